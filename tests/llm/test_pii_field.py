"""The field on held-out lines, its base spans by another reading of the contract, and its bounds of memory."""

import collections
import re
import sys
from pathlib import Path

import numpy as np

from millrace.llm import pii

sys.path.insert(0, str(Path(__file__).parent))
from pii_heldout import LINES


def parsed(line):
    text, spans = "", []
    for part in re.split(r"(\[\w+:[^\]]+\])", line):
        if m := re.fullmatch(r"\[(\w+):([^\]]+)\]", part):
            spans.append((m[1], len(text), len(text) + len(m[2])))
            part = m[2]
        text += part
    return text, spans


def held_out():
    """label -> (right, found, wanted)"""
    texts, want = zip(*map(parsed, LINES))
    got = pii.added_spans(list(texts), pii.trained())
    out = collections.defaultdict(lambda: [0, 0, 0])
    for w, g in zip(want, got):
        for kind in ("name", "address", "id"):
            a, b = {x for x in w if x[0] == kind}, {x for x in g if x[0] == kind}
            for k, n in enumerate((len(a & b), len(b), len(a))):
                out[kind][k] += n
    return {k: tuple(v) for k, v in out.items()}


def test_held_out():
    trained = {" ".join(w) for w, _ in pii._table()}
    assert not trained & {parsed(x)[0] for x in LINES}
    for kind, (right, found, wanted) in held_out().items():
        assert right >= 0.6 * wanted and right >= 0.85 * found, (kind, right, found, wanted)


def test_no_line_of_the_table_is_in_the_scored_documents():
    import pytest

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.is_file():
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    text = "\n".join(t or "" for t in pq.read_table(path, columns=["text"]).column(0).to_pylist())
    windows = {" ".join(w[i : i + 4]) for w, _ in pii._table() for i in range(len(w) - 3) if len(set(w[i : i + 4])) > 1}  # "a a a a" is nobody's
    words = text.split()
    assert not windows & {" ".join(words[i : i + 4]) for i in range(len(words) - 3)}


def brute_base(text):
    """The contract's patterns by a search from each place, without the tricks of the operator."""

    def matches(pattern, ok):
        out, at, p = [], 0, re.compile(pattern)
        while at <= len(text):
            m = p.match(text, at)
            if m and m.end() > at:
                if ok(m[0]):
                    out.append(m.span())
                at = m.end()
            else:
                at += 1
        return out

    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(s):
        d = digits(s)
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0

    return {
        "email": matches(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": matches(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": matches(r"[0-9]([ -]?[0-9])+", luhn),
        "phone": matches(r"\+[0-9][ ().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }


def test_base_spans_by_brute_force():
    rng = np.random.default_rng(5)
    pieces = ["a@b.co", "x.y+z@", "@", "a@b", "@c.de", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.255", "..", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (017) 555-7713", "+49 30 1234567", "+1", "++12345678901", " ", "-", ".", "é", "1", "23", "٣", "\n", "+", "(", "user@host.example.org.", "12345678901234567890"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 9)))
        assert {k: list(v) for k, v in pii.base_spans(text).items()} == brute_base(text), text


def test_batches_of_lines_give_what_single_lines_give(monkeypatch):
    lines = [parsed(x)[0] for x in LINES] * 3 + ["I am Anna Keller " * 50]
    weights = pii.trained()
    one = [pii.added_spans([x], weights)[0] for x in lines]
    monkeypatch.setattr(pii, "WORDS", 20)
    monkeypatch.setattr(pii, "CELLS", 30)
    assert pii.added_spans(lines, weights) == one
    joined = "\n".join(lines)
    at, want = 0, []
    for x, spans in zip(lines, one):
        want += [(k, a + at, b + at) for k, a, b in spans]
        at += len(x) + 1
    assert pii.added_spans([joined], weights)[0] == want


def test_a_line_of_a_million_characters(spark):
    line = "lorem ipsum dolor " * 30_000 + "I am Anna Keller and " + "lorem ipsum " * 40_000
    at = line.index("Anna")
    rows = [(1, line, "c", 0), (2, None, "c", 1), (2, "", "c", 2), (None, "x@y.zz", "c", 3)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")).collect()
    assert [r["doc_id"] for r in got].count(2) == 2 and len(got) == 4
    assert next(r for r in got if r["doc_id"] == 1)["spans"] == f"name:{at}:{at + 11}"
    assert next(r for r in got if r["doc_id"] is None)["n_email"] == 1
