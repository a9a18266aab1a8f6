"""Licences against an independent canonicaliser, ownership by brute force, and stages on odd tables."""

import collections
import hashlib
import random
import re
import time
import unicodedata

import pytest

from millrace.llm import binary_output, licenses, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def canonical(text):
    """The docstring of the operator, read anew: first form."""
    copyright_word = re.compile(r"copyright (holder|owner|notice|licen[sc]e|law|statement)")
    lines = text.lower().split("\n")
    joined = [lines[0]]
    for line in lines[1:]:
        lead = re.match(r"[^a-z0-9]{0,40}", line)[0]
        starts = [k for k in range(len(lead) + 1) if copyright_word.match(line[k:])]
        if starts:  # a wrapped sentence goes on
            joined[-1] += " " + line[starts[-1] :]
        else:
            joined.append(line)
    kept = []
    for line in joined:
        lead = re.match(r"[^a-z0-9]*", line)[0]
        begins = [line[k:] for k in range(min(len(lead), 40) + 1)]
        drop = any(re.match(r"(portions )?copyright|\(c\) *(copyright|[0-9])|©|all rights reserved", x) for x in begins)
        kept.append(" " if drop else line)
    out = "\n".join(kept)
    for old, new in licenses.SPELLINGS:
        out = out.replace(old, new)
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) > 127 else " " for c in out).split(" ")).strip(" ")


def squeezed(x):
    return re.sub(" +", " ", x).strip(" ")


def test_licenses_like_an_independent_canonicaliser(spark):
    r = random.Random(3)
    parts = ["Copyright (c) 2020 A", "(c) 2001", "© me", "All rights reserved.", "лицензия одна", "совсем другое", "rest of text", "the above", "copyright notice and", "* Copyright holder", "Licence", "", "   ", "—", "— copyright 1999", "text copyright 3", "a & b", "per cent"]
    texts = ["\n".join(r.choices(parts, k=r.randint(0, 6))) for _ in range(300)] + ["лицензия одна\ncopyright 2020 x\nrest of text", "совсем другое\ncopyright 2020 x\nrest of text", "rest of text"]
    got = {x["doc_id"]: x["digest"] for x in licenses.scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == hashlib.sha256(squeezed(canonical(t)).encode()).hexdigest(), t
    assert len({got[300], got[301], got[302]}) == 3


@pytest.mark.parametrize("line", ["\n", "лицензия и ещё слова\n", "  \n", "—\n", "copyright\n"])
def test_licenses_of_a_megabyte_in_linear_time(spark, line):
    d = spark.createDataFrame([(1, line * (1_000_000 // len(line.encode())))], "doc_id long, text string")
    licenses.scan(spark, d.limit(0)).collect()
    began = time.time()
    assert licenses.scan(spark, d).count() == 1
    assert len(licenses.scan(spark, d).collect()) == 1 and time.time() - began < 20


def test_licenses_beside_clashing_columns(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, mit, "x", "y", 1), (1, mit, "x", "y", 1), (None, None, None, None, None), (2, "", "x", "y", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, license string, digest string, __digest int")
    got = [(r["doc_id"], r["license"]) for r in licenses.scan(spark, d).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT"), (1, "MIT"), (None, None), (2, None)], key=str)


def test_ownership_by_brute_force(spark):
    """Values are judged by the distinct owners of all their uses, base ones too; one value is hot."""
    r = random.Random(5)
    values = ["Zx9aB3dE5kQ7mN2pR8tV", "Yw8bC4eF6lP9nM3qS7uX", "Xv7cD5fG7mQ0oL4rT6wY", "Wu6dE6gH8nR1pK5sU5vZ", "0123456789abcdef01", "fedcba98765432100f", "AKIAABCDEFGHIJKLMN"]
    rows = []
    for k in range(400):
        own = r.sample(values, r.randint(0, 3)) + ([values[1]] if k % 3 == 0 else [])
        text = " , ".join(own) + (" password = s3cretvalue" + str(k % 4) * 4 if k % 5 == 0 else "")
        owner = "o0" if {values[0], values[4]} & set(own) else None if k % 50 == 49 else f"o{k % 7}"
        rows.append((k if k % 40 else None, text, r.choice(("en", "de")), owner, "clash", 1))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spans string, n_live int")
    got = secrets.find_secrets(spark, d).collect()
    kinds = {"assign": re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
    least = {"assign": 12, "access": 18, "hex": 16}
    owners = collections.defaultdict(set)
    parsed = []
    for _, text, _, owner, *_ in rows:
        base = [(m.start(), kind, m.end(), m[m.lastindex or 0]) for kind, p in kinds.items() for m in p.finditer(text) if len(m[m.lastindex or 0]) >= least[kind]]
        more = [(m.start(), "owned", m.end(), m[0]) for v in values[:4] for m in re.finditer(v, text)]
        more = [x for x in more if not any(x[0] < b[2] and b[0] < x[2] for b in base)]
        parsed.append((base, more))
        for x in base + more:
            owners[x[3]].add(owner)
    want = collections.Counter()
    for (doc, *_), (base, more) in zip(rows, parsed):
        live = [x for x in more if len(owners[x[3]]) == 1]
        spans = sorted([*base, *live], key=lambda x: (x[0], list(secrets.KINDS).index(x[1])))
        want[doc, ",".join(f"{k}:{a}:{b}" for a, k, b, _ in spans), sum(len(owners[x[3]]) == 1 for x in base), sum(len(owners[x[3]]) > 1 for x in base)] += 1
    assert collections.Counter((r["doc_id"], r["spans"], r["n_live"], r["n_example"]) for r in got) == want
    assert any("owned" in k[1] for k in want) and any(k[2] for k in want) and any(k[3] for k in want)


def test_records_without_ids_are_dealt_over_shards(spark):
    rows = [(None if k % 2 else k, f"text number {k}", "en", "s", 1) for k in range(600)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted(binary_output.binary_output(spark, d).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 300 + list(range(0, 600, 2))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0


WORDS = "amber brick cloud drift ember flint grove haven inlet joker knoll lemon mango noble ocean pearl quilt raven slate tulip".split()


def odd_tables():
    r = random.Random(1)
    prose = [" ".join(r.choices(WORDS, k=40)) for _ in range(12)]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(prose)] + [(20, prose[0].upper(), "de", None, 2), (21, prose[1], None, "b", None), (21, prose[1], None, "b", None), (None, prose[2], "en", "b", 3), (None, None, None, None, None), (30, None, "en", "b", 0), (31, "", "en", "b", 0), (32, "word " * 60_000, "en", "b", 9)]
    return {"rows": rows, "empty": []}


@pytest.mark.parametrize("name", ["rows", "empty"])
def test_stages_on_odd_tables(spark, tmp_path, name):
    """Nulls, empty and long texts, repeated rows and ids, columns whose names clash, empty tables: on documents and on the side tables."""
    import corpus_pipeline as p

    more = "mark string, keep int, __score double, __fate_doc int, __hit_doc int, h int, fp int"
    rows = odd_tables()[name]
    docs = spark.createDataFrame([(*x, "m", 1, 0.5, 1, 2, 3, 4) for x in rows], f"{SCHEMA}, {more}")
    for k, (bench, labels) in enumerate((([(1, rows[3][1] if rows else "x y z"), (2, None)], [(i, i % 2, 0) for i in range(12)]), ([], []))):
        sf = tmp_path / str(k)
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        outs = {n: stage(spark, docs, str(sf)) for n, stage in p.STAGES}
        for n in ("quality", "exact_dedup", "near_dedup", "decontaminate"):
            assert outs[n].columns == docs.columns
        if not rows:
            assert all(d.count() == 0 for d in outs.values())
            continue
        kept = {n: collections.Counter((r["doc_id"], r["text"]) for r in d.collect()) for n, d in outs.items() if n != "packing"}
        low = lambda t: (t or "").lower()
        assert sum(kept["exact_dedup"].values()) == len({low(x[1]) for x in rows}) == len({low(t) for _, t in kept["exact_dedup"]})
        assert (20, rows[0][1].upper()) in kept["exact_dedup"] and (21, rows[1][1]) in kept["exact_dedup"] and (31, "") in kept["exact_dedup"]
        assert len({low(t) for _, t in kept["near_dedup"]}) == sum(kept["near_dedup"].values()) and (0, rows[0][1]) in kept["near_dedup"] and (20, rows[0][1].upper()) not in kept["near_dedup"]
        gone = [x for x in rows if (x[0], x[1]) not in kept["decontaminate"]]
        assert gone == ([rows[3]] if bench else [])
        pieces = outs["packing"].collect()
        assert collections.Counter(r["doc_id"] for r in pieces if r["start"] == 0) == collections.Counter(x[0] for x in rows)
        if not labels:
            assert kept["quality"] == collections.Counter() or sum(kept["quality"].values()) == len(rows)


def test_long_text_through_unicode():
    """The independent reading above knows what the operator's first form keeps: characters beyond ASCII."""
    assert unicodedata.category("é") == "Ll" and squeezed(canonical("é — x\n\nCopyright 2020")) == "é — x"
