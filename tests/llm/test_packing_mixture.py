"""The mixture of every window that ``pack`` fills: natural shares, targets, their drain, many sources."""

import collections

import pytest

from millrace.llm import packing

WORDS = "amber brick cloud drift ember flint grove haven inlet joker".split()
WINDOW, QUANTUM = 128, 8


def table(spark, sizes):
    rows, doc = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((doc, " ".join(WORDS[(doc + j) % 10] for j in range(5 + (7 * k) % 40)), source))
            doc += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def mixture(pieces):
    by = collections.defaultdict(collections.Counter)
    for p in pieces:
        by[p["sequence_id"]][p["source"]] += p["length"]
    return [by[k] for k in sorted(by)]


def packed(spark, sizes, targets=None):
    got = packing.pack(spark, table(spark, sizes), window=WINDOW, block=8, quantum=QUANTUM, targets=targets).collect()
    whole = collections.Counter(p["doc_id"] for p in got)
    assert len(whole) == sum(sizes.values())
    spans = collections.defaultdict(list)
    for p in got:
        spans[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
    for s in spans.values():
        at = 0
        for start, n, size in sorted(s):
            assert start == at
            at += n
        assert at == size
    return mixture(got)


def follows(windows, weights, slack):
    """After every window, each source has had its share of all so far within ``slack`` ids."""
    seen, all_ids, total = collections.Counter(), 0, sum(weights.values())
    for w in windows:
        seen.update(w)
        all_ids += sum(w.values())
        assert all(abs(seen[s] - all_ids * x / total) <= slack for s, x in weights.items()), (seen, all_ids)


def test_natural_shares_in_every_window(spark):
    sizes = {"a": 300, "b": 100, None: 50, "c": 5}
    windows = packed(spark, sizes)
    totals = sum(windows, collections.Counter())
    follows(windows, totals, WINDOW / 2)
    assert all(abs(w["a"] / WINDOW - totals["a"] / sum(totals.values())) < 0.2 for w in windows[:-1])


def test_targets_in_every_window_until_a_source_is_empty(spark):
    sizes, targets = {"a": 300, "b": 300, "c": 300, "rest": 60, "other": 30}, {"a": 5, "b": 3, "c": 2}
    windows = packed(spark, sizes, targets)
    totals = sum(windows, collections.Counter())
    # the first source to be empty is the one with the largest target for its size
    full = int(totals["a"] / 0.5 / WINDOW) - 1
    follows(windows[:full], targets, 2 * QUANTUM + 2)
    assert all(abs(w[s] - WINDOW * t / 10) <= 2 * QUANTUM + 2 for w in windows[:full] for s, t in targets.items())
    # then b and c go on, 3 to 2
    second = full + 3 + int((totals["b"] - totals["a"] * 3 / 5) / 0.6 / WINDOW) - 4
    for w in windows[full + 3 : second]:
        assert w["a"] == 0 and abs(w["b"] - WINDOW * 0.6) <= 2 * QUANTUM + 2
    # sources without a target come when all named ones are empty, in their shares
    named = totals["a"] + totals["b"] + totals["c"]
    assert all(not w["rest"] and not w["other"] for w in windows[: named // WINDOW])
    last = windows[named // WINDOW + 1 :]
    assert last and all(not (w["a"] or w["b"] or w["c"]) for w in last)


def test_targets_of_one_and_of_none(spark):
    windows = packed(spark, {"a": 40, None: 40}, {None: 1.0})
    first = sum(w[None] for w in windows)
    assert all(w["a"] == 0 for w in windows[: first // WINDOW])
    assert sum(sum(w.values()) for w in packed(spark, {"a": 10}, {})) > 0


def test_each_of_many_sources_is_a_queue(spark):
    sizes = {f"s{i:03d}": 6 for i in range(300)}
    windows = packed(spark, sizes)
    totals = sum(windows, collections.Counter())
    half = sum(windows[: len(windows) // 2], collections.Counter())
    assert len(totals) == 300 and all(abs(half[s] - totals[s] / 2) <= 3 * QUANTUM for s in totals)


@pytest.mark.parametrize("totals,weights", [([10, 1000, 7], [3, 1, 5]), ([5, 5, 5], [1, 1, 1]), ([0, 9], [4, 2]), ([123456789, 987654321, 5], [7, 1, 1])])
def test_shares_by_weight(totals, weights):
    s = packing.Shares(totals, weights)
    last = [0] * len(totals)
    for m in sorted({0, 1, 2, s.n // 7, s.n // 3, s.n // 2, s.n - 1, s.n}):
        g = s.given(m)
        assert sum(g) == m and all(b <= a <= t for a, b, t in zip(g, last, totals))
        live = [q for q, t in enumerate(totals) if g[q] < t]
        x = [g[q] / weights[q] for q in live]
        assert all(abs(a - b) <= 1.5 for a in x for b in x)
        last = g
