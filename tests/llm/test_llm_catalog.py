"""Registered queries over whole small tables: SQL where there is some, and the pipeline by brute force."""

import collections
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op1_licenses", "op2_exact_dedup"])
def test_same_as_sql(spark, name):
    import __spark_entry__ as e

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = e.queries()[name](spark, SF), c.sql(e.oracle_sql()[name])
    cols = sorted(got.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(map(str, ([r[x] for x in cols] for r in got.collect()))) == sorted(map(str, ([r[i] for i in at] for r in want.fetchall())))


def test_eleven_are_registered():
    import __spark_entry__ as e

    names = [n.split("_")[0] for n in e.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 11)) and "pipeline" in e.queries()


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as p

    import sys

    sys.path.insert(0, os.path.dirname(__file__))
    from test_llm_operators import brute_components, brute_fingerprint, low

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs_out = spark.read.parquet(out)
        after = docs_out.collect()
        if name != "packing":
            assert docs_out.columns == docs.columns
        kept = {r["doc_id"] for r in after}
        if name == "quality":
            wrong = [r["doc_id"] for r in before if r["doc_id"] in labels and (r["doc_id"] in kept) != bool(labels[r["doc_id"]])]
            assert len(wrong) <= 0.1 * sum(r["doc_id"] in labels for r in before)
        elif name == "exact_dedup":
            last = {}
            for r in before:
                last[low(r["text"])] = max(r["doc_id"], last.get(low(r["text"]), -1))
            assert kept == set(last.values()) and len(after) == len(last)
        elif name == "near_dedup":
            comp = brute_components({brute_fingerprint(r["text"]) for r in before})
            first = {}
            for r in before:
                c = comp[brute_fingerprint(r["text"])]
                first[c] = min(r["doc_id"], first.get(c, 1 << 62))
            assert kept == set(first.values())
        elif name == "decontaminate":
            words = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
            flat = [words(b) for b in bench]
            assert kept == {r["doc_id"] for r in before if not any(b in words(r["text"]) for b in flat)}
        else:
            tokens = collections.Counter()
            for r in after:
                tokens[r["doc_id"]] += r["length"]
            assert set(tokens) == {r["doc_id"] for r in before} and all(tokens[r["doc_id"]] == r["doc_tokens"] for r in after)
        docs = docs_out
