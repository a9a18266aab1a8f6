"""Scalar functions against independent Python, and literals from the specification."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import casts as C
from millrace.functions import jsonx as J
from millrace.functions import text as T
from millrace.functions.urls import image_url, robots_path, url_join


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(*cols).collect()]


def test_sentence_dedup_like_python(spark):
    rng = random.Random(1)
    words = ["A b.", "a  B.", "c!", "d", "\n", "é。", "x？ ", " ", "c !"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["", "x" * 5000 + ". " + "x" * 5000 + "."]

    def spec(t):
        seen, out = set(), []
        for p in re.split(r"(?<=[。！？.!?])\s+|\n+", t):
            p = " ".join(p.split())
            m = re.sub(r"\s+", "", p).lower()
            if p and m not in seen:
                seen.add(m)
                out.append(p)
        return " ".join(out)

    got = one(spark, texts, "t string", T.sentence_dedup(F.col("t")))
    assert [g[0] for g in got] == [spec(t) for t in texts]


def test_half_trim(spark):
    double = "The same words are here again, once more. " * 2
    texts = [double.strip(), "short", "a" * 30 + "b" * 30, None]

    def spec(t):
        if t is None or len(t) < 40:
            return t
        a, b = (" ".join(h.split()) for h in (t[: len(t) // 2], t[len(t) // 2 :]))
        return a if difflib.SequenceMatcher(None, a, b).ratio() > 0.92 else t

    assert [g[0] for g in one(spark, texts, "t string", T.half_trim(F.col("t")))] == [spec(t) for t in texts]


def test_repair(spark):
    texts = ["Â£5", "donâ\u0080\u0099t", "plain", "Ã©", "€ Â", None]
    got = one(spark, texts, "t string", T.fix(F.col("t"))["text"], T.fix(F.col("t"))["changed"])
    assert got == [("£5", True), ("don’t", True), ("plain", False), ("é", True), ("€", True), ("", False)]


def test_casts(spark):
    assert one(spark, ["£51.77", "$-3", "free", None], "t string", C.price(F.col("t"))["price"], C.price(F.col("t"))["currency"])[:3] == [(51.77, "GBP"), (3.0, "USD"), (None, "")]
    assert one(spark, ["In stock (19 available)", "Not in stock"], "t string", C.stock_count(F.col("t")), C.in_stock(F.col("t"))) == [(19, True), (None, True)]
    assert one(spark, ["Three", "star-rating five", "six", None], "t string", C.rating_word(F.col("t"))) == [(3,), (5,), (None,), (None,)]
    assert one(spark, ["3.7", "x-12y", ""], "t string", C.parse_int(F.col("t")), C.parse_float(F.col("t"))) == [(3, 3.7), (-12, -12.0), (None, None)]
    crumbs = [(["Home", "Books", "Add a comment", "Title"],), (["Home"],)]
    assert [r[0] for r in spark.createDataFrame(crumbs, "c array<string>").select(C.category_of(F.col("c"))).collect()] == ["Title", None]
    rows = spark.createDataFrame([(9, "Two"), (2, "Two"), (None, "Four"), (7, None)], "n int, t string")
    strict = [tuple(r[0]) for r in rows.select(C.rating(F.col("n"), F.col("t"), True)).collect()]
    assert strict == [(None, True, True, False), (2, False, False, False), (4, False, False, False), (None, True, False, True)]
    assert [r[0]["value"] for r in rows.select(C.rating(F.col("n"), F.col("t"), False)).collect()] == [2, 2, 4, None]


@pytest.mark.parametrize("text,ok", [('{"a":1}', True), ('x {"a":1} y', True), ("[1]", False), ('[{"a":1}]', True), ("", False), ("}{", False), (None, False)])
def test_lenient_object(spark, text, ok):
    assert one(spark, [text], "t string", J.lenient_object(F.col("t")).isNotNull()) == [(ok,)]


def test_schema_error_order(spark):
    base = '{"title":"t","category":null,"price":1.5,"currency":"GBP","availability":{"in_stock":true,"stock_count":null},"rating":3,"key_attributes":{"upc":"u","product_type":"p","price_excl_tax":1,"price_incl_tax":1,"tax":0,"availability_text":"a","review_count":0}}'
    cases = {base: None, base.replace('"title":"t"', '"title":1'): "schema_title_invalid", base.replace("1.5", "true"): "schema_price_invalid", base.replace("GBP", "USD"): "schema_currency_invalid", base.replace('"rating":3', '"rating":3.0'): None if False else "schema_rating_invalid", base.replace('"rating":3', '"rating":6'): "schema_rating_invalid", base.replace('"review_count":0', '"review_count":0.5'): "schema_review_count_invalid", "[]": "invalid_output_json"}
    d = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("v", J.as_object(F.col("t"))).select("t", J.schema_error("v").alias("e"))
    assert {r["t"]: r["e"] for r in d.collect()} == cases


def test_urls(spark):
    assert one(spark, ["http://a.b/c/d?x=1#f", "http://a.b", "http://a.b/?q=2"], "t string", robots_path(F.col("t"))) == [("/c/d?x=1",), ("/",), ("/?q=2",)]
    rows = [("http://a.b/c/d", "../e"), ("http://a.b/c/", "f"), ("http://a.b", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "b string, h string").select(url_join("b", "h")).collect()] == ["http://a.b/e", "http://a.b/c/f", None]
    assert image_url("http://a.b/c/d.html", "../m/x.jpg") == "http://a.b/m/x.jpg"
