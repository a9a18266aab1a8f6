"""Operators on literal records: pages, robots, evaluation goldens, augmentation, ingestion, commands."""

import json

from pyspark.sql import functions as F

from millrace.operators import augment as A
from millrace.operators import badcases as B
from millrace.operators import compare as O
from millrace.operators import html as H
from millrace.operators import profile as P
from millrace.operators import robots as R
from millrace.operators import split as G
from millrace.sources import jsonl
from millrace.sources.web import Fetcher, fetch, text_of
from millrace.streaming import ingest as N

LIST = '<article class="product_pod"><h3><a href="p/1.html">x</a></h3></article><article class="product_pod"><h3><a href="p/2.html">y</a></h3></article><ul><li class="next"><a href="page2.html">n</a></li></ul>'
DETAIL = """<ul class="breadcrumb"><li><a>Home</a></li><li>Books</li><li>Poetry</li><li>T</li></ul><div class="product_main"><h1> A  <b>title</h1>
<p class="price_color">£51.77</p><p class="instock availability">In stock (22 available)<p class="star-rating Three"></p></div><div class="item active"><img src="../../m/i.jpg"></div>
<div id="product_description"><h2>D</h2></div><p>Some &amp; text</p><table class="table table-striped"><tr><th>UPC</th><td>u1</td></tr><tr><th>Tax</th><td>£0.00</td></tr></table><script>"</p>"</script>"""


def test_pages(spark):
    r = H.list_pages(spark.createDataFrame([("http://s/", LIST)], "url string, html string")).first()
    assert r["urls"] == ["p/1.html", "p/2.html"] and r["next"] == "page2.html"
    p = H.product_pages(spark.createDataFrame([(1, "http://s/a/b/c.html", DETAIL), (2, "http://s/", None)], "seq long, url string, html string")).orderBy("seq").collect()
    assert (p[0]["title"], p[0]["category"], p[0]["price"], p[0]["currency"], p[0]["stock_count"], p[0]["rating"], p[0]["description"]) == ("A title", "Poetry", 51.77, "GBP", 22, 3, "Some & text")
    assert [tuple(x) for x in p[0]["product_information"]] == [("UPC", "u1"), ("Tax", "£0.00")] and p[0]["image_url"] == "http://s/m/i.jpg"
    assert p[1]["title"] == "" and p[1]["price"] is None


def test_robots(spark):
    text = "User-agent: a\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\n\nUser-agent: b\nDisallow: /\nno colon"
    rules = R.parse_rules(spark.createDataFrame([("", text)], "host string, text string"))
    assert [(r["directive"], r["prefix"]) for r in rules.orderBy("seq").collect()] == [("disallow", "/x"), ("allow", "/x/y")]
    urls = spark.createDataFrame([("http://s/x/1",), ("http://s/x/y/2",), ("http://s/z",)], "url string")
    got = {r["url"]: r["allowed"] for r in R.match(urls, rules.select("directive", "prefix")).collect()}
    assert got == {"http://s/x/1": False, "http://s/x/y/2": True, "http://s/z": True}


def test_split_rescue_and_keep_first(spark):
    rows = spark.createDataFrame([(i, None, None) for i in range(5)], "seq long, upc string, product_url string")
    assert {r["split"] for r in G.split(rows, val_ratio=0.0).collect()} == {"train"}
    assert [r["split"] for r in G.split(rows, val_ratio=0.005).orderBy("seq").collect()] == ["train"] * 4 + ["val"]
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq long, t string")
    assert sorted(r["seq"] for r in G.keep_first(d, ["t"], "seq").collect()) == [1, 3]


def test_nearest_rank(spark):
    d = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    assert d.agg(P.nearest_rank("x", 0.5).alias("a"), P.nearest_rank("x", 0.95).alias("b")).first() == (5.0, 10.0)


GOLD = '{"availability":{"in_stock":true,"stock_count":3},"category":null,"currency":"GBP","key_attributes":{"availability_text":"In stock","price_excl_tax":1.0,"price_incl_tax":1.0,"product_type":"Books","review_count":0,"tax":0.0,"upc":"u"},"price":1.0,"rating":4,"title":"t"}'


def test_badcase_golden(spark):
    pred = GOLD.replace('"rating":4', '"rating":null')
    rows = spark.createDataFrame([(0, "é" * 1300, GOLD, pred, pred, True, True), (1, "x", GOLD, GOLD, GOLD, True, True), (2, "x", GOLD, None, '{"a', False, False), (3, "x", GOLD, "{}", "{}", True, False)], "pos long, input string, gold_text string, pred_text string, raw_response string, parse_ok boolean, schema_ok boolean")
    a = B.analyze(rows).orderBy("pos").collect()
    assert a[0]["mismatch_fields"] == ["rating"] and a[0]["error_type"] == "extraction_error" and a[0]["bucket_tags"] == ["long_input", "has_non_ascii", "missing_category"]
    assert not a[1]["is_badcase"] and a[1]["error_type"] == "extraction_error"
    assert a[2]["error_type"] == "truncation_suspected" and a[3]["error_type"] == "type_error"


def test_compare(spark):
    t = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    rep = O.report(O.diff(t([("title_exact_match_rate", 0.9), ("price_abs_error_avg", 0.2), ("json_parse_rate", 1.0), ("only", 1.0)]), t([("title_exact_match_rate", 0.8915), ("price_abs_error_avg", 0.1), ("json_parse_rate", 1.0)])))
    by = {r["metric"]: r for r in rep["metrics"]}
    assert by["title_exact_match_rate"]["delta"] == -0.0085 and not by["title_exact_match_rate"]["improved"]
    assert by["price_abs_error_avg"]["improved"] and by["json_parse_rate"]["improved"] and by["only"]["delta"] is None
    assert "| only | 1.0000 |  |" in O.markdown(rep)


def test_augment(spark):
    text = "Title: T-1\nCategory: C\nPrice: 1.00 GBP\nAvailability: In stock (3 available)\nDescription: One. Two.\nProduct Information:\nUPC: u\nTax: £0.00"
    rows = spark.createDataFrame([(1, "i", text, GOLD)], "seq long, instruction string, input string, output string")
    p = A.parse(rows)
    got = {s: A.apply(p, s).collect() for s in A.rewrites()}
    assert got["special_char_perturb"][0]["input"] == text.replace("T-1", "T—1").replace("£", "￡")
    assert "UPC" not in got["drop_upc_line"][0]["input"] and json.loads(got["drop_upc_line"][0]["output"])["key_attributes"]["upc"] is None
    assert got["drop_stock_count_line"][0]["input"].splitlines()[3] == "Availability: In stock"
    assert "Description: One. Two. One." in got["description_repeat_variant"][0]["input"]
    assert sorted(got["shuffle_fields"][0]["input"].splitlines()) == sorted(text.splitlines())
    assert got["trim_product_information"] == [] and "GBP 0.00" in got["pi_numeric_surface_perturb"][0]["input"]
    out = A.augment(rows, list(A.rewrites()), per_row=2).collect()
    assert len(out) <= 3 and sum(r["strategy"] is None for r in out) == 1


def test_ingest_twice(spark, tmp_path):
    landed = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None)], "seq long, url string")
    sink = str(tmp_path / "sink")
    assert N.ingest_batch(landed, sink, order="seq") == 2
    assert N.ingest_batch(landed, sink, order="seq") == 0
    src = str(tmp_path / "in")
    landed.write.parquet(src)
    for _ in range(2):
        N.ingest_stream(spark, src, "seq long, url string", str(tmp_path / "s2"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "s2")).count() == 2


def test_fetch(spark):
    class Reply:
        headers = None

        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return self.body

    def make():
        def opener(url):
            if "bad" in url:
                raise OSError("no")
            return Reply("é".encode())

        return Fetcher(delay=(0, 0), opener=opener, sleep=lambda s: None)

    urls = spark.createDataFrame([("http://s/a", True), ("http://s/bad", True), ("http://s/c", False)], "url string, allowed boolean")
    got = {r["url"]: (r["status"], r["html"]) for r in fetch(urls, make).collect()}
    assert got == {"http://s/a": ("ok", "é"), "http://s/bad": ("failed", None), "http://s/c": ("blocked", None)}
    assert text_of("é".encode(), "latin-1") == "é" and text_of(b"\xe9", None) == "é"


def test_commands(spark, tmp_path, capsys):
    from millrace import cli

    rows = [{"product_url": f"u{i}", "title": f"T{i}", "raw_breadcrumb": ["Home"], "category": "C", "price": 2.5, "currency": "GBP", "availability_text": "In stock (2 available)", "in_stock": True, "stock_count": 2, "rating": 3, "raw_rating_text": "Three", "description": "One. One. Two.", "product_information": {"UPC": f"x{i}", "Tax": "£0.00", "Price (excl. tax)": "£2.50", "Price (incl. tax)": "£2.50", "Product Type": "Books", "Availability": "In stock", "Number of reviews": "0"}, "image_url": None, "scraped_at": "2024"} for i in range(12)] + [{"product_url": "bad", "title": "B", "price": None}, {"product_url": "odd", "title": "O", "raw_breadcrumb": "no list"}, {"product_url": "odd2", "product_information": [1]}]
    src = tmp_path / "products.jsonl"
    src.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    o = lambda n: str(tmp_path / n)
    assert cli.main(["build_sft", "--in", str(src), "--out", o("train"), "--val_out", o("val"), "--val_ratio", "0.5", "--report", o("report.json")]) == 0
    rep = json.loads((tmp_path / "report.json").read_text())
    assert (rep["total_read"], rep["total_written"], rep["drop_reasons"]["price_parse_failed"]) == (15, 12, 1) and rep["fixes_applied"]["description_deduped"] == 12
    assert rep["drop_reasons"]["other_exception"] == 2 and any("odd" in x["excerpt"] for x in rep["sample_badcases"])
    assert len(rep["sample_dedup_cases"]) == 10 and (rep["sample_dedup_cases"][0]["before_head_preview"], rep["sample_dedup_cases"][0]["after_mid_preview"]) == ("One. One. Two.", "One. Two.")
    train = [json.loads(x) for f in (tmp_path / "train").glob("part-*") for x in f.read_text().splitlines()]
    assert list(train[0]) == ["instruction", "input", "output"] and train[0]["input"].splitlines()[6].startswith("UPC: ")
    assert cli.main(["stats", "--in", str(src), "--log", o("logs/stats.log")]) == 0
    assert "ended with" in (tmp_path / "logs" / "stats.log").read_text()
    assert cli.main(["lora_eval", "--val_file", o("val"), "--pred_out", o("lora"), "--report_out", o("lora.json"), "--predictor", "millrace.operators.infer:Rules", "--log", ""]) == 0
    lora = json.loads((tmp_path / "lora.json").read_text())
    assert lora["model_source"] == "predictor" and lora["total_evaluated"] == lora["total_requested"] > 0 and lora["json_parse_rate"] == 1.0 and lora["generation_config"]["max_new_tokens"] == 256
    assert cli.main(["lora_eval", "--val_file", o("val"), "--log", ""]) == 1
    assert cli.main(["baseline", "--val", o("val"), "--pred_out", o("pred"), "--report_out", o("eval.json"), "--mode", "rules", "--log", ""]) == 0
    assert json.loads((tmp_path / "eval.json").read_text())["json_parse_rate"] == 1.0
    assert cli.main(["analyze_badcases", "--gold", o("val"), "--pred", o("pred"), "--summary_out", o("sum.json"), "--badcases_out", o("bad")]) == 0
    assert cli.main(["augment_sft_data", "--train_in", o("train"), "--badcase_in", o("bad"), "--train_out", o("aug")]) == 0
    assert cli.main(["compare_eval", "--baseline_report", o("eval.json"), "--lora_report", o("eval.json"), "--out", o("cmp.json"), "--md_out", o("cmp.md")]) == 0
    assert "metrics did not get worse" in capsys.readouterr().out


def test_jsonl(spark, tmp_path):
    p = str(tmp_path / "x")
    assert jsonl.read(spark, p, "a int").count() == 0
    (tmp_path / "x").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r["a"] for r in jsonl.read_ordered(spark, p, "a int").orderBy("seq").collect()] == [1, 2]
    assert jsonl.write(spark.range(3).withColumnRenamed("id", "a"), str(tmp_path / "y"), single=True) == 3
    assert jsonl.write(spark.range(50).selectExpr("49 - id AS o", "id AS a"), str(tmp_path / "z"), order="o") == 50
    assert [r["a"] for r in jsonl.read_ordered(spark, str(tmp_path / "z"), "a int").orderBy("seq").collect()] == list(range(49, -1, -1))


def test_order_of_files_and_blocks(spark, tmp_path):
    """Files of different size, and one file of many blocks."""
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.json").write_text('{"a":1}\n')
    (d / "b.json").write_text("".join(f'{{"a":{i}}}\n{chr(10) if i % 7 == 0 else ""}' for i in range(2, 3000)))
    (d / "c.json").write_text('{"a":3000}')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [tuple(r) for r in jsonl.read_ordered(spark, str(d), "a int").orderBy("seq").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(i, i + 1) for i in range(3000)]


def test_decode(spark):
    rows = [(b"\xe9", None), ("é".encode(), "latin-1"), ("привет".encode("cp1251"), "windows-1251"), ("привет".encode(), "utf-8"), (b"\xff\xe9", "no such"), (None, "utf-8"), (b"", "koi8-r")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b binary, e string")
    got = [r["t"] for r in d.select("i", jsonl.decode(F.col("b"), F.col("e")).alias("t")).orderBy("i").collect()]
    assert got == ["é", "é", "привет", "привет", "ÿé", None, ""]


def test_plans_stay_small(spark):
    """A filter on a record's fate must not be copied into all that decides it."""
    from millrace import fixtures
    from millrace.operators import sanitize as S

    d = fixtures.products(spark, "/root/testdata/sf0.001")
    for x in (S.accepted(S.sanitize(d)), S.drop_counts(S.sanitize(d)), G.split(S.accepted(S.sanitize(d)).withColumn("upc", F.col("key_attributes.upc")))):
        assert len(x._jdf.queryExecution().optimizedPlan().toString()) < 100_000


SITE = {
    "http://s/": '<article class="product_pod"><h3><a href="p/1.html">x</a></h3></article><article class="product_pod"><h3><a href="p/2.html">y</a></h3></article><article class="product_pod"><h3><a href="bad.html">z</a></h3></article><ul><li class="next"><a href="two.html">n</a></li></ul>',
    "http://s/two.html": '<article class="product_pod"><h3><a href="p/1.html">x</a></h3></article><article class="product_pod"><h3><a href="q/3.html">y</a></h3></article><ul><li class="next"><a href="gone.html">n</a></li></ul>',
    **{f"http://s/{p}.html": DETAIL for p in ("p/1", "p/2", "q/3")},
}


def _site_fetch(urls):
    """A stand-in for the web, in Python workers."""
    import pandas as pd

    def run(parts):
        for d in parts:
            rows = [(u, SITE.get(u) if ok else None, "blocked" if not ok else "ok" if u in SITE else "failed", "robots" if not ok else None if u in SITE else "gone") for u, ok in zip(d["url"], d["allowed"])]
            yield pd.DataFrame(rows, columns=["url", "html", "status", "error"])

    return urls.select("url", "allowed").mapInPandas(run, "url string, html string, status string, error string")


def test_crawl(spark, tmp_path):
    from millrace.plans.crawl import crawl

    out = str(tmp_path / "c")
    got = crawl(spark, "http://s/", _site_fetch, "User-agent: *\nDisallow: /q\n", out, save_html=True)
    assert {k: got[k] for k in got if k != "parsed_path"} == {"pages_crawled": 2, "products_written": 2, "failed_urls_count": 2, "blocked_urls_count": 1}
    records = spark.read.json(got["parsed_path"])
    assert sorted(r["product_url"] for r in records.collect()) == ["http://s/p/1.html", "http://s/p/2.html"] and records.first()["product_information"]["UPC"] == "u1"
    log = lambda n: sorted(tuple(r) for r in spark.read.option("sep", "\t").csv(f"{out}/logs/{n}").collect())
    assert log("blocked") == [("http://s/q/3.html", "robots")] and log("failed") == [("http://s/bad.html", "gone"), ("http://s/gone.html", "list_fetch_error: gone")]
    assert spark.read.parquet(f"{out}/raw_html").count() == 2
    again = crawl(spark, "http://s/", _site_fetch, "", out)  # goes on: only what the records lack
    assert again["products_written"] == 1 and spark.read.json(got["parsed_path"]).count() == 3
    strict = crawl(spark, "http://s/", _site_fetch, None, str(tmp_path / "s"), strict=True)
    assert strict["pages_crawled"] == 0 and strict["failed_urls_count"] == 1
    blocked = crawl(spark, "http://s/", _site_fetch, "User-agent: *\nDisallow: /p/2\n", str(tmp_path / "b"), strict=True)
    assert blocked["pages_crawled"] == 1 and blocked["blocked_urls_count"] == 1


def test_chat_service():
    """Against a server: guided decoding is given up on 400, 429 and 5xx are tried again, other errors are the row's."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from millrace.operators.infer import ChatService, LocalModel

    seen, replies = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            code = replies.pop(0)
            body = json.dumps({"choices": [{"message": {"content": "{}"}}]}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        service = ChatService(f"http://127.0.0.1:{server.server_port}/v1", "m", "k")
        replies += [400, 200]
        assert service.predict("i", "t", 9) == ("{}", None) and "guided_json" in seen[0] and "guided_json" not in seen[1]
        replies += [429, 200]
        assert service.predict("i", "t", 9) == ("{}", None)
        replies += [401]
        assert service.predict("i", "t", 9) == ("", "http_401")
        assert seen[-1]["messages"][1]["content"] == "i\n\nt" and seen[-1]["max_tokens"] == 9
    finally:
        server.shutdown()
    try:
        LocalModel("x")
    except RuntimeError as e:
        assert "transformers" in str(e)
