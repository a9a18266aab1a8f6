"""Traversal of listing pages with robots rules, in rounds over a frontier.

Every round is written before it is read: pages, records and logs lie in the output folder, so
a lost executor never makes the web be asked again, and a crawl that is started anew goes on
with what its records lack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_join
from ..operators import html as H
from ..operators import robots as R
from ..sources import jsonl
from ..streaming.ingest import new_rows

PAGES = "url string, html string, status string, error string"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of the records that are there already; lines that are no JSON are passed over."""
    return jsonl.read(spark, path, "product_url string", mode="DROPMALFORMED").select(F.col("product_url").alias("url")).filter("url <> ''").distinct()


def crawl(spark: SparkSession, start: str, fetch: Callable[[DataFrame], DataFrame], robots: str | None, out: str, max_pages: int = 50, strict: bool = False, save_html: bool = False) -> dict:
    """Counters of the crawl. fetch: (url, allowed) to (url, html, status, error).

    Below ``out``: parsed/products.jsonl (records, appended), logs/failed and logs/blocked (url, reason),
    raw_html (if ``save_html``) and rounds (pages as they came). A listing that can't be had ends the
    crawl; a product page that can't is logged and skipped. In strict mode a site without robots file,
    or a blocked product page, ends it too.
    """
    parsed = f"{out}/parsed/products.jsonl"
    count = {"pages_crawled": 0, "products_written": 0, "failed_urls_count": 0, "blocked_urls_count": 0, "parsed_path": parsed}

    def log(pages: DataFrame) -> None:
        for status in ("failed", "blocked"):
            rows = pages.filter(F.col("status") == status).select("url", F.coalesce("error", F.lit("")).alias("reason"))
            if n := rows.count():
                jsonl.append_log(rows, f"{out}/logs/{status}")
                count[f"{status}_urls_count"] += n

    policy = R.fallback(strict) if robots is None else {"allow_all": False, "available": True}
    if robots is None and strict:
        log(spark.createDataFrame([(start.rstrip("/") + "/robots.txt", None, "failed", "robots_unavailable_in_strict_mode")], PAGES))
        return count
    rules = R.parse_rules(spark.createDataFrame([("", robots or "")], "host string, text string")).select("directive", "prefix")
    allowed = lambda urls: R.match(urls, rules, allow_all=policy["allow_all"]).select("url", "allowed")

    def landed(urls: DataFrame, name: str) -> DataFrame:
        fetch(allowed(urls)).write.mode("overwrite").parquet(f"{out}/rounds/{name}")
        return spark.read.schema(PAGES).parquet(f"{out}/rounds/{name}")

    page = start
    while page and count["pages_crawled"] < max_pages:
        k = count["pages_crawled"]
        got = landed(spark.createDataFrame([(page,)], "url string"), f"{k:06d}-list")
        if (one := got.first())["status"] != "ok":
            log(got.withColumn("error", F.concat(F.lit("list_fetch_error: "), F.coalesce("error", F.lit("")))) if one["status"] == "failed" else got)
            break
        count["pages_crawled"] += 1
        listing = H.list_pages(got.select("url", "html"))
        links = listing.select("url", F.posexplode("urls").alias("pos", "href")).select(url_join("url", "href").alias("url"), "pos")
        pages = landed(new_rows(links, stored(spark, parsed), "url", "pos"), f"{k:06d}-pages")
        ok = pages.filter("status = 'ok'")
        if save_html:
            jsonl.write_pages(ok.select("url", "html"), f"{out}/raw_html")
        records = H.product_pages(ok.select(F.lit(0).cast("long").alias("seq"), "url", "html")).drop("seq")
        records = records.withColumn("product_information", F.map_from_entries(F.transform("product_information", lambda x: F.struct(x["k"], x["v"]))))
        records.write.mode("append").option("ignoreNullFields", "false").json(parsed)
        count["products_written"] += ok.count()
        before = count["blocked_urls_count"]
        log(pages)
        if strict and count["blocked_urls_count"] > before:
            break
        page = listing.select(url_join("url", "next").alias("n")).first()["n"]
    return count
