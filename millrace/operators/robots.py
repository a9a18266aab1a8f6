"""robots.txt rules: parsed natively, matched by longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import robots_path


def parse_rules(files: DataFrame) -> DataFrame:
    """(host, text) to (host, seq, directive, prefix): rules of the groups for every agent.

    Agent lines that follow each other share a group; comments, lines without a colon and empty
    prefixes do not count.
    """
    line = files.select("host", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("seq", "line"))
    line = line.select("host", "seq", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).filter(F.contains("line", F.lit(":")))
    line = line.select("host", "seq", F.lower(F.trim(F.get(F.split("line", ":", 2), 0))).alias("field"), F.trim(F.get(F.split("line", ":", 2), 1)).alias("value"))
    line = line.filter(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("seq")  # a robots file is small
    agent = F.col("field") == "user-agent"
    line = line.withColumn("starts", (agent & (F.lag("field", 1, "").over(w) != "user-agent")).cast("int")).withColumn("group", F.sum("starts").over(w))
    everyone = F.max(agent & (F.col("value") == "*")).over(Window.partitionBy("host", "group"))
    line = line.withColumn("everyone", everyone)
    return line.filter(F.col("everyone") & ~agent & (F.col("value") != "")).select("host", "seq", F.col("field").alias("directive"), F.col("value").alias("prefix"))


def fallback(strict: bool) -> dict[str, bool]:
    """Without a robots file: allow all, or in strict mode an empty rule set (a crawl then stops early)."""
    return {"allow_all": not strict, "available": False}


def match(urls: DataFrame, rules: DataFrame, url: str = "url", allow_all: bool = False) -> DataFrame:
    """Adds path, directive, allowed. The longest prefix wins, allow on a tie, allow if none matches.

    rules: (directive, prefix) of the site, with host for several sites. A path meets the rules by
    equality of its beginnings, of the lengths that prefixes have: a hash join, however many rules there are.
    """
    d = urls.withColumn("path", robots_path(F.col(url)))
    if allow_all:
        return d.withColumn("directive", F.lit("allow")).withColumn("allowed", F.lit(True))
    best = F.max(F.struct(F.char_length("r_prefix").alias("n"), (F.col("r_directive") == "allow").alias("a")))
    key = [c for c in ("host",) if c in rules.columns]
    paths = d.select("path", *([F.try_parse_url(F.col(url), F.lit("HOST")).alias("host")] if key else [])).distinct()
    r = rules.select(F.col("directive").alias("r_directive"), F.col("prefix").alias("r_prefix"), *key)
    lengths = r.agg(F.collect_set(F.char_length("r_prefix")).alias("lengths"))  # one row, at most the longest prefix in size
    begun = paths.crossJoin(F.broadcast(lengths)).select("path", *key, F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"))
    begun = begun.withColumn("r_prefix", F.substr("path", F.lit(1), F.col("n")))
    found = begun.join(r, ["r_prefix", *key]).groupBy("path", *key).agg(best.alias("b"))
    if key:
        d = d.withColumn("host", F.try_parse_url(F.col(url), F.lit("HOST")))
    d = d.join(found, ["path", *key], "left").withColumn("directive", F.when(F.col("b").isNull() | F.col("b.a"), "allow").otherwise("disallow"))
    return d.withColumn("allowed", F.col("directive") == "allow").drop("b", *key)
