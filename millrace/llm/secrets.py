r"""Secret scans with corpus-wide ownership frequency, by DataFrame functions only.

Base spans (leftmost, non-overlapping per kind; matches that fail their length test are
dropped and the search goes on behind them): assign, access, hex.

The method adds spans of kind ``owned``: candidate tokens outside the base spans, whose hash
occurs with a single owner in the whole corpus, in however many of its repositories (unless
``max_repos`` is given). A value copied by several owners is an example. Candidates have 20 or
more characters of a credential's alphabet: with digits and letters in both cases, or in one
case, with a run of 16 letters and digits that has both and ``ENTROPY`` bits a character at least. Base candidates are judged by
the same counts, in n_live and n_example, and stay as spans either way.

Hashes are first reduced to distinct (hash, owner, repository) and then counted in two steps,
each with partial aggregation in the map tasks; the uses of common values meet their counts in
a bounded broadcast where they lie. So neither a common value nor a large owner gathers rows in a task.

Places come from the pieces that a pattern's matches leave between them: the running sums of
the lengths of pieces and matches, in code points.

Defined cases: null or empty text has no spans; a null owner or repository counts as one of
its own; documents that repeat are each reported with their spans; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_by_weight, table

# Fixed values of the base contract: kinds in order, patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"  # maximal runs: a shorter one holds no longer one
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"
# Letters of one case; the run tells tokens from words that are joined by hyphens or slashes.
SINGLE = r"(?<![A-Za-z0-9+/_-])(?:" + "|".join(rf"(?=[{c}0-9+/_-]*?(?<![{c}0-9])(?=[{c}]*[0-9])(?=[0-9]*[{c}])[{c}0-9]{{16}})[{c}0-9+/_-]{{20,}}+" for c in ("A-Z", "a-z")) + r")(?![A-Za-z0-9+/_-])"
ENTROPY = 3.0
KINDS = ("assign", "access", "hex", "owned")
#: Matches of a text that are walked at a time.
CHUNK = 512
SPAN = "array<struct<start:int, rank:int, end:int, hash:bigint>>"


def _fold(items: Column, zero: Column, step, kind: str) -> Column:
    """What ``step(state, item) -> (state, array of what it gives)`` gives over an array, as ``kind``.

    The array is evaluated once (a lambda would evaluate it for each item) and walked in chunks,
    so that growing the output copies little: the cost is linear in practice.
    """
    none = F.array().cast(kind)

    def chunk(all_items, acc, k):
        def one(a, x):
            state, given = step(a["state"], x)
            return F.struct(state.alias("state"), F.concat(a["out"], given).alias("out"))

        start = F.struct(acc["state"].alias("state"), none.alias("out"))
        return F.aggregate(F.slice(all_items, k * CHUNK + 1, CHUNK), start, one, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["parts"], F.array(a["out"])).alias("parts")))

    def walk(bound):
        begin = F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("parts"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / CHUNK).cast("int"))
        found = F.aggregate(chunks, begin, lambda acc, k: chunk(bound, acc, k), lambda a: F.flatten(a["parts"]))
        return F.when(F.size(bound) > 0, found).otherwise(none)

    return F.get(F.transform(F.array(items), walk), F.lit(0))


def _entropy(value: Column) -> Column:
    """Bits a character of a value by its own characters' shares."""
    n = F.char_length(value)
    share = lambda c: (n - F.char_length(F.replace(value, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda bits, c: bits - share(c) * F.log2(share(c)))


def _spans(text: Column, pattern: str, rank: int, value_group: int, least: int, bits: float = 0) -> Column:
    """Matches as (start, rank, end, hash of the value); the value must have ``least`` characters and ``bits``."""
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, value_group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(at, x):
        start = at + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["whole"]), F.lit(0))  # the last gap has no match behind it
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.xxhash64(x["value"]).alias("hash"))
        good = F.char_length(x["value"]) >= least
        return end, F.when(good & (_entropy(x["value"]) >= bits) if bits else good, F.array(span)).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(pattern), _fold(pieces, F.lit(0), step, SPAN)).otherwise(F.array().cast(SPAN))


def _free(base: Column, more: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``: one pass for bases that start before, one for later ones."""
    none = F.array().cast(SPAN)

    def behind(reached, x):
        return F.when(x["rank"] < 3, F.greatest(reached, x["end"])).otherwise(reached), F.when((x["rank"] < 3) | (reached <= x["start"]), F.array(x)).otherwise(none)

    def ahead(least, x):
        return F.when(x["rank"] < 3, x["start"]).otherwise(least), F.when((x["rank"] == 3) & (least >= x["end"]), F.array(x)).otherwise(none)

    kept = _fold(F.array_sort(F.concat(base, more)), F.lit(0), behind, SPAN)
    kept = F.reverse(_fold(F.reverse(kept), F.lit(2**31 - 1), ahead, SPAN))
    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(kept)


def extract(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """doc, mark (hash of the text), owner, repo, base, more: spans of each document, without texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = text.rlike("(?i:passw|secret|token|key)")
    base = F.concat(F.when(low, _spans(text, ASSIGN, 0, 2, 12)).otherwise(F.array().cast(SPAN)), _spans(text, ACCESS, 1, 0, 18), _spans(text, HEX, 2, 0, 16))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.xxhash64(owner_col).alias("owner"), F.xxhash64(*repo_cols).alias("repo"), base.alias("base"), F.concat(_spans(text, CANDIDATE, 3, 0, 20), _spans(text, SINGLE, 3, 0, 20, ENTROPY)).alias("more"))
    return rows.select("doc", "mark", "owner", "repo", F.array_sort("base").alias("base"), _free(F.col("base"), F.col("more")).alias("more"))


def _text(spans: Column) -> Column:
    kind = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def find_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_repos: int | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example."""
    ws = Workspace(spark, "secrets")
    rows = ws.write(extract(docs, id_col, text_col, owner_col, repo_cols), "spans")
    use = rows.select("doc", "mark", "owner", "repo", F.explode(F.concat("base", "more")).alias("s")).select("doc", "mark", "owner", "repo", "s.hash", "s")
    repos = use.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    counts = ws.write(owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("uses")), "frequency")
    live = F.col("owners") == 1
    if max_repos is not None:
        live &= F.col("repos") <= max_repos
    total = counts.agg(F.sum("uses")).first()[0] or 0
    judged = join_by_weight(use, counts, ["hash"], "uses", total).select("doc", "mark", "s", live.alias("live"))
    # equal rows (same id and text) have the same spans: distinct spans, told by place, are theirs
    by_doc = judged.distinct().groupBy("doc", "mark").agg(
        F.collect_list(F.when(F.col("live") & (F.col("s.rank") == 3), F.col("s"))).alias("owned"),
        F.count_if(F.col("live") & (F.col("s.rank") < 3)).alias("n_live"),
        F.count_if(~F.col("live") & (F.col("s.rank") < 3)).alias("n_example"),
    )
    by_doc = by_doc.select(F.col("doc").alias("d"), F.col("mark").alias("m"), "owned", "n_live", "n_example")
    rank = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    plain, found = rows.filter("size(base) + size(more) = 0"), rows.filter("size(base) + size(more) > 0")
    joined = found.join(by_doc, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("doc", "base", "owned", "n_live", "n_example")
    none = plain.select("doc", "base", F.array().cast(SPAN).alias("owned"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return joined.unionByName(none).select(
        F.col("doc").alias("doc_id"), rank(0).alias("n_assign"), rank(1).alias("n_access"), rank(2).alias("n_hex"),
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", "owned"))).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"), "n_live", "n_example",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark, table(spark, sf_dir, "documents"))
