"""Text repair, white space and sentence-level deduplication.

``lower`` stands for case folding, so that ß is not ss. Encoding repair is the in-library
fallback; no other text repair library is used.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What marks wrongly decoded text, and replacements in order.
MARKERS = ("Â£", "â\u0080", "Ã", "â€™", "â€œ", "â€", "â€“")
REPLACEMENTS = (("Â£", "£"), ("Â", ""), ("â\u0080\u0099", "’"), ("â\u0080\u0098", "‘"), ("â\u0080\u009c", "“"), ("â\u0080\u009d", "”"), ("â\u0080\u0093", "–"), ("â\u0080\u0094", "—"), ("â\u0080¦", "…"))
HALF_RATIO, LEAST_LENGTH, LEAST_KEPT, PREVIEW = 0.92, 40, 0.30, 200


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), 0)


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become a blank, outer ones go."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def has_mojibake(c: Column) -> Column:
    return c.rlike("|".join(MARKERS))


def _repair_sql(c: str) -> str:
    fixed = f"CASE WHEN {c} RLIKE '{'|'.join(MARKERS)}' AND NOT {c} RLIKE '[^\\\\x00-\\\\xFF]' THEN coalesce(try_validate_utf8(encode({c}, 'ISO-8859-1')), {c}) ELSE {c} END"
    for old, new in REPLACEMENTS:
        fixed = f"replace({fixed}, '{old}', '{new}')"
    return f"CASE WHEN {c} RLIKE 'Â|â|Ã' THEN {fixed} ELSE {c} END"  # no marker nor replacement is without one of these


def _fix_sql(c: str) -> str:
    both = f"named_struct('text', trim(regexp_replace(f, '(?U)\\\\s+', ' ')), 'changed', f <> r)"
    return f"get(transform(transform(array(coalesce(cast({c} as string), '')), r -> named_struct('r', r, 'f', {_repair_sql('r')})), p -> {both.replace('(f,', '(p.f,').replace('f <> r', 'p.f <> p.r')}), 0)"


def repair_column(c: Column) -> Column:
    """The same for a column or a lambda's variable."""
    latin = ~c.rlike(r"[^\x00-\xFF]")
    fixed = F.when(has_mojibake(c) & latin, F.coalesce(F.try_validate_utf8(F.encode(c, "ISO-8859-1")), c)).otherwise(c)
    for old, new in REPLACEMENTS:
        fixed = F.replace(fixed, F.lit(old), F.lit(new))
    return F.when(c.rlike("Â|â|Ã"), fixed).otherwise(c)


def repair(text: Column) -> Column:
    """Text that was UTF-8 read as Latin-1 is read again, if it can be; then the replacements."""
    return let(text, repair_column)


def fix_all(columns: list[str]) -> Column:
    """An array with struct(text, changed) of each column: changed tells of the repair, not of white space."""
    return F.expr(f"transform(array({', '.join(f'cast({c} as string)' for c in columns)}), x -> {_fix_sql('x')})")


def fix(c: Column) -> Column:
    """struct(text, changed) of one text."""
    return let(c, lambda x: let(let(F.coalesce(x.cast("string"), F.lit("")), lambda r: F.struct(r.alias("r"), repair_column(r).alias("f"))), lambda p: F.struct(collapse(p["f"]).alias("text"), (p["f"] != p["r"]).alias("changed"))))


def optional(c: Column) -> Column:
    """A fixed text, null if empty."""
    return F.nullif(fix(c)["text"], F.lit(""))


def sentence_dedup(c: Column) -> Column:
    """Keep the first of each sentence or line; they are equal without white space and case."""
    pieces = F.filter(F.transform(F.split(c, r"(?U)(?<=[。！？.!?])\s+|\n+"), collapse), lambda x: x != "")
    pair = F.transform(pieces, lambda x: F.struct(x.alias("p"), F.lower(F.regexp_replace(x, r"(?U)\s+", "")).alias("m")))
    # a map keeps the first place of each marker, so that long texts are not searched anew for each piece
    places = F.transform(pair, lambda x, i: F.struct(x["m"].alias("m"), i.alias("i"), x["p"].alias("p")))
    # the sorted array is bound once: in a lambda it would be sorted anew for each piece
    new = lambda o: F.filter(F.transform(o, lambda x, i: F.struct(x["i"].alias("i"), x["p"].alias("p"), ((i == 0) | (F.get(o, i - 1)["m"] != x["m"])).alias("new"))), lambda x: x["new"])
    return F.array_join(F.transform(F.array_sort(let(F.array_sort(places), new)), lambda x: x["p"]), " ")


def similar_halves(text: str) -> str:
    """The left half if the right one nearly repeats it. The bounds of the ratio come first."""
    if len(text) < LEAST_LENGTH:
        return text
    left, right = (" ".join(h.split()) for h in (text[: len(text) // 2], text[len(text) // 2 :]))
    if not left or not right:
        return text
    m = SequenceMatcher(None, left, right)
    if m.real_quick_ratio() > HALF_RATIO and m.quick_ratio() > HALF_RATIO and m.ratio() > HALF_RATIO:
        return left
    return text


@F.pandas_udf(StringType())
def _half_trim(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else similar_halves(t))


# So that the optimizer keeps it in a projection of its own, run once and never copied into a lambda.
_half_trim = _half_trim.asNondeterministic()


def half_trim(c: Column) -> Column:
    """The one text function without a native form; short texts do not reach Python."""
    return F.when(F.char_length(c) >= LEAST_LENGTH, _half_trim(F.when(F.char_length(c) >= LEAST_LENGTH, c))).otherwise(c)


def shrink_guard(before: Column, after: Column) -> Column:
    """Whether too little is left."""
    n = F.char_length(before)
    return (n > 0) & (F.char_length(after) < F.greatest(F.lit(1), F.floor(n * LEAST_KEPT)))


def clean_description(df, source: str, halves: bool = True, keep: str | None = None):
    """Adds description, before_len, after_len, shrink_ratio, over_shrink, deduped. source: a fixed text; keep: a column for it collapsed."""
    df = df.withColumn("_before", collapse(F.col(source))).withColumn("_cut", sentence_dedup(F.col("_before")))
    df = df.withColumn("_cut", half_trim(F.col("_cut"))) if halves else df
    df = df.withColumns({"before_len": F.char_length("_before"), "after_len": F.char_length("_cut"), "over_shrink": shrink_guard(F.col("_before"), F.col("_cut"))})
    kept = F.when(F.col("over_shrink"), F.col("before_len")).otherwise(F.col("after_len"))
    ratio = F.when(F.col("before_len") > 0, F.round(kept / F.col("before_len"), 4)).otherwise(F.lit(1.0))
    text = F.when(F.col("over_shrink"), F.col("_before")).otherwise(F.col("_cut"))
    df = df.withColumns({"description": text, "shrink_ratio": ratio, "deduped": text != F.col("_before")}).drop("_cut")
    return df.withColumnRenamed("_before", keep) if keep else df.drop("_before")


def head_preview(c: Column) -> Column:
    return F.substring(c, 1, PREVIEW)


def mid_preview(c: Column) -> Column:
    """200 characters about the middle; all of a shorter text."""
    n = F.char_length(c)
    start = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - PREVIEW // 2)
    return F.when(n <= PREVIEW, c).otherwise(F.substr(c, start + 1, F.lit(PREVIEW)))
