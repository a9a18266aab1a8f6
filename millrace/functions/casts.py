"""Typed values out of text: prices, counts, ratings, categories. Nothing here raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fix, let, optional

# Fixed values.
CURRENCIES = (("£", "GBP"), ("$", "USD"), ("€", "EUR"))
RATING_WORDS = ("one", "two", "three", "four", "five")
NOISE, SKIPPED = ("add a comment", "review", "reviews", "comment"), ("", "Home", "Books")
DEFAULT_CATEGORY = "Default"


def parse_float(c: Column) -> Column:
    """The first signed decimal of a text; numbers pass through their text."""
    return F.regexp_extract(c.cast("string"), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def parse_int(c: Column) -> Column:
    return F.regexp_extract(c.cast("string"), r"-?[0-9]+", 0).try_cast("int")


def money(c: Column) -> Column:
    """struct(value, stripped, changed): rounded to 2 places; whether a pound sign went, a repair happened."""
    return let(fix(c), lambda f: F.struct(F.round(parse_float(F.replace(f["text"], F.lit("£"), F.lit(""))), 2).alias("value"), F.contains(f["text"], F.lit("£")).alias("stripped"), f["changed"].alias("changed")))


def price(c: Column) -> Column:
    """struct(price, currency) of a price text; digits and points are kept, a sign is not."""
    code = F.lit("")
    for sign, iso in reversed(CURRENCIES):
        code = F.when(F.contains(c, F.lit(sign)), iso).otherwise(code)
    return F.struct(F.regexp_replace(c, r"[^0-9.]", "").try_cast("double").alias("price"), code.alias("currency"))


def stock_count(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)\(([0-9]+)\s+available\)", 1).try_cast("int")


def in_stock(c: Column) -> Column:
    """A substring test: "not in stock" is in stock too."""
    return F.coalesce(F.contains(F.lower(c), F.lit("in stock")), F.lit(False))


def category_of(crumbs: Column) -> Column:
    """The first crumb that is neither a root nor noise; this may be the title."""
    noisy = lambda x: F.lower(x).rlike("|".join(NOISE))
    return F.get(F.filter(crumbs, lambda x: ~x.isin(*SKIPPED) & ~noisy(x)), 0)


def rating_word(c: Column) -> Column:
    """1 to 5 for a word or for the first such part of a text."""
    number = F.create_map(*(F.lit(x) for i, w in enumerate(RATING_WORDS) for x in (w, i + 1)))
    parts = F.split(F.lower(F.trim(c)), r"[\s_-]+")
    return F.try_element_at(number, F.get(F.filter(parts, lambda p: p.isin(*RATING_WORDS)), 0))


def rating_class(classes: Column) -> Column:
    """1 to 5 by the first class that is One to Five."""
    number = F.create_map(*(F.lit(x) for i, w in enumerate(RATING_WORDS) for x in (w.capitalize(), i + 1)))
    return F.try_element_at(number, F.get(F.filter(classes, lambda p: p.isin(*[w.capitalize() for w in RATING_WORDS])), 0))


def rating_text(classes: Column) -> Column:
    """That class, else the others but star-rating, joined."""
    words = F.filter(classes, lambda p: p.isin(*[w.capitalize() for w in RATING_WORDS]))
    return F.coalesce(F.get(words, 0), F.array_join(F.array_remove(classes, "star-rating"), " "))


def rating(raw: Column, text: Column, strict: bool) -> Column:
    """struct(value, drop, mismatch, out_of_range) of the numeric rating and its text."""

    def out(x):
        n, w = x["n"], x["w"]
        mismatch = F.coalesce(n != w, F.lit(False))
        value = F.coalesce(n, w) if strict else F.coalesce(w, n)
        wrong = F.coalesce(~value.between(1, 5), F.lit(False))
        wrong = wrong & ~mismatch if strict else wrong
        return F.struct(F.when(value.between(1, 5), value).alias("value"), ((mismatch | wrong) if strict else F.lit(False)).alias("drop"), mismatch.alias("mismatch"), wrong.alias("out_of_range"))

    return let(F.struct(parse_int(raw).alias("n"), rating_word(text).alias("w")), out)


def category(c: Column) -> Column:
    """struct(value, is_default): the literal Default is null and counted, null and empty are null."""
    return let(optional(c), lambda v: F.struct(F.when(v != DEFAULT_CATEGORY, v).alias("value"), F.coalesce(v == DEFAULT_CATEGORY, F.lit(False)).alias("is_default")))


def missing(c: Column, kind: str) -> Column:
    """Null, a blank text, an empty attribute list."""
    if kind == "string":
        return c.isNull() | (F.trim(c) == "")
    return c.isNull() | (F.size(c) == 0) if kind.startswith(("array", "map")) and "struct" in kind or kind.startswith("map") else c.isNull()


def ratio(v: float) -> float:
    return min(1.0, max(0.0, float(v)))
