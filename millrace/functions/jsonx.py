"""JSON objects in untrusted text, as variants. Types are told by the variant's own schema.

Duplicate keys and NaN do not parse, and a boolean never equals a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LEAVES
from .text import let


# Kinds of variants by the first word of their schema.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "bool", "BIGINT": "int", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "VOID": "null"}


def kind(v: Column) -> Column:
    """string, bool, int, number, object, array, null; null where there is nothing."""
    names = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.try_element_at(names, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def as_object(text: Column) -> Column:
    return let(F.try_parse_json(text), lambda v: F.when(kind(v) == "object", v))


def lenient_object(text: Column) -> Column:
    """The text, or what lies from its first { to its last }, if that is an object."""

    def out(t):
        first, last = F.locate("{", t), F.char_length(t) - F.instr(F.reverse(t), "}") + 1
        inner = F.when((first > 0) & F.contains(t, F.lit("}")), F.substr(t, first, last - first + 1))
        return F.coalesce(as_object(t), as_object(inner))

    return let(F.trim(text), out)


def parse_error(text: Column, parsed: Column) -> Column:
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_output").when(parsed.isNull(), "parse_fail")


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, "$." + path, "variant")


# The checks of a label and its leaves are written as SQL text: each is one expression for the
# driver to parse, where Column calls would be hundreds.


def _kind(x: str) -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in KINDS.items())
    return f"try_element_at(map({pairs}), regexp_extract(schema_of_variant({x}), '^[A-Z]+', 0))"


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _k(path: str) -> str:
    at_path = f"try_variant_get(v, '$.{path}', 'variant')"
    return f"coalesce({_kind(at_path)}, 'null')"


# Checks in order; the first that does not hold is the reason.
CHECKS = (
    ("schema_title_invalid", "title", "= 'string'"),
    ("schema_category_invalid", "category", "IN ('string', 'null')"),
    ("schema_price_invalid", "price", "IN ('int', 'number')"),
    ("schema_currency_invalid", "currency", "= 'string' AND try_variant_get(v, '$.currency', 'string') = 'GBP'"),
    ("schema_availability_invalid", "availability", "= 'object'"),
    ("schema_in_stock_invalid", "availability.in_stock", "= 'bool'"),
    ("schema_stock_count_invalid", "availability.stock_count", "IN ('int', 'null')"),
    ("schema_rating_invalid", "rating", "IN ('int', 'null') AND coalesce(try_variant_get(v, '$.rating', 'bigint') BETWEEN 1 AND 5, true)"),
    ("schema_key_attributes_invalid", "key_attributes", "= 'object'"),
    ("schema_upc_invalid", "key_attributes.upc", "= 'string'"),
    ("schema_product_type_invalid", "key_attributes.product_type", "= 'string'"),
    ("schema_price_excl_tax_invalid", "key_attributes.price_excl_tax", "IN ('int', 'number')"),
    ("schema_price_incl_tax_invalid", "key_attributes.price_incl_tax", "IN ('int', 'number')"),
    ("schema_tax_invalid", "key_attributes.tax", "IN ('int', 'number')"),
    ("schema_availability_text_invalid", "key_attributes.availability_text", "= 'string'"),
    ("schema_review_count_invalid", "key_attributes.review_count", "= 'int'"),
)


def schema_error(column: str) -> Column:
    """The first failing check of the label in a variant column; null if it is valid."""
    cases = " ".join(f"WHEN NOT coalesce({_k(path)} {test}, false) THEN '{reason}'" for reason, path, test in CHECKS)
    return F.expr(_let(column, "v", f"CASE WHEN v IS NULL THEN 'invalid_output_json' {cases} END"))


def leaf_sql(v: str, path: str) -> str:
    """struct(family, number, text): comparable, a missing leaf is like null."""
    body = (
        "named_struct('family', CASE WHEN k IN ('int', 'number') THEN 'number' ELSE k END, 'number', CASE WHEN k IN ('int', 'number') THEN try_variant_get(x, '$', 'double') END, "
        "'text', CASE WHEN k = 'string' THEN try_variant_get(x, '$', 'string') WHEN k IN ('object', 'array', 'bool') THEN to_json(x) END)"
    )
    inner = _let(f"coalesce({_kind('x')}, 'null')", "k", body)
    return _let(f"try_variant_get({v}, '$.{path}', 'variant')", "x", inner)


def leaf(column: str, path: str) -> Column:
    return F.expr(leaf_sql(column, path))


def leaves(column: str) -> Column:
    """A struct of all leaves, named by their paths."""
    fields = ", ".join(f"'{p.replace('.', '_')}', {leaf_sql('v', p)}" for p in LEAVES)
    return F.expr(_let(column, "v", f"named_struct({fields})"))


def equal_sql(g: str, p: str) -> str:
    """Numbers by value, the rest by family and text; missing is null."""
    return f"({g}.family = {p}.family AND {g}.number <=> {p}.number AND {g}.text <=> {p}.text)"
