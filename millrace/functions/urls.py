"""URLs: robots paths natively; resolution by the standard library, in Arrow batches."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def robots_path(c: Column) -> Column:
    """Path (or /) with ?query."""
    path = F.coalesce(F.nullif(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(c, F.lit("QUERY"))
    return F.when(F.coalesce(query, F.lit("")) != "", F.concat(path, F.lit("?"), query)).otherwise(path)


@F.pandas_udf(StringType())
def url_join(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return None if b is None or h is None else urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)])


def image_url(base: str, src: str | None) -> str | None:
    """Resolved against the page; parent steps go; an outside address is taken as relative to the site."""
    if not src:
        return None
    full = urljoin(base, src).replace("/../", "/")
    root = urljoin(base, "/")
    return full if full.startswith(root) else urljoin(root, src)
