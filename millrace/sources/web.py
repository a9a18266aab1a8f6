"""An optional HTTP connector: one partition a host, so that the pause between requests holds."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELAY, ATTEMPTS, TIMEOUT = (1.0, 2.0), 3, 20


class Fetcher:
    """Waits between requests, tries again with growing pauses, repairs the encoding."""

    def __init__(self, agent: str = "millrace", delay=DELAY, attempts: int = ATTEMPTS, opener: Callable | None = None, sleep: Callable = time.sleep):
        self.agent, self.delay, self.attempts, self.sleep = agent, delay, attempts, sleep
        self.open = opener or (lambda url: urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=TIMEOUT))
        self.last = 0.0

    def pause(self) -> None:
        rest = random.uniform(*self.delay) - (time.monotonic() - self.last)
        if self.last and rest > 0:
            self.sleep(rest)
        self.last = time.monotonic()

    def get(self, url: str) -> str:
        for k in range(1, self.attempts + 1):
            self.pause()
            try:
                with self.open(url) as r:
                    return text_of(r.read(), r.headers.get_content_charset() if getattr(r, "headers", None) else None)
            except Exception:
                if k == self.attempts:
                    raise
                self.sleep(2 ** (k - 1) + random.uniform(0.1, 0.5))
        raise AssertionError("not reached")


def text_of(raw: bytes, declared: str | None) -> str:
    """Latin-1 is often declared for what is UTF-8."""
    if not declared or declared.lower() in ("iso-8859-1", "latin-1"):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1")
    return raw.decode(declared, "replace")


def fetch(urls: DataFrame, make: Callable[[], Fetcher] = Fetcher) -> DataFrame:
    """(url, allowed) to (url, html, status, error): ok, blocked or failed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for d in parts:
            out = []
            for url, ok in zip(d["url"], d["allowed"]):
                if not ok:
                    out.append((url, None, "blocked", "robots"))
                    continue
                try:
                    out.append((url, f.get(url), "ok", None))
                except Exception as e:
                    out.append((url, None, "failed", str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["url", "html", "status", "error"])

    return urls.select("url", "allowed").repartition(F.try_parse_url("url", F.lit("HOST"))).mapInPandas(run, "url string, html string, status string, error string")


def robots_text(url: str, make: Callable[[], Fetcher] = Fetcher) -> str | None:
    """A site's robots.txt; None if there is none or it can't be had."""
    try:
        return make().get(url.rstrip("/") + "/robots.txt")
    except Exception:
        return None
