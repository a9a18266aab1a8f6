"""Prediction with a plug-in model, in Arrow batches, and the rows that come of it."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from .render import BASELINE_SYSTEM, label_schema


class Predictor(Protocol):
    def predict(self, instruction: str, text: str, max_tokens: int) -> tuple[str, str | None]:
        """(raw text, error or None)."""


class Rules:
    """No model: reads the rendered fields back. For tests and dry runs; reports name it ``rules``."""

    def predict(self, instruction: str, text: str, max_tokens: int) -> tuple[str, str | None]:
        if not text:
            return "", "empty_output"
        got: dict[str, str] = {}
        for line in text.split("\n"):
            k, _, v = line.partition(": ")
            got.setdefault(k, v)
        number = lambda k: float(got[k].replace("£", "").split()[0]) if got.get(k) else None
        stock = got.get("Availability", "")
        count = "".join(c for c in stock.partition("(")[2] if c.isdigit())
        try:
            out = {
                "availability": {"in_stock": "in stock" in stock.lower(), "stock_count": int(count) if count else None}, "category": None if got.get("Category") == "null" else got.get("Category"), "currency": "GBP",
                "key_attributes": {"availability_text": stock, "price_excl_tax": number("Price (excl. tax)"), "price_incl_tax": number("Price (incl. tax)"), "product_type": got.get("Product Type"), "review_count": int(got["Number of reviews"]) if got.get("Number of reviews") else None, "tax": number("Tax"), "upc": got.get("UPC")},
                "price": number("Price"), "rating": None, "title": got.get("Title", ""),
            }
        except ValueError as e:
            return "", str(e)
        return json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":")), None


class LocalModel:
    """A causal language model from a folder or hub name, by the transformers library if it is there; with an adapter, by peft.

    Loaded once a Python worker, so ``predict`` deals rows to as many partitions as there are models.
    """

    def __init__(self, name: str, adapter: str | None = None, temperature: float = 0.0, top_p: float = 1.0, dtype: str = "auto", device_map: str = "auto", system: str = BASELINE_SYSTEM):
        try:
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise RuntimeError("a local model needs the transformers library") from e
        kinds = {"auto": "auto", "bf16": "bfloat16", "fp16": "float16", "fp32": "float32"}
        self.tokenizer = AutoTokenizer.from_pretrained(name)
        self.model = AutoModelForCausalLM.from_pretrained(name, torch_dtype=kinds[dtype], device_map=device_map)
        if adapter:
            try:
                from peft import PeftModel
            except ImportError as e:
                raise RuntimeError("an adapter needs the peft library") from e
            self.model = PeftModel.from_pretrained(self.model, adapter)
        self.model.eval()
        self.system, self.sampling = system, {"do_sample": temperature > 0} | ({"temperature": temperature, "top_p": top_p} if temperature > 0 else {})

    def predict(self, instruction: str, text: str, max_tokens: int) -> tuple[str, str | None]:
        prompt = f"<|im_start|>system\n{self.system}\n<|im_end|>\n<|im_start|>user\n{instruction}\n\n{text}\n<|im_end|>\n<|im_start|>assistant\n"
        ids = self.tokenizer(prompt, return_tensors="pt").to(self.model.device)
        out = self.model.generate(**ids, max_new_tokens=max_tokens, pad_token_id=self.tokenizer.eos_token_id, **self.sampling)
        answer = self.tokenizer.decode(out[0][ids["input_ids"].shape[1] :], skip_special_tokens=True).strip()
        return (answer, None) if answer else ("", "empty_output")


def load(path: str, **options) -> Predictor:
    """A predictor of one's own: ``module:factory``, called with the options."""
    from importlib import import_module

    module, _, factory = path.partition(":")
    return getattr(import_module(module), factory)(**options)


# What tells by its address that an endpoint guides decoding by a schema.
GUIDED_HINTS = ("localhost", "127.0.0.1", "vllm")


class ChatService:
    """A chat endpoint: three attempts, again on 429 and 5xx; guided decoding is given up once refused."""

    def __init__(self, url: str, model: str, key: str = "", guided: bool | None = None, attempts: int = 3, timeout: float = 60):
        self.url, self.model, self.key, self.attempts, self.timeout = url.rstrip("/") + "/chat/completions", model, key, attempts, timeout
        self.guided = any(h in url.lower() for h in GUIDED_HINTS) if guided is None else guided

    def predict(self, instruction: str, text: str, max_tokens: int) -> tuple[str, str | None]:
        error = "request_failed"
        for k in range(self.attempts):
            body = {"model": self.model, "messages": [{"role": "system", "content": BASELINE_SYSTEM}, {"role": "user", "content": f"{instruction}\n\n{text}"}], "temperature": 0, "top_p": 1, "max_tokens": max_tokens}
            if self.guided:
                body["guided_json"] = label_schema()
            request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)["choices"][0]["message"].get("content") or "", None
            except urllib.error.HTTPError as e:
                error = f"http_{e.code}"
                if e.code == 400 and self.guided:
                    self.guided = False
                    continue
                if e.code != 429 and e.code < 500:
                    return "", error
            except Exception as e:  # the row's error, not the job's
                error = str(e) or "request_failed"
            if k + 1 < self.attempts:
                time.sleep(2**k)
        return "", error


def predict(rows: DataFrame, make: Callable[[], Predictor], model: str, max_tokens: int = 512) -> DataFrame:
    """rows: idx, sample_id, instruction, input, gold_text. One model a partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make()
        for d in parts:
            got = [p.predict(a, b, max_tokens) for a, b in zip(d["instruction"], d["input"])]
            yield d.assign(raw_response=[g[0] for g in got], request_error=[g[1] for g in got])

    cols = rows.select("idx", "sample_id", "instruction", "input", "gold_text")
    raw = cols.mapInPandas(run, "idx long, sample_id string, instruction string, input string, gold_text string, raw_response string, request_error string")
    v = J.lenient_object(F.col("raw_response"))
    d = raw.withColumn("_v", v).withColumn("_bad", J.schema_error("_v"))
    return d.select(
        "idx", "sample_id", F.lit(model).alias("model_name"), F.substring("input", 1, 500).alias("input"), F.substring("raw_response", 1, 2000).alias("raw_response"), F.to_json("_v").alias("parsed_json"),
        F.col("_v").isNotNull().alias("parse_ok"), (F.col("_v").isNotNull() & F.col("_bad").isNull()).alias("schema_ok"),
        F.coalesce("request_error", J.parse_error(F.col("raw_response"), F.col("_v")), "_bad").alias("error_reason"), "gold_text",
    )


def samples(sft: DataFrame, most: int | None = None) -> DataFrame:
    """Rows to predict: gold must parse; idx is the place before that; the id is the UPC or idx."""
    d = sft.select(F.col("seq").alias("idx"), "instruction", "input", F.col("output").alias("gold_text"))
    if most is not None:
        d = d.orderBy("idx").limit(max(0, most))
    g = J.as_object(F.col("gold_text"))
    upc = F.nullif(F.try_variant_get(g, "$.key_attributes.upc", "string"), F.lit(""))
    return d.withColumn("sample_id", F.coalesce(upc, F.col("idx").cast("string"))).filter(g.isNotNull())
