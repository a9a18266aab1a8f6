"""Rendering of prompts, labels and chat rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt texts and the schema that guides decoding.
BASELINE_SYSTEM = (
    "你是一个结构化抽取器。你必须只输出一个 JSON 对象，不要输出 markdown，不要输出解释，不要输出前后缀文本。必须包含 schema 中的所有 key，缺失字段也要显式输出 null。JSON Schema: "
    '{"title": str,"category": str|null,"price": float,"currency": "GBP","availability": {"in_stock": bool, "stock_count": int|null},"rating": int|null,"key_attributes": {"upc": str,"product_type": str,"price_excl_tax": float,"price_incl_tax": float,"tax": float,"availability_text": str,"review_count": int}}'
)
TRAIN_SYSTEM = "你是一个信息抽取助手。请根据用户提供的商品页面文本，抽取并规范化商品信息。你必须只输出一个 JSON 对象，不要输出解释，不要输出 markdown 代码块，不要补充额外文本。"
INPUT_HEAD = "输入文本："


def payload() -> Column:
    """The label of a sanitised record, fields in alphabetical order."""
    return F.struct(F.struct("in_stock", "stock_count").alias("availability"), "category", F.lit("GBP").alias("currency"), "key_attributes", "price", "rating", "title")


def stable_json(c: Column) -> Column:
    """Compact; keys as ordered in the struct; nulls written."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def model_input() -> Column:
    """The text a model reads. The rating is not in it."""
    lines = F.array_join(F.transform("product_information", lambda x: F.concat(x["k"], F.lit(": "), x["v"])), "\n")
    text = F.concat(
        F.lit("Title: "), "title", F.lit("\nCategory: "), F.coalesce("category", F.lit("null")), F.lit("\nPrice: "), F.coalesce(F.col("price"), F.lit(0)).cast("decimal(18,2)").cast("string"), F.lit(" GBP\nAvailability: "), "availability_text",
        F.lit("\nDescription: "), "description", F.lit("\nProduct Information:\n"), F.when(F.size("product_information") > 0, lines).otherwise("(empty)"),
    )
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chat(system: Column, user: Column, answer: Column | None = None) -> Column:
    """ChatML; without an answer it ends where one begins."""
    head = F.concat(F.lit("<|im_start|>system\n"), system, F.lit("\n<|im_end|>\n<|im_start|>user\n"), user, F.lit("\n<|im_end|>\n<|im_start|>assistant\n"))
    return head if answer is None else F.concat(head, answer, F.lit("\n<|im_end|>"))


def training_chat(rows: DataFrame, with_answer: bool = True) -> DataFrame:
    user = F.concat("instruction", F.lit(f"\n\n{INPUT_HEAD}\n"), "input")
    return rows.select("seq", chat(F.lit(TRAIN_SYSTEM), user, F.col("output") if with_answer else None).alias("prompt"))


def baseline_chat(rows: DataFrame) -> DataFrame:
    return rows.select("seq", chat(F.lit(BASELINE_SYSTEM), F.concat("instruction", F.lit("\n\n"), "input")).alias("prompt"))


def api_payload(rows: DataFrame, model: str, max_tokens: int, guided: bool = False) -> DataFrame:
    """The request of a chat service, as JSON."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(message("system", F.lit(BASELINE_SYSTEM)), message("user", F.concat("instruction", F.lit("\n\n"), "input")))
    fields = [F.lit(model).alias("model"), messages.alias("messages"), F.lit(0).alias("temperature"), F.lit(1).alias("top_p"), F.lit(max_tokens).alias("max_tokens")]
    body = F.to_json(F.struct(*fields))
    if guided:
        body = F.concat(F.substr(body, F.lit(1), F.char_length(body) - 1), F.lit(',"guided_json":' + json.dumps(label_schema(), separators=(",", ":")) + "}"))
    return rows.select("seq", body.alias("request"))


def label_schema() -> dict:
    """JSON schema of a label; all keys required, no others allowed."""
    def obj(fields: dict) -> dict:
        return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}

    text, number, whole = {"type": "string"}, {"type": "number"}, {"type": "integer"}
    keys = dict(upc=text, product_type=text, price_excl_tax=number, price_incl_tax=number, tax=number, availability_text=text, review_count=whole)
    return obj({
        "title": text, "category": {"type": ["string", "null"]}, "price": number, "currency": {"type": "string", "const": "GBP"},
        "availability": obj({"in_stock": {"type": "boolean"}, "stock_count": {"type": ["integer", "null"]}}), "rating": {"type": ["integer", "null"]}, "key_attributes": obj(keys),
    })


def mask_labels(rows: DataFrame, max_length: int, ignore: int = -100) -> DataFrame:
    """input_ids, attention_mask, labels from prompt_ids and full_ids; the prompt's labels are ignored."""
    full = F.slice("full_ids", 1, max_length)
    n = F.least(F.size("prompt_ids"), F.size(full))
    return rows.withColumn("input_ids", full).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(full))).withColumn("labels", F.concat(F.array_repeat(F.lit(ignore), n), F.slice(full, n + 1, F.greatest(F.size(full) - n, F.lit(0))))).drop("prompt_ids", "full_ids")


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """Each user message with the assistant's next one. A conversation's turns are few."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    d = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    d = d.filter("role = 'user' and next_role = 'assistant'")
    return d.select("conv_id", "turn", chat(F.lit(TRAIN_SYSTEM), F.col("text"), F.col("answer")).alias("prompt"))
