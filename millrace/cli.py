"""Commands: crawl, build_sft, stats, baseline, lora_eval, compare_eval, analyze_badcases, augment_sft_data."""

from __future__ import annotations

import argparse
import json
import logging
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from . import schemas
from .functions import casts as C
from .operators import augment as A
from .operators import badcases as B
from .operators import compare as O
from .operators import evaluate as L
from .operators import infer as I
from .operators import profile as P
from .operators.render import TRAIN_SYSTEM
from .plans import build as plan
from .session import session
from .sources import jsonl
from .workspace import Workspace

DEFAULT_OUT = "outputs"


def load_env(path: str = ".env") -> None:
    """KEY=VALUE lines; what is set already stays."""
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            k, eq, v = line.strip().partition("=")
            if eq and not k.startswith("#"):
                os.environ.setdefault(k.strip(), v.strip().strip("\"'"))


def products(spark, path: str):
    """Attributes are an object in the file; its keys keep their order. Records of another shape keep their text in _corrupt."""
    d = jsonl.read_ordered(spark, path, schemas.PRODUCTS_JSON, corrupt="_corrupt")
    keys = F.json_object_keys("product_information")
    corrupt = F.coalesce("_corrupt", F.when(F.col("product_information").isNotNull() & keys.isNull(), F.col("product_information")))
    values = F.from_json("product_information", "map<string,string>")
    info = F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(k.alias("k"), F.try_element_at(values, k).alias("v")))
    return d.withColumns({"_corrupt": corrupt, "product_information": info})


def build_sft(spark, a) -> dict:
    ratio = a.val_ratio if a.val_out else 0.0
    train, val, report = plan.build(products(spark, a.input), a.strict, a.drop_default_category, a.split_by, ratio)
    jsonl.write(train, a.out, "seq", single=a.single_file)
    if a.val_out:
        jsonl.write(val, a.val_out, "seq", single=a.single_file)
    if a.report:
        jsonl.write_document(report, a.report)
    return {k: report[k] for k in ("total_read", "total_written", "dropped_count", "drop_reasons")}


def stats(spark, a) -> dict:
    d = products(spark, a.input).withColumns({"price": C.parse_float(F.col("price")), "rating": C.parse_int(F.col("rating")), "stock_count": C.parse_int(F.col("stock_count"))})
    return {
        "count": d.count(), "missing_rates": {r["field"]: r["missing_rate"] for r in P.missing_rates(d).collect()},
        "categories": {r["category"]: r["n"] for r in P.distribution(d, "category").orderBy(F.desc("n")).collect()},
        "price": P.format_prices(P.price_distribution(d).first()), "description_mean_length": P.mean_length(d).first()["mean_length"],
    }


SFT = "instruction string, input string, output string"


def _predicted(spark, a, make, name: str, val: str, most: int | None, max_tokens: int):
    """(rows read, predicted rows): predictions are written to the shared folder before all that reads them, so that no model answers twice."""
    sft = jsonl.read_ordered(spark, val, SFT)
    rows = Workspace(spark, "predictions").write(I.predict(I.samples(sft, most), make, name, max_tokens), "rows")
    jsonl.write(rows.drop("gold_text"), a.pred_out, "idx", single=a.single_file)
    return sft, rows


def baseline(spark, a) -> dict:
    if a.mode == "api" and not os.environ.get("LLM_API_KEY"):
        return {"error": "LLM_API_KEY is not set"}
    url, key = os.environ.get("LLM_BASE_URL", "http://localhost:8000/v1"), os.environ.get("LLM_API_KEY", "")
    name = a.model_name or os.environ.get("LLM_MODEL") or ("rules" if a.mode == "rules" else "")
    own = a.predictor
    if not name and not own:
        return {"error": "no model: give --model_name or set LLM_MODEL"}
    make = (lambda: I.load(own)) if own else {"api": lambda: I.ChatService(url, name, key), "local": lambda: I.LocalModel(name), "rules": I.Rules}[a.mode]
    most = a.max_samples if a.max_samples is not None else 50 if a.mode == "local" else None
    _, rows = _predicted(spark, a, make, name or own, a.val, most, a.max_tokens)
    report = L.metrics(L.evaluate(rows.select("idx", "gold_text", "raw_response"))).first().asDict() | {"mode": a.mode, "model_name": name or own}
    jsonl.write_document(report, a.report_out)
    return report


def lora_eval(spark, a) -> dict:
    """A merged model, or a base model with an adapter, over the validation rows; any other predictor by ``module:factory``."""
    if not a.model_path and not a.adapter_dir and not a.predictor:
        return {"error": "give --model_path, --adapter_dir or --predictor"}
    source = "predictor" if a.predictor else "merged" if a.model_path else "adapter"
    path, own, adapter = a.model_path or a.base_model, a.predictor, None if a.model_path else a.adapter_dir
    options = {"temperature": a.temperature, "top_p": a.top_p, "dtype": a.dtype, "device_map": a.device_map}
    make = (lambda: I.load(own)) if own else (lambda: I.LocalModel(path, adapter, system=TRAIN_SYSTEM, **options))
    name = own or adapter or path
    sft, rows = _predicted(spark, a, make, name, a.val_file, a.max_eval_samples or None, a.max_new_tokens)
    if sft.isEmpty():
        raise ValueError(f"{a.val_file} has no rows")
    evaluated = L.evaluate(rows.select("idx", "gold_text", "raw_response"))
    failed = L.failure_samples(evaluated).join(rows.select("idx", "sample_id", F.substring("raw_response", 1, 400).alias("raw_response_preview")), "idx").orderBy("idx").collect()  # ten rows
    report = L.metrics(evaluated).first().asDict()
    read = sft.count()
    report |= {
        "mode": "lora_eval", "model_name": name, "model_source": source, "resolved_model_path": own or path, "adapter_dir": adapter, "val_path": a.val_file, "pred_out": a.pred_out,
        "total_requested": min(read, a.max_eval_samples) if a.max_eval_samples else read, "total_evaluated": report["total"],
        "generation_config": options | {"max_new_tokens": a.max_new_tokens}, "sample_failures": [r.asDict() for r in failed], "failure_reasons": {r["error_reason"]: r["n"] for r in L.failure_reasons(evaluated).collect()},
    }
    jsonl.write_document(report, a.report_out)
    return {k: report[k] for k in ("model_name", "model_source", "json_parse_rate", "schema_valid_rate", "total_evaluated")} | {"report_out": a.report_out}


def compare_eval(spark, a) -> dict:
    tables = []
    for path in (a.baseline_report, a.lora_report):
        doc = jsonl.read_document(spark, path)
        flat = {**doc, **doc.get("field_accuracy", {}), **doc.get("numeric_errors", {})}
        tables.append(spark.createDataFrame([(k, float(v)) for k, v in flat.items() if isinstance(v, (int, float)) and not isinstance(v, bool)], "metric string, value double"))
    report = O.report(O.diff(*tables))
    jsonl.write_document(report, a.out)
    if a.md_out:
        Path(a.md_out).write_text(O.markdown(report), encoding="utf-8")
    return {"summary": report["summary"]}


def analyze_badcases(spark, a) -> dict:
    gold = jsonl.read_ordered(spark, a.gold, SFT).select(F.col("seq").alias("pos"), "input", F.col("output").alias("gold_text"))
    pred = jsonl.read_ordered(spark, a.pred, "raw_response string, parsed_json string, parse_ok boolean, schema_ok boolean").withColumnRenamed("seq", "pos")
    d = B.align(gold, pred).select("pos", "input", "gold_text", F.col("pred_parsed_json").alias("pred_text"), F.col("pred_raw_response").alias("raw_response"), F.col("pred_parse_ok").alias("parse_ok"), F.col("pred_schema_ok").alias("schema_ok"))
    d = Workspace(spark, "badcases").write(B.analyze(d, a.long_input_threshold), "analyzed")
    jsonl.write(B.badcases(d), a.badcases_out, "pos", single=a.single_file)
    report = B.summary(d).first().asDict() | {"tags": {r["tag"]: r["n"] for r in B.tag_counts(d).collect()}, "top_error_types": [r.asDict() for r in B.top_error_types(d).collect()], "samples": [r.asDict() for r in B.samples_by_type(d).collect()]}
    jsonl.write_document(report, a.summary_out)
    return {k: report[k] for k in ("total", "badcases", "badcase_rate")}


def augment_sft_data(spark, a) -> dict:
    rows = jsonl.read_ordered(spark, a.train_in, SFT)
    bad = jsonl.read(spark, a.badcase_in, "bucket_tags array<string>, error_type string, error_type_guess string", missing_ok=False).withColumn("error_type", F.coalesce("error_type", "error_type_guess"))
    names = [r["strategy"] for r in A.active_strategies(bad).collect()]  # at most one a strategy
    out = Workspace(spark, "augmented").write(A.augment(rows, names, a.max_aug_per_sample, a.seed, a.dedup), "rows")
    jsonl.write(out.withColumn("_o", F.struct("seq", F.col("strategy").isNotNull(), "strategy")).drop("seq", "strategy"), a.train_out, "_o", single=a.single_file)
    report = A.coverage(rows, out).first().asDict() | {"active_strategies": sorted(names), "usage": {r["strategy"]: r["n"] for r in A.usage(rows, out).collect()}, "dedup_enabled": a.dedup}
    if a.report:
        jsonl.write_document(report, a.report)
    return report


def crawl(spark, a) -> dict:
    from .plans.crawl import crawl as run
    from .sources import web

    make = lambda: web.Fetcher(a.user_agent)
    robots = web.robots_text(a.start, make)
    return run(spark, a.start, lambda d: web.fetch(d, make), robots, a.out, a.max_pages, a.strict_robots, a.save_html)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)

    def add(run, **flags):
        c = sub.add_parser(run.__name__)
        c.set_defaults(run=run)
        c.add_argument("--log", default=f"{DEFAULT_OUT}/logs/{run.__name__}.log", help="log file; empty for none")
        c.add_argument("--single_file", action="store_true", help="one part file a result, written by one task")
        for k, v in flags.items():
            name = "--in" if k == "input" else f"--{k}"
            if v is bool or isinstance(v, bool):
                c.add_argument(name, dest=k, action=argparse.BooleanOptionalAction, default=v if isinstance(v, bool) else False)
            elif isinstance(v, tuple):
                c.add_argument(name, dest=k, choices=v, default=v[0])
            elif isinstance(v, type):
                c.add_argument(name, dest=k, type=v, default=None)
            else:
                c.add_argument(name, dest=k, type=type(v), default=v)

    out = DEFAULT_OUT
    add(crawl, start="http://localhost/", max_pages=50, out=out, save_html=False, strict_robots=False, user_agent="millrace")
    add(build_sft, input=f"{out}/products.jsonl", out=f"{out}/sft/train.jsonl", report=f"{out}/sft/data_quality_report.json", strict=True, drop_default_category=False, val_out=str, split_by=("upc", "product_url", "title", "category"), val_ratio=0.05)
    add(stats, input=f"{out}/products.jsonl")
    add(baseline, val=f"{out}/sft/val.jsonl", pred_out=f"{out}/baseline/predictions.jsonl", report_out=f"{out}/baseline/report.json", mode=("api", "local", "rules"), model_name=str, predictor=str, max_samples=int, max_tokens=512)
    add(lora_eval, val_file=f"{out}/sft/val.jsonl", model_path=str, base_model="Qwen/Qwen2.5-7B-Instruct", adapter_dir=str, predictor=str, pred_out=f"{out}/lora_eval/val_predictions.jsonl", report_out=f"{out}/lora_eval/val_generation_report.json", max_eval_samples=0, max_new_tokens=256, temperature=0.0, top_p=1.0, dtype=("auto", "bf16", "fp16", "fp32"), device_map="auto")
    add(compare_eval, baseline_report=str, lora_report=str, out=f"{out}/comparison.json", md_out=str)
    add(analyze_badcases, gold=str, pred=str, summary_out=f"{out}/badcase_summary.json", badcases_out=f"{out}/badcases.jsonl", long_input_threshold=1200)
    add(augment_sft_data, train_in=str, badcase_in=str, train_out=f"{out}/train_augmented.jsonl", report=str, max_aug_per_sample=2, seed=42, dedup=True)
    return p


def logger(command: str, path: str) -> logging.Logger:
    """To stderr and, if a path is given, appended to its file; times are UTC."""
    log = logging.getLogger(f"millrace.{command}")
    log.setLevel(logging.INFO)
    log.handlers.clear()
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s", "%Y-%m-%dT%H:%M:%SZ")
    form.converter = time.gmtime
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(form)
        log.addHandler(h)
    return log


def main(argv: list[str] | None = None) -> int:
    load_env()
    a = parser().parse_args(argv)
    log = logger(a.command, a.log)
    log.info("started with %s", {k: v for k, v in vars(a).items() if k not in ("run", "command", "log")})
    try:
        got = a.run(session(), a)
    except Exception:
        log.exception("failed")
        raise
    (log.error if "error" in got else log.info)("ended with %s", got)
    print(json.dumps(got, ensure_ascii=False, default=str))
    return int("error" in got)


if __name__ == "__main__":
    raise SystemExit(main())
