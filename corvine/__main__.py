"""Command lines: python -m corvine ingest | versions | chunks | search | answer.

Runs on the session that spark-submit gives, or on a local one.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import qa
from corvine.operators import retrieval as ret
from corvine.plans.lake import Lake
from corvine.session import local_session, materialize
from corvine.sources.records import read_jsonl


def _positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvine")
    command = p.add_subparsers(dest="command", required=True)
    c = command.add_parser("ingest", help="publish records as a version")
    c.add_argument("--input", required=True)
    c.add_argument("--lake", required=True)
    c.add_argument("--parent")
    c = command.add_parser("versions", help="list what is published")
    c.add_argument("--lake", required=True)
    for name, told in (("chunks", "count chunks"), ("search", "find the best chunks"), ("answer", "answer with a quote")):
        c = command.add_parser(name, help=told)
        c.add_argument("--lake", required=True)
        c.add_argument("--version", required=True)
        c.add_argument("--size", type=_positive, default=160)
        c.add_argument("--stride", type=_positive, default=160)
        if name != "chunks":
            c.add_argument("--question", required=True, action="append")
            c.add_argument("-k", type=_positive, default=3)
        if name == "answer":
            c.add_argument("--mode", choices=("json", "span", "verified_span"), default="span")
            c.add_argument("--generator", required=True, help="module:function from a prompt to a reply")
    return p


def answers(asked: DataFrame, hits: DataFrame, mode: str, generator: str, k: int) -> DataFrame:
    module, _, name = generator.partition(":")
    call = getattr(importlib.import_module(module), name)
    prompt = qa.json_prompt if mode == "json" else qa.span_prompt
    said = materialize(qa.generate(qa.evidence(asked, hits, k), call, prompt), "replies")
    if mode == "json":
        return qa.bind_citations(said, hits)
    quotes = said.select("id", F.col("raw").alias("quote"))
    if mode == "span":
        return qa.bind_spans(quotes, hits)
    return qa.bind_spans(quotes, hits, materialize(qa.ask_verdicts(asked, qa.bind_spans(quotes, hits), call), "verdicts"))


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | dict:
    lake = Lake(spark, a.lake)
    if a.command == "ingest":
        return lake.publish(read_jsonl(spark, a.input), a.parent)
    if a.command == "versions":
        return lake.versions()
    rows = materialize(ret.chunks(lake.read(a.version), a.size, a.stride), "chunks")
    if a.command == "chunks":
        return rows.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(a.question)], "id string, question string")
    hits = materialize(ret.search(rows, asked, a.k).join(rows, "chunk_id"), "hits")
    return hits if a.command == "search" else answers(asked, hits, a.mode, a.generator, a.k)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    out = run(SparkSession.getActiveSession() or local_session(), a)
    for row in [out] if isinstance(out, dict) else (r.asDict(recursive=True) for r in out.toLocalIterator()):
        print(json.dumps(row, ensure_ascii=False, sort_keys=True))


if __name__ == "__main__":
    main()
