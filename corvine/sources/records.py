"""Readers and writers of records and nested question sets."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet_records(spark: SparkSession, path: str) -> DataFrame:
    """source_id, title (the text's first line), text of a table of documents."""
    d = spark.read.parquet(path)
    return d.select(F.col("doc_id").cast("string").alias("source_id"), F.substring_index("text", "\n", 1).alias("title"), "text")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of any JSON: a field that isn't a string comes out null, so that the
    schema rule catches it, and ``raw`` holds the record as it came, keys sorted, which
    is what its hash is taken of. A line that isn't JSON fails, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = lines.select(F.parse_json("value").alias("v"))

    def field(name: str):
        kind = F.expr(f"schema_of_variant(variant_get(v, '$.{name}', 'variant'))")
        return F.when(kind == "STRING", F.expr(f"try_variant_get(v, '$.{name}', 'string')")).alias(name)

    return v.select(field("source_id"), field("title"), field("text"), F.to_json("v").alias("raw"))


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with sorted keys, nulls kept, in the given order over all parts."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    df.orderBy(*order).select(body.alias("value")).write.text(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c).cast("string") for c in ("doc_id", "title", "title_key", "text")]).write.option("compression", "zstd").parquet(path)


def atomic_json(path: str | Path, value: object) -> None:
    """Readers of ``path`` see the old value or the whole new one, also after a crash.

    The value is made before anything is touched, written in a folder of its own beside
    the target, forced to disk, and moved into place.
    """
    target = Path(path)
    text = json.dumps(value, indent=1, sort_keys=True, ensure_ascii=False)
    with tempfile.TemporaryDirectory(prefix="json-", dir=target.parent) as scratch:
        whole = Path(scratch, "whole")
        with whole.open("x", encoding="utf-8") as out:
            print(text, file=out, flush=True)
            os.fsync(out)
        whole.replace(target)


QUESTIONS = "data array<struct<title string, paragraphs array<struct<context string, qas array<struct<id string, question string, answers array<struct<text string, answer_start int>>>>>>>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row a question of a nested set: source_id (by article and paragraph), title,
    text, id, question, answers (start, text)."""
    a = spark.read.schema(QUESTIONS).option("multiLine", True).json(path).select(F.posexplode("data").alias("ai", "a"))
    p = a.select("ai", F.col("a.title").alias("title"), F.posexplode("a.paragraphs").alias("pi", "p"))
    q = p.select(F.concat_ws(":", F.lit("set"), "ai", "pi").alias("source_id"), "title", F.col("p.context").alias("text"), F.explode_outer("p.qas").alias("q"))
    answers = F.transform("q.answers", lambda x: F.struct(x["answer_start"].alias("start"), x["text"].alias("text")))
    return q.select("source_id", "title", "text", F.col("q.id").alias("id"), F.col("q.question").alias("question"), answers.alias("answers"))


def valid_references(questions: DataFrame) -> DataFrame:
    """Add valid: there are answers, and each is a non-blank text at its offset."""
    from corvine.functions.text import SPACE

    good = F.forall("answers", lambda a: (a["start"] >= 0) & (F.regexp_replace(a["text"], SPACE, "") != "") & (F.substring("text", a["start"] + 1, F.length(a["text"])) == a["text"]))
    return questions.withColumn("valid", F.coalesce((F.size("answers") > 0) & good, F.lit(False)))


def exclude_seen(records: DataFrame, seen_texts: DataFrame, seen_titles: DataFrame) -> DataFrame:
    """Drop records whose text or title_key was seen before: two anti joins, the one of
    texts by their digests, so that the texts seen aren't shuffled."""
    seen = seen_texts.select(F.sha2("text", 256).alias("seen")).distinct()
    return records.join(seen, F.sha2(F.col("text"), 256) == F.col("seen"), "left_anti").join(seen_titles.select("title_key").distinct(), "title_key", "left_anti")
