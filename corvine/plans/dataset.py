"""From nested questions to a split of families that leaks nothing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions import text as t
from corvine.operators import families as fam
from corvine.operators import quality
from corvine.session import materialize
from corvine.sources.records import exclude_seen, valid_references


class Prepared(NamedTuple):
    documents: DataFrame  # doc_id, title, title_key, text
    lineage: DataFrame  # doc_id, source_id, title_key
    families: DataFrame  # doc_id, family_id
    split: DataFrame  # family_id, id, split
    invalid: DataFrame  # id, of questions whose references don't stand
    counts: dict[str, int]


def prepare(questions: DataFrame, seen_texts: DataFrame, seen_titles: DataFrame, dev: int = 160, holdout: int = 160, simhash: Column | None = None) -> Prepared:
    """The set that is made of ``questions`` (source_id, title, text, id, question,
    answers; id is null for a paragraph without questions), and what went into it.

    Paragraphs whose text or title was seen are left out, the rest pass the rules; a
    question counts if its references stand and its paragraph was accepted, and one of
    each family is dealt to dev or holdout. Too few families raise ValueError. The driver
    gets counts only.
    """
    rows = materialize(questions.select("source_id", "title", "text", "id", "answers"), "questions")
    raw = materialize(rows.select("source_id", "title", "text").distinct(), "paragraphs")
    fresh = exclude_seen(raw.withColumn("title_key", t.title_key("title")), seen_texts, seen_titles)
    flagged = materialize(quality.flag(fresh), "flagged")
    good = materialize(quality.accepted(flagged), "accepted")
    docs, edges = materialize(quality.exact_dedup(good), "documents"), materialize(quality.lineage(good), "lineage")
    hashed = materialize(docs.select("doc_id", (t.simhash("text") if simhash is None else simhash).alias("h")), "hashes")
    near = materialize(fam.near_pairs(docs, hashed), "near")
    of = materialize(fam.families(docs, fam.title_edges(edges).unionByName(near.select("a", "b"))), "families")
    checked = valid_references(rows.where(F.col("id").isNotNull()))
    kept = checked.where("valid").join(good.select("source_id", "doc_id").distinct(), "source_id").join(of, "doc_id")
    chosen = materialize(fam.one_per_family(kept.select("id", "family_id")), "chosen")
    invalid = materialize(checked.where("not valid").select("id"), "invalid")
    counts = {"raw_paragraphs": raw.count(), "candidates": flagged.count(), "accepted": good.count(), "documents": docs.count(), "near_pairs": near.count(), "families": of.select("family_id").distinct().count(), "question_families": chosen.count(), "invalid_references": invalid.count()}
    counts["excluded"] = counts["raw_paragraphs"] - counts["candidates"]
    if counts["question_families"] < dev + holdout:
        raise ValueError(f"{counts['question_families']} families with questions, {dev + holdout} wanted")
    return Prepared(docs, edges, of, materialize(fam.split_families(chosen, dev, holdout), "split"), invalid, counts)


def with_probes(questions: DataFrame, probes: list[str]) -> DataFrame:
    """id, question, answerable: the questions, and written ones that nothing answers,
    under ids probe:0 and on."""
    spark = questions.sparkSession
    extra = spark.createDataFrame([(f"probe:{i}", q) for i, q in enumerate(probes)], "id string, question string")
    return questions.select("id", "question", F.lit(True).alias("answerable")).unionByName(extra.withColumn("answerable", F.lit(False)))
