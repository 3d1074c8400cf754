"""Record quality, quarantine, exact dedup and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions import text as t

FIELDS = ("source_id", "title", "text")


def flag(records: DataFrame) -> DataFrame:
    """Add reason (schema, empty, suspected_contact_pattern or null; the first that
    applies) and record_hash, of ``raw`` where a reader gives the record as it came; one
    row each, no shuffle. Titles aren't searched."""
    missing = F.col("source_id").isNull() | F.col("title").isNull() | F.col("text").isNull()
    empty = (F.col("source_id") == "") | t.is_blank("text") | t.is_blank("title")
    contact = (F.contains("text", F.lit(t.IN_EMAIL)) & F.col("text").rlike(t.EMAIL)) | (F.col("text").rlike(t.IN_PHONE) & F.col("text").rlike(t.PHONE))
    reason = F.when(missing, "schema").when(empty, "empty").when(contact, "suspected_contact_pattern")
    return records.select(*FIELDS, reason.alias("reason"), (F.sha2("raw", 256) if "raw" in records.columns else t.record_digest(*FIELDS)).alias("record_hash"))


def quarantined(flagged: DataFrame) -> DataFrame:
    """Ids, digests and reasons; never the text."""
    return flagged.where(F.col("reason").isNotNull()).select(F.coalesce("source_id", F.lit("")).alias("source_id"), "record_hash", "reason")


def accepted(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("reason").isNull()).select(*FIELDS, "record_hash", t.digest("text").alias("doc_id"), t.title_key("title").alias("title_key"))


def exact_dedup(rows: DataFrame) -> DataFrame:
    """One document per doc_id: the row of least (source_id, title), and only its title
    is folded.

    The shuffle carries ids and titles only; the text, which all rows of a doc_id share,
    travels once a task as the group's first.
    """
    g = rows.groupBy("doc_id").agg(F.min(F.struct("source_id", "title")).alias("m"), F.first("text").alias("text"))
    return g.select("doc_id", F.col("m.title").alias("title"), t.title_key(F.col("m.title")).alias("title_key"), "text")


def lineage(rows: DataFrame) -> DataFrame:
    """One edge per (doc_id, source_id)."""
    return rows.groupBy("doc_id", "source_id").agg(F.max("title_key").alias("title_key"))


def manifest_counts(flagged: DataFrame) -> DataFrame:
    good = F.col("reason").isNull()
    c = flagged.agg(
        F.count(F.lit(1)).alias("input"),
        F.count_if(good).alias("accepted_rows"),
        F.count_distinct(F.when(good, t.digest("text"))).alias("documents"),
        F.count_if(~good).alias("quarantined"),
    )
    return c.withColumn("duplicate_rows", F.col("accepted_rows") - F.col("documents"))


def source_conflicts(flagged: DataFrame) -> DataFrame:
    """Non-empty source ids that come with different records."""
    named = flagged.where(F.col("source_id").isNotNull() & (F.col("source_id") != ""))
    g = named.groupBy("source_id").agg(F.min("record_hash").alias("a"), F.max("record_hash").alias("b"))
    return g.where(F.col("a") != F.col("b")).select("source_id")


def removed_records(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Digests that the parent has more often than the child: empty if append-only."""
    return parent.select("record_hash").exceptAll(child.select("record_hash"))


def shard_assignment(flagged: DataFrame, batch_size: int = 64) -> DataFrame:
    """bucket (two hex digits) and shard of each record: runs of ``batch_size`` within a
    bucket by digest. Buckets are refined by two more digits to rank in small windows;
    their sizes then place each within its bucket."""
    from pyspark.sql import Window

    h = flagged.select("record_hash", F.substring("record_hash", 1, 2).alias("bucket"), F.substring("record_hash", 1, 5).alias("fine"))
    size = h.groupBy("bucket", "fine").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("fine", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("fine").orderBy("record_hash")) - 1
    ranked = h.withColumn("rank", rank).join(size, "fine")
    return ranked.select("record_hash", "bucket", F.floor((F.col("before") + F.col("rank")) / batch_size).cast("long").alias("shard"))
