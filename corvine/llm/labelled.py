"""What the trained operators share: the split, labels, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 by 3; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y (0 or 1) of the rows that may be learnt from: ids and labels not
    null, not held out; of labels that disagree about an id the largest."""
    t = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    return t.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).where(F.col("y").isin(0, 1))


def sample_ids(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of either class, the first in the order of a hash of
    the id, so that the sample doesn't depend on partitions."""
    one, zero = (labels.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (1, 0))
    return one.unionByName(zero)
