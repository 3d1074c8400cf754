"""Families of near copies, and samples that leak none across a split."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corvine.functions import text as t
from corvine.functions.shingles import overlap
from corvine.operators.components import connected_components
from corvine.session import materialize, small_side

BITS = 3
JACCARD = 0.85


def title_edges(lineage: DataFrame) -> DataFrame:
    """Each document to the least one of its title: a star has a chain's components."""
    least = lineage.groupBy("title_key").agg(F.min("doc_id").alias("b"))
    star = lineage.select("doc_id", "title_key").distinct().join(least, "title_key")
    return star.where(F.col("doc_id") != F.col("b")).select(F.col("doc_id").alias("a"), "b").distinct()


def _masks(bits: int) -> list[int]:
    """Masks, as signed longs, of every choice of ``bits`` out of 2 * ``bits`` blocks of a
    hash: where at most ``bits`` bits differ, some choice lies in the blocks without one."""
    blocks = 2 * bits
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in pairwise(cuts)]
    whole = [sum(c) for c in combinations(one, bits)] or [0]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def near_candidates(hashed: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs a > b whose 64-bit hashes differ in at most ``bits`` bits. hashed: doc_id, h.

    A hash is looked up by half of its bits, in each of the 20 ways (for three bits) that
    take three of six blocks; one of them agrees for every such pair. So n hashes meet by
    chance 20 n^2 / 2^33 times, where four keys of a quarter would need 4 n^2 / 2^17.
    Equal hashes are joined once, by their least document, and not within a group.
    """
    groups = hashed.groupBy("h").agg(F.min("doc_id").alias("rep"))
    band = F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in _masks(bits)]))
    banded = materialize(groups.select("h", band.alias("band", "key")), "bands")
    x, y = banded.select("band", "key", F.col("h").alias("hx")), banded.select("band", "key", F.col("h").alias("hy"))
    near = x.join(y, ["band", "key"]).where((F.col("hx") < F.col("hy")) & (F.bit_count(F.col("hx").bitwiseXOR(F.col("hy"))) <= bits)).select("hx", "hy").distinct()
    same = hashed.select(F.col("h").alias("hx"), F.col("h").alias("hy")).groupBy("hx", "hy").count().where("count > 1").select("hx", "hy")
    near = near.unionByName(same)
    a, b = hashed.select(F.col("doc_id").alias("p"), F.col("h").alias("hx")), hashed.select(F.col("doc_id").alias("q"), F.col("h").alias("hy"))
    both = near.join(a, "hx").join(b, "hy").where((F.col("hx") != F.col("hy")) | (F.col("p") < F.col("q")))
    return both.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b"))


def near_pairs(docs: DataFrame, hashed: DataFrame, least: float = JACCARD) -> DataFrame:
    """a, b, jaccard of candidate pairs by their five-character shingles; only texts of
    candidates meet, and shingles are made for those only."""
    c = materialize(near_candidates(hashed), "candidates")
    ids = materialize(c.select(F.col("a").alias("doc_id")).unionByName(c.select(F.col("b").alias("doc_id"))).distinct(), "copies")
    texts = docs.select("doc_id", "text").join(small_side(ids), "doc_id", "left_semi")
    p = c.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sizes = [overlap(s, t) for s, t in zip(x.column("ta").to_pylist(), x.column("tb").to_pylist(), strict=True)]
            j = pa.array([both / (m + n - both) for m, n, both in sizes], pa.float64())
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), j], names=["a", "b", "jaccard"])

    schema = StructType([p.schema["a"], p.schema["b"], StructField("jaccard", DoubleType())])
    return p.select("a", "b", "ta", "tb").mapInArrow(compare, schema).where(F.col("jaccard") >= least)


def audit(hashed: DataFrame, near: DataFrame, of: DataFrame) -> DataFrame:
    """One row: candidate pairs, those that are near, documents, families, and the size
    of the largest one."""
    sizes = of.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    a = near_candidates(hashed).agg(F.count(F.lit(1)).alias("candidates"))
    b = near.agg(F.count(F.lit(1)).alias("near_pairs"))
    c = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count(F.lit(1)).alias("families"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return a.crossJoin(b).crossJoin(c)


def families(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, family_id: the digest of the sorted members, as JSON."""
    labels = connected_components(edges)
    of = docs.select("doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"))
    of = materialize(of, "members")
    # A family's id is a function of all its member ids, so those must meet.
    ids = of.groupBy("label").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("doc_id"))), 256).alias("family_id"))
    return of.join(materialize(ids, "families"), "label").select("doc_id", "family_id")


def one_per_family(questions: DataFrame) -> DataFrame:
    """The question of least salted digest of each family. questions: id, family_id."""
    key = F.struct(t.digest(F.concat(F.lit("question-v1:"), F.col("id"))).alias("d"), "id")
    return questions.groupBy("family_id").agg(F.min(key).alias("k")).select("family_id", F.col("k.id").alias("id"))


def split_families(chosen: DataFrame, dev: int, holdout: int) -> DataFrame:
    """Families by salted digest: the first ``dev``, then ``holdout``; the cut is a
    top-k, so only those rows reach one task."""
    d = chosen.withColumn("d", t.digest(F.concat(F.lit("evidence-v1:"), F.col("family_id"))))
    top = d.orderBy("d").limit(dev + holdout)
    r = F.row_number().over(Window.orderBy("d"))
    return top.withColumn("r", r).select("family_id", "id", F.when(F.col("r") <= dev, "dev").otherwise("holdout").alias("split"))
