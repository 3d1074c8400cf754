"""From raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents. A stage's rows are written as Parquet in
the shared folder and reread, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from corvine.session import materialize

#: Rows of a batch of texts and token ids: a batch is held in the JVM and in Python, and
#: by this stage the JVM's heap has grown to what it may take.
BATCH = 500


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger marks as toxic go.

    Null and empty texts have no tokens and stay; rows are judged one by one, so repeated
    ones go or stay together. Without labels of both classes nothing is learnt and the
    score is the labels' base rate, 0.5 if there are none, so all stay. Other columns are
    untouched; an empty table stays empty.
    """
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where(F.col("predicted") == 0).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that consisted of nothing else.

    The order is that of doc_id, null last, then of a hash of the text; rows that repeat
    both are one document. Null and empty texts stay. n_chars, if there, follows the text.
    """
    d = line_dedup.dedup_lines(docs)
    d = d.where((F.col("n_removed") == 0) | (F.coalesce("text", F.lit("")) != ""))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that link by five-word shingles at 0.8 the one of smallest doc_id stays.

    What is judged is a doc_id with a text: of rows that repeat both, the least one
    stays; several texts of one id are judged each for itself, those of one class in the
    order of their digests. Rows with a null id stay.
    """
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    again = materialize(again.select("doc_id"), "again")
    digest, row = F.coalesce(F.sha2("text", 256), F.lit("")), F.col("doc_id").cast("long")
    each = docs
    if again.limit(1).count():
        some = docs.join(again, "doc_id", "left_semi").select(docs.columns)
        some = materialize(some.groupBy("doc_id", digest.alias("_text")).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*"), "repeated")
        each = docs.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(some)
        if some.groupBy("doc_id").count().where(F.col("count") > 1).limit(1).count():
            # Numbers in the order of id and digest stand for the ids.
            order = each.where(F.col("doc_id").isNotNull()).select("doc_id", digest.alias("_text")).orderBy("doc_id", "_text")
            order = materialize(order.withColumn("_row", F.monotonically_increasing_id()), "order")
            each, row = each.withColumn("_text", digest).join(order, ["doc_id", "_text"], "left"), F.col("_row")
        each = materialize(each, "each")
    found = ngram_join.jaccard_components(each.select(row.alias("doc_id"), "text"), n=5, share=(80, 100))
    gone = materialize(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")), "gone")
    return each.join(gone, row == F.col("_gone"), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words are never taken. Rows
    that repeat doc_id and text are taken alike."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids of each document. Written
    here, as only the write can bound the batches."""
    return materialize(bpe.token_digests(docs, with_ids=True), "encoded", BATCH)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No SQL trains the tagger or draws the sample; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
