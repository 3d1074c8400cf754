"""Results that grow run by run, files with known digests, and readable traces."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.sources.records import atomic_json


def pinned_files(spark: SparkSession, digests: dict[str, str]) -> DataFrame:
    """path, length, sha256 of files whose SHA-256 is known; reading the plan fails at
    the first one that differs. Each file is read where the plan runs."""
    out = None
    for path, want in digests.items():
        f = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
        told = F.when(F.col("sha256") == want, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("path"))).cast("string"))
        f = f.withColumn("sha256", told)
        out = f if out is None else out.unionByName(f)
    if out is None:
        raise ValueError("no files named")
    return out


def freeze(path: str | Path, config: dict) -> str:
    """The digest of a configuration, kept in a file beside it. A file that holds another
    configuration, or one that was changed by hand, raises ValueError."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    frozen = {"config": config, "sha256": digest}
    if Path(path).exists():
        if json.loads(Path(path).read_text(encoding="utf-8")) != json.loads(json.dumps(frozen)):
            raise ValueError("frozen with another configuration")
    else:
        atomic_json(path, frozen)
    return digest


def append_results(results: DataFrame, path: str, keys: tuple[str, ...] = ("arm", "id")) -> DataFrame:
    """Add the results whose keys the folder doesn't hold yet, as JSON lines, and return
    all it holds; a run that was broken off goes on where it stopped. Of rows with equal
    keys one is kept, the least."""
    spark = results.sparkSession
    order = F.struct(*[c for c in results.columns])
    fresh = results.groupBy(*keys).agg(F.min(order).alias("r")).select("r.*")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.schema(results.schema).json(path)
        fresh = fresh.join(held.select(*keys), list(keys), "left_anti").select(*results.columns)
    fresh.write.mode("append").option("ignoreNullFields", "false").json(path)
    return spark.read.schema(results.schema).json(path)


def render_trace(question: str, rows: list[dict]) -> str:
    """Markdown of one question's chain of evidence. rows: source_id, doc_id, rank,
    chunk_id, from_source of its hits (as ``trace`` gives them)."""
    lines = [f"# {question}", ""]
    for doc in sorted({r["doc_id"] for r in rows}):
        lines += [f"Source document `{doc}`, from record " + ", ".join(f"`{s}`" for s in sorted({r["source_id"] for r in rows if r["doc_id"] == doc})), ""]
    lines += ["| rank | chunk | from its source |", "|-|-|-|"]
    seen = {(r["rank"], r["chunk_id"], bool(r["from_source"])) for r in rows}
    lines += [f"| {rank} | `{chunk}` | {'yes' if own else 'no'} |" for rank, chunk, own in sorted(seen)]
    return "\n".join(lines) + "\n"
