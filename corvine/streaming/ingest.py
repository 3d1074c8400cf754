"""File-arrival ingestion (an extension): each micro-batch is published as a version
whose parent is the one before."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.plans.lake import Lake
from corvine.sources.records import atomic_json


def ingest(spark: SparkSession, source: str, lake: Lake, checkpoint: str):
    """Publish all JSON files that are there and return the versions, oldest first. A
    batch that is delivered again finds its version published."""
    chain = Path(lake.root) / "chain"
    chain.mkdir(exist_ok=True)
    got: list[str] = []

    def publish(batch: DataFrame, epoch: int) -> None:
        import json

        entry = chain / f"{epoch:012d}.json"
        before = sorted(p for p in chain.glob("*.json") if p.name < entry.name)
        parent = json.loads(before[-1].read_text()) if before else None
        rows = batch
        if parent is not None:
            held = spark.read.schema(batch.schema).json(f"file://{chain}/rows")
            rows = batch.unionByName(held.where(F.col("epoch") < epoch).select(batch.columns))
        version = lake.publish(rows, parent)["version"]
        batch.write.mode("overwrite").json(f"file://{chain}/rows/epoch={epoch}")
        atomic_json(entry, version)
        got.append(version)

    stream = spark.readStream.schema("source_id string, title string, text string").json(source)
    stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return got
