"""Immutable, verified, append-only snapshots with a version and lineage catalog.

Tables are computed and written by Spark; the driver decides versions, checks what was
written and publishes by one rename (a local or mounted file system that has one).
There is no latest pointer: readers name a version.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import pkgutil
import shutil
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import quality
from corvine.session import materialize
from corvine.sources.records import atomic_json

#: A digest of the rules' source; part of every version and of every cached shard.
OPERATOR = hashlib.sha256(b"".join(pkgutil.get_data("corvine", name) or b"" for name in ("operators/quality.py", "functions/text.py"))).hexdigest()[:16]
TABLES = ("documents", "lineage", "quarantine", "input_hashes")


def _row_hash(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def _sums(h: str) -> list[Column]:
    """The number of rows and the sums of the pieces of their hashes."""
    return [F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]]


def table_digest(df: DataFrame) -> str:
    """A digest of the rows as a multiset: their number and the sums of the pieces of
    their hashes, so neither order nor files matter and no rows are gathered."""
    row = df.select(_row_hash(df).alias("h")).agg(*_sums("h")).first()
    return hashlib.sha256(json.dumps([str(x) for x in row]).encode()).hexdigest()


def _bucket_digests(df: DataFrame) -> dict[str, tuple]:
    """The number and sums of each bucket's whole rows: at most 256 entries."""
    d = df.select(F.substring("record_hash", 1, 2).alias("bucket"), _row_hash(df).alias("h"))
    return {r["bucket"]: tuple(r)[1:] for r in d.groupBy("bucket").agg(*_sums("h")).collect()}


class Lake:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root).resolve()
        for d in ("versions", "staging", "catalog", "shards"):
            (self.root / d).mkdir(parents=True, exist_ok=True)

    @contextlib.contextmanager
    def _alone(self) -> Iterator[None]:
        with (self.root / "writer.lock").open("a") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield

    def _read(self, path: Path) -> DataFrame:
        return self.spark.read.parquet(_uri(path))

    def _manifest(self, folder: Path) -> dict:
        """The manifest, if the folder holds its tables and nothing else."""
        at = folder / "manifest.json"
        if at.is_symlink() or not at.is_file():
            raise ValueError("a snapshot's manifest must be a regular file")
        manifest = json.loads(at.read_text())
        if set(manifest.get("tables", ())) != set(TABLES) or {p.name for p in folder.iterdir()} != {*TABLES, "manifest.json"}:
            raise ValueError("snapshot with missing or unknown tables")
        if manifest.get("version") != _version(manifest["identity"]):
            raise ValueError("snapshot's version isn't that of its identity")
        if any((folder / name).is_symlink() for name in TABLES):
            raise ValueError("snapshot with a table elsewhere")
        return manifest

    def verify(self, folder: Path) -> dict:
        """The manifest, if the folder holds exactly its tables with their digests."""
        manifest = self._manifest(folder)
        for name, digest in manifest["tables"].items():
            if table_digest(self._read(folder / name)) != digest:
                raise ValueError(f"snapshot checksum mismatch: {name}")
        return manifest

    def _published(self, version: str) -> Path:
        """The folder of a published version, if its manifest is the registered one."""
        entry = self.root / "catalog" / f"{version}.json"
        if not entry.is_file():
            raise KeyError("version not published")
        folder = self.root / "versions" / version
        if hashlib.sha256((folder / "manifest.json").read_bytes()).hexdigest() != json.loads(entry.read_text())["manifest"]:
            raise ValueError("catalog and manifest differ")
        return folder

    def snapshot(self, version: str) -> Path:
        """The verified folder of a published version."""
        folder = self._published(version)
        self.verify(folder)
        return folder

    def read(self, version: str, table: str = "documents") -> DataFrame:
        return self._read(self.snapshot(version) / table)

    def lineage(self, version: str, doc_id: str | None = None) -> DataFrame:
        """version, doc_id, source_id, title_key of a published version's documents."""
        rows = self.read(version, "lineage").withColumn("version", F.lit(version))
        return rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)

    def versions(self) -> DataFrame:
        """version, parent and counts of all that is published."""
        at = [json.loads((self.snapshot(p.stem) / "manifest.json").read_text()) for p in sorted((self.root / "catalog").glob("*.json"))]
        names = ("input", "accepted_rows", "documents", "quarantined", "duplicate_rows")
        rows = [(m["version"], m["identity"]["parent"], *[m["counts"][c] for c in names]) for m in at]
        return self.spark.createDataFrame(rows, "version string, parent string, " + ", ".join(f"{c} long" for c in names))

    def export(self, version: str, folder: str | Path) -> Path:
        """A copy of a published version in a folder that doesn't exist yet, verified."""
        target = Path(folder)
        shutil.copytree(self.snapshot(version), target)
        self.verify(target.resolve())
        return target

    def _register(self, version: str) -> None:
        body = (self.root / "versions" / version / "manifest.json").read_bytes()
        atomic_json(self.root / "catalog" / f"{version}.json", {"version": version, "manifest": hashlib.sha256(body).hexdigest()})

    def _processed(self, flagged: DataFrame, hashes: DataFrame) -> tuple[DataFrame, int, int]:
        """Flagged rows, whose digests are given too, through the shard cache: a bucket
        (two hex digits of the record's digest) whose records are unchanged is read, the
        others are written first. All that is read must be the rows that went in."""
        b = flagged.withColumn("bucket", F.substring("record_hash", 1, 2))
        piece = lambda i: F.sum(F.conv(F.substring("record_hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
        # At most 256 rows.
        keys = hashes.select("record_hash", F.substring("record_hash", 1, 2).alias("bucket")).groupBy("bucket").agg(F.sha2(F.concat_ws(":", F.lit(OPERATOR), F.count(F.lit(1)), *[piece(i) for i in range(4)]), 256).alias("key")).collect()
        names = {r["bucket"]: f"{r['bucket']}-{r['key'][:40]}" for r in keys}
        have = {p.name.removeprefix("shard=") for p in (self.root / "shards").iterdir() if (p / "done").is_file()}
        todo = sorted(x for x, n in names.items() if n not in have)
        if todo:
            name = F.create_map(*[F.lit(v) for k in todo for v in (k, names[k])])
            rows = b.where(F.col("bucket").isin(todo)).withColumn("shard", name[F.col("bucket")]).drop("bucket")
            rows.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(_uri(self.root / "shards"))
            for x in todo:
                (self.root / "shards" / f"shard={names[x]}" / "done").touch()
        if not names:
            return flagged, 0, 0
        paths = [_uri(self.root / "shards" / f"shard={n}") for n in names.values()]
        rows = self.spark.read.schema(flagged.schema).parquet(*paths)
        want, got = _bucket_digests(flagged), _bucket_digests(rows)
        if bad := sorted(x for x in want.keys() | got.keys() if want.get(x) != got.get(x)):
            raise ValueError(f"shard checksum mismatch: {', '.join(names.get(x, str(x)) for x in bad)}")
        return rows, len(names) - len(todo), len(todo)

    def publish(self, records: DataFrame, parent: str | None = None) -> dict:
        """Publish records (source_id, title, text) as a version; the same input gives
        the same version, and a version that exists is verified and returned."""
        if missing := sorted({*quality.FIELDS} - {*records.columns}):
            raise ValueError(f"records lack {', '.join(missing)}")
        if parent is not None and not (isinstance(parent, str) and parent):
            raise ValueError("parent must be the name of a version")
        flagged = quality.flag(records)
        # Digests read whole texts, so they are made once for all that needs only them.
        narrow = materialize(flagged.select("source_id", "record_hash"), "hashes")
        if (bad := quality.source_conflicts(narrow).limit(1).collect()):
            raise ValueError(f"conflicting source_id: {bad[0]['source_id']}")
        hashes = narrow.select("record_hash")
        identity = {"input": table_digest(hashes), "operator": OPERATOR, "parent": parent}
        version = _version(identity)
        home, stage = self.root / "versions" / version, self.root / "staging" / version
        with self._alone():
            if parent is not None and not quality.removed_records(self.read(parent, "input_hashes"), hashes).isEmpty():
                raise ValueError("append-only: the parent has records that the input lacks")
            if home.exists():
                if self.verify(home)["identity"] != identity:
                    raise ValueError("version of another identity")
                if (self.root / "catalog" / f"{version}.json").is_file():
                    self._published(version)  # whose tables were verified just now
                else:  # a writer ended between rename and registration
                    self._register(version)
                return {"version": version, "reused_snapshot": True, "resumed_shards": 0, "processed_shards": 0}
            if stage.is_symlink() or (stage.exists() and {p.name for p in stage.iterdir()} - {*TABLES, "manifest.json"}) or any(p.is_symlink() for p in (stage.iterdir() if stage.exists() else ())):
                raise ValueError("unknown files in the staging folder")
            rows, resumed, processed = self._processed(flagged, hashes)
            good = quality.accepted(rows)
            tables = {"documents": quality.exact_dedup(good), "lineage": quality.lineage(good), "quarantine": quality.quarantined(rows), "input_hashes": rows.select("record_hash")}
            for name, df in tables.items():
                df.write.mode("overwrite").option("compression", "zstd").parquet(_uri(stage / name))
            # Written documents are the distinct texts, so those aren't looked for again.
            n = rows.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("reason").isNull()).alias("accepted_rows")).first()
            documents = self._read(stage / "documents").count()
            counts = {**n.asDict(), "documents": documents, "quarantined": n["input"] - n["accepted_rows"], "duplicate_rows": n["accepted_rows"] - documents}
            atomic_json(stage / "manifest.json", {"version": version, "identity": identity, "counts": counts, "tables": {n: table_digest(self._read(stage / n)) for n in TABLES}})
            self._manifest(stage)  # digests are those of the files, read back just now
            os.rename(stage, home)
            self._register(version)
        return {"version": version, "reused_snapshot": False, "resumed_shards": resumed, "processed_shards": processed}


def _uri(path: Path) -> str:
    return f"file://{path}"  # as_uri() would escape the signs of partition names


def _version(identity: dict) -> str:
    return hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:24]
