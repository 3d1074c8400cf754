"""Which texts hold which pieces, by an equality join on what stands at the start of a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.points import points, slices
from corvine.session import materialize, small_side

#: Characters from the start of a word that are looked up: the most that a piece has.
SIZES = (32, 16, 8, 4, 2, 1)
#: Up to so many keys of pieces go to the tasks, which then send none but those.
KEYS = 1 << 20
#: Bytes of text that a worker looks at in one step.
CHARS = 1 << 19
FACTOR = 0x9E3779B97F4A7C15


def _starts(flat: np.ndarray) -> np.ndarray:
    """Where a word starts after white space."""
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    return np.flatnonzero(space[:-1] & ~space[1:]) + 1


def _keys(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` (a power of two) characters from each place, as a long."""
    h, n, f = flat.astype(np.uint64), 1, FACTOR
    while n < size:
        h = h[:-n] * np.uint64(f) + h[n:]
        n, f = 2 * n, f * f % (1 << 64)
    return ((h[at] + np.uint64(size)) * np.uint64(FACTOR)).view(np.int64)


def _piece_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "piece", CHARS):
        size, key = [], []
        for s in b.column("piece"):
            flat, _ = points(pa.array([s.as_py()], pa.string()))
            at = _starts(flat)[:1]
            size.append(next((n for n in SIZES if len(at) and at[0] + n <= len(flat)), 0))
            key.append(int(_keys(flat, at, size[-1])[0]) if size[-1] else 0)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("piece"), pa.array(size, pa.int32()), pa.array(key, pa.int64())], names=["id", "piece", "size", "key"])


def places(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, id, at: the documents (doc_id, text) that hold a piece (id, piece)
    verbatim, and its first place, from 0.

    A word within a piece that white space precedes there starts a word in any text that
    holds it. So a piece is looked up by the characters from its first such place on, up
    to 32 of them, among those of every place of a text where a word starts, and only
    what is found is searched. Pieces without such a place are compared with every text.
    """
    kind = pieces.schema["id"].dataType.simpleString()
    p = materialize(pieces.select("id", "piece").where(F.col("piece").isNotNull()).mapInArrow(_piece_keys, f"id {kind}, piece string, size int, key long"), "pieces")
    sizes = [r["size"] for r in p.select("size").distinct().collect()]  # at most len(SIZES) + 1
    found = []
    where = (F.call_function("locate", F.col("piece"), F.col("text")) - 1).alias("at")
    if 0 in sizes:
        found.append(docs.join(small_side(p.where("size = 0")), F.contains("text", "piece")).select("doc_id", "id", where))
    if (some := sorted(set(sizes) - {0})):
        rows = p.where("size > 0").select("key").distinct().limit(KEYS + 1).collect()
        wanted = np.sort(np.array([r["key"] for r in rows], np.int64)) if len(rows) <= KEYS else None

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", CHARS):
                flat, length = points(b.column("text"))
                ends, at = np.cumsum(length), _starts(flat)
                row = np.searchsorted(ends, at, side="right")
                for size in some:
                    whole = at + size <= ends[row]
                    key, of = _keys(flat, at[whole], size) if whole.any() else np.empty(0, np.int64), row[whole]
                    if wanted is not None:
                        near = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                        key, of = key[near], of[near]
                    if len(key):
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), pa.array(key)], names=["doc_id", "key"])

        name = docs.schema["doc_id"].dataType.simpleString()
        at = docs.select("doc_id", "text").mapInArrow(keys, f"doc_id {name}, key long").join(p.where("size > 0").select("id", "key"), "key").select("doc_id", "id").distinct()
        sure = small_side(materialize(at.join(p.select("id", "piece"), "id"), "places"))
        found.append(docs.select("doc_id", "text").join(sure, "doc_id").where(F.contains("text", "piece")).select("doc_id", "id", where))
    if not found:
        return docs.select("doc_id").limit(0).join(pieces.select("id").limit(0)).withColumn("at", F.lit(0))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def contained(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, id: the documents (doc_id, text) that hold a piece (id, piece) verbatim."""
    return places(docs, pieces).select("doc_id", "id")
