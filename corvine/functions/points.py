"""Texts as arrays of code points, a batch at a time, for steps that look at every character."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: In a table by code point: dropped, and folded to more than one character.
DROP, MANY = -1, -2
#: Below this, no character composes with another, so a text is in NFC as it is.
COMPOSES = 0x300


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a column of strings, one string after another, and the length
    of each; a null counts as empty."""
    s = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1]
    body = memoryview(s.buffers()[2])[ends[0] : ends[-1]] if len(s) and ends[-1] > ends[0] else b""
    flat = np.frombuffer(bytes(body).decode().encode("utf-32-le"), np.uint32)
    return flat, pc.utf8_length(s).to_numpy(zero_copy_only=False).astype(np.int64)


def normal_form(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``points`` of each string's NFC."""
    flat, sizes = points(column)
    if len(flat) and flat.max() >= COMPOSES:
        texts = [unicodedata.normalize("NFC", x or "") for x in column.to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return flat, sizes


@cache
def folded() -> tuple[np.ndarray, dict[int, list[int]]]:
    """By code point, what a letter or digit folds to: one character, MANY (those are in
    the second table), or DROP for what is neither. Built once in a process."""
    table, many = np.full(sys.maxunicode + 1, DROP, np.int32), {}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            f = c.casefold()
            table[i] = ord(f) if len(f) == 1 else MANY
            if len(f) > 1:
                many[i] = [ord(x) for x in f]
    return table, many


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Batches whose strings in a column take about so many bytes, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, side="right")))
            yield b.slice(at, to - at)
            at = to


def letters(column: pa.Array, normal: bool = False, number: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The code points of each string's normal form (``text.normal_text``), one string
    after another, and the string that each belongs to; ``normal`` says that the strings
    are such forms already. With ``number`` (of ``numbered``) numbers in their place."""
    flat, sizes = points(column) if normal else normal_form(column)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    if normal:
        return flat.astype(np.int32) if number is None else number[0].take(flat), row
    table, many = folded()
    out = (table if number is None else number[1]).take(flat)
    kept = np.flatnonzero(out != DROP)
    out, row = out.take(kept), row.take(kept)
    if (some := np.flatnonzero(out == MANY)).size:
        long = [many[i] if number is None else number[0].take(many[i]).tolist() for i in flat.take(kept.take(some)).tolist()]
        out[some] = [x[0] for x in long]
        rest = np.repeat(some, [len(x) - 1 for x in long])
        out, row = np.insert(out, rest + 1, [c for x in long for c in x[1:]]), np.insert(row, rest + 1, row[rest])
    return out, row


def numbered(known: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tables by code point: the place of a character in ``known``, from 1 (0: not there);
    and the same of what a letter or digit folds to, with DROP and MANY as in ``folded``."""
    plain = np.zeros(sys.maxunicode + 1, np.int32)
    plain[known] = np.arange(1, len(known) + 1)
    table = folded()[0]
    return plain, np.where(table < 0, table, plain[table])
