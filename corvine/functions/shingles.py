"""Sets of five-character shingles and their SimHash, by arrays of code points.

Shingles are numbers: a worker numbers the characters that it meets, and five numbers of
12 bits make a shingle's. A text of over 4,095 different characters goes another way.
"""

from __future__ import annotations

import hashlib
import sys
from functools import cache

import numpy as np
import pyarrow as pa

from corvine.functions.points import points, slices

N, BITS = 5, 12
#: Shingles whose hashes a worker keeps, at a place that each has by its number.
SLOTS = 20
#: Bytes of text that a worker looks at in one step.
CHARS = 1 << 19
HASH = {"blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest(), "sha256": lambda b: hashlib.sha256(b).digest()[:8]}


class Shingles:
    """Numbers of characters, and of the hashes of shingles that were met."""

    def __init__(self, kind: str = "sha256"):
        self.hash = HASH[kind]
        self._reset()

    def _reset(self) -> None:
        self.number = np.zeros(sys.maxunicode + 1, np.uint16)
        self.known = [0]
        self.keys = np.full(1 << SLOTS, -1, np.int64).view(np.uint64)  # no shingle's number
        self.values = np.zeros(1 << SLOTS, np.uint64)

    def numbers(self, flat: np.ndarray) -> np.ndarray | None:
        """The characters' numbers, from 1; None if there are too many different ones.
        Numbers that were given before may be given anew."""
        n = self.number.take(flat)
        if not n.all():
            new = np.unique(flat[n == 0])
            if len(self.known) + len(new) > 1 << BITS:
                self._reset()
                new = np.unique(flat)
            if len(self.known) + len(new) > 1 << BITS:
                return None
            self.number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known += new.tolist()
            n = self.number.take(flat)
        return n

    def distinct(self, n: np.ndarray) -> np.ndarray:
        """The distinct shingles of a text, sorted; a shorter one is its own only one."""
        key, n = n[: max(len(n) - N + 1, 1)].astype(np.uint64) if len(n) else np.zeros(1, np.uint64), n.astype(np.uint64)
        for i in range(1, min(N, len(n))):
            key = key << np.uint64(BITS) | n[i : i + len(key)]
        key.sort()
        return key[np.r_[True, key[1:] != key[:-1]]]

    def hashes(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.values.take(at)
        if (some := np.flatnonzero(self.keys.take(at) != keys)).size:
            new, back = np.unique(keys[some], return_inverse=True)
            mask = (1 << BITS) - 1
            texts = ["".join([chr(self.known[c]) for i in range(N - 1, -1, -1) if (c := k >> BITS * i & mask)]) for k in new.tolist()]
            made = np.frombuffer(b"".join([self.hash(x.encode()) for x in texts]), ">u8").astype(np.uint64)
            out[some] = made[back]
            self.keys[at[some]], self.values[at[some]] = keys[some], out[some]
        return out


@cache
def shingles(kind: str = "sha256") -> Shingles:
    """This process's."""
    return Shingles(kind)


@cache
def _lanes() -> np.ndarray:
    """A byte's bits, each in a byte of its own."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def votes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of so many hashes, one at least, the hash of the bits that half of
    them or more have."""
    first = np.cumsum(sizes) - sizes
    # Runs in blocks of up to 255, so that a byte holds a block's sum.
    blocks = -(-sizes // 255)
    start = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    out = np.zeros(len(sizes), np.uint64)
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for p in range(8):
        some = np.add.reduceat(_lanes().take(parts[:, p]), start).view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(some.astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
        out |= np.packbits(2 * count >= sizes[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * p)
    return out.view(np.int64)


def simhash_all(texts: pa.Array, kind: str, slow) -> list[int | None]:
    """SimHash of each text; ``slow`` of the texts of too many different characters."""
    held, out = shingles(kind), []
    for b in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", CHARS):
        column = b.column("text")
        flat, length = points(column)
        if (n := held.numbers(flat)) is None:
            if len(column) == 1:
                out.append(slow(column[0].as_py()))
            else:
                out += simhash_all(column[: len(column) // 2], kind, slow) + simhash_all(column[len(column) // 2 :], kind, slow)
            continue
        sets = [held.distinct(n[e - x : e]) for e, x in zip(np.cumsum(length).tolist(), length.tolist(), strict=True)]
        h = votes(held.hashes(np.concatenate(sets)), np.array([len(x) for x in sets]))
        out += [x if ok else None for x, ok in zip(h.tolist(), column.is_valid().to_pylist(), strict=True)]
    return out


def overlap(a: str, b: str) -> tuple[int, int, int]:
    """The number of shingles of either text and of both."""
    held = shingles()
    flat, length = points(pa.array([a, b], pa.string()))
    if (n := held.numbers(flat)) is None:
        x, y = ({s} if len(s) < N else {s[i : i + N] for i in range(len(s) - N + 1)} for s in (a, b))
        return len(x), len(y), len(x & y)
    x, y = held.distinct(n[: length[0]]), held.distinct(n[length[0] :])
    both = np.sort(np.concatenate([x, y]))
    return len(x), len(y), int((both[1:] == both[:-1]).sum())
