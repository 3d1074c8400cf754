"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvine.llm.workers import give_back

#: Texts above this many characters are encoded piece by piece, so that the library's
#: working memory follows the piece and not the text.
PIECE_CHARS = 1 << 16


class ByteBpe:
    """An encoder for one rank file; each match of the pattern is encoded separately."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # Ids as text, for joining them.
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= PIECE_CHARS:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in safe_pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where the pattern always ends a match: before a space or line
    feed that follows an ASCII letter or digit. No match of the pattern runs from a
    character that isn't white space into one that is, and it looks only ahead, so both
    sides split as they do in the whole text. A text without such a place stays whole.
    """
    start, at = 0, size
    while at < len(text):
        c = text[at]
        if (c == " " or c == "\n") and text[at - 1].isascii() and text[at - 1].isalnum():
            yield text[start:at]
            start, at = at, at + size
        else:
            at += 1
    yield text[start:]


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(ranks_path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def _with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in new]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [*new.values()], names=[n for n, _ in kept] + [*new])


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """Keep every column and add ``token_ids``, an array of ints.

    Null and empty texts get an empty array. A narrow map: no shuffle, rows one by one.
    A column named token_ids is replaced.
    """
    path, pat = default_vocabulary()
    path, pat = ranks_path or path, pattern or pat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pat)
        for b in batches:
            ids = [bpe.encode(x) for x in b.column(text).to_pylist()]
            yield _with_columns(b, {"token_ids": pa.array(ids, pa.list_(pa.int32()))})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "token_ids"]
    return docs.mapInArrow(run, ", ".join([*fields, "token_ids array<int>"]))


def decode_documents(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None, ids: str = "token_ids") -> DataFrame:
    """Keep every column and add ``decoded``, the bytes of the ids (null ids: empty)."""
    path, pat = default_vocabulary()
    path, pat = ranks_path or path, pattern or pat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pat)
        for b in batches:
            raw = [bpe.decode(x or []) for x in b.column(ids).to_pylist()]
            yield _with_columns(b, {"decoded": pa.array(raw, pa.binary())})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded"]
    return encoded.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def token_digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encode, decode the
    ids again and digest both, batch by batch; the ids are returned only if asked for.
    Null and empty texts have no tokens; repeated rows are encoded one by one.
    """
    path, pat = default_vocabulary()
    path, pat = ranks_path or path, pattern or pat
    names_out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pat)
        names = bpe.names
        for b in batches:
            n, one, two, every = [], [], [], []
            for x in b.column("text"):
                ids = bpe.encode(x.as_py())
                n.append(len(ids))
                one.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                two.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    every.append(pa.array(ids, pa.int32()))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            if with_ids:
                ends = pa.array(list(itertools.accumulate(n, initial=0)), pa.int32())
                cols.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(every) if every else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names_out)
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)
