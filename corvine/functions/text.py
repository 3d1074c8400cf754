"""Column functions over text: canonical JSON digests, normal forms, tokens, shingles.

Only Unicode normalisation and case folding leave the JVM (Arrow batches); everything
else is built in, by code points.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from corvine.functions.shingles import simhash_all

# Patterns that a result must agree on. Java's classes are ASCII by
# default, so Unicode's word characters, digits and white space are spelled out.
SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x85]"
EMAIL = r"(?<![\p{L}\p{N}_.])[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
PHONE = r"(?<!\p{Nd})(?:\+86[- ]?)?1[3-9]\p{Nd}{9}(?!\p{Nd})"
#: What stands in every text that EMAIL or PHONE matches, and is quicker to look for.
IN_EMAIL, IN_PHONE = "@", r"1[3-9]\p{Nd}{9}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_string(c: str | Column) -> Column:
    """A string as JSON, non-ASCII characters kept."""
    s = F.to_json(F.array(_col(c)))
    return F.substring(s, 2, F.length(s) - 2)


def digest(c: str | Column) -> Column:
    """SHA-256 of the canonical JSON of a string."""
    return F.sha2(json_string(c), 256)


def record_digest(*names: str) -> Column:
    """SHA-256 of the canonical JSON of an object: sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"}), 256)


def is_blank(c: str | Column) -> Column:
    return ~_col(c).rlike(SPACE.replace("[", "[^", 1))


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """NFC, then case folding."""
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t).casefold())


@F.pandas_udf(StringType())
def normal_text(s: pd.Series) -> pd.Series:
    """NFC, letters and digits only, each case-folded."""
    return s.map(lambda t: t if t is None else "".join([c.casefold() for c in unicodedata.normalize("NFC", t) if c.isalnum()]))


def title_key(c: str | Column) -> Column:
    return F.regexp_replace(fold(_col(c)), SPACE, "")


def grams(c: str | Column, n: int) -> Column:
    """All n-grams of code points, in order; none if the text is shorter.

    The text is cut into code points once, as the only item of an outer array, so that
    the inner lambda reads places of a finished array and not of a string.
    """
    one = F.array(F.regexp_extract_all(_col(c), F.lit("(?s)."), F.lit(0)))
    none = F.array().cast("array<string>")
    whole = lambda x: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*[F.get(x, i + j) for j in range(n)]))).otherwise(none)
    return F.get(F.transform(one, whole), F.lit(0))


def tokens(normal: str | Column) -> Column:
    """Characters, then character pairs, of a normalised text."""
    return F.concat(grams(normal, 1), grams(normal, 2))


def shingles(c: str | Column, n: int = 5) -> Column:
    """Distinct n-grams of the raw text; a shorter text is its own only shingle."""
    s = _col(c)
    return F.when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(grams(s, n)))


def _simhash(text: str | None, kind: str) -> int | None:
    if text is None:
        return None
    parts = {text} if len(text) < 5 else {text[i : i + 5] for i in range(len(text) - 4)}
    if kind == "blake2b":
        raw = b"".join([hashlib.blake2b(p.encode(), digest_size=8).digest() for p in parts])
    else:
        raw = b"".join([hashlib.sha256(p.encode()).digest()[:8] for p in parts])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * bits.sum(0, dtype=np.int64) >= len(parts)
    return int(np.packbits(votes).view(">i8")[0])


def _simhashes(s: pd.Series, kind: str) -> pd.Series:
    return pd.Series(simhash_all(pa.array(s, pa.string(), from_pandas=True), kind, lambda t: _simhash(t, kind)), dtype="Int64")


@F.pandas_udf(LongType())
def simhash(s: pd.Series) -> pd.Series:
    """64 votes over the distinct shingles' BLAKE2b hashes; a tie sets the bit."""
    return _simhashes(s, "blake2b")


@F.pandas_udf(LongType())
def simhash_sha(s: pd.Series) -> pd.Series:
    """The same over the first 64 bits of SHA-256, which SQL engines have."""
    return _simhashes(s, "sha256")


def register(spark) -> None:
    """Make the functions that SQL lacks available to ``spark.sql``."""
    for name, f in (("fold_text", fold), ("normal_text", normal_text), ("simhash64", simhash)):
        spark.udf.register(name, f)
