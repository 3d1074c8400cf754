"""Chunks, character BM25, and span-level evaluation."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import nsmallest
from itertools import islice
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corvine.functions import text as t
from corvine.functions.points import letters, numbered
from corvine.session import materialize

BUDGET = 480
#: Questions are scored in blocks, so that the matrix of a block is bounded.
QUESTIONS = 512
#: Terms that a task counts before it sends them on.
TERMS = 1 << 18
#: Chunks, and cells of a matrix of chunks by terms, that a worker looks at in one step.
BATCH, CELLS = 2048, 1 << 21
#: Pairs of letters are looked up in a table of up to so many entries.
PAIRS = 1 << 22
#: A pair of code points is a number from here on.
PAIR = 1 << 21


def chunks(docs: DataFrame, size: int = 160, stride: int = 160) -> DataFrame:
    """chunk_id, doc_id, start, end, text: no further chunk once one reaches the end of
    the text; an empty text has none."""
    if not 0 < stride <= size:
        raise ValueError("need 0 < stride <= size")
    # A text is cut once from its start into pieces, of which chunks consist, so that no
    # chunk counts characters from the start of the text again.
    g = gcd(size, stride)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{g}}}"), F.lit(0))
    if stride < size:
        last = F.ceil(F.greatest(F.length("text") - size, F.lit(0)) / stride).cast("int")
        join = lambda x: F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(x, i * (stride // g) + 1, size // g), ""))
        pieces = F.get(F.transform(F.array(pieces), join), F.lit(0))
    d = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(pieces).alias("at", "text"))
    d = d.select("doc_id", (F.col("at") * stride).alias("start"), (F.col("at") * stride + F.length("text")).alias("end"), "text")
    return d.select(F.sha2(F.concat(F.lit('["'), "doc_id", F.lit('",'), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit("]")), 256).alias("chunk_id"), "doc_id", "start", "end", "text")


def starts(docs: DataFrame, size: int = 160, stride: int = 160) -> DataFrame:
    """doc_id, at: a row for each chunk of ``chunks``, without its text."""
    last = F.ceil(F.greatest(F.length("text") - size, F.lit(0)) / stride)
    return docs.where(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))


def normal_chunks(rows: DataFrame) -> DataFrame:
    """chunk_id, normal, dl (the number of tokens); normalised chunk by chunk."""
    r = rows.select("chunk_id", t.normal_text("text").alias("normal"))
    return r.withColumn("dl", F.greatest(2 * F.length("normal") - 1, F.lit(0)))


def term_statistics(normal: DataFrame) -> DataFrame:
    """term, cf (occurrences), df (chunks with it): counted where the chunks are, so a
    task sends a row for each of its terms and not one for each token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cf, df = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            terms = [chr(g) if g < PAIR else chr(g // PAIR - 1) + chr(g % PAIR) for g in cf]
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([*cf.values()], pa.int64()), pa.array([df[g] for g in cf], pa.int64())], names=["term", "cf", "df"])
            cf.clear()
            df.clear()
            return out

        for part in _slices(batches, BATCH):
            at, row = letters(part.column("normal"), normal=True)
            one = at.astype(np.int64)
            two = (PAIR * (one[:-1] + 1) + one[1:])[row[:-1] == row[1:]]
            # A term and its chunk in one number, so that equal ones stand together.
            key = np.sort(np.concatenate([one, two]) * BATCH + np.concatenate([row, row[:-1][row[:-1] == row[1:]]]))
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            term = key[start] // BATCH
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
            grams = term[first].tolist()
            for g, c, d in zip(grams, np.diff(np.r_[start[first], len(key)]).tolist(), np.diff(np.r_[first, len(term)]).tolist(), strict=True):
                cf[g] += c
                df[g] += d
            if len(cf) >= TERMS:
                yield rows()
        yield rows()

    some = normal.select("normal").where(F.length("normal") > 0).mapInArrow(count, "term string, cf long, df long")
    return some.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def collection(normal: DataFrame) -> DataFrame:
    return normal.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def _tokens(s: str) -> list[str]:
    return [*s, *(s[i : i + 2] for i in range(len(s) - 1))]


def search(rows: DataFrame, questions: DataFrame, k: int = 3, k1: float = 1.2, b: float = 0.75, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, rank, chunk_id, score: BM25 of each question (id, question) over all chunks,
    by rounded score, then chunk_id. Questions without letters or digits get no rows.
    The columns ``carry`` of a hit's chunk follow, so that no join has to find it again.

    Question by block: the chunks are read once for the numbers that weights need and
    once to be scored; no chunk's terms are written or sent anywhere.
    """
    _check_k(k)

    def score(block: list) -> DataFrame:
        terms = Terms(block)
        df, n, avgdl = terms.statistics(rows, "text", False)
        return terms.best(rows, "text", False, df, n, avgdl, k, k1, b, carry)

    return _ranked(rows, [score(block) for block in _blocks(_asked(questions))], k, carry)


class Terms:
    """The terms of a block of questions, and how often chunks have them: letters are
    numbered, and pairs of them looked up by both numbers at once, for a batch of chunks
    without a step for each character in Python."""

    def __init__(self, block: list):
        self.block = block
        self.words = sorted(set().union(*[_tokens(r["normal"]) for r in block]))
        self.vocab = {w: i for i, w in enumerate(self.words)}

    def statistics(self, rows: DataFrame, column: str, normal: bool) -> tuple[np.ndarray, int, float]:
        """How many chunks have each term; the number of chunks, and of tokens in one."""
        lookup = Lookup(self.words)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(lookup.words), np.int64)
            n = tokens = 0
            for part in _slices(batches, lookup.rows()):
                tf, length = lookup.frequencies(part.column(0), normal)
                seen += np.count_nonzero(tf, axis=0)
                n, tokens = n + part.num_rows, tokens + int(length.sum())
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[n, tokens, seen[at]])], names=["term", "df"])

        got = rows.select(column).mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        df, of = np.zeros(len(self.words)), {r["term"]: r["df"] for r in got}  # at most the block's terms
        n, tokens = of.pop(-2, 0), of.pop(-1, 0)
        df[[*of]] = [*of.values()]
        return df, n, tokens / n if n else 0.0

    def best(self, rows: DataFrame, column: str, normal: bool, df: np.ndarray, n: int, avgdl: float, k: int, k1: float, b: float, carry: tuple[str, ...] = ()) -> DataFrame:
        """id, score, chunk_id and the columns ``carry`` of the k best chunks that a task
        has for each question."""
        lookup = Lookup(self.words)
        weights = _weights(self.block, self.vocab, np.log1p((n - df + 0.5) / (df + 0.5)), k1)
        ids = [r["id"] for r in self.block]

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = Top(ids, weights, k, schema)
            for part in _slices(batches, lookup.rows()) if k else ():
                tf, length = lookup.frequencies(part.column(0), normal)
                top.add(tf, k1 * (1 - b + b * length / max(avgdl, 1)), part.select(range(1, part.num_columns)))
            yield from top.rows()

        schema, chunk = to_arrow_schema(_hits(rows, carry)), ["chunk_id", *carry]
        return rows.select(F.col(column).alias("_text"), *chunk).mapInArrow(find, _hits(rows, carry))


class Lookup:
    """Numbers of the terms in a batch of chunks."""

    def __init__(self, words: list[str]):
        self.words = words
        self.known = sorted({ord(c) for w in words for c in w})
        self.base = len(self.known) + 1
        number = {c: i + 1 for i, c in enumerate(self.known)}
        self.one = np.full(self.base, len(words), np.int32)
        pairs = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                self.one[number[ord(w)]] = i
            else:
                pairs[number[ord(w[0])] * self.base + number[ord(w[1])]] = i
        self.keys = np.array([-1, *sorted(pairs)], np.int64)
        self.ids = np.array([len(words), *[pairs[x] for x in sorted(pairs)]], np.int32)
        self.tables = None

    def rows(self) -> int:
        """Chunks to look at in one step, so that their matrix is bounded."""
        return max(16, min(BATCH, CELLS // max(len(self.words), 1)))

    def _made(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Letters by code point, of normal forms and of texts, and pairs by both numbers,
        made where they are used: the latter is a table up to PAIRS entries, or else they
        are searched."""
        if self.tables is None:
            two = None
            if self.base**2 <= PAIRS:
                two = np.full(self.base**2, len(self.words), np.int32)
                two[self.keys[1:]] = self.ids[1:]
            self.tables = *numbered(self.known), two
        return self.tables

    def frequencies(self, column: pa.Array, normal: bool) -> tuple[np.ndarray, np.ndarray]:
        """How often each string has each term, and its number of tokens."""
        plain, fold, two = self._made()
        c, row = letters(column, normal, (plain, fold))
        size = np.bincount(row, minlength=len(column))
        if two is not None:
            pair = two.take(c[:-1] * np.int32(self.base) + c[1:])
        else:
            key = c[:-1].astype(np.int64) * self.base + c[1:]
            place = np.searchsorted(self.keys, key, side="right") - 1
            pair = np.where(self.keys[place] == key, self.ids[place], len(self.words))
        last = np.cumsum(size)[:-1] - 1  # of a string: its pair with the next one's first
        pair[last[(last >= 0) & (last < len(pair))]] = len(self.words)
        width = len(self.words) + 1  # the last column is what is no term
        at = row.astype(np.int64) * width
        tf = np.bincount(np.concatenate([at + self.one.take(c), at[:-1] + pair]), minlength=len(column) * width)
        return tf.reshape(len(column), width)[:, :-1], np.maximum(2 * size - 1, 0)


class Top:
    """The k best chunks so far of each question, by rounded score, then chunk_id.

    A product in single precision, with a bound of its error, tells which few chunks of a
    batch may be among them; those are scored in double precision, each by itself, so
    that equal chunks have equal scores.
    """

    def __init__(self, ids: list[str], weights: np.ndarray, k: int, schema: pa.Schema):
        self.ids, self.k, self.schema = ids, k, schema
        self.single = np.ascontiguousarray(weights.T, np.float32)
        self.terms = [np.flatnonzero(w) for w in weights.T]
        self.weights = [w[t] for w, t in zip(weights.T, self.terms, strict=True)]
        self.error = (len(weights) + 8) * 2.0**-23
        self.held: list[list[tuple]] = [[] for _ in ids]  # (-score, chunk_id, ...), best first
        self.least = np.full(len(ids), -np.inf)

    def add(self, tf: np.ndarray, norm: np.ndarray, chunks: pa.RecordBatch) -> None:
        """Chunks by their terms' frequencies and by what is added to those below."""
        single = tf.astype(np.float32)
        single /= single + np.maximum(norm, 1e-30).astype(np.float32)[:, None]
        rough = self.single @ single.T
        low = self.least.copy()
        new = np.flatnonzero(np.isinf(low))
        if len(new) and len(tf) > self.k:
            low[new] = np.partition(rough[new], len(tf) - self.k, axis=1)[:, len(tf) - self.k] * (1 - self.error)
        low = ((low - 2e-9) / (1 + self.error)).astype(np.float32)
        # All weights are positive, so only a chunk without a common term scores 0.
        low = np.nextafter(np.maximum(low, 0), np.where(low > 0, np.float32(0), np.float32(1)))
        for q in np.flatnonzero(rough.max(axis=1) >= low):
            r = np.flatnonzero(rough[q] >= low[q])
            for r in np.array_split(r, len(r) // BATCH + 1):
                f = tf[np.ix_(r, self.terms[q])].astype(np.float64)
                s = np.round((f / (f + np.maximum(norm[r], 1e-300)[:, None]) * self.weights[q]).sum(axis=1), 9)
                r, s = r[s >= self.least[q]], s[s >= self.least[q]]
                if len(r):
                    best = [*self.held[q], *zip((-s).tolist(), *[c.take(pa.array(r)).to_pylist() for c in chunks.columns], strict=True)]
                    self.held[q] = nsmallest(self.k, best, key=lambda x: x[:2])
                    if len(self.held[q]) == self.k:
                        self.least[q] = -self.held[q][-1][0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        found = [(i, -s, *chunk) for i, held in zip(self.ids, self.held, strict=True) for s, *chunk in held]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), self.schema, strict=True)], schema=self.schema)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("id").cast("string"), t.normal_text("question").alias("normal")).where(F.length("normal") > 0)


def _blocks(asked: DataFrame) -> Iterator[list]:
    """The questions, at most QUESTIONS of them on the driver at once."""
    rows = asked.toLocalIterator()
    while block := list(islice(rows, QUESTIONS)):
        yield block


def _weights(block: list, vocab: dict[str, int], rare: np.ndarray, k1: float) -> np.ndarray:
    """Terms by questions: occurrences in the question times the term's weight."""
    out = np.zeros((len(vocab), len(block)))
    for q, r in enumerate(block):
        for w, m in Counter(_tokens(r["normal"])).items():
            out[vocab[w], q] = m * rare[vocab[w]] * (k1 + 1)
    return out


def _check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("k must be an integer of at least 0")


def _hits(rows: DataFrame, carry: tuple[str, ...]) -> StructType:
    return StructType([StructField("id", StringType()), StructField("score", DoubleType()), *rows.select("chunk_id", *carry).schema])


def _ranked(rows: DataFrame, blocks: list[DataFrame], k: int, carry: tuple[str, ...] = ()) -> DataFrame:
    out = reduce(DataFrame.unionByName, blocks) if blocks else rows.sparkSession.createDataFrame([], _hits(rows, carry))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", *carry)


class PreparedIndex:
    """An index that is built once and searched often; its hits are those of ``search``.

    Written are each chunk's normal form, and the number of chunks of each term. A search
    reads the first table once for a block of questions, without normalising any text,
    and of the second one the block's terms.
    """

    def __init__(self, rows: DataFrame, k1: float = 1.2, b: float = 0.75):
        self.chunks = materialize(normal_chunks(rows), "normal")
        self.k1, self.b = k1, b
        self.n, self.avgdl = self.chunks.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        self.terms = materialize(term_statistics(self.chunks).select("term", "df"), "terms")

    def search(self, questions: DataFrame, k: int = 3) -> DataFrame:
        _check_k(k)
        return _ranked(self.chunks, [self._score(block, k) for block in _blocks(_asked(questions))], k)

    def _score(self, block: list, k: int) -> DataFrame:
        terms = Terms(block)
        df = np.zeros(len(terms.words))
        asked = self.terms.sparkSession.createDataFrame(pd.DataFrame({"term": terms.words}))
        for r in self.terms.join(asked, "term").collect():  # at most the block's terms
            df[terms.vocab[r["term"]]] = r["df"]
        return terms.best(self.chunks, "normal", True, df, self.n, self.avgdl, k, self.k1, self.b)


def predictions(hits: DataFrame, rows: DataFrame, gold: DataFrame) -> DataFrame:
    """id, document_hit, span_hit, reciprocal_rank, oracle_span, failure, returned_chars
    of each question of ``gold`` (id, doc_id, answers: array of start, text). Where hits
    carry doc_id, start and end, only the chunks of gold's documents are needed."""
    holds = lambda d, s, e: (F.col("doc_id") == F.col(d)) & F.exists("answers", lambda a: (F.col(s) <= a["start"]) & (F.col(e) >= a["start"] + F.length(a["text"])))
    place = F.col("doc_id").alias("hit_doc"), F.col("start").alias("hs"), F.col("end").alias("he")
    found = hits.select("id", "rank", *place) if {"doc_id", "start", "end"} <= {*hits.columns} else hits.join(rows.select("chunk_id", *place), "chunk_id")
    got = gold.select("id", "doc_id", "answers").join(found, "id", "left").groupBy("id").agg(
        F.coalesce(F.max((F.col("hit_doc") == F.col("doc_id")).cast("long")), F.lit(0)).alias("document_hit"),
        F.coalesce(F.max(holds("hit_doc", "hs", "he").cast("long")), F.lit(0)).alias("span_hit"),
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("hit_doc") == F.col("doc_id"), F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.sum(F.col("he") - F.col("hs")), F.lit(0)).cast("long").alias("returned_chars"),
    )
    own = rows.select(F.col("doc_id").alias("cd"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    oracle = gold.select("id", "doc_id", "answers").join(own, F.col("doc_id") == F.col("cd")).groupBy("id").agg(F.max(holds("cd", "cs", "ce").cast("long")).alias("oracle_span"))
    p = got.join(oracle, "id", "left").withColumn("oracle_span", F.coalesce("oracle_span", F.lit(0)).cast("long"))
    failure = F.when(F.col("span_hit") == 1, "success").when(F.col("oracle_span") == 0, "chunk_boundary_or_answer_too_long").when(F.col("document_hit") == 0, "source_not_retrieved").otherwise("wrong_chunk_from_source")
    return p.withColumn("failure", failure)


def check_budget(predicted: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The same rows; running the plan fails where more characters are returned."""
    over = F.when(F.col("returned_chars") > budget, F.raise_error(F.lit("retrieval character budget exceeded")).cast("long")).otherwise(F.col("returned_chars"))
    return predicted.withColumn("returned_chars", over)


def metrics(predicted: DataFrame) -> DataFrame:
    """One row; rates are null where there are no predictions."""
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.avg("document_hit").alias("document_recall_at3"), F.avg("span_hit").alias("span_hit_at3"), F.avg("reciprocal_rank").alias("mrr_at3"), F.avg("oracle_span").alias("oracle_span_coverage"))


def latency(rows: DataFrame, value: str) -> DataFrame:
    """Median and nearest-rank 95th percentile."""
    return rows.agg(F.median(value).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").cast("double").alias("p95"))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, kind (fix or regression); fails unless both sides have the same ids."""
    j = before.select("id", F.col("span_hit").alias("x")).join(after.select("id", F.col("span_hit").alias("y")), "id", "full_outer")
    same = F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("unmatched ids")).cast("long")).otherwise(F.col("y") - F.col("x"))
    return j.withColumn("d", same).where(F.col("d") != 0).select("id", F.when(F.col("d") > 0, "fix").otherwise("regression").alias("kind"))


def gate(base: DataFrame, candidate: DataFrame, base_chunks: DataFrame, candidate_chunks: DataFrame) -> DataFrame:
    """One row: the candidate's gains, and whether it is adopted."""
    m = base.select(F.col("span_hit_at3").alias("s0"), F.col("document_recall_at3").alias("r0")).crossJoin(candidate.select(F.col("span_hit_at3").alias("s1"), F.col("document_recall_at3").alias("r1")))
    c = base_chunks.agg(F.count(F.lit(1)).alias("c0")).crossJoin(candidate_chunks.agg(F.count(F.lit(1)).alias("c1")))
    g = m.crossJoin(c).select((F.col("s1") - F.col("s0")).alias("span_gain"), (F.col("r0") - F.col("r1")).alias("recall_drop"), (F.col("c1") / F.col("c0")).alias("chunk_ratio"))
    return g.withColumn("adopted", (F.col("span_gain") >= 0.02 - 1e-12) & (F.col("recall_drop") <= 0.01 + 1e-12) & (F.col("chunk_ratio") <= 1.8))
