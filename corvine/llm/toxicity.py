"""Toxic spans by a linear-chain conditional random field, and scores of documents.

Token labels come from the labelled documents: words that occur in far more toxic than
clean training documents are toxic tokens of the toxic ones. A two-state chain with
hashed word, prefix, suffix and neighbour features is trained on them; forward-backward
marginals of every token of a whole text are aggregated to a score, calibrated on
training documents that the chain was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.labelled import held_out, sample_ids, training_labels
from corvine.llm.workers import give_back

#: Bounds of the training sample, by class: documents, and characters of their texts.
#: The shortest texts are taken first where all would be more.
SAMPLE_PER_CLASS = 2000
SAMPLE_CHARS = 1 << 25
TABLE_BITS = 18
BLOCK = 32
THRESHOLD = 0.7
#: Documents are tagged in groups of about so many bytes, which bounds a task's memory
#: (a single longer text is tagged alone).
GROUP_BYTES = 1 << 19

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("'")]] = True
_WORD[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.concatenate([[1], np.full(255, 0x100000001B3)]).astype(np.uint64))
KINDS = 5


def _lower(text: str) -> bytes:
    """Lower case, one code point for each of the text, so that places in it are places
    in the text: the few letters that lower-case to several stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.encode("utf-8", "replace")


def token_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs of letters, digits and other scripts."""
    w = _WORD[raw]
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    if len(w) and w[0]:
        edge = np.concatenate([[0], edge])
    if len(w) and w[-1]:
        edge = np.concatenate([edge, [len(w)]])
    return edge[::2], edge[1::2]


def _hash(contrib: np.ndarray, base: np.ndarray, upto: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of the byte ranges whose running sums are given, as table indexes."""
    h = (contrib[upto] - contrib[base]) * _MIX + np.uint64(kind * 0x51_7C_C1B7_2722_0A95 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(29)
    h *= _MIX
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def featurize(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case UTF-8 texts: feature indexes (KINDS x tokens), word hashes, the
    number of tokens of each text, and each token's bounds in the joined bytes."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = token_bounds(raw)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    counts = np.diff(np.searchsorted(starts, at))
    n = len(starts)
    if not n:
        return np.zeros((KINDS, 0), np.int32), np.zeros(0, np.uint64), counts, starts, ends
    length = ends - starts
    # Bytes weighted by a power of their place in the token; running sums give any prefix.
    owner_start = np.zeros(len(raw), np.int64)
    owner_start[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(raw)) - np.cumsum(owner_start)
    contrib = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POW[np.minimum(place, 255)], dtype=np.uint64)])
    # Suffix bytes are weighted from the end.
    word = contrib[ends] - contrib[starts]
    idx = np.empty((KINDS, n), np.int32)
    idx[0] = _hash(contrib, starts, ends, 1)
    idx[1] = _hash(contrib, starts, starts + np.minimum(length, 5), 2)
    idx[2] = _hash(contrib, starts, starts + np.minimum(length, 8), 3)
    last = np.zeros(n, np.uint64)
    for k in range(4):
        p = ends - 1 - k
        last = last * np.uint64(257) + np.where(p >= starts, raw[np.maximum(p, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    zero = np.zeros(1, np.uint64)
    both = np.concatenate([zero, last])
    idx[3] = _hash(both, np.zeros(n, np.int64), np.arange(1, n + 1), 4)
    before = np.concatenate([zero, word[:-1]]) * np.uint64(3) + word
    first = np.cumsum(counts)[:-1]
    before[np.concatenate([[0], first[first < n]])] = 1
    idx[4] = _hash(np.concatenate([zero, before]), np.zeros(n, np.int64), np.arange(1, n + 1), 5)
    return idx, word, counts, starts, ends


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of these lengths: each token's slot in a (blocks, BLOCK) grid, the
    first block of each sequence, and the number of its blocks."""
    nb = -(-counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(nb)])
    start = np.concatenate([[0], np.cumsum(counts)])[:-1]
    slot = np.arange(counts.sum()) - np.repeat(start, counts) + np.repeat(first[:-1] * BLOCK, counts)
    return slot, first[:-1], nb


def forward_backward(odds: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 of every token, and the summed expected transitions (2 x 2).

    ``odds`` are exp(emission score of state 1 over state 0); every sequence starts
    after a token of state 0. Exact: products over blocks of tokens, then vectors from
    block to block, then vectors within all blocks at once, so the number of numpy
    calls follows the longest text's blocks and not its tokens.
    """
    slot, first, nb = _blocks(counts)
    total = int(nb.sum())
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    a = np.exp(trans)
    x = np.ones(total * BLOCK)
    x[slot] = odds
    real = np.zeros(total * BLOCK, bool)
    real[slot] = True
    x, real = x.reshape(total, BLOCK).T.copy(), real.reshape(total, BLOCK).T.copy()
    p00, p01, p10, p11 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for k in range(BLOCK):
        r, xk = real[k], x[k]
        m00, m01, m10, m11 = np.where(r, a[0, 0], 1), np.where(r, a[0, 1] * xk, 0), np.where(r, a[1, 0], 0), np.where(r, a[1, 1] * xk, 1)
        p00, p01 = p00 * m00 + p01 * m10, p00 * m01 + p01 * m11
        p10, p11 = p10 * m00 + p11 * m10, p10 * m01 + p11 * m11
        if k % 4 == 3:
            s = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
            p00, p01, p10, p11 = p00 / s, p01 / s, p10 / s, p11 / s
    # From block to block, all sequences that are long enough in step.
    order = np.argsort(-nb, kind="stable")
    order = order[nb[order] > 0]
    ordered = nb[order]
    f0, f1 = np.empty(total), np.empty(total)
    v0, v1 = np.ones(len(order)), np.zeros(len(order))
    for j in range(int(ordered[0])):
        live = np.searchsorted(-ordered, -j, side="left")
        b = first[order[:live]] + j
        v0, v1 = v0[:live], v1[:live]
        f0[b], f1[b] = v0, v1
        v0, v1 = v0 * p00[b] + v1 * p10[b], v0 * p01[b] + v1 * p11[b]
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
    b0, b1 = np.empty(total), np.empty(total)
    w0, w1 = np.ones(len(order)), np.ones(len(order))
    for j in range(int(ordered[0]) - 1, -1, -1):
        live = np.searchsorted(-ordered, -j, side="left")
        b = first[order[:live]] + j
        u0, u1 = w0[:live], w1[:live]
        b0[b], b1[b] = u0, u1
        u0, u1 = p00[b] * u0 + p01[b] * u1, p10[b] * u0 + p11[b] * u1
        s = u0 + u1
        w0[:live], w1[:live] = u0 / s, u1 / s
    al0, al1 = np.empty((BLOCK + 1, total)), np.empty((BLOCK + 1, total))
    al0[0], al1[0] = f0, f1
    for k in range(BLOCK):
        r, xk = real[k], x[k]
        n0, n1 = al0[k] * a[0, 0] + al1[k] * a[1, 0], (al0[k] * a[0, 1] + al1[k] * a[1, 1]) * xk
        s = n0 + n1
        al0[k + 1], al1[k + 1] = np.where(r, n0 / s, al0[k]), np.where(r, n1 / s, al1[k])
    marg = np.empty((BLOCK, total))
    pair = np.zeros((2, 2))
    for k in range(BLOCK - 1, -1, -1):
        r, xk = real[k], x[k]
        one = al1[k + 1] * b1
        marg[k] = one / (one + al0[k + 1] * b0)
        q00, q01 = al0[k] * a[0, 0] * b0, al0[k] * a[0, 1] * xk * b1
        q10, q11 = al1[k] * a[1, 0] * b0, al1[k] * a[1, 1] * xk * b1
        z = np.where(r, 1 / (q00 + q01 + q10 + q11), 0)
        pair += [[(q00 * z).sum(), (q01 * z).sum()], [(q10 * z).sum(), (q11 * z).sum()]]
        n0, n1 = a[0, 0] * b0 + a[0, 1] * xk * b1, a[1, 0] * b0 + a[1, 1] * xk * b1
        s = n0 + n1
        b0, b1 = np.where(r, n0 / s, b0), np.where(r, n1 / s, b1)
    return marg.T.reshape(-1)[slot], pair


@dataclass
class ToxicityModel:
    table: np.ndarray  # weights by feature
    bias: float
    trans: np.ndarray  # 2 x 2 scores
    calibration: np.ndarray  # weights over aggregate features
    base_rate: float

    def marginals(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        d = sum(self.table[i] for i in idx) + self.bias
        return forward_backward(np.exp(np.clip(d, -15, 15)), counts, self.trans)[0]

    def score(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.table.shape[0] == 1:
            return np.full(len(counts), self.base_rate)
        return 1 / (1 + np.exp(-np.clip(aggregates(p, counts) @ self.calibration, -30, 30)))


def aggregates(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text: 1, the largest marginal, the log of the expected number of toxic
    tokens and of its share."""
    n = len(counts)
    start = np.concatenate([[0], np.cumsum(counts)])[:-1]
    full = counts > 0
    top, total = np.zeros(n), np.zeros(n)
    if full.any():
        top[full] = np.maximum.reduceat(p, start[full])
        total[full] = np.add.reduceat(p, start[full])
    share = total / np.maximum(counts, 1)
    return np.stack([np.ones(n), top, np.log1p(total), np.log1p(100 * share)], 1)


def toxic_words(words: np.ndarray, counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted hashes of words with many more toxic than clean documents: the lower bound
    of the log odds, smoothed, above log 8."""
    of = [np.unique(w) for w in np.split(words, np.cumsum(counts)[:-1])]
    vocab, inv = np.unique(np.concatenate(of), return_inverse=True)
    hit = np.repeat(y, [len(w) for w in of])
    pos = np.bincount(inv, hit, len(vocab))
    neg = np.bincount(inv, 1 - hit, len(vocab))
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    gain = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1)) - 1.0 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return vocab[(pos >= 3) & (gain > np.log(8.0))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - pen * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-6)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, word hashes and token counts, group by group: featurizing needs some 40
    bytes for each byte of text."""
    parts = [featurize([_lower(t) for t in texts[i:j]])[:3] for i, j in _groups(texts)]
    if not parts:
        return featurize([])[:3]
    return np.concatenate([x[0] for x in parts], 1), np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])


def train(features: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, rate: float, rounds: int = 40) -> ToxicityModel:
    """Fit the chain on the rows of fold 0, which come first, and the calibration on
    those of fold 1; ``rate`` is the share of toxic documents among all labelled ones."""
    none = ToxicityModel(np.zeros(1, np.float32), 0.0, np.zeros((2, 2)), np.zeros(4), rate)
    if not len(y) or y.min() == y.max():
        return none
    idx, words, counts = features
    owner = np.repeat(np.arange(len(y)), counts)
    if not len(words):
        return none
    ci = counts[fold == 0]
    n = int(ci.sum())
    lex = toxic_words(words[:n], ci, y[fold == 0].astype(float))
    if not len(lex):
        lex = toxic_words(words, counts, y.astype(float))
    label = np.isin(words, lex) & (y[owner] == 1)
    feats, tags = idx[:, :n], label[:n].astype(float)
    size = 1 << TABLE_BITS
    start = np.concatenate([[0], np.cumsum(ci)])
    gold = np.zeros((2, 2))
    previous = np.concatenate([[0], tags[:-1]]).astype(int)
    edge = np.concatenate([[0], np.cumsum(ci)[:-1]])
    previous[edge[edge < len(previous)]] = 0
    np.add.at(gold, (previous, tags.astype(int)), 1)
    # Only features that occur with a toxic token can tell it; the others stay at 0.
    theta, trans, bias = np.zeros(size), np.zeros((2, 2)), -4.0
    known = np.zeros(size, bool)
    known[feats[:, tags > 0].ravel()] = True
    gt, ga, gb = np.full(size, 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(rounds):
        miss, pair = np.empty(n), np.zeros((2, 2))
        for i in range(0, len(ci), 400):  # a few documents at a time bound the memory
            a, b = start[i], start[min(i + 400, len(ci))]
            d = sum(theta[feats[k, a:b]] for k in range(KINDS)) + bias
            p, q = forward_backward(np.exp(np.clip(d, -15, 15)), ci[i : i + 400], trans)
            miss[a:b] = tags[a:b] - p
            pair += q
        g = sum(np.bincount(feats[k], miss, size) for k in range(KINDS))
        g = np.where(known, g - 0.1 * theta, 0)
        gt += g * g
        theta += 0.8 * g / np.sqrt(gt)
        t = gold - pair - 0.1 * trans
        t[0] -= t[0].mean()
        t[1] -= t[1].mean()
        ga += t * t
        trans += 0.5 * t / np.sqrt(ga)
        b = miss.sum() - 0.1 * bias
        gb += b * b
        bias += 0.8 * b / np.sqrt(gb)
    model = ToxicityModel(theta.astype(np.float32), float(bias), trans, np.zeros(4), rate)
    rest = fold == 1
    if not (rest.any() and y[rest].min() != y[rest].max()):
        rest = np.ones(len(y), bool)
    ends = np.concatenate([[0], np.cumsum(counts)])
    x = []
    for i in range(0, len(counts), 400):
        n = counts[i : i + 400]
        x.append(aggregates(model.marginals(idx[:, ends[i] : ends[i + len(n)]], n), n))
    x = np.concatenate(x)[rest]
    yr = y[rest].astype(float)
    share = max(yr.mean(), 1e-9)
    weight = np.where(yr > 0, rate / share, (1 - rate) / max(1 - share, 1e-9))
    model.calibration = _logistic(x, yr, weight)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, label: str = "toxic") -> ToxicityModel:
    """Train on a bounded sample: of either class at most ``per_class`` labelled
    documents and SAMPLE_CHARS characters, whole texts, collected to the driver. The
    share of toxic labels is taken from all of them."""
    known = training_labels(labels, label)
    ids = sample_ids(known, per_class)
    # At most 2 * per_class rows of 12 bytes: a proven bound.
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.col("text").isNotNull())
    # One text for each id, however often its rows repeat.
    got = got.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text").cast("long")).over(Window.partitionBy("y").orderBy(F.length("text"), "doc_id"))
    got = got.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).drop("upto").toArrow()
    seen = known.agg(F.avg("y")).first()[0]
    ids_of = got["doc_id"].to_numpy()
    fold = ((ids_of * 2654435761 >> 7) % 10 < 3).astype(int)
    texts = got["text"]
    order = sorted(range(len(ids_of)), key=lambda i: (fold[i], ids_of[i]))  # ids come once
    y, fold = got["y"].to_numpy()[order], fold[order]
    features = training_features([texts[i].as_py() for i in order])
    del got, texts
    return train(features, y, fold, 0.5 if seen is None else float(seen))


def _runs(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    at, end, held = 0, 0, 0
    for n in sizes:
        end, held = end + 1, held + n
        if held >= GROUP_BYTES:
            yield at, end
            at, held = end, 0
    if at < end:
        yield at, end


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    return _runs(len(t or "") for t in texts)


Span = tuple[int, int, float]


def judge(model: ToxicityModel, texts: list[str | None], least: float = 0.5) -> tuple[np.ndarray, list[list[Span]]]:
    """Of each text its score, and (start, end, marginal) in code points of its tokens
    that are at least so likely toxic, neighbouring ones joined."""
    score, spans = np.zeros(len(texts)), [[] for _ in texts]
    for i, j in _groups(texts):
        raw = [_lower(t or "") for t in texts[i:j]]
        idx, _, counts, starts, ends = featurize(raw)
        if model.table.shape[0] == 1:
            score[i:j] = model.score(np.zeros(idx.shape[1]), counts)
            continue
        p = model.marginals(idx, counts)
        score[i:j] = model.score(p, counts)
        hits = np.flatnonzero(p >= least)
        if not len(hits):
            continue
        # Code points before each byte of the joined texts.
        points = np.concatenate([[0], np.cumsum((np.frombuffer(b"\n".join(raw), np.uint8) & 0xC0) != 0x80)])
        first = points[np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw[:-1]])]).astype(np.int64)]
        owner = np.repeat(np.arange(len(raw)), counts)[hits]
        a, b = points[starts[hits]] - first[owner], points[ends[hits]] - first[owner]
        new = np.concatenate([[True], (np.diff(hits) > 1) | (np.diff(owner) > 0)])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(hits)]]) - 1
        for k, (x, y, top) in enumerate(zip(a[at].tolist(), b[last].tolist(), np.maximum.reduceat(p[hits], at).tolist(), strict=True)):
            spans[i + owner[at[k]]].append((x, y, top))
    return score, spans


def toxic_spans(model: ToxicityModel, text: str, least: float = 0.5) -> list[Span]:
    return judge(model, [text], least)[1][0]


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", spans: bool = False) -> DataFrame:
    """Keep every column and add score, predicted and, if asked, toxic_spans (an array
    of start, end, marginal). Null and empty texts score as texts without tokens; rows
    are scored one by one, so repeated ones get equal scores; an empty table gives an
    empty result. A narrow map that sends texts to Python and only results back; columns
    named like results are replaced."""
    of_span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
    kind = "struct<score:double,predicted:int" + (",toxic_spans:array<struct<start:int,end:int,marginal:double>>>" if spans else ">")

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        score, found, sizes = np.zeros(len(texts)), [], pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        # Strings and arrays of one group at a time, not of the whole batch.
        for i, j in _runs(sizes):
            score[i:j], spanned = judge(model, texts.slice(i, j - i).to_pylist())
            found += spanned
        give_back()
        cols = {"score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}
        if spans:
            cols["toxic_spans"] = pa.array([[dict(zip(("start", "end", "marginal"), s, strict=True)) for s in x] for x in found], pa.list_(of_span))
        return pa.StructArray.from_arrays([*cols.values()], names=[*cols])

    new = ["score", "predicted", *(["toxic_spans"] if spans else [])]
    kept = [c for c in docs.columns if c not in new]
    own = [f"c{i}" for i in range(len(kept))]  # own names can't clash with the input's
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, own, strict=True)], run(F.col(f"`{text}`").cast("string")).alias("got"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, own, strict=True)], *[F.col(f"got.{c}").alias(c) for c in new])


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_spans of every row, by a model trained
    on ``labels``.

    Without labels of both classes every score is the labels' base rate (0.5 if there
    are none) and there are no spans. Repeated rows get equal scores; an empty table
    gives an empty result.
    """
    d = docs.select("doc_id", "text")
    scored = score_toxicity(d, fit_toxicity(d, labels), spans=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "toxic_spans")
