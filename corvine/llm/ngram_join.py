"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix
filters, each candidate pair verified once, and components of what links.

Texts with equal shingle sets are one node. A node's shingles are ordered rare first (by
a count sketch over all documents, then by hash); two sets that are similar enough share
one among the first few, the prefix. Nodes with a prefix shingle in common form a
bucket. A bucket's members are first compared with one leader, which joins families of
near copies in as many comparisons as they have members. Then members of different
components are compared, under the length and positional filters. Where that would be
over LIMIT others for each member, the bucket is refined: similar sets share not only
one but several shingles, each in a prefix that is one longer, so members meet by the
next shingle that they share, in smaller buckets with leaders of their own. That is done
where it halves the comparisons at least, DEPTH shingles deep at most. No pair that
links is lost, and none is formed that the components already hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.workers import give_back
from corvine.operators.components import join_labels
from corvine.operators.skew import spread_join
from corvine.session import materialize

#: Cells of the count sketch that orders shingles; its size doesn't grow with the data.
SKETCH_BITS = 18
#: Longs of the suffix filter's sketches, 64 cells each.
SKETCH_LONGS = 16
#: Buckets whose members would meet more members of other components, on average, are
#: refined by a further shingle if that pays, up to so many in all. Members are compared
#: in places of BLOCK members each.
LIMIT = 200
BLOCK = 1000
#: So often members of large buckets that are apart from the largest component are
#: compared with the most promising others before they are with all that may be similar.
TURNS = 2
DEPTH = 4
#: Rows of an Arrow batch of whole texts.
BATCH = 500
#: Ids are broadcast up to so many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_P, _A, _B = np.uint64(0x100000001B3), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_pow = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        p = np.full(max(n, 4096), _P)
        p[0] = 1
        _pow = np.cumprod(p, dtype=np.uint64)
    return _pow


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, A-Z lower-cased. A text
    of fewer words has its whole sequence as one, one without words has none."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = _FOLD[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    bound = np.searchsorted(starts, at)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(texts)
    length = ends - starts
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    contrib = (raw.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    contrib[~word] = 0
    h = _mix(np.add.reduceat(contrib, starts) + length.astype(np.uint64) * _A)
    m = len(h) - n + 1
    gram = np.zeros(max(m, 0), np.uint64)
    for k in range(n):
        gram = _mix(gram * _P + h[k : k + len(gram)] + np.uint64(k + 1))
    out = []
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            x = np.uint64((b - a) * 0x9E3779B9)
            for w in h[a:b]:
                x = _mix(np.array([x * _P + w]))[0]
            out.append(np.array([x]))
        else:
            out.append(none)
    return out


def _chunks(sizes: list[int], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingle sets of a column, some half a megabyte of text at a time."""
    with np.errstate(over="ignore"):
        for a, b in _chunks(pc.binary_length(texts).to_pylist()):
            yield from shingle_sets(texts.slice(a, b - a).to_pylist(), n)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _least_overlap(n: int, share: tuple[int, int]) -> int:
    """The least number of a set's shingles that any similar set must hold."""
    return -(-share[0] * n // share[1])


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Of each document its number of shingles and its set's key, and each task's
    occupied cells of the sketch (rows with a cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "set", "cell", "seen"]
        for b in batches:
            size, keys = [], []
            for s in _sets(b.column("text"), n):
                size.append(len(s))
                keys.append(_key(s))
                # Cells repeat seldom within one set.
                np.add.at(cells, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), *none], names=names)
        at = np.flatnonzero(cells)
        for i in range(0, len(at), 1 << 16):
            c = at[i : i + (1 << 16)]
            none = pa.nulls(len(c), pa.int64()), pa.nulls(len(c), pa.int64()), pa.nulls(len(c), pa.binary())
            yield pa.RecordBatch.from_arrays([*none, pa.array(c.astype(np.int32)), pa.array(cells[c])], names=names)
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, set binary, cell int, seen long")


def _levels(share: tuple[int, int]) -> int:
    """How many shingles two different sets that are similar share at least, up to DEPTH:
    with J >= p / q they share p / (q - p) or more."""
    p, q = share
    return max(1, min(DEPTH, p // (q - p))) if q > p else DEPTH


def _prefixes(docs: DataFrame, n: int, share: tuple[int, int], counts) -> DataFrame:
    """Of each document with words its longest prefix, rare first, and the
    sketch of its set: a bit for each cell, set if the cell holds an odd number. Sets
    whose sketches differ in d bits differ in d shingles at least."""
    more = _levels(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for b in batches:
            ids, keys, tokens, sketches = [], [], [], []
            for doc, s in zip(b.column("doc_id"), _sets(b.column("text"), n), strict=True):
                if len(s):
                    k = len(s) - _least_overlap(len(s), share) + more
                    order = np.lexsort((s, seen[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    ids.append(doc.as_py())
                    keys.append(_key(s))
                    tokens.append(s[order[:k]].view(np.int64))
                    odd = np.bincount((s & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "set", "tokens", "sketch"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, set binary, tokens array<long>, sketch array<long>")


class _Join:
    """One run of the join: the nodes, and what has been compared and linked so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, share: tuple[int, int]):
        self.docs, self.nodes, self.n, self.share = docs, nodes, n, share
        spark = docs.sparkSession
        # Not from a Python list: even an empty one starts Python workers of another kind
        # beside those of the join, which stay for a minute.
        none = spark.range(0)
        self.tested = none.select(F.col("id").alias("x"), F.col("id").alias("y"))
        self.labels = none.select(F.col("id").alias("node"), F.col("id").alias("label"))

    def texts(self, ids: DataFrame) -> DataFrame:
        """node, text of these nodes (column node), from the documents."""
        want = materialize(ids.distinct().join(self.nodes.select("node", "doc_id", "set"), "node").select("node", "doc_id", "set"), "wanted")
        keys = F.broadcast(want) if want.count() <= BROADCAST_IDS // 4 else want
        # A repeated doc_id may have several texts; verify() drops those of other sets.
        return materialize(self.docs.join(keys, "doc_id").select("node", "set", "text"), "texts")

    def with_texts(self, pairs: DataFrame) -> DataFrame:
        t = self.texts(pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))))
        return pairs.join(t.select(F.col("node").alias("x"), F.col("set").alias("sx"), F.col("text").alias("tx")), "x").join(t.select(F.col("node").alias("y"), F.col("set").alias("sy"), F.col("text").alias("ty")), "y")

    def verify(self, pairs: DataFrame) -> None:
        """Compare pairs (x, y) whose sketches, which stand for all of a set's suffix, allow
        it, by their exact sets."""
        p, q = self.share
        size = self.nodes.select("node", "n", "sketch")
        of = lambda k: size.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        apart = sum((F.bit_count(F.get("sx", F.lit(i)).bitwiseXOR(F.get("sy", F.lit(i)))) for i in range(1, SKETCH_LONGS)), F.bit_count(F.get("sx", F.lit(0)).bitwiseXOR(F.get("sy", F.lit(0)))))
        # |x ^ y| <= total * (q - p) / (q + p)
        left = pairs.join(of("x"), "x").join(of("y"), "y").where(apart * (p + q) <= (F.col("nx") + F.col("ny")) * (q - p))
        left = materialize(left.select("x", "y"), "pairs")
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a, c, ok = b.column("x").to_numpy(), b.column("y").to_numpy(), []
                for sx, sy, x, y in _pairs_of_sets(b, n):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(sx and sy and q * both >= p * (len(x) + len(y) - both))
                keep = np.array(ok, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep])], names=["a", "b"])
            give_back()

        new = materialize(self.with_texts(left).select("x", "y", "sx", "sy", "tx", "ty").mapInArrow(run, "a long, b long"), "links", BATCH)
        self.tested = self.tested.unionByName(left)
        self.link(new)

    def link(self, new: DataFrame) -> None:
        self.labels = join_labels(self.labels, new)

    def labelled(self, members: DataFrame) -> DataFrame:
        return members.drop("label").join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def live(self, members: DataFrame) -> DataFrame:
        """The members, labelled, of buckets with several components."""
        now = self.labelled(members)
        open_ = now.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("k")).where(F.col("a") != F.col("b"))
        open_ = materialize(open_.select("bucket", "k"), "live")
        total = open_.agg(F.sum("k")).first()[0] or 0
        return materialize(spread_join(now, open_, ["bucket"], "left_semi", "k", total, ["node"]), "members")

    def similar_sizes(self, a: str, b: str) -> Column:
        p, q = self.share
        return (F.col(a) * q >= F.col(b) * p) & (F.col(b) * q >= F.col(a) * p)

    def may_overlap(self, level: int) -> Column:
        """The positional filter. Where two members meet by the first ``level`` shingles
        that they share, the last at pos, they share at most what is left of the shorter
        rest besides; a similar pair passes there, whatever its other buckets say."""
        p, q = self.share
        left = F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy")) + (level - 1)
        return left * (p + q) >= (F.col("nx") + F.col("ny")) * p

    def leaders(self, members: DataFrame, level: int) -> DataFrame:
        """The members with a leader of their bucket (leader, leader_n, leader_label)."""
        # A family of near copies shares many buckets: large ones take the member that is
        # in most of them, so that the family is compared once.
        many = members.where(F.col("size") > LIMIT) if level == 1 else members
        hubs = materialize(many.groupBy("node").agg(F.count(F.lit(1)).alias("hub")), "hubs")
        each = many.join(hubs, "node").groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("hub", (-F.col("node")).alias("back"), "n")).alias("h"))
        each = materialize(each, "groups")
        if level > 1:  # the largest component had its leader: now the next one has
            top = each.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"))
            each = each.join(materialize(top, "top"), "bucket").where(F.col("label") != F.col("top.label"))
            best = F.max(F.struct("c", "h", "label"))
        else:
            best = F.max(F.struct("h", "label", "c"))
        led = materialize(each.groupBy("bucket").agg(best.alias("b")).select("bucket", (-F.col("b.h.back")).alias("l2"), F.col("b.h.n").alias("n2"), F.col("b.label").alias("b2")), "led")
        out = members.join(led, "bucket", "left")
        return out.withColumns({"leader": F.coalesce("l2", "head.node"), "leader_n": F.coalesce("n2", "head.n"), "leader_label": F.coalesce("b2", "head.node")}).drop("l2", "n2", "b2", "head")

    def compare(self, rows: DataFrame, level: int) -> DataFrame | None:
        """One level over buckets (bucket, node, n, pos): its members share ``level``
        shingles, the last one at pos. Returns the next level's buckets, if any."""
        last = level == _levels(self.share)
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("pos", "n", "node")).alias("head")).where(F.col("size") > 1)
        sizes = materialize(sizes, "sizes")
        total = sizes.agg(F.sum("size")).first()[0] or 0
        members = spread_join(rows, sizes, ["bucket"], "inner", "size", total, ["node"])
        members = materialize(self.labelled(members), "members")
        # A leader is compared with those members whose length allows it.
        star = self.leaders(members, level).where((F.col("label") != F.col("leader_label")) & self.similar_sizes("n", "leader_n"))
        star = star.select(F.least("node", "leader").alias("x"), F.greatest("node", "leader").alias("y")).distinct()
        self.verify(materialize(star.join(self.tested, ["x", "y"], "left_anti"), "star"))
        live = self.live(members.drop("head"))
        few, many = live.where(F.col("size") <= LIMIT), live.where(F.col("size") > LIMIT)
        nxt = None
        if many.limit(1).count():
            many = self.sized(many)
            for _ in range(TURNS):
                self.meet(self.across(many, level, nearest=True))
                many = self.sized(self.live(many.drop("size", "top", "cross")))
            if not last:
                many, nxt = self.refine(many, level)
            self.meet(self.pairs(few, level).unionByName(self.across(many, level)))
        else:
            self.meet(self.pairs(few, level))
        return nxt if nxt is not None and nxt.limit(1).count() else None

    def meet(self, pairs: DataFrame) -> None:
        pairs = materialize(pairs.distinct().join(self.tested, ["x", "y"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            self.verify(pairs)

    def sized(self, members: DataFrame) -> DataFrame:
        """The members of large buckets with the bucket's size, its largest component
        (top) and how many ordered pairs of members of different components it has."""
        each = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
        each = each.groupBy("bucket").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label"))["label"].alias("top"), F.sum(F.col("c") * F.col("c")).alias("same"))
        each = materialize(each.withColumn("cross", F.col("size") * F.col("size") - F.col("same")).drop("same"), "sized")
        total = each.agg(F.sum("size")).first()[0] or 0
        return materialize(spread_join(members.drop("size"), each, ["bucket"], "inner", "size", total, ["node"]), "members")

    def pairs(self, members: DataFrame, level: int) -> DataFrame:
        """Pairs of a bucket's members that may be similar and aren't linked yet. Of the
        shorter one (x) the place must be in the first half of its prefix."""
        p, q = self.share
        of = lambda k: members.select("bucket", F.col("node").alias(k), *(F.col(c).alias(c + k) for c in ("n", "pos", "label")))
        x = of("x").where((F.col("nx") - F.col("posx") + (level - 1)) * (p + q) >= F.col("nx") * (2 * p))
        found = x.join(of("y").hint("merge"), "bucket").where((F.struct("nx", "x") < F.struct("ny", "y")) & (F.col("labelx") != F.col("labely")) & self.similar_sizes("nx", "ny") & self.may_overlap(level))
        return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    def across(self, members: DataFrame, level: int, nearest: bool = False) -> DataFrame:
        """The same for large buckets: what isn't of the largest component meets all
        others, a BLOCK of the ones with a BLOCK of the others at a time, under the
        suffix filter too. With ``nearest`` only the most promising of a block is
        returned for each: one link joins a copy to its family, however many it has."""
        p, q = self.share
        rows = members.join(self.nodes.select("node", "sketch"), "node")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        cols = ["bucket", "node", "n", "pos", "label", "sketch"]
        x = rows.where(F.col("label") != F.col("top")).select(*cols, F.col("own").alias("u"), F.col("other").alias("v"))
        y = rows.select(*[F.col(c).alias(f"y_{c}") for c in cols], F.col("other").alias("y_u"), F.col("own").alias("y_v"))

        def run(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(xs) and len(ys):
                b, m, at, lab, ids = np.stack(ys["y_sketch"].to_numpy()), *(ys[f"y_{c}"].to_numpy() for c in ("n", "pos", "label", "node"))
                a, nx, px, lx, ix = np.stack(xs["sketch"].to_numpy()), *(xs[c].to_numpy() for c in ("n", "pos", "label", "node"))
                for i in range(len(xs)):
                    far = np.bitwise_count((a[i] ^ b).view(np.uint64)).sum(1, dtype=np.int64)  # of a negative number it counts the absolute's
                    rest = np.minimum(nx[i] - px[i], m - at) + (level - 1)
                    ok = (lab != lx[i]) & (far * (p + q) <= (nx[i] + m) * (q - p)) & (rest * (p + q) >= (nx[i] + m) * p) & (nx[i] * q >= m * p) & (m * q >= nx[i] * p)
                    hit = np.flatnonzero(ok)
                    if nearest and len(hit):
                        hit = hit[[np.lexsort((ids[hit], far[hit]))[0]]]
                    out.append(np.stack([np.minimum(ix[i], ids[hit]), np.maximum(ix[i], ids[hit])], 1))
            both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            return pd.DataFrame({"x": both[:, 0], "y": both[:, 1]})

        key = ["bucket", "u", "v"]
        return x.groupBy(*key).cogroup(y.groupBy(*(f"y_{k}" for k in key))).applyInPandas(run, "x long, y long")

    def refine(self, large: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Those large buckets that are to be compared as they are, and the next level's
        buckets of the others: their members by one more of the shingles that follow, in
        a prefix that is one longer."""
        p, q = self.share
        wide = large.where(F.col("cross") > F.col("size") * LIMIT)
        k = F.col("n") - F.ceil(F.col("n") * p / q) + 1
        tokens = self.nodes.select("node", "tokens").join(wide.select("node").distinct(), "node", "left_semi")
        rest = F.slice("tokens", F.col("pos") + 2, F.greatest(k + level - F.col("pos") - 1, F.lit(0)).cast("int"))
        nxt = wide.join(tokens, "node").select("bucket", "node", "n", "label", "pos", F.posexplode(rest).alias("i", "t"))
        nxt = materialize(nxt.select(F.col("bucket").alias("parent"), F.xxhash64("bucket", "t").alias("bucket"), "node", "n", (F.col("pos") + 1 + F.col("i")).cast("int").alias("pos"), "label"), "refined")
        each = nxt.groupBy("parent", "bucket", "label").agg(F.count(F.lit(1)).alias("c"))
        each = each.groupBy("parent", "bucket").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("same"))
        each = materialize(each.withColumn("less", F.col("k") * F.col("k") - F.col("same")).where(F.col("less") > 0), "several")
        sums = each.groupBy("parent").agg(F.sum("less").alias("less")).withColumnRenamed("parent", "bucket")
        # A bucket without any smaller ones holds no similar pair.
        pays = wide.select("bucket", "cross").distinct().join(sums, "bucket", "left").where(F.coalesce("less", F.lit(0)) * 2 <= F.col("cross"))
        pays = materialize(pays.select(F.col("bucket").alias("parent")), "pays")
        stay = large.join(pays.select(F.col("parent").alias("bucket")), "bucket", "left_anti")
        kept = materialize(each.join(pays, "parent", "left_semi").select("bucket", "k"), "kept")
        total = kept.agg(F.sum("k")).first()[0] or 0
        return stay, materialize(spread_join(nxt.select("bucket", "node", "n", "pos"), kept, ["bucket"], "left_semi", "k", total, ["node"]), "buckets")


def _pairs_of_sets(b: pa.RecordBatch, n: int) -> Iterator[tuple[bool, bool, np.ndarray, np.ndarray]]:
    """For each row (sx, sy, tx, ty) whether the texts are of the sets that are meant,
    and their shingles; a set that rows share is made once for a batch."""
    made: dict[bytes, tuple[bool, np.ndarray]] = {}

    def of(key: bytes, text: str | None) -> tuple[bool, np.ndarray]:
        if key in made and made[key][0]:
            return made[key]
        s = next(_sets(pa.array([text], pa.string()), n))
        made[key] = (_key(s) == key, s)
        return made[key]

    for kx, ky, tx, ty in zip(b.column("sx"), b.column("sy"), b.column("tx"), b.column("ty"), strict=True):
        (ox, x), (oy, y) = of(kx.as_py(), tx.as_py()), of(ky.as_py(), ty.as_py())
        yield ox, oy, x, y
        if len(made) > 500:
            made.clear()


def jaccard_components(docs: DataFrame, n: int = 3, share: tuple[int, int] = (90, 100), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Two texts link when share[1] * |intersection| >= share[0] * |union| of their word
    n-grams; component_id is the smallest doc_id reachable. A text without words (null,
    empty, white space) has no shingles and links with nothing, so its component is
    itself. Equal texts link whatever their number. Rows that repeat a doc_id belong to
    what each of their texts links. A row with a null doc_id links with nothing and has
    a null component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = materialize(_scan(d, n), "scan", BATCH)
    mine = scanned.where(F.col("cell").isNull()).select("doc_id", "n", "set")
    cells = scanned.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("seen").alias("seen")).toArrow()
    seen = np.zeros(1 << SKETCH_BITS, np.int64)
    seen[cells["cell"].to_numpy()] = cells["seen"].to_numpy()
    # 2 ** SKETCH_BITS counts, whatever the input.
    counts = spark.sparkContext.broadcast(np.minimum(seen, 2**31 - 1).astype(np.int32))
    usable = d.where(F.col("doc_id").isNotNull())
    sets = mine.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    prefixes = _prefixes(usable, n, share, counts).join(sets, ["doc_id", "set"])
    nodes = materialize(prefixes.select("node", "doc_id", "set", "n", "tokens", "sketch"), "nodes", BATCH)
    k = (F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1).cast("int")
    rows = nodes.select("node", "n", F.posexplode(F.slice("tokens", F.lit(1), k)).alias("pos", "bucket"))
    join = _Join(usable, nodes, n, share)
    todo, level = rows, 1
    while todo is not None:
        todo, level = join.compare(todo, level), level + 1
    # Rows that repeat a doc_id tie what their texts link.
    repeated = mine.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("b"), F.count_distinct("set").alias("k")).where(F.col("k") > 1)
    if repeated.limit(1).count():
        several = mine.join(repeated.select("doc_id"), "doc_id").join(sets.select("set", "node"), "set").select("doc_id", "node")
        first = several.groupBy("doc_id").agg(F.min("node").alias("b"))
        join.link(materialize(several.join(first, "doc_id").select(F.col("node").alias("a"), "b"), "links"))
    labels = sets.join(join.labels, "node", "left").select("set", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = materialize(labels.join(materialize(smallest, "smallest"), "label").select("set", "component_id"), "components")
    out = mine.join(of_set, "set", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
