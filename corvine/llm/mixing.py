"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations.

Every document of a source is expected target / source size times in the mix. The whole
part of that is taken for certain. What is left of the target is sampled: a document's
inclusion odds follow the square root of its size, so that long documents have a greater
chance and short ones one too. Documents so large that theirs would pass 1 are certain.
The others are ranked by their random odds divided by their inclusion odds, and the
first ones are taken until the words come nearest to the target: one ranking of unequal
probabilities for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.session import materialize

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: A rank has LEVELS digits of BITS bits; each level sums words by one digit, so the
#: table that is searched for a source's cut has at most 2**BITS rows a source.
BITS, LEVELS = 8, 3
#: Bins of sizes to a factor of 2 of their square root, and turns that fill a source.
SIZE_BINS, FILLS = 64, 3
#: A source may miss what is drawn for it by this share.
SLACK = 0.01
#: Sources are numbered, and their targets levelled, within so many ranges at once.
RANGES = 16


def _numbered(rows: DataFrame, by: list[Column], sums: dict[str, str]) -> DataFrame:
    """The rows with their place in the order ``by`` (from 0), and the running sums of
    other columns before them: within ranges of the order, then on top of what the
    ranges before hold. No task sees more than one range."""
    ranged = materialize(rows.repartitionByRange(RANGES, *by).withColumn("part", F.spark_partition_id()), "ranges")
    each = {"at": F.count(F.lit(1)).cast("long"), **{k: F.sum(c).cast("double") for k, c in sums.items()}}
    heads = ranged.groupBy("part").agg(*[v.alias(k) for k, v in each.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    heads = heads.select("part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_0") for k in each])
    own = Window.partitionBy("part").orderBy(*by)
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(heads), "part")
    place = {"at": F.row_number().over(own) - 1 + F.col("at_0")}
    place |= {k: F.coalesce(F.sum(c).over(upto), F.lit(0.0)) + F.col(f"{k}_0") for k, c in sums.items()}
    return out.withColumns(place).drop("part", *[f"{k}_0" for k in each])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size).

    Targets share the total by weight, none above ``cap`` times its source's size; what
    is cut off is shared again by weight. Sorted by cap / weight, the capped sources come
    first, so running sums find the common multiple at once: it is the least one at which
    a source stays below its cap. One row a source; sources may be many.
    """
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    t = _numbered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {})
    t = t.select("source", "source_size", choice.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    t = _numbered(t.withColumn("ratio", F.col("most") / F.col("w")), [F.col("ratio"), F.col("source").asc_nulls_last()], {"capped": "most", "weighed": "w"})
    t = materialize(t, "levels")
    total, weight = t.agg(F.sum(F.col("source_size").cast("double")), F.sum("w")).first()
    level = (F.lit(total) - F.col("capped")) / (F.lit(weight) - F.col("weighed"))
    first = t.select("at", level.alias("level")).where(F.col("level") * F.col("w") < F.col("most")) if total else t.limit(0).withColumn("level", F.lit(0.0))
    common = first.agg(F.min_by("level", "at")).first()[0]
    target = F.col("most") if common is None else F.least(F.col("most"), F.lit(common) * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def pareto_key(u: Column, pi: Column) -> Column:
    """Random odds over inclusion odds, mapped to 0..1 by q / (1 + q)."""
    return u * (1 - pi) / (u * (1 - pi) + pi * (1 - u))


def size_bin(size: Column) -> Column:
    return F.floor(F.log2(F.sqrt(size.cast("double"))) * SIZE_BINS).cast("int")


def inclusion_scale(rows: DataFrame) -> DataFrame:
    """g, scale, rest, upto of each source (rows: g, size, lack). A document's inclusion
    probability is the square root of its size times scale, so that documents of all
    sizes have a chance and large ones a greater one. Those of bins above ``upto`` would
    pass 1: they are certain, and the others are expected to hold the words that are
    left then (rest).

    Sizes are summed in bins, SIZE_BINS to a factor of 2 of the root, so a source has a
    bounded number of rows whatever its documents.
    """
    root = F.sqrt(F.col("size").cast("double"))
    some = rows.where((F.col("size") > 0) & (F.col("lack") > 0))
    bins = some.groupBy("g", "lack", size_bin(F.col("size")).alias("bin")).agg(F.sum(root * F.col("size")).alias("by"), F.sum("size").cast("double").alias("words"), F.max(root).alias("top"))
    # With all bins above certain, the scale of this one and those below.
    down = Window.partitionBy("g").orderBy(F.desc("bin"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    below = F.sum("by").over(down.rowsBetween(0, Window.unboundedFollowing))
    fit = bins.withColumn("rest", F.col("lack") - above).withColumn("scale", F.col("rest") / below)
    # The largest bin none of whose documents would pass 1.
    ok = fit.where((F.col("rest") <= 0) | (F.col("scale") * F.col("top") < 1))
    first = ok.groupBy("g").agg(F.max(F.struct("bin", "scale", "rest")).alias("x"))
    return materialize(first.select("g", F.col("x.scale").alias("scale"), F.col("x.rest").alias("rest"), F.col("x.bin").alias("upto")), "scales")


def fill(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows: doc_id, g, size, key, tie; goals: g, goal (words). Adds ``in``.

    The ranking is cut where the goal is passed; a document there that is short against
    the goal is in or out, whichever is nearer. Only where it is long, as in sources of
    few documents, the ranking goes on over those that are no longer than what is
    missing, for FILLS turns in all. Documents that are ranked before are all in.
    """
    done, left = None, rows
    goals = goals.withColumn("slack", F.col("goal") * SLACK)
    for turn in range(FILLS):
        last = turn == FILLS - 1
        cut = materialize(_cut(left, goals.withColumn("slack", F.lit(float(1 << 62))) if last else goals), "cut-rows")
        if last:
            return cut if done is None else done.unionByName(cut)
        had = cut.groupBy("g").agg(F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("had")).withColumnRenamed("g", "g1")
        missing = goals.join(had, goals["g"].eqNullSafe(had["g1"]), "left").select("g", (F.col("goal") - F.coalesce("had", F.lit(0))).alias("goal"), "slack")
        goals = materialize(missing.where(F.col("goal") > F.col("slack")), "goals")
        g = goals.select(F.col("g").alias("g1"), "goal")
        open_ = cut.join(g, cut["g"].eqNullSafe(g["g1"]), "left").withColumn("more", ~F.col("in") & F.coalesce(F.col("size") <= F.col("goal"), F.lit(False))).drop("g1", "goal")
        over, left = open_.where(~F.col("more")).drop("more"), open_.where("more").drop("more", "in")
        done = over if done is None else done.unionByName(over)
        if not goals.limit(1).count():
            return cut if turn == 0 else done.unionByName(left.withColumn("in", F.lit(False)))
    return done


def _tie(seed: int, text: str) -> Column:
    return F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col(text))


def _cut(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows: g, size, key (0..1), tie; goals: g, goal, slack (words). Adds ``in``: the rows
    of least key of each g whose sizes reach its goal, or come nearest to it if the last
    one isn't longer than twice the slack.

    Level by level one digit of the key is summed (partial sums before the shuffle), the
    digit where the running sum passes the goal is fixed, and only rows that share all
    fixed digits are left for the last, exact ranking.
    """
    bits = BITS * LEVELS
    rows = rows.withColumn("k", F.least((F.col("key") * F.lit(float(1 << bits))).cast("long"), F.lit((1 << bits) - 1)))
    state = goals.select("g", F.col("goal").alias("need"), F.lit(0).cast("long").alias("fixed"))
    for level in range(LEVELS):
        shift = bits - BITS * (level + 1)
        digit = F.shiftright("k", shift)
        of = rows.join(state, rows["g"].eqNullSafe(state["g"])).where(F.shiftright(F.col("k"), shift + BITS) == F.col("fixed"))
        sums = of.groupBy(rows["g"].alias("g"), digit.alias("digit"), "need").agg(F.sum("size").alias("words"))
        w = Window.partitionBy("g").orderBy("digit")
        run = sums.withColumn("upto", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # The last digit, if all words are not enough.
        run = run.withColumn("last", F.lead("digit").over(w).isNull())
        at = run.where((F.col("upto") >= F.col("need")) | F.col("last")).groupBy("g").agg(F.min_by(F.struct("digit", (F.col("need") - F.col("upto") + F.col("words")).alias("need")), "digit").alias("x"))
        state = materialize(at.select("g", F.col("x.need").alias("need"), F.col("x.digit").alias("fixed")), "cut")
    at = state.withColumnRenamed("g", "g2")
    edge = rows.join(at, rows["g"].eqNullSafe(at["g2"])).where(F.col("k") == F.col("fixed"))
    w = Window.partitionBy("g").orderBy("key", "tie", "size")
    edge = edge.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A row is in if it fits, or if it is short and stopping after it is nearer to the
    # goal than stopping before it.
    slack = goals.select(F.col("g").alias("g5"), "slack")
    edge = edge.join(slack, edge["g"].eqNullSafe(slack["g5"]))
    near = (F.col("size") <= 2 * F.col("slack")) & (F.col("upto") - F.col("need") < F.col("need") - F.col("upto") + F.col("size"))
    ok = (F.col("upto") <= F.col("need")) | near
    last = materialize(edge.groupBy("g").agg(F.max(F.when(ok, F.struct("key", "tie", "size"))).alias("upto_row")), "edge")
    cut = state.join(last.withColumnRenamed("g", "g3"), state["g"].eqNullSafe(F.col("g3")), "left").select(state["g"].alias("g4"), "fixed", "upto_row")
    out = rows.join(cut, rows["g"].eqNullSafe(cut["g4"]), "left")
    within = (F.col("k") < F.col("fixed")) | ((F.col("k") == F.col("fixed")) & (F.struct("key", "tie", "size") <= F.col("upto_row")))
    return out.withColumn("in", F.coalesce(within, F.lit(False))).drop("k", "fixed", "upto_row", "g4")


def plan_mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """doc_id, tie (a hash of id and text), source, size, source_size, target, copies,
    taken of every row.

    A null text has size 0 and is never taken. A null source is a source, the last. Rows
    that repeat a doc_id draw by their text too; rows that repeat both share one draw, so
    that they are told apart only where the cut falls between them, and then it makes no
    difference which. An empty table gives an empty plan. Only doc_id, source and one
    text column are read; the draw depends on ``seed``, doc_id and text alone.
    """
    u = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text))
    narrow = docs.select(
        "doc_id",
        "source",
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        # 52 bits, never 0 or 1
        ((F.shiftrightunsigned(u, 12).cast("double") + 0.5) / F.lit(float(1 << 52))).alias("u"),
        _tie(seed, text).alias("tie"),
    )
    narrow = materialize(narrow, "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sizes, weights)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Rounding may leave the capped sources a hair below a whole number.
    t = targets.withColumn("whole", F.floor(expected + 1e-9)).withColumn("lack", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    t = materialize(t.withColumnRenamed("source", "of"), "targets")
    rows = materialize(narrow.join(t, narrow["source"].eqNullSafe(t["of"])).drop("of").select("doc_id", F.col("source").alias("g"), "size", "u", "tie", "lack", "source_size"), "rows")
    scale = inclusion_scale(rows)
    s = scale.withColumnRenamed("g", "g1")
    rows = rows.join(s, rows["g"].eqNullSafe(s["g1"]), "left").drop("g1")
    some = (F.col("size") > 0) & (F.col("lack") > 0)
    # Without a bin that is drawn from, all are certain.
    sure = some & (F.col("upto").isNull() | (size_bin(F.col("size")) > F.col("upto")))
    rest = rows.where(~some | sure).withColumn("in", sure)
    pi = F.least(F.greatest(F.sqrt(F.col("size").cast("double")) * F.col("scale"), F.lit(1e-12)), F.lit(1 - 1e-12))
    drawn = rows.where(some & ~sure & (F.col("rest") > 0)).withColumn("key", pareto_key(F.col("u"), pi))
    none = rows.where(some & ~sure & (F.col("rest") <= 0)).withColumn("in", F.lit(False))
    drawn = fill(drawn.select("doc_id", "g", "size", "key", "tie"), scale.where(F.col("rest") > 0).select("g", F.col("rest").alias("goal")))
    cols = ["doc_id", "tie", "g", "size", "in"]
    every = drawn.select(cols).unionByName(rest.select(cols)).unionByName(none.select(cols)).withColumnRenamed("g", "source")
    every = every.join(t, every["source"].eqNullSafe(t["of"])).drop("of")
    copies = (F.col("whole") + F.col("in").cast("long")).cast("long")
    return every.select("doc_id", "tie", "source", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, its columns
    unchanged, whatever their names. Rows that repeat both doc_id and text are taken
    alike."""
    plan = plan_mix(docs.select("doc_id", "source", "text"), "text", weights, seed).where(F.col("copies") > 0)
    # One row for each id and text, whatever repeats; the draw depends on these alone.
    plan = materialize(plan.groupBy(F.col("doc_id").alias("id"), "tie").agg(F.max("copies").alias("copies")), "copies")
    mine = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # own names can't clash with the input's
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()], _tie(seed, "text").alias("own"))
    out = rows.join(plan, (F.col("own") == F.col("tie")) & F.col(mine["doc_id"]).eqNullSafe(F.col("id")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(n).alias(c) for c, n in mine.items()])
