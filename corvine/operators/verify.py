"""Comparisons of runs, samples in a stated order, and summaries of timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = 1e-12


def close(a: Column, b: Column, by: float = CLOSE) -> Column:
    """Both finite, and equal up to ``by`` of the larger one, or up to ``by``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(finite(a) & finite(b) & (F.abs(a - b) <= F.greatest(by * F.greatest(F.abs(a), F.abs(b)), F.lit(by))), F.lit(False))


def compare_hits(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: places (id, rank) of either run, those whose chunk differs or is missing,
    whose score isn't close, and whose score differs at all, and the largest difference."""
    x, y = (d.select("id", "rank", F.col("chunk_id").alias(f"c{k}"), F.col("score").alias(f"s{k}")) for k, d in enumerate((one, two)))
    j = x.join(y, ["id", "rank"], "full_outer")
    d = F.abs(F.col("s0") - F.col("s1"))
    return j.agg(F.count(F.lit(1)).alias("places"), F.count_if(~F.col("c0").eqNullSafe(F.col("c1"))).alias("other_chunk"), F.count_if(~close(F.col("s0"), F.col("s1"))).alias("not_close"), F.count_if(d > 0).alias("rounded"), F.max(d).alias("max_difference"))


def compare_predictions(one: DataFrame, two: DataFrame, timing: tuple[str, ...] = ("seconds",)) -> DataFrame:
    """One row: ids of either run, those that the other lacks, and those of which any
    column but the timings differs. Nulls are equal."""
    fields = [c for c in one.columns if c != "id" and c not in timing]
    if sorted(fields) != sorted(c for c in two.columns if c != "id" and c not in timing):
        raise ValueError("predictions with other columns")
    x, y = (d.select("id", F.struct(*fields).alias(f"v{k}")) for k, d in enumerate((one, two)))
    j = x.join(y, "id", "full_outer")
    alone = F.col("v0").isNull() | F.col("v1").isNull()
    return j.agg(F.count(F.lit(1)).alias("ids"), F.count_if(alone).alias("unmatched"), F.count_if(~alone & ~F.col("v0").eqNullSafe(F.col("v1"))).alias("different"))


def recheck(claimed: DataFrame, derived: DataFrame, by: float = CLOSE) -> DataFrame:
    """metric, claimed, derived, same for each column of two one-row tables of figures;
    a null equals a null only."""
    both = [c for c in derived.columns if c in claimed.columns]
    wide = claimed.select(F.struct(*[F.col(c).cast("double").alias(c) for c in both]).alias("c")).crossJoin(derived.select(F.struct(*[F.col(c).cast("double").alias(c) for c in both]).alias("d")))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"c.{c}").alias("claimed"), F.col(f"d.{c}").alias("derived")) for c in both]))
    same = close(F.col("claimed"), F.col("derived"), by) | (F.col("claimed").isNull() & F.col("derived").isNull())
    return wide.select(each.alias("r")).select("r.*").withColumn("same", same)


def zip_by_place(one: DataFrame, two: DataFrame, place: str = "place") -> DataFrame:
    """Rows of the same place side by side, as structs one and two; the plan fails where
    a place is on one side only, so nothing shifts unseen."""
    x, y = one.select(place, F.struct(*one.columns).alias("one")), two.select(place, F.struct(*two.columns).alias("two"))
    j = x.join(y, place, "full_outer")
    lone = F.col("one").isNull() | F.col("two").isNull()
    return j.select(F.when(lone, F.raise_error(F.lit("sequences differ in length")).cast("long")).otherwise(F.col(place)).cast(one.schema[place].dataType).alias(place), "one", "two")


def throughput(runs: DataFrame) -> DataFrame:
    """executor, median of rows a second, runs. runs: executor, rows, seconds."""
    return runs.groupBy("executor").agg(F.median(F.col("rows") / F.col("seconds")).alias("rows_per_second"), F.count(F.lit(1)).alias("runs"))


def valid_schedule(times: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    """index, round, valid: whether each arm ran once in the round, in places 0 and on,
    and the first place went to another arm than in the round before. times: index,
    round, place, arm."""
    r = times.groupBy("index", "round").agg(F.array_sort(F.collect_list(F.struct("place", "arm"))).alias("ran"))
    order = F.transform("ran", lambda x: x["arm"])
    places = F.transform("ran", lambda x: x["place"].cast("int"))
    r = r.withColumns({"order": order, "whole": (places == F.sequence(F.lit(0), F.lit(len(arms) - 1))) & (F.array_sort(order) == F.array(*[F.lit(a) for a in sorted(arms)]))})
    before = F.lag(F.get("order", F.lit(0))).over(Window.partitionBy("index").orderBy("round"))
    turned = F.coalesce(before != F.get("order", F.lit(0)), F.lit(True))
    return r.select("index", "round", (F.col("whole") & turned).alias("valid"))


def exactly_one(rows: DataFrame, of: str) -> DataFrame:
    """The only row; running the plan fails unless there is one."""
    two = rows.limit(2).agg(F.collect_list(F.struct(*rows.columns)).alias("r"))
    kind = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema.fields)}>"
    one = F.when(F.size("r") != 1, F.raise_error(F.lit(f"not exactly one {of}")).cast(kind)).otherwise(F.get("r", F.lit(0)))
    return two.select(one.alias("x")).select("x.*")


def hash_sample(rows: DataFrame, salt: str, count: int, key: str = "id") -> DataFrame:
    """The first rows by the digest of [salt, key], with their place; a top-k, so only
    those reach one task."""
    d = F.sha2(F.to_json(F.array(F.lit(salt), F.col(key))), 256)
    top = rows.withColumn("d", d).orderBy("d").limit(count)
    return top.withColumn("place", F.row_number().over(Window.orderBy("d")) - 1).drop("d")


def rotating_arms(sample: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    """Each question of a sample (id, place) once for each arm; which comes first moves
    on by one with the place."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(len(arms) - 1)))
    t = sample.withColumn("turn", turns)
    return t.withColumn("arm", F.element_at(F.array(*[F.lit(a) for a in arms]), ((F.col("place") + F.col("turn")) % len(arms) + 1).cast("int")))


def disjoint_selection(candidates: DataFrame, salt: str, positives: int, negatives: int) -> DataFrame:
    """id, family_id, kind of a choice of questions (id, family_id, positive) in which no
    family comes twice: by the digests of [salt, id] the first positive one of each
    family, then of what other families have. Taking the least of each family gives what
    going through them one by one would."""
    d = candidates.withColumn("d", F.sha2(F.to_json(F.array(F.lit(salt), F.col("id"))), 256))
    first = lambda rows, n: rows.groupBy("family_id").agg(F.min(F.struct("d", "id")).alias("m")).orderBy("m.d").limit(n).select("family_id", F.col("m.id").alias("id"))
    yes = first(d.where("positive"), positives)
    no = first(d.where(~F.col("positive")).join(yes.select("family_id"), "family_id", "left_anti"), negatives)
    return yes.withColumn("kind", F.lit("positive")).unionByName(no.withColumn("kind", F.lit("negative")))


def split_checks(split: DataFrame) -> DataFrame:
    """By split its rows, families and the families that it shares with another one."""
    shared = split.groupBy("family_id").agg(F.count_distinct("split").alias("k"))
    return split.join(shared, "family_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("family_id").alias("families"), F.count_distinct(F.when(F.col("k") > 1, F.col("family_id"))).alias("shared"))


def benchmark_summary(times: DataFrame, before: str, after: str) -> DataFrame:
    """By index: the arms' medians of per-round medians, the speed-up, the rounds in which
    ``after`` was faster, and all rounds. times: index, round, arm, seconds."""
    each = times.groupBy("index", "round").pivot("arm", [before, after]).agg(F.median("seconds"))
    x, y = F.col(before), F.col(after)
    out = each.groupBy("index").agg(F.median(x).alias("before"), F.median(y).alias("after"), F.count_if(y < x).alias("faster_rounds"), F.count(F.lit(1)).alias("rounds"))
    return out.withColumn("speed_up", F.try_divide(F.col("before"), F.col("after")))
