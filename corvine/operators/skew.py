"""Shuffled joins whose hot keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds over one of so many rows, so at most SHARES keys are hot.
SHARES = 1000
SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: str, total: int, by: list[str]) -> DataFrame:
    """``left`` joined (inner or left_semi) with ``right``, which has one row a key and
    in ``rows`` how many rows of the left side the key has, ``total`` of all its keys.

    Hot keys, at most SHARES whatever the data, are broadcast to mark the rows of the
    left side; those go to SALTS places by a hash of the columns ``by``, and their rows
    of the right side to each of them. All else meets once, by one sort-merge join at
    every size.
    """
    hot = F.col(rows) * SHARES > F.lit(total)
    marks = F.broadcast(right.where(hot).select(*on, F.lit(True).alias("_hot")))
    salted = left.join(marks, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    place = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(place)).hint("merge"), [*on, "_salt"], how).drop("_salt")
