"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in column expression, so a document is judged where it is
scanned: no user function, no shuffle, and memory bounded by one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "der die das und ist nicht ein eine zu den mit von sich auf für im dem des "
    "le la les de du et un une que qui en est dans pour pas sur par au avec ce "
    "el los las del y se por con no su para es lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure's allowed range; a bound that is None does not apply."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The method's own verdict, beside the base rule. Ratios of an empty text are 0.
DEFAULT_RULES = (
    Rule("n_words", 50, 100_000),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.5),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.3),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("upper_ratio", None, 0.6),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def quality_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of every row's whole text as columns prefixed ``_q_``.

    Three stacked projections: arrays first, so that each is built once and the
    lambdas above read a finished column.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.withColumn("_q_text", body)
    one = one.withColumns(
        {
            "_q_words": F.filter(F.split("_q_text", SPACE), lambda w: w != ""),
            "_q_lines": F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(WORD_CHAR)),
        }
    )
    two = one.withColumns({"_q_n": F.size("_q_words").cast("long"), "_q_h": F.transform("_q_words", lambda w: F.xxhash64(w))})
    grams = F.when(
        F.col("_q_n") >= 3,
        F.transform(
            F.sequence(F.lit(0), (F.col("_q_n") - 3).cast("int")),
            lambda i: F.xxhash64(F.get("_q_h", i), F.get("_q_h", i + 1), F.get("_q_h", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    three = two.withColumn("_q_grams", grams)
    # Only texts with a repeated window are sorted.
    four = three.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct("_q_grams")) < F.size("_q_grams"),
            F.array_sort(F.transform("_q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    again = F.filter(
        "_q_sorted",
        lambda e, i: (F.get("_q_sorted", i - 1)["h"] == e["h"]) | (F.get("_q_sorted", i + 1)["h"] == e["h"]),
    )
    covered = F.aggregate(
        F.array_sort(F.transform(again, lambda e: e["p"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    n, chars = F.col("_q_n"), F.col("_q_word_chars")
    lines = F.size("_q_lines")
    measured = four.withColumns(
        {
            "_q_word_chars": F.length(F.regexp_replace("_q_text", SPACE, "")).cast("long"),
            "_q_symbols": F.regexp_count("_q_text", F.lit(SYMBOLS)).cast("long"),
            "_q_dup_lines": (lines - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_repeat": F.coalesce(covered, F.lit(0)).cast("long"),
            "_q_stop": F.size(F.filter("_q_words", lambda w: F.lower(w).isin(STOP_WORDS))),
            "_q_upper": F.regexp_count("_q_text", F.lit(r"\p{Lu}")),
            "_q_ellipsis": F.size(F.filter("_q_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
            "_q_bullets": F.size(F.filter("_q_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))),
        }
    )
    return measured.withColumns(
        {
            "_q_mean_word_chars": _ratio(chars, n),
            "_q_symbol_ratio": _ratio(F.col("_q_symbols"), n),
            "_q_stop_ratio": _ratio(F.col("_q_stop"), n),
            "_q_dup_line_ratio": _ratio(F.col("_q_dup_lines"), lines),
            "_q_ellipsis_line_ratio": _ratio(F.col("_q_ellipsis"), lines),
            "_q_bullet_line_ratio": _ratio(F.col("_q_bullets"), lines),
            "_q_upper_ratio": _ratio(F.col("_q_upper"), chars),
            "_q_n_words": n,
        }
    )


def compile_rules(rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """The threshold table as one boolean column over the measures."""
    verdict = F.lit(True)
    for r in rules:
        x = F.col(f"_q_{r.measure}")
        if r.low is not None:
            verdict = verdict & (x >= F.lit(float(r.low)))
        if r.high is not None:
            verdict = verdict & (x <= F.lit(float(r.high)))
    return verdict


def judge_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Keep every column and add n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and kept.

    Null and empty texts have no words: all counts 0, base_failed true, kept false.
    Repeated rows are judged one by one; an empty table gives an empty result; columns
    that the result needs are replaced where an input column has the same name.
    """
    given = [c for c in docs.columns if not c.startswith("_q_")]
    m = quality_measures(docs.select(given), text)
    failed = (F.col("_q_n") < 50) | (100 * F.col("_q_repeat") > 50 * F.col("_q_n"))
    out = {
        "n_words": F.col("_q_n"),
        "word_chars": F.col("_q_word_chars"),
        "n_symbols": F.col("_q_symbols"),
        "n_dup_lines": F.col("_q_dup_lines"),
        "n_repeat_words": F.col("_q_repeat"),
        "base_failed": failed,
        "kept": ~failed & compile_rules(rules),
    }
    return m.select(*[c for c in given if c not in out], *[v.alias(k) for k, v in out.items()])
