"""Cited extractive answers: prompts, a pluggable generator, and quote binding."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import SPACE, is_blank

NONE = "NO_ANSWER"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def read_reply(raw: Column) -> Column:
    """A struct of answer and citation from a reply that is JSON as a whole, or in one
    fence with nothing around it; both null unless the answer is a string and the
    citation a whole number (a boolean is none)."""
    whole = strip(raw)
    fenced = F.regexp_extract(whole, "(?s)^`{3}(?:json)?\\s*\\n(.*?)\\n`{3}$", 1)
    value = F.try_parse_json(F.when(fenced != "", fenced).otherwise(whole))
    part = lambda name, kind: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == kind, F.try_variant_get(value, f"$.{name}", kind))
    answer, citation = part("answer", "STRING"), part("citation", "BIGINT")
    both = answer.isNotNull() & citation.isNotNull()
    return F.struct(F.when(both, answer).alias("answer"), F.when(both, citation).alias("citation"))


def evidence(questions: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """id, question, evidence: the texts of the k best hits, best first."""
    if k not in (1, 3):
        raise ValueError("k must be 1 or 3")
    e = hits.where(F.col("rank") <= k).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("evidence"))
    return questions.select("id", "question").join(e, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def json_prompt(question: str, texts: list[str]) -> str:
    ask = "Answer with the shortest passage of the evidence, as JSON {\"answer\": ..., \"citation\": number}; NO_ANSWER and 0 if there is none.\n"
    return ask + json.dumps({"question": question, "evidence": [{"citation": i + 1, "text": x} for i, x in enumerate(texts)]}, ensure_ascii=False)


def span_prompt(question: str, texts: list[str]) -> str:
    return "Copy the passage of the evidence that answers the question, or write NO_ANSWER.\n" + question + "\n---\n" + "\n---\n".join(texts)


def verdict_prompt(question: str, texts: list[str]) -> str:
    return "Does the passage answer the question? Write YES or NO.\n" + question + "\n---\n" + texts[0]


def generate(asked: DataFrame, generator: Callable[[str], str], prompt: Callable[[str, list[str]], str] = json_prompt) -> DataFrame:
    """id, raw, answer, citation: one call of the generator for each row, in batches on
    the executors; a generator that holds a model should load it at its first call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "raw": [generator(prompt(q, list(e))) for q, e in zip(b["question"], b["evidence"], strict=True)]})

    said = asked.select("id", "question", "evidence").mapInPandas(run, "id string, raw string")
    return said.withColumn("reply", read_reply(F.col("raw"))).select("id", "raw", "reply.answer", "reply.citation")


def bind_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """id, reason, answer, doc_id, chunk_id, start, end of each answer (id, answer,
    citation); a quote counts at its first place in the cited chunk, and only there.

    Order: invalid_json, model_abstained, invalid_citation, unsupported_quote, quoted.
    """
    n = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    h = hits.select("id", F.col("rank").alias("citation"), "doc_id", "chunk_id", F.col("start").alias("s"), "text")
    j = answers.select("id", "answer", "citation").join(n, "id", "left").join(h, ["id", "citation"], "left")
    at = F.call_function("locate", F.col("answer"), F.col("text"))
    reason = (
        F.when(F.col("answer").isNull() | F.col("citation").isNull(), "invalid_json")
        .when(F.col("answer") == NONE, "model_abstained")
        .when(is_blank("answer") | (F.col("citation") < 1) | (F.col("citation") > F.coalesce("n", F.lit(0))), "invalid_citation")
        .when(F.coalesce(at, F.lit(0)) == 0, "unsupported_quote")
        .otherwise("quoted")
    )
    j = j.withColumns({"reason": reason, "at": at})
    only = lambda c: F.when(F.col("reason") == "quoted", c)
    first = F.col("s") + F.col("at") - 1
    return j.select("id", "reason", F.coalesce(only(F.col("answer")), F.lit(NONE)).alias("answer"), only(F.col("doc_id")).alias("doc_id"), only(F.col("chunk_id")).alias("chunk_id"), only(first).cast("long").alias("start"), only(first + F.length("answer")).cast("long").alias("end"))


def span_occurrences(quotes: DataFrame, hits: DataFrame) -> DataFrame:
    """id, doc_id, start, chunk_id: all places, overlapping ones too, of each quote (id,
    quote) in its hits' texts; a place in several chunks is cited by the last hit."""
    j = quotes.where(F.length("quote") > 0).join(hits, "id").where(F.length("text") >= F.length("quote"))
    at = F.filter(F.sequence(F.lit(1), F.length("text") - F.length("quote") + 1), lambda i: F.substring("text", i, F.length("quote")) == F.col("quote"))
    p = j.select("id", "doc_id", "chunk_id", "rank", F.col("start").alias("s"), F.explode(at).alias("at"))
    return p.withColumn("start", (F.col("s") + F.col("at") - 1).cast("long")).groupBy("id", "doc_id", "start").agg(F.max_by("chunk_id", "rank").alias("chunk_id"))


def bind_spans(quotes: DataFrame, hits: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """id, reason, answer, doc_id, chunk_id, start, end, candidate, model_calls of each
    quote, white space around it aside. A quote needs one place; verdicts (id, verdict),
    if given, are asked of those only: YES accepts, NO rejects, anything else is invalid.
    The candidate is the quote that a verdict was asked of or could have been."""
    quotes = quotes.select("id", strip(F.col("quote")).alias("quote"))
    places = span_occurrences(quotes, hits).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start", "chunk_id")).alias("at"))
    j = quotes.join(places, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("quote") == NONE, "model_abstained").when(is_blank("quote"), "empty_answer").when(F.col("n") == 0, "unsupported_quote").when(F.col("n") > 1, "ambiguous_quote")
    one = reason.isNull()
    calls = F.lit(1)
    if verdicts is not None:
        j = j.join(verdicts.select("id", strip(F.col("verdict")).alias("verdict")), "id", "left")
        calls = F.when(one, 2).otherwise(1)
        reason = reason.when(F.col("verdict") == "NO", "verifier_rejected").when(~F.coalesce(F.col("verdict") == "YES", F.lit(False)), "invalid_verdict")
    j = j.select("id", "quote", "at", reason.otherwise("quoted").alias("reason"), F.when(one, F.col("quote")).alias("candidate"), calls.alias("model_calls"))
    only = lambda c: F.when(F.col("reason") == "quoted", c)
    return j.select("id", "reason", F.coalesce(only(F.col("quote")), F.lit(NONE)).alias("answer"), only(F.col("at.doc_id")).alias("doc_id"), only(F.col("at.chunk_id")).alias("chunk_id"), only(F.col("at.start")).alias("start"), only(F.col("at.start") + F.length("quote")).alias("end"), "candidate", "model_calls")


def ask_verdicts(asked: DataFrame, spans: DataFrame, verifier: Callable[[str], str]) -> DataFrame:
    """id, verdict: the verifier's replies on the candidates of ``bind_spans``."""
    c = asked.join(spans.where(F.col("candidate").isNotNull()).select("id", F.array("candidate").alias("evidence")), "id")
    return generate(c.select("id", "question", "evidence"), verifier, verdict_prompt).select("id", F.col("raw").alias("verdict"))


def answer_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, before, after, changed of the same questions' answers (id, answer, reason) on
    two versions of the documents; one that is asked of one version only has a null."""
    x, y = (d.select("id", F.struct("answer", "reason").alias(n)) for n, d in (("x", before), ("y", after)))
    j = x.join(y, "id", "full_outer")
    return j.select("id", F.col("x.answer").alias("before"), F.col("y.answer").alias("after"), (~F.col("x").eqNullSafe(F.col("y"))).alias("changed"))


def score(results: DataFrame, gold: DataFrame, hits: DataFrame, rows: DataFrame) -> DataFrame:
    """arm, id, answerable, answered, correct, retrieval_hit, quote_valid,
    reference_supported, model_calls of results (arm, id, reason, answer, doc_id,
    chunk_id, start, end, model_calls) against gold (id, doc_id, answers), hits (id,
    chunk_id) and chunks (chunk_id, doc_id, start, end, text).

    Correct: an answer that is a gold one, or none where there is none. A quote is valid
    if the cited chunk reads so at the cited place, and supported if that is where a gold
    answer stands.
    """
    answers = gold.select("id", F.col("doc_id").alias("gold_doc"), "answers")
    got = hits.select("id", "chunk_id").join(rows.select("chunk_id", F.col("doc_id").alias("hit_doc"), F.col("start").alias("hs"), F.col("end").alias("he")), "chunk_id").join(answers, "id")
    holds = (F.col("hit_doc") == F.col("gold_doc")) & F.exists("answers", lambda a: (F.col("hs") <= a["start"]) & (F.col("he") >= a["start"] + F.length(a["text"])))
    found = got.groupBy("id").agg(F.max(holds).alias("retrieval_hit"))
    j = results.join(answers, "id", "left").join(found, "id", "left").join(rows.select("chunk_id", F.col("start").alias("cs"), F.col("text").alias("cited")), "chunk_id", "left")
    done, answerable = F.col("reason") == "quoted", F.col("answers").isNotNull()
    is_gold = F.exists("answers", lambda a: a["text"] == F.col("answer"))
    valid = done & (F.substring("cited", F.col("start") - F.col("cs") + 1, F.col("end") - F.col("start")) == F.col("answer"))
    at = (F.col("doc_id") == F.col("gold_doc")) & F.exists("answers", lambda a: (a["text"] == F.col("answer")) & (a["start"] == F.col("start")))
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select("arm", "id", answerable.alias("answerable"), done.alias("answered"), no(F.when(answerable, done & is_gold).otherwise(~done)).alias("correct"), no(F.col("retrieval_hit")).alias("retrieval_hit"), no(valid).alias("quote_valid"), no(valid & at).alias("reference_supported"), F.coalesce("model_calls", F.lit(1)).alias("model_calls"))


def arm_metrics(scored: DataFrame) -> DataFrame:
    """By arm the counts of ``score``'s verdicts, and all model calls."""
    names = ["answerable", "answered", "correct", "retrieval_hit", "quote_valid", "reference_supported"]
    return scored.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in names], F.sum("model_calls").cast("long").alias("model_calls"))


def metrics(scored: DataFrame) -> DataFrame:
    """By k: counts and rates over rows (k, answerable, answered, correct, supported);
    a rate over no rows is null."""
    rate = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b).cast("double"))
    yes, done = F.col("answerable"), F.col("answered")
    return scored.groupBy("k").agg(F.count(F.lit(1)).alias("n"), rate(yes & F.col("correct"), yes).alias("em_answerable"), rate(yes & ~done, yes).alias("false_refusal"), rate(~yes & ~done, ~yes).alias("correct_refusal"), rate(done & F.col("supported"), done).alias("citation_support"))
