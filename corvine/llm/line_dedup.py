"""Line dedup by winnowing over line hashes, in DataFrame operations.

A run is a sequence of lines with words (blank ones are looked through). A run that
occurred earlier in the corpus (by document, then line) is deleted where it has MIN_LINES
lines or MIN_WORDS words, whatever its length.

Winnowing: of each window of MIN_LINES lines, and of each shorter one that has the words,
the line of least hash is selected as a fingerprint, so two equal runs of that length
have at least one fingerprint in common, at the same place. Fingerprints that occur at
one position only are dropped. The positions of the others are joined with the first
position of the same fingerprint amid the same window, a seed of a match. Seeds that
follow each other in both documents at one distance are one match: it is extended from
each fingerprint forward and backward as far as the two documents agree, since every
window of a match is a seed of it. All but the first occurrence of a match go.

Hot lines (a license in a third of all documents) are spread over tasks by
``spread_join``; all joins are sort-merge joins at every size, which spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.operators.skew import spread_join
from corvine.session import materialize

MIN_LINES = 3
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
_LAST = (1 << 63) - 1
#: A match: the document with its text's hash, and where else the match occurred first.
_MATCH = ["doc", "of", "from_doc", "from_of", "shift"]


def _order(doc_id: str = "doc_id") -> Column:
    """A null id counts as the last document."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))


def _windows(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """doc, of (a hash of the text), and ``all``: an array of windows over the lines with
    words (f: the least hash, p: its place, the last of equal ones; start, size; id, id2;
    a, z: places of the first and last line in the text). Texts are split and matched
    once. Equal rows are one document; rows of one id with several texts are several."""
    one = lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("w"))
    worded = F.filter(F.transform(F.split("text", "\n"), one), lambda x: x["w"] > 0)

    def of(lines: Column, i: Column, size: int) -> Column:
        x = [F.get(lines, i + j) for j in range(size)]
        h = [y["h"] for y in x]
        least = F.least(*h) if size > 1 else h[0]
        p = F.lit(0)
        for j in range(size):
            p = F.when(h[j] == least, F.lit(j)).otherwise(p)
        good = (i + size <= F.size(lines)) & ((sum((y["w"] for y in x[1:]), x[0]["w"]) >= min_words) if size < min_lines else F.lit(True))
        ids = F.xxhash64(F.lit(size), *h).alias("id"), F.hash(F.lit(size), *[y["g"] for y in x]).alias("id2")
        return F.when(good, F.struct(least.alias("f"), (i + p).alias("p"), i.alias("start"), F.lit(size).alias("size"), *ids, x[0]["at"].alias("a"), x[-1]["at"].alias("z")))

    def every(lines: Column) -> Column:
        start = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: i < F.size(lines))
        return F.flatten(F.transform(start, lambda i: F.filter(F.array(*[of(lines, i, s) for s in range(1, min_lines + 1)]), lambda x: x.isNotNull())))

    # As the only item of an array the lines are a lambda's variable, made once.
    texts = docs.where(F.col("text").isNotNull())
    return texts.select(_order().alias("doc"), F.xxhash64("text").alias("of"), F.get(F.transform(F.array(worded), every), F.lit(0)).alias("all"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, of, from_doc, from_of, shift, first, last: the maximal matches of each
    document (by id and hash of the text) with an earlier place: lines first..last of its
    text that have words repeat those of from_doc, ``shift`` lines with words before or
    after."""
    windows = materialize(_windows(docs, min_lines, min_words), "windows").where(F.size("all") > 0)
    # A fingerprint is a position, however many windows choose it; equal rows are one.
    prints = windows.select("doc", "of", F.explode(F.array_distinct(F.transform("all", lambda x: F.struct(x["f"].alias("f"), x["p"].alias("p"))))).alias("x"))
    at = F.struct("doc", "of", "x.p")
    shared = prints.groupBy(F.col("x.f").alias("f")).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("a") != F.col("b"))
    shared = materialize(shared.select("f", "n"), "fingerprints")
    total = shared.agg(F.sum("n")).first()[0] or 0
    each = windows.select("doc", "of", F.explode("all").alias("x")).select("doc", "of", "x.f", "x.start", "x.size", "x.id", "x.id2", "x.a", "x.z")
    seeds = materialize(spread_join(each, shared, ["f"], "left_semi", "n", total, ["doc", "start"]).drop("f"), "seeds")
    where = F.struct("doc", "of", "start")
    first = seeds.groupBy("id", "id2").agg(F.min(where).alias("first"), F.max(where).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first") != F.col("last"))
    first = materialize(first.select("id", "id2", "first", "n"), "first")
    total = first.agg(F.sum("n")).first()[0] or 0
    met = spread_join(seeds, first, ["id", "id2"], "inner", "n", total, ["doc", "start"]).where(where > F.col("first"))
    met = met.select("doc", "of", F.col("first.doc").alias("from_doc"), F.col("first.of").alias("from_of"), (F.col("start") - F.col("first.start")).alias("shift"), "start", (F.col("start") + F.col("size") - 1).alias("end"), "a", "z")
    # Along one distance of one pair of documents: as many seeds as the text has lines.
    along = Window.partitionBy(*_MATCH).orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    met = met.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return met.groupBy(*_MATCH, "run").agg(F.min("a").alias("first"), F.max("z").alias("last")).drop("run")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Keep every column, put the lines that are left into ``text``, and add n_lines and
    n_removed.

    Null and empty texts stay as they are, with no lines removed; a text may become
    empty. Of copies the first document keeps its lines, ordered by doc_id (null last),
    then by a hash of the text; rows that repeat both id and text are one document and
    keep or lose the same lines. An empty table gives an empty result; input columns
    named like results are replaced. Texts are shuffled once, by id and hash, to meet
    their matches.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), min_lines, min_words)
    runs = runs.groupBy("doc", "of").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    mine = {c: f"c{i}" for i, c in enumerate(kept)}  # own names can't clash with the input's
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()], _order().alias("doc"), F.xxhash64("text").alias("of"))
    out = base.join(materialize(runs, "runs").hint("merge"), ["doc", "of"], "left")
    text, lines = F.col(mine["text"]), F.split(mine["text"], "\n")
    # Within a match the lines with words go; sets of places, so linear in the lines.
    worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    spans = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    gone = F.when(F.col("runs").isNotNull(), F.array_intersect(worded, spans))
    out = out.select(*mine.values(), gone.alias("gone"), F.when(F.col("runs").isNotNull(), lines).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.concat_ws("\n", F.transform(left, lambda i: F.get("lines", i))))
    n = F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    out = out.select(*[new.alias(c) if c == "text" else F.col(m).alias(c) for c, m in mine.items()], n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out


#: DuckDB: the same definition by content of all windows, without fingerprints.
SQL = rf"""
WITH lines AS (
  SELECT doc_id, text, i - 1 AS place, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i) WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, place, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, n, 1 AS size, line AS body, words FROM worded
  UNION ALL SELECT a.doc_id, a.n, 2, a.line || chr(10) || b.line, a.words + b.words
  FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.n = a.n + 1
  UNION ALL SELECT a.doc_id, a.n, 3, a.line || chr(10) || b.line || chr(10) || c.line, {MIN_WORDS}
  FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN worded c ON a.doc_id = c.doc_id AND c.n = a.n + 2
), later AS (
  SELECT * FROM (SELECT doc_id, n, size, row_number() OVER (PARTITION BY size, body ORDER BY doc_id, n) AS r FROM windows WHERE words >= {MIN_WORDS}) WHERE r > 1
), gone AS (
  SELECT DISTINCT w.doc_id, w.place FROM later l JOIN worded w ON w.doc_id = l.doc_id AND w.n >= l.n AND w.n < l.n + l.size
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS body, count(*) AS n
  FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS BIGINT) AS n_removed,
       CAST(length(coalesce(k.body, '')) AS BIGINT) AS kept_chars, sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
