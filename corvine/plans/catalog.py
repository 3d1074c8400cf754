"""The library's own queries over the test tables, each with its SQL.

Records are the documents: the id as text, the first line as title, the text; a few
literal records are added for rules that the tables never trigger.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as t
from corvine.operators import families as fam
from corvine.operators import qa, quality, verify
from corvine.operators.containment import contained, places
from corvine.operators import retrieval as ret
from corvine.plans.dataset import prepare
from corvine.plans.lake import Lake, table_digest
from corvine.sources.records import exclude_seen, read_jsonl, read_parquet_records, valid_references, write_jsonl
from corvine.sources.results import append_results
from corvine.session import materialize, shared_path, small_side

EXTRA = [
    ("x:schema", "标题", None),
    ("x:empty", "标题", " 　\n"),
    ("", "标题", "有文本"),
    ("x:phone", "标题", "call +86 15912345670 today"),
    ("x:mail", "标题", "write to größe@beispiel.test"),
    ("x:wide", "ＡＢＣ ß", "  ＡＢＣ\n中文 é  "),
    ("x:twice", "标题", "同一来源"),
    ("x:twice", "标题", "同一来源，另一文本"),
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks -------------------------------------------------------------


def _lit(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_EXTRA_SQL = ", ".join(f"({', '.join(map(_lit, r))})" for r in EXTRA)
_WS = r"[\p{Z}\t-\r\x{1c}-\x{1f}\x{85}]"
def _blank(c: str) -> str:
    return f"regexp_replace({c}, '{_WS}', '', 'g') = ''"


_EMAIL = r"(^|[^\p{L}\p{N}_.])[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+"
_PHONE = r"(^|\P{Nd})(\+86[- ]?)?1[3-9]\p{Nd}{9}($|\P{Nd})"
_RECORDS = f"""records AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_id, split_part(text, chr(10), 1) AS title, text FROM documents
  UNION ALL SELECT * FROM (VALUES {_EXTRA_SQL}) v(source_id, title, text)
)"""
_FLAGGED = f"""{_RECORDS}, flagged AS (
  SELECT *, CASE WHEN source_id IS NULL OR title IS NULL OR text IS NULL THEN 'schema'
    WHEN source_id = '' OR {_blank("text")} OR {_blank("title")} THEN 'empty'
    WHEN regexp_matches(text, '{_EMAIL}') OR regexp_matches(text, '{_PHONE}') THEN 'suspected_contact_pattern' END AS reason,
    sha256(CAST(to_json({{'source_id': source_id, 'text': text, 'title': title}}) AS VARCHAR)) AS record_hash
  FROM records
)"""
_ACCEPTED = f"""{_FLAGGED}, accepted AS (
  SELECT source_id, title, text, record_hash, sha256(CAST(to_json(text) AS VARCHAR)) AS doc_id,
    regexp_replace(replace(lower(nfc_normalize(title)), 'ß', 'ss'), '{_WS}', '', 'g') AS title_key
  FROM flagged WHERE reason IS NULL
)"""
_DOCS = f"""{_ACCEPTED}, docs AS (
  SELECT doc_id, min(text) AS text, arg_min(title, (source_id, title)) AS title, arg_min(title_key, (source_id, title)) AS title_key FROM accepted GROUP BY doc_id
)"""


def _chunks(stride: int, name: str) -> str:
    return f"""{name} AS (
  SELECT sha256('["' || doc_id || '",' || s || ',' || least(s + 160, length(text)) || ']') AS chunk_id, doc_id, s AS "start",
    least(s + 160, length(text)) AS "end", substring(text, s + 1, 160) AS text
  FROM docs, unnest(range(0, CAST(ceil(greatest(length(text) - 160, 0) / {stride}.0) * {stride} AS BIGINT) + 1, {stride})) r(s) WHERE length(text) > 0
)"""


_BASE, _OVER = _chunks(160, "base"), _chunks(96, "over")
_QUESTIONS = "questions AS (SELECT CAST(item_id AS VARCHAR) AS id, text AS question FROM benchmark)"


def _norm(c: str) -> str:
    return rf"replace(lower(regexp_replace(nfc_normalize({c}), '[^\p{{L}}\p{{N}}]', '', 'g')), 'ß', 'ss')"




def _normal(src: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT chunk_id, s, greatest(2 * length(s) - 1, 0) AS dl FROM (SELECT chunk_id, {_norm('text')} AS s FROM {src}))"


def _tf(normal: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (
    SELECT chunk_id, unnest(list_concat([substring(s, i, 1) for i in range(1, length(s) + 1)], [substring(s, i, 2) for i in range(1, length(s))])) AS term FROM {normal}) GROUP BY ALL)"""


def _search(src: str, p: str, k: int = 3, k1: float = 1.2, b: float = 0.75) -> str:
    return f"""{_normal(src, p + "n")}, {_tf(p + "n", p + "tf")},
{p}q AS (SELECT id, term, count(*) AS qtf FROM (SELECT id, unnest(list_concat([substring(s, i, 1) for i in range(1, length(s) + 1)], [substring(s, i, 2) for i in range(1, length(s))])) AS term
  FROM (SELECT id, {_norm('question')} AS s FROM questions)) GROUP BY ALL),
{p}c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}n),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf WHERE term IN (SELECT term FROM {p}q) GROUP BY term),
{p}s AS (SELECT q.id, tf.chunk_id, round(sum(q.qtf * ln(1 + (c.n - d.df + 0.5) / (d.df + 0.5)) * tf.tf * ({k1} + 1) / (tf.tf + {k1} * (1 - {b} + {b} * n.dl / greatest(c.avgdl, 1)))), 9) AS score
  FROM {p}q q JOIN {p}df d USING (term) JOIN {p}tf tf USING (term) JOIN {p}n n ON n.chunk_id = tf.chunk_id CROSS JOIN {p}c c GROUP BY ALL),
{p}hits AS (SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS "rank", chunk_id, score FROM {p}s) WHERE "rank" <= {k})"""


_GOLD = f"""gold AS (SELECT id, doc_id, answer, loc FROM (
  SELECT CAST(b.item_id AS VARCHAR) AS id, d.doc_id, substring(b.text, 1, 40) AS answer, instr(d.text, b.text) - 1 AS loc, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS r
  FROM benchmark b JOIN docs d ON contains(d.text, b.text)) WHERE r = 1)"""


def _predict(src: str, p: str, name: str) -> str:
    return f"""{name}g AS (SELECT g.id, coalesce(max(CAST(c.doc_id = g.doc_id AS BIGINT)), 0) AS document_hit,
    coalesce(max(CAST(c.doc_id = g.doc_id AND c."start" <= g.loc AND c."end" >= g.loc + length(g.answer) AS BIGINT)), 0) AS span_hit,
    coalesce(1.0 / min(CASE WHEN c.doc_id = g.doc_id THEN h."rank" END), 0.0) AS reciprocal_rank, coalesce(sum(c."end" - c."start"), 0) AS returned_chars
  FROM gold g LEFT JOIN {p}hits h ON h.id = g.id LEFT JOIN {src} c ON c.chunk_id = h.chunk_id GROUP BY g.id),
{name}o AS (SELECT g.id, max(CAST(c."start" <= g.loc AND c."end" >= g.loc + length(g.answer) AS BIGINT)) AS oracle_span FROM gold g JOIN {src} c ON c.doc_id = g.doc_id GROUP BY g.id),
{name} AS (SELECT id, document_hit, span_hit, CAST(reciprocal_rank AS DOUBLE) AS reciprocal_rank, CAST(returned_chars AS BIGINT) AS returned_chars, coalesce(oracle_span, 0) AS oracle_span,
    CASE WHEN span_hit = 1 THEN 'success' WHEN coalesce(oracle_span, 0) = 0 THEN 'chunk_boundary_or_answer_too_long' WHEN document_hit = 0 THEN 'source_not_retrieved' ELSE 'wrong_chunk_from_source' END AS failure
  FROM {name}g LEFT JOIN {name}o USING (id))"""


_BASE_RUN = f"WITH RECURSIVE {_DOCS}, {_QUESTIONS}, {_GOLD}, {_BASE}, {_search('base', 'b')}, {_predict('base', 'b', 'pb')}"
_BOTH_RUN = f"{_BASE_RUN}, {_OVER}, {_search('over', 'v')}, {_predict('over', 'v', 'po')}"
_METRICS = "SELECT count(*) AS n, avg(document_hit) AS document_recall_at3, avg(span_hit) AS span_hit_at3, avg(reciprocal_rank) AS mrr_at3, avg(oracle_span) AS oracle_span_coverage FROM "

# ---- Spark building blocks -----------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA, "source_id string, title string, text string")
    return read_parquet_records(spark, f"{sf_dir}/documents.parquet").unionByName(extra)


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag(records(spark, sf_dir))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted(_flagged(spark, sf_dir))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exact_dedup(_accepted(spark, sf_dir))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"))


#: What hits carry of their chunks.
CHUNK = ("doc_id", "start", "end", "text")


def _hits(spark: SparkSession, sf_dir: str, stride: int = 160, docs: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The hits of all questions. Chunks are cut again from the written documents wherever
    they are read, as that costs less than to write them."""
    rows = ret.chunks(docs or _texts(spark, sf_dir), 160, stride)
    return materialize(ret.search(rows, _questions(spark, sf_dir), 3, k1, b, CHUNK), "hits")


def _top3(hits: DataFrame) -> DataFrame:
    return hits.select("id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_docs(spark, sf_dir).select("doc_id", "text"), "docs")


def _gold(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Items that a document holds verbatim; the least document is its source."""
    q = _questions(spark, sf_dir)
    found = places(docs or _texts(spark, sf_dir), q.select("id", F.col("question").alias("piece")))
    g = found.groupBy("id").agg(F.min(F.struct("doc_id", "at")).alias("g")).join(q, "id")
    return g.select("id", F.col("g.doc_id").alias("doc_id"), F.array(F.struct(F.col("g.at").alias("start"), F.substring("question", 1, 40).alias("text"))).alias("answers"))


def _predicted(spark: SparkSession, sf_dir: str, stride: int, docs: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    docs = docs or _texts(spark, sf_dir)
    gold = gold or materialize(_gold(spark, sf_dir, docs), "gold")
    own = docs.join(small_side(materialize(gold.select("doc_id").distinct(), "sources")), "doc_id", "left_semi")
    p = ret.predictions(_hits(spark, sf_dir, stride, docs), ret.chunks(own, 160, stride), gold)
    return materialize(ret.check_budget(p), "predictions")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents, and both arms' predictions over them and the same gold."""
    docs = _texts(spark, sf_dir)
    gold = materialize(_gold(spark, sf_dir, docs), "gold")
    return docs, _predicted(spark, sf_dir, 160, docs, gold), _predicted(spark, sf_dir, 96, docs, gold)


# ---- quality, dedup, lineage ---------------------------------------------------------


@query(f"WITH {_FLAGGED} SELECT source_id, record_hash, reason FROM flagged")
def quality_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("source_id", "record_hash", "reason")


@query(f"WITH {_FLAGGED} SELECT coalesce(source_id, '') AS source_id, record_hash, reason FROM flagged WHERE reason IS NOT NULL")
def quarantine(spark, sf_dir):
    return quality.quarantined(_flagged(spark, sf_dir))


@query(f"WITH {_ACCEPTED} SELECT source_id, doc_id, title_key FROM accepted")
def accepted_doc_ids(spark, sf_dir):
    return _accepted(spark, sf_dir).select("source_id", "doc_id", "title_key")


@query(f"WITH {_DOCS} SELECT doc_id, title, title_key, text FROM docs")
def exact_dedup(spark, sf_dir):
    return _docs(spark, sf_dir)


@query(f"WITH {_ACCEPTED} SELECT doc_id, source_id, max(title_key) AS title_key FROM accepted GROUP BY ALL")
def lineage(spark, sf_dir):
    return quality.lineage(_accepted(spark, sf_dir))


@query(f"""WITH {_FLAGGED} SELECT *, accepted_rows - documents AS duplicate_rows FROM (SELECT count(*) AS input, count(*) FILTER (reason IS NULL) AS accepted_rows,
  count(DISTINCT CASE WHEN reason IS NULL THEN text END) AS documents, count(*) FILTER (reason IS NOT NULL) AS quarantined FROM flagged)""")
def manifest_counts(spark, sf_dir):
    return quality.manifest_counts(_flagged(spark, sf_dir))


@query(f"WITH {_FLAGGED} SELECT source_id FROM flagged WHERE source_id <> '' GROUP BY 1 HAVING count(DISTINCT record_hash) > 1")
def source_conflicts(spark, sf_dir):
    return quality.source_conflicts(_flagged(spark, sf_dir))


@query(f"WITH {_FLAGGED} SELECT record_hash, substring(record_hash, 1, 2) AS bucket, CAST((row_number() OVER (PARTITION BY substring(record_hash, 1, 2) ORDER BY record_hash) - 1) // 64 AS BIGINT) AS shard FROM flagged")
def shard_assignment(spark, sf_dir):
    return quality.shard_assignment(_flagged(spark, sf_dir))


@query(f"WITH {_FLAGGED} SELECT record_hash FROM flagged EXCEPT ALL SELECT record_hash FROM flagged WHERE reason IS NULL")
def append_only_check(spark, sf_dir):
    f = _flagged(spark, sf_dir)
    return quality.removed_records(f, f.where(F.col("reason").isNull()))


# ---- chunks and retrieval ------------------------------------------------------------


@query(f'WITH {_DOCS}, {_BASE} SELECT chunk_id, doc_id, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", text FROM base')
def chunks_baseline(spark, sf_dir):
    return ret.chunks(_docs(spark, sf_dir), 160, 160)


@query(f'WITH {_DOCS}, {_OVER} SELECT chunk_id, doc_id, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", text FROM over')
def chunks_overlap(spark, sf_dir):
    return ret.chunks(_docs(spark, sf_dir), 160, 96)


@query(f"WITH {_DOCS}, {_BASE}, {_OVER} SELECT 160 AS stride, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM base UNION ALL SELECT 96, count(*), CAST(sum(length(text)) AS BIGINT) FROM over")
def chunk_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    one = lambda s: ret.chunks(docs, 160, s).agg(F.lit(s).alias("stride"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return one(160).unionByName(one(96))


def _normal_base(spark, sf_dir):
    return ret.normal_chunks(ret.chunks(_docs(spark, sf_dir), 160, 160))


@query(f"WITH {_DOCS}, {_BASE}, {_normal('base', 'n')}, {_tf('n', 'tf')} SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def term_frequency(spark, sf_dir):
    return ret.term_statistics(_normal_base(spark, sf_dir)).select("term", "cf")


@query(f"WITH {_DOCS}, {_BASE}, {_normal('base', 'n')}, {_tf('n', 'tf')} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_frequency(spark, sf_dir):
    return ret.term_statistics(_normal_base(spark, sf_dir)).select("term", "df")


@query(f"WITH {_DOCS}, {_BASE}, {_normal('base', 'n')}, {_tf('n', 'tf')}, c AS (SELECT count(*) AS n FROM n) SELECT term, round(ln(1 + (c.n - df + 0.5) / (df + 0.5)), 9) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) CROSS JOIN c")
def idf(spark, sf_dir):
    normal = materialize(_normal_base(spark, sf_dir), "normal")
    n = normal.count()
    return ret.term_statistics(normal).select("term", F.round(ret.idf(F.lit(n), F.col("df")), 9).alias("idf"))


@query(f"WITH {_DOCS}, {_BASE}, {_normal('base', 'n')} SELECT count(*) AS n, round(avg(dl), 9) AS avgdl FROM n")
def avgdl(spark, sf_dir):
    return ret.collection(_normal_base(spark, sf_dir)).select("n", F.round("avgdl", 9).alias("avgdl"))


_HITS = 'SELECT id, "rank", chunk_id, round(score, 6) AS score FROM '


@query(f"WITH {_DOCS}, {_QUESTIONS}, {_BASE}, {_search('base', 'b')} {_HITS} bhits")
def bm25_top3_baseline(spark, sf_dir):
    return _top3(_hits(spark, sf_dir))


@query(f"WITH {_DOCS}, {_QUESTIONS}, {_BASE}, {_search('base', 'b')} {_HITS} bhits")
def bm25_prepared(spark, sf_dir):
    """The same hits from an index that is built once."""
    index = ret.PreparedIndex(ret.chunks(_texts(spark, sf_dir), 160, 160))
    return index.search(_questions(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_DOCS}, {_QUESTIONS}, {_OVER}, {_search('over', 'v')} {_HITS} vhits")
def bm25_top3_overlap(spark, sf_dir):
    return _top3(_hits(spark, sf_dir, 96))


@query(f"WITH {_DOCS}, {_QUESTIONS}, {_BASE}, {_search('base', 'b', 3, 0.5, 0.0)} {_HITS} bhits")
def bm25_tf_saturation(spark, sf_dir):
    return _top3(_hits(spark, sf_dir, k1=0.5, b=0.0))


@query(f"{_BASE_RUN} SELECT * FROM pb")
def predictions(spark, sf_dir):
    return _predicted(spark, sf_dir, 160).drop("doc_id", "answers")


@query(f"{_BASE_RUN} {_METRICS} pb")
def retrieval_metrics(spark, sf_dir):
    return ret.metrics(_predicted(spark, sf_dir, 160))


@query(f"{_BASE_RUN} SELECT failure, count(*) AS n FROM pb GROUP BY failure")
def failure_slices(spark, sf_dir):
    return _predicted(spark, sf_dir, 160).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_BOTH_RUN} SELECT id, CASE WHEN o.span_hit > b.span_hit THEN 'fix' ELSE 'regression' END AS kind FROM pb b JOIN po o USING (id) WHERE o.span_hit <> b.span_hit")
def paired_diff(spark, sf_dir):
    _, one, two = _both(spark, sf_dir)
    return ret.paired(one, two)


@query(f"""{_BOTH_RUN}, m AS (SELECT (SELECT avg(span_hit) FROM po) - (SELECT avg(span_hit) FROM pb) AS g, (SELECT avg(document_hit) FROM pb) - (SELECT avg(document_hit) FROM po) AS d, (SELECT count(*) FROM over) / (SELECT count(*) FROM base) AS r)
SELECT round(g, 9) AS span_gain, round(d, 9) AS recall_drop, round(r, 9) AS chunk_ratio, g >= 0.02 - 1e-12 AND d <= 0.01 + 1e-12 AND r <= 1.8 AS adopted FROM m""")
def adoption_gate(spark, sf_dir):
    docs, p0, p1 = _both(spark, sf_dir)
    g = ret.gate(ret.metrics(p0), ret.metrics(p1), ret.starts(docs, 160, 160), ret.starts(docs, 160, 96))
    return g.select(*[F.round(c, 9).alias(c) for c in ("span_gain", "recall_drop", "chunk_ratio")], "adopted")


@query("SELECT median(n_chars) AS median, CAST(quantile_disc(n_chars, 0.95) AS DOUBLE) AS p95 FROM documents")
def latency_percentiles(spark, sf_dir):
    return ret.latency(spark.read.parquet(f"{sf_dir}/documents.parquet").select("n_chars"), "n_chars")


# ---- families and samples ------------------------------------------------------------


@query(f"WITH {_RECORDS} SELECT source_id, regexp_replace(replace(lower(nfc_normalize(title)), 'ß', 'ss'), '{_WS}', '', 'g') AS title_key FROM records")
def title_key(spark, sf_dir):
    return records(spark, sf_dir).select("source_id", t.title_key("title").alias("title_key"))


_EDGES = "edges AS (SELECT DISTINCT doc_id AS a, b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY title_key) AS b FROM accepted) WHERE doc_id <> b)"


@query(f"WITH {_ACCEPTED}, {_EDGES} SELECT a, b FROM edges")
def same_title_edges(spark, sf_dir):
    return fam.title_edges(quality.lineage(_accepted(spark, sf_dir)))


_GRAMS = "CASE WHEN length(text) < 5 THEN [text] ELSE list_distinct([substring(text, i, 5) for i in range(1, length(text) - 3)]) END"


@query(f"WITH {_DOCS} SELECT doc_id, len({_GRAMS}) AS shingles FROM docs")
def shingle_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(t.shingles("text")).cast("long").alias("shingles"))


@query()
def simhash_exact(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.simhash("text").alias("h"))


_VOTES = ", ".join(f"sum(CAST((h >> {i}) & 1 AS INT)) * 2 >= count(*) AS b{i}" for i in range(64))
_VALUE = " + ".join(f"CASE WHEN b{i} THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
_HASHED = f"hashed AS MATERIALIZED (SELECT doc_id, CAST({_VALUE} AS UBIGINT) AS h FROM (SELECT doc_id, {_VOTES} FROM (SELECT doc_id, CAST('0x' || substring(sha256(g), 1, 16) AS UBIGINT) AS h FROM (SELECT doc_id, unnest({_GRAMS}) AS g FROM docs)) GROUP BY doc_id))"


@query(f"WITH {_DOCS}, {_HASHED} SELECT doc_id, bit_count(h) AS ones, CAST((h >> 48) & 65535 AS BIGINT) AS band3, CAST(h & 65535 AS BIGINT) AS band0 FROM hashed")
def simhash_sha64(spark, sf_dir):
    h = _docs(spark, sf_dir).select("doc_id", t.simhash_sha("text").alias("h"))
    return h.select("doc_id", F.bit_count("h").cast("tinyint").alias("ones"), F.shiftrightunsigned("h", 48).bitwiseAND(65535).alias("band3"), F.col("h").bitwiseAND(65535).alias("band0"))


_NEAR = f"""cand AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM hashed x JOIN hashed y ON x.doc_id > y.doc_id AND bit_count(xor(x.h, y.h)) <= 3),
pairs AS MATERIALIZED (SELECT a, b, ga, {_GRAMS} AS gb FROM (SELECT a, b, {_GRAMS} AS ga FROM cand JOIN docs ON doc_id = a) JOIN docs ON doc_id = b),
near AS MATERIALIZED (SELECT a, b, round(j, 9) AS jaccard FROM (SELECT a, b, len(list_intersect(ga, gb)) AS i, i / (len(ga) + len(gb) - i) AS j FROM pairs) WHERE j >= 0.85)"""


def _near(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    hashed = materialize(docs.select("doc_id", t.simhash_sha("text").alias("h")), "hashes")
    return docs, hashed, materialize(fam.near_pairs(docs, hashed), "near")


@query(f"WITH {_DOCS}, {_HASHED}, {_NEAR} SELECT a, b, jaccard FROM near")
def near_pairs(spark, sf_dir):
    return _near(spark, sf_dir)[2].withColumn("jaccard", F.round("jaccard", 9))


_FAMILIES = f"""{_DOCS}, {_HASHED}, {_NEAR}, {_EDGES}, links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges UNION SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(x, y) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
roots AS (SELECT x AS doc_id, min(y) AS root FROM reach GROUP BY x),
fams AS (SELECT root, sha256(CAST(to_json(list(doc_id ORDER BY doc_id)) AS VARCHAR)) AS family_id FROM roots GROUP BY root),
families AS (SELECT doc_id, family_id FROM roots JOIN fams USING (root))"""


def _families(spark, sf_dir, found=None):
    docs, _, near = found or _near(spark, sf_dir)
    titles = materialize(quality.lineage(_accepted(spark, sf_dir)).select("doc_id", "title_key").distinct(), "titles")
    edges = fam.title_edges(titles).unionByName(near.select("a", "b"))
    return materialize(fam.families(docs, edges), "families")


@query(f"WITH RECURSIVE {_FAMILIES} SELECT doc_id, family_id FROM families")
def families(spark, sf_dir):
    return _families(spark, sf_dir)


@query(f"""WITH RECURSIVE {_FAMILIES} SELECT (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM near) AS near_pairs, (SELECT count(*) FROM families) AS documents,
  (SELECT count(DISTINCT family_id) FROM families) AS families, (SELECT max(n) FROM (SELECT count(*) AS n FROM families GROUP BY family_id)) AS largest""")
def families_audit(spark, sf_dir):
    found = _, hashed, near = _near(spark, sf_dir)
    return fam.audit(hashed, near, _families(spark, sf_dir, found))


_CHOSEN = f"WITH RECURSIVE {_FAMILIES}, chosen AS (SELECT family_id, arg_min(doc_id, sha256('\"question-v1:' || doc_id || '\"')) AS id FROM families GROUP BY family_id)"


def _chosen(spark, sf_dir):
    return fam.one_per_family(_families(spark, sf_dir).select(F.col("doc_id").alias("id"), "family_id"))


@query(f"{_CHOSEN} SELECT family_id, id FROM chosen")
def one_per_family(spark, sf_dir):
    return _chosen(spark, sf_dir)


@query(f"{_CHOSEN} SELECT family_id, id, CASE WHEN r <= 40 THEN 'dev' ELSE 'holdout' END AS split FROM (SELECT *, row_number() OVER (ORDER BY sha256('\"evidence-v1:' || family_id || '\"')) AS r FROM chosen) WHERE r <= 80")
def split_assignment(spark, sf_dir):
    return fam.split_families(_chosen(spark, sf_dir), 40, 40)


_REFS = "refs AS (SELECT CAST(b.item_id AS VARCHAR) AS id, CASE WHEN d.n IS NULL THEN 'empty_or_offset_mismatch' ELSE 'valid' END AS state FROM benchmark b LEFT JOIN (SELECT b.item_id, 1 AS n FROM benchmark b JOIN docs d ON contains(d.text, b.text) GROUP BY 1) d USING (item_id))"


def _references(spark, sf_dir):
    """Every item as a reference to its source, or to nothing at offset 0."""
    q = _questions(spark, sf_dir)
    g = _gold(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("id", "text", "answers")
    j = q.join(g, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("answers", F.array(F.struct(F.lit(0).alias("start"), F.col("question").alias("text")))).alias("answers"))
    return valid_references(j)


@query(f"WITH {_DOCS}, {_REFS} SELECT id FROM refs WHERE state = 'valid'")
def references_valid(spark, sf_dir):
    return _references(spark, sf_dir).where("valid").select("id")


@query(f"WITH {_DOCS}, {_REFS} SELECT id, state AS reason FROM refs WHERE state <> 'valid'")
def reference_audit(spark, sf_dir):
    return _references(spark, sf_dir).where("not valid").select("id", F.lit("empty_or_offset_mismatch").alias("reason"))


@query(f"WITH {_DOCS}, {_GOLD} SELECT d.doc_id FROM docs d WHERE d.doc_id NOT IN (SELECT doc_id FROM gold)")
def withheld_sources(spark, sf_dir):
    """The corpus without the documents that hold a gold span."""
    return _docs(spark, sf_dir).join(_gold(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query(f"""WITH RECURSIVE {_FAMILIES}, asked AS (SELECT family_id, arg_min('q' || r.source_id, sha256('"question-v1:q' || r.source_id || '"')) AS id
  FROM records r JOIN (SELECT DISTINCT source_id, doc_id FROM accepted) a USING (source_id) JOIN families USING (doc_id) WHERE NOT {_blank("substring(r.text, 1, 4)")} GROUP BY family_id)
SELECT family_id, id, CASE WHEN r <= 40 THEN 'dev' ELSE 'holdout' END AS split FROM (SELECT *, row_number() OVER (ORDER BY sha256('"evidence-v1:' || family_id || '"')) AS r FROM asked) WHERE r <= 80""")
def prepared_split(spark, sf_dir):
    """The whole way from paragraphs, each with a question that its first characters
    answer, to a split of 40 + 40 families; those of quarantined ones vanish."""
    first = F.array(F.struct(F.lit(0).alias("start"), F.substring("text", 1, 4).alias("text")))
    asked = records(spark, sf_dir).select("*", F.concat(F.lit("q"), "source_id").alias("id"), first.alias("answers"))
    none = spark.createDataFrame([], "text string, title_key string")
    return prepare(asked, none.select("text"), none.select("title_key"), 40, 40, t.simhash_sha("text")).split


# ---- cited answers; the generator is a column expression ----------------------------

_TEXT_HITS = f"WITH {_DOCS}, {_QUESTIONS}, {_BASE}, {_search('base', 'b')}, h AS (SELECT id, \"rank\", chunk_id, doc_id, \"start\", text FROM bhits JOIN base USING (chunk_id))"
_REPLY = "reply AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'NO_ANSWER' WHEN CAST(id AS BIGINT) % 5 = 1 THEN 'zzzz' WHEN CAST(id AS BIGINT) % 5 = 3 THEN substring(question, 1, 40) ELSE substring(text, 11, 12) END AS answer, CASE WHEN CAST(id AS BIGINT) % 5 = 2 THEN 9 ELSE 1 END AS citation FROM h JOIN questions USING (id) WHERE \"rank\" = 1)"


def _reply(hits: DataFrame, questions: DataFrame) -> DataFrame:
    n = F.col("id").cast("long") % 5
    said = F.when(n == 0, qa.NONE).when(n == 1, "zzzz").when(n == 3, F.substring("question", 1, 40)).otherwise(F.substring("text", 11, 12))
    return hits.where(F.col("rank") == 1).join(questions, "id").select("id", said.alias("answer"), F.when(n == 2, 9).otherwise(1).cast("long").alias("citation"))


_BOUND = f"""{_TEXT_HITS}, {_REPLY}, bound AS (SELECT r.id, CASE WHEN answer = 'NO_ANSWER' THEN 'model_abstained' WHEN {_blank("answer")} OR citation > 3 THEN 'invalid_citation' WHEN instr(text, answer) = 0 THEN 'unsupported_quote' ELSE 'quoted' END AS reason,
  answer AS said, doc_id, chunk_id, CAST("start" + instr(text, answer) - 1 AS BIGINT) AS s FROM reply r LEFT JOIN h ON h.id = r.id AND h."rank" = r.citation)"""


@query(f"{_BOUND} SELECT id, reason, CASE WHEN reason = 'quoted' THEN said ELSE 'NO_ANSWER' END AS answer, CASE WHEN reason = 'quoted' THEN doc_id END AS doc_id, CASE WHEN reason = 'quoted' THEN chunk_id END AS chunk_id, CASE WHEN reason = 'quoted' THEN s ELSE -1 END AS \"start\", CASE WHEN reason = 'quoted' THEN s + length(said) ELSE -1 END AS \"end\" FROM bound")
def citation_binding(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    b = qa.bind_citations(_reply(hits, _questions(spark, sf_dir)), hits)
    return b.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("start", "end")})


def _cite_first(prompt: str) -> str:
    """A generator: twelve characters of the first text of the evidence, in a fence."""
    texts = json.loads(prompt.split("\n", 1)[1])["evidence"]
    reply = {"answer": texts[0]["text"][10:22], "citation": 1} if texts else {"answer": qa.NONE, "citation": 0}
    return f"```json\n{json.dumps(reply, ensure_ascii=False)}\n```"


_SAID = "reply AS (SELECT q.id, coalesce(substring(text, 11, 12), 'NO_ANSWER') AS answer, CASE WHEN text IS NULL THEN 0 ELSE 1 END AS citation FROM questions q LEFT JOIN h ON h.id = q.id AND \"rank\" = 1)"


@query(f"{_BOUND.replace(_REPLY, _SAID)} SELECT id, reason, CASE WHEN reason = 'quoted' THEN said ELSE 'NO_ANSWER' END AS answer, CASE WHEN reason = 'quoted' THEN chunk_id END AS chunk_id FROM bound")
def generated_answers(spark, sf_dir):
    """Evidence, prompt, generator, reply and quote of every question."""
    hits, q = _hits(spark, sf_dir), _questions(spark, sf_dir)
    said = materialize(qa.generate(qa.evidence(q, hits, 3), _cite_first), "replies")
    return qa.bind_citations(said, hits).select("id", "reason", "answer", "chunk_id")


@query(f"""{_TEXT_HITS}, quotes AS (SELECT id, substring(text, 1, 4) AS quote FROM h WHERE "rank" = 1)
SELECT id, doc_id, s AS "start", arg_max(chunk_id, "rank") AS chunk_id FROM (SELECT q.id, doc_id, chunk_id, "rank", CAST("start" + i - 1 AS BIGINT) AS s FROM quotes q JOIN h USING (id), unnest(range(1, length(text) - length(quote) + 2)) r(i) WHERE quote <> '' AND substring(text, i, length(quote)) = quote) GROUP BY ALL""")
def span_occurrences(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return qa.span_occurrences(hits.where(F.col("rank") == 1).select("id", F.substring("text", 1, 4).alias("quote")), hits)


_SCORED = f"""{_BOUND}, {_GOLD}, valid AS (SELECT b.*, b.reason = 'quoted' AND substring(c.text, CAST(b.s - c."start" + 1 AS BIGINT), length(b.said)) = b.said AS ok FROM bound b LEFT JOIN h c ON c.id = b.id AND c.chunk_id = b.chunk_id),
scored AS (SELECT 1 AS k, 'json' AS arm, b.id, g.id IS NOT NULL AS answerable, reason = 'quoted' AS answered, CASE WHEN g.id IS NOT NULL THEN reason = 'quoted' AND said = g.answer ELSE reason <> 'quoted' END AS correct,
  EXISTS (SELECT 1 FROM h WHERE h.id = b.id AND h.doc_id = g.doc_id AND h."start" <= g.loc AND h."start" + length(h.text) >= g.loc + length(g.answer)) AS retrieval_hit,
  coalesce(ok, false) AS quote_valid, coalesce(ok AND b.doc_id = g.doc_id AND said = g.answer AND s = g.loc, false) AS reference_supported FROM valid b LEFT JOIN gold g ON g.id = b.id)"""


def _scored(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    hits, q = _hits(spark, sf_dir, 160, docs), _questions(spark, sf_dir)
    rows = hits.select("chunk_id", *CHUNK).distinct()  # a quote is of a hit
    b = qa.bind_citations(_reply(hits, q), hits).withColumns({"arm": F.lit("json"), "model_calls": F.lit(1)})
    return qa.score(b, materialize(_gold(spark, sf_dir, docs), "gold"), hits, rows)


@query(f"{_SCORED} SELECT arm, id, answerable, answered, correct, retrieval_hit, quote_valid, reference_supported, 1 AS model_calls FROM scored")
def qa_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"""{_SCORED} SELECT arm, count(*) AS n, count_if(answerable) AS answerable, count_if(answered) AS answered, count_if(correct) AS correct, count_if(retrieval_hit) AS retrieval_hit,
  count_if(quote_valid) AS quote_valid, count_if(reference_supported) AS reference_supported, count(*) AS model_calls FROM scored GROUP BY arm""")
def qa_arm_metrics(spark, sf_dir):
    return qa.arm_metrics(_scored(spark, sf_dir))


@query(f"""{_SCORED} SELECT k, count(*) AS n, count(*) FILTER (answerable AND correct) / nullif(count(*) FILTER (answerable), 0) AS em_answerable, count(*) FILTER (answerable AND NOT answered) / nullif(count(*) FILTER (answerable), 0) AS false_refusal,
  count(*) FILTER (NOT answerable AND NOT answered) / nullif(count(*) FILTER (NOT answerable), 0) AS correct_refusal, count(*) FILTER (answered AND reference_supported) / nullif(count(*) FILTER (answered), 0) AS citation_support FROM scored GROUP BY k""")
def qa_metrics(spark, sf_dir):
    return qa.metrics(_scored(spark, sf_dir).withColumns({"k": F.lit(1), "supported": F.col("reference_supported")}))


@query(f"{_SCORED} SELECT k, count(*) FILTER (answered) AS answered, count(*) FILTER (quote_valid) AS quote_valid, count(*) FILTER (reference_supported) AS reference_supported FROM scored GROUP BY k")
def quote_decomposition(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.groupBy(F.lit(1).alias("k")).agg(*[F.count_if(c).alias(c) for c in ("answered", "quote_valid", "reference_supported")])


_STRIP = f"regexp_replace(substring(text, 1, 30), '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"""{_TEXT_HITS}, quotes AS (SELECT id, {_STRIP} AS quote, ['YES', 'NO', 'maybe'][CAST(id AS BIGINT) % 3 + 1] AS verdict FROM h WHERE "rank" = 1),
occ AS (SELECT id, doc_id, s, arg_max(chunk_id, "rank") AS chunk_id FROM (SELECT q.id, doc_id, chunk_id, "rank", CAST("start" + i - 1 AS BIGINT) AS s FROM quotes q JOIN h USING (id), unnest(range(1, length(text) - length(quote) + 2)) r(i) WHERE quote <> '' AND substring(text, i, length(quote)) = quote) GROUP BY ALL),
n AS (SELECT id, count(*) AS n, min(doc_id) AS doc_id, min(chunk_id) AS chunk_id, min(s) AS s FROM occ GROUP BY id),
said AS (SELECT q.id, quote, n.doc_id, n.chunk_id, s, CASE WHEN quote = '' THEN 'empty_answer' WHEN n.n IS NULL THEN 'unsupported_quote' WHEN n.n > 1 THEN 'ambiguous_quote' WHEN verdict = 'NO' THEN 'verifier_rejected' WHEN verdict <> 'YES' THEN 'invalid_verdict' ELSE 'quoted' END AS reason FROM quotes q LEFT JOIN n USING (id))
SELECT id, reason, CASE WHEN reason = 'quoted' THEN quote ELSE 'NO_ANSWER' END AS answer, CASE WHEN reason = 'quoted' THEN chunk_id END AS chunk_id, coalesce(CASE WHEN reason = 'quoted' THEN s END, -1) AS "start",
  CASE WHEN reason IN ('verifier_rejected', 'invalid_verdict', 'quoted') THEN quote END AS candidate, CAST(CASE WHEN reason IN ('verifier_rejected', 'invalid_verdict', 'quoted') THEN 2 ELSE 1 END AS INT) AS model_calls FROM said""")
def span_qa(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    first = hits.where(F.col("rank") == 1)
    quotes = first.select("id", F.concat(F.lit("\n "), F.substring("text", 1, 30), F.lit("\u3000\n")).alias("quote"))
    verdicts = first.select("id", F.concat(F.element_at(F.array(F.lit("YES"), F.lit("NO"), F.lit("maybe")), (F.col("id").cast("long") % 3 + 1).cast("int")), F.lit("\n")).alias("verdict"))
    b = qa.bind_spans(quotes, hits, verdicts)
    return b.select("id", "reason", "answer", "chunk_id", F.coalesce("start", F.lit(-1)).cast("long").alias("start"), "candidate", "model_calls")


# ---- comparisons, samples, timings ---------------------------------------------------


@query(f"""WITH {_DOCS}, {_QUESTIONS}, {_BASE}, {_search('base', 'b')}, two AS (SELECT id, "rank", CASE WHEN CAST(id AS BIGINT) % 5 = 0 AND "rank" = 2 THEN 'x' ELSE chunk_id END AS chunk_id, score + CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 0.5 ELSE 0 END AS score FROM bhits WHERE id <> '3' OR "rank" < 3)
SELECT count(*) AS places, count_if(a.chunk_id IS DISTINCT FROM b.chunk_id) AS other_chunk, count_if(a.score IS NULL OR b.score IS NULL OR abs(a.score - b.score) > greatest(1e-12 * greatest(abs(a.score), abs(b.score)), 1e-12)) AS not_close,
  count_if(abs(a.score - b.score) > 0) AS rounded, round(max(abs(a.score - b.score)), 9) AS max_difference FROM bhits a FULL JOIN two b ON a.id = b.id AND a."rank" = b."rank" """)
def compare_runs(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    n = F.col("id").cast("long")
    two = hits.where((F.col("id") != "3") | (F.col("rank") < 3)).withColumns({"chunk_id": F.when((n % 5 == 0) & (F.col("rank") == 2), "x").otherwise(F.col("chunk_id")), "score": F.col("score") + F.when(n % 7 == 0, 0.5).otherwise(0.0)})
    return verify.compare_hits(hits, two).withColumn("max_difference", F.round("max_difference", 9))


@query(f"""{_BOTH_RUN} SELECT count(*) AS ids, count_if(b.id IS NULL OR o.id IS NULL) AS unmatched, count_if(b.id IS NOT NULL AND o.id IS NOT NULL AND (b.document_hit, b.span_hit, b.reciprocal_rank, b.oracle_span, b.failure) IS DISTINCT FROM (o.document_hit, o.span_hit, o.reciprocal_rank, o.oracle_span, o.failure)) AS different
  FROM pb b FULL JOIN (SELECT * FROM po WHERE CAST(id AS BIGINT) % 6 <> 0) o ON b.id = o.id""")
def compare_predicted(spark, sf_dir):
    """Two runs of which one lacks questions; characters returned pose as timings."""
    _, one, two = _both(spark, sf_dir)
    return verify.compare_predictions(one, two.where(F.col("id").cast("long") % 6 != 0), ("returned_chars",))


_RATES = ("n", "document_recall_at3", "span_hit_at3", "mrr_at3", "oracle_span_coverage")


@query(f"{_BASE_RUN}, m AS ({_METRICS} pb) " + " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) {'+ 0.5' if c == 'mrr_at3' else ''} AS claimed, CAST({c} AS DOUBLE) AS derived, {c != 'mrr_at3'} AS same FROM m" for c in _RATES))
def recheck_metrics(spark, sf_dir):
    """Figures, one of them false, against those that the predictions give."""
    true = materialize(ret.metrics(_predicted(spark, sf_dir, 160)), "metrics")
    return verify.recheck(true.withColumn("mrr_at3", F.col("mrr_at3") + 0.5), true)


@query('SELECT n_nationkey AS place, n_name AS "name", n_regionkey AS region FROM nation')
def zipped(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumnRenamed("n_nationkey", "place")
    z = verify.zip_by_place(n.select("place", "n_name"), n.select("place", "n_regionkey"))
    return z.select("place", F.col("one.n_name").alias("name"), F.col("two.n_regionkey").alias("region"))


@query("SELECT lang AS executor, median(n_chars / (doc_id % 7 + 1)) AS rows_per_second, count(*) AS runs FROM documents GROUP BY lang")
def throughput(spark, sf_dir):
    """Lengths and ids stand in for rows and seconds."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verify.throughput(d.select(F.col("lang").alias("executor"), F.col("n_chars").alias("rows"), (F.col("doc_id") % 7 + 1).alias("seconds")))


@query("""WITH t AS (SELECT id // 30 AS index, (id // 3) % 10 AS round, id % 3 AS place, (CASE WHEN (id // 3) % 10 = 7 THEN 0 ELSE id % 3 END + (id // 3) % 10 // 2) % 3 AS arm FROM range(60) r(id)),
r AS (SELECT index, round, list(arm ORDER BY place) AS ran FROM t GROUP BY ALL)
SELECT index, round, list_sort(ran) = [0, 1, 2] AND coalesce(lag(ran[1]) OVER (PARTITION BY index ORDER BY round) <> ran[1], true) AS valid FROM r""")
def timing_schedule(spark, sf_dir):
    """Rounds whose first arm moves on every second time only, and one of a single arm."""
    turn = F.floor(F.col("id") / 3) % 10
    arm = (F.when(turn == 7, 0).otherwise(F.col("id") % 3) + F.floor(turn / 2)) % 3
    times = spark.range(60).select(F.floor(F.col("id") / 30).alias("index"), turn.alias("round"), (F.col("id") % 3).alias("place"), F.element_at(F.array(*map(F.lit, "abc")), (arm + 1).cast("int")).alias("arm"))
    return verify.valid_schedule(times, ("a", "b", "c"))


@query(f"""WITH {_QUESTIONS}, s AS (SELECT id, row_number() OVER (ORDER BY sha256('["arm-order","' || id || '"]')) - 1 AS place FROM questions QUALIFY place < 24)
SELECT id, CAST(place AS INT) AS place, CAST(turn AS INT) AS turn, ['json', 'span', 'verified_span'][(place + turn) % 3 + 1] AS arm FROM s, range(3) t(turn)""")
def arm_order(spark, sf_dir):
    sample = verify.hash_sample(_questions(spark, sf_dir).select("id"), "arm-order", 24)
    return verify.rotating_arms(sample, ("json", "span", "verified_span"))


@query("""WITH m AS (SELECT lang AS "index", doc_id % 5 AS round, median(n_chars) FILTER (doc_id % 2 = 0) AS b, median(n_chars) FILTER (doc_id % 2 = 1) AS a FROM documents GROUP BY ALL)
SELECT "index", median(b) AS before, median(a) AS after, count_if(a < b) AS faster_rounds, count(*) AS rounds, median(b) / median(a) AS speed_up FROM m GROUP BY "index" """)
def benchmark_summary(spark, sf_dir):
    """Lengths stand in for seconds."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    times = d.select(F.col("lang").alias("index"), (F.col("doc_id") % 5).alias("round"), F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("arm"), F.col("n_chars").cast("double").alias("seconds"))
    return verify.benchmark_summary(times, "old", "new")


_CUT = f"{_CHOSEN}, cut AS (SELECT family_id, CASE WHEN r <= 40 THEN 'dev' ELSE 'holdout' END AS split FROM (SELECT *, row_number() OVER (ORDER BY sha256('\"evidence-v1:' || family_id || '\"')) AS r FROM chosen) WHERE r <= 80)"


@query(f"{_CUT} SELECT split, count(*) AS n, count(DISTINCT family_id) AS families, count(DISTINCT CASE WHEN family_id IN (SELECT family_id FROM cut GROUP BY 1 HAVING count(DISTINCT split) > 1) THEN family_id END) AS shared FROM cut GROUP BY split")
def split_checks(spark, sf_dir):
    return verify.split_checks(materialize(fam.split_families(_chosen(spark, sf_dir), 40, 40), "split"))


@query(f"""WITH RECURSIVE {_FAMILIES}, {_GOLD}, picked AS (SELECT g.id, f.family_id, NOT EXISTS (SELECT 1 FROM docs d WHERE d.doc_id <> g.doc_id AND contains(d.text, g.answer)) AS positive, sha256('["span-set","' || g.id || '"]') AS d FROM gold g JOIN families f USING (doc_id)),
yes AS (SELECT family_id, arg_min(id, d) AS id, min(d) AS d FROM picked WHERE positive GROUP BY 1 ORDER BY min(d) LIMIT 8),
no AS (SELECT family_id, arg_min(id, d) AS id, min(d) AS d FROM picked WHERE NOT positive AND family_id NOT IN (SELECT family_id FROM yes) GROUP BY 1 ORDER BY min(d) LIMIT 4)
SELECT id, family_id, 'positive' AS kind FROM yes UNION ALL SELECT id, family_id, 'negative' FROM no""")
def build_set(spark, sf_dir):
    """Questions whose answer no other document holds, a family each, and others."""
    gold = materialize(_gold(spark, sf_dir), "gold")
    answers = gold.select("id", "doc_id", F.col("answers")[0]["text"].alias("piece"))
    held = contained(_docs(spark, sf_dir).select("doc_id", "text"), answers.select("id", "piece"))
    others = held.join(answers.select("id", F.col("doc_id").alias("own")), "id").where(F.col("doc_id") != F.col("own")).select("id").distinct().withColumn("other", F.lit(True))
    cand = answers.join(_families(spark, sf_dir), "doc_id").join(others, "id", "left").select("id", "family_id", F.col("other").isNull().alias("positive"))
    return verify.disjoint_selection(materialize(cand, "candidates"), "span-set", 8, 4)


@query(f"""{_BASE_RUN}, one AS (SELECT * FROM gold ORDER BY CAST(id AS BIGINT) LIMIT 1)
SELECT o.id, o.doc_id, a.source_id, h."rank", h.chunk_id, b.doc_id = o.doc_id AS from_source FROM one o JOIN (SELECT DISTINCT doc_id, source_id FROM accepted) a USING (doc_id) JOIN bhits h ON h.id = o.id JOIN base b ON b.chunk_id = h.chunk_id""")
def trace(spark, sf_dir):
    """One question to its source, the records that it came from, and its hits."""
    docs = _texts(spark, sf_dir)
    hits = _hits(spark, sf_dir, 160, docs)
    gold = materialize(_gold(spark, sf_dir, docs).select("id", "doc_id"), "gold")
    least = gold.agg(F.min(F.col("id").cast("long")).cast("string").alias("id"))
    one = verify.exactly_one(gold.join(least, "id"), "question")
    edges = quality.lineage(_accepted(spark, sf_dir)).select("doc_id", "source_id")
    found = hits.select("id", "rank", "chunk_id", F.col("doc_id").alias("hit_doc"))
    return one.join(edges, "doc_id").join(found, "id").select("id", "doc_id", "source_id", "rank", "chunk_id", (F.col("hit_doc") == F.col("doc_id")).alias("from_source"))


@query(f"""WITH {_ACCEPTED}, keys AS (SELECT DISTINCT title_key FROM accepted WHERE source_id IN ('0', '50', '100')), kept AS (SELECT * FROM accepted WHERE text NOT IN (SELECT text FROM benchmark) AND title_key NOT IN (SELECT title_key FROM keys))
SELECT (SELECT count(*) FROM accepted) AS raw, (SELECT count(*) FROM accepted) - (SELECT count(*) FROM kept) AS excluded, (SELECT count(*) FROM kept) AS candidates, (SELECT count(*) FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE contains(a.text, b.text))) AS invalid_references""")
def corpus_counters(spark, sf_dir):
    """Records, those whose text or title was seen before, the rest, and bad references."""
    rows = materialize(_accepted(spark, sf_dir), "accepted")
    seen = rows.where(F.col("source_id").isin("0", "50", "100"))
    kept = exclude_seen(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), seen.select("title_key"))
    raw, left = rows.agg(F.count(F.lit(1)).alias("raw")), kept.agg(F.count(F.lit(1)).alias("candidates"))
    bad = _references(spark, sf_dir).agg(F.count_if(~F.col("valid")).alias("invalid_references"))
    return raw.crossJoin(left).crossJoin(bad).select("raw", (F.col("raw") - F.col("candidates")).alias("excluded"), "candidates", "invalid_references")


# ---- the lake and the JSON sources, in the shared folder -----------------------------


def _lake(spark: SparkSession) -> Lake:
    return Lake(spark, shared_path(spark, "lake").removeprefix("file://"))


_PLAIN = f"UNION ALL SELECT * FROM (VALUES {_EXTRA_SQL}) v(source_id, title, text)"


@query(f"WITH {_DOCS.replace(_PLAIN, '')} SELECT doc_id, title, title_key, text FROM docs")
def lake_documents(spark, sf_dir):
    """A version's documents, verified, after it was published."""
    lake = _lake(spark)
    return lake.read(lake.publish(read_parquet_records(spark, f"{sf_dir}/documents.parquet"))["version"])


_COUNTED = "count(*) AS input, count_if(reason IS NULL) AS accepted_rows, count(DISTINCT CASE WHEN reason IS NULL THEN text END) AS documents, count_if(reason IS NOT NULL) AS quarantined FROM flagged"


@query(f"WITH {_FLAGGED.replace(_PLAIN, '')}, c AS (SELECT false AS child, {_COUNTED} WHERE CAST(source_id AS BIGINT) % 2 = 0 UNION ALL SELECT true, {_COUNTED}) SELECT *, accepted_rows - documents AS duplicate_rows FROM c")
def lake_append(spark, sf_dir):
    """Half of the records, then all of them as its child; publishing again adds none."""
    lake, rows = _lake(spark), read_parquet_records(spark, f"{sf_dir}/documents.parquet")
    half = lake.publish(rows.where(F.col("source_id").cast("long") % 2 == 0))["version"]
    whole = lake.publish(rows, half)
    if lake.publish(rows, half) != {"version": whole["version"], "reused_snapshot": True, "resumed_shards": 0, "processed_shards": 0}:
        raise ValueError("publishing again made another version")
    return lake.versions().select(F.col("parent").isNotNull().alias("child"), "input", "accepted_rows", "documents", "quarantined", "duplicate_rows")


@query(f"WITH {_ACCEPTED.replace(_PLAIN, '')} SELECT DISTINCT doc_id, source_id FROM accepted")
def lake_lineage(spark, sf_dir):
    lake = _lake(spark)
    return lake.lineage(lake.publish(read_parquet_records(spark, f"{sf_dir}/documents.parquet"))["version"]).select("doc_id", "source_id")


@query(f"WITH {_RECORDS} SELECT coalesce(source_id, '') AS source_id, title, text FROM records")
def jsonl_round_trip(spark, sf_dir):
    path = shared_path(spark, "jsonl")
    write_jsonl(records(spark, sf_dir), path, ["source_id", "text"])
    return read_jsonl(spark, path).select("source_id", "title", "text")


@query("SELECT lang AS arm, doc_id AS id, n_chars AS value FROM documents")
def appended_results(spark, sf_dir):
    """Even rows, then all: what is there isn't added again."""
    path = shared_path(spark, "results")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("arm"), F.col("doc_id").alias("id"), F.col("n_chars").alias("value"))
    append_results(rows.where("id % 2 = 0"), path)
    return append_results(rows, path)


@query("SELECT true AS same")
def executor_parity(spark, sf_dir):
    """The documents' digest as they come and dealt to other partitions."""
    d = _docs(spark, sf_dir)
    same = table_digest(d) == table_digest(d.repartition(7))
    return spark.range(1).select(F.lit(same).alias("same"))


@query(f"WITH {_DOCS}, {_BASE} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM base) AS chunks")
def asset_summary(spark, sf_dir):
    d = materialize(_docs(spark, sf_dir), "docs")
    return d.agg(F.count(F.lit(1)).alias("documents")).crossJoin(ret.chunks(d).agg(F.count(F.lit(1)).alias("chunks")))
