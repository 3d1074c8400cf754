"""Steps that look at every character: right on odd texts, and bounded in what they return."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from corvine.functions import text as t
from corvine.operators import retrieval as ret
from corvine.operators.containment import places

ODD = ["Straße ŉǰﬃ Ｚ１", "é x", "", "각 가", "😀ßß!", "  ", "İi̇ K", "abc" * 30, "ﬁ" * 9]


def normal(s):
    return "".join(c.casefold() for c in unicodedata.normalize("NFC", s) if c.isalnum())


def test_letters_are_those_of_the_normal_text():
    pa = pytest.importorskip("pyarrow")
    from corvine.functions.points import letters, numbered

    column = pa.array(["cut", *ODD, None, "cut"]).slice(1, len(ODD) + 1)
    at, row = letters(column)
    got = ["".join(map(chr, at[row == i])) for i in range(len(column))]
    assert got == [normal(s) for s in ODD] + [""]
    known = sorted(map(ord, set("stmi̇é각")))
    number, row2 = letters(column, number=numbered(known))
    assert row2.tolist() == row.tolist() and [known.index(c) + 1 if c in known else 0 for c in at.tolist()] == number.tolist()


def test_search_carries_chunks_and_a_task_returns_k_a_question(spark):
    texts = ODD + [f"text {i % 37} straße {i % 11}" for i in range(9000)]
    rows = spark.createDataFrame([(f"c{i:04d}", s, i) for i, s in enumerate(texts)], "chunk_id string, text string, place int").coalesce(1)
    asked = spark.createDataFrame([("1", "STRASSE 5"), ("2", "각 e"), ("3", "text 36")], "id string, question string")
    hits = ret.search(rows, asked, 3, carry=("place", "text"))
    got = hits.collect()
    assert all(texts[r["place"]] == r["text"] and r["chunk_id"] == f"c{r['place']:04d}" for r in got)
    assert sorted((r["id"], r["rank"]) for r in got) == [(q, r) for q in "123" for r in (1, 2, 3)]
    block = [r.asDict() for r in asked.select("id", t.normal_text("question").alias("normal")).collect()]
    terms = ret.Terms(block)
    assert terms.best(rows, "text", False, *terms.statistics(rows, "text", False), 3, 1.2, 0.75).count() == 9  # three batches


def test_terms_count_once_each_where_frequency_has_no_weight(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", "x"), ("c", "")], "chunk_id string, text string")
    got = ret.search(rows, spark.createDataFrame([("q", "x")], "id string, question string"), 3, k1=0.0).collect()
    assert [r["chunk_id"] for r in got] == ["a", "b"] and got[0]["score"] == got[1]["score"] > 0


@pytest.mark.parametrize(("size", "stride"), [(10, 10), (10, 6), (7, 1)])
def test_starts_are_those_of_chunks(spark, size, stride):
    d = spark.createDataFrame([(str(i), "😀" * i) for i in range(40)] + [("null", None)], "doc_id string, text string")
    want = ret.chunks(d, size, stride).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, ret.starts(d, size, stride).groupBy("doc_id").count().collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_places_of_pieces(spark, monkeypatch, most):
    monkeypatch.setattr("corvine.operators.containment.KEYS", most)
    texts = ["one two  three four", "xone two", "\n two", "😀 one two three", "twoone", "", "a b c " * 40 + "one\ttwo"]
    pieces = ["one two", "e two", "two", " two", "one\ttwo", "😀", "e two  three f", "a b c a b c a b c a b c a b c a b c", "zz", "c d", "o t"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "doc_id long, text string")
    p = spark.createDataFrame([(str(i), s) for i, s in enumerate(pieces)], "id string, piece string")
    got = sorted((r["doc_id"], r["id"], r["at"]) for r in places(d, p).collect())
    assert got == sorted((i, str(j), s.find(x)) for i, s in enumerate(texts) for j, x in enumerate(pieces) if x in s)


def test_rules_find_what_their_patterns_find(spark):
    texts = ["a@b.cd", "@", "x 15912345670", "+86 15912345670.", "115912345670", "159123456701", "１5912345670", "15９１２３４５６７０", "a@b", "　\x1c ", "", "​", "é"]
    d = spark.createDataFrame([(s,) for s in [*texts, None]], "text string").select("*", F.lit("t").alias("title"), F.lit("1").alias("source_id"))
    from corvine.operators import quality

    slow = F.when(F.col("text").isNull(), "schema").when(F.regexp_replace("text", t.SPACE, "") == "", "empty").when(F.col("text").rlike(t.EMAIL) | F.col("text").rlike(t.PHONE), "suspected_contact_pattern")
    assert [r["reason"] for r in quality.flag(d).collect()] == [r["x"] for r in d.select(slow.alias("x")).collect()]


@pytest.mark.parametrize("kind", ["sha256", "blake2b"])
def test_simhash_of_arrays_is_that_of_each_text(kind, monkeypatch):
    import pyarrow as pa

    from corvine.functions import shingles as sh

    monkeypatch.setattr(sh, "CHARS", 3000)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))  # more characters than a worker numbers
    texts = ["", "a", "abcd", "abcde", None, "ab\0" * 300, wide, "😀ß" * 700, wide[:4000], wide[1000:], "x" * 3000]
    assert sh.simhash_all(pa.array(texts), kind, lambda s: t._simhash(s, kind)) == [t._simhash(s, kind) for s in texts]
    grams = lambda s: {s} if len(s) < 5 else {s[i : i + 5] for i in range(len(s) - 4)}
    for a in filter(None, texts):
        for b in ("", wide, "abcdx", texts[7]):
            assert sh.overlap(a, b) == (len(grams(a)), len(grams(b)), len(grams(a) & grams(b)))


def test_publishing_reads_each_table_once_for_its_digest_and_counts_documents(spark, tmp_path, monkeypatch):
    from corvine.plans import lake as module

    rows = spark.createDataFrame([(str(i), "t", f"text {i % 5}" if i else "a@b.cd") for i in range(12)], "source_id string, title string, text string")
    made, digest = [], module.table_digest
    monkeypatch.setattr(module, "table_digest", lambda d: made.append(d.columns) or digest(d))
    lake = module.Lake(spark, tmp_path)
    first = lake.publish(rows)
    assert len(made) == 5  # the input's, and one a table
    assert lake.publish(rows) == {**first, "reused_snapshot": True, "processed_shards": 0} and len(made) == 10
    got = lake.versions().first().asDict()
    assert {k: got[k] for k in ("input", "accepted_rows", "documents", "quarantined", "duplicate_rows")} == {"input": 12, "accepted_rows": 11, "documents": 5, "quarantined": 1, "duplicate_rows": 6}
