"""Comparisons, samples, containment and the shared folder, on literal fixtures."""

import hashlib
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvine.operators import verify
from corvine.operators.containment import contained
from corvine.operators.components import connected_components, join_labels
from corvine.operators.skew import spread_join
from corvine.session import shared_dir


def test_close_needs_finite_numbers(spark):
    rows = [(1.0, 1.0 + 1e-13, True), (1.0, 1.0 + 1e-9, False), (0.0, 1e-13, True), (float("nan"), float("nan"), False), (float("inf"), float("inf"), False), (None, 1.0, False)]
    d = spark.createDataFrame(rows, "a double, b double, want boolean")
    assert d.where(verify.close(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_runs_are_compared_place_by_place(spark):
    one = spark.createDataFrame([("q", 1, "a", 2.0), ("q", 2, "b", 1.0), ("r", 1, "c", 1.0)], "id string, rank long, chunk_id string, score double")
    two = spark.createDataFrame([("q", 1, "a", 2.0), ("q", 2, "x", 1.5)], "id string, rank long, chunk_id string, score double")
    assert verify.compare_hits(one, two).first().asDict() == {"places": 3, "other_chunk": 2, "not_close": 2, "rounded": 1, "max_difference": 0.5}
    assert verify.exactly_one(one.where("id = 'r'"), "row").count() == 1
    for bad in (one, one.limit(0)):
        with pytest.raises(PySparkException):
            verify.exactly_one(bad, "row").collect()


def test_selection_takes_no_family_twice(spark):
    rng = random.Random(3)
    rows = [(str(i), f"f{rng.randrange(12)}", rng.random() < 0.5) for i in range(60)]
    digest = lambda i: hashlib.sha256(json.dumps(["s", i], separators=(",", ":")).encode()).hexdigest()
    used, want = set(), []
    for kind, most in (("positive", 5), ("negative", 4)):
        n = 0
        for i, f, yes in sorted(rows, key=lambda r: digest(r[0])):
            if n < most and f not in used and yes == (kind == "positive"):
                used.add(f)
                want.append((i, f, kind))
                n += 1
    got = verify.disjoint_selection(spark.createDataFrame(rows, "id string, family_id string, positive boolean"), "s", 5, 4)
    assert sorted((r["id"], r["family_id"], r["kind"]) for r in got.collect()) == sorted(want)


def test_arms_rotate_and_timings_are_summed_up(spark):
    sample = verify.hash_sample(spark.createDataFrame([(str(i),) for i in range(9)], "id string"), "x", 4)
    first = {r["place"]: r["arm"] for r in verify.rotating_arms(sample, ("a", "b", "c")).where("turn = 0").collect()}
    assert first == {0: "a", 1: "b", 2: "c", 3: "a"}
    times = [("i", r, arm, s * (1 + r)) for r in range(3) for arm, s in (("old", 4.0), ("new", 2.0), ("old", 6.0))]
    got = verify.benchmark_summary(spark.createDataFrame(times, "index string, round int, arm string, seconds double"), "old", "new").first()
    assert (got["before"], got["after"], got["speed_up"], got["faster_rounds"], got["rounds"]) == (10.0, 4.0, 2.5, 3, 3)


def test_pieces_are_found_where_they_stand(spark):
    rng = random.Random(4)
    words = ["ab", "cd", "ef", "gh", "\u4e2d", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["", "one\ttwo\nthree four five six"]
    pieces = [t[a : a + rng.randrange(1, 30)] for t in texts if t for a in [rng.randrange(len(t))]] + ["wo\nthree fo", "no such", "ab"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = contained(docs, spark.createDataFrame([(str(i), p) for i, p in enumerate(pieces)], "id string, piece string"))
    want = sorted((str(i), str(k)) for i, t in enumerate(texts) for k, p in enumerate(pieces) if p in t)
    assert sorted((r["doc_id"], r["id"]) for r in got.collect()) == want


def test_labels_follow_further_edges(spark):
    edges = lambda *e: spark.createDataFrame([*e], "a long, b long")
    labels = connected_components(edges((5, 6), (8, 9)))
    more = join_labels(labels, edges((6, 8), (1, 2), (9, 5)))
    assert {r["node"]: r["label"] for r in more.collect()} == {5: 5, 6: 5, 8: 5, 9: 5, 1: 1, 2: 1}
    assert join_labels(more, edges((5, 9))).count() == 6


def test_hot_keys_are_spread_and_lose_nothing(spark):
    left = spark.range(6000).select((F.when(F.col("id") < 4000, 0).otherwise(F.col("id"))).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 2 = 0")
    for how in ("inner", "left_semi"):
        assert spread_join(left, right, ["k"], how, "n", 6000, ["id"]).count() == 5000


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    for master, fine in (("spark://host:7077", False), ("yarn", False), ("local-cluster[2,1,1024]", False)):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf=Conf(), sparkContext=context))
