"""Near candidates, the prepared index, preparation, comparisons, results, commands."""

import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException

from corvine import __main__ as cli
from corvine.operators import families as fam
from corvine.operators import qa, verify
from corvine.operators import retrieval as ret
from corvine.plans.dataset import prepare, with_probes
from corvine.plans.lake import Lake
from corvine.sources.records import write_jsonl
from corvine.sources.results import append_results, freeze, pinned_files, render_trace


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_near_hashes_are_all_found(spark, bits):
    rng = random.Random(bits)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    for h in hashes[:30]:
        for flips in range(1, 6):
            hashes.append(h ^ sum(1 << i for i in rng.sample(range(64), flips)))
    hashes += hashes[:3]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = fam.near_candidates(spark.createDataFrame([(f"{i:03d}", h) for i, h in enumerate(signed)], "doc_id string, h long"), bits)
    want = sorted((f"{i:03d}", f"{j:03d}") for i in range(len(hashes)) for j in range(i) if (hashes[i] ^ hashes[j]).bit_count() <= bits)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want


def test_prepared_index_finds_what_search_finds(spark):
    rng = random.Random(8)
    rows = [(f"c{i:03d}", "".join(rng.choice("abcde 中文é") for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    asked = spark.createDataFrame([("1", "abc 中"), ("2", "zz"), ("3", "!?"), ("4", "e e e")], "id string, question string")
    index = ret.PreparedIndex(chunks)
    for k in (0, 1, 5):
        one, two = (sorted(map(tuple, d.collect())) for d in (ret.search(chunks, asked, k), index.search(asked, k)))
        assert [r[:3] for r in one] == [r[:3] for r in two] and [r[3] for r in two] == pytest.approx([r[3] for r in one])
    assert index.search(asked.limit(0)).count() == 0
    assert ret.PreparedIndex(chunks.limit(0)).search(asked).count() == 0
    with pytest.raises(ValueError):
        index.search(asked, -1)


QUESTIONS = "source_id string, title string, text string, id string, question string, answers array<struct<start int, text string>>"


def test_prepare_drops_seen_and_bad_and_splits_families(spark):
    text = lambda i: f"paragraph {i} " + hashlib.sha256(str(i).encode()).hexdigest() * 3
    rows = [(f"s{i}", f"title {i}", text(i), f"q{i}", "?", [(0, "paragraph")]) for i in range(8)]
    rows += [("s8", "title 0", text(8), "q8", "?", [(0, "paragraph")]), ("s9", "t9", text(9), "q9", "?", [(3, "paragraph")])]
    rows += [("s10", "t10", "call 15912345670 now", "q10", "?", [(0, "call")]), ("s11", "Seen", text(11), "q11", "?", [(0, "paragraph")]), ("s12", "t12", text(12), None, None, None)]
    q = spark.createDataFrame(rows, QUESTIONS)
    texts, titles = spark.createDataFrame([(text(7),)], "text string"), spark.createDataFrame([("seen",)], "title_key string")
    made = prepare(q, texts, titles, 3, 4)
    assert made.counts == {"raw_paragraphs": 13, "excluded": 2, "candidates": 11, "accepted": 10, "documents": 10, "near_pairs": 0, "families": 9, "question_families": 7, "invalid_references": 1}
    split = made.split.collect()
    assert sorted(r["split"] for r in split) == ["dev"] * 3 + ["holdout"] * 4
    assert not {"q7", "q9", "q10", "q11"} & {r["id"] for r in split} and len({"q0", "q8"} & {r["id"] for r in split}) == 1
    with pytest.raises(ValueError, match="7 families"):
        prepare(q, texts, titles, 4, 4)


def test_predictions_and_figures_are_compared(spark):
    kind = "id string, hit long, failure string, seconds double"
    one = spark.createDataFrame([("a", 1, None, 0.1), ("b", 0, "x", 0.2), ("c", 1, None, 0.3)], kind)
    two = spark.createDataFrame([("a", 1, None, 0.9), ("b", 0, None, 0.2), ("d", 1, None, 0.3)], kind)
    assert verify.compare_predictions(one, two).first().asDict() == {"ids": 4, "unmatched": 2, "different": 1}
    with pytest.raises(ValueError):
        verify.compare_predictions(one, two.drop("hit"))
    figures = spark.createDataFrame([(3, 0.5, None)], "n long, rate double, none double")
    got = {r["metric"]: r["same"] for r in verify.recheck(spark.createDataFrame([(3, 0.5 + 1e-6, None)], "n long, rate double, none double"), figures).collect()}
    assert got == {"n": True, "rate": False, "none": True}


def test_sequences_of_one_length_are_zipped(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "place long, x string")
    assert [(r["one"]["x"], r["two"]["x"]) for r in verify.zip_by_place(rows, rows).orderBy("place").collect()] == [("a", "a"), ("b", "b")]
    with pytest.raises(PySparkException):
        verify.zip_by_place(rows, rows.limit(1)).collect()


def test_throughput_and_schedule(spark):
    runs = spark.createDataFrame([("x", 10, 1.0), ("x", 10, 2.0), ("x", 10, 5.0)], "executor string, rows long, seconds double")
    assert tuple(verify.throughput(runs).first()) == ("x", 5.0, 3)
    plan = [("i", r, p, a) for r, order in enumerate(("ab", "ba", "ba", "aa")) for p, a in enumerate(order)]
    got = verify.valid_schedule(spark.createDataFrame(plan, "index string, round int, place int, arm string"), ("a", "b"))
    assert [r["valid"] for r in got.orderBy("round").collect()] == [True, True, False, False]


def test_results_grow_and_files_are_pinned(spark, tmp_path):
    kind, where = "arm string, id string, v long", str(tmp_path / "results")
    first = append_results(spark.createDataFrame([("x", "1", 1), ("x", "1", 1)], kind), where)
    assert first.count() == 1
    again = append_results(spark.createDataFrame([("x", "1", 9), ("y", "1", 2)], kind), where)
    assert sorted(map(tuple, again.collect())) == [("x", "1", 1), ("y", "1", 2)]
    f = tmp_path / "f.bin"
    f.write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    assert pinned_files(spark, {str(f): digest}).first()["sha256"] == digest
    with pytest.raises(PySparkException):
        pinned_files(spark, {str(f): "0" * 64}).collect()
    with pytest.raises(ValueError):
        pinned_files(spark, {})
    shown = render_trace("why?", [{"source_id": "s", "doc_id": "d", "rank": r, "chunk_id": f"c{r}", "from_source": r == 1} for r in (2, 1)])
    assert shown.splitlines()[0] == "# why?" and "| 1 | `c1` | yes |\n| 2 | `c2` | no |" in shown


def say(prompt: str) -> str:
    if prompt.startswith("Does"):
        return "YES\n"
    return json.dumps({"answer": "blue whale", "citation": 1}) if '"evidence"' in prompt else "blue whale"


def test_commands_publish_search_and_answer(spark, tmp_path, capsys):
    rows = [("1", "Whales", "The largest animal is the blue whale."), ("2", "Ants", "Ants are small."), ("3", "Bad", None)]
    write_jsonl(spark.createDataFrame(rows, "source_id string, title string, text string"), str(tmp_path / "in"), ["source_id"])
    lake = str(tmp_path / "lake")
    cli.main(["ingest", "--input", str(tmp_path / "in"), "--lake", lake])
    version = json.loads(capsys.readouterr().out)["version"]
    cli.main(["versions", "--lake", lake])
    told = json.loads(capsys.readouterr().out)
    assert (told["version"], told["input"], told["documents"], told["quarantined"]) == (version, 3, 2, 1)
    at = ["--lake", lake, "--version", version]
    cli.main(["chunks", *at])
    assert json.loads(capsys.readouterr().out) == {"chunks": 2, "chars": 52}
    ask = [*at, "--question", "largest animal", "-k", "1"]
    cli.main(["search", *ask])
    assert "blue whale" in json.loads(capsys.readouterr().out)["text"]
    for mode, calls in (("json", None), ("span", 1), ("verified_span", 2)):
        cli.main(["answer", *ask, "--mode", mode, "--generator", "tests.test_operators:say"])
        got = json.loads(capsys.readouterr().out)
        assert (got["reason"], got["answer"], got["start"], got.get("model_calls")) == ("quoted", "blue whale", 26, calls)
    for bad in (["ingest", "--lake", lake], ["search", *at, "--question", "x", "-k", "0"], ["answer", *ask, "--mode", "other", "--generator", "a:b"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def test_lake_lists_exports_and_rejects(spark, tmp_path):
    lake = Lake(spark, tmp_path / "lake")
    rows = spark.createDataFrame([("1", "t", "one"), ("2", "t", "one")], "source_id string, title string, text string")
    version = lake.publish(rows)["version"]
    assert sorted(r["source_id"] for r in lake.lineage(version).collect()) == ["1", "2"]
    doc = lake.read(version).first()["doc_id"]
    assert lake.lineage(version, doc).count() == 2 and lake.lineage(version, "none").count() == 0
    assert lake.export(version, tmp_path / "out").joinpath("manifest.json").is_file()
    with pytest.raises(FileExistsError):
        lake.export(version, tmp_path / "out")
    for bad in (lambda: lake.publish(rows.drop("title")), lambda: lake.publish(rows, "")):
        with pytest.raises(ValueError):
            bad()


def test_answers_on_two_versions(spark):
    kind = "id string, answer string, reason string"
    before = spark.createDataFrame([("1", "a", "quoted"), ("2", "b", "quoted")], kind)
    after = spark.createDataFrame([("1", "a", "quoted"), ("2", "c", "quoted"), ("3", "d", "quoted")], kind)
    assert {r["id"]: r["changed"] for r in qa.answer_changes(before, after).collect()} == {"1": False, "2": True, "3": True}


def test_configurations_are_frozen_and_probes_added(spark, tmp_path):
    at = tmp_path / "frozen.json"
    assert freeze(at, {"k": 3, "name": "é"}) == freeze(at, {"name": "é", "k": 3})
    with pytest.raises(ValueError):
        freeze(at, {"k": 4, "name": "é"})
    at.write_text(at.read_text().replace('"k": 3', '"k": 5'))
    with pytest.raises(ValueError):
        freeze(at, {"k": 5, "name": "é"})
    asked = with_probes(spark.createDataFrame([("1", "where?")], "id string, question string"), ["who?", "when?"])
    assert sorted((r["id"], r["answerable"]) for r in asked.collect()) == [("1", True), ("probe:0", False), ("probe:1", False)]
