"""The ten operators and the pipeline on small fixtures, against plain Python."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvine.llm import ann, bpe, line_dedup, mixing, ngram_join, quality_gam, quality_rules, secret_scan, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "one two", "ABC abc 😀 é", "x " * 3000, "same words here again\n" * 40, "same words here again\n" * 40]


# ---- 1 -------------------------------------------------------------------------------


def brute_nearest(vecs, k=20):
    ok = {i: np.array(v, float) for i, v in vecs if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float((ok[q] * ok[i]).sum()), i) for i in ok if i != q))[:k]
    return out


@pytest.mark.parametrize("leaf", [1024, 64])
def test_neighbours_with_copies_ties_and_unusable_vectors(spark, leaf):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(400)]
    vecs += [(i, [1.0] + [0.0] * 7) for i in range(400, 500)]  # copies: ties by id
    vecs += [(600, None), (620, [0.0] * 8), (640, [None] + [1.0] * 7), (660, [float("nan")] + [1.0] * 7), (680, []), vecs[3]]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, leaf=leaf, probes=None if leaf == 1024 else 200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(vecs)
    assert got.keys() == want.keys()
    hit = []
    for q, r in got.items():
        assert [x[0] for x in sorted(r)] == list(range(1, 21))
        hit.append(len({x[1] for x in r} & {i for _, i in want[q]}) / 20)
    assert np.mean(hit) == 1.0 if leaf == 1024 else np.mean(hit) > 0.9
    assert [x[1] for x in sorted(got[400])] == [i for _, i in want[400]]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]


def test_few_leaves_find_the_neighbours_of_clustered_doubles(spark):
    """12 of some 380 leaves are probed, against brute force over everything."""
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((60, 16)) * 3
    x = np.concatenate([m + 0.3 * rng.standard_normal((60, 16)) for m in middle])
    vecs = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, leaf=64, probes=12).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    want = brute_nearest(vecs)
    assert got.keys() == want.keys() and np.mean([len(got[q].keys() & {i for _, i in w}) / 20 for q, w in want.items()]) > 0.9
    assert all(abs(s - float((x[q] * x[i]).sum())) < 1e-12 for q, g in got.items() for i, s in g.items())


def test_probes_are_tuned_to_the_recall_that_is_asked(spark):
    x = np.random.default_rng(2).standard_normal((4000, 32)).astype(np.float32)
    f = ann.fit_forest(ann.lift(x, 8.0), len(x), 4, 256)
    p = ann.tune_probes(f, x, 20)
    leaves = f.leaves(ann.lift(x, float(np.linalg.norm(x.astype(float), axis=1).max())))
    hit = []
    for i in range(0, 4000, 100):
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -np.inf
        seen = set(f.probe(ann.lift_query(x[i : i + 1])[0], p))
        hit += [any((t, leaves[j, t]) in seen for t in range(4)) for j in np.argsort(-s)[:20]]
    assert np.mean(hit) > 0.9


def test_probes_are_tuned_where_a_long_vector_outside_of_the_sample_puts_the_index(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 32)) + 1.0
    x *= (rng.uniform(0.8, 1, 4000) / np.linalg.norm(x, axis=1))[:, None]
    x[-1] *= 2.0 / np.linalg.norm(x[-1])
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert 3999 not in {r["vec_id"] for r in df.orderBy(F.xxhash64("embedding")).limit(1000).collect()}
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, leaf=64, sample=1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(list(enumerate(x)))
    assert np.mean([len(got[q] & {i for _, i in w}) / 20 for q, w in want.items()]) > 0.93


def test_marks_are_the_leaves_that_the_shared_queue_visits():
    x = np.random.default_rng(8).standard_normal((2000, 8)).astype(np.float32)
    f = ann.fit_forest(ann.lift(x, 8.0), len(x), 3, 64)
    q = ann.lift_query(x[:40])
    every = 3 << f.depth
    for probes in (1, 3, 17, every):
        marked = np.unpackbits(f.marks(q, probes), axis=1, count=every)
        for i in range(40):
            assert {divmod(int(at), 1 << f.depth) for at in np.flatnonzero(marked[i])} == set(f.probe(q[i], probes))


@pytest.mark.parametrize("tile", [1 << 22, 64])
def test_best_of_a_block_keeps_ties_whatever_is_held_at_once(monkeypatch, tile):
    monkeypatch.setattr(ann, "TILE", tile)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 4)).astype(np.float64)  # few distinct scores
    x = np.concatenate([x[np.abs(x).max(1) > 0], rng.standard_normal((200, 4))])
    q, first = x[:70], rng.permutation(len(x))
    leaves = rng.integers(0, 12, (len(x), 2)) + [0, 12]
    held = [(leaf, np.flatnonzero((leaves == leaf).any(1))) for leaf in range(24)]
    marked = rng.random((24, len(q))) < 0.4
    least = np.where(np.arange(len(q)) % 2, -np.inf, 0.5)
    before = least.copy()
    a, b, s = ann._best(q, marked, x, ann.lift(x, 20.0)[:, :-1], first, held, least, 20.0, 7)
    for i in range(len(q)):
        seen = [j for j in range(len(x)) if marked[leaves[j], i].any()]
        want = sorted((-float((q[i] * x[j]).sum()), int(first[j])) for j in seen)
        want = [w for w in want if -w[0] >= before[i]][:7]
        assert sorted((-float(t), int(first[j])) for t, j in zip(s[a == i], b[a == i], strict=True)) == want
        assert least[i] == (-want[6][0] if len(want) == 7 else before[i])


def test_searching_holds_a_row_a_query_and_bounded_blocks_and_rounds(spark, monkeypatch):
    """Not a row for each query and leaf it probes: executors failed by that."""
    monkeypatch.setattr(ann, "BLOCK_BYTES", 4 * 8 * 100)  # 100 vectors
    monkeypatch.setattr(ann, "ROUND_BYTES", 2000)
    rows, materialize = {}, ann.materialize

    def counted(df, name="table", batch_rows=None):
        out = materialize(df, name, batch_rows)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ann, "materialize", counted)
    rng = np.random.default_rng(9)
    vecs = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(1500)]
    vecs += [(i, [0.5, 0.25] * 4) for i in range(1500, 1600)] + [(i, [float(x) for x in np.eye(8)[i % 8]]) for i in range(1600, 1700)]
    odd = [(i, [float(i)]) for i in range(3000, 3004)] + vecs[:30]  # another length, and repeated rows
    df = spark.createDataFrame(vecs + odd, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, leaf=32, probes=10_000).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(vecs)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()}
    assert all(s == -w for q, r in got.items() for (_, s), (w, _) in zip(r, want[q], strict=True))
    assert rows["visits"] == [75 + 1 + 2] and len(rows["found"]) > 3
    assert ann.nearest(df, F.col("vec_id") < 0).count() == 0


# ---- 2 -------------------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    trans = rng.standard_normal((2, 2))
    counts = np.array([0, 5, 1, 70, 0, 33])
    odds = np.exp(rng.standard_normal(counts.sum()))
    got, pair = toxicity.forward_backward(odds, counts, trans)
    a, at, total = np.exp(trans), 0, np.zeros((2, 2))
    for n in counts:
        x = odds[at : at + n]
        f, b = [np.array([1.0, 0.0])], [np.ones(2)]
        for v in x:
            w = (f[-1] @ a) * [1, v]
            f.append(w / w.sum())
        for v in x[::-1]:
            w = a @ (b[-1] * [1, v])
            b.append(w / w.sum())
        b = b[::-1]
        for t in range(n):
            m = f[t + 1] * b[t + 1]
            assert abs(got[at + t] - m[1] / m.sum()) < 1e-9
            q = f[t][:, None] * a * ([1, x[t]] * b[t + 1])[None, :]
            total += q / q.sum()
        at += n
    assert np.allclose(pair, total)


def toxic_set(spark, n=400):
    rng = random.Random(4)
    texts, toxic = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = prose(40, rng).split()
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["dreadful", "rotten"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return texts, toxic, labels


def test_toxicity_learns_scores_and_finds_spans(spark):
    texts, toxic, labels = toxic_set(spark)
    d = docs(spark, texts + ODD)
    got = rows(toxicity.toxicity_scores(d, labels))
    assert len(got) == len(texts) + len(ODD)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    model = toxicity.fit_toxicity(d, labels)
    text = "Some rotten words, and then é Dreadful ones."
    assert [text[a:b] for a, b, _ in toxicity.toxic_spans(model, text)] == ["rotten", "Dreadful"]
    odd = "\u0130\u0130 \u00e9 rotten \U0001f600 rotten rotten, DREADFUL \u0130"  # lower-casing a dotted I adds a code point
    want = [(m.start(), m.end()) for m in re.finditer("rotten rotten|rotten|DREADFUL", odd)]
    one, many = toxicity.toxic_spans(model, odd), toxicity.judge(model, ["", odd, None, "x " * 200_000 + odd, odd])
    joined = [(x, y) for x, y, _ in one]
    assert joined[0] == want[0] and joined[-1][1] == want[-1][1] and {x for x, _ in joined} <= {x for x, _ in want}
    assert many[1][0] == many[1][2] == [] and many[1][1] == many[1][4] == one
    assert [(x - 400_000, y - 400_000) for x, y, _ in many[1][3]] == joined
    twice = toxicity.score_toxicity(d.unionByName(d), model).groupBy("doc_id").agg(F.count_distinct("score").alias("n"), F.count("score").alias("m")).collect()
    assert {(r["n"], r["m"]) for r in twice} == {(1, 2)}
    scored = toxicity.score_toxicity(d.withColumn("score", F.lit("old")), model, spans=True)
    assert scored.columns[-3:] == ["score", "predicted", "toxic_spans"] and scored.count() == d.count()


def test_toxicity_of_a_batch_of_several_groups_is_that_of_each_text(spark):
    texts, _, labels = toxic_set(spark)
    model = toxicity.fit_toxicity(docs(spark, texts), labels)
    long = "plain words and so on. " * (toxicity.GROUP_BYTES // 40)
    some = [None, "", long, "a rotten one", long + " rotten", long * 3, "", "dreadful and rotten", None]
    got = rows(toxicity.score_toxicity(docs(spark, some).coalesce(1), model, spans=True))
    for i, t in enumerate(some):
        score, spans = toxicity.judge(model, [t])
        assert abs(got[i]["score"] - score[0]) < 1e-12 and [(s["start"], s["end"]) for s in got[i]["toxic_spans"]] == [x[:2] for x in spans[0]]


def test_trained_operators_without_labels(spark):
    d, none = docs(spark, ["a b", None]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity_scores(d, none).collect()} == {0.5}
    assert {r["score"] for r in quality_gam.quality_scores(d, none).collect()} == {0.5}
    assert toxicity.toxicity_scores(d.limit(0), none).count() == quality_gam.quality_scores(d.limit(0), none).count() == 0


# ---- 3 -------------------------------------------------------------------------------


def test_bpe_equals_the_library_and_comes_back(spark):
    path, pattern = bpe.default_vocabulary()
    enc = bpe.ByteBpe(path, pattern)
    long = (prose(40000) + "\n\n  x" * 50).replace(" a", "  a")
    assert enc.encode(long) == enc.encoding.encode_ordinary(long) and len(list(bpe.safe_pieces(long))) > 1
    bare = "x" * (bpe.PIECE_CHARS + 10)
    assert list(bpe.safe_pieces(bare)) == [bare]
    texts = [*ODD, long, "it's 42's\r\n\x1c　 naïve<|endoftext|>"]
    got = rows(bpe.token_digests(docs(spark, texts), with_ids=True))
    for i, t in enumerate(texts):
        ids = enc.encoding.encode_ordinary(t or "")
        assert list(got[i]["token_ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs(spark, texts).withColumn("token_ids", F.lit(1))))
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert bpe.token_digests(docs(spark, texts).limit(0)).count() == 0


# ---- 4 -------------------------------------------------------------------------------


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + i] * 40)) for i in range(8)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))


def test_secrets(spark):
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256'})}.{url({'sub': 1})}." + "A" * 43
    ssh = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 30, b"k" * 90))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(RSA)}\n-----END RSA PRIVATE KEY-----"
    texts = {"é😀 Api_Key = 'abcdef' x": "assign", "token: abc": "", "AKIA" + "A" * 16: "access", "AKIAAAAA": "", "0" * 24: "hex", "0" * 23: "", "x " + jwt: "jwt", f"k {b64(PKCS8)} e": "der", f"k {b64(ssh)}": "openssh", pem: "pem", RSA.hex().upper(): "der", f"k {b64(RSA[:-1])} e": "", "eyJhIjoxfQ.eyJhIjoxfQ.AAAA": "", 'secret=token" : abcdefgh': "", "-----BEGIN PRIVATE KEY-----" * 50: ""}
    got = rows(secret_scan.scan_secrets(docs(spark, [*texts]).withColumn("spans", F.lit(0))))
    for i, (text, kind) in enumerate(texts.items()):
        kinds = [s.split(":")[0] for s in got[i]["spans"].split(",") if s]
        assert (kind in kinds) if kind else not kinds, (text, got[i]["spans"])
    assert got[0]["spans"] == "assign:3:20"
    odd = rows(secret_scan.scan_secrets(docs(spark, ODD)))
    assert odd[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and odd[0]["spans"] == "" and len(odd) == len(ODD)
    assert secret_scan.scan_secrets(docs(spark, ODD).limit(0)).count() == 0


def test_encoded_keys_are_found_within_runs_in_armour_and_over_lines():
    code = base64.b64encode(PKCS8).decode()
    wrap = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    pem = f"-----BEGIN PRIVATE KEY-----\n{wrap(code, 64)}\n-----END PRIVATE KEY-----\n"
    coded = base64.b64encode(pem.encode()).decode()
    for body, kind in {coded: "pem", wrap(coded, 76): "pem", code: "der", wrap(code, 64): "der", wrap(PKCS8.hex(), 64): "der", code.rstrip("="): "der"}.items():
        assert secret_scan.structural_spans(f"k: {body} e") == [(3, 3 + len(body), kind)], body
    assert secret_scan.structural_spans(f"path/{code}") == [(5, 5 + len(code), "der")]
    assert secret_scan.structural_spans(f"00{PKCS8.hex()}") == [(2, 2 + 2 * len(PKCS8), "der")]
    assert secret_scan.structural_spans(pem) == [(0, len(pem) - 1, "pem")]
    lost = wrap(code, 64).split("\n")
    assert secret_scan.structural_spans("\n".join(lost[:2] + lost[3:])) == []
    assert secret_scan.structural_spans(coded[:-60]) == []


def test_armour_is_parsed_and_not_searched_for_words():
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = base64.b64encode(bytes(range(48))).decode()
    heads = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    good = f"{begin}\n{heads}{body}\n{end}"
    assert secret_scan.structural_spans(f"x {good} y") == [(2, 2 + len(good), "pem")]
    for bad in (f"{begin}\nhello ENCRYPTED world\n{end}", f"{begin}\n{body}\n{end}", f"{begin}\n{heads}{body[:-8]}\n{end}", f"{begin}\nProc-Type: 4,ENCRYPTED\n\n{body}\n{end}"):
        assert secret_scan.structural_spans(bad) == [], bad
    began = time.process_time()
    assert secret_scan.structural_spans((begin + "x" * 50) * 40_000 + "\n" + good) == [((len(begin) + 50) * 40_000 + 1, (len(begin) + 50) * 40_000 + 1 + len(good), "pem")]
    assert time.process_time() - began < 3


def test_spans_of_keys_equal_the_places_they_were_put():
    rng = random.Random(21)
    kinds = {"der": base64.b64encode(PKCS8).decode(), "pem": f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(PKCS8).decode()}\n-----END PRIVATE KEY-----"}
    for _ in range(60):
        text, want = "", []
        for _ in range(rng.randrange(1, 6)):
            text += prose(rng.randrange(1, 30), rng) + rng.choice([" ", "\n", " é😀 ", "; "])
            kind = rng.choice([*kinds])
            want.append((len(text), len(text) + len(kinds[kind]), kind))
            text += kinds[kind] + rng.choice([" ", "\n", ". "])
        got = secret_scan.structural_spans(text)
        assert [x for x in got if x[2] == "pem"] == [x for x in want if x[2] == "pem"]
        assert {x for x in want if x[2] == "der"} <= set(got)
        inside = lambda a, b: any(x <= a and b <= y for x, y, _ in want)
        assert all(inside(a, b) for a, b, _ in got)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(6)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abc", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJKLMNOP", "é", "-", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        want = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secret_scan.base_spans(text) == want


# ---- 5 -------------------------------------------------------------------------------


def plain_targets(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * size[s] for s in free if share[s] >= 3 * size[s]}
        if not over:
            return capped | share
        capped |= over


def test_mix_meets_targets_with_whole_copies(spark):
    rng = random.Random(7)
    texts = [prose(rng.choice([3, 20, 60, 400]), rng) for _ in range(600)] + [None, "", prose(5000, rng)]
    source = lambda i: None if i % 11 == 0 else ["b", "a", "Z", "é", "c"][min(i % 13, 4)]
    d = docs(spark, texts, source)
    got = rows(mixing.plan_mix(d))
    size = Counter()
    for i, t in enumerate(texts):
        assert got[i]["size"] == len(WORD.findall(t or ""))
        size[source(i)] += got[i]["size"]
    want, taken = plain_targets(size), Counter()
    for i, r in got.items():
        assert abs(r["target"] - want[source(i)]) < 1e-6 and r["source_size"] == size[source(i)]
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[source(i)] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 60, (s, taken[s], want[s])
    again = rows(mixing.plan_mix(d.repartition(5)))
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in again.items()}
    out = mixing.mix(d)
    assert out.columns == d.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: r["copies"] for i, r in got.items() if r["copies"]})
    assert mixing.plan_mix(d.limit(0)).count() == 0
    twice = mixing.plan_mix(d.unionByName(d)).collect()
    assert len(twice) == 2 * len(texts)


def test_inclusion_follows_the_odds(spark):
    """50 sources of 240 documents of like sizes draw for themselves: how often those of a
    size are taken must be their probability. As many sources take 0.6 of theirs."""
    sizes = [5 + 3 * (i % 40) for i in range(240)]
    total = sum(sizes)
    data = [(1000 * s + i, "w " * n, f"a{s:03}") for s in range(50) for i, n in enumerate(sizes)]
    data += [(1_000_000 + s, "w " * (total // 5), f"b{s:03}") for s in range(50)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = [r for r in mixing.plan_mix(d, weights=(1,)).collect() if r["source"][0] == "a"]
    goal = got[0]["target"]
    assert abs(goal / (0.6 * total) - 1) < 0.01 and {r["copies"] for r in got} == {0, 1}
    often, taken = np.zeros(40), Counter()
    for r in got:
        often[r["doc_id"] % 1000 % 40] += r["copies"] / 300
        taken[r["source"]] += r["taken"]
    scale = goal / sum(n**1.5 for n in sizes)
    want = scale * np.array(sizes[:40]) ** 0.5
    assert want.max() < 1 and np.abs(often - want).max() < 0.11 and abs((often - want).mean()) < 0.01 and np.corrcoef(often, want)[0, 1] > 0.97
    assert max(abs(x / goal - 1) for x in taken.values()) < 0.01


def test_certain_documents_and_clashing_columns(spark):
    """One document that is nearly all of its source, and names that the mix uses itself."""
    data = [(i, "w " * n, "s", i) for i, n in enumerate([1, 1, 1, 1000])] + [(9, "w " * 500, "t", 9)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, _id long").withColumns({c: F.col("_id") for c in ("own", "tie", "id", "copies", "c0", "copy", "_own")})
    got = mixing.mix(d)
    assert got.columns == d.columns and all(r["own"] == r["c0"] == r["_own"] == r["doc_id"] for r in got.collect())
    plan = rows(mixing.plan_mix(d))
    assert all(r["taken"] <= 3 * r["size"] for r in plan.values())
    assert mixing.plan_mix(d.limit(0)).count() == 0


# ---- 6 -------------------------------------------------------------------------------


def test_quality_model_learns_features_and_an_interaction():
    rng = np.random.default_rng(8)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.3) & ((x[:, 1] > 0.5) == (x[:, 2] > 0.5))).astype(float)
    m = quality_gam.train(x[:4000], y[:4000], np.ones(4000))
    assert (1, 2) in m.pairs
    assert ((m.score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.95
    one = m.score(x[:1])[0]  # a sum of table entries
    z = m.base + sum(m.tables[f][np.searchsorted(m.cuts[f], x[0, f], side="right")] for f in range(4))
    z += sum(g[np.searchsorted(m.pair_cuts[a], x[0, a], side="right"), np.searchsorted(m.pair_cuts[b], x[0, b], side="right")] for (a, b), g in zip(m.pairs, m.grids, strict=True))
    assert abs(one - 1 / (1 + np.exp(-z))) < 1e-12


def test_quality_scores_held_out_documents(spark):
    rng = random.Random(9)
    texts = [(" | ".join(prose(30, rng).split()) if i % 4 == 0 else prose(60, rng)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = rows(quality_gam.quality_scores(docs(spark, texts + ODD), labels))
    held = [i for i in range(300) if got[i]["held_out"]]
    assert len(got) == 300 + len(ODD) and np.mean([got[i]["predicted"] == int(i % 4 != 0) for i in held]) > 0.97
    assert len(quality_gam.text_features("a b")) == len(quality_gam.text_features(None)) == len(quality_gam.FEATURES)


# ---- 7 -------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_pages_come_back_from_archives(spark, version):
    same = "<p>é" + "y" * 200
    pages = [(3, "http://a/ b", same), (1, "http://c", same), (2, None, same), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u\r\nx", "a\r\n\r\nb" * 30), (None, "n", same)]
    got = rows(warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)), version), "page_id")
    for page, _, html in pages:
        body = (html or "").encode()
        assert got[page]["payload_bytes"] == len(body) and got[page]["payload_digest"] == hashlib.sha256(body).hexdigest() and got[page]["digest_ok"]
        revisit = html == same and page != 1
        assert (got[page]["record_type"], got[page]["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_revisits_name_the_record_that_they_repeat_and_long_archives_are_read_in_linear_time(spark):
    same = "z" * 300
    pages = spark.createDataFrame([(i, f"http://h/ {i}", same) for i in range(5, 9)], "page_id long, url string, html string")
    got = rows(warc.archive_pages(pages.coalesce(1)), "page_id")
    assert {got[i]["refers_id"] for i in (6, 7, 8)} == {got[5]["record_id"]} and got[5]["refers_id"] is None
    r = warc.ArcRecord("http://x", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.0 200 OK\r\n\r\n" + random.Random(1).randbytes(2000))
    raw = warc.write_warc([warc.to_warc(r)]) * 8000
    began = time.process_time()
    assert sum(1 for _ in warc.read_warc(raw)) == 8000
    assert time.process_time() - began < 5
    with pytest.raises(ValueError):
        list(warc.read_warc(raw[:-5]))


def test_arc_headers_are_parsed_by_version():
    r = [warc.ArcRecord("http://x/a b", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi"), warc.ArcRecord("dns:x", "1.2.3.4", "20200102", "text/dns", b"")]
    for v in (1, 2):
        back = list(warc.parse_arc(warc.write_arc(r, "n.arc", v)))
        assert [(x.url, x.date, x.content) for x in back] == [("http://x/a%20b", "20200102030405", r[0].content), ("dns:x", "20200102", b"")]
        one, two = (warc.to_warc(x) for x in back)
        assert one.headers["WARC-Date"] == "2020-01-02T03:04:05Z" and one.headers["WARC-Type"] == "response" and two.headers["WARC-Type"] == "resource"
        assert [(x.headers, x.block) for x in warc.read_warc(warc.write_warc([one, two]))] == [(one.headers, one.block), (two.headers, two.block)]
    assert warc.to_warc(back[0]).headers == warc.to_warc(back[0]).headers
    raw = warc.write_arc(r, "n.arc")
    spaced = raw.replace(b"http://x/a%20b", b"http://x/a b")
    assert next(warc.parse_arc(spaced)).url == "http://x/a b"
    for bad in (raw[:-30] + b"9", raw.replace(b"1 0 corvine", b"7 0 corvine"), raw.replace(b"20200102030405", b"yesterday")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


# ---- 8 -------------------------------------------------------------------------------


def plain_line_dedup(texts):
    seen, gone = set(), [set() for _ in texts]
    for d, t in enumerate(texts):
        if t is None:
            continue
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if WORD.search(x)]
        for i in range(len(at)):
            for n in (1, 2, 3):
                part = at[i : i + n]
                body = tuple(lines[j] for j in part)
                if len(part) == n and (n == 3 or sum(len(WORD.findall(x)) for x in body) >= 50):
                    if body in seen:
                        gone[d].update(part)
                    seen.add(body)
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) if t is not None else None for t, g in zip(texts, gone, strict=True)]


def test_line_dedup_equals_plain_python(spark):
    rng = random.Random(10)
    pool = [prose(rng.choice([2, 5, 30, 60]), rng) for _ in range(12)] + [""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(150)] + ODD
    want = plain_line_dedup(texts)
    d = docs(spark, texts).withColumn("n_removed", F.lit("old"))
    out = rows(line_dedup.dedup_lines(d))
    assert [out[i]["text"] for i in range(len(texts))] == want
    assert sum(r["n_removed"] for r in out.values()) > 100
    assert rows(line_dedup.dedup_lines(d.repartition(7)))[5]["text"] == want[5]
    twice = line_dedup.dedup_lines(docs(spark, ["a\nb\nc\nd"]).unionByName(docs(spark, ["a\nb\nc\nd"]))).collect()
    assert [r["text"] for r in twice] == ["a\nb\nc\nd"] * 2
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


# ---- 9 -------------------------------------------------------------------------------


def test_quality_rules_equal_plain_python(spark):
    rng = random.Random(12)
    texts = [*ODD, *[" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(60)], *[prose(200, rng) + "\n" + "# * $\n" * rng.randrange(4) for _ in range(20)], "the cat of the hat and a dog " * 20, prose(20000, rng)]
    got = rows(quality_rules.judge_quality(docs(spark, texts).withColumn("kept", F.lit("old"))))
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        seen = Counter(grams)
        cover = {j + k for j, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    plan = quality_rules.judge_quality(docs(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality_rules.judge_quality(docs(spark, texts).limit(0)).count() == 0


# ---- 10 ------------------------------------------------------------------------------


def shingles(t, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(texts, n, p, q):
    s = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and q * len(s[i] & s[j]) >= p * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(s))], [len(x) for x in s]


def family(rng, size, words, most):
    base = [rng.choice(VOCAB) for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(words)] = rng.choice(VOCAB)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "p", "q", "limit"), [(3, 90, 100, 200), (3, 90, 100, 4), (5, 80, 100, 4), (5, 4, 5, 200), (2, 1, 2, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, n, p, q, limit):
    monkeypatch.setattr(ngram_join, "LIMIT", limit)
    rng = random.Random(13)
    texts = [*ODD, "One TWO", *family(rng, 60, 120, 5), *family(rng, 30, 40, 2), *[prose(30, rng) for _ in range(30)], "é É ß", "É é ß"]
    texts += [texts[12]] * 3
    want, sizes = plain_components(texts, n, p, q)
    got = rows(ngram_join.jaccard_components(docs(spark, texts).withColumn("n", F.lit(1)), n, (p, q)))
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_components_of_buckets_with_thousands_of_members(spark):
    """Sets of 40 of 60 common words: any word is in thousands of them."""
    rng = np.random.default_rng(5)
    sets = np.zeros((5000, 60), bool)
    for i in range(len(sets)):
        if i % 10 == 9:  # one word of another set replaced: near copies, and chains of them
            at = rng.integers(0, i)
            sets[i] = sets[at]
            sets[i, rng.choice(np.flatnonzero(sets[i]))] = False
            sets[i, rng.choice(np.flatnonzero(~sets[i]))] = True
        else:
            sets[i, rng.choice(60, 40, replace=False)] = True
    both = sets.astype(np.int32) @ sets.T.astype(np.int32)
    linked = 100 * both >= 90 * (80 - both)
    root = np.arange(len(sets))
    while True:
        least = np.where(linked, root[None, :], len(sets)).min(1)
        if (least == root).all():
            break
        root = least
    words = np.array([f"w{i}" for i in range(60)])
    texts = [" ".join(words[x]) for x in sets]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = rows(ngram_join.jaccard_components(d, 1))
    assert [got[i]["component_id"] for i in range(len(sets))] == root.tolist()
    assert len(set(root.tolist())) < 4600


def test_components_with_null_and_repeated_ids(spark):
    a, b = prose(30), prose(30)
    d = spark.createDataFrame([(1, a), (None, a), (2, b), (3, a), (3, b), (2, b)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["component_id"]) for r in ngram_join.jaccard_components(d).collect())
    assert got == [(0, None), (1, 1), (2, 1), (2, 1), (3, 1), (3, 1)]
    assert ngram_join.jaccard_components(d.limit(0)).count() == 0


# ---- pipeline ------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    texts, toxic, labels = toxic_set(spark, 200)
    rng = random.Random(14)
    passage = "\n".join(prose(20, rng) for _ in range(4))
    texts += [prose(30, rng) + "\n" + passage for _ in range(6)] + family(rng, 5, 150, 1) + ODD
    d = docs(spark, texts)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "byte_bpe"]
    sizes, held = [], d
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = held
        held = stage(spark, before, str(tmp_path))
        if k < 4:
            assert held.columns == d.columns, name
            path = str(tmp_path / f"stage{k}")
            held.write.parquet(path)
            held = spark.read.parquet(path)
        sizes.append(held.count())
        if name == "toxicity":
            kept = {r["doc_id"] for r in held.collect()}
            assert sum(i not in kept for i, y in enumerate(toxic) if y) > 30 and all(i in kept for i in range(200, len(texts)))
        if name == "line_dedup":
            got = {r["doc_id"]: r for r in held.collect()}
            assert sum(passage in (r["text"] or "") for r in got.values()) == 1
            assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
        if name == "ngram_jaccard":
            mine = before.collect()
            want, _ = plain_components([r["text"] for r in mine], 5, 80, 100)
            least = Counter()
            for i, r in enumerate(mine):
                least[want[i]] = min(least.get(want[i], r["doc_id"]), r["doc_id"])
            assert {r["doc_id"] for r in held.collect()} == set(least.values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == sizes[-1] and whole.columns == held.columns


def test_near_copies_are_judged_by_id_and_text(spark):
    rng = random.Random(15)
    a, b, c, e = (prose(40, rng) for _ in range(4))
    rows_in = [(1, a, "x"), (3, a, "x"), (3, b, "x"), (4, c, "z"), (4, c, "y"), (4, c, "z"), (5, e, "x"), (5, e.upper(), "x"), (None, a, "x"), (None, a, "x"), (7, "", "x"), (7, None, "x")]
    first = min(e, e.upper(), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = sorted([(1, a, "x"), (3, b, "x"), (4, c, "y"), (5, first, "x"), (None, a, "x"), (None, a, "x"), (7, "", "x"), (7, None, "x")], key=repr)
    d = spark.createDataFrame(rows_in, "doc_id long, text string, source string")
    for n in (1, 5):
        got = corpus_pipeline.drop_near_copies(spark, d.repartition(n), "")
        assert got.columns == d.columns and sorted((tuple(r) for r in got.collect()), key=repr) == want
    same = corpus_pipeline.drop_near_copies(spark, d.where("doc_id = 4 or doc_id = 1"), "")
    assert sorted(tuple(r) for r in same.collect()) == [(1, a, "x"), (4, c, "y")]


def test_pipeline_encodes_in_batches_of_bounded_rows(spark, monkeypatch):
    """Batches of 10,000 texts, with their ids, made the last stage's workers large."""
    import pyarrow as pa

    def batches(df, with_ids):
        def run(got):
            for b in got:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([b.num_rows] * b.num_rows, pa.int64())], names=["doc_id", "of"])

        return df.select("doc_id").mapInArrow(run, "doc_id long, of long")

    monkeypatch.setattr(bpe, "token_digests", batches)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = corpus_pipeline.encode(spark, docs(spark, ["a b"] * 1201).coalesce(1), "").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1201))
    assert max(r["of"] for r in got) <= 500 and spark.conf.get(key) == before


def test_a_join_that_begins_has_no_table_made_by_python(spark):
    """Those start a second kind of Python workers in each executor."""
    nodes = spark.range(3).select(F.col("id").alias("node"))
    j = ngram_join._Join(docs(spark, ["a"]), nodes, 5, (80, 100))
    for t, columns in ((j.tested, ["x", "y"]), (j.labels, ["node", "label"])):
        assert t.columns == columns and {k for _, k in t.dtypes} == {"bigint"} and t.count() == 0
        assert "ExistingRDD" not in t._jdf.queryExecution().executedPlan().toString()
