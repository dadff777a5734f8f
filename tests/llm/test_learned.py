"""Toxicity, quality and language model: held-out accuracy, odd rows, brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import lm, quality, toxicity
from tripweave.llm.eliasfano import EliasFano
from tripweave.llm.queries import QUERIES, held_out


def invented(rng, words, toxic):
    text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
    for i in range(5, len(text), 9):
        text[i] += "."
    if toxic:
        text.insert(rng.randrange(len(text)), rng.choice(["nastyfool", "nastyfools", "vilegit"]))
    return " ".join(text)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("n", "r", "st", "lk")]
    rows = [(i, invented(rng, words, i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


def test_toxicity_learns_and_locates(labelled):
    model = toxicity.train(labelled, labelled.filter("doc_id < 600"))
    scored = toxicity.score(labelled, model).join(labelled, "doc_id").filter("doc_id >= 600").collect()
    right = [(r["score"] >= 0.5) == bool(r["toxic"]) for r in scored]
    assert sum(right) >= 0.97 * len(right)
    texts = {r["doc_id"]: r["text"] for r in labelled.collect()}
    found = toxicity.offending_sentences(labelled.filter("doc_id >= 600"), model).collect()
    named = [re.search("nasty|vile", texts[r["doc_id"]][r["start"] : r["end"]]) is not None for r in found]
    assert len(named) > 40 and sum(named) >= 0.97 * len(named)
    worst = {(r["doc_id"], r["worst"]) for r in toxicity.score(labelled, model).collect() if r["score"] >= 0.5}
    assert {(r["doc_id"], r["sentence"]) for r in found} & worst


def test_toxicity_of_odd_rows(odd, nothing, labelled):
    model = toxicity.train(labelled, labelled)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0.0}
    kept = toxicity.passing(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] < 0.5 for r in rows)
    assert toxicity.score(nothing, model).count() == 0
    untaught = toxicity.train(labelled, labelled.filter("toxic = 0"))
    assert {r["score"] < 1e-9 for r in toxicity.score(odd, untaught).collect()} == {True}
    assert toxicity.train(nothing, labelled).prior == 0


def test_quality_holds_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.classify(docs, labels.filter("doc_id % 3 != 1")).join(labels.filter("doc_id % 3 = 1"), "doc_id")
    right = [(r["score"] >= 0.5) == bool(r["quality"]) for r in scored.collect()]
    assert len(right) > 100 and sum(right) >= 0.95 * len(right)


def test_discriminant_against_full_densities():
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    sums = np.zeros((2, d + 1, d + 1))
    for value, n in ((0, 400), (1, 900)):
        x = np.hstack([np.ones((n, 1)), rng.normal(value, 1 + value, (n, d))])
        sums[value] = x.T @ x
    model = quality._solved(sums, 0.2, 0.05)
    x = rng.normal(0.5, 1, (50, d))
    z = (x - model.centre) / model.scale
    density = []
    for prior, mean, inverse in model.classes:
        covariance = np.linalg.inv(inverse.T @ inverse)
        away = z - mean
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(covariance), away)
        density.append(prior - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * distance)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(density[0] - density[1])))


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 1), (3, 0), (99, 0), (7, None)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    one_kind = quality.classify(odd, labels.filter("quality = 1")).collect()
    assert {r["score"] for r in one_kind} == {1.0}
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


# --- language model -----------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 3, 5_000, 2**40, 2**63, 2**64 - 1])
def test_elias_fano(top):
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 700):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=top < 2**64 - 1))
        sequence = EliasFano.of(values)
        asked = np.concatenate([values, rng.integers(0, top, 300, dtype=np.uint64), np.array([0, top], np.uint64)])
        assert (sequence.at(np.arange(n)) == values).all()
        assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()
        assert ((sequence.find(asked) >= 0) == np.isin(asked, values)).all()


def discount(counts):
    once, twice = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def brute(docs, order):
    split = [
        (i, train, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"])
        for i, t, train in docs
    ]
    single = Counter(w for _, train, words in split if train for w in words)
    n, kinds, less = sum(single.values()), len(single), discount(single.values())
    levels = {}
    for k in range(2, order + 1):
        grams = Counter()
        for _, train, words in split:
            begun = ["<s>", *words]
            for j in range(k - 2, len(words) * bool(train)):
                grams[tuple(begun[j + 2 - k : j + 2])] += 1
        totals, kids = Counter(), Counter()
        for g, c in grams.items():
            totals[g[:-1]] += c
            kids[g[:-1]] += 1
        levels[k] = grams, totals, kids, discount(grams.values())
    rows = []
    for i, train, words in split:
        begun, score, base = ["<s>", *words], 0.0, 0.0
        for j, w in enumerate(words):
            p = ((single[w] - less) if single[w] else less * kinds) / n if n else 1.0
            base += math.log10((single[w] + 0.5) / (n + 0.5 * (kinds + 1)))
            for k in range(2, min(order, j + 2) + 1):
                grams, totals, kids, cut = levels[k]
                g = tuple(begun[j + 2 - k : j + 2])
                if totals[g[:-1]]:
                    own = max(grams[g] - cut, 0) if grams[g] else 0
                    p = (own + cut * kids[g[:-1]] * p) / totals[g[:-1]]
            score += math.log10(p)
        rows.append((i is None, i or 0, bool(train), len(words), sum(single[w] > 0 for w in words), n, base, score))
    return sorted(rows)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(2)
    word = lambda: rng.choice("the a of b c d e f".split()) if rng.random() < 0.8 else f"W{rng.randrange(40)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40))), i % 3 != 0) for i in range(60)]
    return [*docs, (100, None, True), (101, "", False), (None, "a b", True), (5, "the a", True), (5, "the a", None)]


@pytest.mark.parametrize(("order", "shards", "chunk"), [(1, 2, 100), (2, 1, 10**6), (3, 1, 90), (2, 4, 90), (3, 5, 200)])
def test_model_against_brute_force(spark, spoken, order, shards, chunk):
    frame = spark.createDataFrame(spoken, "doc_id long, text string, train boolean")
    got = sorted(
        (r[0] is None, r[0] or 0, *r[1:]) for r in lm.score(frame, F.col("train"), order, shards=shards, chunk=chunk).collect()
    )
    want = brute(spoken, order)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert np.allclose([g[6] for g in got], [w[6] for w in want])
    assert np.allclose([g[7] for g in got], [w[7] for w in want], rtol=1e-9)


def differences(spark, docs, order, shards, chunk):
    frame = spark.createDataFrame(docs, "doc_id long, text string, train boolean")
    rows = lm.score(frame, F.col("train"), order, shards=shards, chunk=chunk).collect()
    got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in rows)
    return np.array([abs(g[7] / w[7] - 1) for g, w in zip(got, brute(docs, order), strict=True)])


def test_shards_share_one_discount(spark, spoken):
    # So few different counts that every code is exact.
    for order, shards, chunk in ((2, 4, 90), (3, 5, 200), (3, 13, 10**6)):
        assert differences(spark, spoken, order, shards, chunk).max() < 1e-9


def test_many_counts_stay_exact(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(20, 200, 1_500)
    words = [f"w{i}" for i in rng.zipf(1.25, lengths.sum()) % 5_000]
    ends = np.cumsum(lengths)
    docs = [(i, " ".join(words[e - n : e]), i % 5 != 1) for i, (e, n) in enumerate(zip(ends.tolist(), lengths, strict=True))]
    grams = Counter(g for _, t, train in docs if train for g in zip(t.split(), t.split()[1:], strict=False))
    totals = Counter()
    for (a, _), c in grams.items():
        totals[a] += c
    assert len({(c, totals[a]) for (a, _), c in grams.items()}) > 4 * 255
    for shards in (1, 4):
        assert differences(spark, docs, 3, shards, 20_000).max() < 1e-9


def test_codes_of_counts():
    counts = np.append(np.arange(70_000), np.geomspace(70_000, 9e14, 5_000).astype(np.int64))
    codes, book = lm._code(counts).astype(np.int64), lm._book()
    assert (np.diff(book) > 0).all() and (codes[: lm._EXACT] == counts[: lm._EXACT]).all()
    assert (book[codes] <= counts).all() and (counts < book[codes + 1]).all()
    assert (counts <= 1.001 * book[codes]).all()


def test_a_chunk_sends_no_empty_parcel():
    places = lm.Places(500, {})
    docs = [(i, True, np.array([1, 2, i % 7 + 3, 0], np.int32)) for i in range(50)]
    rows = list(lm._requests(docs, {b"": 0} | {b"w%d" % i: i for i in range(1, 10)}, 3, places, 3))
    # One tree for each shard with a first word, the start and end marks among them.
    assert rows[0][2] == 0 and len({r[0] for r in rows[1:]}) == len(rows) - 1 <= 11


def test_model_without_training_rows(spark, odd, nothing):
    rows = lm.score(odd, F.lit(None).cast("boolean")).collect()
    assert len(rows) == odd.count() and {(r["score"], r["base_score"], r["n_known"]) for r in rows} == {(0.0, 0.0, 0)}
    assert lm.score(odd, F.lit(True), shards=3).filter("score > 0").count() == 0
    assert lm.score(nothing, F.lit(True)).count() == 0


def test_query_looks_at_two_words_of_context(spark, tmp_path):
    ids = spark.range(400).select("id", held_out(5, 1, "id").alias("out")).collect()
    taught, asked = ([r["id"] for r in ids if r["out"] == out] for out in (False, True))
    rows = [(i, ("go a x b", "go c x d")[k % 2]) for k, i in enumerate(taught[: len(taught) // 2 * 2])]
    rows += [(asked[0], "go a x b"), (asked[1], "go a x d"), (asked[2], "go c x d"), (asked[3], "go c x b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in QUERIES["op2_lm_scoring"](spark, str(tmp_path)).collect()}
    # One word of context gives b and d the same probability after x.
    assert got[asked[0]] > got[asked[1]] + 1 and got[asked[2]] > got[asked[3]] + 1


# --- noisy-or by hand ---------------------------------------------------------------


def _sentence_values(text, model):
    """Sum of the weights of each sentence's features, and the bias; by the definition."""
    values, held = [], []
    for token in text.lower().split():
        word = token.strip(".,;:!?\"'()[]{}*#$%&|<>…«»¿¡")
        parts = [f"w {word}"] + [f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) > n] if word else []
        held += [zlib.crc32(p.encode()) % toxicity.WIDTH for p in parts]
        if token[-1] in ".!?":
            values.append(held)
            held = []
    if text.split() and text.split()[-1][-1] not in ".!?":
        values.append(held)
    return [sum(float(model.weights[i]) for i in own) + model.bias for own in values]


def test_noisy_or_score_against_its_definition(spark, odd):
    rng = np.random.default_rng(3)
    weights = np.where(rng.random(toxicity.WIDTH) < 0.5, rng.normal(0, 2, toxicity.WIDTH), 0).astype(np.float32)
    model = toxicity.Model(weights, -2.0, 0.5)
    texts = {10 + i: " ".join(f"word{rng.integers(40)}{rng.choice(['', '.', '!', ','])}" for _ in range(rng.integers(1, 40))) for i in range(60)}
    texts |= {1: "One. two? (three) ... four", 2: "...", 3: "no end"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.score(rows, model).collect():
        chances = [1 / (1 + math.exp(-z)) for z in _sentence_values(texts[r["doc_id"]], model)]
        assert r["score"] == pytest.approx(1 - math.prod(1 - p for p in chances), rel=1e-5)
        assert r["sentences"] == len(chances) and r["worst_score"] == pytest.approx(max(chances), rel=1e-5)
        assert chances[r["worst"]] == pytest.approx(max(chances), rel=1e-5)


def test_first_step_follows_the_gradient():
    """One step from zero against differences of the weighted log likelihood."""
    rng = np.random.default_rng(4)
    labels = np.array([1, 0, 1, 0, 0])
    weight = np.array([2.0, 0.5, 1.0, 1.5, 1.0])
    sentences = np.array([2, 1, 3, 2, 1])
    words = rng.integers(1, 5, sentences.sum())
    features = rng.integers(0, 6, words.sum())
    use = np.zeros(toxicity.WIDTH, bool)
    use[:5] = True

    def likelihood(w, bias):
        total, at, s = 0.0, 0, 0
        for label, share, n in zip(labels, weight / weight.mean() / len(labels), sentences, strict=True):
            clean = 1.0
            for size in words[s : s + n]:
                own = [f for f in features[at : at + size] if use[f]]
                clean *= 1 - 1 / (1 + math.exp(-(sum(w[f] for f in own) + bias)))
                at += size
            s += n
            total += share * (math.log(1 - clean) if label else math.log(clean))
        return total

    got, bias = toxicity.fit(labels, weight, sentences, words, features, use, epochs=1, rate=0.3, batches=1)
    zero, h = np.zeros(6), 1e-5
    for f in range(5):
        step = np.eye(6)[f] * h
        slope = (likelihood(zero + step, -5.0) - likelihood(zero - step, -5.0)) / (2 * h)
        assert got[f] == pytest.approx(0.3 * slope / math.sqrt(1e-6 + slope * slope), rel=1e-5)
    slope = (likelihood(zero, -5.0 + h) - likelihood(zero, -5.0 - h)) / (2 * h)
    assert bias == pytest.approx(-5.0 + 0.3 * slope / math.sqrt(1e-6 + slope * slope), rel=1e-5)
    assert not got[5:].any()
