import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tripweave.llm import rules, simhash
from tripweave.llm.queries import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def longest_repeats(words):
    found = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            found[i] = max(found[i], k)
    return found


def test_longest_repeats_against_all_pairs():
    rng = random.Random(3)
    for _ in range(150):
        texts = [[rng.choice("abc") for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 5))]
        sizes = [len(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        symbols = np.array([300 * i + ord(c) for i, t in enumerate(texts) for c in t], np.int64)
        got = rules.longest_repeats(symbols, np.cumsum(sizes)[owner])
        assert got.tolist() == [x for t in texts for x in longest_repeats(t)]


def judged(text, repeat_words=10):
    words = SPACE.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {i + j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, seen, copies = (text or "").split("\n"), set(), 0
    for line in lines:
        if SPACE.search(line):
            copies += line in seen
            seen.add(line)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(repeated),
        n < 50 or 100 * len(repeated) > 50 * n,
    )


def test_rules_against_brute_force(documents, odd, nothing):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for frame in (documents, odd):
        got = rules.repetition(frame).select("doc_id", *names).collect()
        want = Counter((r["doc_id"], *judged(r["text"])) for r in frame.collect())
        assert Counter(map(tuple, got)) == want
        kept = Counter(r["doc_id"] for r in rules.repetition(frame).filter("kept").collect())
        assert Counter(r["doc_id"] for r in rules.passing(frame).collect()) == kept
        assert rules.passing(frame).columns == frame.columns
    assert rules.repetition(nothing).count() == 0


def test_repeated_passages_fail_and_are_located(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    # Two passages of 24 words, each twice: under half of the words, and no repeat is long.
    half = [w for p in (fresh(24), fresh(24)) for _ in range(2) for w in p + fresh(1)]
    rows = [
        (1, " ".join(fresh(300))),
        (2, " ".join(fresh(40) + passage + fresh(40) + passage)),
        (3, " ".join(fresh(100) + passage[:20] + fresh(100) + passage[:20])),
        (4, " ".join(half + fresh(120))),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rules.repetition(frame, with_spans=True, longest_share=0.2).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {1: True, 2: False, 3: True, 4: True}
    assert [tuple(s) for s in got[2]["spans"]] == [(40, 100), (140, 200)]
    assert got[2]["longest_repeat"] == 60 and got[2]["n_covered_words"] == 120


def test_each_limit_rejects_what_the_base_rule_keeps(spark, tmp_path):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, four = fresh(30), [fresh(12) for _ in range(4)]
    texts = [
        fresh(300),
        # Four repeats of 12 words: 96 of 340 words are covered, the longest is 0.035 of them.
        [w for p in four * 2 for w in p + fresh(5)] + fresh(204),
        # One repeat of 30 in 330 words: 0.18 are covered, the longest is 0.09.
        fresh(100) + passage + fresh(100) + passage + fresh(70),
        # Short repeats stay.
        fresh(150) + passage[:11] + fresh(150) + passage[:11],
    ]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, str(tmp_path)).collect()}
    for i, words in enumerate(texts):
        longest = longest_repeats(words)
        inside = {i + j for i, n in enumerate(longest) if n >= 10 for j in range(n)}
        over = len(inside) > 0.2 * len(words), max(longest) > 0.08 * len(words)
        assert over == [(False, False), (True, False), (False, True), (False, False)][i]
        assert (got[i]["n_covered_words"], got[i]["longest_repeat"]) == (len(inside), max(longest))
        assert not got[i]["base_failed"] and got[i]["kept"] == (not any(over))
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, frame, "").collect()} == {0, 3}


# --- fingerprints -------------------------------------------------------------------


def fingerprint(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=3):
    """Smallest fingerprint that each reaches, from all pairs."""
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= distance and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**64 - 1, max(1, n // 10), dtype=np.uint64)[rng.integers(0, max(1, n // 10), n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(fps)


@pytest.mark.parametrize("n", [1, 2, 40, 200])
def test_index_finds_what_all_pairs_find(n):
    fps = clustered(n)
    index = simhash.GrayIndex(fps)
    for distance in (0, 3, 7):
        query, member = index.within(fps, distance)
        want = np.argwhere(np.bitwise_count(fps[:, None] ^ index.fps[None, :]) <= distance)
        assert sorted(zip(query.tolist(), member.tolist(), strict=True)) == list(map(tuple, want.tolist()))
    a, b = simhash.spanning_links(fps, 3)
    got = {int(f): int(f) for f in fps} | dict(zip(a.tolist(), b.tolist(), strict=True))
    assert got == components([int(f) for f in fps])


@pytest.mark.parametrize("limit", [None, 4])
def test_links_join_the_same_components_when_nodes_are_crowded(spark, limit):
    fps = clustered(120, 5)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    label = {int(f): int(f) for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in simhash.links(frame, 3, limit=limit).collect():
        a, b = root(r["a"] % 2**64), root(r["b"] % 2**64)
        label[max(a, b)] = min(a, b)
    assert {f: root(f) for f in label} == components(list(label))


def test_near_duplicates(spark, documents, odd, nothing):
    for frame in (documents.limit(120), odd):
        rows = [(r["doc_id"], fingerprint(r["text"])) for r in frame.select("doc_id", "text").collect()]
        label = components(list({f for _, f in rows}))
        least = {}
        for doc_id, f in rows:
            if doc_id is not None:
                least[label[f]] = min(doc_id, least.get(label[f], doc_id))
        want = Counter((d, f, least.get(label[f])) for d, f in rows)
        got = simhash.near_duplicates(frame).collect()
        assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0
