"""Exact search, ranked search and vector codes against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import covertree, lexical, topk
from tripweave.llm.queries import QUERIES
from tripweave.llm.vectors import matrix

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, score long, _nth int, vector string"


def scaled(vector, width):
    own = [math.floor(1024 * x) for x in vector]
    return own + [0] * (width - len(own))


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def some_vectors(seed, n, width=8):
    """Few different components, so that scores and distances tie often; a third are copies."""
    rng = np.random.default_rng(seed)
    values = rng.integers(-3, 4, (n, width)) / 16 + rng.choice([0, 1 / 4096], (n, width))
    values[rng.random(n) < 0.33] = values[0]
    return [np.float32(v).tolist() for v in values]


def odd_vectors(seed, n):
    rows = [(i, v, i % 4 if i % 5 else None, 1, 2, "x") for i, v in enumerate(some_vectors(seed, n))]
    rows += [(n + i, v, 0, 1, 2, "x") for i, v in enumerate([None, [0.1, None], [NAN] * 8, [INF] + [0.0] * 7, [], [0.5, -0.5]])]
    rows += [(None, rows[3][1], None, 1, 2, "x"), rows[2], (1, rows[3][1], 3, 1, 2, "x")]
    return rows


# --- exact top-k --------------------------------------------------------------------


def best(rows, asked, k):
    kept = [(r[0], scaled(r[1], 8)) for r in rows if usable(r[1])]
    lists = []
    for query, vector in [(r[0], scaled(r[1], 8)) for r in asked if usable(r[1])]:
        scores = [(-sum(a * b for a, b in zip(vector, own, strict=True)), i is None, i or 0) for i, own in kept if i != query]
        lists.append([(query, n + 1, None if no else i, -s) for n, (s, no, i) in enumerate(sorted(scores)[:k])])
    return Counter(row for one in lists for row in one)


@pytest.mark.parametrize("tile", [3, 4096])
def test_exact_top_k(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE_ROWS", tile)
    monkeypatch.setattr(topk, "TILE_QUERIES", tile)
    rows = odd_vectors(1, 120)
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    asked = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    for block in (topk.QUERY_BLOCK, 17):
        got = topk.exact_top_k(frame, spark.createDataFrame(asked, VECTORS), k=7, query_block=block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert Counter(map(tuple, got.collect())) == best(rows, asked, 7)


def test_exact_top_k_of_few_and_none(spark):
    rows = odd_vectors(2, 4)
    frame = spark.createDataFrame(rows, VECTORS)
    assert Counter(map(tuple, topk.exact_top_k(frame, frame.filter("vec_id = 0"), 50).collect())) == best(rows, rows[:1], 50)
    assert topk.exact_top_k(frame, frame.limit(0)).collect() == []
    assert topk.exact_top_k(frame.limit(0), frame).collect() == []


def test_lists_merge_over_many_tasks(spark):
    rows = odd_vectors(3, 300)
    frame = spark.createDataFrame(rows, VECTORS).repartition(90)
    got = topk.exact_top_k(frame, frame.filter("vec_id % 100 = 0"), 10)
    assert Counter(map(tuple, got.collect())) == best(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)


def test_products_are_exact_beyond_doubles(spark):
    big = [float(2**19 + 1), float(2**18 + 1)]
    frame = spark.createDataFrame([(0, big), (1, big), (2, [x + 1 for x in big])], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(frame, frame.filter("vec_id = 0")).collect()
    want = {i: sum(int(1024 * a) * int(1024 * b) for a, b in zip(big, v, strict=True)) for i, v in ((1, big), (2, [x + 1 for x in big]))}
    assert {r["vec_id"]: r["score"] for r in got} == want and max(want.values()) > 2**53
    huge = spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_top_k(huge, huge).collect()


# --- ranked search ------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    counts = [(key, Counter(terms(text))) for key, text in docs if terms(text)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in holding.items()}
    found = Counter()
    for item, text in items:
        scores = []
        for key, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0))
        found.update((item, r + 1, None if no else key, -s) for r, (s, no, key) in enumerate(sorted(scores)[:k]))
    return found


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 9])
@pytest.mark.parametrize("leaf", [1, 64])
def test_ranked_search(spark, odd, monkeypatch, block, leaf):
    monkeypatch.setattr(lexical.BallTree.__init__, "__defaults__", (leaf,))
    rng = random.Random(leaf)
    word = lambda: rng.choice(["a", "B2", "é", "straße", "x"] + [f"W{i}" for i in range(60)])
    text = lambda n: rng.choice([" ", ", ", "_"]).join(word() for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(160)]
    docs += [(200 + i, docs[5][1]) for i in range(70)] + [(None, docs[5][1]), (3, "a a a"), (400, None), (401, "..."), docs[9]]
    items = [(i, text(rng.randrange(1, 15))) for i in range(9)] + [(50, None), (51, ""), (52, "nowhere"), (0, "a w1 w2"), (None, "x w5")]
    left = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n int, terms int").repartition(3)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    got = lexical.ranked_search(left, right, k=6, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked(docs, items, 6)
    assert lexical.ranked_search(left.limit(0), right).count() == 0
    assert lexical.ranked_search(left, right.limit(0)).count() == 0
    rows = odd.collect()
    want = ranked([(r["doc_id"], r["text"]) for r in rows], [(1, "lazy words long")], 50)
    item = spark.createDataFrame([(1, "lazy words long")], "item_id long, text string")
    assert Counter(map(tuple, lexical.ranked_search(odd, item).collect())) == want


def test_small_trees_give_the_same_lists(spark, documents, monkeypatch, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, lexical.ranked_search(documents, items).collect()))
    monkeypatch.setattr(lexical, "TREE_DOCS", 7)
    assert sorted(map(tuple, lexical.ranked_search(documents, items).collect())) == whole
    monkeypatch.setattr(lexical, "TREE_WEIGHTS", 1)
    assert sorted(map(tuple, lexical.ranked_search(documents, items).collect())) == whole


def test_bounds_hold_and_prune():
    """No leaf left out holds a row of the list, and leaves are left out where rows lie in groups."""
    rng = np.random.default_rng(1)
    rows = []
    for group in range(64):
        base = rng.choice(np.arange(group * 30, group * 30 + 30), 12, replace=False)
        rows += [(np.sort(base), rng.integers(400_000, 420_000, 12)) for _ in range(64)]
    starts = np.arange(0, 12 * len(rows) + 1, 12)
    tree = lexical.BallTree(starts, np.concatenate([t for t, _ in rows]), np.concatenate([w for _, w in rows]), leaf=16)
    assert sorted(tree.order.tolist()) == list(range(len(rows)))
    visited = 0
    for group in range(0, 64, 7):
        asked = np.arange(group * 30, group * 30 + 20)
        importances = rng.integers(1, 9_000, 20)
        value = dict(zip(asked.tolist(), importances.tolist(), strict=True))
        scores = [sum(value.get(t, 0) * w for t, w in zip(own.tolist(), weights.tolist(), strict=True)) for own, weights in rows]
        top: list = []

        def leaf(lo, found):
            for row, score in zip(tree.order[lo : lo + len(found)].tolist(), found.tolist(), strict=True):
                assert score == scores[row]
                top.append((-score, row))
            top.sort()
            del top[20:]

        visited += tree.search(asked, importances, lambda bound: len(top) < 20 or bound >= -top[-1][0], leaf)
        assert top == sorted((-s, i) for i, s in enumerate(scores))[:20]
    assert visited < 0.2 * 10 * 256


# --- cover-tree codes ---------------------------------------------------------------


def lloyd(rows, parts, entries, rounds):
    kept = [r for r in rows if usable(r[1])]
    longest = max((len(r[1]) for r in kept), default=1)
    width = -(-longest // parts) * parts
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = np.array([scaled(r[1], width) for r in kept], dtype=object).reshape(len(kept), parts, -1)
    books = [points[:entries, p].copy() for p in range(parts)]

    def nearest(p):
        squares = ((points[:, p, None] - books[p][None]) ** 2).sum(axis=2)
        return squares.argmin(axis=1), squares.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            own, _ = nearest(p)
            for entry in range(len(books[p])):
                if (own == entry).any():
                    books[p][entry] = points[own == entry, p].sum(axis=0) // int((own == entry).sum())
    codes, errors = zip(*(nearest(p) for p in range(parts)), strict=True)
    total = sum(errors)
    return Counter((r[0], "".join(f"{c:02x}" for c in code), int(e)) for r, code, e in zip(kept, zip(*codes, strict=True), total, strict=True)), books


@pytest.mark.parametrize("chunk", [5, 4096])
@pytest.mark.parametrize("entries,n", [(6, 150), (256, 150)])
def test_codes_are_those_of_plain_rounds(spark, chunk, entries, n):
    rows = odd_vectors(entries, n)
    codes, books = covertree.fit_codes(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries, chunk=chunk)
    want, want_books = lloyd(rows, 4, entries, 4)
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))
    got = covertree.with_label_errors(codes).collect()
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in got) == want
    sums = Counter()
    for r in got:
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got) and None in sums


def test_codes_of_wide_ragged_and_no_vectors(spark):
    rows = [(i, [float(i + j) for j in range(i % 7)], i) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, books = covertree.fit_codes(frame, entries=5)
    want, want_books = lloyd(rows, 4, 5, 4)
    assert all((a == b).all() for a, b in zip(books, want_books, strict=True))
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in codes.collect()) == want
    codes, books = covertree.fit_codes(frame.limit(0))
    assert covertree.with_label_errors(codes).collect() == []
    large = spark.createDataFrame([(i, [1e4 * i, 1.0, -2e4 * i, 3.0]) for i in range(9)], "vec_id long, embedding array<double>")
    large = large.selectExpr("*", "'' AS label")
    with pytest.raises(Exception, match="64 bits"):
        covertree.fit_codes(large.withColumn("embedding", F.transform("embedding", lambda x: x * 1e3)), entries=3)
    codes, _ = covertree.fit_codes(large, entries=3)
    want, _ = lloyd([(r["vec_id"], r["embedding"]) for r in large.collect()], 4, 3, 4)
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in codes.collect()) == want


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-3000, 3000, (12, 4))
    points = centres[rng.integers(0, 12, 700)] + rng.integers(-40, 41, (700, 4))
    points[rng.random(700) < 0.2] = points[0]
    tree = covertree.CoverTree.build(points)
    tree = covertree.CoverTree.unpacked(tree.packed())
    assert sorted(tree.order.tolist()) == list(range(700))
    for node in range(len(tree.lo)):
        own = points[tree.order[tree.lo[node] : tree.hi[node]]]
        assert np.sqrt(((own - own[0]) ** 2).sum(axis=1).max()) <= tree.radius[node]
        if tree.radius[node] > 0:
            children = range(tree.first[node], tree.first[node] + tree.count[node])
            assert [tree.lo[c] for c in children] + [tree.hi[node]] == [tree.lo[node]] + [tree.hi[c] for c in children]
    entries = np.concatenate((centres + 5, centres[:3], centres[:1] + 5))
    squares = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    lo, hi, entry, computed = tree.assign(points, entries)
    order = np.argsort(lo)
    assert (np.repeat(entry[order], (hi - lo)[order]) == squares.argmin(axis=1)[tree.order]).all()
    # Points in groups: whole subtrees are assigned, so far fewer distances than points times entries.
    assert computed < 0.2 * squares.size and (hi - lo).max() > 30


def test_matrix_floors_and_pads():
    import pyarrow as pa

    column = pa.array([[0.5, -0.0001], [], [1.0, 2.0, 3.0]])
    assert matrix(column).tolist() == [[512, -1, 0], [0, 0, 0], [1024, 2048, 3072]]
    assert matrix(column.slice(1, 2), width=4).tolist() == [[0, 0, 0, 0], [1024, 2048, 3072, 0]]
    assert matrix(pa.array([], pa.list_(pa.float32()))).shape == (0, 0)


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_ranked_search", "op13_cover_tree_codes"])
def test_queries_leave_tables_without_rows_whole(spark, tmp_path, sf_dir, name):
    for table in ("embeddings", "documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    full, empty = QUERIES[name](spark, sf_dir), QUERIES[name](spark, str(tmp_path))
    assert empty.collect() == [] and empty.dtypes == full.dtypes
