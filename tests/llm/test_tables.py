"""Decontamination, sharding, revisits, the pipeline, and queries that SQL expresses."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from oracle_check import mismatch, open_tables

import corpus_pipeline
from tripweave.llm import decontam, rules, sharding, simhash, warc
from tripweave.llm.queries import ORACLES, QUERIES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, window=13):
    found = []
    for doc_id, text in docs:
        own, hit, named = words(text), set(), set()
        for item, other in items:
            theirs = words(other)
            n = min(window, len(theirs))
            runs = {tuple(theirs[j : j + n]) for j in range(len(theirs) - n + 1)} if n else set()
            for p in range(len(own) - n + 1):
                if tuple(own[p : p + n]) in runs:
                    hit |= set(range(p, p + n))
                    named.add(str(item))
        found.append((doc_id, len(own), len(hit), tuple(sorted(named))))
    return Counter(found)


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("alphabet", [["a", "b", "c", "É"], [f"w{i}" for i in range(30)]])
def test_contamination(spark, short, alphabet):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(rng.randrange(13, 40))) for i in range(6)] + [(90, None), (91, ""), (92, "...")]
    if short:
        items += [(50, "a b"), (51, "W1 w2 w3 w4 w5 w6")]
    docs = []
    for i in range(40):
        own = words(text(rng.randrange(60)))
        if i % 2:
            other, at = words(items[rng.randrange(6)][1]), rng.randrange(5)
            own[at:at] = other[at : at + rng.randrange(8, 30)]
        docs.append((i, " ".join(own)))
    docs += [(100, None), (101, ""), (None, items[0][1]), docs[3], (3, "other " + items[1][1]), (102, "x " * 500)]
    left = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int")
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hashes string")
    want = contamination(docs, items)
    for block in (decontam.BLOCK, 25):
        rows = decontam.contamination(left, right, block=block).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows) == want
        assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in rows)
    assert decontam.contamination(left.limit(0), right).count() == 0
    assert decontam.contamination(left, right.limit(0)).filter("n_hit > 0").count() == 0


def test_a_short_item_leaves_other_fingerprints_alone(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60))) for i in range(20)]
    prints = lambda rows: decontam.fingerprints(decontam.item_windows(spark.createDataFrame(rows, "item_id long, text string")), 13)
    alone = {r["print"] for r in prints(items).collect()}
    more = {r["print"] for r in prints([*items, (90, "w1"), (91, "w2 w3 w4")]).collect()}
    assert alone == more and len(alone) < 0.4 * 20 * 56


def test_contamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog. " * 2)], "item_id long, text string")
    rows = decontam.contamination(odd, items).collect()
    assert len(rows) == odd.count()
    assert sorted(r["doc_id"] for r in rows if r["n_hit"] == r["n_words"] > 0) == [1, 5, 5]


# --- sharding -----------------------------------------------------------------------


def test_slots_are_shared_out_evenly_and_mostly_stay():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 1009)
    counts = Counter(table)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:9], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(names, 1000)


def test_placement(spark, odd, nothing):
    placed = sharding.place(odd, ["a", "b", "c"], slots=101)
    assert placed.columns == [*odd.columns, "shard"]
    rows = placed.collect()
    assert len(rows) == odd.count() and {r["shard"] for r in rows} <= {"a", "b", "c"}
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert sharding.place(odd.withColumnRenamed("length", "shard"), ["a"]).select("shard").distinct().collect()[0][0] == "a"
    assert sharding.place(nothing, ["a"]).count() == 0
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()


# --- revisits -----------------------------------------------------------------------

RECORD = (
    "record_id long, url string, captured_at timestamp, status int, etag string, last_modified timestamp,"
    " headers map<string,string>, digest string, canonical string"
)


def at(hour):
    return dt.datetime(2024, 1, 1, hour)


def test_revisits(spark):
    page = "http://www.Example.org:80/a/?b=1&utm_source=x#top"
    same = "https://example.org/a?b=1"
    h = {"Content-Type": "text/html", "Age": "0"}
    rows = [
        (1, page, at(1), 200, "t1", at(0), h, "d1", "clash"),
        (2, same, at(2), 304, "W/t1", None, {"age": "9", "Content-Type": "no", "ETag": "t1"}, None, None),
        (3, same, at(3), 200, "t2", at(3), {}, "d2", None),
        (4, same, at(4), 304, "t1", None, None, None, None),
        (5, same, at(5), 304, None, at(3), None, None, None),
        (6, same, at(6), 304, None, None, None, None, None),
        (7, same, at(0), 304, "t1", None, None, None, None),
        (8, None, at(0), 304, "t1", None, None, None, None),
        (9, same, None, 304, "t1", None, None, None, None),
        (10, same, at(7), 404, "t1", None, None, None, None),
        (12, same, at(3), 304, "t2", None, None, None, None),
        (12, same, at(3), 304, "t2", None, None, None, None),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    assert sorted((r["record_id"], r["outcome"], r["response_id"], r["response_digest"]) for r in got) == [
        (2, "resolved", 1, "d1"),
        (4, "changed", None, None),
        (5, "resolved", 3, "d2"),
        (6, "changed", None, None),
        (7, "orphan", None, None),
        (8, "orphan", None, None),
        (9, "orphan", None, None),
        (12, "resolved", 3, "d2"),
        (12, "resolved", 3, "d2"),
    ]
    merged = next(r["headers"] for r in got if r["record_id"] == 2)
    assert merged == {"content-type": "text/html", "age": "9", "etag": "t1"}
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_repeated_fields_and_partial_responses(spark):
    page = "http://example.org/a"
    rows = [
        (1, page, at(1), 200, "t", None, {"Age": "0", "age": "1", "Vary": "a", "VARY": "a", "Content-Type": "x", "content-type": None}, "d1", None),
        # A part, and answers without a body, stand for nothing.
        (2, page, at(2), 206, "t", None, {"Content-Range": "1-2"}, "part", None),
        (3, page, at(3), 204, "other", None, None, "none", None),
        (4, page, at(4), 304, "t", None, {"AGE": "8", "Age": "9", "X": None}, None, None),
        (5, page, at(5), 203, "t", None, None, "d5", None),
        (6, page, at(6), 304, "t", None, None, None, None),
        (7, "http://example.org/b", at(1), 206, "t", None, None, "part", None),
        (8, "http://example.org/b", at(2), 304, "t", None, None, None, None),
        (9, page, at(7), None, "t", None, None, "nothing", None),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert {i: (r["outcome"], r["response_digest"]) for i, r in got.items()} == {
        4: ("resolved", "d1"), 6: ("resolved", "d5"), 8: ("orphan", None)
    }
    assert got[4]["headers"] == {"age": "8, 9", "vary": "a", "content-type": "x", "x": None}
    assert got[6]["headers"] == {}


def test_a_hot_url_spreads_over_ranges(spark):
    rows = [
        (i, "http://a.org/x", at(0) + dt.timedelta(seconds=i), 200 if i % 50 == 0 else 304, f"t{i // 50}", None, None, f"d{i}", None)
        for i in range(2000)
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORD).repartition(8)).collect()
    assert len(got) == 1960 and all(r["response_id"] == r["record_id"] // 50 * 50 for r in got)


# --- queries ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def con(sf_dir):
    return open_tables(sf_dir)


@pytest.mark.parametrize("name", ORACLES)
def test_query_against_sql(spark, con, sf_dir, name):
    assert mismatch(spark, con, sf_dir, name) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_returns_every_document(spark, documents, sf_dir, name):
    ids = {r["doc_id"] for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in documents.collect()}


def test_pipeline_stages(spark, sf_dir, documents, tmp_path):
    docs = documents
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        kept = {r["doc_id"] for r in after.collect()}
        assert kept <= {r["doc_id"] for r in before}, name
        if name == "quality rules":
            assert kept == {r["doc_id"] for r in rules.repetition(docs).filter("kept").collect()}
        if name == "near duplicates":
            found = simhash.near_duplicates(docs).collect()
            assert kept == {r["component_id"] for r in found} and after.count() == len(kept)
        if name == "benchmark decontamination":
            hit = contamination([(r["doc_id"], r["text"]) for r in before], items)
            assert kept == {d for d, n, h, _ in hit if not (h and 20 * h >= n)}
        if number < 4:
            assert after.columns == documents.columns, name
        else:
            assert kept == {r["doc_id"] for r in before}
        docs = after


def test_pipeline_keeps_one_row_of_repeated_ids(spark, sf_dir, odd):
    once = corpus_pipeline.near_duplicates(spark, odd, sf_dir)
    assert sorted(r["doc_id"] for r in once.filter("doc_id in (1, 5)").collect()) == [1]
    assert once.columns == odd.columns


LONG = {x: f"{x} is a text of its own " + " ".join(f"{x}{i}" for i in range(80)) for x in "ABCDE"}


@pytest.mark.parametrize(
    "rows, kept",
    [
        # Doc 5 has two texts; that one goes as a copy of 2 takes nothing from the other's group.
        ([(5, "A"), (5, "B"), (2, "B"), (7, "A"), (8, "A")], [(2, "B"), (5, "A")]),
        ([(5, "A"), (5, "B"), (5, "A")], [(5, "A"), (5, "B")]),
        ([(None, "A"), (None, "A"), (None, "B"), (4, "B"), (None, "C")], [(None, "A"), (None, "C"), (4, "B")]),
        ([(1, "A"), (2, "A"), (3, "B")], [(1, "A"), (3, "B")]),
        ([(None, "D"), (None, "D")], [(None, "D")]),
    ],
)
def test_one_row_of_each_group_of_copies_stays(spark, sf_dir, rows, kept):
    docs = spark.createDataFrame([(d, LONG[t], "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, component string, fp int")
    found = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert found.columns == docs.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"][0]) for r in found.collect()), key=order) == sorted(kept, key=order)


def test_decontamination_stage_decides_by_row(spark, sf_dir):
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(1, passage), (1, LONG["A"]), (None, passage), (None, LONG["B"]), (2, None), (3, ""), (4, LONG["C"] * 300)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, text_hash string")
    found = corpus_pipeline.decontaminated(spark, docs, sf_dir)
    want = Counter((d, t) for d, t in rows if t != passage)
    assert found.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in found.collect()) == want


def test_stages_of_odd_rows_and_of_none(spark, sf_dir, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).collect() == [], name
    toxic = corpus_pipeline.toxic_documents(spark, odd, sf_dir)
    assert toxic.columns == odd.columns and {None, 1, 2, 3, 4, 5, 8} >= {r["doc_id"] for r in toxic.collect()} - {7} >= {2, 3}
    pieces = corpus_pipeline.packed(spark, odd, sf_dir).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in odd.collect())
    places = Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places[r["sequence_id"]]
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 1024
