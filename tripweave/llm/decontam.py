"""Benchmark passages in documents, by winnowing.

Texts become words and words become hashes.  Of every ``reach - k + 1`` neighbouring k-word
hashes the smallest is kept as a fingerprint, so any ``reach`` words that a document shares
with a benchmark item leave a fingerprint that both keep.  Where fingerprints meet, the hit is
extended: the words around it are compared with the item's windows.  Only DataFrame functions
are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import ascii_lower
from tripweave.plans.lineage import cut_lineage

#: What separates words: ASCII other than digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words hashed together in a fingerprint.
K = 5
#: Fingerprints of the benchmark that are broadcast at once, some 20 MB.
BLOCK = 500_000
#: Every document has one row with this position, whether or not a fingerprint meets.
WHOLE = -1
_MARK = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, which an inlined column inside a lambda is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column, k: int) -> Column:
    """Hash of each k neighbouring words; empty where there are fewer."""
    last = F.size(hashes) - k
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))),
        ),
    ).otherwise(F.array().cast("array<long>"))


def _kept(grams: Column, width: int) -> Column:
    """Places of the first smallest hash of every ``width`` neighbouring ones."""
    last = F.size(grams) - width
    if width == 1:
        places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    else:
        places = F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                lambda i: _let(
                    F.slice(grams, i + 1, width),
                    lambda part: i + F.array_position(part, F.array_min(part)).cast("int") - 1,
                ),
            )
        )
    return F.when(last >= 0, places).otherwise(F.array().cast("array<int>"))


def _winnowed(hashes: Column, k: int, reach: int) -> Column:
    """Struct of the word hashes, the k-word hashes and the places of the fingerprints."""
    return _let(
        hashes,
        lambda own: _let(
            _grams(own, k),
            lambda grams: F.struct(
                own.alias("hashes"), grams.alias("grams"), _kept(grams, reach - k + 1).alias("kept")
            ),
        ),
    )


def _window(hashes: Column, start: Column, length: Column) -> Column:
    """Two hashes of a run of words, together 96 bits: equal for equal runs."""
    return _let(
        F.slice(hashes, start + 1, length),
        lambda run: F.struct(F.xxhash64(run).alias("key"), F.hash(run).alias("check")),
    )


def item_windows(items: DataFrame, window: int = 13, item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id as string, hashes of its words, length of its windows) of items with words."""
    rows = items.select(
        F.col(item).cast("string").alias("item_id"),
        _hashes(_words(F.coalesce(F.col(text), F.lit("")))).alias("hashes"),
    ).filter(F.size("hashes") > 0)
    return rows.withColumn("length", F.least(F.size("hashes"), F.lit(window)))


def fingerprints(windows: DataFrame, length: int) -> DataFrame:
    """The different fingerprints (``print``) of the items whose windows have ``length`` words.
    Any such window holds one, whatever other items there are."""
    own = windows.filter(F.col("length") == length).select(_winnowed(F.col("hashes"), min(K, length), length).alias("w"))
    places = own.select(F.explode("w.kept").alias("place"), "w.grams")
    return places.select(F.get("grams", F.col("place")).alias("print")).distinct()


def text_hash(text: str = "text") -> Column:
    """Tells rows of one key apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted item ids as strings),
    spans (disjoint (start, end) of the words hit) and text_hash (:func:`text_hash` of the text).

    A window is ``window`` neighbouring words of an item; an item of fewer words, but not none,
    is one window.  A document word within an occurrence of a window is hit.  Null and empty
    texts have no words; items without words have no windows; rows with the same key and text
    share their result, a row each; an empty table on either side gives no rows or no hits;
    other columns are not read.

    The fingerprints of the benchmark are broadcast ``block`` at a time, so their size has a
    bound; one block is one pass over the documents.  So is each length of items shorter than a
    window, of which there are fewer than ``window``.
    """
    windows = item_windows(items, window, item, item_text)
    # Items shorter than a window are winnowed apart, by their own length, so a short one does not
    # make the others' fingerprints any denser.
    short = {r["length"] for r in windows.select("length").distinct().collect()} - {window}
    met = _meetings(docs, cut_lineage(fingerprints(windows, window)), window, key, text, block, whole=True)
    for length in sorted(short):
        prints = cut_lineage(fingerprints(windows, length))
        met = met.unionByName(_meetings(docs, prints, length, key, text, block, whole=False))
    met = cut_lineage(met)

    # Extension: every window of the words around a meeting place that an item has as well.
    length = F.col("length")
    near = (
        met.filter(F.col("place") >= 0)
        .select("doc_id", "text_hash", "first", "around", "length")
        .filter(F.size("around") >= length)
        .select(
            "doc_id",
            "text_hash",
            "length",
            "first",
            "around",
            F.explode(F.sequence(F.lit(0), F.size("around") - length)).alias("at"),
        )
        .select(
            "doc_id",
            "text_hash",
            "length",
            (F.col("first") + F.col("at")).alias("start"),
            _window(F.col("around"), F.col("at"), length).alias("run"),
        )
    )
    wanted = (
        windows.select(
            "item_id",
            "length",
            "hashes",
            F.explode(F.sequence(F.lit(0), F.size("hashes") - F.col("length"))).alias("at"),
        )
        .select("item_id", "length", _window(F.col("hashes"), F.col("at"), F.col("length")).alias("run"))
        .distinct()
    )
    hits = near.select("doc_id", "text_hash", "length", "start", "run.*").join(
        cut_lineage(wanted.select("item_id", "length", "run.*")), ["length", "key", "check"]
    )
    per_text = hits.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("_runs"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    per_text = per_text.select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), _union(F.col("_runs")).alias("spans"), "items"
    )
    every = met.filter(F.col("place") == WHOLE).select("doc_id", "text_hash", "n_words")
    none = F.array().cast("array<struct<start: int, end: int>>")
    spans = F.coalesce("spans", none)
    found = F.coalesce("items", F.array().cast("array<string>"))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return every.join(
        per_text, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text")), "left"
    ).select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        found.alias("items"),
        spans.alias("spans"),
        "text_hash",
    )


def _meetings(
    docs: DataFrame, prints: DataFrame, length: int, key: str, text: str, block: int, whole: bool
) -> DataFrame:
    """Where documents have one of ``prints``: the place, and the words around it that a window of
    ``length`` words can take up.  With ``whole`` every document has a row at ``WHOLE`` as well."""
    k = min(K, length)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        text_hash(text).alias("text_hash"),
        _winnowed(_hashes(_words(F.coalesce(F.col(text), F.lit("")))), k, length).alias("w"),
    ).select("doc_id", "text_hash", "w.hashes", "w.grams", "w.kept")
    mark = docs.sparkSession.range(1).select(F.lit(_MARK).cast("long").alias("print"))
    blocks = max(1, -(-prints.count() // block))
    met = None
    for number in range(blocks):
        own = prints.filter(F.pmod(F.col("print"), F.lit(blocks)) == number)
        places = F.col("kept")
        if whole and number == 0:
            own, places = own.unionByName(mark).distinct(), F.concat(F.array(F.lit(WHOLE)), places)
        place = F.col("place")
        first = F.greatest(place - (length - k), F.lit(0))
        found = (
            rows.select("doc_id", "text_hash", "hashes", "grams", F.explode(places).alias("place"))
            .withColumn("print", F.when(place < 0, F.lit(_MARK)).otherwise(F.get("grams", place)))
            # At most ``block`` longs, as counted above.
            .join(F.broadcast(own), "print")
            .select(
                "doc_id",
                "text_hash",
                "place",
                F.lit(length).alias("length"),
                F.size("hashes").cast("long").alias("n_words"),
                first.alias("first"),
                F.when(place >= 0, F.slice("hashes", first + 1, F.lit(2 * length - k))).alias("around"),
            )
        )
        met = found if met is None else met.unionByName(found)
    return met


def _union(runs: Column) -> Column:
    """Disjoint spans that cover what ``runs`` cover, in order.

    A run starts a span if none reaches it from before: starts and ends are sorted apart, and
    a span ends where as many runs have ended as have begun.
    """
    return _let(
        F.array_sort(F.transform(runs, lambda r: r["start"])),
        lambda starts: _let(
            F.array_sort(F.transform(runs, lambda r: r["end"])),
            lambda ends: _let(
                F.filter(
                    F.sequence(F.lit(0), F.size(starts) - 1),
                    lambda i: (i == 0) | (F.get(starts, i) > F.get(ends, i - 1)),
                ),
                lambda heads: F.transform(
                    F.sequence(F.lit(0), F.size(heads) - 1),
                    lambda j: F.struct(
                        F.get(starts, F.get(heads, j)).alias("start"),
                        F.get(
                            ends,
                            F.coalesce(F.get(heads, j + 1), F.size(starts)) - 1,
                        ).alias("end"),
                    ),
                ),
            ),
        ),
    )
