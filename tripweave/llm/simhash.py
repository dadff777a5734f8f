"""Near duplicates by SimHash, found in a Gray-order hierarchical index.

A fingerprint has 64 bits.  Two that differ in at most ``distance`` bits agree on all bits of
at least ``blocks - distance`` of the ``blocks`` they are cut into, so for every choice of that
many blocks the fingerprints are dealt out by the bits chosen: those bits are the pattern that
the top node of an index has in common.  Below it the fingerprints are sorted by Gray rank,
in which neighbours differ in few bits; runs of them form nodes, each with the mask of the
bits its members share and their pattern, less what the node above has said already.  A search
adds up differences on the way down and drops a whole group once they exceed the distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import key_and_text, map_arrow
from tripweave.operators.components import connected_components
from tripweave.plans.lineage import cut_lineage
from tripweave.plans.skew import HOT_ROWS, hot_keys_if_any, spread_join

BITS = 64
#: Members of a lowest node, and nodes under a node above it.
LEAF, FANOUT = 16, 8
#: Fingerprints that one top node may hold before its bits are cut further, and how many top
#: nodes may at most be above it; the limit rises beyond that, so their list stays short.
NODE_LIMIT, MANY_NODES = 4_096, 1_000_000
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


# --- fingerprints -------------------------------------------------------------------


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, as an unsigned number."""
    found = text.encode().split()
    n = len(found) - words + 1
    if n < 1:
        if not found:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(found), seed=42)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (np.append(0, ends[:-1])[:n]).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):
        hashes = np.array(
            [digest(joined[a:b], 42) for a, b in zip(starts[at : at + SLICE], stops[at : at + SLICE], strict=True)],
            np.uint64,
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3
) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of each lower-cased (A-Z) text, as a signed long."""
    capitals = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    table = bytes(capitals.get(i, i) for i in range(256))

    def hashed(batches):
        for batch in batches:
            lowered = (t.encode().translate(table).decode() for t in batch.column("text").to_pylist())
            found = np.array([fingerprint(t, words) for t in lowered], np.uint64)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))}
            )

    return map_arrow(key_and_text(docs, key, text), hashed, "doc_id long, fp long")


# --- the index ----------------------------------------------------------------------


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the order in which neighbours differ in one bit."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints (uint64, all different), searched from the top."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        same, pattern = np.full(len(fps), ~np.uint64(0)), self.fps
        fan, levels = LEAF, []
        while len(same) > 1:
            starts = np.arange(0, len(same), fan)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(same))))
            above = np.bitwise_and.reduceat(same & ~(pattern ^ first), starts)
            levels.append((same, pattern, fan, above))
            same, pattern, fan = above, pattern[starts] & above, FANOUT
        #: From the top: what a node shares beyond the node above it, its pattern there, fan-out.
        self.levels = []
        for own, bits, width, above in reversed(levels):
            rest = own & ~np.repeat(above, width)[: len(own)]
            self.levels.append((rest, bits & rest, width))
        self.top = (same, pattern)

    def within(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's place in ``queries``, member's place in ``fps``) at most so far apart."""
        mask, bits = self.top
        query = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        apart = np.bitwise_count((queries[query] ^ bits[node]) & mask[node]).astype(np.int16)
        for mask, bits, width in self.levels:
            near = apart <= distance
            query, node, apart = query[near], node[near], apart[near]
            child = (node[:, None] * width + np.arange(width)).ravel()
            query, apart = np.repeat(query, width), np.repeat(apart, width)
            there = child < len(mask)
            query, node, apart = query[there], child[there], apart[there]
            apart = apart + np.bitwise_count((queries[query] ^ bits[node]) & mask[node])
        near = apart <= distance
        return query[near], node[near]


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that can be reached from a smaller one in steps of at most ``distance``
    bits, with the smallest it reaches: the components of all links, without listing all links.

    The search spreads from a start; what has been reached is asked for its neighbours once.
    """
    index = GrayIndex(fps)
    fps = index.fps
    root = np.full(len(fps), -1, np.int64)
    if len(fps) <= 4 * LEAF:
        a, b = index.within(fps, distance)
        label = np.arange(len(fps))
        while True:
            lower = label.copy()
            np.minimum.at(lower, a, label[b])
            if np.array_equal(lower, label):
                break
            label = lower
        root = label
    else:
        for start in range(len(fps)):
            if root[start] >= 0:
                continue
            root[start] = start
            front = np.array([start])
            while len(front):
                reached = []
                for at in range(0, len(front), 256):
                    _, member = index.within(fps[front[at : at + 256]], distance)
                    member = np.unique(member)
                    member = member[root[member] < 0]
                    root[member] = start
                    reached.append(member)
                front = np.concatenate(reached)
    least = np.full(len(fps), ~np.uint64(0))
    np.minimum.at(least, root, fps)
    least = least[root]
    other = least != fps
    return fps[other], least[other]


# --- dealing out --------------------------------------------------------------------


def _cuts(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(start, width) of ``blocks`` blocks of about equal width over the lowest ``bits``."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _top_masks(distance: int, blocks: int) -> list[int]:
    """For each choice of blocks the mask of its bits; one of them is free of differences."""
    cuts = [((1 << width) - 1) << start for start, width in _cuts(BITS, blocks)]
    return [sum(chosen) for chosen in combinations(cuts, len(cuts) - distance)]


def _finer_masks(mask: int, distance: int) -> list[int]:
    """``mask`` with one more block of the free bits, of distance + 1 blocks."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [
        mask | sum(1 << free[i] for i in range(start, start + width))
        for start, width in _cuts(len(free), distance + 1)
    ]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _deal(fps: DataFrame, masks: DataFrame | list[int]) -> DataFrame:
    """Rows (mask, pattern, fp): every fingerprint under each of the masks."""
    given = F.array(*(F.lit(_signed(m)).cast("long") for m in masks))
    return fps.select("fp", F.explode(given).alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, limit: int | None = None) -> DataFrame:
    """Links (a, b) between the different fingerprints of ``fps`` (fp, materialised) whose
    components are those of all pairs at most ``distance`` bits apart.

    A top node holds the fingerprints that agree on its mask.  One that has more than the limit
    is dealt out again by masks of more bits, until at most 18 bits are free; then it holds no
    more than 2**18 different fingerprints whatever the input.
    """
    masks = _top_masks(distance, blocks)
    crowd = limit or NODE_LIMIT
    if limit is None:
        crowd = max(crowd, fps.count() * len(masks) // MANY_NODES)
    dealt, found = _deal(fps, masks), []
    while True:
        keys = ["mask", "pattern"]
        finer = {m: _finer_masks(m, distance) for m in masks if BITS - m.bit_count() > 18}
        crowded = None
        if finer:
            crowded = cut_lineage(
                dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowd).select(*keys)
            )
            if crowded.isEmpty():
                crowded = None
        # At most rows / limit keys, so a million at most: safe to broadcast.
        fitting = dealt if crowded is None else dealt.join(F.broadcast(crowded), keys, "left_anti")
        found.append(_linked(fitting, distance))
        if crowded is None:
            break
        wider = F.create_map(
            *(
                part
                for m, more in finer.items()
                for part in (
                    F.lit(_signed(m)).cast("long"),
                    F.array(*(F.lit(_signed(x)).cast("long") for x in more)),
                )
            )
        )
        dealt = cut_lineage(
            dealt.join(F.broadcast(crowded), keys, "left_semi")
            .select("fp", F.explode(wider[F.col("mask")]).alias("mask"))
            .withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
            .distinct()
        )
        masks = sorted({x for more in finer.values() for x in more})
    joined = found[0]
    for more in found[1:]:
        joined = joined.unionByName(more)
    return joined.distinct()


def _linked(dealt: DataFrame, distance: int) -> DataFrame:
    """Spanning links of every top node: its rows come together, sorted, one node at a time."""

    def search(batches):
        mask = pattern = None
        held: list[np.ndarray] = []

        def flush():
            fps = np.concatenate(held) if len(held) > 1 else held[0]
            a, b = spanning_links(fps.view(np.uint64), distance)
            return a.view(np.int64), b.view(np.int64)

        for batch in batches:
            masks, patterns, fps = (batch.column(i).to_numpy() for i in range(3))
            if not len(fps):
                continue
            turn = np.flatnonzero((masks[1:] != masks[:-1]) | (patterns[1:] != patterns[:-1])) + 1
            bounds = np.concatenate([[0], turn, [len(fps)]])
            ones, others = [], []
            # Most nodes have one row: only the first, the last and those of more need a look.
            several = np.flatnonzero(np.diff(bounds) > 1)
            looked = np.unique(np.concatenate([[0], several, [len(bounds) - 2]]))
            for i in looked:
                a, b = bounds[i], bounds[i + 1]
                if (masks[a], patterns[a]) != (mask, pattern):
                    if held and sum(map(len, held)) > 1:
                        x, y = flush()
                        ones.append(x)
                        others.append(y)
                    held = []
                    mask, pattern = masks[a], patterns[a]
                held.append(fps[a:b])
            if ones:
                yield _pairs(np.concatenate(ones), np.concatenate(others))
        if held and sum(map(len, held)) > 1:
            yield _pairs(*flush())

    together = (
        dealt.select("mask", "pattern", "fp").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    )
    return map_arrow(together, search, "a long, b long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 3,
    distance: int = 3,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows (doc_id, fp, component, component_id): the smallest doc_id that links of at most
    ``distance`` differing bits reach from the row, itself included, and the smallest fingerprint,
    which names the component where doc_ids repeat or are missing.

    Null, empty and blank texts have fingerprint 0, linked like any other; a text of fewer words
    than a shingle is one shingle.  Repeated rows share fingerprint and component; where no row
    of a component has a doc_id, component_id is null.  An empty table gives no rows and other
    columns are not read.  Equal fingerprints are one entry of the index, so copies cost a count.
    """
    hashed = cut_lineage(fingerprints(docs, key, text, words))
    different = cut_lineage(
        hashed.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    )
    joined = cut_lineage(links(different.select("fp"), distance))
    members = connected_components(different.select(F.col("fp").alias("node")), joined)
    named = cut_lineage(different.join(members.withColumnRenamed("node", "fp"), "fp"))
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_rows"))
    least = cut_lineage(least)
    # A component of very many fingerprints is split.
    crowded = hot_keys_if_any(least, ["component"], "_rows", hot_rows)
    fields = named.select("fp", "component", "_rows")
    placed = cut_lineage(spread_join(fields, least.drop("_rows"), ["component"], ["fp"], crowded))
    hot = hot_keys_if_any(placed, ["fp"], "_rows", hot_rows)
    return spread_join(hashed, placed.drop("_rows"), ["fp"], ["doc_id"], hot).select(
        "doc_id", "fp", "component", "component_id"
    )
