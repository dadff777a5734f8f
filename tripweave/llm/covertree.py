"""Vector codes from codebooks that are fitted over cover trees.

Vectors are cut into equal parts, each with a codebook of its own.  A task puts its vectors into
chunks and builds, once, a cover tree over each part of a chunk: a node stands for a run of the
tree's order and knows a centre and the distance to its farthest member.  A round of Lloyd's
method walks down all trees: an entry farther from a node's centre than the nearest one by more
than twice the node's radius is nearest to no member, by the triangle inequality.  A node left
with one entry is assigned as a whole, its sum being a difference of two cumulative sums; only
the others are opened, down to members that are compared exactly.

Components and sums are integers, so results do not depend on how vectors are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import map_arrow
from tripweave.llm.vectors import EXACT, largest, matrix, regrouped, usable_vectors
from tripweave.plans.lineage import cut_lineage
from tripweave.plans.skew import hot_keys_if_any, spread_join

#: Vectors of a chunk; a tree never grows beyond it, so the cost of a vector has a bound.
CHUNK = 4_096
#: Factor between the radii of a node and of its children.
BASE = 2.0
#: A node of so few members is opened into them at once.
SMALL = 8


class CoverTree:
    """Cover tree over integer points, as arrays.

    Node i holds ``order[lo[i]:hi[i]]``; its centre is ``order[lo[i]]``, a member; ``radius[i]``
    is the distance to its farthest member, rounded up.  Its children are the ``count[i]`` nodes
    from ``first[i]``: the first has the same centre, and all centres of one node's children are
    farther apart than the children's covering radius.
    """

    def __init__(self, order, lo, hi, first, count, radius):
        self.order, self.lo, self.hi = order, lo, hi
        self.first, self.count, self.radius = first, count, radius

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        order = np.zeros(len(points), np.int64)
        lo, hi, first, count, radius = [], [], [], [], []

        def node(begin, members, distances):
            """``members`` start with the centre; ``distances`` are squared, from it."""
            far = int(distances.max())
            lo.append(begin)
            hi.append(begin + len(members))
            first.append(-1)
            count.append(0)
            radius.append(0 if far == 0 else math.isqrt(far - 1) + 1)
            if far == 0:
                order[begin : begin + len(members)] = members
            else:
                todo.append((len(lo) - 1, members, distances))

        todo: list = []
        everyone = np.arange(len(points))
        node(0, everyone, _squares(points, points[0]))
        while todo:
            parent, members, distances = todo.pop()
            first[parent] = len(lo)
            begin = lo[parent]
            # The largest power of the base below the radius; none for the few of a small node.
            scale = BASE ** (math.ceil(math.log(math.sqrt(distances.max()), BASE)) - 1)
            reach = 0.0 if len(members) <= SMALL else scale * scale
            while len(members):
                near = distances <= reach
                near[0] = True
                node(begin, members[near], distances[near])
                begin += int(near.sum())
                members = members[~near]
                if len(members):
                    distances = _squares(points[members], points[members[0]])
            count[parent] = len(lo) - first[parent]
        as_int = lambda values: np.array(values, np.int64)
        return cls(order, as_int(lo), as_int(hi), as_int(first), as_int(count), as_int(radius))

    def packed(self) -> dict[str, bytes]:
        nodes = np.stack([self.lo, self.hi, self.first, self.count]).astype("<i4")
        return {"order": self.order.astype("<i4").tobytes(), "nodes": nodes.tobytes(), "radius": self.radius.astype("<i8").tobytes()}

    @classmethod
    def unpacked(cls, tree: dict[str, bytes]) -> CoverTree:
        nodes = np.frombuffer(tree["nodes"], "<i4").astype(np.int64).reshape(4, -1)
        return cls(np.frombuffer(tree["order"], "<i4").astype(np.int64), *nodes, np.frombuffer(tree["radius"], "<i8"))

    def assign(self, points: np.ndarray, entries: np.ndarray):
        """Runs of ``order`` and the nearest entry of each (ties to the first), as arrays lo, hi,
        entry; with the number of distances computed."""
        different, places = np.unique(entries, axis=0, return_index=True)
        # Equal entries: only the first can be nearest.
        places = np.sort(places)
        different = entries[places]
        nodes = np.zeros(1, np.int64)
        open_to = np.ones((1, len(places)), bool)
        runs, computed = [], 0
        while len(nodes):
            squares = distances(points[self.order[self.lo[nodes]]], different).astype(np.float64)
            computed += int(open_to.sum())
            squares[~open_to] = np.inf
            nearest = squares.argmin(axis=1)
            # Twice the radius beyond the nearest; the factor covers the rounding of the roots.
            reach = (np.sqrt(squares.min(axis=1)) + 2.0 * self.radius[nodes]) ** 2 * (1 + 1e-9)
            open_to &= squares <= reach[:, None]
            done = (self.radius[nodes] == 0) | (open_to.sum(axis=1) == 1)
            runs.append((self.lo[nodes[done]], self.hi[nodes[done]], places[nearest[done]]))
            left = nodes[~done]
            times = self.count[left]
            ahead = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            open_to = np.repeat(open_to[~done], times, axis=0)
            nodes = np.repeat(self.first[left], times) + ahead
        lo, hi, entry = (np.concatenate(column) for column in zip(*runs, strict=True))
        return lo, hi, entry, computed


def _squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances, exact for integer points."""
    away = points - centre
    return np.einsum("ij,ij->i", away, away)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact."""
    kind = np.int64
    if 4.0 * max(largest(points), largest(entries)) ** 2 * max(points.shape[1], 1) < EXACT:
        kind = np.float64
    points, entries = points.astype(kind), entries.astype(kind)
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(axis=1)


def _sized(values: np.ndarray, parts: int) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    if 4.0 * largest(values) ** 2 * values.shape[1] / parts >= 2.0**63:
        raise OverflowError("squared distances of these vectors may exceed 64 bits")
    return values.astype("<i2" if largest(values) <= np.iinfo("<i2").max else "<i4")


def _chunk_points(row: dict) -> np.ndarray:
    return np.frombuffer(row["points"], row["kind"]).astype(np.int64).reshape(row["size"], -1)


_TREES = (
    "ids array<long>, labels array<string>, size int, kind string, points binary,"
    " trees array<struct<order: binary, nodes: binary, radius: binary>>"
)


def chunk_trees(vectors: DataFrame, width: int, parts: int, scale: float, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of rows (vec_id, vector, label): its ids, labels and scaled
    vectors, filled up with zeros to ``width``, and a tree over each part."""

    def build(batches):
        for table in regrouped(batches, chunk):
            points = matrix(table.column("vector").combine_chunks(), scale, width)
            stored = _sized(points, parts)
            points = stored.astype(np.int64)
            trees = [CoverTree.build(part).packed() for part in np.split(points, parts, axis=1)]
            row = {
                "ids": table.column("vec_id").to_pylist(),
                "labels": table.column("label").to_pylist(),
                "size": len(points),
                "kind": stored.dtype.str,
                "points": stored.tobytes(),
                "trees": trees,
            }
            yield pa.RecordBatch.from_pylist([row], schema=_TREES_ARROW)

    return map_arrow(vectors, build, _TREES)


_TREES_ARROW = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("labels", pa.list_(pa.string())),
        ("size", pa.int32()),
        ("kind", pa.string()),
        ("points", pa.binary()),
        ("trees", pa.list_(pa.struct([("order", pa.binary()), ("nodes", pa.binary()), ("radius", pa.binary())]))),
    ]
)


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round of Lloyd's method: each entry becomes the mean of the parts nearest to it,
    rounded down; unused entries stay."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]

    def assign(batches):
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for part, points in enumerate(np.split(_chunk_points(row), parts, axis=1)):
                    tree = CoverTree.unpacked(row["trees"][part])
                    lo, hi, entry, _ = tree.assign(points, books[part])
                    so_far = np.concatenate((np.zeros((1, width), np.int64), np.cumsum(points[tree.order], axis=0)))
                    np.add.at(sums[part], entry, so_far[hi] - so_far[lo])
                    np.add.at(counts[part], entry, hi - lo)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part, pa.int32()),
                "entry": pa.array(entry, pa.int32()),
                "n": pa.array(counts[part, entry], pa.int64()),
                "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
            }
        )

    found = map_arrow(trees, assign, "part int, entry int, n long, sums array<long>")
    summed = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums")
    )
    books = [book.copy() for book in books]
    # One row an entry: as many as the codebooks have.
    for row in summed.collect():
        books[row["part"]][row["entry"]] = np.array(row["sums"], np.int64) // row["n"]
    return books


def _codes(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    parts = len(books)

    def encode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.zeros((row["size"], parts), np.int64)
                errors = np.zeros(row["size"], np.int64)
                for part, points in enumerate(np.split(_chunk_points(row), parts, axis=1)):
                    tree = CoverTree.unpacked(row["trees"][part])
                    lo, hi, entry, _ = tree.assign(points, books[part])
                    begins = np.argsort(lo)
                    codes[tree.order, part] = np.repeat(entry[begins], (hi - lo)[begins])
                    errors += _squares(points, books[part][codes[:, part]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": pa.array(row["ids"], pa.int64()),
                        "label": pa.array(row["labels"], pa.string()),
                        "code": pa.array(["".join(f"{c:02x}" for c in own) for own in codes.tolist()], pa.string()),
                        "error": pa.array(errors, pa.int64()),
                    }
                )

    return map_arrow(trees, encode, "vec_id long, label string, code string, error long")


def first_books(vectors: DataFrame, width: int, parts: int, entries: int, scale: float) -> list[np.ndarray]:
    """The parts of the vectors with the ``entries`` smallest keys, in their order."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    points = matrix(first.column("vector").combine_chunks(), scale, width).astype(np.int64)
    return np.split(points, parts, axis=1)


def fit_codes(
    rows: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 1024.0,
    chunk: int = CHUNK,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label as string, code, error) of the vectors with finite components only, and
    the codebooks.

    A component x counts as floor(scale * x).  The codebook of each of ``parts`` starts as that
    part of the ``entries`` vectors of the smallest keys (vectors without a key after the others,
    equal keys by their components; all vectors if there are fewer).  ``code`` names the nearest
    entry of each part, ties to the first, with two hex digits; ``error`` is the squared distance.

    Vectors that are null or hold null or non-finite components are left out.  Shorter vectors
    count as filled up with zeros to the longest, and to a multiple of ``parts``.  Rows that repeat
    a key are rows of their own; an empty table gives no rows; other columns are not read.
    Components so large that a squared distance may exceed 64 bits are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits an entry, so 1 to 256 entries")
    vectors = usable_vectors(rows, key, vector, F.col(label).cast("string").alias("label"))
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    books = first_books(vectors, width, parts, entries, scale)
    if not len(books[0]):
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    trees = cut_lineage(chunk_trees(vectors, width, parts, scale, chunk))
    for _ in range(rounds):
        books = _round(trees, books)
    return cut_lineage(_codes(trees, books)), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Add label_error: the sum of ``error`` over the rows of the same label, nulls being one.

    Labels that hold very many rows are split in the join.
    """
    keyed = codes.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(""))})
    totals = cut_lineage(
        keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    )
    hot = hot_keys_if_any(totals, ["_none", "_label"], "_rows")
    joined = spread_join(keyed, totals.drop("_rows"), ["_none", "_label"], ["vec_id", "code"], hot)
    return joined.drop("_none", "_label")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and place, joined by commas."""
    listed = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return hashlib.sha256(listed.encode()).hexdigest()
