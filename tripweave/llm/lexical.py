"""Exact ranked lexical search over ball trees of sparse document weights.

A document is a sparse vector of integer term weights, an item one of integer term importances,
and its score their inner product.  Tasks collect documents into balls: a node knows its integer
centroid and a radius rounded up, so no document below it can score more than

    item . centroid + |item| * radius

where only the item's terms that occur below the node count.  The nodes are visited best first
until no bound reaches the item's list; at the leaves scores are computed as integers.  All
sums of the bound are integers as well, and both roots are rounded up, so nothing is lost.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import ascii_lower, key_and_text, map_arrow
from tripweave.llm.vectors import leading, merged_lists
from tripweave.plans.lineage import cut_lineage, cut_measured
from tripweave.plans.ranking import dense_ranks

#: What separates terms, once A-Z are small letters: ASCII other than digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms of the items that are searched for at once; more take another pass over the documents.
BLOCK_TERMS = 200_000
#: A tree takes up so many documents, or weights if these are reached first.
TREE_DOCS, TREE_WEIGHTS = 8_192, 2_000_000
LEAF = 64

#: Per byte: letters and digits as small letters, other ASCII a blank, the rest as it is.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (_item, item_id, terms): the items with a term, numbered from 0 in order of item_id,
    each with its different terms."""
    words = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS)
    terms = F.array_distinct(F.array_remove(words, ""))
    rows = items.select(F.col(item).alias("item_id"), terms.alias("terms")).filter(F.size("terms") > 0)
    return dense_ranks(rows, ["item_id"], "_item", start=0)


def _blocks(numbered: DataFrame, most: int) -> Iterator[tuple[int, int]]:
    """First and last number of items that together have ``most`` terms at most, or of one."""
    sizes = numbered.select("_item", F.size("terms").alias("n")).orderBy("_item").toLocalIterator()
    first = last = None
    held = 0
    for number, n in sizes:
        if first is not None and held + n > most:
            yield first, last
            first, held = None, 0
        first = number if first is None else first
        last, held = number, held + n
    if first is not None:
        yield first, last


def term_counts(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n, terms, counts) of the documents that have a term at all: n terms with
    repeats, and the places in ``terms`` of those found there, with their numbers."""
    rows = key_and_text(docs, key, text).select("doc_id", F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def count(batches):
        place = shared.value.get
        for batch in batches:
            keys, n, starts, found, counts = [], [], [0], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = text.as_py().translate(_FOLD).split()
                if not own:
                    continue
                seen = Counter(map(place, own))
                seen.pop(None, None)
                keys.append(key)
                n.append(len(own))
                found.extend(seen.keys())
                counts.extend(seen.values())
                starts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return map_arrow(rows, count, "doc_id long, n long, terms array<int>, counts array<long>")


def importance(documents: int, holding: int) -> int:
    """Of a term that ``holding`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _length_norm(n: str, documents: int, terms: int) -> Column:
    """100 - 50 + ((50 * n * documents) div terms); the product may need more than 64 bits."""
    if not terms:
        return F.lit(50).cast("long")
    big = "decimal(19, 0)"
    return F.lit(50) + F.floor(F.expr(f"(cast(50 * {n} as {big}) * cast({documents} as {big})) div cast({terms} as {big})"))


class BallTree:
    """Sparse integer rows in balls, and the search for the largest inner products.

    ``starts``, ``terms`` and ``weights`` are the rows, weights at least 1; ``terms`` are any
    integers.  Sums of squares must stay below 2**63.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, leaf: int = LEAF):
        self._vocabulary, local = np.unique(terms, return_inverse=True)
        self._width = len(self._vocabulary)
        self._leaf = leaf
        self.order = np.zeros(len(starts) - 1, np.int64)
        self._lo, self._hi, self._left, self._radius = [], [], [], []
        centres = []
        rows = np.arange(len(starts) - 1)
        todo = [(self._node(0, len(rows)), rows, np.diff(starts), local, weights.astype(np.int64))]
        ends, kept_terms, kept_weights = [], [], []
        while todo:
            node, rows, sizes, terms, weights = todo.pop()
            present, centre = self._centre(len(rows), terms, weights)
            distance = self._distance(sizes, terms, weights, present, centre)
            far = int(distance.max())
            self._radius[node] = 0 if far == 0 else math.isqrt(far - 1) + 1
            centres.append((node, present, centre))
            if len(rows) <= leaf or far == 0:
                self.order[self._lo[node] : self._hi[node]] = rows
                ends.append((self._lo[node], sizes, terms, weights))
                continue
            upper = self._halves(sizes, terms, weights, distance)
            cut = self._lo[node] + int((~upper).sum())
            self._left[node] = len(self._lo)
            of_entry = np.repeat(upper, sizes)
            for lo, hi, side, entries in (
                (self._lo[node], cut, ~upper, ~of_entry),
                (cut, self._hi[node], upper, of_entry),
            ):
                todo.append((self._node(lo, hi), rows[side], sizes[side], terms[entries], weights[entries]))
        ends.sort(key=lambda e: e[0])
        sizes = np.concatenate([e[1] for e in ends])
        self._starts = np.concatenate(([0], np.cumsum(sizes)))
        self._terms = np.concatenate([e[2] for e in ends])
        self._weights = np.concatenate([e[3] for e in ends])
        # Centroids by term: the nodes below which it occurs, and its component there.
        nodes = np.concatenate([np.full(len(present), node) for node, present, _ in centres])
        present = np.concatenate([present for _, present, _ in centres])
        by_term = np.argsort(present, kind="stable")
        self._nodes = nodes[by_term]
        self._components = np.concatenate([centre for *_, centre in centres])[by_term]
        self._begins = np.searchsorted(present[by_term], np.arange(self._width + 1))
        self._lo, self._hi = np.array(self._lo), np.array(self._hi)
        self._radius = np.array(self._radius, np.int64)

    def _node(self, lo: int, hi: int) -> int:
        self._lo.append(lo)
        self._hi.append(hi)
        self._left.append(-1)
        self._radius.append(0)
        return len(self._lo) - 1

    def _centre(self, n: int, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms that occur, and the mean of their weights as whole numbers."""
        if len(terms) * 4 >= self._width:
            sums = np.bincount(terms, weights, self._width)
            present = np.flatnonzero(sums)
            sums = sums[present]
        else:
            present, inverse = np.unique(terms, return_inverse=True)
            sums = np.bincount(inverse, weights)
        return present, np.rint(sums / n).astype(np.int64)

    def _distance(self, sizes, terms, weights, present, point) -> np.ndarray:
        """Squared distance of each row to a sparse point, exact."""
        dense = np.zeros(self._width, np.int64)
        dense[present] = point
        return self._summed(sizes, weights * (weights - 2 * dense[terms])) + int((point * point).sum())

    @staticmethod
    def _summed(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def _halves(self, sizes, terms, weights, distance) -> np.ndarray:
        """Mark the half of the rows nearer to the second of two rows that lie far apart."""
        ends = np.cumsum(sizes)
        first = int(np.argmax(distance))
        own = slice(ends[first] - sizes[first], ends[first])
        to_first = self._distance(sizes, terms, weights, terms[own], weights[own])
        second = int(np.argmax(to_first))
        own = slice(ends[second] - sizes[second], ends[second])
        to_second = self._distance(sizes, terms, weights, terms[own], weights[own])
        upper = np.ones(len(sizes), bool)
        upper[np.argsort(to_first - to_second, kind="stable")[: len(sizes) // 2]] = False
        return upper

    def search(self, terms: np.ndarray, importances: np.ndarray, reaches, leaf) -> int:
        """Call ``leaf(lo, scores)`` for the leaves, best bound first, while ``reaches(bound)``;
        lo is the place in ``order`` of the leaf's first row.  The number of leaves visited."""
        at = np.searchsorted(self._vocabulary, terms)
        known = at < self._width
        known[known] = self._vocabulary[at[known]] == terms[known]
        at, importances = at[known], importances[known]
        products = np.zeros(len(self._lo), np.int64)
        squares = np.zeros(len(self._lo), np.int64)
        for term, value in zip(at.tolist(), importances.tolist(), strict=True):
            own = slice(self._begins[term], self._begins[term + 1])
            products[self._nodes[own]] += value * self._components[own]
            squares[self._nodes[own]] += value * value
        # Rounded up: a root in doubles is less than one away from the true one.
        norms = np.where(squares > 0, np.sqrt(squares).astype(np.int64) + 1, 0)
        bounds = products + norms * self._radius
        asked = np.zeros(self._width, np.int64)
        asked[at] = importances
        visited = 0
        heap = [(-int(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if not reaches(-bound):
                break
            child = self._left[node]
            if child < 0:
                lo, hi = self._lo[node], self._hi[node]
                entries = slice(self._starts[lo], self._starts[hi])
                values = asked[self._terms[entries]] * self._weights[entries]
                leaf(lo, self._summed(np.diff(self._starts[lo : hi + 1]), values))
                visited += 1
                continue
            for below in (child, child + 1):
                heapq.heappush(heap, (max(bound, -int(bounds[below])), below))
        return visited


class _Best:
    """An item's list so far: scores above 0, the highest first, ties to the smaller key."""

    def __init__(self, k: int):
        self._k = k
        self.score = self.key = np.zeros(0, np.int64)
        self.keyless = np.zeros(0, bool)
        self._least = 1

    def reaches(self, bound: int) -> bool:
        return bound >= self._least

    def add(self, score, key, keyless) -> None:
        useful = score >= self._least
        if not useful.any():
            return
        score = np.concatenate((self.score, score[useful]))
        key = np.concatenate((self.key, key[useful]))
        keyless = np.concatenate((self.keyless, keyless[useful]))
        best = leading(np.zeros(len(score), np.int8), score, keyless, key, self._k)
        self.score, self.key, self.keyless = score[best], key[best], keyless[best]
        if len(best) == self._k:
            self._least = int(self.score[-1])


def _trees(batches) -> Iterator[tuple[np.ndarray, np.ndarray, BallTree]]:
    """Keys, marks of missing keys, and the tree of as many rows as one takes up."""
    held: list[pa.RecordBatch] = []
    docs = weights = 0
    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(np.cumsum(sizes[at:]), TREE_WEIGHTS - weights, "right"))
            take = min(TREE_DOCS - docs, max(room, 0 if held else 1), batch.num_rows - at)
            if take:
                held.append(batch.slice(at, take))
                docs, weights, at = docs + take, weights + int(sizes[at : at + take].sum()), at + take
            if at < batch.num_rows:
                yield _tree(held)
                held, docs, weights = [], 0, 0
    if held:
        yield _tree(held)


def _tree(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, BallTree]:
    table = pa.Table.from_batches(held).combine_chunks()
    keys, terms, weights = (table.column(c).combine_chunks() for c in ("doc_id", "terms", "weights"))
    lengths = np.asarray(pc.list_value_length(terms), np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    tree = BallTree(starts, np.asarray(terms.flatten()), np.asarray(weights.flatten()))
    return np.asarray(keys.fill_null(0), np.int64), np.asarray(keys.is_null(), bool), tree


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents with the highest score above 0
    for each row of ``items``, all if fewer, equal scores by ascending key.

    Terms are runs of ASCII letters and digits and of any other than ASCII characters, in whole
    texts; A-Z count as small letters.  Null texts and texts without a term are no documents and
    no items.  Rows that repeat a key are documents, or items, of their own; a document without
    a key ranks after others of its score.  An empty table on either side gives no rows; other
    columns are not read.

    Items are searched for in blocks of ``block_terms`` terms at most (an item of more is a block
    of its own): their terms, with the numbers of documents that hold them, are what is broadcast.
    A block is one pass over the documents.  The counts of a pass are written once, as document
    frequencies must be known before a weight is.
    """
    spark = docs.sparkSession
    numbered = cut_lineage(item_terms(items, item, item_text))
    found = None
    for first, last in _blocks(numbered, block_terms):
        block = numbered.filter(F.col("_item").between(first, last))
        asked = block.select("_item", "terms").collect()
        vocabulary = sorted({t for row in asked for t in row["terms"]})
        lists = _block(docs, asked, vocabulary, k, key, text)
        found = lists if found is None else found.unionByName(lists)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    found, most = cut_measured(found, "_part")
    best = merged_lists(found, ["_item"], k, most, "doc_id")
    return best.join(numbered.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")


_FOUND = "_item long, _part long, doc_id long, score long"


def _block(docs: DataFrame, asked: list, vocabulary: list[str], k: int, key: str, text: str) -> DataFrame:
    counted = cut_lineage(term_counts(docs, vocabulary, key, text))
    whole = counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    weight = {t: importance(whole["documents"], n) for t, n in holding.collect()}
    place = {t: i for i, t in enumerate(vocabulary)}
    queries = []
    for number, terms in asked:
        own = np.array(sorted(place[t] for t in terms if weight.get(place[t], 0) > 0), np.int64)
        if len(own):
            queries.append((number, own, np.array([weight[t] for t in own.tolist()], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast(queries)
    weighed = counted.filter(F.size("terms") > 0).select(
        "doc_id",
        "terms",
        F.col("counts"),
        _length_norm("n", whole["documents"], whole["terms"]).alias("m"),
    )
    weighed = weighed.select(
        "doc_id",
        "terms",
        F.expr("transform(counts, c -> (1000000000L * c) div (1000L * c + 20L * m))").alias("weights"),
    )

    def search(batches):
        lists = [_Best(k) for _ in shared.value]
        for keys, keyless, tree in _trees(batches):
            for (_, terms, importances), held in zip(shared.value, lists, strict=True):

                def leaf(lo, scores, held=held):
                    rows = tree.order[lo : lo + len(scores)]
                    held.add(scores, keys[rows], keyless[rows])

                tree.search(terms, importances, held.reaches, leaf)
        part = TaskContext.get().partitionId()
        for (number, *_), held in zip(shared.value, lists, strict=True):
            size = len(held.score)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * size, pa.int64()),
                    pa.array([part] * size, pa.int64()),
                    pa.array(held.key, pa.int64(), mask=held.keyless),
                    pa.array(held.score, pa.int64()),
                ],
                names=["_item", "_part", "doc_id", "score"],
            )

    return map_arrow(weighed, search, _FOUND)
