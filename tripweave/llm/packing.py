"""Pattern packing by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens.  A pattern is a list of at most
three piece lengths that fill a sequence exactly.  The repeat counts of all patterns are
fitted to the histogram of lengths by non-negative least squares and rounded; the pieces
that no pattern takes are packed by best fit.  All of that sees the histogram alone, whose
size depends on ``capacity`` and not on the data.  The pieces themselves never meet: each
learns its rank among the pieces of its length, and the rank its place.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import WORKER_CACHE, key_and_text, map_arrow, ship_package
from tripweave.plans.lineage import cut_lineage

#: Split of a text before the merges, as the byte-level vocabularies of this family fix it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as the pattern has it, in runs too long for its look-ahead, which would need a
#: stack as deep as the run.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
#: A run that long covers three of the characters that lie so far apart.
_STRIDE, _THREE = 250, re.compile(r"\s{3}")
_ROW_BITS = 40
_CACHES: dict[str, dict[str, bytes]] = {}


# --- token ids ----------------------------------------------------------------------


@lru_cache(maxsize=4)
def _encoder(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """Byte-level BPE of a ``tokenizers`` file, and the special strings it looks for.

    The library of that file is five times slower than this one; both apply the same merges
    in the same order, which the tests hold against each other.
    """
    import json

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = {char: byte for byte, char in _byte_letters().items()}
    ranks = {
        bytes(byte_of[c] for c in token): i
        for token, i in spec["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Where every white space is one space or line feed between two other characters, no
    pre-token crosses it, so a text falls into short stretches that are encoded once per
    worker.  Any other text is encoded in one go, but for very long runs of white space: all of
    a run but its last character is one pre-token, and at the end of a text the whole run.
    """

    def __init__(self, path: str):
        self._bpe, self._special = _encoder(path)
        self._known = _CACHES.setdefault(path, {})

    def ids(self, text: str) -> bytes:
        for string, token in self._special.items():
            if string in text:
                mark = np.array([token], "<u4").tobytes()
                return mark.join(self.ids(part) for part in text.split(string))
        flat = text.replace("\n", " ")
        if not text or " ".join(flat.split()) != flat:
            return self._plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        known = self._known
        try:
            return self._plain(first) + b"".join([known[part] for part in rest])
        except KeyError:
            return self._plain(first) + b"".join([known.get(part) or self._learn(part) for part in rest])

    def _learn(self, part: str) -> bytes:
        ids = self._plain(part if part[0] == "\n" else " " + part)
        if len(self._known) < WORKER_CACHE and len(part) <= 64:
            self._known[part] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if not _THREE.search(text[::_STRIDE]):
            return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()
        ids, at = [], 0
        for run in _LONG_RUN.finditer(text):
            to = run.end() - (run.end() < len(text))
            ids += self._bpe.encode_ordinary(text[at : run.start()])
            ids += self._bpe._encode_single_piece(text[run.start() : to])
            at = to
        return np.array(ids + self._bpe.encode_ordinary(text[at:]), "<u4").tobytes()


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, nth[, ids]), a piece each.

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone.  Texts may
    be of any length and hold runs of any length, of white space too.  A document over ``capacity`` is cut into full pieces, its first piece being the shorter one.
    ``part`` is the task that made a piece and ``nth`` its place among the pieces of the same
    length there, so write the result before using them twice.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = Encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            doc, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                ids = encoder.ids(text) + end
                size = len(ids) // 4
                at, to = 0, size % capacity or capacity
                for number in range(-(-size // capacity)):
                    own = ids[4 * at : 4 * to]
                    doc.append(doc_id)
                    piece.append(number)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(own))
                    nth.append(seen[to - at])
                    seen[to - at] += 1
                    if with_ids:
                        kept.append(np.frombuffer(own, "<u4").astype("i4"))
                    at, to = to, to + capacity
            columns = {
                "doc_id": pa.array(doc, pa.int64()),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "part": pa.array([part] * len(doc), pa.int64()),
                "nth": pa.array(nth, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
    return map_arrow(key_and_text(docs, key, text), cut, schema + (", ids array<int>" if with_ids else ""))


# --- plan over the histogram --------------------------------------------------------


def patterns(capacity: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0, a >= 1 and a + b + c = capacity: about
    capacity² / 12 of them."""
    rows = []
    for c in range(capacity // 3 + 1):
        b = np.arange(max(c, 0), (capacity - c) // 2 + 1)
        if c > 0:
            b = b[b > 0]
        rows.append(np.stack([capacity - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(rows)


def fit_counts(histogram: np.ndarray, rows: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|², A the pieces of each length
    that a pattern takes: accelerated projected gradient with a diagonal scale.

    ``histogram`` has index 0 (always 0) to capacity.  A has at most three entries a column,
    so a round is a few passes over ``rows`` and A is never formed.
    """
    size = len(histogram)
    flat = rows.T.ravel()
    used = flat > 0
    column = np.tile(np.arange(len(rows)), 3)[used]
    flat = flat[used]
    # A bound of the gradient's slope for each pattern: the sum, over the lengths it takes,
    # of all pieces that patterns take of that length.
    load = np.bincount(flat, minlength=size).astype(float)
    step = 1.0 / np.bincount(column, load[flat], minlength=len(rows))
    x = np.zeros(len(rows))
    ahead, momentum = x, 1.0
    target = histogram.astype(float)
    for _ in range(rounds):
        residual = np.bincount(flat, ahead[column], minlength=size) - target
        slope = np.bincount(column, residual[flat], minlength=len(rows))
        after = np.maximum(ahead - step * slope, 0.0)
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = after + (momentum - 1) / following * (after - x)
        x, momentum = after, following
    return x


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences), taking every piece just once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens in sequences of {capacity}")
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left.sum():
        if left[capacity]:
            plan.append(((capacity,), int(left[capacity])))
            left[capacity] = 0
        rows = patterns(capacity)
        rows = rows[(left[rows] > 0).sum(axis=1) == (rows > 0).sum(axis=1)]
        fitted = fit_counts(left, rows) if len(rows) else np.zeros(0)
        for i in np.argsort(-fitted, kind="stable"):
            # Rounded down: a pattern too many takes short pieces that close gaps later.
            if fitted[i] < 1:
                break
            own = Counter(int(v) for v in rows[i] if v)
            n = min(int(fitted[i]), *(int(left[v]) // k for v, k in own.items()))
            if n > 0:
                plan.append((tuple(sorted(own.elements(), reverse=True)), n))
                for v, k in own.items():
                    left[v] -= n * k
    plan.extend(_best_fit(left, capacity))
    merged: Counter = Counter()
    for lengths, n in plan:
        merged[lengths] += n
    return sorted(merged.items(), reverse=True)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: equal sequences are one entry, so the work depends
    on how many different ones there are and not on how many pieces."""
    by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append([lengths, n])

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            room = rooms[at]
            lengths, there = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            fits = room // length
            filled = min(there, n // fits)
            if filled:
                put(lengths + (length,) * fits, filled)
                n -= filled * fits
            if filled < there and n < fits:
                if n:
                    put(lengths + (length,) * n, 1)
                    filled, n = filled + 1, 0
            if filled < there:
                put(lengths, there - filled)
    return [(tuple(lengths), n) for group in by_room.values() for lengths, n in group]


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each run of equal places: the key of its first rank (length and rank in one number),
    the sequence the first one is in, its offset, and how many of the length a sequence takes."""
    rows = []
    taken: Counter = Counter()
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for length, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append(((length << _ROW_BITS) + taken[length], sequence, offset, k))
            taken[length] += n * k
            offset += k * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {name: table[:, i] for i, name in enumerate(("first", "sequence", "offset", "each"))}


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (length, part, nth, any other columns).

    ``pieces`` must be materialised.  Of the data, the driver sees the histogram, at most
    ``capacity`` rows; what the tasks get of the plan is bounded by the number of patterns.
    An empty table stays empty.
    """
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {
        r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    context = pieces.sparkSession.sparkContext
    ship_package(context)
    shared = context.broadcast(_places(pack_histogram(histogram, capacity)))
    # The window has a row per task and length, not per piece.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.join(
        by_part.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
        ["part", "length"],
    ).withColumn("_rank", F.col("_before") + F.col("nth"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        places = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = (length << _ROW_BITS) + rank
        at = np.searchsorted(places["first"], key, side="right") - 1
        ahead = key - places["first"][at]
        each = places["each"][at]
        return pd.DataFrame(
            {
                "sequence_id": places["sequence"][at] + ahead // each,
                "offset": places["offset"][at] + ahead % each * length,
            }
        )

    return (
        ranked.withColumn("_place", place("length", "_rank"))
        .withColumns({"sequence_id": F.col("_place.sequence_id"), "offset": F.col("_place.offset")})
        .drop("_place", "_rank", "_before", "part", "nth")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Null and empty texts are one piece of ``end_id``; repeated rows are packed each for
    itself; an empty table gives none; other columns are not read.
    """
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, key, text, with_ids)
    return pack_pieces(cut_lineage(pieces), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of :func:`pack_documents` ``with_ids``: sequence_id, ids and the
    offsets at which its pieces start.  A group is one sequence, so at most ``capacity`` ids."""
    placed: Column = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(placed.alias("_pieces")).select(
        "sequence_id", F.flatten("_pieces.ids").alias("ids"), F.col("_pieces.offset").alias("starts")
    )
