"""Scores of an n-gram language model kept as Elias-Fano tries.

N-grams are paths of words, and a shard has the paths that begin with its words: a trie whose
root is the shard's vocabulary and whose levels are the bigrams, trigrams and so on, each n-gram
coded by the place of the n-gram it extends and the number of its last word.  Every level is an
Elias-Fano sequence, with Elias-Fano pointers to where a place's extensions begin, and quantised
counts that make its smoothed probabilities.  The levels are written to a file and mapped.  An
n-gram is found word by word: each is the least number not below (place, word), searched among
the extensions of the place before.

Documents are scored in chunks.  A chunk asks each shard once for the different paths it has, as a
tree, so what moves is different n-grams per chunk and never a token.  Requests carry the chunk's
training counts, so the same exchange builds the model and asks it:

    documents -> chunks (trees for shards) -> shards (trie, replies) -> chunks (scores)

Extensions of a hot path are dealt over several shards by ranges of their last word.  Such a path
is a guest, without a count, in the shards that hold its extensions but not itself.

Probabilities interpolate absolute discounting down to unigrams, where all words that training
has not seen are one: P(w | u) = max(c(uw) - D, 0) / c(u) + D n(u) / c(u) P(w).  There is one
discount D for each order, from how many n-grams of the whole corpus occur once and twice.
Counts are exact up to 32,767 and from there one of 32,768 steps of a fixed ratio, whatever
the number of shards.
"""

from __future__ import annotations

import functools
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import ascii_lower, map_arrow
from tripweave.llm.eliasfano import EliasFano
from tripweave.plans.lineage import cut_lineage, owns_copies

#: Tokens of a chunk, and bytes of text that make one shard.
CHUNK, SHARD_BYTES = 3_000_000, 20_000_000
#: Most shards.  A chunk sends one parcel to a shard at most, so parcels grow with the number of
#: chunks; beyond 1.3 TB of text it is the shards that grow, and executors must hold them.
MOST_SHARDS = 65_536
#: Paths looked up at a time.
_LOOKED_UP = 1 << 18
_END = xxhash.xxh64_intdigest(b"\n end")
_BEGIN = xxhash.xxh64_intdigest(b"\n begin")
#: Parts: 0 documents of a chunk, 1 a tree or its reply, 2 sums of a shard.
_PARCEL = "dest long, chunk long, part int, data array<binary>, sums array<long>"
_NAMES = ("dest", "chunk", "part", "data", "sums")


# --- numbers ------------------------------------------------------------------------

#: Counts below are exact; codes above stand for steps of one ratio, the last for 10**15.
_EXACT = 2**15
_RATIO = (1e15 / _EXACT) ** (1 / _EXACT)


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts as 16 bits, rounded down."""
    counts = np.asarray(counts, np.int64)
    codes = counts.copy()
    large = np.flatnonzero(counts >= _EXACT)
    if len(large):
        codes[large] = np.minimum(np.searchsorted(_book(), counts[large], side="right") - 1, 2 * _EXACT - 1)
    return codes.astype(np.uint16)


@functools.cache
def _book() -> np.ndarray:
    """The least count of each code, and of one more."""
    steps = np.ceil(_EXACT * _RATIO ** np.arange(_EXACT + 1)).astype(np.int64)
    return np.append(np.arange(_EXACT), steps)


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers of a little-endian ``kind`` by byte planes, compressed."""
    planes = np.ascontiguousarray(values, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(values: np.ndarray, kind: str) -> bytes:
    """Numbers by what each is more than the one before, which is little in rising runs."""
    values = np.ascontiguousarray(values, kind)
    return _pack(np.diff(values, prepend=values.dtype.type(0)), kind)


def _summed(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_unpack(data, kind), dtype=kind)


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers (not below 0), rising, and which each value is.  Overwrites ``values``."""
    bits = len(values).bit_length()
    if not len(values) or int(values.max()) >> (63 - bits):
        different, of = np.unique(values, return_inverse=True)
        return different, of.astype(np.int32)
    # Sorting numbers with their places in the low bits is faster than sorting places, and takes
    # little memory.
    kind = values.dtype.type
    values <<= kind(bits)
    values |= np.arange(len(values), dtype=kind)
    values.sort()
    place = np.empty(len(values), np.int32)
    np.bitwise_and(values, kind((1 << bits) - 1), out=place, casting="unsafe")
    values >>= kind(bits)
    new = np.append(True, values[1:] != values[:-1])
    of = np.empty(len(values), np.int32)
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    of[place] = number
    return values[new], of


def _mixed(path: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a path with one more word at its end."""
    x = path * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Places:
    """Which shard holds a path, by the upper 32 bits of its words' hashes.  ``spread`` gives the
    hash of hot paths the number of shards that their extensions are dealt over; it only evens
    out the shards."""

    def __init__(self, shards: int, spread: dict[int, int]):
        self.shards = shards
        hot = sorted(spread)
        self.hot = np.array(hot, np.uint64)
        self.ranges = np.array([spread[h] for h in hot], np.int64)

    def spreads(self, paths: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(paths), np.int64)
        at = np.minimum(np.searchsorted(self.hot, paths), len(self.hot) - 1)
        return np.where(self.hot[at] == paths, self.ranges[at], 1)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        return (words % np.uint64(self.shards)).astype(np.int32)

    def of_extensions(self, shard: np.ndarray, spreads: np.ndarray, words: np.ndarray) -> np.ndarray:
        step = words * spreads.astype(np.uint64)
        step >>= np.uint64(32)
        return (shard + step.astype(np.int32)) % np.int32(self.shards)


# --- chunks -------------------------------------------------------------------------


class Level:
    """Different n-grams of a chunk: ``owner`` is the number of the n-gram each extends, ``child``
    its last word; ``begins`` says which n-gram begins at each place, -1 where none does."""

    def __init__(self, owner: np.ndarray, child: np.ndarray, begins: np.ndarray):
        self.owner, self.child, self.begins = owner, child, begins
        self.size = len(child)


class Chunk:
    """Trees of some documents: ``flat`` has word numbers, each document ended by the end mark's,
    ``sizes`` its tokens, and ``heads`` the upper half of the hash of each number."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, heads: np.ndarray, order: int, places: Places):
        self.flat, self.sizes = flat, sizes
        self.heads = np.append(heads, _BEGIN >> 32).astype(np.uint64)
        numbers = len(self.heads)
        self.first = np.cumsum(sizes) - sizes
        number = np.arange(len(sizes))
        # All tokens, with the start mark before each document.
        everywhere = np.arange(len(flat) + len(sizes), dtype=np.int32)
        begun = np.full(len(everywhere), numbers - 1, np.int32)
        begun[everywhere[: len(flat)] + np.repeat(number + 1, sizes).astype(np.int32)] = flat
        room = np.repeat((self.first + number + sizes).astype(np.int32), sizes + 1)
        room -= everywhere
        del everywhere
        self.levels = [Level(np.zeros(numbers, np.int32), np.arange(numbers, dtype=np.int32), begun)]
        for n in range(2, order + 1):
            starts = np.flatnonzero(room >= n - 1).astype(np.int32)
            pairs = self.levels[-1].begins[starts].astype(np.int64)
            pairs *= numbers
            pairs += begun[starts + (n - 1)]
            pairs, of = _unique(pairs)
            begins = np.full(len(begun), -1, np.int32)
            begins[starts] = of
            del starts, of
            owner = (pairs // numbers).astype(np.int32)
            self.levels.append(Level(owner, (pairs % numbers).astype(np.int32), begins))
            del pairs
        del room
        self._deal(places)

    def _deal(self, places: Places) -> None:
        """Nodes of each level by shard (``nodes``), where each shard's begin (``bounds``), and
        which of them are guests there (``guest``)."""
        last = len(self.levels) - 1
        shards, extra = [], []
        for n, level in enumerate(self.levels):
            if n == 0:
                shard, paths = places.of_words(self.heads), self.heads
            else:
                shard = shard[level.owner]
                dealt = np.flatnonzero((spreads > 1)[level.owner])
                own = level.owner[dealt]
                shard[dealt] = places.of_extensions(shard[dealt], spreads[own], self.heads[level.child[dealt]])
                paths = _mixed(paths[level.owner], self.heads[level.child]) if n < last else None
            shards.append(shard)
            # A path whose extensions are dealt out is a guest wherever some may be, also where the
            # chunk has none: how many it has in all comes from every such shard.
            spreads = places.spreads(paths) if n < last else np.ones(0, np.int64)
            hot = np.flatnonzero(spreads > 1)
            step = np.arange(spreads[hot].sum()) - np.repeat(np.cumsum(spreads[hot]) - spreads[hot], spreads[hot])
            hot = np.repeat(hot, spreads[hot])
            extra.append((hot, (shard[hot] + step) % places.shards))
        for n in range(last, -1, -1):
            level = self.levels[n]
            node, shard = extra[n]
            if n < last:
                # The path before a guest is a guest with it.
                longer, where = extra[n + 1]
                node = np.append(node, self.levels[n + 1].owner[longer])
                shard = np.append(shard, where)
            away = shard != shards[n][node]
            coded = np.unique(shard[away] * level.size + node[away])
            extra[n] = coded % max(level.size, 1), coded // max(level.size, 1)
            nodes = np.append(np.arange(level.size, dtype=np.int32), extra[n][0].astype(np.int32))
            by = np.append(shards[n].astype(np.uint16), extra[n][1].astype(np.uint16))
            if len(coded):
                order = np.argsort(nodes, kind="stable")
                nodes, by = nodes[order], by[order]
            order = np.argsort(by, kind="stable")
            level.nodes, by = nodes[order], by[order]
            level.guest = shards[n][level.nodes] != by
            level.bounds = np.searchsorted(by, np.arange(places.shards + 1))

    def asked(self) -> np.ndarray:
        """Shards that the chunk has paths for."""
        return np.flatnonzero(np.diff(self.levels[0].bounds))

    def own(self, level: Level, shard: int) -> slice:
        return slice(level.bounds[shard], level.bounds[shard + 1])

    def tree(self, shard: int, words: np.ndarray, counts: list[np.ndarray]) -> list[bytes]:
        """What the shard gets: its words' hashes, and for each level the words, how many extend
        each of the level before, and training counts (0 for guests)."""
        used = np.zeros(len(words), bool)
        for level in self.levels:
            used[level.child[level.nodes[self.own(level, shard)]]] = True
        number = np.cumsum(used) - 1
        data = [_steps(words[used], "<u8")]
        before = None
        for level, seen in zip(self.levels, counts, strict=True):
            own = self.own(level, shard)
            nodes = level.nodes[own]
            data.append(_pack(number[level.child[nodes]], "<u4"))
            if before is not None:
                parent = np.searchsorted(before, level.owner[nodes])
                data.append(_pack(np.bincount(parent, minlength=len(before)), "<u4"))
            data.append(_pack(np.where(level.guest[own], 0, seen[nodes]), "<u4"))
            before = nodes
        return data


def _parcels(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(_NAMES)
    )


def _requests(docs: list[tuple], vocabulary: dict[bytes, int], label: int, places: Places, order: int):
    """Parcels of one chunk: its documents, and a tree for each shard that has some of it.  Empties
    ``docs`` and ``vocabulary``, which are large."""
    # Frequent words get small numbers, and words about as frequent rising hashes: both pack well.
    used = np.concatenate([d[2] for d in docs])
    counts = np.bincount(used, minlength=len(vocabulary))
    hashed = (_END if w == b"" else xxhash.xxh64_intdigest(w) for w in vocabulary)
    words = np.fromiter(hashed, np.uint64, len(counts))
    order_of = np.lexsort((words, -np.log2(counts).astype(np.int64)))
    rank = np.empty(len(counts), np.int32)
    rank[order_of] = np.arange(len(counts), dtype=np.int32)
    words, flat = words[order_of], rank[used]
    vocabulary.clear()
    del used, rank, counts, order_of
    sizes = np.array([len(d[2]) for d in docs], np.int64)
    train = np.array([d[1] for d in docs], bool)
    keys = [(-1 if d[0] is None else d[0], d[0] is not None) for d in docs]
    table = np.array([[k, known, t, s] for (k, known), t, s in zip(keys, train, sizes, strict=True)], np.int64)
    docs.clear()
    heads = (words >> np.uint64(32)).astype(np.uint32)
    yield label % places.shards, label, 0, [_pack(table, "<i8"), _steps(heads, "<u4"), _pack(flat, "<u4")], None
    chunk = Chunk(flat, sizes, heads, order, places)
    words = np.append(words, np.uint64(_BEGIN))
    trained = np.repeat(train, sizes + 1)
    seen = [np.bincount(v.begins[trained & (v.begins >= 0)], minlength=v.size) for v in chunk.levels]
    # The start mark is a context, no token.
    seen[0][-1] = 0
    for shard in chunk.asked().tolist():
        yield shard, label, 1, chunk.tree(shard, words, seen), None


# --- shards -------------------------------------------------------------------------


def discount(once: int, twice: int) -> float:
    """Absolute discount from how many n-grams occur once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Trie:
    """Paths of words in a mapped file, each level an Elias-Fano sequence."""

    def __init__(self, folder: str, order: int):
        self.load = lambda name: np.load(Path(folder, f"{name}.npy"), mmap_mode="r")
        self.words = self._sequence("words")
        self.levels = [self._sequence(f"paths-{n}") for n in range(2, order + 1)]
        self.pointers = [self._sequence(f"pointers-{n}") for n in range(1, order)]
        self.counts = [self.load(f"counts-{n}") for n in range(1, order + 1)]
        self.kinds = [self.load(f"kinds-{n}") for n in range(1, order)]

    def _sequence(self, name: str) -> EliasFano:
        return EliasFano(*(self.load(f"{name}-{f}") for f in EliasFano.FIELDS))

    @staticmethod
    def write(folder: str, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``words`` are sorted hashes.  A level has, sorted, the codes of its paths, parent * words
        + word, where a parent is a place in the level before, and their counts.  Paths without a
        count stay only where they lead to one with a count."""
        keep = [np.ones(len(words), bool), *(counts > 0 for _, counts in levels[1:])]
        for n in range(len(levels) - 1, 1, -1):
            keep[n - 1][levels[n][0][keep[n]] // len(words)] = True

        def save(name, values):
            if not name.startswith(("counts", "kinds")):
                sequence = EliasFano.of(values)
                for field in EliasFano.FIELDS:
                    np.save(Path(folder, f"{name}-{field}.npy"), getattr(sequence, field))
            else:
                np.save(Path(folder, f"{name}.npy"), values)

        save("words", words)
        number = np.arange(len(words))
        save("counts-1", levels[0][1])
        size = len(words)
        for n, (codes, counts) in enumerate(levels[1:], 2):
            codes, counts = codes[keep[n - 1]], counts[keep[n - 1]]
            parent = number[codes // len(words)]
            codes %= len(words)
            codes += parent * len(words)
            save(f"paths-{n}", codes)
            save(f"counts-{n}", _code(counts))
            save(f"pointers-{n - 1}", np.searchsorted(parent, np.arange(size + 1)))
            kinds = np.bincount(parent[counts > 0], minlength=size)
            save(f"kinds-{n - 1}", kinds if n == 2 else _code(kinds))
            number, size = np.cumsum(keep[n - 1]) - 1, len(codes)
            del codes, counts, parent

    def find(self, n: int, place: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places of the n-grams that extend those at ``place`` by ``words``; -1 where the place
        is -1 or has no such extension."""
        found = np.full(len(place), -1)
        # The search is among a place's own extensions: where it has none, nothing is looked up.
        at, of = _unique(np.maximum(place, 0).astype(np.int64))
        level, pointers = self.levels[n - 2], self.pointers[n - 2]
        if not len(at) or not level.n:
            return found
        begin, end = pointers.at(at).astype(np.int64), pointers.at(at + 1).astype(np.int64)
        open_ = np.flatnonzero((place >= 0) & (begin < end)[of])
        code = (place[open_].astype(np.int64) * self.words.n + words[open_]).astype(np.uint64)
        reached = level.successor(code)
        inside = reached < end[of[open_]]
        same = level.at(reached[inside]) == code[inside]
        found[open_[inside][same]] = reached[inside][same]
        return found


def _replies(shard: int, trees: list[tuple], order: int):
    """Answers of one shard: for each tree, in its order, counts of its paths and how many words
    extend them, exact for single words and coded for others.  Then the shard's sums, which make
    up those of the corpus: for each level all counts, paths, and paths that occur once and twice."""
    hashes = [_summed(t[3][0], "<u8") for t in trees]
    words, number = np.unique(np.concatenate(hashes), return_inverse=True)
    number = np.split(number.astype(np.int32), np.cumsum([len(h) for h in hashes])[:-1])
    del hashes
    levels, asked, parts = [], [], []
    for n in range(1, order + 1):
        codes = []
        for i, tree in enumerate(trees):
            child = number[i][_unpack(tree[3][1 if n == 1 else 3 * n - 3], "<u4")]
            if n > 1:
                parent = np.repeat(parts[-1][i], _unpack(tree[3][3 * n - 2], "<u4"))
                child = parent.astype(np.int64) * len(words) + child
            codes.append(child)
        sizes = np.cumsum([len(c) for c in codes])
        codes = np.concatenate(codes)
        # Every word is a root, so that places of roots are numbers of words.
        different, of = (np.arange(len(words)), codes) if n == 1 else _unique(codes)
        del codes, child
        parts.append(np.split(of, sizes[:-1]))
        total = np.zeros(len(different), np.int64)
        for own, tree in zip(parts[-1], trees, strict=True):
            # A tree has each path once.
            total[own] += _unpack(tree[3][2 if n == 1 else 3 * n - 1], "<u4")
        levels.append((different, total))
        asked.append(different)
    del number
    sums = [f for _, c in levels for f in (c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum())]
    with tempfile.TemporaryDirectory(prefix="trie-") as folder:
        Trie.write(folder, words, levels)
        del levels, different, total
        trie = Trie(folder, order)
        # Different paths are looked up once, whatever the number of trees that ask for them.
        place = trie.words.find(words)
        counts, kinds = [trie.counts[0][place]], []
        for n in range(2, order + 1):
            kinds.append(_taken(trie.kinds[n - 2], place))
            # Looked up some at a time, so that it takes little memory beside the trie.
            before, place = place, np.empty(len(asked[n - 1]), np.int32)
            for at in range(0, len(place), _LOOKED_UP):
                code = asked[n - 1][at : at + _LOOKED_UP]
                place[at : at + _LOOKED_UP] = trie.find(n, before[code // len(words)], code % len(words))
            counts.append(_taken(trie.counts[n - 1], place))
        del trie
    for i, tree in enumerate(trees):
        data = []
        for n in range(order):
            own = parts[n][i]
            data.append(_pack(counts[n][own], "<u2" if n else "<i8"))
            if n + 1 < order:
                data.append(_pack(kinds[n][own], "<u2" if n else "<i8"))
        yield tree[1], shard, 1, data, None
    yield -1, shard, 2, None, [int(s) for s in sums]


def _taken(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The values at places, 0 where there is none."""
    if not len(values):
        return np.zeros(len(place), values.dtype)
    return np.where(place >= 0, values[place], 0).astype(values.dtype)


# --- scores -------------------------------------------------------------------------


def _scores(parcels: list[tuple], places: Places, order: int, sums: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of the result for the documents of one chunk."""
    mine = next(p for p in parcels if p[2] == 0)
    table = _unpack(mine[3][0], "<i8").reshape(-1, 4)
    sizes = table[:, 3]
    flat = _unpack(mine[3][2], "<u4").astype(np.int32)
    chunk = Chunk(flat, sizes, _summed(mine[3][1], "<u4"), order, places)
    counts = [np.zeros(v.size, np.int64) for v in chunk.levels]
    most = [np.zeros(v.size, np.int64) for v in chunk.levels]
    kinds = [np.zeros(v.size, np.int64) for v in chunk.levels]
    book = _book()
    for p in parcels:
        if p[2] != 1:
            continue
        for n, level in enumerate(chunk.levels):
            nodes = level.nodes[chunk.own(level, p[1])]
            at = 2 * n
            code = _unpack(p[3][at], "<u2" if n else "<i8")
            counts[n][nodes] += book[code] if n else code
            if n + 1 < order:
                # A whole is the largest count of its code, so that parts never exceed it.
                most[n][nodes] += np.where(code > 0, book[code.astype(np.int64) + 1] - 1, 0) if n else code
                code = _unpack(p[3][at + 1], "<u2" if n else "<i8")
                kinds[n][nodes] += book[code] if n else code
    tokens, different, once, twice = map(int, sums[:4])
    less = discount(once, twice)
    single = counts[0]
    if tokens:
        p = np.where(single > 0, (single - less) / tokens, less * different / tokens)[chunk.flat]
    else:
        p = np.ones(len(chunk.flat))
    # As a context the start mark occurs as often as the end mark, which ends every document.
    most[0][-1] = single[chunk.flat[-1]]
    marks = np.repeat(np.arange(1, len(sizes) + 1, dtype=np.int32), sizes + 1)
    for n, level in enumerate(chunk.levels[1:], 1):
        less = discount(*map(int, sums[4 * n + 2 : 4 * n + 4]))
        whole = most[n - 1][level.owner]
        known = whole > 0
        own = np.where(known, np.maximum(counts[n] - less, 0) / np.maximum(whole, 1), 0.0)
        share = np.where(known, less * kinds[n - 1][level.owner] / np.maximum(whole, 1), 1.0)
        # Numbers among the tokens of the n-grams' last words: places less the start marks before.
        for at in range(0, len(level.begins), _LOOKED_UP):
            starts = at + np.flatnonzero(level.begins[at : at + _LOOKED_UP] >= 0)
            token, of = starts + n - marks[starts], level.begins[starts]
            p[token] = own[of] + share[of] * p[token]
    base = np.log10((single + 0.5) / (tokens + 0.5 * (different + 1)))[chunk.flat]
    return {
        "doc_id": table[:, 0],
        "has_id": table[:, 1].astype(bool),
        "train": table[:, 2].astype(bool),
        "n_tokens": sizes,
        "n_known": np.add.reduceat((single > 0)[chunk.flat].astype(np.int64), chunk.first),
        "train_tokens": np.full(len(sizes), tokens, np.int64),
        "base_score": np.add.reduceat(base, chunk.first),
        "score": np.add.reduceat(np.log10(p), chunk.first),
    }


def _grouped(batches):
    """Parcels for one receiver after the other; rows come sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in _NAMES), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _hot_paths(docs: DataFrame, text: str, shards: int, documents: int, order: int) -> dict[int, int]:
    """Paths of up to order - 1 words that take over an eighth of a shard's share of a sample of
    documents, some more for each shard, with the number of shards to spread their extensions
    over: at most 8 * shards of each length.  Only where n-grams are kept depends on the sample."""

    def leaders(batches):
        seen: dict[bytes, int] = {}
        n = 0
        for batch in batches:
            for one in batch.column("text").to_pylist():
                begun = [b"\n begin", *one.encode().split()]
                n += len(begun)
                for length in range(1, order):
                    for i in range(len(begun) - length + 1):
                        w = b"\t".join(begun[i : i + length])
                        seen[w] = seen.get(w, 0) + 1
        found = [(w, c) for w, c in seen.items() if c * 16 * shards >= n]
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array([w for w, _ in found] + [b""], pa.binary()),
                "n": pa.array([c for _, c in found] + [n], pa.int64()),
            }
        )

    drawn = docs.select(text).sample(min(1.0, (2_000 + 4 * shards) / max(1, documents)), seed=3)
    lowered = drawn.select(ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    found = map_arrow(lowered.coalesce(8 + shards // 1_024), leaders, "word binary, n long")
    found = found.groupBy("word").agg(F.sum("n").alias("n"))
    most = 8 * shards * max(1, order - 1) + 1
    counts = {bytes(r["word"]): r["n"] for r in found.orderBy(F.col("n").desc()).limit(most).collect()}
    total = counts.pop(b"", 0)

    def hashed(path: bytes) -> int:
        first, *others = (np.array([xxhash.xxh64_intdigest(w) >> 32], np.uint64) for w in path.split(b"\t"))
        for word in others:
            first = _mixed(first, word)
        return int(first[0])

    return {
        hashed(w): min(shards, -(-4 * n * shards // total))
        for w, n in counts.items()
        if n * 8 * shards >= total
    }


@owns_copies
def score(
    docs: DataFrame,
    train: Column,
    order: int = 2,
    key: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Rows (doc_id, train, n_tokens, n_known, train_tokens, base_score, score).

    ``train`` says which rows the model learns from; null counts as no.  Tokens are the words of
    the text, A-Z lower-cased and parted by ASCII white space, and one end mark.  n_known counts
    tokens that training has; base_score is that of unigrams with 0.5 added to each count, score
    the model's, both log10.  Null and empty texts are the end mark alone.  Repeated rows count
    and score each for itself; without training rows every token is the unknown one and scores
    0; an empty table gives no rows; other columns are not read.  A chunk holds at least one
    document, however long.  Words are told apart by 64 bits of their hash.

    The tries are built and asked at once and their replies written to the shared folder; what is
    returned reads these.  A chunk sends a shard at most one parcel, and none without a path.
    """
    # Lower-casing leaves sizes as they are, so the sizes are read without it.
    size = docs.agg(F.sum(F.octet_length(F.col(text))).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    shards = shards or min(MOST_SHARDS, max(1, -(-(size["bytes"] or 0) // SHARD_BYTES)))
    places = Places(shards, _hot_paths(docs, text, shards, size["n"], order) if shards > 1 else {})
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )

    def ask(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, vocabulary, tokens = [], {b"": 0}, 0
        for batch in batches:
            for doc_id, trained, one in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "train", "text")), strict=True
            ):
                words = one.encode().split()
                own = np.fromiter(
                    (vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)
                )
                held.append((doc_id, trained, np.append(own, np.int32(0))))
                tokens += len(own) + 1
                if tokens >= chunk:
                    for row in _requests(held, vocabulary, (part << 20) + number, places, order):
                        yield _parcels([row])
                    number += 1
                    held, vocabulary, tokens = [], {b"": 0}, 0
        if held:
            for row in _requests(held, vocabulary, (part << 20) + number, places, order):
                yield _parcels([row])

    def answer(batches):
        for held in _grouped(batches):
            for row in held:
                if row[2] == 0:
                    # The documents go on to their chunk.
                    yield _parcels([(row[1], *row[1:])])
            shard, trees = held[0][0], [row for row in held if row[2] == 1]
            del held
            if trees:
                for row in _replies(shard, trees, order):
                    yield _parcels([row])

    asked = map_arrow(rows, ask, _PARCEL).repartitionById(shards, F.col("dest").cast("int"))
    answered = cut_lineage(map_arrow(asked.sortWithinPartitions("dest"), answer, _PARCEL))
    parts = answered.filter("part = 2").select(F.posexplode("sums").alias("at", "n"))
    found = {r["at"]: r["n"] for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    sums = np.array([found.get(i, 0) for i in range(4 * order)], np.int64)

    def finish(batches):
        for held in _grouped(batches):
            found = _scores(held, places, order, sums)
            ids = pa.array(found.pop("doc_id"), pa.int64(), mask=~found.pop("has_id"))
            yield pa.RecordBatch.from_pydict({"doc_id": ids} | {n: pa.array(v) for n, v in found.items()})

    return map_arrow(
        answered.filter("part < 2").repartition("dest").sortWithinPartitions("dest"),
        finish,
        "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double",
    )
