"""Repetition rules read off a suffix array of each text's words.

Suffixes of a text are sorted by prefix doubling; what neighbours in that order share, the
longest common prefixes, are the intervals of its repeated substrings.  A suffix lies in the
deepest interval given by the longer of its two neighbours' prefixes, which is the longest
repeat that starts there.  The union of those spans is what the text repeats; a text fails if
the union covers too much of it or one repeat is too long.

Many texts share one sort: a word counts as another symbol in each text, so suffixes of two
texts share nothing.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripweave.llm.common import key_and_text, map_arrow

#: Words sorted together; a longer text is sorted alone.
TOGETHER = 300_000
SYMBOLS = "#*$%&|<>"
#: Limits of the query and the pipeline.  Each rejects texts that the base rule, half of the words
#: in 3-word repeats, lets pass: many repeats of ten words over a fifth of the words, or one repeat
#: over 0.08 of them, whose two copies cover less than that fifth up to 0.1.
LIMITS = {"repeat_words": 10, "most_covered": 0.2, "longest_share": 0.08}


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of texts laid end to end, and what each suffix shares with the one before.

    ``symbols`` are numbers that differ between texts; ``ends`` is, per place, the end of its
    text.  A suffix stops at that end, and one that is a prefix of another comes first.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _group_starts(symbols[order])
    levels = [rank.astype(np.int32)]
    active = order[_shared(rank[order])]
    step = 1
    while len(active):
        ahead = active + step
        inside = ahead < ends[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        rank[active] = old + _group_starts(key) - _group_starts(old)
        levels.append(rank.astype(np.int32))
        active = active[_shared(rank[active])]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    near = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    a, b = suffixes[near - 1], suffixes[near]
    length = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        # Equal ranks of two places mean that the whole step is equal and within the text.
        same = (x < ends[a]) & (y < ends[b])
        same &= levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)]
        length += same.astype(np.int64) << level
    shared[near] = length
    return suffixes, shared


def _group_starts(values: np.ndarray) -> np.ndarray:
    """For sorted values: the index at which the run of each begins."""
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _shared(values: np.ndarray) -> np.ndarray:
    """For sorted values: which are not alone in their run."""
    equal = values[1:] == values[:-1]
    return np.append(equal, False) | np.append(False, equal)


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per place, the length of the longest substring from there found elsewhere in its text."""
    suffixes, shared = suffix_order(symbols, ends)
    longest = np.empty(len(symbols), np.int64)
    longest[suffixes] = np.maximum(shared, np.append(shared[1:], 0))
    return longest


def covered(longest: np.ndarray, at_least: int) -> np.ndarray:
    """Per place, whether a repeat of ``at_least`` words covers it."""
    starts = np.flatnonzero(longest >= at_least)
    n = len(longest)
    turns = np.bincount(starts, minlength=n + 1) - np.bincount(starts + longest[starts], minlength=n + 1)
    return np.cumsum(turns)[:n] > 0


def _duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.encode().split()]
    return len(lines) - len(set(lines))


def repetition(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repeat_words: int = 10,
    most_covered: float = 0.5,
    longest_share: float = 0.08,
    with_spans: bool = False,
) -> DataFrame:
    """Statistics and verdict per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_covered_words, longest_repeat, base_failed, kept.

    Words are runs without ASCII white space.  n_repeat_words counts words within 3-word windows
    found twice or more; n_covered_words those within repeats of ``repeat_words`` or more;
    longest_repeat is in words.  base_failed: under 50 words, or n_repeat_words over half of
    them.  kept is false if base_failed, if repeats cover more than ``most_covered`` of the words,
    or if one repeat is longer than ``longest_share`` of them.  ``with_spans`` adds spans, the
    union of those repeats as (start, end) in words.

    Repeats of ten words lie within repeats of three, so ``most_covered`` of one half, the default,
    adds nothing to base_failed; a ``longest_share`` of over a quarter would hardly either.  The
    query and the pipeline take :data:`LIMITS`, where both add to it.

    Null and empty texts have no words and fail.  Each row is judged alone, so repeated rows
    repeat their results and an empty table gives none; other columns are not read.  A text is
    sorted whole whatever its length, in about 40 bytes a word and doubling round.
    """

    limits = (repeat_words, most_covered, longest_share)

    def judge(batches):
        for batch in batches:
            found = _verdicts(batch.column("text").to_pylist(), *limits, with_spans)
            spans = found.pop("spans", None)
            columns = {"doc_id": batch.column("doc_id")} | {n: pa.array(v) for n, v in found.items()}
            if spans is not None:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns["spans"] = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
            yield pa.RecordBatch.from_pydict(columns)

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
    )
    if with_spans:
        schema += ", spans array<struct<start: long, end: long>>"
    return map_arrow(key_and_text(docs, key, text), judge, schema)


def passing(
    docs: DataFrame,
    text: str = "text",
    repeat_words: int = 10,
    most_covered: float = 0.5,
    longest_share: float = 0.08,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`repetition` keeps; no shuffle."""

    def keep(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(_verdicts(texts, repeat_words, most_covered, longest_share)["kept"]))

    return map_arrow(docs, keep, docs.schema)


def _verdicts(
    texts: list[str], repeat_words: int, most_covered: float, longest_share: float, with_spans: bool = False
) -> dict[str, np.ndarray]:
    """The columns of :func:`repetition` for some texts, sorted together in groups."""
    parts, group, size = [], [], 0
    for one in texts:
        words = one.encode().split()
        if group and size + len(words) > TOGETHER:
            parts.append(_judged(group, repeat_words, with_spans))
            group, size = [], 0
        group.append((one, words))
        size += len(words)
    parts.append(_judged(group, repeat_words, with_spans))
    found = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    words = found["n_words"]
    base = (words < 50) | (100 * found["n_repeat_words"] > 50 * words)
    bad = (found["n_covered_words"] > most_covered * words) | (found["longest_repeat"] > longest_share * words)
    return found | {"base_failed": base, "kept": ~base & ~bad}


def _judged(group: list[tuple[str, list[bytes]]], repeat_words: int, with_spans: bool) -> dict[str, np.ndarray]:
    """Statistics of some texts, from one sort of all their words."""
    sizes = np.array([len(words) for _, words in group], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    numbers: dict[bytes, int] = {}
    fresh = count()
    codes = np.fromiter(
        (c if (c := numbers.get(w)) is not None else numbers.setdefault(w, next(fresh)) for _, words in group for w in words),
        np.int64,
        int(bounds[-1]),
    )
    owner = np.repeat(np.arange(len(group)), sizes)
    longest = longest_repeats(owner * (len(numbers) + 1) + codes, bounds[1:][owner])

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=len(group)).astype(np.int64)

    inside = covered(longest, repeat_words)
    top = np.zeros(len(group), np.int64)
    np.maximum.at(top, owner, longest)
    found = {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, " \t\n\v\f\r")) for t, _ in group], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t, _ in group], np.int64),
        "n_dup_lines": np.array([_duplicate_lines(t) for t, _ in group], np.int64),
        "n_repeat_words": per_text(covered(longest, 3)),
        "n_covered_words": per_text(inside),
        "longest_repeat": top,
    }
    if with_spans:
        found["spans"] = np.empty(len(group), object)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], inside[a:b].astype(np.int8), [0]])))
            found["spans"][i] = edges.reshape(-1, 2).tolist()
    return found
