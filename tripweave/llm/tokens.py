"""Token counts without moving a pre-token between tasks.

A piece of the vocabulary holds the space mark at its start only, and no piece holds a
line feed, so no merge crosses the start of a run of spaces or of a line: the text falls
into pre-tokens that are encoded apart.  Their lengths come from two tiers.  A table of
the most frequent pre-tokens of the whole corpus is broadcast; what misses it is encoded
once per worker and kept in the worker's own cache.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import WORKER_CACHE, key_and_text, map_arrow

#: Bytes of the longest pre-token that the broadcast table takes up.
LONGEST = 48
#: Pre-tokens that one sampled document hands on.
PER_TEXT = 4_096
_SPACED = re.compile(" *[^ ]+| +")
#: Per vocabulary file: lengths this worker knows, kept from task to task.
_CACHES: dict[str, dict[str, int]] = {}


@lru_cache(maxsize=4)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if model.piece_to_id("▁") == model.unk_id() or any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
        raise ValueError(f"{path}: pieces cross word starts; pre-tokens are not independent")
    return model


def pretokens(text: str) -> list[str] | None:
    """Runs of spaces and what follows, the first of each run of spaces left out, cut before
    line feeds.  None where the text has the space mark itself and must stay whole."""
    if "▁" in text:
        return None
    if not text:
        return []
    found = text.replace("\n", " \n").split(" ")
    if "" not in found:
        return found
    # Runs of spaces: keep each run with what follows it.
    first, *lines = text.split("\n")
    found = [run[1:] for run in _SPACED.findall(" " + first)]
    for line in lines:
        head, *rest = _SPACED.findall("\n" + line)
        found.append(head)
        found.extend(run[1:] for run in rest)
    return found


def _measure(model: sentencepiece.SentencePieceProcessor, pretokens: list[str]) -> dict[str, int]:
    """Tokens of each pre-token.  The model puts a space mark before whatever it is given, but
    before nothing at all; before a line feed nothing merges with it, so it is one too many."""
    encoded = model.encode(pretokens, num_threads=1)
    return {
        word: len(ids) - (word[:1] == "\n") if word else 1
        for word, ids in zip(pretokens, encoded, strict=True)
    }


class _Known(dict):
    """Lengths by pre-token, in two tiers: what it holds itself is the broadcast table, what that
    lacks is looked up in the worker's cache."""

    cache: dict[str, int]

    def __missing__(self, word: str) -> int:
        return self.cache[word]


def frequent_pretokens(docs: DataFrame, entries: int = 65_536, sample: int = 4_000) -> list[str]:
    """The ``entries`` most frequent pre-tokens of about ``sample`` documents, drawn from all of
    them with equal chances.

    They decide what is broadcast and nothing else: a pre-token missing here costs time and never a
    wrong count.  Nothing of the other documents is split, and nothing shuffled; what reaches the
    driver is bounded by the sample.
    """
    rows = docs.count()
    drawn = key_and_text(docs).select("text").sample(min(1.0, sample / max(rows, 1)), seed=1)

    def counted(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                # A text of very many different pre-tokens hands on the first of them by number.
                own = Counter(w for w in pretokens(text) or () if len(w.encode()) <= LONGEST).most_common(PER_TEXT)
                yield pa.RecordBatch.from_pydict(
                    {"pretoken": pa.array([w for w, _ in own], pa.string()), "n": pa.array([n for _, n in own], pa.int64())}
                )

    total: Counter = Counter()
    for word, n in map_arrow(drawn, counted, "pretoken string, n long").toLocalIterator():
        total[word] += n
    return [word for word, _ in sorted(total.items(), key=lambda e: (-e[1], e[0]))[:entries]]


def token_counts(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", entries: int = 65_536
) -> DataFrame:
    """Per row of ``docs``: the key as doc_id, n_bytes (UTF-8) and n_tokens.

    A null text is empty and has no token.  Repeated rows give repeated results, an empty
    table none; other columns are not read.  Very long texts are held one at a time.
    The broadcast table has at most ``entries`` rows of ``LONGEST`` bytes, whatever the input.
    """
    spark = docs.sparkSession
    rows = key_and_text(docs, key, text)
    model = _model(model_path)
    table = spark.sparkContext.broadcast(_measure(model, frequent_pretokens(rows, entries)))

    def count(batches):
        model, known = _model(model_path), _Known(table.value)
        cache = known.cache = _CACHES.setdefault(model_path, {})
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lengths = []
            for text in texts:
                parts = pretokens(text)
                if parts is None:
                    lengths.append(len(model.encode(text)))
                    continue
                try:
                    lengths.append(sum(map(known.__getitem__, parts)))
                except KeyError:
                    missed = _measure(model, list({w for w in parts if w not in known and w not in cache}))
                    if len(cache) + len(missed) <= WORKER_CACHE:
                        cache.update((w, n) for w, n in missed.items() if len(w) <= LONGEST)
                    lengths.append(sum(missed[w] if w in missed else known[w] for w in parts))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                }
            )

    return map_arrow(rows, count, "doc_id long, n_bytes long, n_tokens long")
