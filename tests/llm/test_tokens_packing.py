import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tripweave.llm import packing, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\n\n", "é", "<|endoftext|>", "<s>", "</s>", "▁", "'s", "\t", ".", " x",
    "日本", "\x00", "\r", "１", "\x1c", "　", "​", "İ", " \n", "\xa0", "ﬁ",
]


def texts(n):
    rng = random.Random(4)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_ids_equal_the_library_of_the_file():
    library, ours = Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    for text in texts(4000):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == want, repr(text)


SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"


def test_long_runs_equal_the_library():
    library, ours = Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    runs = [own * 1_500 for own in SPACES] + [" \n" * 800, "\t " * 700 + "\xa0", "\x1c" * 2_000, " " * 999, " " * 1_000]
    cases = [text for run in runs for text in (run, "a" + run, run + "b", f"a{run}b{run}.{run[:-1]}\n1", run + "<|endoftext|>" + run)]
    cases += ["x" * 10_000_000, "." * 1_000_000, "7" * 1_000_000, "é" * 500_000]
    for n in (1_000_000, 2_000_000, 5_000_000):
        cases += [" " * n, "a" + "\n" * n + "b", "one" + " " * n + "two"]
    for text in cases:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == want, repr(text[:20])


def test_pretoken_lengths_add_up_to_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts(4000):
        parts = tokens.pretokens(text)
        if parts is not None:
            assert sum(tokens._measure(model, [p])[p] for p in parts) == len(model.encode(text)), repr(text)


def test_token_counts(documents, odd, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for frame in (documents, odd):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in frame.collect())
        assert Counter(map(tuple, tokens.token_counts(frame, PIECES).collect())) == want
    assert tokens.token_counts(nothing, PIECES).count() == 0


def test_counts_take_no_exchange_and_keep_two_tiers(documents):
    counted = tokens.token_counts(documents, PIECES)
    assert "Exchange" not in str(counted._jdf.queryExecution().executedPlan())
    table = tokens.frequent_pretokens(documents, entries=50, sample=20)
    assert len(table) == len(set(table)) == 50
    assert len(tokens.frequent_pretokens(documents)) > 50 and tokens.frequent_pretokens(documents.limit(0)) == []
    known = tokens._Known({"a": 1})
    known.cache = {"b": 2}
    assert [known["a"], known["b"]] == [1, 2] and "b" not in known
    with pytest.raises(KeyError):
        known["c"]


def test_frequent_pretokens_are_a_cache_only(documents):
    few = sorted(map(tuple, tokens.token_counts(documents, PIECES, entries=1).collect()))
    assert few == sorted(map(tuple, tokens.token_counts(documents, PIECES).collect()))


@pytest.mark.parametrize("seed", range(6))
def test_histogram_is_packed_whole(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([rng.integers(1, 65, 400), rng.integers(30, 40, 400), rng.integers(1, 5, 400)][seed % 3], 3000)
    plan = packing.pack_histogram(dict(Counter(lengths.tolist())), 64)
    packed = Counter()
    for sequence, n in plan:
        assert sum(sequence) <= 64 and n > 0
        for length in sequence:
            packed[length] += n
    assert packed == Counter(lengths.tolist())
    left = np.bincount(lengths, minlength=65)
    assert sum(n for _, n in plan) <= 1.01 * sum(n for _, n in packing._best_fit(left, 64)) + 2


def test_pattern_counts_fit_the_histogram():
    rows = packing.patterns(12)
    assert sorted({tuple(sorted(r[r > 0])) for r in rows}) == sorted(tuple(sorted(r[r > 0])) for r in rows)
    assert (rows.sum(axis=1) == 12).all()
    want = np.zeros(13)
    want[[7, 5, 4]] = 30, 30, 60
    fitted = packing.fit_counts(want, rows)
    made = np.zeros(13)
    for row, n in zip(rows, fitted, strict=True):
        for length in row[row > 0]:
            made[length] += n
    assert np.abs(made - want).max() < 0.5


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packed_documents(spark, documents, odd, capacity):
    library = Tokenizer.from_file(BYTES)
    for frame in (documents.limit(40), odd):
        packed = packing.pack_documents(frame, BYTES, 2, capacity, with_ids=True)
        rows = packed.collect()
        whole = Counter()
        by_sequence = {}
        for r in rows:
            assert r["length"] == len(r["ids"]) <= capacity
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        for own in by_sequence.values():
            at = 0
            for r in sorted(own, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= capacity
        # Pieces of rows that repeat a doc_id are equal, so a piece may be taken from either.
        pieces = {(r["doc_id"], r["piece"]): r for r in rows}
        for (doc_id, text), n in Counter((r["doc_id"], r["text"]) for r in frame.collect()).items():
            ids = library.encode(text or "", add_special_tokens=False).ids + [2]
            number = -(-len(ids) // capacity)
            whole[doc_id] += number * n
            again = [i for k in range(number) for i in pieces[doc_id, k]["ids"]]
            assert again == ids
            assert [pieces[doc_id, k]["length"] for k in range(1, number)] == [capacity] * (number - 1)
        assert whole == Counter(r["doc_id"] for r in rows)
    sequences = packing.sequences(packed).collect()
    assert sum(len(s["ids"]) for s in sequences) == sum(r["length"] for r in rows)


def test_nothing_to_pack(nothing):
    assert packing.pack_documents(nothing, BYTES, 2).count() == 0
