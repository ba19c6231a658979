"""BPE against the tokenizers library, packing against its own rules."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "abcdeé ß'sΣσİıŉ½²Ⅷ一二́ 　\x1c\x85\n\t!?#<|>😀ǅ‍١٢x"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [*made, "", " ", "<|endoftext|>a<|startoftext|> b", "it's we'll <|endoftext|", "a" * 60, "word " * 3000, "Thouble, ANOTHER. thereinafter"]


def test_pieces_encode_as_the_library_does(library):
    cache = bpe.token_bytes(bpe.load(PATH))
    for text, parts in zip(texts(), cache.batches(texts()), strict=True):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_failing_guesses_are_merged():
    tokenizer = bpe.load(PATH)
    words = sorted({w for t in texts() for w in t.lower().split() if w.isalpha() and w.isascii()} | {"thingouble", "onreation", "aaaaaaa", "thentlyst"})
    flat, sizes = tokenizer.bases(words)
    guess, of_guess = tokenizer.speculate(flat, sizes)
    exact, of_exact = tokenizer.merge(flat, sizes)
    final, counts = tokenizer.encode_words(words)
    assert final.tolist() == exact.tolist() and counts.tolist() == np.bincount(of_exact, minlength=len(words)).tolist()
    assert guess.tolist() != exact.tolist()


def test_long_words_equal_the_library_in_bounded_memory(library):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "the" * 3000 + "q", "ab" * 700, "é" * 900, "=" * 5000, "x" * 513, "then" * 128]
    words += ["thentlyst" + "".join(rng.choice("etaoinsr") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    tokenizer = bpe.load(PATH)
    tracemalloc.start()
    token, counts = tokenizer.encode_words(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    stops = np.cumsum(counts)
    for word, a, b in zip(words, stops - counts, stops, strict=True):
        assert token[a:b].tolist() == library.encode(word, add_special_tokens=False).ids, word[:60]


def test_known_pieces_are_bounded_by_their_characters(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_CHARACTERS", 500)
    cache = bpe.PieceCache(bpe.load(PATH), *(lambda c: (c.render, c.join))(bpe.token_bytes(bpe.load(PATH))))
    for k in range(20):
        for parts in cache.batches([f"{'ab' * 100} piece{k}"]):
            assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(f"{'ab' * 100} piece{k}", add_special_tokens=False).ids
        assert sum(map(len, cache)) <= 500


def test_digests_and_decoding(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(10_000, None), (0, texts()[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as ids", "1 as id")
    got = bpe.digests(docs, PATH).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want


def test_encode_returns_ids_and_text(spark, library):
    docs = spark.createDataFrame([(1, "Hello there, thing!"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode(docs, PATH).collect()}
    ids = library.encode("Hello there, thing!", add_special_tokens=False).ids
    assert got == {1: (ids, library.decode(ids, skip_special_tokens=False)), 2: ([], "")}


@pytest.mark.parametrize("capacity", [10, 64, 2048])
def test_plan_places_every_piece_once_without_gaps(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        counts = Counter()
        for _ in range(rng.randint(0, 200)):
            counts[rng.randint(1, capacity)] += rng.choice([1, 1, 2, 9])
        sequences, seen = {}, Counter()
        for length, start, end, first, each, offset in packing.plan(dict(counts), capacity):
            for rank in range(start, end):
                sequences.setdefault(first + (rank - start) // each, []).append((offset + (rank - start) % each * length, length))
                seen[length] += 1
        assert seen == counts
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        least = -(-sum(k * n for k, n in counts.items()) // capacity)
        larger_half = sum(n for k, n in counts.items() if 2 * k > capacity)
        # Best fit in falling order needs at most 11/9 of the optimum and one; the volume and the large pieces bound that from below.
        assert max(least, larger_half) <= len(sequences)
        few = sum(n for k, n in counts.items() if 5 * k >= capacity) == 0
        assert not few or len(sequences) <= 5 / 4 * least + 1


def test_plan_is_tight_and_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(2)
    natural = Counter(np.minimum(2048, rng.lognormal(5.5, 1.2, 200_000).astype(int) + 1).tolist())
    for counts in ({1700: 50_000, 300: 50_000}, {1500: 30_000, 400: 20_000, 120: 40_000}, {683: 10_000, 700: 9_001}, {1100: 7, 900: 50_000, 40: 3}, dict(natural)):
        places = [packing.plan({k: n * times for k, n in counts.items()}, 2048) for times in (1, 64)]
        assert len(places[1]) <= len(places[0]) + 4 * len(counts)
        assert len(places[1]) <= 12 * len(counts)
    sequences = max(first + (end - start - 1) // each + 1 for _, start, end, first, each, _ in packing.plan(dict(natural), 2048))
    assert sequences <= 1.001 * sum(k * n for k, n in natural.items()) / 2048 + 1


def test_dominance_is_no_worse_than_the_optimum():
    """Against exhaustive search on tiny instances."""

    def optimum(items, capacity):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity:
                    bins[k] += items[i]
                    place(i + 1, bins)
                    bins[k] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best

    rng = random.Random(1)
    for _ in range(80):
        items = sorted((rng.randint(3, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        fixed, rest = packing.reduce_by_dominance(dict(Counter(items)), 20)
        left = [k for k, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + optimum(left, 20) == optimum(items, 20), items


def test_packed_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, texts()[3]), (9_999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 as length", "0 as piece")
    got = packing.pack_documents(docs, PATH, 2048).collect()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.where("false"), PATH).count() == 0
