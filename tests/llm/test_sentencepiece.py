"""Backtracking against the sentencepiece library."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece as library_module

from tidemark.llm import sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = "abcdethes▁  \n\t éßΣ一二😀<s>0x1\x00\ufffd\u200d#.,'"


@pytest.fixture(scope="module")
def library():
    return library_module.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    pieces = sorted(sentencepiece.load(PATH).ids)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    made += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    return [*made, "", " ", "  ", " " * 100, "▁", "▁a", "a" * 5000, "<s>", "<0x0A>", "\n", "the" * 2000, " a", "  a", "a ", "word, " * 500]


def test_ids_and_text_equal_the_library(library):
    model = sentencepiece.load(PATH)
    for text in texts():
        want = library.encode(text)
        assert model.encode(text) == want, text[:60]
        assert model.shown(model.parts(text)) == library.decode(want) == model.decode(want), text[:60]


def test_any_ids_decode_as_the_library_does(library):
    model, rng = sentencepiece.load(PATH), random.Random(4)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_backtracking_takes_pieces_back():
    model = sentencepiece.load(PATH)
    greedy_fails = 0
    for text in texts():
        for cut in model.cut("▁" + text.replace(" ", "▁")):
            pieces = model.segmented(cut)
            assert "".join(pieces) == cut
            if len(cut) <= 60:
                assert pieces == model.remerged(cut)
            first = next((n for n in range(min(len(cut), model.longest), 0, -1) if cut[:n] in model.whole or n == 1), 0)
            greedy_fails += len(pieces[0]) != first
    assert greedy_fails > 100


def test_long_stretches_cost_their_length(library, monkeypatch):
    model, rng = sentencepiece.load(PATH), random.Random(5)
    text = "".join(rng.choice("etaoinsrhl") for _ in range(300_000))
    assert model.encode(text) == library.encode(text)
    monkeypatch.setattr(sentencepiece, "AHEAD", 64)
    assert model.segmented("▁" + text[:5000]) == library.encode(text[:5000], out_type=str)


def test_what_is_known_is_bounded(library, monkeypatch):
    monkeypatch.setattr(sentencepiece, "KNOWN_WORDS", 50)
    monkeypatch.setattr(sentencepiece, "KNOWN_PAIRS", 50)
    model = sentencepiece.Backtracker(PATH)
    for k in range(300):
        text = f"word{k} piece{k * 7}, and: word{k // 2}."
        assert model.encode(text) == library.encode(text)
        assert max(map(len, (*model.words, *model.stretches, model.pairs))) <= 50


def test_digests_of_a_table_with_odd_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[::20])] + [(None, "no id"), (7, None), (0, "again"), (0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "'x' as ids", "2 as n_tokens")
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in sentencepiece.digests(docs, PATH).collect()) == want
    assert sentencepiece.digests(docs.limit(0), PATH).count() == 0


def test_tables_encode_and_decode(spark, library):
    docs = spark.createDataFrame([(1, "Hello wörld  again\n"), (2, None)], "doc_id long, text string")
    coded = sentencepiece.encode(docs, PATH)
    assert {r.doc_id: (r.ids, r.decoded) for r in coded.collect()} == {1: (library.encode("Hello wörld  again\n"), "Hello wörld  again\n"), 2: ([], "")}
    assert {tuple(r) for r in sentencepiece.decode(coded, PATH).collect()} == {(1, "Hello wörld  again\n"), (2, "")}
