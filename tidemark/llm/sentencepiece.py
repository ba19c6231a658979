"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking.

Such a model merges the two neighbours whose joined text is the piece of the best score, the leftmost of equals, until none can
be joined. A sequence of pieces is what that gives if and only if each piece merges to itself and each adjacent pair, merged
anew, stays that pair. So at each place the longest piece that starts there (all matches come from one Aho-Corasick pass) is
tried, then the shorter ones; a piece is taken if it is compatible with the one before it. Where none is, the place is marked in a
bitfield of failed places and the last piece is taken back. A place is reached by one sequence alone, so a failed place never has
to be tried again, and a text costs its length.

A text is cut first where no piece can cross: between characters that stand side by side in no piece of the vocabulary, so before each
word and around most marks. Workers remember words and stretches that they encoded, as many as a stated bound allows.

Defined cases: a null text counts as empty, an empty text has no tokens; a character without a piece becomes its bytes' pieces, or the
unknown piece where the model has none; texts of any length are whole; rows are independent, so repeated rows and ids repeat their result;
null ids stay null; columns of other names pass by unseen. A model that rewrites texts (a normalizer other than identity, pieces by the user,
white space removed, spaces as suffixes) or isn't of the merge type is an error.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from operator import add

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: How such models write a space, and what decoding shows for bytes that are no text.
SPACE, BROKEN = "▁", "�"
#: A worker forgets what it knows at so many words, so many of their characters, so many pairs of pieces.
KNOWN_WORDS, KNOWN_CHARACTERS, KNOWN_PAIRS = 400_000, 12_000_000, 1_000_000
#: Matches are looked up so many characters ahead.
AHEAD = 4096
#: Runs of spaces with what follows them.
WORDS = re.compile(" +[^ ]*")

#: Of a word: its ids as text, the decoded text with its leading space, the number of ids.
Known = tuple[str, str, int]


class Backtracker:
    """One model, ready to encode and decode. Build it once per worker with :func:`load`."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
            raise ValueError(f"{path}: not a model of the merge type")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: the model rewrites texts before it encodes them")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: the model has pieces that are not merged by score")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.names = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.unknown = model.trainer_spec.unk_id
        self.unknown_text = model.trainer_spec.unk_surface
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes = {b: i for i, b in self.byte_of.items()} if model.trainer_spec.byte_fallback else {}
        self.longest = max(map(len, self.ids), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Characters that stand side by side in a piece, and whether words can be told apart by the spaces before them.
        self.beside = {p[i - 1 : i + 1] for p in self.ids for i in range(1, len(p))}
        self.by_words = bool(self.prefix) and not any(b[0] != SPACE and b[1] == SPACE for b in self.beside)
        # A piece can be taken if merging its own text gives it whole.
        self.matches = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and self.remerged(p) == [p]:
                self.matches.add_word(p, len(p))
        self.matches.make_automaton()
        self.whole = set(self.matches.keys())
        self.surface = [self.unknown_text if i == self.unknown else "" if i in self.hidden else p.replace(SPACE, " ") for i, p in enumerate(self.names)]
        #: Words and stretches known, younger and older; the older go when the younger are too many.
        self.words: tuple[dict[str, Known], dict[str, Known]] = ({}, {})
        self.stretches: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        self.characters = [0, 0]
        #: Marks that are a piece of their own.
        self.marks = {p: (str(i), p, 1) for p, i in self.ids.items() if len(p) == 1 and p != SPACE and not p.isalnum()}

    def cut(self, text: str) -> list[str]:
        """The stretches between places that no piece crosses: neighbours that stand side by side in no piece."""
        beside = self.beside
        if beside.issuperset(map(add, text, text[1:])):
            return [text]
        at = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in beside]
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]

    def remerged(self, text: str) -> list[str]:
        """Exact merging of a short text."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether two adjacent pieces stay as they are when their joined text is merged anew."""
        held = self.pairs.get((a, b))
        if held is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            held = self.pairs[a, b] = self.remerged(a + b) == [a, b]
        return held

    def _lengths(self, text: str, start: int) -> list[int]:
        """For each of the next places a bit for each length of a piece that starts there; a lone character always can."""
        end = min(len(text), start + AHEAD)
        found = [2] * (end - start)
        ahead = self.matches.iter(text, start, min(len(text), end + self.longest - 1)) if len(text) > AHEAD else self.matches.iter(text)
        for last, n in ahead:
            at = last - n + 1
            if at < end:
                found[at - start] |= 1 << n
        return found

    def segmented(self, text: str) -> list[str]:
        """The pieces of a stretch; characters without a piece stand alone."""
        if len(text) == 1 or text in self.whole:
            return [text]
        n, held = len(text), self.pairs.get
        failed = bytearray(n // 8 + 1)
        ends = array("q", [0])
        base, ahead = 0, self._lengths(text, 0)
        at, before, tried = 0, "", 0
        while at < n:
            if not base <= at < base + len(ahead):
                base, ahead = at, self._lengths(text, at)
            bits = ahead[at - base]
            if tried:
                bits &= (1 << tried) - 1
            while bits:
                tried = bits.bit_length() - 1
                end = at + tried
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = text[at:end]
                    if not before:
                        break
                    fits = held((before, piece))
                    if fits or (fits is None and self.compatible(before, piece)):
                        break
                bits ^= 1 << tried
            if bits:
                ends.append(end)
                at, before, tried = end, piece, 0
            else:
                if at == 0:
                    raise ValueError(f"no sequence of pieces for {text[:60]!r}")
                failed[at >> 3] |= 1 << (at & 7)
                ends.pop()
                tried, at = at - ends[-1], ends[-1]
                before = text[ends[-2] : at] if len(ends) > 1 else ""
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _joined(self, ids) -> str:
        """The pieces' texts, leading spaces kept; byte pieces side by side are read together."""
        out, held, byte_of = [], bytearray(), self.byte_of
        for i in ids:
            if i in byte_of:
                held.append(byte_of[i])
                continue
            if held:
                out.append(_readable(held))
                held = bytearray()
            out.append(self.surface[i])
        if held:
            out.append(_readable(held))
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of these ids, without the space that encoding puts before a text."""
        ids = list(ids)
        first = next((k for k, i in enumerate(ids) if i not in self.hidden), len(ids))
        text = self._joined(ids[first:])
        leads = first < len(ids) and self.prefix and ids[first] not in self.byte_of and ids[first] != self.unknown
        return text[1:] if leads and text.startswith(" ") else text

    def _held(self, kind: int, caches: tuple[dict, dict], key: str, value):
        """Remember a value among the younger; when those are too many or too long, they become the older."""
        young, old = caches
        self.characters[kind] += len(key)
        if len(young) >= KNOWN_WORDS or self.characters[kind] > KNOWN_CHARACTERS:
            old.clear()
            old.update(young)
            young.clear()
            self.characters[kind] = len(key)
        young[key] = value
        return value

    def learned(self, word: str) -> Known:
        """What follows a space up to the next word, encoded; it is remembered under the text without that space.

        A word with a mark behind it that no piece crosses is put together from the two."""
        young, old = self.words
        held = old.get(word)
        if held is None:
            if len(word) > 1 and word[-2] != " " and word[-2:] not in self.beside and (mark := self.marks.get(word[-1])):
                bare = young.get(word[:-1]) or self.learned(word[:-1])
                return f"{bare[0]},{mark[0]}", bare[1] + mark[1], bare[2] + mark[2]
            held = self._encoded(SPACE + word.replace(" ", SPACE))
        return self._held(0, self.words, word, held)

    def _encoded(self, text: str) -> Known:
        cuts = self.cut(text)
        ids = self._ids(cuts[0]) if len(cuts) == 1 else [i for cut in cuts for i in self._stretch(cut)]
        surface = self.surface
        shown = "".join([surface[i] for i in ids]) if self.byte_of.keys().isdisjoint(ids) else self._joined(ids)
        return ",".join(map(str, ids)), shown, len(ids)

    def _ids(self, cut: str) -> list[int]:
        found = [self.ids.get(p) for p in self.segmented(cut)]
        return [i for p in self.segmented(cut) for i in self.ids_of(p)] if None in found else found

    def _stretch(self, cut: str) -> list[int]:
        """A stretch of a longer word, remembered."""
        young, old = self.stretches
        held = young.get(cut)
        if held is None:
            held = self._held(1, self.stretches, cut, old.get(cut) or self._ids(cut))
        return held

    def parts(self, text: str | None) -> list[Known]:
        """What is known of each word of a text, in order."""
        if not text:
            return []
        if not self.by_words:
            return [self._encoded(self.prefix + text.replace(" ", SPACE))]
        if SPACE in text:
            text = text.replace(SPACE, " ")
        words = [w[1:] for w in WORDS.findall(" " + text)] if "  " in text or text[0] == " " else text.split(" ")
        known, learned = self.words[0].get, self.learned
        return [known(w) or learned(w) for w in words]

    def shown(self, parts: list[Known]) -> str:
        """The decoded text of a whole text's parts."""
        text = "".join([p[1] for p in parts])
        return text[1:] if self.prefix and text.startswith(" ") else text

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[0].split(",")]


def _readable(raw: bytearray) -> str:
    """UTF-8 with one replacement for each byte that isn't."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(BROKEN)
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Backtracker:
    return Backtracker(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: the id column, ``ids array<int>, decoded string``."""

    def run(batches):
        model = load(model_path)
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(1):
                parts = model.parts(text.as_py())
                ids.append([int(i) for p in parts for i in p[0].split(",")])
                decoded.append(model.shown(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each list of ids: the id column and ``text``; null lists count as empty."""

    def run(batches):
        model = load(model_path)
        for batch in batches:
            texts = [model.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    picked = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].cast("array<int>").alias("ids"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("text", T.StringType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`encode`, with the lists folded to ``n_tokens, ids_sha256, decoded_sha256`` in the same pass."""

    def run(batches):
        model = load(model_path)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for text in batch.column(1):
                parts = model.parts(text.as_py())
                counts.append(sum([p[2] for p in parts]))
                hashes.append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(model.shown(parts).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
