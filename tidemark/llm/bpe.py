"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match. A token sequence is what exact merging gives
if and only if each token merges to itself and no merge crosses the border of two adjacent tokens, so a
guess is verified by testing its adjacent pairs, all pairs of a batch of words at once with numpy. Only
words with a failing pair go through exact merging.

The vocabulary file is that of a word-end BPE (byte alphabet, an end-of-word suffix, NFC, lower case,
white space dropped). Defined cases: a null text counts as empty; an empty text gives no tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The word pattern of this kind of vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space to str.split(), but not to the word pattern; texts with these take the slower way.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: A worker forgets its pieces of text when it knows so many; bounds its memory.
KNOWN_PIECES = 700_000
#: Or pieces of so many characters in all.
KNOWN_CHARACTERS = 16_000_000
#: Words of more bytes are looked through place by place and merged one by one; others in rectangles of so many cells.
LONG, CELLS = 512, 1 << 19
NEVER = np.iinfo(np.int64).max


def _picked(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all items of these runs, end to end."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class PairTable:
    """Integer pairs (a, b) -> value, looked up by whole arrays; open addressing, -1 where a pair is absent."""

    def __init__(self, a: np.ndarray, b: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(a)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        todo, slot = self._key(a, b), self._slot(self._key(a, b))
        values = np.asarray(values, np.int64)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = todo[first], values[first]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, values, slot = todo[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.asarray(a, np.int64) << 24) | np.asarray(b, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self._key(a, b)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class SpeculativeBpe:
    """One vocabulary, ready to encode words. Build it once per worker with :func:`load`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, v = model["end_of_word_suffix"], model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*v.items(), *self.added.items()]}
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.words = regex.compile(WORD_PATTERN)
        self.caches: dict[str, PieceCache] = {}
        self.rank_of: dict[int, int] = {}
        alphabet = byte_alphabet()
        #: Byte -> token within a word and at its end. A word is a row of these; longer tokens are merges of them.
        self.inner, self.final = np.array([v[c] for c in alphabet]), np.array([v[c + end] for c in alphabet])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.lefts, self.rights = np.array([v[a] for a, _ in pairs]), np.array([v[b] for _, b in pairs])
        self.made = np.array([v[a + b] for a, b in pairs])
        self.ranks = PairTable(self.lefts, self.rights, np.arange(len(pairs)))
        n = max(v.values()) + 1
        left, right, born = np.full(n, -1), np.full(n, -1), np.full(n, NEVER)
        left[self.made], right[self.made], born[self.made] = self.lefts, self.rights, np.arange(len(pairs))

        def spine(child: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            """Level d: the token on a token's border after d splits (-1: none), and the rank at which it is merged away."""
            node, gone, levels = np.arange(n), np.full(n, NEVER), []
            while (node >= 0).any():
                levels.append((node, gone))
                safe = np.where(node >= 0, node, 0)
                gone, node = np.where(node >= 0, born[safe], NEVER), np.where(node >= 0, child[safe], -1)
            return levels

        self.right_spine, self.left_spine = spine(right), spine(left)
        # A token can be proposed if exact merging of its own bytes gives it: both parts can, and no merge
        # crosses their border before its own does.
        sound = self.first_crossing(self.lefts, self.rights) >= np.arange(len(pairs))
        reach = left < 0
        bases: list[tuple[int, ...]] = [(t,) for t in range(n)]
        for t, x, y, ok in zip(self.made.tolist(), self.lefts.tolist(), self.rights.tolist(), sound.tolist(), strict=True):
            reach[t] = ok and reach[x] and reach[y]
            bases[t] = bases[x] + bases[y]
        self._plant([(bases[t], t) for t in range(n) if reach[t]])

    def _plant(self, tokens: list[tuple[tuple[int, ...], int]]) -> None:
        """A trie over the base tokens of every token that can be proposed; node 0 is the root."""
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for base, t in tokens:
            at = 0
            for c in base:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            ends[at] = t
        edges = np.array(list(nodes), np.int64)
        self.trie = PairTable(edges[:, 0], edges[:, 1], np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.ends = np.full(len(nodes) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def first_crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens the rank of the first merge across their border; NEVER if none.

        A merge of x (on the right spine of a) and y (on the left spine of b) happens if its rank comes before x is
        merged away and not after y is: of equal merges the leftmost goes first."""
        out = np.full(len(a), NEVER)
        for x_level, x_gone in self.right_spine:
            x, gx = x_level[a], x_gone[a]
            live = np.flatnonzero(x >= 0)
            if not len(live):
                break
            for y_level, y_gone in self.left_spine:
                y = y_level[b[live]]
                live = live[y >= 0]
                if not len(live):
                    break
                rank = self.ranks.get(x[live], y[y >= 0])
                crosses = (rank >= 0) & (rank < gx[live]) & (rank <= y_gone[b[live]])
                out[live[crosses]] = np.minimum(out[live[crosses]], rank[crosses])
        return out

    def bases(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' base tokens, end to end, and how many each word has."""
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), np.uint8)
        flat = self.inner[raw]
        last = np.cumsum(sizes) - 1
        flat[last] = self.final[raw[last]]
        return flat, sizes

    def speculate(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: the tokens in order, and the word of each."""
        if (sizes > LONG).any():
            return self._with_long(flat, sizes)
        stop = np.cumsum(sizes)
        live = np.arange(len(sizes))
        start, at, node = stop - sizes, stop - sizes, np.zeros(len(sizes), np.int64)
        best, best_end = np.full(len(sizes), -1), stop - sizes
        out = []
        while len(live):
            inside = at < stop[live]
            node = np.where(inside, self.trie.get(np.maximum(node, 0), flat[np.minimum(at, len(flat) - 1)]), -1)
            token = np.where(node >= 0, self.ends[node], -1)
            at = at + 1
            hit = token >= 0
            best, best_end = np.where(hit, token, best), np.where(hit, at, best_end)
            done = node < 0  # nothing longer: the longest match so far is the token
            if done.any():
                out.append((live[done], start[done], best[done]))
                start = np.where(done, best_end, start)
                at, node = np.where(done, best_end, at), np.where(done, 0, node)
                keep = start < stop[live]
                live, start, at, node, best, best_end = live[keep], start[keep], at[keep], node[keep], best[keep], best_end[keep]
        word, begin, token = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(begin, kind="stable")
        return token[order], word[order]

    def _with_long(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Speculation where some words are long: in those the longest match is taken at every place at once, then followed."""
        long = np.flatnonzero(sizes > LONG)
        short = np.flatnonzero(sizes <= LONG)
        starts = np.cumsum(sizes) - sizes
        tokens, words = [], []
        if len(short):
            token, word = self.speculate(flat[_picked(starts[short], sizes[short])], sizes[short])
            tokens.append(token)
            words.append(short[word])
        for w in long.tolist():
            mine = flat[starts[w] : starts[w] + sizes[w]]
            token, end = self._longest_everywhere(mine)
            token, end, at, out = token.tolist(), end.tolist(), 0, []
            while at < len(mine):
                out.append(token[at])
                at = end[at]
            tokens.append(np.array(out, np.int64))
            words.append(np.full(len(out), w))
        token, word = np.concatenate(tokens), np.concatenate(words)
        order = np.argsort(word, kind="stable")
        return token[order], word[order]

    def _longest_everywhere(self, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that starts at each place of a word, and its end."""
        best, end = np.full(len(base), -1), np.arange(len(base)) + 1
        live, node, depth = np.arange(len(base)), np.zeros(len(base), np.int64), 0
        while len(live):
            node = self.trie.get(node, base[live + depth])
            depth += 1
            hit = node >= 0
            live, node = live[hit], node[hit]
            token = self.ends[node]
            best[live[token >= 0]], end[live[token >= 0]] = token[token >= 0], live[token >= 0] + depth
            inside = live + depth < len(base)
            live, node = live[inside], node[inside]
        return best, end

    def _merge_long(self, base: list[int]) -> list[int]:
        """Exact merging of one long word: a queue of pairs by rank and place over a linked list."""
        if not self.rank_of:
            self.rank_of = dict(zip(((self.lefts << 24) | self.rights).tolist(), range(len(self.lefts)), strict=True))
        rank_of, made = self.rank_of, self.made
        n, tok = len(base), list(base)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := rank_of.get(tok[i] << 24 | tok[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            # A pair that an earlier merge has changed is out of date.
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = int(made[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(tok[i] << 24 | tok[k])) is not None:
                    heapq.heappush(queue, (r, i, tok[i], tok[k]))
            h = before[i]
            if h >= 0 and (r := rank_of.get(tok[h] << 24 | tok[i])) is not None:
                heapq.heappush(queue, (r, h, tok[h], tok[i]))
        return [t for t in tok if t >= 0]

    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging, the pair of lowest rank first and the leftmost of equals, one merge in every word a round.

        Words share a rectangle with words of up to twice their length, of CELLS cells at most; long ones go one by one."""
        out_token, out_word = [], []
        offsets = np.cumsum(sizes) - sizes
        for w in np.flatnonzero(sizes > LONG).tolist():
            merged = self._merge_long(flat[offsets[w] : offsets[w] + sizes[w]].tolist())
            out_token.append(np.array(merged, np.int64))
            out_word.append(np.full(len(merged), w))
        parts = []
        for bits in range(1, LONG.bit_length() + 1):
            alike = np.flatnonzero((sizes <= LONG) & (sizes >= (1 << bits) >> 1) & (sizes < 1 << bits))
            parts += np.array_split(alike, -(-(len(alike) << bits) // CELLS)) if len(alike) else []
        for part in parts:
            width = int(sizes[part].max())
            cols = np.arange(width)
            held = cols < sizes[part][:, None]
            tok = np.where(held, flat[np.minimum(offsets[part][:, None] + cols, len(flat) - 1)], -1)
            size, rows = sizes[part].copy(), part
            rank = np.full(tok.shape, NEVER)
            at = np.nonzero(held[:, 1:])
            found = self.ranks.get(tok[:, :-1][at], tok[:, 1:][at])
            rank[:, :-1][at] = np.where(found >= 0, found, NEVER)
            while len(rows):
                best = rank.argmin(axis=1)
                line = np.arange(len(rows))
                low = rank[line, best]
                ended = low == NEVER
                if ended.any():
                    keep = cols < size[ended][:, None]
                    out_token.append(tok[ended][keep])
                    out_word.append(np.repeat(rows[ended], size[ended]))
                    tok, rank, size, rows, best, low = tok[~ended], rank[~ended], size[~ended], rows[~ended], best[~ended], low[~ended]
                    if not len(rows):
                        break
                    line = np.arange(len(rows))
                shift = np.minimum(cols + (cols > best[:, None]), width - 1)
                tok, rank = np.take_along_axis(tok, shift, 1), np.take_along_axis(rank, shift, 1)
                size = size - 1
                tok[line, best] = self.made[low]
                for side in (best - 1, best):  # the ranks on both sides of the merged token
                    ok = np.flatnonzero((side >= 0) & (side < size - 1))
                    found = self.ranks.get(tok[line[ok], side[ok]], tok[line[ok], side[ok] + 1])
                    rank[line[ok], side[ok]] = np.where(found >= 0, found, NEVER)
                over = np.flatnonzero(best >= size - 1)
                rank[line[over], best[over]] = NEVER
                rank[line, size - 1] = NEVER
        token, word = np.concatenate(out_token), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return token[order], word[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' tokens end to end, and how many each has: guesses, verified together, merged where they fail."""
        flat, sizes = self.bases(words)
        token, word = self.speculate(flat, sizes)
        within = np.flatnonzero(word[:-1] == word[1:])
        pairs, back = np.unique((token[within] << 24) | token[within + 1], return_inverse=True)
        crossed = self.first_crossing(pairs >> 24, pairs & 0xFFFFFF) != NEVER
        wrong = np.zeros(len(words), bool)
        wrong[word[within[crossed[back]]]] = True
        if wrong.any():
            bad = np.flatnonzero(wrong)
            starts = np.cumsum(sizes) - sizes
            again, owner = self.merge(flat[_picked(starts[bad], sizes[bad])], sizes[bad])
            keep = ~wrong[word]
            token, word = np.concatenate([token[keep], again]), np.concatenate([word[keep], bad[owner]])
            order = np.argsort(word, kind="stable")
            token, word = token[order], word[order]
        return token, np.bincount(word, minlength=len(words))

    def split(self, chunk: str) -> list[str]:
        """The words of a lower-cased piece of text without white space."""
        return [chunk] if chunk.isalpha() else self.words.findall(chunk)

    def pieces(self, text: str) -> list[str]:
        """Normalised white-space-free pieces of one text; added tokens stand alone in their own spelling."""
        if "<|" in text:
            parts = self.added_pattern.split(text)
            if len(parts) > 1:
                return [y for x in parts for y in ([x] if x in self.added else self.pieces(x))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return self.words.findall(text) if ODD_SPACE.search(text) else text.split()


@lru_cache(maxsize=2)
def load(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


class PieceCache(dict):
    """Piece of text -> what ``render`` makes of its token ids; joined over the words of a piece."""

    def __init__(self, bpe: SpeculativeBpe, render, join):
        super().__init__()
        self.bpe, self.render, self.join, self.characters = bpe, render, join, 0

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't known, all their distinct words together."""
        todo = [p for p in pieces if p not in self]
        more = sum(map(len, todo))
        if len(self) + len(todo) > KNOWN_PIECES or self.characters + more > KNOWN_CHARACTERS:
            self.clear()
            todo, self.characters = list(pieces), 0
            more = sum(map(len, todo))
        self.characters += more
        added, split = self.bpe.added, self.bpe.split
        parts = [() if p in added else split(p) for p in todo]
        words = list({w for ws in parts for w in ws})
        shown = {}
        if words:
            token, sizes = self.bpe.encode_words(words)
            stops = np.cumsum(sizes)
            shown = dict(zip(words, self.render(token, (stops - sizes).tolist(), stops.tolist()), strict=True))
        for p, ws in zip(todo, parts, strict=True):
            self[p] = shown[ws[0]] if len(ws) == 1 else self.join([shown[w] for w in ws]) if p not in added else self.render(np.array([added[p]]), [0], [1])[0]

    def batches(self, texts: list[str | None]):
        """For each text its pieces, rendered, in order. Texts are taken some megabytes at a time."""
        held, size = [], 0
        for text in texts:
            held.append(self.bpe.pieces(text or ""))
            size += len(held[-1])
            if size > 200_000:
                yield from self._known(held)
                held, size = [], 0
        yield from self._known(held)

    def _known(self, held: list[list[str]]):
        self.learn(set().union(*held))
        for pieces in held:
            yield [self[p] for p in pieces]


def _kept(bpe: SpeculativeBpe, name: str, render, join) -> PieceCache:
    """The worker's cache of this kind, so that later tasks of the same worker find it filled."""
    if name not in bpe.caches:
        bpe.caches[name] = PieceCache(bpe, render, join)
    return bpe.caches[name]


def token_bytes(bpe: SpeculativeBpe) -> PieceCache:
    """Pieces to their ids as little-endian unsigned 32-bit integers."""

    def render(token, starts, stops):
        raw = token.astype("<u4").tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(starts, stops, strict=True)]

    return _kept(bpe, "bytes", render, b"".join)


def token_strings(bpe: SpeculativeBpe) -> PieceCache:
    """Pieces to (decimal ids joined by a space, decoded tokens joined by a space, number of tokens)."""

    def render(token, starts, stops):
        ids, names = list(map(str, token.tolist())), list(map(bpe.names.__getitem__, token.tolist()))
        return [(" ".join(ids[i:j]), " ".join(names[i:j]), j - i) for i, j in zip(starts, stops, strict=True)]

    def join(parts):
        return " ".join(p[0] for p in parts), " ".join(p[1] for p in parts), sum(p[2] for p in parts)

    return _kept(bpe, "strings", render, join)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: ``id, ids array<int>, decoded string``. Null text: empty; null ids stay null."""

    def run(batches):
        bpe = load(vocab_path)
        cache = token_bytes(bpe)
        for batch in batches:
            ids, decoded = [], []
            for parts in cache.batches(batch.column(1).to_pylist()):
                ids.append(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                decoded.append(" ".join(map(bpe.names.__getitem__, ids[-1].tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`encode`, with the lists folded to ``n_tokens, ids_sha256, decoded_sha256`` in the same pass."""

    def run(batches):
        cache = token_strings(load(vocab_path))
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for parts in cache.batches(batch.column(1).to_pylist()):
                parts = [p for p in parts if p[2]]
                counts.append(sum(p[2] for p in parts))
                hashes.append(hashlib.sha256(" ".join([p[0] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, vocab_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids plus ``end_id``, cut into pieces of at most ``capacity``: ``id, piece, start, length, ids_crc32``."""

    def run(batches):
        cache = token_bytes(load(vocab_path))
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            keys, piece, start, length, crc = [], [], [], [], []
            for row, parts in enumerate(cache.batches(batch.column(1).to_pylist())):
                ids = b"".join(parts) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    keys.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
