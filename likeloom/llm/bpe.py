"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols sit in the leaves' positions; leaf i holds the merge rank of the pair that starts
at symbol i, packed with i, so the root is the leftmost lowest-rank merge. A merge changes the pair
at its place and the pair before it, and removes the pair of the swallowed symbol: three point
updates, each along one path to the root. The tree is worked until no mergeable pair remains.

Many distinct words are worked in lockstep: one tree a row, so that each step is a handful of numpy
operations. Words of more than LONG bytes share one tree over all their pairs, parted by gaps: the root
yields the lowest rank, and all places of that rank are merged in one step, from the left. That is
the same as one by one where no merge makes a pair of a lower rank, which is checked when the file is
read; else only the leftmost is merged. So a step costs a rank, not a merge, and a word of a megabyte
takes seconds. Words recur, so encodings of shorter ones are kept in a bounded memory per worker.

The tokenizer file's own normaliser steps and split pattern are read from the file. decode() is the
library's for a model without a decoder: the tokens joined by one space.

Edge cases: a null text counts as empty (no ids, empty decoding); special-token strings in a text
give their ids, as the library does; repeated rows are encoded each on its own; texts without any
white space take time in proportion to their length, but for a logarithm.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import arrow_pass, blocks, texts_of

_SEPARATORS = re.compile("[\x1c-\x1f]")
NO_PAIR = np.int64(1) << 62
#: Encoded words kept per worker; the older half goes when it is full.
KEPT_WORDS = 600_000
#: Words of more bytes than this share a tree; their encodings aren't kept.
LONG = 64


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Bpe:
    """A tokenizer file's model, with its merges as a sorted table of packed pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        alphabet = byte_alphabet()
        self.first = np.array([self.vocab[alphabet[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([self.vocab[alphabet[b] + self.suffix] for b in range(256)], dtype=np.int64)
        pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs[self.vocab[left] << 20 | self.vocab[right]] = (rank, self.vocab[left + right])
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.pairs.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.pairs.tolist()], dtype=np.int64)
        #: Whether each merge comes after those that make its parts, so that no merge gives a pair of a lower rank.
        made: dict[int, int] = {}
        for rank, token in pairs.values():
            made[token] = max(rank, made.get(token, rank))
        self.rising = all(rank > max(made.get(key >> 20, -1), made.get(key & 0xFFFFF, -1)) for key, (rank, _) in pairs.items())
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern)
        self.library = Tokenizer.from_file(path)
        steps = spec["normalizer"]["normalizers"]
        self.steps = [x["type"] for x in steps]
        self.spaces = regex.compile(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Replace"))

    # ---- text to words ----

    def pieces(self, word: str) -> list[str]:
        """The normalised pieces of a text without white space."""
        if max(word) >= "\u0300":
            # The library's own tables: its Unicode version may differ from Python's.
            normal = self.library.normalizer.normalize_str(word)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        for step in self.steps:
            word = word.lower() if step == "Lowercase" else unicodedata.normalize(step, word) if step in ("NFC", "NFD", "NFKC", "NFKD") else word
        return [word] if word.isalpha() else self.words.findall(word)

    # ---- words to ids ----

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NO_PAIR) and place in the merge table of each pair."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_PAIR), at

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 after their ends, merged in lockstep; swallowed places are -1."""
        rows, width = symbols.shape
        leaves = 1 << max(1, (width - 1).bit_length())
        shift = np.int64(leaves.bit_length())
        tree = np.full((rows, 2 * leaves), NO_PAIR, dtype=np.int64)
        rank, _ = self._lookup(symbols[:, :-1], symbols[:, 1:])
        place = np.arange(width - 1, dtype=np.int64)
        tree[:, leaves : leaves + width - 1] = np.where(rank == NO_PAIR, NO_PAIR, rank << shift | place)
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, width + 1, dtype=np.int64), (rows, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int64), (rows, 1))
        symbols = np.hstack([symbols, np.full((rows, 1), -1, dtype=np.int64)])  # place `width` is never a symbol

        def update(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[row, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(live):
            at = tree[live, 1] & ((np.int64(1) << shift) - 1)
            gone = after[live, at]
            _, entry = self._lookup(symbols[live, at], symbols[live, gone])
            symbols[live, at] = self.merged[entry]
            symbols[live, gone] = -1
            beyond = after[live, gone]
            after[live, at] = beyond
            inside = beyond < width
            before[live[inside], beyond[inside]] = at[inside]
            update(live, gone, np.full(len(live), NO_PAIR))
            for start, ok in ((at, np.ones(len(live), dtype=bool)), (before[live, at], before[live, at] >= 0)):
                row, start = live[ok], start[ok]
                if len(row):
                    rank, _ = self._lookup(symbols[row, start], symbols[row, after[row, start]])
                    update(row, start, np.where(rank == NO_PAIR, NO_PAIR, rank << shift | start))
            live = live[tree[live, 1] < NO_PAIR]
        return symbols[:, :-1]

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of words with -1 between them, merged in one tree; swallowed places are -1."""
        n = len(symbols)
        leaves = 1 << max(1, (n - 1).bit_length())
        tree = np.full(2 * leaves, NO_PAIR, dtype=np.int64)
        tree[leaves : leaves + n - 1] = self._lookup(symbols[:-1], symbols[1:])[0]
        level = leaves
        while level > 1:
            level //= 2
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        symbols = np.append(symbols, -1)  # place n is never a symbol
        while tree[1] < NO_PAIR:
            at = np.ones(1, dtype=np.int64)
            while at[0] < leaves:  # down to all leaves of the root's rank, from left to right
                at = np.repeat(2 * at, 2)
                at[1::2] += 1
                at = at[tree[at] == tree[1]]
            at -= leaves
            if not self.rising:
                at = at[:1]
            elif len(at) > 1:  # of places that overlap (a pair of equal symbols in a run) every other one
                linked = np.append(False, after[at[:-1]] == at[1:])
                start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            _, entry = self._lookup(symbols[at], symbols[gone])
            symbols[at], symbols[gone] = self.merged[entry], -1
            beyond = after[gone]
            after[at] = beyond
            before[beyond[beyond < n]] = at[beyond < n]
            left = before[at]
            again = np.concatenate([at, left[left >= 0]])
            tree[gone + leaves] = NO_PAIR
            tree[again + leaves] = self._lookup(symbols[again], symbols[after[again]])[0]
            nodes = np.unique(np.concatenate([again, gone]) + leaves)
            while nodes[0] > 1:
                nodes = nodes >> 1
                nodes = nodes[np.append(True, nodes[1:] != nodes[:-1])]
                tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
        return symbols[:-1]

    def _encode_long(self, words: list[bytes]) -> list[list[int]]:
        gaps = np.cumsum([len(w) + 1 for w in words])
        flat = np.frombuffer(b" ".join([*words, b""]), dtype=np.uint8)
        symbols = self.first[flat]
        symbols[gaps - 2] = self.last[flat[gaps - 2]]
        symbols[gaps - 1] = -1
        symbols = self._merge_long(symbols)
        return [x[x >= 0].tolist() for x in np.split(symbols, gaps[:-1])]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (a piece of the split, not empty)."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        start = 0
        if long := [i for i in order if len(raw[i]) > LONG]:
            order = order[: len(order) - len(long)]
            for i, ids in zip(long, self._encode_long([raw[i] for i in long]), strict=True):
                out[i] = ids
        while start < len(order):
            width = len(raw[order[start]])
            # Rows are as wide as the widest word among them: at most a quarter wider than the narrowest, some MB of tree.
            end, most = start, max(1, (1 << 18) // max(width, 8))
            while end < len(order) and end - start < most and len(raw[order[end]]) <= max(width + 1, width + width // 4):
                end += 1
            group = order[start:end]
            lengths = np.array([len(raw[i]) for i in group])
            wide = int(lengths[-1])
            symbols = np.full((len(group), wide), -1, dtype=np.int64)
            inside = np.arange(wide) < lengths[:, None]
            flat = np.frombuffer(b"".join(raw[i] for i in group), dtype=np.uint8)
            symbols[inside] = self.first[flat]
            ends = np.cumsum(lengths) - 1
            symbols[np.arange(len(group)), lengths - 1] = self.last[flat[ends]]
            if wide > 1:
                symbols = self._merge_rows(symbols)
            ids = symbols[symbols >= 0].tolist()
            cuts = np.cumsum((symbols >= 0).sum(axis=1)).tolist()
            at = 0
            for i, cut in zip(group, cuts, strict=True):
                out[i], at = ids[at:cut], cut
            start = end
        return out


class Coder:
    """Encodes and decodes texts; keeps the blank-separated words it has met, KEPT_WORDS at most.

    Neither a split's piece nor a normalisation reaches over white space, so a text's ids are those
    of its blank-separated words in turn.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.bpe, self.kept = Bpe(path), kept
        #: word -> its ids as decimals and its tokens, each joined by one space
        self.new: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def _words(self, text: str) -> list[str]:
        """Blank-separated words; special tokens' strings as words after a blank, which no other word starts with."""
        special = self.bpe.split_special
        if special and "<|" in text:
            parts = special.split(text)
            return [w for i, x in enumerate(parts) for w in ([f" {x}"] if i % 2 else self._words_of(x))]
        return self._words_of(text)

    def _words_of(self, text: str) -> list[str]:
        # str.split() also parts at U+001C to U+001F, which are not white space to the tokenizer.
        return [x for x in self.bpe.spaces.split(text) if x] if _SEPARATORS.search(text) else text.split()

    def _learn(self, words: set[str]) -> None:
        """Makes self.new know words."""
        missing = words.difference(self.new)
        if len(self.new) + len(missing) > self.kept // 2:
            self.old, self.new, missing = self.new, {}, words
        old, new, bpe = self.old, self.new, self.bpe
        new.update((w, old[w]) for w in missing if w in old)
        found = [w for w in missing if w not in old]
        split = [[] if w[0] == " " else bpe.pieces(w) for w in found]
        pieces = list({x for parts in split for x in parts})
        known = dict(zip(pieces, bpe.encode_words(pieces), strict=True))
        for w, parts in zip(found, split, strict=True):
            ids = [i for x in parts for i in known[x]] if w[0] != " " else [bpe.special[w[1:]]]
            new[w] = (" ".join(map(str, ids)), " ".join([bpe.tokens[i] for i in ids]))
        self.long = [w for w in found if len(w) > LONG]

    def coded(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, the decimal ids joined by one space, the decoded text."""
        for a, b in blocks([len(x) for x in texts]):
            split = [self._words(x) for x in texts[a:b]]
            self._learn({w for words in split for w in words})
            new = self.new
            for words in split:
                items = [new[w] for w in words]
                ids = " ".join([x[0] for x in items])
                yield ids.count(" ") + 1 if ids else 0, ids, " ".join([x[1] for x in items])
            for w in self.long:
                del new[w]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row: ids as decimals joined by one space, decoded as text.

    path: a tokenizer file that the driver and all executors can read (an installed package's file).
    """
    return _coded(docs, path, lambda ids: ids, "ids", "decoded")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode_decode() with its two texts hashed where they are made."""
    return _coded(docs, path, lambda x: hashlib.sha256(x.encode("utf-8", "replace")).hexdigest(), "ids_sha256", "decoded_sha256")


def _coded(docs: DataFrame, path: str, made, ids: str, decoded: str) -> DataFrame:
    held: list[Coder] = []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held or held.append(Coder(path))
        rows = [(n, made(a), made(b)) for n, a, b in held[0].coded(texts_of(batch.column(1)))]
        columns = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_tokens", ids, decoded])

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, f"doc_id long, n_tokens long, {ids} string, {decoded} string")
