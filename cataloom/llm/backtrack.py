"""Exact byte-level BPE by backtracking over longest matches, and decoding by an offset table.

Two neighbouring tokens are compatible if the merges of their joined bytes never cross the border between
them; a sequence of tokens is the merged form of a word exactly if all neighbours are compatible. An
Aho-Corasick automaton over the reversed tokens gives the longest token that starts at every byte of a word
in one pass. The encoder takes the longest token, falls back to shorter prefixes of it, and steps back where
none is compatible with its left neighbour; ends that failed are marked and never entered again, so the
time is linear in the word for tokens of bounded length. Nothing is ever merged.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import ByteBpe, byte_chars
from .common import by_size
from .tokens import vocabulary

BYTE = -1  # rank of a token that no merge makes


class PairCompatibility:
    """Whether two tokens may stand side by side; answers are kept in a table of at most `entries` pairs.

    `rank[t]` is the rank of the merge that makes token t, `left[t]` and `right[t]` its two parts.
    """

    def __init__(self, merges: list[tuple[int, int, int]], entries: int = 250_000):
        size = max((max(m) for m in merges), default=0) + 1
        self.size = size
        self.merge = {a * size + b: n for n, (a, b, _) in enumerate(merges)}
        self.rank, self.left, self.right = [BYTE] * size, [BYTE] * size, [BYTE] * size
        for n, (a, b, t) in enumerate(merges):
            if self.rank[t] != BYTE:
                raise ValueError("a token that two merges make is not handled")
            self.rank[t], self.left[t], self.right[t] = n, a, b
        self.entries = entries
        self.table: dict[int, bool] = {}

    def ask(self, a: int, b: int) -> bool:
        pair = a * self.size + b
        known = self.table.get(pair)
        if known is None:
            if len(self.table) >= self.entries:
                self.table.clear()
            known = self.table[pair] = self.border_holds(a, b, len(self.merge))
        return known

    def border_holds(self, a: int, b: int, before: int) -> bool:
        """Undo the later of the two tokens' merges again and again; the parts at the border at any moment must not
        have a merge that would have come `before` the one just undone. Equal ranks go from left to right, so the
        border's merge yields to one on its left and wins over one on its right."""
        merge, rank, size = self.merge, self.rank, self.size
        while True:
            if merge.get(a * size + b, before) < before:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                before, a = ra, self.right[a]
            elif rb != BYTE:
                before, b = rb + 1, self.left[b]
            else:
                return True


class Backtracker:
    """Ids of a word's bytes. Tokens that merging can never give (their own bytes merge otherwise) are left out."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]]):
        import ahocorasick
        self.pairs = PairCompatibility(merges)
        made = {t for *_, t in merges}
        whole = {w: t for w, t in vocab.items() if t not in made and len(w) == 1}
        text = {t: w for w, t in vocab.items()}
        good = set(whole.values())
        for n, (a, b, t) in enumerate(merges):
            if a in good and b in good and self.pairs.border_holds(a, b, n):
                good.add(t)
                whole[text[t]] = t
        self.whole = whole
        self.length = {t: len(w) for w, t in whole.items()}
        self.shorter = {t: next((whole[w[:k]] for k in range(len(w) - 1, 0, -1) if w[:k] in whole), None) for w, t in whole.items()}
        self.matches = ahocorasick.Automaton()
        for w, t in whole.items():
            self.matches.add_word(w[::-1].decode("latin-1"), t)
        self.matches.make_automaton()

    def longest(self, word: bytes) -> list[int]:
        """The longest token that starts at each byte: the longest reversed token that ends there in the reversed word."""
        found = [-1] * len(word)
        last = len(word) - 1
        for end, token in self.matches.iter(word[::-1].decode("latin-1")):  # longest first at every end
            if found[last - end] < 0:
                found[last - end] = token
        return found

    def encode(self, word: bytes) -> tuple[int, ...]:
        token = self.whole.get(word)
        if token is not None:
            return (token,)
        size, longest, ask, length, shorter = len(word), self.longest(word), self.pairs.ask, self.length, self.shorter
        open_ = bytearray(b"\1") * (size + 1)  # ends from which the rest may still be encoded
        out: list[int] = []
        at = 0
        token = longest[0] if size else None
        while at < size:
            end = at + length[token]
            if open_[end] and (not out or ask(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else None
                continue
            token = shorter[token]
            while token is None:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return tuple(out)


class BacktrackBpe(ByteBpe):
    """Word boundaries, special strings and distinct words of a batch as in `ByteBpe`; the words themselves
    are encoded by backtracking. At most `remember` words of up to 64 bytes are kept for later batches."""

    def __init__(self, path: str, remember: int = 150_000):
        super().__init__(path, remember)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, byte = model["vocab"], byte_chars()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        spelled = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
        self.backtracker = Backtracker(spelled, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self._known: dict[bytes, tuple[int, ...]] = {}

    def _merged(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, known, encode = data.tobytes(), self._known, self.backtracker.encode
        if len(known) > self._remember:
            known.clear()
        out = []
        for b, s in zip(begin.tolist(), size.tolist()):
            word = raw[b:b + s]
            ids = known.get(word)
            if ids is None:
                ids = encode(word)
                if s <= 64:
                    known[word] = ids
            out.append(ids)
        count = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(count.sum())), np.cumsum(count) - count, count


class OffsetTable:
    """The bytes of all tokens one after the other and where each begins; ids without a token have no bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_chars()
        spelled = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
        spelled |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        parts = [spelled.get(i, b"") for i in range(max(spelled) + 2)]  # the last place stands for unknown ids
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of the id sequences ids[bounds[i]:bounds[i + 1]]; bytes that are not UTF-8 become replacement characters."""
        ids = np.where((ids < 0) | (ids >= len(self.offset) - 1), len(self.offset) - 2, ids)
        begin, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        edge = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.arange(edge[-1]) + np.repeat(begin - edge[:-1], size)].tobytes()
        at = edge[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


_LOADED: dict[tuple[type, str], BacktrackBpe | OffsetTable] = {}


def _loaded(kind: type, path: str):
    """An encoder or table, made once per Python worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", at_once: int = 1_000_000) -> DataFrame:
    """Token ids of every text: (id, ids array<int>), one row per input row, in one narrow pass.

    Whole texts are encoded as the vocabulary's library does without added special tokens, truncation or
    padding; a special string inside a text is one token. A null or empty text has no ids, a null id stays null,
    repeated rows are encoded each, other columns are left aside and an empty table gives an empty result.
    Memory follows `at_once` bytes of text or the longest text, not the partition.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in by_size(pc.binary_length(batch.column(1)), at_once):
                part = batch.slice(at, rows)
                found = _loaded(BacktrackBpe, path).encode(part.column(1).to_pylist())
                edge = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
                ids = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edge, ids)], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", at_once: int = 250_000) -> DataFrame:
    """Texts of id sequences: (id, ids, text), special tokens spelled out, in one narrow pass.

    Null sequences and null ids inside one count as absent ids; ids that the vocabulary does not have are skipped. Memory
    follows `at_once` ids or the longest sequence.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in by_size(batch.column(1).value_lengths(), at_once):
                part = batch.slice(at, rows)
                lists = part.column(1)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = _loaded(OffsetTable, path).decode(ids, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")
