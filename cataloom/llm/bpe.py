"""Byte-level BPE over batches: vectorised word boundaries and rank-synchronous array merging.

A vocabulary file is read once per Python worker. Texts are cut into pre-tokens with the byte-level
rule (contractions, letters, digits, other signs, white space); the character classes are asked from
the tokenizer library itself, once per code point seen, so that its Unicode version decides.
The distinct pre-tokens of a batch are merged together: one flat symbol array holds them all, each round
replaces every occurrence of each sequence's lowest-rank pair, and sequences without a pair leave.
"""

from __future__ import annotations

import json
import re

import numpy as np

LETTER, NUMBER, OTHER, SPACE, BREAK, UNKNOWN = 0, 1, 2, 3, 4, 255
SEPARATOR = "\ud800"  # a lone surrogate: no UTF-8 text holds it
NO_PAIR = np.int32(2**31 - 1)


def byte_chars() -> dict[str, int]:
    """The byte that each printable stand-in character of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Pair of symbols -> (rank, merged symbol), as an open hash table that is probed by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_PAIR, np.int32)
        self.merged = merged.astype(np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, left_over, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(left_over):
            free = self.keys[at[left_over]] < 0
            take = left_over[free]
            _, first = np.unique(at[take], return_index=True)
            take = take[first]
            self.keys[at[take]] = key[take]
            self.rank[at[take]] = take
            left_over = left_over[self.keys[at[left_over]] != key[left_over]]
            at[left_over] = (at[left_over] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NO_PAIR where the vocabulary has no merge for it."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.rank[at], NO_PAIR)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def merge_words(table: PairTable, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences at once. `symbols` holds them one after the other, `sizes` their lengths
    (each at least 1). Returns the surviving symbols in the same order and the new lengths."""
    number = len(sizes)
    final = np.zeros(number, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    ids = np.arange(number)
    sym = symbols.astype(np.int32)
    size = sizes.astype(np.int64)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(size) - 1] = True
    rank = np.full(len(sym), NO_PAIR, np.int32)
    if len(sym) > 1:
        rank[:-1] = np.where(last[:-1], NO_PAIR, table.ranks(sym[:-1], sym[1:]))
    while len(ids):
        starts = np.cumsum(size) - size
        low = np.minimum.reduceat(rank, starts)
        live = low != NO_PAIR
        if not live.all():
            stay = np.repeat(live, size)
            final[ids[~live]] = size[~live]
            done.append((np.repeat(ids[~live], size[~live]), sym[~stay]))
            sym, rank, last = sym[stay], rank[stay], last[stay]
            ids, size, low = ids[live], size[live], low[live]
            if not len(ids):
                break
        owner = np.repeat(np.arange(len(ids)), size)
        at = np.flatnonzero(rank == low[owner])
        if len(at) > 1 and (at[1:] == at[:-1] + 1).any():  # x x x: every second pair, from the left
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        sym[at] = table.merged[rank[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        size = size - np.bincount(owner[at], minlength=len(ids))
        sym, rank, last = sym[keep], rank[keep], last[keep]
        here = at - np.arange(len(at))
        for p in (here, here[here > 0] - 1):
            p = p[p < len(sym)]
            inner = p[~last[p]]
            rank[p[last[p]]] = NO_PAIR
            rank[inner] = table.ranks(sym[inner], sym[inner + 1])
    if done:
        owner = np.concatenate([d[0] for d in done])
        out = np.concatenate([d[1] for d in done])[np.argsort(owner, kind="stable")]
    else:
        out = sym
    return out, final


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin[i] .. begin[i] + size[i] - 1 of all i, one after the other."""
    return np.arange(size.sum(), dtype=np.int64) + np.repeat(begin - (np.cumsum(size) - size), size)


def _nothing_seen() -> dict[str, np.ndarray]:
    return {"hash": np.zeros(0, np.uint64), "size": np.zeros(0, np.int32), "begin": np.zeros(0, np.int64), "from": np.zeros(0, np.int64),
            "count": np.zeros(0, np.int64), "data": np.zeros(0, np.uint8), "symbols": np.zeros(0, np.int32)}


class ByteBpe:
    """Token ids of whole texts as the tokenizer library gives them (no added special tokens; special
    strings inside a text are one token each). Each distinct word of a batch is merged once; at most `remember` merged words are kept
    for later batches."""

    def __init__(self, path: str, remember: int = 500_000):
        from tokenizers import pre_tokenizers
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        byte = byte_chars()
        self.byte_symbol = np.zeros(256, np.int32)
        for ch, b in byte.items():
            self.byte_symbol[b] = vocab[ch]
        self.table = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]),
                               np.array([vocab[a + b] for a, b in pairs]))
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if spec.get("normalizer") or any(t[k] for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: normalizers and trimming special tokens are not handled")
        self.special = special
        self._special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self._probe = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self._classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._classes[ord(SEPARATOR)] = BREAK
        self._byte_value = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64, endpoint=False)
        self._weights = np.zeros(0, np.uint64)
        self._remember = remember
        self._seen = _nothing_seen()

    def _class_of(self, c: str) -> int:
        return next((k for k, beside in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self._probe(beside + c)) == 1), SPACE)

    def bounds(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Start of every pre-token of texts joined by SEPARATOR, and whether it is a separator."""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self._classes[code]
        if (kind == UNKNOWN).any():
            for c in np.unique(code[kind == UNKNOWN]):
                self._classes[c] = self._class_of(chr(c))
            kind = self._classes[code]
        start = np.ones(len(code), bool)
        before, now = kind[:-1], kind[1:]
        start[1:] = (before != now) & ((code[:-1] != 32) | (now == BREAK)) | (now == BREAK)
        # a space hands itself to the next word; the last character of a longer run of white space stands apart
        space = now == SPACE
        start[1:][space & (before != SPACE)] = True
        middle = (kind[1:-1] == SPACE) & (kind[:-2] == SPACE) & (kind[2:] != SPACE) & (kind[2:] != BREAK)
        start[1:-1][middle] = True
        quote = np.flatnonzero((code == 39) & start)
        if len(quote):
            padded = np.concatenate([code, np.zeros(3, np.uint32)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            for chosen, width in ((quote[short], 2), (quote[long], 3)):
                for k in range(1, width):
                    start[chosen + k] = False
                end = chosen + width
                start[end[end < len(code)]] = True
        at = np.flatnonzero(start)
        return at, kind[at] == BREAK

    def _distinct(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Representative word of each word, the index of each word's representative, and the representatives'
        hashes. Words are told apart by a 64-bit multilinear hash; the bytes are then compared, so that a
        collision only costs time."""
        longest = int(size.max())
        if longest > len(self._weights):
            self._weights = np.random.default_rng(7).integers(0, 2**64, max(64, 2 * longest), np.uint64, endpoint=False) | np.uint64(1)
        inside = np.arange(len(data), dtype=np.int32) - np.repeat(begin, size)
        value = self._byte_value[data]
        value *= self._weights[inside]
        hashed = np.add.reduceat(value, begin)
        del value
        _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        inside += np.repeat(begin[first[which]], size)
        np.minimum(inside, len(data) - 1, out=inside)
        same = (size == size[first[which]]) & np.logical_and.reduceat(data == data[inside], begin)
        if not same.all():
            odd = np.flatnonzero(~same)
            which[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        return first, which, hashed[first]

    def _merged(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of distinct words, and each word's first symbol and number of symbols. Words of earlier
        batches are looked up by hash and compared by their bytes."""
        old = self._seen
        at = np.minimum(np.searchsorted(old["hash"], hashed), max(0, len(old["hash"]) - 1))
        hit = np.zeros(len(size), bool)
        if len(old["hash"]):
            hit = (old["hash"][at] == hashed) & (old["size"][at] == size)
            ours, theirs = _ragged(begin[hit], size[hit]), _ragged(old["begin"][at[hit]], size[hit])
            if hit.any():
                starts = np.cumsum(size[hit]) - size[hit]
                hit[np.flatnonzero(hit)[~np.logical_and.reduceat(data[ours] == old["data"][theirs], starts)]] = False
        miss = np.flatnonzero(~hit)
        raw = data[_ragged(begin[miss], size[miss])]
        symbols, number = merge_words(self.table, self.byte_symbol[raw], size[miss])
        from_, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        from_[miss], count[miss] = len(old["symbols"]) + np.cumsum(number) - number, number
        from_[hit], count[hit] = old["from"][at[hit]], old["count"][at[hit]]
        both = np.concatenate([old["symbols"], symbols])
        if len(old["hash"]) + len(miss) > self._remember:
            old = _nothing_seen()
            kept = np.concatenate([old["symbols"], symbols])
        else:
            kept = both
        new = {"hash": hashed[miss], "size": size[miss], "begin": len(old["data"]) + np.cumsum(size[miss]) - size[miss],
               "from": len(kept) - len(symbols) + np.cumsum(number) - number, "count": number}
        new = {k: np.concatenate([old[k], v]) for k, v in new.items()}
        order = np.argsort(new["hash"])
        self._seen = {k: v[order] for k, v in new.items()} | {"data": np.concatenate([old["data"], raw]), "symbols": kept}
        return both, from_, count

    def _batch(self, texts: list[str], ids: bool) -> list[bytes] | np.ndarray:
        joined = SEPARATOR.join(texts)
        if not joined:
            return [b""] if ids else np.zeros(1, np.int64)
        at, sep = self.bounds(joined)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        begin = at.astype(np.int32)
        if len(data) > len(code):
            width = np.ones(len(code), np.int8)
            for limit in (0x7f, 0x7ff, 0xffff):
                width += code > limit
            begin = (np.cumsum(width, dtype=np.int32) - width)[at]
        del code
        size = np.diff(np.append(begin, np.int32(len(data))))
        first, which, hashed = self._distinct(data, begin, size)
        symbols, from_, merged = self._merged(data, begin[first], size[first], hashed)
        number = np.where(sep, 0, merged[which])
        cuts = np.flatnonzero(sep)
        total = np.concatenate([[0], np.cumsum(number)])
        edges = np.concatenate([[0], total[cuts], total[-1:]])
        if not ids:
            return np.diff(edges)
        out = symbols[_ragged(from_[which], number)].astype("<u4").tobytes()
        return [out[a * 4:b * 4] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def _run(self, texts: list[str | None], ids: bool, at_once: int) -> tuple[list, list[list]]:
        """Results of the pieces between special strings, and how each text is put together from them."""
        pieces: list[str] = []
        plan: list[list[int | bytes]] = []
        for text in texts:
            steps: list[int | bytes] = []
            text = text or ""
            if self._special and (found := list(self._special.finditer(text))):
                edge = 0
                for m in found:
                    steps += [len(pieces), np.array([self.special[m[0]]], "<u4").tobytes()]
                    pieces.append(text[edge:m.start()])
                    edge = m.end()
                text = text[edge:]
            steps.append(len(pieces))
            pieces.append(text)
            plan.append(steps)
        done: list = []
        batch: list[str] = []
        size = 0
        for p in pieces:
            batch.append(p)
            size += len(p) + 1
            if size >= at_once:
                done.extend(self._batch(batch, ids))
                batch, size = [], 0
        if batch:
            done.extend(self._batch(batch, ids))
        return done, plan

    def encode(self, texts: list[str | None], at_once: int = 1_000_000) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; a null text is an empty one. About `at_once`
        characters are worked on together; a longer text is one batch."""
        done, plan = self._run(texts, True, at_once)
        return [done[s[0]] if len(s) == 1 else b"".join(done[x] if isinstance(x, int) else x for x in s) for s in plan]

    def count(self, texts: list[str | None], at_once: int = 1_000_000) -> list[int]:
        """Number of ids of each text."""
        done, plan = self._run(texts, False, at_once)
        return [int(sum(done[x] if isinstance(x, int) else 1 for x in s)) for s in plan]


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The vocabulary of a file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
