"""Token ids against the library, packing as an exact round trip."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cataloom.llm.bpe import ByteBpe
from cataloom.llm.packing import best_pattern, pack, whole_patterns
from cataloom.llm.tokens import count_tokens, vocabulary

PIECES = ["the ", "'s", "'re", "'ll ", "''", " \n", "  ", "\t", "é", "漢字", "😀", "\x1c", "\x85", "1२", "!?", "<|endoftext|>", "aaaaaaa", "DON'T", " don't", "​", "ß"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def texts(n: int, seed: int = 3) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(n)] + ["", "a" * 20_000, " " * 3_000, "'" * 77, "<|endoftext|>" * 3]


def test_ids_are_the_library_s(library):
    bpe, cases = ByteBpe(vocabulary(), remember=50), texts(600)
    want = [library.encode(t, add_special_tokens=False).ids for t in cases]
    for at_once in (200, 100_000):
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(cases, at_once)] == want
        assert bpe.count(cases, at_once) == [len(w) for w in want]
    assert bpe.encode([]) == [] and bpe.encode([None]) == [b""]


def test_counts(spark, library):
    cases = texts(50) + [None]
    rows = [(None if i == 7 else i % 40, t, "clash") for i, t in enumerate(cases)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _ in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert count_tokens(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(2)
    for sizes in (np.array([3, 5, 16]), np.array([1]), np.arange(1, 33)):
        demand = rng.integers(1, 400, len(sizes))
        used = np.zeros(len(sizes), int)
        for times, held in whole_patterns(sizes, demand, 32):
            assert sum(sizes[i] * n for i, n in held.items()) <= 32
            for i, n in held.items():
                used[i] += times * n
        assert (used == demand).all()
    assert (best_pattern(np.array([2, 3]), np.array([1.0, 1.6]), 7) == [2, 1]).all()


def test_packing_round_trip(spark, library):
    docs = [(i, t) for i, t in enumerate(texts(300))] + [(1000, None), (1001, "word " * 9_000), (1001, "word " * 9_000), (None, "x")]
    rows = pack(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, length int")).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    want = defaultdict(list)
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            part = ids[at:at + 2048]
            want[doc].append((at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
