"""Backtracking encoder and offset table against the tokenizer library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cataloom.llm.backtrack import BacktrackBpe, Backtracker, OffsetTable, PairCompatibility, decode_ids, encode_texts
from cataloom.llm.tokens import vocabulary

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(vocabulary())
ENCODER, TABLE = BacktrackBpe(vocabulary()), OffsetTable(vocabulary())


def ids_of(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)]


def expected(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def merged(word, merges):
    """Plain merging: the lowest-rank pair, leftmost first."""
    rank = {(a, b): (n, t) for n, (a, b, t) in enumerate(merges)}
    word = list(word)
    while True:
        found = min(((rank[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in rank), default=None)
        if found is None:
            return tuple(word)
        i = found[1]
        word[i:i + 2] = [rank[word[i], word[i + 1]][1]]


def test_random_vocabularies_by_plain_merging():
    draw = random.Random(3)
    for _ in range(60):
        letters = [b"a", b"b", b"c"]
        vocab, merges = {w: i for i, w in enumerate(letters)}, []
        while len(vocab) < 16:
            a, b = draw.choice(list(vocab)), draw.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((vocab[a], vocab[b], vocab[a + b]))
        encoder = Backtracker(vocab, merges)
        for _ in range(200):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 30)))
            assert encoder.encode(word) == merged([vocab[bytes([x])] for x in word], merges)


def test_tokens_that_two_merges_make_are_refused():
    with pytest.raises(ValueError):
        PairCompatibility([(0, 1, 3), (2, 1, 3)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_texts_as_the_library(texts):
    found = ids_of(texts)
    assert found == expected(texts)
    flat = np.array([i for f in found for i in f], np.int64)
    assert TABLE.decode(flat, np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)) == texts


def test_long_words_and_special_strings():
    texts = ["a" * 100_000, " " * 5_000 + "x", "the" * 20_000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", None, "", "Zoë's 日本語🙂\x85 x"]
    assert ids_of(texts) == expected(texts)


def test_decoding_of_any_ids():
    ids = np.random.default_rng(2).integers(0, 50_300, 5_000)
    bounds = np.arange(0, 5_001, 5)
    assert TABLE.decode(ids, bounds) == [LIBRARY.decode(ids[a:a + 5].tolist(), skip_special_tokens=False) for a in bounds[:-1]]


def test_frames_with_odd_rows(spark):
    rows = [(1, "x y", "q"), (1, "x y", "q"), (None, None, None), (2, "", "r"), (3, "le été, 12's", None)]
    docs = spark.createDataFrame(rows, "doc_id smallint, text string, ids string")
    out = decode_ids(encode_texts(docs, at_once=5), at_once=3)
    found = sorted((r.doc_id or 0, list(r.ids), r.text) for r in out.collect())
    assert found == sorted((d or 0, e, t or "") for (d, t, _), e in zip(rows, expected([r[1] for r in rows])))
    assert decode_ids(encode_texts(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [50256, None, 64, 99_999_999])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_ids(odd).collect()} == {1: "", 2: "<|endoftext|>a"}


def test_query_digests(spark):
    from cataloom.llm.queries import QUERIES
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op11_bpe_round_trip"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
