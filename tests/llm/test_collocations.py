"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cataloom.llm.collocations import Bitmap, chunks_of, collocations, dictionary, frequent_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [w for p in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) if (w := re.findall("[^\x20\x09]+", p))]


def plain(rows, least, top=2_000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        kept = []
        cands = [p for p, a in count.items() if len(p) > 1 and a >= least]
        for p in cands:
            a = count[p]
            score, cut = min((2_000_000 * a // (count[p[:c]] + count[p[c:]]), c) for c in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * count[q] >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q in cands):
                kept.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, rows=80):
    r = random.Random(seed)
    words = ["a", "B", "cc", "É", "e-e", "zz\x1c", "日本", "the", "THE", "x'"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "!?", " \r\n "]
    passage = "one two a three four B five, six seven eight cc nine ten"
    out = []
    for _ in range(rows):
        text = "".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 60)))
        out.append((r.choice(["en", "en", "de", None, "und"]), r.choice([text, text, text + passage, passage + " " + text, "", None, "the " * 50])))
    return out


@pytest.mark.parametrize("modulus", [1, 3, 16])
def test_as_plain_counting(spark, modulus):
    rows = corpus(modulus) + corpus(7)[:10] * 3
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "lang string, text string, phrase string, n int").repartition(5)
    found = sorted(tuple(r) for r in collocations(docs, least=5, modulus=modulus).collect())
    assert found == plain(rows, 5) and len(found) > 20
    assert sorted(tuple(r) for r in collocations(docs, least=5, top=3).collect()) == plain(rows, 5, 3)


def test_parse_covers_every_word_once_and_equal_passages_share_chunks(spark):
    passage = " ".join(f"w{i % 37}x{i % 11}" for i in range(300))
    texts = [passage, "some other beginning " + passage + " and an end", passage]
    text, own, tail, chunk = chunks_of(pa.array(texts), 8)
    assert [int(own[text == i].sum()) for i in range(3)] == [len(t.split()) for t in texts]
    words = [c.split(" ") for c in chunk.to_pylist()]
    assert all(len(w) == o + t and t <= 3 for w, o, t in zip(words, own, tail))
    rebuilt = [w for w, o, i in zip(words, own, text) if i == 1 for w in w[:o]]
    assert rebuilt == texts[1].split()
    parsed = dictionary(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), modulus=8).collect()
    assert len(parsed) < len(chunk) / 2 and sum(r.own * r.freq for r in parsed) == sum(len(t.split()) for t in texts)


def test_counts_pass_32_bits_and_bitmap_only_prunes(spark):
    chunks = spark.createDataFrame([("en", 0, "a b c d", 4, 3_000_000_000), ("en", 0, "a b", 2, 2)], "lang string, tail int, chunk string, own long, freq long")
    found = {r.phrase: r.f for r in frequent_phrases(chunks, 3).collect()}
    assert found["a b"] == 3_000_000_002 and found["a b c d"] == found["c d"] == 3_000_000_000
    full = Bitmap(6, np.full(1, 2**64 - 1, np.uint64))
    assert full.holds(np.array([0, 2**64 - 1, 12345], np.uint64)).all()


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", ". , !")], "lang string, text string"), least=1).count() == 0


def test_one_very_long_text_and_a_hot_passage(spark):
    long = "lorem ipsum dolor sit " * 40_000
    rows = [("en", long), ("en", "x y. " * 3_000)] + [("en", "one and the same line of words")] * 400
    found = collocations(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, 30)
