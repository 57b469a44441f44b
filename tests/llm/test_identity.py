"""Rows with null or repeated ids are told by their texts."""

import random

import xxhash

import corpus_pipeline
from cataloom.llm.lines import dedup_lines
from cataloom.llm.substrings import remove_repeats

FOLDER = "/root/testdata/sf0.001"


def colliding(make):
    """Two texts of which the hashes agree in the low 32 bits."""
    seen = {}
    for i in range(1_000_000):
        low = xxhash.xxh64_intdigest(make(i), 42) & 0xFFFFFFFF
        if low in seen:
            return make(seen[low]), make(i)
        seen[low] = i
    raise AssertionError("no collision")


def test_texts_of_colliding_half_hashes_are_two_documents(spark):
    a, b = colliding(lambda i: f"same words on this line of both {'x' * 90}\nown{i} line{i * 7}")
    rows = dedup_lines(spark.createDataFrame([(None, a), (None, b)], "doc_id bigint, text string")).collect()
    assert sorted(r.n_removed for r in rows) == [0, 1]
    assert {line for r in rows for line in r.text.split("\n")} == set(a.split("\n")) | set(b.split("\n"))
    rnd = random.Random(3)
    shared = "".join(rnd.choice("abcdefghij klmnop") for _ in range(150))
    a, b = colliding(lambda i: f"{i} own words {shared}")
    rows = remove_repeats(spark.createDataFrame([(None, a), (None, b)], "doc_id bigint, text string")).collect()
    assert len(rows) == 2 and sum(len(r.kept) for r in rows) < len(a) + len(b) - 100


def test_stages_go_by_rows(spark):
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(900)]
    one, two, three = (" ".join(rnd.choices(words, k=80)) for _ in range(3))
    rows = [(None, one), (None, one), (None, one + " more"), (5, two), (5, two), (5, three), (None, two), (None, " ".join(rnd.choices(words, k=80)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, source string").repartition(3)
    got = corpus_pipeline.simhash_dedup(spark, docs, FOLDER).collect()
    assert len(got) == 4 and sorted(r.text for r in got if r.doc_id == 5) == sorted([two, three])
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, "Before it. " + item), (None, one), (7, "Before it. " + item), (7, two)], "doc_id bigint, text string")
    got = corpus_pipeline.decontaminate(spark, docs, FOLDER).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.where(f"text IN ('{one}', '{two}')").collect()))
