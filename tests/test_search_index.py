"""Stored search structures: postings with block bounds, vector cells."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from cataloom.operators import postings as po
from cataloom.operators import search as se


def key(df):
    return sorted((r.query_id, r.product_id, r.score, r.rnk) for r in df.collect())


def corpus(spark, n=1_500, seed=1):
    r = random.Random(seed)
    words = ["oak", "table", "red", "velvet", "the", "of"] + [f"w{i}" for i in range(80)]
    weight = [20, 10, 5, 2, 200, 100] + [1] * 80
    rows = [(i, " ".join(r.choices(words, weight, k=r.choice([0, 3, 8, 40, 120])))) for i in range(n)] + [(n, None)]
    return spark.createDataFrame(rows, "product_id long, text string").repartition(7)


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_postings_answer_as_the_full_scan_and_skip_blocks(spark):
    docs = corpus(spark)
    queries = asked(spark, ["oak table", "velvet", "Red  OAK", "the of the", "w3 w7 velvet oak", "nothing here", "", None, "oak table"] + [f"w{i} velvet" for i in range(40)])
    scan = se.bm25_search(se.bm25_index(docs, "product_id", "text"), queries, 5)
    for size in (32, 128):
        index = po.postings_index(docs, "product_id", "text", block_docs=size)
        assert key(po.postings_search(index, queries, 5)) == key(scan)
    index = po.postings_index(docs, "product_id", "text", block_docs=32)
    _, _, weights = po.query_weights(index, queries, "query_id", "query", 0.25)
    plan = po.block_plan(index, weights, 5)
    opened, closed = (plan.where(F.col("opened") == o).count() for o in (True, False))
    assert closed > 0.3 * (opened + closed) and opened > 0
    # what is opened is a part of the asked terms' postings, which are a part of all
    lists = index["postings"]
    read = plan.where("opened").join(weights, "_rep").join(lists, ["term", "block"]).count()
    held = weights.join(lists, "term").count()
    assert read < 0.8 * held


def test_scores_are_added_up_where_the_postings_meet(spark):
    index = po.postings_index(corpus(spark), "product_id", "text", block_docs=32)
    _, _, weights = po.query_weights(index, asked(spark, ["the of oak", "w3 the", "red of"]), "query_id", "query", 0.25)
    blocks = index["postings"].select("block").distinct().crossJoin(weights.select("_rep").distinct())
    scores = po._scored(blocks, weights, index["postings"])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)", plan)
    assert dealt and not any("pos#" in d for d in dealt), plan  # no row of a document and a query is shuffled
    plain = weights.join(index["postings"], "term").select("_rep", "_w", F.explode("parts").alias("p")).groupBy("_rep", "p.pos").agg(
        F.first("p.doc").alias("doc"), F.round(F.sum(F.col("_w") * F.col("p.part")), 6).alias("score"))
    rows = lambda df: sorted(map(tuple, df.select("_rep", "pos", "doc", "score").collect()))
    assert rows(scores) == rows(plain)


def test_a_frequent_term_is_many_bounded_rows_in_order_of_their_parts(spark):
    docs = spark.createDataFrame([(i, "the " * (1 + i % 50) + f"n{i}") for i in range(2_000)], "product_id long, text string")
    rows = po.postings_index(docs, "product_id", "text", block_docs=64)["postings"].where("term = 'the'").collect()
    assert sum(len(r.parts) for r in rows) == 2_000 and max(len(r.parts) for r in rows) <= 64 and len(rows) >= 32
    for r in rows:
        parts = [p.part for p in r.parts]
        assert parts == sorted(parts, reverse=True) and r.bound == parts[0]


def test_fifty_thousand_distinct_queries(spark):
    docs = spark.createDataFrame([(i, f"a{i % 997} b{i % 89} oak") for i in range(3_000)], "product_id long, text string")
    queries = spark.range(50_000).select(F.col("id").alias("query_id"), F.format_string("a%s b%s q%s", F.col("id") % 997, F.col("id") % 89, F.col("id")).alias("query"))
    index = po.postings_index(docs, "product_id", "text")
    out = po.postings_search(index, queries, 1)
    assert out.count() == 50_000 and out.where("product_id % 997 <> query_id % 997 AND product_id % 89 <> query_id % 89").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


def test_full_scan_holds_one_small_matrix_at_a_time(spark):
    import pandas as pd
    weights = pd.DataFrame({"_rep": np.repeat(np.arange(20_000), 3), "term": [f"t{i}" for i in range(60_000)], "_w": 1.0})
    groups = se._query_groups(weights, 1_000_000)
    assert sum(len(g[0]) for g in groups) == 20_000 and max(len(g[0]) * len(g[1]) for g in groups) <= 1_000_000
    docs, queries = corpus(spark, 300), asked(spark, [f"w{i} oak" for i in range(60)])
    index = se.bm25_index(docs, "product_id", "text")
    whole = key(se.bm25_search(index, queries, 3))
    plain = se._bm25_scorer.__defaults__
    se._bm25_scorer.__defaults__ = (256, 40)  # many groups of queries
    try:
        assert key(se.bm25_search(index, queries, 3)) == whole
    finally:
        se._bm25_scorer.__defaults__ = plain


def test_postings_of_nothing(spark):
    none = spark.createDataFrame([], "product_id long, text string")
    assert po.postings_search(po.postings_index(none, "product_id", "text"), asked(spark, ["oak"]), 3).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "product_id long, text string")
    assert po.postings_search(po.postings_index(empty, "product_id", "text"), asked(spark, ["oak"]), 3).count() == 0
    one = po.postings_index(corpus(spark, 50), "product_id", "text")
    assert po.postings_search(one, spark.createDataFrame([], "query_id long, query string"), 3).count() == 0


def vectors(n, seed, groups=40, d=16):
    r = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(groups, d)) * 2
    v = middle[r.integers(0, groups, n)] + r.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")


def test_cells_are_stored_pruned_and_found_again(spark):
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(4_000, 1))], "product_id long, vector array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(60, 2))], "query_id long, vector array<float>")
    index = se.ivf_index(c)
    assert len(index.centres) == 63 and index.corpus(spark).count() == 4_000
    exact = {(r.query_id, r.product_id) for r in se.vector_topk(q, c, 10).collect()}
    probes = se.probes_for(index, q.where("query_id < 20"), c, 10, recall=0.97)
    assert probes < 32
    near = se.ivf_search(index, q, 10, probes)
    assert len({(r.query_id, r.product_id) for r in near.collect()} & exact) >= 0.9 * len(exact)
    assert se.probes_for(index, q, c, 10, recall=1.0) >= probes
    one = se.ivf_search(index, q.limit(1), 10, 2)
    plan = one._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan)
    one.collect()
    read = [int(line.split("number of partitions read: ")[1].split()[0]) for line in plan.splitlines() if "number of partitions read: " in line]
    assert all(n <= 2 for n in read)


def test_a_hot_cell_is_many_files(spark, tmp_path):
    import os
    c = spark.createDataFrame([(i, [1.0, 0.0] if i % 10 else [float(i % 7), 1.0]) for i in range(3_000)], "product_id long, vector array<float>")
    index = se.ivf_index(c, nlist=3, file_rows=500)
    folder = index.path.removeprefix("file:")
    files = {d: len([f for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")]) for d in os.listdir(folder) if d.startswith("cell=")}
    assert max(files.values()) >= 4 and index.corpus(spark).count() == 3_000


def test_a_large_vocabulary_meets_few_texts(spark):
    from cataloom.operators import joins as jo
    r = random.Random(5)
    syllables = ["ta", "ro", "men", "li", "kor", "a", "es", "ti", "on", "ve", "sha", "u", "bri", "x", "yn"]
    words = {"".join(r.choices(syllables, k=r.randint(1, 5))) for _ in range(300_000)}
    words = [*sorted(words)[:99_000], *{f"{a} {b}" for a, b in zip(sorted(words)[::90], sorted(words)[7::90])}][:100_000]
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 12))) + r.choice(["", " Solid-OAK", "!"])) for i in range(150)] + [(150, None)]
    vocab = spark.createDataFrame([(w, f"l{i % 7}") for i, w in enumerate(words)], "keyword string, label string")
    docs = spark.createDataFrame(texts, "d long, t string").repartition(4)
    plain = docs.selectExpr("d AS _row", "regexp_replace(lower(t), '[^a-z0-9]+', ' ') AS _t").cache()
    tested = jo.keyword_candidates(plain, vocab.selectExpr("keyword AS kw"), 5).count()
    want, hits = {}, 0
    for d, t in texts:
        low = re.sub("[^a-z0-9]+", " ", (t or "").lower())
        for i, w in enumerate(words):
            if w in low:
                hits += 1
                want.setdefault((d, f"l{i % 7}"), []).append(w)
    assert len(words) > 90_000 and hits < tested < 4 * hits
    out = jo.keyword_join(docs, vocab, "d", "t")
    assert {(x.d, x.label): (x.keyword, x.n_keywords) for x in out.collect()} == {k: (min(v, key=lambda w: (-len(w), w)), len(v)) for k, v in want.items()}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 8
