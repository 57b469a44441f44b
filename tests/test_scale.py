"""Exactness under skew, and plan shapes that must hold on large tables."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cataloom.functions import attributes as A
from cataloom.operators import evaluate as ev
from cataloom.operators import joins as jo
from cataloom.operators import ranking as rk
from cataloom.operators import sampling as sa
from cataloom.operators import search as se
from cataloom.operators import taxonomy as ta
from cataloom.plans import load_all
from cataloom.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_bucketed_rank_with_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("product_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"))
    out = rk.shuffled_rank(df, ["g"], 7, ["product_id"], "r", "n").toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["r"]) == list(range(1, len(part) + 1)) and set(part["n"]) == {len(part)}


def test_bucketed_rank_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "product_id long, g string")
    assert rk.shuffled_rank(df, ["g"], 1, ["product_id"], "r").count() == 3


@pytest.mark.parametrize("n,accuracy", [(1, 100_000), (7, 100_000), (1000, 100_000), (20011, 100_000), (20011, 100), (50000, 1000)])
def test_order_statistics_exact(spark, n, accuracy):
    """With a coarse sketch only the bracketed values are ordered, and the answer stays exact."""
    rng = np.random.default_rng(n)
    v = np.round(rng.gamma(2, 50, n), 2)
    v[: n // 3] = 12.5  # one value holds a third of the rows
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    targets = {"p50": (0.5, F.floor(F.col("n") / 2)), "p99": (0.99, F.floor(F.col("n") * 0.99)), "lo": (0.0, F.lit(0)), "hi": (1.0, F.col("n") - 1)}
    row = rk.order_statistics(df, "v", targets, accuracy=accuracy).first()
    s = np.sort(v)
    assert (row["n"], row["p50"], row["p99"], row["lo"], row["hi"]) == (n, s[n // 2], s[int(n * 0.99)], s[0], s[-1])
    p = rk.interpolated_percentiles(df, "v", {"p5": 0.05, "p95": 0.95}, accuracy=accuracy).first()
    assert p["p5"] == pytest.approx(np.percentile(v, 5)) and p["p95"] == pytest.approx(np.percentile(v, 95))


def test_order_statistics_by_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(5000) < 0.4, "hot", "cold"), "v": rng.random(5000)})
    out = rk.order_statistics(spark.createDataFrame(pdf), "v", {"m": (0.5, F.floor(F.col("n") / 2))}, ["g"], accuracy=100).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert out.loc[g, "m"] == np.sort(part["v"].to_numpy())[len(part) // 2]


def test_average_ranks_match_pandas(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=4000), 1)
    v[:1500] = 0.3
    counts = spark.createDataFrame(pd.DataFrame({"v": v})).groupBy("v").agg(F.count("*").alias("n"))
    out = ev.average_ranks(counts, "v").toPandas().set_index("v")["avg_rank"]
    want = pd.Series(v).rank()
    assert np.allclose(out.reindex(v).to_numpy(), want.to_numpy())


def test_failure_streaks_cross_chunks(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.5, 0, rng.integers(1, 5, 4000)), "i": np.arange(4000), "bad": rng.random(4000) < 0.85})
    out = rk.failure_streaks(spark.createDataFrame(pdf), "k", ["i"], "bad", F.floor(F.col("i") / 100), 15).toPandas().set_index("i")
    run = {}
    for _, r in pdf.iterrows():
        run[r.k] = run.get(r.k, 0) + 1 if r.bad else 0
        assert out.loc[r.i, "streak"] == run[r.k] and out.loc[r.i, "flagged"] == (run[r.k] == 15)
        if run[r.k] == 15:
            run[r.k] = 0


def _vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)).astype("float32")
    v[: n // 3] = v[0]  # a group of copies: equal scores, ordered by id
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_vector_topk_paths_match_brute_force(spark):
    cv, qv = _vectors(400, 16, 1), _vectors(30, 16, 2)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cv)], "product_id long, vector array<float>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "query_id long, vector array<float>")
    scores = np.round(qv.astype("float64") @ cv.astype("float64").T, 6)
    want = {(i, int(j)) for i in range(30) for j in np.lexsort((np.arange(400), -scores[i]))[:10]}
    small = {(r.query_id, r.product_id) for r in se.vector_topk(q, c, 10).collect()}
    blocks = {(r.query_id, r.product_id) for r in se.vector_topk(q, c, 10, block_rows=60, block_queries=7).collect()}
    assert small == want and blocks == want


def test_equal_vectors_are_multiplied_once(spark, monkeypatch):
    """300 products of 6 different vectors and 40 queries of 5: the blocks meet 6 and 5 rows, and every query is answered."""
    cv, qv = _vectors(7, 16, 1), _vectors(5, 16, 2)
    c = spark.createDataFrame([(i, cv[i % 7].tolist()) for i in range(300)], "product_id long, vector array<float>").repartition(5)
    q = spark.createDataFrame([(i, qv[i % 5].tolist()) for i in range(40)], "query_id long, vector array<float>")
    scores = np.round(np.stack([qv[i % 5] for i in range(40)]).astype("float64") @ np.stack([cv[i % 7] for i in range(300)]).astype("float64").T, 6)
    want = {(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(300), -scores[i]))[:90]}
    met = []
    inner = se._block_hits
    monkeypatch.setattr(se, "_block_hits", lambda a, b, *rest: (met.append((a.count(), b.count())), inner(a, b, *rest))[1])
    rows = se.vector_topk(q, c, 90, block_rows=3, block_queries=2).collect()
    assert met == [(5, 6)] and len(rows) == 40 * 90
    assert {(r.query_id, r.product_id) for r in rows} == want


def test_ivf_recall(spark):
    cv, qv = _vectors(2000, 16, 3), _vectors(40, 16, 4)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cv)], "product_id long, vector array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "query_id long, vector array<float>")
    exact = {(r.query_id, r.product_id) for r in se.vector_topk(q, c, 10).collect()}
    near = {(r.query_id, r.product_id) for r in se.ivf_topk(q, c, 10, nlist=20, nprobe=8, block_rows=200).collect()}
    every = {(r.query_id, r.product_id) for r in se.ivf_topk(q, c, 10, nlist=20, nprobe=20, block_rows=200).collect()}
    assert every == exact and len(near & exact) / len(exact) > 0.6


def test_keyword_join_matches_substring_search(spark):
    docs = spark.createDataFrame([(0, "Covered in light-gray oak"), (1, "standard TAN table"), (2, "x"), (3, None), (4, "solid woodwork")], "d long, t string")
    vocab = spark.createDataFrame([("tan", "brown"), ("light gray", "gray"), ("red", "red"), ("x", "ex"), ("solid wood", "wood"), ("in", "in")], "keyword string, label string")
    got = {(r.d, r.label) for r in jo.keyword_join(docs, vocab, "d", "t").collect()}
    assert got == {(0, "gray"), (0, "red"), (0, "in"), (1, "brown"), (2, "ex"), (4, "wood")}


def test_balanced_queue_caps(spark):
    df = spark.range(400).select(F.col("id").alias("product_id"), F.when(F.col("id") < 150, "Big|x").when(F.col("id") < 220, "Mid")
                                 .when(F.col("id") < 230, "Few").when(F.col("id") < 232, "Two").alias("product_class"), (F.col("id") % 7).cast("double").alias("attr_score"))
    n = {r.class_clean: (r["n"], r.tier) for r in rk.balanced_queue(df).groupBy("class_clean", "tier").agg(F.count("*").alias("n")).collect()}
    assert n == {"Big": (30, "large"), "Mid": (50, "medium"), "Few": (10, "small"), "Two": (2, "tiny"), "Unknown": (30, "large")}


def test_splits_are_disjoint_and_partition_independent(spark):
    df = spark.range(1000).select(F.col("id").alias("product_id"), (F.col("id") % 3).alias("g"))
    a = {r.product_id: r.split for r in sa.stratified_split(df, ["g"]).collect()}
    b = {r.product_id: r.split for r in sa.stratified_split(df.repartition(13), ["g"]).collect()}
    assert a == b and len(a) == 1000
    assert sa.sample_n(df, 10).count() == 10 and sa.sample_n(df, 5000).count() == 1000


def test_align_predictions_reports_lonely_records(spark):
    p = spark.createDataFrame([(1, "a")], "product_id long, prediction string")
    g = spark.createDataFrame([(1, "a"), (2, "b")], "product_id long, ground_truth string")
    with pytest.raises(Exception, match="one side only"):
        jo.align_predictions(p, g).collect()
    assert jo.align_predictions(p, g, strict=False).count() == 1


def test_extraction_is_one_stage_without_python(spark):
    load_all()
    from cataloom.plans.registry import Tables
    df = A.extract_attributes_v2(A.extract_attributes_v1(Tables(spark, "/root/testdata/sf0.001").v_products).withColumn("taxonomy_full", F.lit("a")).drop(
        "style", "primary_material", "secondary_material"))
    physical = plan_of(df.select("product_id", "color_family", "primary_color", "shape")).split("== Physical Plan ==")[1]
    assert "Exchange" not in physical and "Python" not in physical
    assert "p_retailprice" not in physical and "p_size" not in physical


@pytest.mark.parametrize("name", ["extract_attributes_v2", "parse_model_output", "balanced_queue", "search_metrics",
                                  "route_tiers", "augment_text", "resolve_class", "stratified_split", "keyword_join", "score_correlation"])
def test_no_python_udf_and_no_cartesian(spark, name):
    load_all()
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    physical = plan.split("== Physical Plan ==")[1]
    assert "ArrowEvalPython" not in physical and "BatchEvalPython" not in physical and "InPandas" not in physical
    assert "CartesianProduct" not in physical


@pytest.mark.parametrize("name", ["sort_by_score", "attribute_words", "extract_attributes_v2", "image_query", "tiered_boost", "style_of"])
def test_the_catalog_is_never_sent_through_the_driver(spark, name):
    """Its columns compress so well that the file size of a small catalog would let Spark broadcast all names."""
    load_all()
    assert "Broadcast" not in plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]


def test_hits_meet_products_by_sort_and_merge(spark):
    load_all()
    logical = plan_of(QUERIES["staged_search_vector"](spark, "/root/testdata/sf0.001")).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert len(re.findall(r"Join LeftOuter, \(product_id#\d+L = product_id#\d+L\), rightHint=\(strategy=merge\)", logical)) == 2  # texts, attributes


def test_chosen_keys_meet_the_features_where_they_lie(spark):
    """The side that is broadcast holds the chosen keys, not the features of all products."""
    load_all()
    logical = plan_of(QUERIES["coverage_by_class"](spark, "/root/testdata/sf0.001")).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert re.search(r"Join Inner, \(k#\d+ = key#\d+\), rightHint=\(strategy=broadcast\)", logical)


@pytest.mark.parametrize("name", ["bm25_search", "staged_search"])
def test_documents_are_scored_where_they_lie(spark, name):
    """Blocks of documents meet blocks of query weights in a map over batches; no Python per row, no product of rows."""
    load_all()
    physical = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
    assert "MapInPandas" in physical and "EvalPython" not in physical and "CartesianProduct" not in physical


def test_topk_uses_limit_before_shuffle(spark):
    load_all()
    for name in ("topk_per_query", "balanced_queue", "bm25_search"):
        assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_by_id_filter_reaches_scan(spark):
    load_all()
    plan = plan_of(QUERIES["by_id"](spark, "/root/testdata/sf0.001"))
    assert "EqualTo(p_partkey,42)" in plan
    from cataloom.operators.filters import by_id
    with pytest.raises(Exception, match="not found"):
        by_id(spark.range(3).withColumnRenamed("id", "product_id"), 99).collect()


def test_value_bound_once_in_lambdas(spark):
    """The text expression must not be pushed into the per-keyword lambda."""
    df = spark.createDataFrame([("Red Oak",)], "t string").select(F.lower("t").alias("x"))
    from cataloom import lexicon as lx
    from cataloom.functions.keywords import keyword_vote
    physical = plan_of(df.select(keyword_vote(F.col("x"), lx.COLOR_KEYWORDS))).split("== Physical Plan ==")[1]
    assert physical.count("lower(t") == 1


def test_upholstered_material_logic(spark):
    df = spark.createDataFrame([("Velvet Sofa", "Sofas", "framematerial:Solid Wood"), ("Desk", "Desks", "material:Metal | topmaterial:Glass"),
                                ("Leather Recliner", "Recliners", "framematerial:Steel"), ("Thing", None, None)], "n string, c string, f string")
    from cataloom.functions.features import parse_features_multi
    out = [tuple(r.m) if r.m else None for r in df.select(A.materials_smart(parse_features_multi(F.col("f")), F.col("n"), F.col("c"), F.lit("")).alias("m")).collect()]
    assert out[0] == ("leather", "wood") or out[0] == ("velvet", "wood")
    assert out[1] == ("metal", "glass") and out[2] == ("leather", "metal")


def test_encoded_texts_are_unit_vectors_and_rank_their_own_text_first(spark):
    df = spark.createDataFrame([(0, "red oak table"), (1, "blue steel chair"), (2, "green velvet sofa bed"), (3, "")], "product_id long, text string")
    vectors, model = se.encode_corpus(df, "text", dim=512)
    rows = {r.product_id: np.array(r.vector) for r in vectors.collect()}
    assert all(len(v) == 512 for v in rows.values()) and not rows[3].any()
    assert all(np.linalg.norm(rows[i]) == pytest.approx(1.0, abs=1e-5) for i in range(3))
    queries, _ = se.encode_corpus(df.filter("product_id < 3").withColumnRenamed("product_id", "query_id"), "text", dim=512, fitted=model)
    assert {(r.query_id, r.product_id) for r in se.vector_topk(queries, vectors, 1).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_bm25_gives_repeated_queries_the_same_answer(spark):
    docs = spark.createDataFrame([(0, "red oak oak"), (1, "red steel"), (2, "blue"), (3, ""), (4, "green")], "product_id long, text string")  # df(red) = N/2 would give idf 0
    queries = spark.createDataFrame([(7, "Red oak"), (8, "red  Oak"), (9, "red oak"), (10, "none")], "query_id long, query string")
    out = se.bm25_search(se.bm25_index(docs, "product_id", "text"), queries, 5).collect()
    by_query = {q: [(r.product_id, r.score) for r in sorted(out, key=lambda r: r.rnk) if r.query_id == q] for q in (7, 8, 9, 10)}
    assert by_query[7] == by_query[8] == by_query[9] and [p for p, _ in by_query[7]] == [0, 1] and by_query[10] == []


def test_bm25_shuffles_no_query_document_rows(spark):
    docs = spark.createDataFrame([(i, f"oak table number{i} {'velvet ' * (i % 4)}") for i in range(300)], "product_id long, text string").repartition(6)
    queries = spark.createDataFrame([(i, f"oak velvet number{i}") for i in range(40)], "query_id long, query string")
    index = se.bm25_index(docs, "product_id", "text")
    out = se.bm25_search(index, queries, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("Exchange hashpartitioning(")[1:] if "_rep" in x.split(")")[0] and "product_id" in x.split(")")[0]]
    blocks = se.bm25_search(index, queries, 3, block_weights=15)  # many blocks of queries, the same answer
    key = lambda df: sorted((r.query_id, r.product_id, r.score, r.rnk) for r in df.collect())
    assert key(out) == key(blocks) and len(key(out)) == 120


def test_shared_folder(spark, monkeypatch):
    """The session's folder is used; without one, a cluster is refused and a single machine gets a temporary one."""
    from cataloom import session

    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = f"file:{path}"

    class Session:
        class conf:
            named = None

            @classmethod
            def get(cls, key, default):
                return cls.named or default
        sparkContext = Context()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert session.shared_dir(Session).startswith("file:") and session.shared_dir(Session) == session.shared_dir(Session)
    Session.conf.named = "hdfs://store/shared/"
    assert session.shared_dir(Session) == "hdfs://store/shared"


def test_views_keep_every_row(spark):
    """Row counts of the views, worked out from the tables alone."""
    from cataloom.plans.registry import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    parts, pages = t.part.count(), t.pages.count()
    assert t.v_products.count() == parts and t.v_named.count() == parts and t.v_pairs.count() == parts and t.v_answers.count() == parts
    assert t.v_heads.count() == 6 * parts and t.v_candidates.count() == 2 * pages and t.v_calls.count() == t.events.count()
    shipped = t.lineitem.selectExpr("l_suppkey", "l_partkey + CAST(l_linenumber = 1 AS INT) AS p").distinct().count()
    assert t.v_results.count() == shipped and t.v_labels.count() == t.lineitem.select("l_suppkey", "l_partkey").distinct().count()
    assert t.v_heads._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_vocabulary_of_one_shared_prefix(spark):
    """Ranges of values, not prefixes: the index is right however many ranges there are."""
    from cataloom.operators.taxonomy import build_vocab
    df = spark.range(500).selectExpr("array('Furniture', concat('Furniture ', lpad(id % 90, 3, '0'))) AS taxonomy", "concat('c', id % 7) AS product_class", "concat('s', id % 3) AS style")
    one, many = (sorted(map(tuple, build_vocab(df, ["style"], bucket_rows=n).collect())) for n in (50_000, 4))
    assert one == many
    paths = [r for r in one if r[0] == "level_2"]
    assert [r[3] for r in paths] == list(range(1, 91)) and sum(r[2] for r in paths) == 500


def test_encoding_sends_only_the_kinds_it_asks_for(spark):
    """Classes and paths of the vocabulary, one for nearly every product here, are no part of the join that encodes."""
    df = spark.range(3000).selectExpr("id AS product_id", "IF(id % 2 = 0, 'modern', 'rare') AS style", "array('Furniture', concat('path ', id)) AS taxonomy")
    vocab = spark.createDataFrame([("style", "modern", 3), ("level_1", "Furniture", 1), *(("product_class", f"class {i}", i) for i in range(3000)),
                                   *(("path", f"Furniture / path {i}", i) for i in range(3000))], "kind string, value string, idx int")
    out = ta.encode_labels(df, vocab, ["style"], levels=2)
    got = {(r.kind, r.idx): r.n for r in out.groupBy("kind", "idx").agg(F.count("*").alias("n")).collect()}
    assert got == {("style", 3): 1500, ("style", 0): 1500, ("level_1", 1): 3000, ("level_2", 0): 3000}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"kind#\d+ IN \(style,level_1,level_2\)", plan)


def test_vocab_drift_numbers_no_values(spark, monkeypatch):
    """Which values occur is all it asks: nothing is ranked, so no table of ranges is sent to every task."""
    from cataloom.operators import taxonomy
    from cataloom.plans import load_all
    from cataloom.plans.registry import QUERIES
    load_all()
    monkeypatch.setattr(taxonomy, "bucketed_rank", lambda *a, **k: pytest.fail("values are numbered"))
    rows = QUERIES["vocab_drift"](spark, "/root/testdata/sf0.001").collect()
    assert {r.kind for r in rows} <= {"style", "primary_color"} and {r.only_in for r in rows} <= {"default", "data"} and rows
