"""Bucketed prediction cache."""

import uuid

from pyspark.sql import functions as F

from cataloom.operators import cache as ca
from cataloom.operators.extend import PythonExtractor

KIND = "struct<style: string>"


def open_cache(spark, path, name=None, buckets=4):
    return ca.PredictionCache(spark, name or f"c_{uuid.uuid4().hex}", str(path), KIND, buckets)


def made(spark, ids, style="modern", error=None):
    return spark.createDataFrame([(i, (style,), 1.0, "m", error) for i in ids], f"product_id long, prediction {KIND}, latency_ms double, model string, error string")


def test_neither_side_is_exchanged(spark, tmp_path):
    cache = open_cache(spark, tmp_path / "c")
    cache.append(made(spark, range(0, 300, 2)))
    cache.append(made(spark, range(300, 400, 2)))
    name = f"p_{uuid.uuid4().hex}"
    ca.bucketed_table(spark, name, str(tmp_path / "p"), "product_id long, t string", "product_id", 4)
    ca.append_bucketed(spark.range(500).selectExpr("id AS product_id", "'x' AS t"), name, "product_id", 4)
    alike = cache.missing(spark.table(name))
    plan = alike._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert alike.count() == 500 - 200
    other = cache.missing(spark.range(500).withColumnRenamed("id", "product_id"))
    plan = other._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == plan.count("Exchange") == 1 and other.count() == 300  # the catalog alone
    latest = cache.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in latest


def test_the_last_write_counts_and_survives_the_table(spark, tmp_path):
    cache = open_cache(spark, tmp_path / "c")
    assert cache.rows().count() == 0 and cache.missing(made(spark, [1])).count() == 1
    cache.append(made(spark, [1, 2, 3]))
    cache.append(made(spark, [2], "rustic"))
    cache.append(made(spark, [4], error="broken"))
    cache.append(made(spark, [None]))
    assert {r.product_id: r.prediction.style for r in cache.rows().collect()} == {1: "modern", 2: "rustic", 3: "modern"}
    assert {r.product_id for r in cache.hits(made(spark, [2, 2, 3, 9])).collect()} == {2, 3}
    again = open_cache(spark, tmp_path / "c", f"later_{uuid.uuid4().hex}")  # as a later session does
    assert {r.product_id: r.prediction.style for r in again.rows().collect()}[2] == "rustic"
    again.append(made(spark, [5]))
    assert again.missing(made(spark, [1, 5, 6, None])).count() == 2
    again.clear()
    assert again.rows().count() == 0


def test_products_are_extracted_once_and_failed_ones_again(spark, tmp_path):
    def extract(_model, row):
        if row["product_id"] == 3:
            raise ValueError("no")
        return {"style": "modern"}
    fields = "struct<" + ", ".join(f"{a}: string" for a in ca_fields()) + ">"
    cache = ca.PredictionCache(spark, f"c_{uuid.uuid4().hex}", str(tmp_path / "c"), fields, 4)
    extractor = PythonExtractor("m", lambda: None, extract)
    some = spark.range(10).withColumnRenamed("id", "product_id")
    first = ca.cached_extraction(some, extractor, cache)
    second = ca.cached_extraction(spark.range(12).withColumnRenamed("id", "product_id"), extractor, cache)
    assert first.where("cached").count() == 0 and first.where("error IS NOT NULL").count() == 1
    rows = {r.product_id: r for r in second.collect()}
    assert len(rows) == 12 and {i for i, r in rows.items() if not r.cached} == {3, 10, 11}
    assert second.where(F.col("prediction.style") == "modern").count() == 11


def ca_fields():
    from cataloom import lexicon as lx
    return lx.SCHEMA1
