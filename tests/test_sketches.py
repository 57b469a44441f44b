"""Daily sketches: errors, ranges of days, repeated and single days."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.operators import sketches as sk

DAY = dt.date(2024, 3, 1)


def log(spark, days=5, rows=4_000):
    r = np.random.default_rng(4)
    out = [(DAY + dt.timedelta(int(d)), dt.datetime.combine(DAY + dt.timedelta(int(d)), dt.time(int(h))), "hot" if h % 3 else "cold", float(v), int(u))
           for d, h, v, u in zip(r.integers(0, days, rows), r.integers(0, 24, rows), r.lognormal(3, 1, rows).round(1), r.integers(0, 900, rows))]
    return spark.createDataFrame(out, "day date, ts timestamp, model string, ms double, user long")


def merged(spark, path, *span):
    rows = sk.merge_days(sk.stored_days(spark, path, *span), ["model"]).select(
        "model", "n", sk.quantile(0.5).alias("p50"), sk.quantile(0.99).alias("p99"), sk.members().alias("users")).collect()
    return {r.model: r for r in rows}


def counts(found):
    return {m: (r.n, r.users) for m, r in found.items()}  # quantile sketches sample by chance, within their error


def test_any_range_of_days_within_the_stated_errors(spark, tmp_path):
    calls, path = log(spark), str(tmp_path / "s")
    sk.store_days(calls, path, "ts", ["model"], "ms", "user")
    rows = calls.toPandas()
    for span in ((None, None), (DAY, DAY), (DAY + dt.timedelta(1), DAY + dt.timedelta(3))):
        mine = rows if span[0] is None else rows[(rows.day >= span[0]) & (rows.day <= span[1])]
        for model, r in merged(spark, path, *span).items():
            part = mine[mine.model == model]
            assert r.n == len(part) and abs(r.users - part.user.nunique()) <= sk.distinct_error() * part.user.nunique() + 0.5
            for q, v in ((0.5, r.p50), (0.99, r.p99)):
                assert (part.ms < v).mean() <= q + sk.rank_error() and (part.ms <= v).mean() >= q - sk.rank_error()


def test_a_new_day_reads_one_day_only(spark, tmp_path):
    calls, path, source = log(spark), str(tmp_path / "s"), str(tmp_path / "log")
    calls.write.partitionBy("day").parquet(source)
    first = [DAY + dt.timedelta(i) for i in range(4)]
    stored = spark.read.parquet(source)
    sk.store_days(stored, path, "ts", ["model"], "ms", "user", first)
    assert {r.day for r in sk.stored_days(spark, path).select("day").collect()} == set(first)
    for d in first:  # whoever opened a folder of these days would fail
        for f in (tmp_path / "log" / f"day={d}").glob("*.parquet"):
            f.write_bytes(b"not parquet")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        stored.agg(F.sum("ms")).collect()
    fresh = sk.rows_of_days(stored, "ts", [DAY + dt.timedelta(4)])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(ts" in plan
    sk.store_days(stored, path, "ts", ["model"], "ms", "user", [DAY + dt.timedelta(4)])
    whole = str(tmp_path / "whole")
    sk.store_days(calls, whole, "ts", ["model"], "ms", "user")
    assert counts(merged(spark, path)) == counts(merged(spark, whole))


def test_a_day_stored_again_replaces_itself_alone(spark, tmp_path):
    calls, path = log(spark), str(tmp_path / "s")
    sk.store_days(calls, path, "ts", ["model"], "ms", "user")
    before = counts(merged(spark, path))
    sk.store_days(calls, path, "ts", ["model"], "ms", "user", [DAY])
    assert counts(merged(spark, path)) == before


def test_members_that_come_back(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(dt.datetime(2024, 3, 1 + d), "m", 1.0, u) for d in range(2) for u in range(d * 500, d * 500 + 2_000)] + [(dt.datetime(2024, 3, 1), "m", None, None), (None, "m", 1.0, 7)]
    sk.store_days(spark.createDataFrame(rows, "ts timestamp, model string, ms double, user long"), path, "ts", ["model"], "ms", "user")
    a, b = (sk.merge_days(sk.stored_days(spark, path, d, d), ["model"]).select("model", F.col("theta").alias(n)) for n, d in (("a", DAY), ("b", DAY + dt.timedelta(1))))
    assert a.join(b, "model").select(sk.shared_members("a", "b")).first()[0] == 1_500
    assert merged(spark, path)["m"].n == 4_001


def test_a_hot_key_is_combined_in_its_tasks(spark):
    plan = sk.sketch_days(log(spark, 2, 200), "ts", ["model"], "ms", "user")._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll" in plan and "partial_hll" in plan and "partial_theta" in plan
