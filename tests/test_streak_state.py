"""Streaks in event time: order, late rows, idle keys, restarts."""

import datetime as dt

from pyspark.sql import functions as F

from cataloom.streaming import streams as st

SCHEMA = "k long, i long, bad boolean, ts timestamp"
DAY = dt.datetime(2024, 1, 1)


def row(k, i, minutes, bad=True):
    return (k, i, bad, DAY + dt.timedelta(minutes=minutes))


def alerts(spark, batches, n=3, **how):
    steps = [spark.createDataFrame(b, SCHEMA) for b in batches]
    out = st.drain_steps(spark, steps, lambda s: st.timed_streak_alerts(s, "k", "i", "bad", "ts", n, **how), "test")
    return sorted((r.k, r.i, r.streak) for r in out.collect())


def test_order_of_arrival_does_not_matter_and_late_rows_are_ignored(spark):
    flush = [row(9, 0, 600, False)]
    inside = [[row(1, 3, 12), row(1, 1, 2), row(2, 1, 5, False)], [row(1, 2, 7), row(2, 2, 6), row(1, 4, 15, False)], [row(2, 4, 18), row(2, 3, 17)], flush]
    assert alerts(spark, inside, bucket="20 minutes") == [(1, 3, 3), (2, 4, 3)]
    late = [[row(1, 1, 2), row(1, 3, 70)], [row(5, 0, 200, False)], [row(1, 2, 50), row(1, 4, 195)], [row(9, 0, 900, False)]]
    # the row of minute 50 comes when the watermark stands at 190 and is left out; the others make the streak
    assert alerts(spark, late, bucket="20 minutes") == [(1, 4, 3)]


def test_streaks_cross_buckets_batches_and_restarts(spark):
    batches = [[row(1, b * 10 + j, b * 100 + j * 10) for j in range(10)] for b in range(5)] + [[row(2, 0, 2_000, False)]]
    assert alerts(spark, batches, n=15) == [(1, 14, 15), (1, 29, 15), (1, 44, 15)]


def test_idle_keys_start_again_and_hold_no_state(spark, monkeypatch):
    folders = []
    plain = st.fresh_path
    monkeypatch.setattr(st, "fresh_path", lambda *a: folders.append(plain(*a)) or folders[-1])
    batches = [[row(1, 1, 0), row(1, 2, 1), row(2, 1, 1)], [row(2, 2, 300)], [row(1, 3, 600), row(2, 3, 601)], [row(3, 1, 5_000, False)]]
    # key 1 is idle for ten hours, key 2 never for more than six
    assert alerts(spark, batches, idle="6 hours") == [(2, 3, 3)]
    log = next(f for f in folders if "-log-" in f)
    with st.state_store(spark):
        kept = spark.read.format("statestore").option("stateVarName", "run").load(log)
        rows = [r.k for r in kept.select(F.col("key.k").alias("k")).collect()]
    assert 1 not in rows and 2 not in rows


def test_state_provider_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with st.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before
