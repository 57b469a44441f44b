"""Sources, sinks, streams, learning and the extension surface."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cataloom import lexicon as lx
from cataloom.functions.attributes import extract_attributes_v1
from cataloom.operators import evaluate as ev
from cataloom.operators import extend as ex
from cataloom.operators import learn as le
from cataloom.operators import routing as ro
from cataloom.sources import readers as rd
from cataloom.sources import writers as wr
from cataloom.streaming import streams as st


def test_tsv_with_quotes_tabs_newlines(spark, tmp_path):
    rows = [(1, "a\tb", 'say "hi"', "x / y", "line1\nline2", " "), (2, None, "", None, None, "Color:Red")]
    df = spark.createDataFrame(rows, rd.CATALOG)
    wr.write_tsv(df, str(tmp_path / "c"))
    rows[1] = (2, None, None, None, None, "Color:Red")  # an empty field reads as missing
    assert sorted(map(tuple, rd.read_catalog(spark, str(tmp_path / "c")).collect())) == sorted(rows)


def test_jsonl_policies(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"model": "a", "input_tokens": 1}\n\n{"model": "b"\n{"model": "c", "input_tokens": 2}\n')
    path = str(tmp_path / "f.jsonl")
    assert rd.read_jsonl(spark, path, rd.CALL_LOG, on_bad="skip").agg(F.sum("input_tokens")).first()[0] == 3
    with pytest.raises(Exception):
        rd.read_jsonl(spark, path, rd.CALL_LOG).agg(F.sum("input_tokens")).collect()


def test_manifest_and_queue(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"7": {"image_count": 2, "status": "success"}, "8": {"image_count": 0, "status": "no_results"}}, indent=2))
    assert {r.product_id: r.image_count for r in rd.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {"7": 2, "8": 0}
    (tmp_path / "q.json").write_text(json.dumps([{"product_id": "1", "taxonomy": ["a", "b"], "attr_score": 2.5}, {"product_id": "2"}]))
    assert [r.taxonomy for r in rd.read_queue(spark, str(tmp_path / "q.json")).orderBy("product_id").collect()] == [["a", "b"], None]


def test_images_validated(spark, tmp_path):
    for name, head, size in [("a.jpg", b"\xff\xd8\xff", 4000), ("b.png", b"\x89PNG\r\n\x1a\n", 4000), ("c.jpg", b"\xff\xd8\xff", 100), ("d.jpg", b"html", 4000), ("e.webp", b"RIFF", 4000)]:
        (tmp_path / name).write_bytes(head + b"0" * (size - len(head)))
    got = {r.path.rsplit("/", 1)[1] for r in rd.read_images_validated(spark, str(tmp_path / "*")).collect()}
    assert got == {"a.jpg", "b.png", "e.webp"}


def test_missing_vectors_are_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, embedding array<float>")
    assert rd.fill_missing_vectors(df, "embedding", 2).orderBy("id").collect()[1].embedding == [0.0, 0.0]


def _files(spark, tmp_path, batches, schema):
    """One parquet file per batch, with modification times in batch order."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        seen = set(folder.glob("*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
    return str(folder)


def test_streak_state_survives_batches(spark, tmp_path):
    batches = [[(1, i, True) for i in range(b * 4, b * 4 + 4)] for b in range(5)]
    folder = _files(spark, tmp_path, batches, "k long, i long, bad boolean")
    stream = spark.readStream.schema("k long, i long, bad boolean").option("maxFilesPerTrigger", 1).parquet(folder)
    alerts = st.drain(st.streak_alerts(stream, "k", "i", "bad", 15), "t").collect()
    assert len(alerts) == 1 and alerts[0].streak == 15


def test_enrich_stream_matches_batch_and_drops_repeats(spark, tmp_path):
    schema = "product_id long, product_name string, product_class string, product_description string, ts timestamp"
    import datetime as dt
    row = lambda i, m: (i, f"Modern oak desk {i}", "Desks", "Some assembly required", dt.datetime(2024, 1, 1, 0, m))
    folder = _files(spark, tmp_path, [[row(1, 0), row(2, 1)], [row(1, 2), row(3, 3)]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = st.drain(st.enrich_stream(stream, "ts").select("product_id", "style", "primary_material", "assembly_required"), "e")
    batch = extract_attributes_v1(spark.createDataFrame([row(1, 0), row(2, 1), row(3, 3)], schema)).select(
        "product_id", "style", "primary_material", "assembly_required")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_late_calls_are_dropped(spark, tmp_path):
    import datetime as dt
    schema = "ts timestamp, model string, input_tokens int, output_tokens int, latency_ms double, success boolean"
    row = lambda h, m=0: (dt.datetime(2024, 1, 1, h, m), "gpt-4o", 1000, 1000, 5.0, True)
    folder = _files(spark, tmp_path, [[row(1), row(1, 30)], [row(6)], [row(6, 10)], [row(1, 45), row(9)]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = {r.window.start.hour: (r.calls, r.cost) for r in st.drain(st.call_log_stream(stream, "ts"), "c").collect()}
    assert out[1] == (2, pytest.approx(0.04)) and out[6][0] == 2 and 9 not in out


def test_python_extractor_isolates_errors(spark):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(20)], "product_id long, product_name string")

    def extract(model, row):
        if row["product_id"] == 3:
            raise ValueError("bad")
        return {"style": model, "assembly_required": True}
    out = {r.product_id: r for r in ex.run_extraction(df, ex.PythonExtractor("m", lambda: "modern", extract)).collect()}
    assert out[3].prediction is None and "ValueError: bad" in out[3].error
    assert out[4].prediction.style == "modern" and out[4].prediction.assembly_required == "True" and out[4].latency_ms is not None


def test_models_beat_majority_and_feed_routing(spark):
    rows = [(i, f"{'steel loft' if i % 3 else 'oak barn'} table {i % 5}", "industrial" if i % 3 else "farmhouse", ["F", "T" if i % 2 else "C"] if i % 4 else ["F"]) for i in range(200)]
    df = spark.createDataFrame(rows, "product_id long, text_input string, style string, taxonomy array<string>")
    models = le.train_attribute_models(df, ["style"], dim=64, iterations=10)
    pred = le.predict_with_confidence(df, models).join(df.select("product_id", "style"), "product_id")
    acc = pred.agg(F.avg((F.col("val") == F.col("style")).cast("double"))).first()[0]
    assert acc > 0.9
    assert pred.filter("confidence < 0 OR confidence > 1 OR val NOT IN ('industrial', 'farmhouse')").count() == 0
    levels = le.train_taxonomy_models(df, 2, dim=64, iterations=5)
    cls = le.train_class_model(df.withColumn("product_class", F.col("style")), levels, iterations=5)
    long = le.predict_with_confidence(df, cls)
    assert {r.field for r in long.select("field").distinct().collect()} == {"level_1", "level_2", "product_class"}
    assert ro.fields_to_route(long).count() == 200


def test_f1_literals(spark):
    df = spark.createDataFrame([("modern", "modern"), ("rustic", "modern"), ("rustic", "rustic")], "gt_style string, pred_style string")
    r = ev.attribute_f1(df, ["style"]).first()
    assert (r.precision, r.recall, r.f1, r.support) == (0.6667, 0.6667, 0.6667, 3)
    one = spark.createDataFrame([("Modern ", "modern"), (None, "x")], "gt_style string, pred_style string")
    r = ev.attribute_f1(one, ["style"]).first()
    assert (r.f1, r.support) == (1.0, 1)
    rooms = spark.createDataFrame([(["living room", "office"], ["living room", "bedroom"])], "gt_room_type array<string>, pred_room_type array<string>")
    r = ev.attribute_f1(rooms, ["room_type"]).first()
    assert (r.precision, r.recall) == (0.5, 0.5)
    assert ev.exact_match(df.filter("1 = 0"), ["style"]).first().exact_match_rate == 0.0
    f1 = spark.createDataFrame([("a", 0.8), ("b", 0.4)], "attribute string, f1 double")
    assert ev.weighted_f1(f1, {"a": 2.0}).first().weighted_f1 == 0.6667


def test_empty_cost_log(spark):
    from cataloom.operators.upkeep import cost_summary
    r = cost_summary(spark.createDataFrame([], rd.CALL_LOG)).first()
    assert (r.total_calls, r.total_cost_usd, r.success_rate) == (0, 0.0, 0.0)
    assert lx.CATALOG_SIZE == 40_000_000
