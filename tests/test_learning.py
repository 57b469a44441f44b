"""Heads trained together against separate fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.operators import learn as le


def rows(spark, n=900, seed=3):
    r = random.Random(seed)
    words = ["oak", "steel", "velvet", "sofa", "desk", "lamp", "modern", "rustic", "big", "small", "with", "the"]
    out = []
    for i in range(n):
        w = r.choices(words, k=r.randint(2, 9))
        style = "modern" if "modern" in w and r.random() < 0.9 else "rustic" if "rustic" in w else "glam"
        kind = next((x for x in ("sofa", "desk", "lamp") if x in w), None)
        out.append((i, " ".join(w), style, kind, "yes" if ("oak" in w) != (r.random() < 0.1) else "no"))
    return spark.createDataFrame(out, "product_id long, text_input string, style string, kind string, wood string").repartition(6)


def test_heads_agree_with_separate_fits(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    df = rows(spark)
    fields = ["style", "kind", "wood"]
    models = le.train_attribute_models(df, fields, dim=64, iterations=60)
    mine = {(r.product_id, r.field): (r.val, r.confidence) for r in le.predict_with_confidence(df, models).collect()}
    at, x = models.features.columns()
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: F.coalesce(F.get(F.col("_x"), (F.array_position("_at", d) - 1).cast("int")), F.lit(0.0)))
    ready = df.withColumns({"_at": at, "_x": x}).withColumn("features", array_to_vector(F.when(F.size("_at") >= 0, dense))).cache()
    for f in fields:
        fit = Pipeline(stages=[StringIndexer(inputCol=f, outputCol="y", stringOrderType="alphabetAsc"),
                               LogisticRegression(labelCol="y", family="multinomial", maxIter=200, tol=1e-9, regParam=0.01)]).fit(ready.where(F.col(f).isNotNull()))
        out = fit.stages[-1].transform(ready).select("product_id", vector_to_array("probability").alias("p")).collect()
        assert models.heads[f].labels == list(fit.stages[0].labels)
        apart = [abs(max(r.p) - mine[r.product_id, f][1]) for r in out]
        agree = [fit.stages[0].labels[int(np.argmax(r.p))] == mine[r.product_id, f][0] for r in out]
        assert max(apart) < 0.02 and np.mean(agree) > 0.995


def test_one_pass_a_round_for_all_heads(spark, monkeypatch):
    passes = []
    plain = le._losses
    monkeypatch.setattr(le, "_losses", lambda *a: passes.append(len(a[1])) or plain(*a))
    le.train_attribute_models(rows(spark, 200), ["style", "kind", "wood"], dim=32, iterations=7)
    assert passes == [3] * len(passes) and 1 < len(passes) <= 7


def test_sums_in_two_levels_are_the_sums(spark):
    df = rows(spark, 400).repartition(40)
    wide = le.fit_heads(le._sparse(df, f := le.text_features(df, "text_input", 32)), {"style": F.col("style")}, 32, 5)
    few = le.fit_heads(le._sparse(df.coalesce(1), f), {"style": F.col("style")}, 32, 5)
    assert np.allclose(wide["style"].weights, few["style"].weights, atol=1e-8)

    def ones(batches):
        yield le._emit(2, np.array([[float(sum(b.num_rows for b in batches)), 1.0]]))
    parts = spark.range(0, 5_000, 1, 40).mapInArrow(ones, "head int, label int, part int, v array<double>")
    assert {(r.head, r.label): list(r.v) for r in le._summed(parts, 40).collect()} == {(2, 0): [5_000.0, 40.0]}


def test_missing_labels_and_texts(spark):
    df = rows(spark, 300).withColumn("none", F.lit(None).cast("string")).withColumn("one", F.lit("always"))
    models = le.train_attribute_models(df, ["none", "one", "kind"], dim=32, iterations=10)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "sofa"), (None, "sofa")], "product_id smallint, text_input string")
    out = le.predict_with_confidence(odd, models).collect()
    assert len(out) == 12 and {(r.val, r.confidence, r.needs_vlm) for r in out if r.field == "none"} == {(None, 0.0, True)}
    assert {(r.val, round(r.confidence, 9)) for r in out if r.field == "one"} == {("always", 1.0)}
    assert {r.val for r in out if r.field == "kind" and r.product_id is None} == {"sofa"}
    assert le.predict_with_confidence(odd.limit(0), models).count() == 0


def test_class_model_uses_the_levels(spark):
    df = rows(spark).withColumns({"taxonomy": F.array("kind", "style"), "product_class": F.concat_ws("-", "kind", "style")})
    levels = le.train_taxonomy_models(df, 2, dim=64, iterations=30)
    model = le.train_class_model(df, levels, iterations=40)
    head = model.heads["product_class"]
    assert head.inputs == ("level_1", "level_2") and head.weights.shape[0] == 64 + 3 + 3 + 1 and np.abs(head.weights[64:-1]).max() > 0.1
    out = le.predict_with_confidence(df, model).where("field = 'product_class'").join(df, "product_id")
    assert out.agg(F.avg((F.col("val") == F.col("product_class")).cast("int"))).first()[0] > 0.8  # a tenth of the styles is noise
    assert out.agg(F.min("i")).first()[0] == 2


@pytest.mark.parametrize("text, places", [(None, 0), ("", 0), ("Oak oak, OAK", 1), ("a b a c", 3)])
def test_word_places(values, text, places):
    found = values(lambda c: le.word_places(c, 1_000_003), [text])[0]
    assert len(found) == places and sum(e.n for e in found) == len([w for w in (text or "").replace(",", " ").split()])


def test_equal_rows_are_learned_from_once_over_all_cores(spark, monkeypatch):
    """Copies of rows weigh as much as before, but the passes read distinct rows, in more than one task."""
    texts = [("oak chair", "modern"), ("steel lamp", "rustic"), ("velvet sofa", "glam"), ("oak sofa", None), ("steel chair", "modern"), (None, "glam")]
    rows = [(t, s, i % 3) for i, (t, s) in enumerate(texts) for _ in range(1 + 7 * i)]
    df = spark.createDataFrame(rows, "text_input string, style string, product_class int").coalesce(1).withColumn("product_class", F.concat(F.lit("c"), "product_class"))
    features = le.text_features(df, "text_input", 32)
    plain = le.fit_heads(le._sparse(df, features), {"style": F.col("style")}, 32, 5)["style"]
    seen = []
    losses = le._losses
    monkeypatch.setattr(le, "_losses", lambda r, w, parts: seen.append((r.count(), r.rdd.getNumPartitions())) or losses(r, w, parts))
    models = le.train_attribute_models(df, ["style"], dim=32, iterations=5, features=features)
    assert models.heads["style"].labels == plain.labels and np.allclose(models.heads["style"].weights, plain.weights, atol=1e-9)
    assert {n for n, _ in seen} == {len(texts)} and min(p for _, p in seen) > 1
    seen.clear()
    le.train_class_model(df, models, iterations=2)
    assert {n for n, _ in seen} == {len(texts)}
