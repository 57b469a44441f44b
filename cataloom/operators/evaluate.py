"""Evaluation of extracted attributes, searches and model scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import let, strip
from ..functions.vectors import ndcg
from ..session import written
from .ranking import interpolated_percentiles, topk_per_key


def _values(df: DataFrame, c: str) -> Column:
    """A value or a list as a list of lower-cased, trimmed strings (null stays null)."""
    if dict(df.dtypes)[c].startswith("array"):
        return F.transform(F.col(c), lambda v: F.lower(strip(v)))
    return F.when(F.col(c).isNotNull(), F.array(F.lower(strip(F.col(c).cast("string")))))


def long_pairs(pairs: DataFrame, attributes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per record and attribute with a truth: lists `gt` and `pred` (columns gt_*, pred_*)."""
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("attribute"), _values(pairs, f"gt_{a}").alias("gt"),
                               _values(pairs, f"pred_{a}").alias("pred")) for i, a in enumerate(attributes)])
    return pairs.select(*keep, F.explode(items).alias("_e")).select(*keep, "_e.*").filter(F.col("gt").isNotNull())


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def attribute_f1(pairs: DataFrame, attributes: Sequence[str] = lx.EVAL_ATTRIBUTES, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per attribute (and per slice `by`).

    A wrong single value counts as false positive and false negative, as one-element sets do.
    """
    pred = F.coalesce("pred", F.array().cast("array<string>"))
    counts = long_pairs(pairs, attributes, by).groupBy(*by, "attribute").agg(
        F.sum(F.size(F.array_intersect("gt", pred))).alias("tp"),
        F.sum(F.size(F.array_except(pred, "gt"))).alias("fp"),
        F.sum(F.size(F.array_except("gt", pred))).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"_p": p, "_r": r}).select(
        *by, "attribute", F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"),
        F.round(_ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), 4).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"))


def exact_match(pairs: DataFrame, attributes: Sequence[str] = lx.EVAL_ATTRIBUTES, by: Sequence[str] = ()) -> DataFrame:
    """Share of records whose every attribute with a truth matches; lists compare sorted."""
    hit = F.lit(True)
    for a in attributes:
        gt, pred = F.array_sort(_values(pairs, f"gt_{a}")), F.array_sort(_values(pairs, f"pred_{a}"))
        hit = hit & (gt.isNull() | F.coalesce(gt == pred, F.lit(False)))
    return pairs.groupBy(*by).agg(F.count("*").alias("num_examples"),
                                  F.coalesce(F.round(F.avg(hit.cast("double")), 4), F.lit(0.0)).alias("exact_match_rate"))


def weighted_f1(f1: DataFrame, weights: dict[str, float] = lx.F1_WEIGHTS, by: Sequence[str] = ()) -> DataFrame:
    """Weighted and plain mean of the per-attribute F1."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    w = F.coalesce(F.try_element_at(table, F.col("attribute")), F.lit(1.0))
    return f1.groupBy(*by).agg(F.round(F.avg("f1"), 4).alias("average_f1"),
                               F.round(F.sum(w * F.col("f1")) / F.sum(w), 4).alias("weighted_f1"))


def evaluate_models(pairs: DataFrame, attributes: Sequence[str] = lx.EVAL_ATTRIBUTES, model: str = "model") -> DataFrame:
    """Comparison table of all models, best mean F1 marked, cost and latency constants attached."""
    f1 = attribute_f1(pairs, attributes, [model])
    wide = f1.groupBy(model).pivot("attribute", list(attributes)).agg(F.first("f1"))
    wide = wide.select(model, *[F.col(a).alias(f"f1_{a}") for a in attributes])
    table = wide.join(weighted_f1(f1, by=[model]), model).join(exact_match(pairs, attributes, [model]), model)
    best = table.agg(F.max_by(model, F.struct("average_f1", model)).alias("_best"))  # one row
    cost = F.create_map(*[x for k, v in lx.COST_PER_1K.items() for x in (F.lit(k), F.lit(float(v)))])
    late = F.create_map(*[x for k, v in lx.LATENCY_MS.items() for x in (F.lit(k), F.lit(float(v)))])
    return table.crossJoin(F.broadcast(best)).select(
        *table.columns, F.try_element_at(cost, F.col(model)).alias("cost_per_1k"),
        F.try_element_at(late, F.col(model)).alias("avg_latency_ms"), (F.col(model) == F.col("_best")).alias("is_best"))


# --- error analysis -------------------------------------------------------------------------
def classify_failures(pairs: DataFrame, attributes: Sequence[str] = lx.EVAL_ATTRIBUTES,
                      keep: Sequence[str] = ("product_id", "product_class")) -> DataFrame:
    """One row per wrong attribute with its failure mode."""
    long = long_pairs(pairs, attributes, keep).withColumns(
        {"gt": F.array_join(F.array_sort("gt"), "|"), "pred": F.array_join(F.array_sort("pred"), "|")})
    wrong = long.filter(F.col("pred").isNull() | (F.col("pred") != F.col("gt")))
    similar = [a + "~" + b for x in lx.SIMILAR_STYLES for a, b in (x, x[::-1])]
    a = F.col("attribute")
    mode = (F.when(F.col("pred").isNull(), "missing_attribute")
            .when((a == "style") & F.concat_ws("~", "pred", "gt").isin(similar), "ambiguous_style")
            .when(a == "primary_material", "multi_material").when(a == "color_family", "color_lighting")
            .when(a == "product_type", "wrong_category").otherwise("granularity_mismatch"))
    return wrong.select(*keep, "pos", "attribute", F.col("pred").alias("predicted"), F.col("gt").alias("ground_truth"),
                        mode.alias("failure_mode"))


def error_report(errors: DataFrame, key: str = "product_id") -> DataFrame:
    """Sections of the report in one table (section, attribute, item, n, rnk)."""
    def section(name: str, df: DataFrame, attribute: Column, item: Column, rnk: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), attribute.alias("attribute"), item.alias("item"),
                         F.col("n").cast("long").alias("n"), rnk.cast("int").alias("rnk"))
    none = F.lit(None).cast("string")
    pair = F.concat_ws(" -> ", "ground_truth", F.coalesce("predicted", F.lit("None")))

    def entry(name: str, attribute: Column, item: Column) -> Column:
        return F.struct(F.lit(name).alias("section"), attribute.alias("attribute"), item.alias("item"))
    # all counts in one pass over the errors; what is left is small and stored
    entries = F.array(entry("by_attribute", F.col("attribute"), none), entry("by_mode", none, F.col("failure_mode")),
                      entry("confusion", F.col("attribute"), pair), entry("hardest_class", none, F.col("product_class")))
    counts = written(errors.select(F.explode(entries).alias("e")).groupBy("e.section", "e.attribute", "e.item").agg(F.count("*").alias("n")), "error-counts")
    by_attr = counts.filter(F.col("section") == "by_attribute")
    by_mode = counts.filter(F.col("section") == "by_mode").withColumnRenamed("item", "failure_mode")
    confusions = topk_per_key(counts.filter(F.col("section") == "confusion").withColumnRenamed("item", "pair"),
                              ["attribute"], [F.col("n").desc(), F.col("pair").asc()], 5)
    per_class = counts.filter((F.col("section") == "hardest_class") & (F.col("item") != "")).withColumnRenamed("item", "product_class")
    hardest = per_class.orderBy(F.col("n").desc(), "product_class").limit(10)
    first = errors.orderBy(key, "pos").limit(20).withColumn("n", F.col(key))
    parts = [section("by_attribute", by_attr, F.col("attribute"), none, F.lit(0)),
             section("by_mode", by_mode, none, F.col("failure_mode"), F.lit(0)),
             section("confusion", confusions, F.col("attribute"), F.col("pair"), F.col("rnk")),
             section("hardest_class", hardest, none, F.col("product_class"), F.lit(0)),
             section("sample", first, F.col("attribute"), F.col("failure_mode"), F.lit(0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def worst_examples(errors: DataFrame, n: int = 20, key: str = "product_id") -> DataFrame:
    return errors.groupBy(key).agg(F.count("*").alias("num_errors")).orderBy(F.col("num_errors").desc(), key).limit(n)


# --- search ---------------------------------------------------------------------------------------
def judge_results(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Relevance of each hit; unjudged hits count 0."""
    rel = F.try_element_at(F.create_map(*[x for k, v in lx.RELEVANCE.items() for x in (F.lit(k), F.lit(v))]), F.col("label"))
    judged = labels.select("query_id", "product_id", rel.alias("_rel"))
    return results.join(judged, ["query_id", "product_id"], "left").withColumn(
        "relevance", F.coalesce("_rel", F.lit(0))).drop("_rel")


def query_metrics(results: DataFrame, labels: DataFrame, ks: Sequence[int] = (5, 10, 20), judged_ideal: bool = False) -> DataFrame:
    """NDCG@k and reciprocal rank of every judged query; queries without hits score 0.

    The ideal order is that of the retrieved list, or with `judged_ideal` that of all judgements of the query,
    which is the standard measure; for that the judgements are counted per relevance, never listed."""
    judged = judge_results(results.filter(F.col("rnk") <= max(ks)), labels)  # at most max(ks) hits per query
    lists = judged.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rnk", "relevance"))), lambda r: r["relevance"]).alias("_rels"),
        F.min(F.when(F.col("relevance") >= 1, F.col("rnk"))).alias("_first"))
    every = labels.select("query_id").distinct().join(lists, "query_id", "left")
    rels = F.coalesce("_rels", F.array().cast("array<int>"))
    ideal = None
    if judged_ideal:
        grades = sorted(set(lx.RELEVANCE.values()), reverse=True)
        names = [name for g in grades for name, v in lx.RELEVANCE.items() if v == g][:len(grades)]
        counts = labels.groupBy("query_id").agg(*[F.count(F.when(F.col("label") == n, 1)).alias(f"_g{lx.RELEVANCE[n]}") for n in names])
        every = every.join(counts, "query_id")
        ideal = F.concat(*[F.array_repeat(F.lit(g), F.least(F.col(f"_g{g}"), F.lit(max(ks))).cast("int")) for g in grades])
    return every.select("query_id", *[ndcg(rels, k, ideal).alias(f"ndcg_{k}") for k in ks],
                        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("rr"))


def search_metrics(results: DataFrame, labels: DataFrame, latencies: DataFrame | None = None,
                   ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """One row: mean NDCG@k, MRR, query count, and latency percentiles when latencies are given."""
    q = query_metrics(results, labels, ks)
    out = q.agg(*[F.round(F.avg(f"ndcg_{k}"), 4).alias(f"ndcg_{k}") for k in ks], F.round(F.avg("rr"), 4).alias("mrr"),
                F.count("*").alias("num_queries"))
    if latencies is None:
        return out
    p = interpolated_percentiles(latencies, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.crossJoin(F.broadcast(p.select(*[F.round(c, 1).alias(f"latency_{c}_ms") for c in ("p50", "p95", "p99")])))


def compare_search(metrics: dict[str, DataFrame], primary: str = "ndcg_10") -> DataFrame:
    """One row per search system, best first."""
    out = None
    for name, m in metrics.items():
        row = m.withColumn("system", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out.orderBy(F.col(primary).desc(), "system")


# --- classifier outputs ------------------------------------------------------------------------------
def level_accuracy(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy over labels >= 0 (columns label, pred)."""
    return pred.filter(F.col("label") >= 0).groupBy(*by).agg(
        F.count("*").alias("n"), F.round(100.0 * F.avg((F.col("label") == F.col("pred")).cast("double")), 4).alias("accuracy"))


def confidence_profile(pred: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Mean, median, counts and shares below 0.5 and 0.8 and above 0.9."""
    c, n = F.col(confidence), F.count("*")
    marks = {"lt_05": c < 0.5, "lt_08": c < 0.8, "gt_09": c > 0.9}
    counts = [F.sum(cond.cast("int")).alias(name) for name, cond in marks.items()]
    shares = [F.round(100.0 * F.sum(cond.cast("int")) / n, 4).alias(f"{name}_pct") for name, cond in marks.items()]
    # confidences repeat, so the median is taken over value counts
    med = interpolated_percentiles(pred.withColumn("_c", c.cast("double")), "_c", {"median": 0.5})
    return pred.agg(F.round(F.avg(c), 6).alias("mean"), *counts, *shares).crossJoin(
        F.broadcast(med.select(F.round("median", 6).alias("median"))))


def class_accuracy(pred: DataFrame, cls: str, top: int = 20, bottom: int = 10) -> DataFrame:
    """Accuracy per class, the best and the worst ones."""
    acc = level_accuracy(pred, [cls])
    best = acc.orderBy(F.col("accuracy").desc(), cls).limit(top).withColumn("side", F.lit("top"))
    worst = acc.orderBy(F.col("accuracy").asc(), F.col(cls).desc()).limit(bottom).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def gate_summary(heads: DataFrame, names: Sequence[str] = ("image", "text")) -> DataFrame:
    """Mean modality weights per head, overall and split by image presence (column gate: array)."""
    means = [F.round(F.avg(F.get("gate", F.lit(i))), 6).alias(n) for i, n in enumerate(names)]
    overall = heads.groupBy("field").agg(*means).withColumn("has_image", F.lit(None).cast("boolean"))
    return overall.unionByName(heads.groupBy("field", "has_image").agg(*means))


# --- score correlation ----------------------------------------------------------------------------------
def average_ranks(counts: DataFrame, value: str, n: str = "n", splits: int = 200, parts: int = 64) -> DataFrame:
    """(value, avg_rank) from value counts; ties share their mean rank.

    Values are cut into order-preserving buckets (sketch quantiles, then even widths), so
    running counts are taken inside small buckets and shifted by the bucket totals.
    """
    per_value = counts.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(
        F.sum(n).alias("_n"))
    q = per_value.agg(F.percentile_approx("_v", [i / splits for i in range(splits + 1)], 2000).alias("_q"))  # one row
    i = let(F.col("_v"), lambda v: F.greatest(F.size(F.filter("_q", lambda x: x <= v)) - 1, F.lit(0)))
    lo, hi = F.get("_q", F.col("_i")), F.get("_q", F.col("_i") + 1)
    sub = F.coalesce(F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(
        F.try_divide(F.col("_v") - lo, hi - lo) * parts).cast("int"))), F.lit(0))
    cut = per_value.crossJoin(F.broadcast(q)).withColumn("_i", i).select("_v", "_n", (F.col("_i") * parts + sub).alias("_b"))
    totals = cut.groupBy("_b").agg(F.sum("_n").alias("_t")).withColumn(  # at most splits x parts rows
        "_before", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_r", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    return inside.join(totals, "_b").select(
        F.col("_v").alias(value), (F.col("_before") + F.col("_r") + (F.col("_n") + 1) / 2).alias("avg_rank"))


def _weighted_corr(x: str, y: str, n: str, name: str) -> list[Column]:
    c = F.col
    return [F.sum(n).alias(f"{name}_n"), *[F.sum(c(n) * e).alias(f"{name}_{k}") for k, e in {
        "x": c(x), "y": c(y), "xx": c(x) * c(x), "yy": c(y) * c(y), "xy": c(x) * c(y)}.items()]]


def _corr_of(name: str) -> Column:
    n, x, y, xx, yy, xy = (F.col(f"{name}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
    return F.round((n * xy - x * y) / (F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y)), 6).alias(name)


def score_correlation(df: DataFrame, score: str, label: str) -> DataFrame:
    """Pearson and Spearman correlation.

    Everything is computed from (score, label) counts: the rows are read once, and ranks
    are joined to distinct values, so equal scores cannot pile up in a join.
    """
    cells = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_l")).agg(F.count("*").alias("n"))
    cells = written(cells, "cells")  # read three times below
    rx = average_ranks(cells, "_s").withColumnRenamed("avg_rank", "_x")
    ry = average_ranks(cells, "_l").withColumnRenamed("avg_rank", "_y")
    ranked = cells.join(rx, "_s").join(ry, "_l")
    return ranked.agg(*_weighted_corr("_s", "_l", "n", "pearson"), *_weighted_corr("_x", "_y", "n", "spearman")).select(
        _corr_of("pearson"), _corr_of("spearman"))
