"""Operational reports: costs, latencies, image manifests, split cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..session import written
from .joins import price_calls
from .ranking import order_statistics


def split_card(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("has_image"), 1)).alias("with_images"),
                                   F.count(F.when(~F.col("has_image"), 1)).alias("text_only"))



def cost_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, successes, cost, tokens, mean latency, cost per 1k calls and success rate; zeros for an empty log."""
    n = F.count("*")
    total = F.coalesce(F.sum("cost"), F.lit(0.0))
    return price_calls(log).groupBy(*(by or [])).agg(
        n.alias("total_calls"), F.count(F.when(F.col("success"), 1)).alias("successful_calls"),
        F.round(total, 4).alias("total_cost_usd"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"),
        F.round(total / F.greatest(n, F.lit(1)) * 1000, 2).alias("cost_per_1k"),
        F.round(F.count(F.when(F.col("success"), 1)) / F.greatest(n, F.lit(1)), 4).alias("success_rate"))


def catalog_cost(costs: DataFrame, cost_per_1k: str = "cost_per_1k", size: int = lx.CATALOG_SIZE) -> DataFrame:
    """Cost of the full catalog and a verdict."""
    total = F.coalesce(F.col(cost_per_1k), F.lit(0.0)) * (size / 1000.0)
    return costs.withColumn("full_cost", F.round(total, 2)).withColumn(
        "feasible", F.when(total < 50_000, "Yes").when(total < 500_000, "Expensive").otherwise("No"))


def latency_report(preds: DataFrame) -> DataFrame:
    """Processed, cached and error counts, p50/p99 as order statistics, throughput.

    Columns: latency_ms (null when nothing ran), cached, error.
    """
    counts = preds.agg(F.count(F.when(~F.col("cached") & F.col("error").isNull(), 1)).alias("processed"),
                       F.count(F.when(F.col("cached"), 1)).alias("cached"), F.count("error").alias("errors"),
                       F.count("*").alias("_rows"), F.sum("latency_ms").alias("_total"))
    ran = preds.filter(~F.col("cached") & F.col("error").isNull())
    p = order_statistics(ran, "latency_ms", {"p50": (0.5, F.floor(F.col("n") / 2)), "p99": (0.99, F.floor(F.col("n") * 0.99))})
    return counts.crossJoin(F.broadcast(p.select("p50", "p99"))).select(  # one row each
        "processed", "cached", "errors", "p50", "p99",
        F.round(F.try_divide(F.col("_rows") * 1000.0, F.col("_total")), 4).alias("throughput"))


def manifest_summary(manifest: DataFrame, domains: int = 15) -> DataFrame:
    """(section, item, n, value): totals, counts by status, most frequent source domains."""
    has = F.coalesce(F.col("image_count") > 0, F.lit(False))
    # one pass over the manifest; the stored counts by status and domain answer every section
    pre = written(manifest.groupBy(has.alias("_has"), "status", "source_domain").agg(
        F.count("*").alias("_n"), F.sum("image_count").alias("_images")), "manifest-counts")
    n = F.sum("_n")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))
    empty = F.col("status").isin("no_results", "no_good_images")
    totals = pre.agg(
        F.coalesce(n, F.lit(0)).alias("total"), rows(F.col("_has")).alias("with_images"),
        rows(empty | (F.col("status") == "download_failed")).alias("without_images"),
        rows(empty).alias("no_results"), rows(F.col("status") == "download_failed").alias("download_failed"),
        F.coalesce(F.sum("_images"), F.lit(0)).cast("long").alias("total_images"))
    t = totals.withColumns({"mean_images": F.round(F.try_divide("total_images", "with_images"), 4),
                            "success_rate": F.round(100.0 * F.col("with_images") / F.greatest("total", F.lit(1)), 4)})
    counts = t.unpivot([], ["total", "with_images", "without_images", "no_results", "download_failed", "total_images"], "item", "n")
    rates = t.unpivot([], ["mean_images", "success_rate"], "item", "value")
    status = pre.groupBy(F.coalesce("status", F.lit("unknown")).alias("item")).agg(n.alias("n"))
    top = pre.filter(F.col("source_domain") != "").groupBy(F.col("source_domain").alias("item")).agg(
        n.alias("n")).orderBy(F.col("n").desc(), "item").limit(domains)
    none = F.lit(None)

    def part(section: str, df: DataFrame) -> DataFrame:
        cols = df.columns
        return df.select(F.lit(section).alias("section"), "item",
                         (F.col("n") if "n" in cols else none.cast("long")).alias("n"),
                         (F.col("value") if "value" in cols else none.cast("double")).alias("value"))
    return part("count", counts).unionByName(part("rate", rates)).unionByName(part("status", status)).unionByName(
        part("domain", top))


def routing_stats(results: DataFrame) -> DataFrame:
    """(section, item, n, pct) of tiers and reasons (columns routing_tier, reason)."""
    total = results.agg(F.count("*").alias("_t"))  # one row
    tiers = results.groupBy(F.concat(F.lit("tier"), F.col("routing_tier").cast("string")).alias("item")).agg(
        F.count("*").alias("n")).withColumn("section", F.lit("tier"))
    reasons = results.filter(F.col("reason").isNotNull()).groupBy(F.col("reason").alias("item")).agg(
        F.count("*").alias("n")).withColumn("section", F.lit("reason"))
    return tiers.unionByName(reasons).crossJoin(F.broadcast(total)).select(
        "section", "item", "n", F.round(100.0 * F.col("n") / F.greatest("_t", F.lit(1)), 1).alias("pct"))


def field_routing_stats(routed: DataFrame) -> DataFrame:
    """(item, n, value) from rows with routed_fields (array), classifier_ms and fallback_ms."""
    any_ = F.size("routed_fields") > 0
    n = F.count("*")
    sent = F.count(F.when(any_, 1))
    t = routed.agg(n.alias("total"), (n - sent).alias("classifier_only"), sent.alias("routed"),
                   F.round(F.avg("classifier_ms"), 4).alias("avg_classifier_ms"),
                   F.round(F.coalesce(F.sum(F.when(F.col("fallback_ms") > 0, F.col("fallback_ms"))), F.lit(0.0))
                           / F.greatest(sent, F.lit(1)), 4).alias("avg_fallback_ms"))
    counts = t.unpivot([], ["total", "classifier_only", "routed"], "item", "n").withColumn("value", F.lit(None).cast("double"))
    means = t.unpivot([], ["avg_classifier_ms", "avg_fallback_ms"], "item", "value").withColumn("n", F.lit(None).cast("long"))
    fields = routed.select(F.explode("routed_fields").alias("item")).groupBy("item").agg(n.alias("n")).crossJoin(
        F.broadcast(t.select("total"))).select(F.concat(F.lit("field_"), "item").alias("item"), "n",
                                               F.round(100.0 * F.col("n") / F.col("total"), 4).alias("value"))
    return counts.unionByName(means).unionByName(fields)
