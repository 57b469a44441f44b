"""Confidence routing between the classifier and a fallback model, and merging of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import vectors as ve


def mismatch_flags(df: DataFrame) -> DataFrame:
    """Statistics, mismatch flag and reason from p_img, p_txt, p_fused, has_image.

    The image checks only run with an image and exclude each other; the later checks
    overwrite the reason, so the last failing one names it.
    """
    s = df.withColumns({"_i": ve.prob_stats(F.col("p_img")), "_t": ve.prob_stats(F.col("p_txt")),
                        "_f": ve.prob_stats(F.col("p_fused")), "_e": ve.entropy(F.col("p_fused")),
                        "_kl": F.when(F.col("has_image"), ve.kl(F.col("p_txt"), F.col("p_img"))).otherwise(F.lit(0.0))})
    reason = (F.when(F.col("_e") > lx.ENTROPY_LIMIT, "high_entropy")
              .when(F.col("_f.margin") < lx.MARGIN_LIMIT, "low_margin")
              .when(F.col("_f.confidence") < lx.CONFIDENCE_LIMIT, "low_confidence")
              .when(F.col("has_image") & (F.col("_i.pred") != F.col("_t.pred")), "top1_disagree")
              .when(F.col("has_image") & (F.col("_kl") > lx.KL_LIMIT), "kl_diverge").otherwise("none"))
    kept = [c for c in df.columns if c not in ("p_img", "p_txt", "p_fused")]
    return s.select(*kept, (reason != "none").alias("mismatch"), reason.alias("mismatch_reason"), F.col("_kl").alias("kl_divergence"),
                    F.col("_i.pred").alias("img_prediction"), F.col("_i.confidence").alias("img_confidence"),
                    F.col("_t.pred").alias("txt_prediction"), F.col("_t.confidence").alias("txt_confidence"),
                    F.col("_f.confidence").alias("fused_confidence"), F.col("_f.margin").alias("fused_margin"),
                    F.col("_e").alias("fused_entropy"))


def route_tiers(flags: DataFrame) -> DataFrame:
    """Tier 1 classifier, tier 2 cautious unless both modalities are sure and disagree, else tier 3."""
    conf = F.col("fused_confidence")
    conflict = ((F.col("img_confidence") > lx.MODALITY_CONFIDENT) & (F.col("txt_confidence") > lx.MODALITY_CONFIDENT)
                & (F.col("img_prediction") != F.col("txt_prediction")))
    tier = F.when(conf >= lx.TIER1, 1).when((conf >= lx.TIER2) & ~conflict, 2).otherwise(3)
    return flags.withColumn("routing_tier", tier).withColumns({
        "method": F.when(F.col("routing_tier") == 1, "classifier").when(F.col("routing_tier") == 2, "classifier_cautious")
                   .otherwise("vlm_fallback"),
        "reason": F.when(F.col("routing_tier") == 3, F.when(conf >= lx.TIER2, "modality_conflict").otherwise("low_confidence"))})


def is_level(c: Column) -> Column:
    return F.startswith(c, F.lit("level_"))


def weak(value: Column, confidence: Column, threshold: float = 0.5) -> Column:
    return (confidence < threshold) | value.isNull() | (value == lx.UNKNOWN)


def cut_levels(heads: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Taxonomy rows kept up to the first weak level (columns product_id, i, field, val, confidence).

    The window covers the levels of one product, a handful of rows.
    """
    levels = heads.filter(is_level(F.col("field")))
    upto = Window.partitionBy("product_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.max(weak(F.col("val"), F.col("confidence"), threshold).cast("int")).over(upto)
    return levels.withColumn("_bad", bad).filter(F.col("_bad") == 0).drop("_bad")


def fields_to_route(heads: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per product: kept taxonomy path and the fields to ask the fallback for, in head order.

    The taxonomy counts as one field, listed last.
    """
    w = weak(F.col("val"), F.col("confidence"), threshold)
    level = is_level(F.col("field"))
    grouped = heads.groupBy("product_id").agg(  # one row per head, so the lists hold a handful of entries
        F.min(F.when(level & w, F.col("i"))).alias("_cut"),
        F.array_sort(F.collect_list(F.when(level, F.struct("i", "val")))).alias("_levels"),
        F.transform(F.array_sort(F.collect_list(F.when(~level & w, F.struct("i", "field")))), lambda f: f["field"]).alias("_fields"))
    kept = F.filter("_levels", lambda l: F.col("_cut").isNull() | (l["i"] < F.col("_cut")))
    return grouped.select("product_id", F.transform(kept, lambda l: l["val"]).alias("taxonomy"), F.when(
        F.col("_cut").isNotNull(), F.concat("_fields", F.array(F.lit("taxonomy")))).otherwise(F.col("_fields")).alias("routed_fields"))


def decode_attributes(predictions: Column) -> Column:
    """Attribute map without unknown values; `_family` and `primary_` stripped from the keys."""
    known = F.map_filter(predictions, lambda k, v: v.isNotNull() & (v != "") & (v != lx.UNKNOWN))
    return F.transform_keys(known, lambda k, v: F.replace(F.replace(k, F.lit("_family"), F.lit("")), F.lit("primary_"), F.lit("")))


def join_known(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: v != "unknown"), ", ")


def merge_fallback(heads: DataFrame, fallback: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Attribute rows where routed fields take the fallback value when there is one.

    `fallback` has product_id, field, fb_val.  Fields that stay weak are pending.
    """
    attrs = heads.filter(~is_level(F.col("field")))
    w = weak(F.col("val"), F.col("confidence"), threshold)
    joined = attrs.join(fallback, ["product_id", "field"], "left")
    take = w & F.col("fb_val").isNotNull() & (F.col("fb_val") != "")
    return joined.select(
        "product_id", "field", F.when(take, F.col("fb_val")).when(~w, F.col("val")).alias("val"),
        F.when(take, F.lit(lx.FALLBACK_CONFIDENCE)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(take, "vlm").when(~w, "classifier").otherwise("pending_vlm").alias("source"))


def merge_taxonomy(routed: DataFrame, fallback_taxonomy: DataFrame) -> DataFrame:
    """Routed taxonomies take the fallback path when it is not empty (columns taxonomy, routed_fields, fb_taxonomy)."""
    take = F.array_contains("routed_fields", "taxonomy") & (F.size("fb_taxonomy") > 0)
    return routed.join(fallback_taxonomy, "product_id", "left").select(
        "product_id", F.when(take, F.col("fb_taxonomy")).otherwise(F.col("taxonomy")).alias("taxonomy"),
        F.coalesce(take, F.lit(False)).alias("taxonomy_from_fallback"))


def parsed_safety_net(merged: DataFrame, parsed: DataFrame, fields: tuple[str, ...] = ("assembly", "shape")) -> DataFrame:
    """Missing or very weak assembly and shape take the parsed feature with confidence 1."""
    j = merged.join(parsed, ["product_id", "field"], "full_outer")
    take = (F.col("field").isin(list(fields)) & (F.col("val").isNull() | (F.col("confidence") < 0.3))
            & (F.coalesce("parsed_val", F.lit("")) != ""))
    take = F.coalesce(take, F.lit(False))
    return j.filter(take | F.col("source").isNotNull()).select(
        "product_id", "field", F.when(take, F.col("parsed_val")).otherwise(F.col("val")).alias("val"),
        F.when(take, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(take, "parsed_features").otherwise(F.col("source")).alias("source"))


def routed_catalog(heads: DataFrame, fallback: DataFrame, fallback_taxonomy: DataFrame, parsed: DataFrame | None = None,
                   threshold: float = 0.5) -> DataFrame:
    """Catalog rows from predictions: (product_id, taxonomy, attributes, confidence, routed_fields, method).

    `heads` is the long form of `predict_with_confidence`. Weak fields and taxonomies are routed and take the answers of
    `fallback` (product_id, field, fb_val) and `fallback_taxonomy` (product_id, fb_taxonomy) where there are any, assembly and shape
    those of `parsed`; the confidence is that of the least sure field that has a value, and `method` tells who answered.
    """
    routed = fields_to_route(heads, threshold)
    merged = merge_fallback(heads, fallback, threshold)
    if parsed is not None:
        merged = parsed_safety_net(merged, parsed)
    fields = merged.groupBy("product_id").agg(  # one row per head
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "val")))).alias("_fields"),
        F.min(F.when(F.col("val").isNotNull(), F.col("confidence"))).alias("confidence"),
        F.bool_or(F.col("source") == "pending_vlm").alias("_pending"))
    asked = F.size("routed_fields") > 0
    return routed.join(merge_taxonomy(routed, fallback_taxonomy).select("product_id", F.col("taxonomy").alias("_path")), "product_id").join(
        fields, "product_id", "left").select(
            "product_id", F.col("_path").alias("taxonomy"), decode_attributes(F.col("_fields")).alias("attributes"), "confidence", "routed_fields",
            F.when(~asked, "classifier").when(F.col("_pending"), "pending").otherwise("fallback").alias("method"))


def unavailable_fallback(tiers: DataFrame, answers: DataFrame) -> DataFrame:
    """Tier-3 rows without a fallback answer keep the classifier result with confidence 0.5."""
    j = tiers.join(answers, "product_id", "left")
    asked = F.col("routing_tier") == 3
    return j.withColumn("confidence", F.when(asked, F.coalesce("answer_confidence", F.lit(lx.UNAVAILABLE_CONFIDENCE)))
                        .otherwise(F.col("fused_confidence"))).drop("answer_confidence")
