"""Catalog profiles: coverage, distributions, class sizes, taxonomy and feature statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import features as fe
from ..functions.text import each, let, text_or_empty
from .ranking import order_statistics, topk_per_key


def _as_text(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.array_join(c, "|") if kind.startswith("array") else F.col(c).cast("string")


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[_as_text(df, c).alias(c) for c in cols]).unpivot([], cols, "attribute", "value")


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-null count, percent and distinct values per attribute.

    Two combined aggregations: values collapse per (attribute, value) before the distinct
    count, so no attribute is collected in one task.
    """
    per_value = _long(df, cols).groupBy("attribute", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("attribute").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.round(100.0 * F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("pct"),
        F.count("value").alias("n_unique"))


def value_distribution(df: DataFrame, cols: list[str], n: int = 15) -> DataFrame:
    """Top n values per attribute with count, share, number of values and total."""
    per_value = _long(df, cols).filter(F.col("value").isNotNull()).groupBy("attribute", "value").agg(
        F.count("*").alias("n"))
    totals = per_value.groupBy("attribute").agg(F.sum("n").alias("total"), F.count("*").alias("n_unique"))
    top = topk_per_key(per_value, ["attribute"], [F.col("n").desc(), F.col("value").asc()], n)
    return top.join(totals, "attribute").select(
        "attribute", "value", "n", "rnk", "total", "n_unique", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


def dataset_summary(products: DataFrame, queries: DataFrame, labels: DataFrame) -> DataFrame:
    """Row counts, class count, rows with features and label counts as (metric, value) rows."""
    p = products.agg(F.count("*").alias("num_products"), F.count("product_features").alias("products_with_features"))
    c = products.filter(F.col("product_class").isNotNull()).select("product_class").distinct().agg(
        F.count("*").alias("num_product_classes"))
    q = queries.agg(F.count("*").alias("num_queries"))
    out = None
    for part in (p, c, q):
        long = part.unpivot([], part.columns, "metric", "value")
        out = long if out is None else out.unionByName(long)
    per_label = labels.groupBy("label").agg(F.count("*").alias("value")).select(
        F.concat(F.lit("label_"), "label").alias("metric"), "value")
    return out.unionByName(per_label).unionByName(
        labels.agg(F.count("*").alias("num_labels")).unpivot([], ["num_labels"], "metric", "value"))


def product_classes(products: DataFrame) -> DataFrame:
    return products.filter(F.col("product_class").isNotNull()).select("product_class").distinct().orderBy("product_class")


def size_bucket(n: Column) -> Column:
    return F.when(n < 5, "tiny").when(n < 20, "small").when(n < 100, "medium").otherwise("large")


def class_sizes(df: DataFrame, cls: str = "product_class") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(cls), F.lit("unknown")).alias("class")).agg(F.count("*").alias("n"))


def category_sizes(df: DataFrame, cls: str = "product_class", n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Classes per size bucket, and the n largest and smallest classes."""
    sizes = class_sizes(df, cls)
    buckets = sizes.groupBy(size_bucket(F.col("n")).alias("bucket")).agg(
        F.count("*").alias("classes"), F.sum("n").alias("products"))
    top = sizes.orderBy(F.col("n").desc(), "class").limit(n).withColumn("side", F.lit("top"))
    low = sizes.orderBy(F.col("n").asc(), F.col("class").desc()).limit(n).withColumn("side", F.lit("bottom"))
    return buckets, top.unionByName(low)


def taxonomy_profile(df: DataFrame, path: str = "taxonomy") -> tuple[DataFrame, DataFrame]:
    """Depth histogram with share; distinct names per level (max depth = last level)."""
    depths = df.groupBy(F.size(path).alias("depth")).agg(F.count("*").alias("n"))
    total = depths.agg(F.sum("n").alias("_total"))  # one row
    histogram = depths.crossJoin(F.broadcast(total)).select(
        "depth", "n", F.round(100.0 * F.col("n") / F.col("_total"), 4).alias("pct"))
    levels = df.select(F.posexplode(path).alias("pos", "name")).distinct().groupBy(
        (F.col("pos") + 1).alias("level")).agg(F.count("*").alias("names"))
    return histogram, levels


def _features(df: DataFrame) -> DataFrame:
    return each(df, fe.lower_entries(F.col("product_features")), "e", "product_id", "product_class").select(
        "product_id", "product_class", "e.k", "e.v")


def feature_key_presence(df: DataFrame, targets: list[str] = lx.TARGET_KEYS) -> DataFrame:
    """Products having each raw key, percent of the catalog, target flag."""
    total = df.agg(F.count("*").alias("_total"))  # one row
    per_key = _features(df).groupBy("k").agg(F.count("*").alias("n"))
    return per_key.crossJoin(F.broadcast(total)).select(
        F.col("k").alias("key"), "n", F.round(100.0 * F.col("n") / F.col("_total"), 4).alias("pct"),
        F.col("k").isin(list(targets)).alias("is_target"))


def chosen_keys(keys: DataFrame, targets: list[str], exact_first: bool) -> DataFrame:
    """(target, key): the exact key, else the alphabetically first key containing the target."""
    ts = let(F.col("k"), lambda k: F.filter(F.lit(list(targets)), lambda t: F.contains(k, t)))
    pairs = keys.select("k", F.explode(ts).alias("target"))
    score = F.struct((F.col("k") != F.col("target")) if exact_first else F.lit(False), F.col("k"))
    return pairs.groupBy("target").agg(F.min_by("k", score).alias("key"))


def feature_value_profile(df: DataFrame, targets: list[str] = lx.TARGET_KEYS, n: int = 15) -> DataFrame:
    """Top n values per target key with share, number of values and of rare values (< 5 rows)."""
    per_value = _features(df).groupBy("k", "v").agg(F.count("*").alias("n"))
    picked = chosen_keys(per_value.select("k").distinct(), targets, exact_first=True).select(
        F.col("key").alias("k")).distinct()
    values = per_value.join(picked, "k", "left_semi")
    totals = values.groupBy("k").agg(F.sum("n").alias("total"), F.count("*").alias("n_unique"),
                                     F.sum((F.col("n") < 5).cast("int")).alias("rare"))
    top = topk_per_key(values, ["k"], [F.col("n").desc(), F.col("v").asc()], n)
    return top.join(totals, "k").select(F.col("k").alias("key"), F.col("v").alias("value"), "n", "rnk", "total",
                                        "n_unique", "rare", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


def sampling_plan(df: DataFrame, caps: list[int] = lx.SAMPLE_CAPS, cls: str = "product_class") -> DataFrame:
    """Rows and class coverage when every class is cut at a cap."""
    rows = class_sizes(df, cls).select("n", F.explode(F.lit(list(caps))).alias("cap"))
    s = F.least("n", "cap")
    return rows.groupBy("cap").agg(
        F.sum(s).alias("sampled"), F.count("*").alias("classes"), F.sum((s >= 10).cast("int")).alias("well_covered"),
        F.sum(((s >= 3) & (s < 10)).cast("int")).alias("partly_covered"), F.sum((s < 3).cast("int")).alias("barely_covered"))


def coverage_by_class(df: DataFrame, targets: list[str] = lx.COVERAGE_TARGETS, n: int = 30) -> DataFrame:
    """Percent of products per class that have each target key, for the n largest classes."""
    feats = _features(df)
    picked = chosen_keys(feats.select("k").distinct(), targets, exact_first=False)
    having = feats.join(F.broadcast(picked), feats.k == picked.key).groupBy("product_class", "target").agg(F.count("*").alias("h"))  # one row per target
    wide = having.groupBy("product_class").pivot("target", list(targets)).agg(F.first("h"))
    sizes = df.filter(F.col("product_class").isNotNull()).groupBy("product_class").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.col("n").desc(), "product_class").limit(n)
    return largest.join(wide, "product_class", "left").select(
        "product_class", "n", *[F.round(100.0 * F.coalesce(t, F.lit(0)) / F.col("n"), 4).alias(t) for t in targets])


def feature_count_stats(df: DataFrame) -> DataFrame:
    """Features per product with rows and the overall mean and median.

    The histogram has one row per distinct count, so the order statistics run on it alone.
    """
    rows = df.filter(F.col("product_features").isNotNull()).select(
        F.size(F.split("product_features", r"\|")).alias("features"))
    stats = order_statistics(rows, "features", {"_lo": (0.5, F.floor((F.col("n") - 1) / 2)), "_hi": (0.5, F.floor(F.col("n") / 2))})
    mean = rows.agg(F.round(F.avg("features"), 4).alias("mean"))
    one = stats.crossJoin(F.broadcast(mean)).select(((F.col("_lo") + F.col("_hi")) / 2).alias("median"), "mean")  # one row
    return rows.groupBy("features").agg(F.count("*").alias("n")).crossJoin(F.broadcast(one))


def richness_score(df: DataFrame, weights: dict[str, float] = lx.RICHNESS, depth: str = "taxonomy_depth") -> Column:
    score = F.when(F.col(depth) >= 4, 1.0).otherwise(0.0)
    for c, w in weights.items():
        score = score + F.when(F.col(c).isNotNull(), float(w)).otherwise(0.0)
    return score


def material_check(queue: DataFrame) -> DataFrame:
    """Among names with `chair`: count, wood-like and fabric-like rows and shares."""
    chairs = queue.filter(F.contains(F.lower(text_or_empty(F.col("product_name"))), F.lit("chair")))
    n = F.count("*")
    wood = F.count(F.when(F.col("primary_material").isin(lx.WOODLIKE), 1))
    soft = F.count(F.when(F.col("primary_material").isin(lx.FABRICLIKE), 1))
    share = lambda c: F.round(100.0 * c / F.greatest(n, F.lit(1)), 4)
    return chairs.agg(n.alias("chairs"), wood.alias("wood"), soft.alias("soft"), share(wood).alias("wood_pct"),
                      share(soft).alias("soft_pct"))
