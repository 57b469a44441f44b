"""Row filters and projections of the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon as lx
from ..functions import features as fe
from ..functions import text as tx


def with_features(df: DataFrame, col: str = "product_features") -> DataFrame:
    return df.filter(F.col(col).isNotNull() & (tx.strip(F.col(col)) != ""))


def by_id(df: DataFrame, value: int, id_col: str = "product_id") -> DataFrame:
    """Row of one id; a missing id fails when the result is read."""
    hit = df.filter(F.col(id_col) == F.lit(value))
    error = F.raise_error(F.lit(f"{id_col} {value} not found")).cast("boolean")
    # a count that never passes the filter: it adds no row, only the error
    check = hit.agg(F.count("*").alias("_n")).filter(F.when(F.col("_n") == 0, error).otherwise(F.lit(False)))
    return hit.unionByName(check.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def count_present(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in cols])


def min_attributes(df: DataFrame, cols: list[str], n: int = 2) -> DataFrame:
    return df.filter(count_present(cols) >= n)


def with_image(df: DataFrame, images: DataFrame, key: str = "image_path") -> DataFrame:
    """Rows whose image exists."""
    return df.join(images.select(key), key, "left_semi")


def kept_counts(df: DataFrame, images: DataFrame, key: str = "image_path") -> DataFrame:
    """One row: kept and total."""
    known = images.select(key).distinct().withColumn("_hit", F.lit(1))
    return df.join(known, key, "left").agg(F.count("_hit").alias("kept"), F.count("*").alias("total"))


def valid_taxonomy(df: DataFrame, path: str = "taxonomy", junk: list[str] = lx.JUNK_LEVEL1) -> DataFrame:
    first = F.get(F.col(path), F.lit(0))
    branded = F.coalesce(F.contains(first, F.lit("Browse By Brand")), F.lit(True))
    return df.filter((F.size(path) > 0) & ~branded & ~first.isin(junk))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN and the text `nan` to null in all top-level columns."""
    def fix(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit("nan"))
        return c.alias(f.name)
    return df.select(*[fix(f) for f in df.schema.fields])


def pad_attributes(attrs: Column, keys: list[str] = lx.SCHEMA1) -> Column:
    """JSON attribute object as a struct with exactly the given keys."""
    return F.from_json(attrs, T.StructType([T.StructField(k, T.StringType()) for k in keys]))


def process_products(df: DataFrame) -> DataFrame:
    """Rows with features, plus the seven canonical attribute columns."""
    parsed = with_features(df).withColumn(
        "_a", fe.normalize_attributes(fe.feature_entries(F.col("product_features"))))
    return parsed.select(*df.columns, "_a.*")


def training_examples(processed: DataFrame) -> DataFrame:
    """product_id, input_text, target_attributes (non-null ones as JSON), product_class."""
    return processed.select(
        "product_id",
        tx.training_text(F.col("product_name"), F.col("product_class"), F.col("product_description")).alias("input_text"),
        F.to_json(F.struct(*lx.SCHEMA1)).alias("target_attributes"), "product_class")


def hybrid_merge(visual: DataFrame, text: DataFrame, key: str = "product_id") -> DataFrame:
    """Visual answers first for the visible attributes, text answers for the others."""
    seen = ["style", "primary_material", "color_family", "product_type"]
    told = ["secondary_material", "room_type", "assembly_required"]
    v, t = visual.alias("v"), text.alias("t")
    return v.join(t, F.col(f"v.{key}") == F.col(f"t.{key}"), "left").select(
        F.col(f"v.{key}").alias(key),
        *[F.coalesce(f"v.{c}", f"t.{c}").alias(c) for c in seen], *[F.col(f"t.{c}").alias(c) for c in told])


def compare_extractions(results: dict[str, DataFrame], key: str = "product_id") -> DataFrame:
    """Attribute x model table per product over the union of the attribute keys."""
    long = None
    for model, df in results.items():
        cols = [c for c in df.columns if c != key]
        part = df.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
            [key], cols, "attribute", "value").withColumn("model", F.lit(model))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(key, "attribute").pivot("model", list(results)).agg(F.first("value"))


def explain_match(hits: DataFrame, attributes: list[str] = ("color_family", "style", "primary_material", "product_type")) -> DataFrame:
    """Per hit and attribute: does the product value contain the query value (columns q_*, p_*)."""
    def flag(a: str) -> Column:
        qv, pv = F.lower(F.col(f"q_{a}")), F.lower(F.col(f"p_{a}"))
        return F.when((tx.text_or_empty(qv) != "") & (tx.text_or_empty(pv) != ""), F.contains(pv, qv)).alias(f"match_{a}")
    return hits.select("*", *[flag(a) for a in attributes])


def image_metadata(df: DataFrame) -> DataFrame:
    """Nested image record; the source part only exists when the search found something."""
    truth = ["style", "primary_material", "color_family", "product_type", "room_type", "assembly_required"]
    source = ["url", "photographer", "source", "source_id", "license"]
    return df.select(
        "product_id", "product_name", "product_class", "image_path", "search_query", "status",
        F.struct(*truth).alias("ground_truth"),
        F.when(F.col("url").isNotNull(), F.struct(*source)).alias("image_source"))


def catalog_lines(df: DataFrame) -> DataFrame:
    """Public row: id, taxonomy, flattened attributes, confidence with 3 decimals."""
    return df.select("product_id", "taxonomy", "attributes.*", F.round("confidence", 3).alias("confidence"))
