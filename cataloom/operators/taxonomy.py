"""Taxonomy vocabulary and lookup: building, resolving classes, label encoding.

The lookup is kept in long form (path, depth, class); no list of classes or paths is
collected, so a root that covers the whole catalog is an ordinary group of counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import text_or_empty
from ..session import written
from .ranking import bucketed_rank


def _prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda d: F.struct(
        d.alias("depth"), F.array_join(F.slice(path, F.lit(1), d), "/").alias("prefix")))


def build_lookup(queue: DataFrame, path: str = "taxonomy", cls: str = "product_class") -> DataFrame:
    """(path, depth, product_class, full_rows, n): every prefix with its classes."""
    rows = queue.filter((F.size(path) > 0) & (text_or_empty(F.col(cls)) != ""))
    # same path and class collapse before the prefixes are exploded
    pairs = rows.groupBy(F.col(path).alias("_p"), F.col(cls).alias("product_class")).agg(F.count("*").alias("_n"))
    each = pairs.select("product_class", "_n", F.size("_p").alias("_len"), F.explode(_prefixes(F.col("_p"))).alias("e"))
    return each.groupBy(F.col("e.prefix").alias("path"), F.col("e.depth").alias("depth"), "product_class").agg(
        F.sum(F.when(F.col("e.depth") == F.col("_len"), F.col("_n")).otherwise(0)).alias("full_rows"),
        F.sum("_n").alias("n"))


def lookup_stats(lookup: DataFrame) -> DataFrame:
    """Number of full paths, of classes and of ambiguous full paths."""
    full = lookup.filter(F.col("full_rows") > 0)
    per_path = full.groupBy("path").agg(F.count("*").alias("_c"))
    classes = full.select("product_class").distinct().agg(F.count("*").alias("n_classes"))
    return per_path.agg(F.count("*").alias("n_paths"), F.sum((F.col("_c") > 1).cast("int")).alias("n_ambiguous")).crossJoin(
        F.broadcast(classes))  # one row each


def resolve_class(products: DataFrame, lookup: DataFrame, path: str = "taxonomy", key: str = "product_id") -> DataFrame:
    """product_class, class_match (exact/partial/fallback) and matched depth per product.

    Works on distinct (path, colour, material, style) combinations: the best known prefix
    per distinct path first, then the best class at that prefix.  Classes are reduced once
    per prefix to the smallest class for every set of attribute words that it holds; a
    combination then looks up the eight subsets of its words instead of all classes.
    """
    points = {"primary_color": 3, "primary_material": 2, "style": 1}
    names = [f"_{a}" for a in points]
    keyed = products.withColumn("_path", F.array_join(path, "/")).withColumns(
        {f"_{a}": F.lower(text_or_empty(F.col(a))) for a in points})
    combo_keys = ["_path", *names]
    paths = keyed.groupBy("_path").agg(F.first(path).alias("_levels"))
    known = lookup.groupBy("path").agg(F.max("full_rows").alias("_full"))
    tried = paths.select("_path", F.size("_levels").alias("_len"), F.explode(_prefixes(F.col("_levels"))).alias("e"))
    usable = tried.join(known, F.col("e.prefix") == F.col("path")).filter(
        (F.col("e.depth") < F.col("_len")) | (F.col("_full") > 0))
    best = usable.groupBy("_path").agg(F.max_by(F.struct(
        F.col("e.prefix").alias("prefix"), F.col("e.depth").alias("depth"),
        (F.col("e.depth") == F.col("_len")).alias("exact")), F.col("e.depth")).alias("_b"))
    combos = keyed.select(*combo_keys).distinct()
    # the words in use, one row: attributes come from closed vocabularies
    vocabulary = combos.agg(*[F.collect_set(n).alias(f"{n}_words") for n in names])
    classes = lookup.select("path", F.col("product_class").alias("_cls"), F.lower("product_class").alias("_low"),
                            # at the full path only classes that occur at the full path count
                            F.explode(F.when(F.col("full_rows") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("_exact"))
    held = classes.crossJoin(F.broadcast(vocabulary))

    def words_held(n: str) -> Column:
        low = F.col("_low")
        return F.concat(F.array(F.lit("")), F.filter(f"{n}_words", lambda w: (w != "") & F.contains(low, w)))
    for n in names:
        held = held.withColumn(n, F.explode(words_held(n)))
    smallest = held.groupBy("path", "_exact", *names).agg(F.min("_cls").alias("_cls"))
    subsets = F.array(*[F.struct(*[(F.col(n) if m >> i & 1 else F.lit("")).alias(n) for i, n in enumerate(names)],
                                 sum([F.when(F.col(n) != "", p).otherwise(0) for i, (n, p) in enumerate(zip(names, points.values())) if m >> i & 1], F.lit(0)).alias("score"))
                        for m in range(8)])
    asked = combos.join(best, "_path").select(*combo_keys, "_b", F.explode(F.array_distinct(subsets)).alias("k"))
    hit = asked.join(smallest.select("path", "_exact", *[F.col(n).alias(f"{n}_k") for n in names], "_cls"), [
        F.col("_b.prefix") == F.col("path"), F.col("_b.exact") == F.col("_exact"), *[F.col(f"k.{n}") == F.col(f"{n}_k") for n in names]])
    chosen = hit.groupBy(*combo_keys).agg(
        F.min_by("_cls", F.struct(-F.col("k.score"), F.col("_cls"))).alias("product_class"), F.first("_b").alias("_b"))
    out = keyed.drop("product_class").join(chosen, combo_keys, "left")
    return out.select(key, "product_class", F.when(F.col("_b").isNull(), "fallback").when(F.col("_b.exact"), "exact")
                      .otherwise("partial").alias("class_match"), F.coalesce("_b.depth", F.lit(0)).alias("matched_depth"))


def valid_classes(paths: DataFrame, lookup: DataFrame, path: str = "taxonomy") -> DataFrame:
    """(path, product_class): classes of any prefix of each distinct path."""
    each = paths.groupBy(F.array_join(path, "/").alias("path")).agg(F.first(path).alias("_l")).select(
        "path", F.explode(_prefixes(F.col("_l"))).alias("e"))
    return each.join(lookup.select(F.col("path").alias("_lp"), "product_class"), F.col("e.prefix") == F.col("_lp")).select(
        "path", "product_class").distinct()


def vocab_values(df: DataFrame, attributes: Sequence[str], path: str = "taxonomy", cls: str = "product_class") -> DataFrame:
    """(kind, value, n): distinct values per attribute, level and class."""
    parts = F.array(*[F.struct(F.lit(a).alias("kind"), F.col(a).cast("string").alias("value")) for a in attributes],
                    F.struct(F.lit("product_class").alias("kind"), F.col(cls).alias("value")),
                    F.struct(F.lit("path").alias("kind"), F.nullif(F.array_join(path, " / "), F.lit("")).alias("value")))
    levels = F.transform(F.col(path), lambda v, i: F.struct(
        F.concat(F.lit("level_"), (i + 1).cast("string")).alias("kind"), v.alias("value")))
    return df.select(F.explode(F.concat(parts, levels)).alias("e")).select("e.*").filter(
        F.col("value").isNotNull()).groupBy("kind", "value").agg(F.count("*").alias("n"))


def build_vocab(df: DataFrame, attributes: Sequence[str], path: str = "taxonomy", cls: str = "product_class",
                bucket_rows: int = 50_000) -> DataFrame:
    """(kind, value, n, idx): sorted distinct values per attribute, level and class; idx from 1.

    The index is counted inside ranges of (kind, value) of about `bucket_rows` values, which
    Spark draws from the values themselves, so a prefix that all of them share does not matter.
    """
    values = written(vocab_values(df, attributes, path, cls), "values")
    ranges = max(1, -(-values.count() // bucket_rows))
    ranged = written(values.repartitionByRange(ranges, "kind", "value").withColumn("_range", F.spark_partition_id()), "ranges")
    return bucketed_rank(ranged, ["kind"], [F.col("value")], F.col("_range"), "idx").drop("_range")


def encode_labels(df: DataFrame, vocab: DataFrame, attributes: Sequence[str], path: str = "taxonomy",
                  levels: int = 4, key: str = "product_id", missing: int = -1) -> DataFrame:
    """(product_id, kind, idx): vocabulary index, 0 when unknown, `missing` when null or too shallow."""
    items = [F.struct(F.lit(a).alias("kind"), F.col(a).cast("string").alias("value")) for a in attributes]
    items += [F.struct(F.lit(f"level_{i + 1}").alias("kind"), F.get(path, F.lit(i)).alias("value")) for i in range(levels)]
    long = df.select(key, F.explode(F.array(*items)).alias("e")).select(key, "e.*")
    kinds = [*attributes, *(f"level_{i + 1}" for i in range(levels))]  # classes and paths, which grow with the catalog, stay where they are
    hit = long.join(vocab.filter(F.col("kind").isin(kinds)).select("kind", "value", F.col("idx").alias("_idx")), ["kind", "value"], "left")
    return hit.select(key, "kind", F.when(F.col("value").isNull(), missing).otherwise(
        F.coalesce(F.col("_idx"), F.lit(0))).cast("int").alias("idx"))


def vocab_drift(vocab: DataFrame, defaults: dict[str, list[str]]) -> DataFrame:
    """Values in only one of the built-in and the data vocabulary (kind, value) per attribute."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("values")) for k, v in defaults.items()])
    built_in = vocab.sparkSession.range(1).select(F.explode(kinds).alias("e")).select(
        "e.kind", F.explode("e.values").alias("value"))
    data = vocab.filter(F.col("kind").isin(list(defaults))).select("kind", "value")
    return built_in.exceptAll(data).withColumn("only_in", F.lit("default")).unionByName(
        data.exceptAll(built_in).withColumn("only_in", F.lit("data")))
