"""Deterministic splits, samples and training sets.

All random choices order or draw by md5 of (seed, id): the same on any cluster.  Ranks come
from `shuffled_rank`, so a stratum that holds a third of the table is still spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import hash_long, hash_uniform
from ..session import written
from .joins import product_texts, relevance_pairs
from .ranking import hash_order, shuffled_rank


def stratified_split(df: DataFrame, strata: Sequence[str], train: float = 0.8, val: float = 0.1, seed: int = 42,
                     ids: Sequence[str] = ("product_id",)) -> DataFrame:
    """Column `split`: per stratum the first int(train n) rows, up to int((train+val) n), the rest."""
    ranked = shuffled_rank(df, list(strata), seed, ids, "_r", "_n")
    first = F.floor(F.col("_n") * F.lit(train))
    second = F.floor(F.col("_n") * F.lit(round(train + val, 9)))
    return ranked.withColumn("split", F.when(F.col("_r") <= first, "train").when(F.col("_r") <= second, "val")
                             .otherwise("test")).drop("_r", "_n")


def query_split(labels: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(query_id, split) for every query with labels; a query is in exactly one split."""
    return stratified_split(labels.select("query_id").distinct(), [], train, val, seed, ["query_id"])


def sample_n(df: DataFrame, n: int, seed: int = 42, ids: Sequence[str] = ("product_id",)) -> DataFrame:
    """Exactly n rows, or all when there are fewer; every task forwards n rows at most."""
    order = [hash_order(seed, *ids), *[F.col(i) for i in ids]]
    return df.orderBy(*order).limit(n)


def holdout(df: DataFrame, share: float = 0.1, seed: int = 42, ids: Sequence[str] = ("product_id",)) -> DataFrame:
    """Column `is_val`: the first int(share n) rows of the shuffle."""
    ranked = shuffled_rank(df, [], seed, ids, "_r", "_n")
    return ranked.withColumn("is_val", F.col("_r") <= F.floor(F.col("_n") * F.lit(share))).drop("_r", "_n")


def sample_negatives(labels: DataFrame, products: DataFrame, seed: int = 42) -> DataFrame:
    """(query_id, pos_product_id, neg_product_id): one drawn Irrelevant product per positive pair.

    Negatives are numbered per query and positives draw a number, so no query is collected.
    """
    known = written(labels.join(products.select("product_id"), "product_id", "left_semi").select("query_id", "product_id", "label"), "known")
    negatives = written(shuffled_rank(known.filter(F.col("label") == "Irrelevant").select("query_id", "product_id"),
                                      ["query_id"], seed, ["query_id", "product_id"], "_i", "_n"), "negatives")
    sizes = negatives.groupBy("query_id").agg(F.max("_n").alias("_n"))
    positives = known.filter(F.col("label").isin("Exact", "Partial")).select("query_id", "product_id").join(sizes, "query_id")
    drawn = positives.withColumn("_i", F.pmod(hash_long(seed, "neg", F.concat_ws(
        ":", F.col("query_id").cast("string"), F.col("product_id").cast("string"))), F.col("_n")) + 1)
    return drawn.join(negatives.select("query_id", F.col("product_id").alias("neg_product_id"), "_i"), ["query_id", "_i"]).select(
        "query_id", F.col("product_id").alias("pos_product_id"), "neg_product_id")


def search_datasets(labels: DataFrame, queries: DataFrame, products: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """Triplets, scored pairs (train/val), graded test pairs and the corpus."""
    split = query_split(labels, seed=seed)
    tagged = labels.join(split, "query_id")
    texts = product_texts(products).filter(F.col("product_text") != "")
    train = tagged.filter(F.col("split") == "train")
    pos = texts.select(F.col("product_id").alias("pos_product_id"), F.col("product_text").alias("positive"))
    neg = texts.select(F.col("product_id").alias("neg_product_id"), F.col("product_text").alias("negative"))
    triplets = sample_negatives(train, texts, seed).join(queries.select("query_id", "query"), "query_id").join(
        pos, "pos_product_id").join(neg, "neg_product_id").select(
        "query", "positive", "negative", "query_id", "pos_product_id", "neg_product_id")

    def pairs(name: str) -> DataFrame:
        return relevance_pairs(tagged.filter(F.col("split") == name).drop("split"), queries, products)
    test = relevance_pairs(tagged.filter(F.col("split") == "test").drop("split"), queries, products, training=False)
    return {"triplets": triplets, "pairs_train": pairs("train"), "pairs_val": pairs("val"), "test": test,
            "corpus": product_texts(products)}


def balance_labels(pairs: DataFrame, rates: dict[str, float], seed: int = 42,
                   ids: Sequence[str] = ("query_id", "product_id")) -> DataFrame:
    """Repeat or thin rows per label: rate 2.5 gives two copies and a third with chance one half."""
    table = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(float(v)))])
    rate = F.coalesce(F.try_element_at(table, F.col("label")), F.lit(1.0))
    whole = F.floor(rate).cast("int")
    key = F.concat_ws(":", *[F.col(i).cast("string") for i in ids])
    copies = whole + (hash_uniform(seed, "rate", key) < rate - whole).cast("int")
    return pairs.withColumn("_n", copies).filter(F.col("_n") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def majority_label(labels: DataFrame) -> DataFrame:
    """Duplicate (query, product) judgements collapse to the most frequent label, ties to the higher relevance."""
    rel = F.try_element_at(F.create_map(*[x for k, v in lx.RELEVANCE.items() for x in (F.lit(k), F.lit(v))]), F.col("label"))
    votes = labels.groupBy("query_id", "product_id", "label").agg(F.count("*").alias("_n"))
    return votes.groupBy("query_id", "product_id").agg(
        F.max_by("label", F.struct(F.col("_n"), rel)).alias("label"), F.sum("_n").alias("votes"))
