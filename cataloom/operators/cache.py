"""Cache of predictions as a bucketed table: look-ups and appends without shuffling what is already there.

Rows are dealt to buckets by their key when they are written. A catalog bucketed alike meets the cache bucket by
bucket; any other catalog is shuffled alone. Appends add files to the buckets; the last write of a key counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .extend import RESULT, Extractor


def bucketed_table(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int) -> None:
    """Declare the table over the files of `path`, which may be empty or hold what an earlier session wrote."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")


def append_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Add rows, one task and one file per bucket; a bucket of a hot key is a large file, which is written as a stream."""
    spark = df.sparkSession
    df.select(*spark.table(name).columns).repartition(buckets, key).write.insertInto(name)


def latest_rows(stored: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest `order` of every key, counted inside the buckets."""
    rest = [c for c in stored.columns if c != key]
    return stored.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


class PredictionCache:
    """Predictions by `product_id`, kept in `buckets` buckets under `path`, for this session and later ones.

    `prediction` is the struct type of the predictions. Rows without an id cannot be looked up and are not kept, neither
    are failed ones, so these are tried again.
    """

    KEY = "product_id"

    def __init__(self, spark: SparkSession, name: str, path: str, prediction: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        bucketed_table(spark, name, path, f"product_id long, prediction {prediction}, latency_ms double, model string, batch long", self.KEY, buckets)

    def rows(self) -> DataFrame:
        return latest_rows(self.spark.table(self.name), self.KEY, "batch")

    def missing(self, products: DataFrame) -> DataFrame:
        """Products without a prediction; the cache is read in its buckets and never exchanged."""
        return products.join(self.spark.table(self.name).select(self.KEY).hint("merge"), self.KEY, "left_anti")

    def hits(self, products: DataFrame) -> DataFrame:
        """Cached predictions of the products that have one."""
        return self.rows().hint("merge").join(products.select(self.KEY).distinct(), self.KEY)

    def append(self, predictions: DataFrame) -> None:
        """Keep the successful rows of (product_id, prediction, latency_ms, model, error)."""
        last = self.spark.table(self.name).agg(F.max("batch")).first()[0]  # one row
        good = predictions.where("error IS NULL AND prediction IS NOT NULL AND product_id IS NOT NULL")
        append_bucketed(good.withColumn("batch", F.lit((last or 0) + 1).cast("long")), self.name, self.KEY, self.buckets)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.spark.table(self.name).schema).write.insertInto(self.name, overwrite=True)


def cached_extraction(products: DataFrame, extractor: Extractor, cache: PredictionCache) -> DataFrame:
    """Predictions of all products (columns RESULT): cached ones as they are, the others made once, stored and added to the cache."""
    done = written(cache.hits(products).select("product_id", "prediction", "latency_ms", "model"), "hits")
    fresh = extractor(cache.missing(products))
    fields = cache.spark.table(cache.name).schema["prediction"].dataType.names
    made = written(fresh.select("product_id", F.when(F.col("error").isNull(), F.struct(*fields)).alias("prediction"), "latency_ms",
                                F.lit(extractor.name).alias("model"), "error"), "predictions")
    cache.append(made)
    return made.withColumn("cached", F.lit(False)).select(*RESULT).unionByName(
        done.withColumns({"error": F.lit(None).cast("string"), "cached": F.lit(True)}).select(*RESULT))
