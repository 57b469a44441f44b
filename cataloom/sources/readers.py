"""Readers of catalogs, JSON data sets, manifests, embeddings and image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon as lx
from ..functions.text import let

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


CATALOG = fields(product_id=L, product_name=S, product_class=S, category_hierarchy=S, product_description=S,
                 product_features=S)
QUERIES = fields(query_id=L, query=S, query_class=S)
LABELS = fields(id=L, query_id=L, product_id=L, label=S)
QUEUE_ITEM = fields(product_id=S, product_name=S, product_class=S, taxonomy=T.ArrayType(S), taxonomy_depth=T.IntegerType(),
                    text_input=S, **{a: S for a in lx.SCHEMA2}, attr_score=D, tier=S)
MANIFEST_ENTRY = fields(product_name=S, image_count=T.IntegerType(), image_paths=T.ArrayType(S), source_url=S,
                        source_domain=S, timestamp=S, status=S)
CALL_LOG = fields(model=S, input_tokens=T.IntegerType(), output_tokens=T.IntegerType(), latency_ms=D, timestamp=D,
                  success=T.BooleanType(), error=S)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated file with a header; quotes may contain tabs and newlines."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"')
            .option("escape", '"').option("multiLine", True).csv(path))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, CATALOG)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, QUERIES)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, LABELS)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, on_bad: str = "fail") -> DataFrame:
    """JSON lines; a malformed line fails the read or is skipped (`on_bad="skip"`)."""
    return spark.read.schema(schema).option("mode", {"fail": "FAILFAST", "skip": "DROPMALFORMED"}[on_bad]).json(path)


def read_queue(spark: SparkSession, path: str, schema: T.StructType = QUEUE_ITEM) -> DataFrame:
    """One JSON array of products per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_manifest(spark: SparkSession, path: str, entry: T.StructType = MANIFEST_ENTRY) -> DataFrame:
    """One JSON object keyed by product id per file, turned to rows."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(S, entry))
    return text.select(F.explode(parsed).alias("product_id", "e")).select("product_id", "e.*")


def fill_missing_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.withColumn(vector, F.coalesce(F.col(vector).cast("array<float>"), zero))


def read_embeddings(spark: SparkSession, path: str, dim: int, vector: str = "embedding") -> DataFrame:
    """Parquet with an id and a vector; a missing vector reads as zeros."""
    return fill_missing_vectors(spark.read.parquet(path), vector, dim)


def is_image(content: Column, length: Column, limits: tuple[int, int] = lx.IMAGE_BYTES) -> Column:
    """Size within limits and the magic bytes of a JPEG, PNG, RIFF or GIF file."""
    head = F.hex(F.substring(content, 1, 8))
    magic = let(head, lambda h: F.exists(F.lit(lx.IMAGE_MAGIC), lambda m: F.startswith(h, m)))
    return length.between(*limits) & magic


def read_images_validated(spark: SparkSession, pattern: str, limits: tuple[int, int] = lx.IMAGE_BYTES) -> DataFrame:
    """Paths and sizes of the binary files that are images."""
    files = spark.read.format("binaryFile").load(pattern).filter(F.col("length").between(*limits))
    return files.filter(is_image(F.col("content"), F.col("length"), limits)).select("path", "length")
