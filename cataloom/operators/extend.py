"""Extension surface: plugging any extractor into the catalog job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.attributes import extract_attributes_v1
from .joins import skip_cached

RESULT = ["product_id", "prediction", "latency_ms", "model", "error", "cached"]


class Extractor(Protocol):
    """Turns product rows into rows with product_id, the seven attributes, latency_ms and error."""

    name: str

    def __call__(self, products: DataFrame) -> DataFrame: ...


class RuleExtractor:
    """Keyword votes as column expressions."""

    name = "rule-based"

    def __call__(self, products: DataFrame) -> DataFrame:
        out = extract_attributes_v1(products)
        flat = [F.array_join("room_type", ", ").alias(a) if a == "room_type" else F.col(a).cast("string").alias(a) for a in lx.SCHEMA1]
        return out.select("product_id", *flat, F.lit(None).cast("double").alias("latency_ms"), F.lit(None).cast("string").alias("error"))


class PythonExtractor:
    """Any Python model: `load()` runs once per task, `extract(model, row)` per product.

    An exception in one row gives that row an error message and no prediction.
    """

    def __init__(self, name: str, load: Callable[[], object], extract: Callable[[object, dict], dict]):
        self.name = name
        self.load = load
        self.extract = extract

    def __call__(self, products: DataFrame) -> DataFrame:
        load, extract, keys = self.load, self.extract, list(lx.SCHEMA1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for pdf in batches:
                rows = []
                for row in pdf.to_dict("records"):
                    started = time.perf_counter()
                    found, error = {}, None
                    try:
                        found = extract(model, row) or {}
                    except Exception as e:  # noqa: BLE001 - one bad product must not stop the job
                        error = f"{type(e).__name__}: {e}"
                    rows.append({"product_id": row["product_id"], **{a: None if found.get(a) is None else str(found[a]) for a in keys},
                                 "latency_ms": None if error else round((time.perf_counter() - started) * 1000, 1), "error": error})
                yield pd.DataFrame(rows, columns=["product_id", *keys, "latency_ms", "error"])
        schema = ", ".join(["product_id long", *[f"{a} string" for a in keys], "latency_ms double", "error string"])
        return products.mapInPandas(run, schema)


def run_extraction(products: DataFrame, extractor: Extractor, cache: DataFrame | None = None) -> DataFrame:
    """Predictions of all products; cached ones are returned as they are (columns RESULT)."""
    todo, done = (products, None) if cache is None else skip_cached(products, cache)
    fresh = extractor(todo).select(
        "product_id", F.when(F.col("error").isNull(), F.struct(*lx.SCHEMA1)).alias("prediction"), "latency_ms",
        F.lit(extractor.name).alias("model"), "error", F.lit(False).alias("cached"))
    return fresh if done is None else fresh.unionByName(done.withColumn("cached", F.lit(True)).select(*RESULT))
