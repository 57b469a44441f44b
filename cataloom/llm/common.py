"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import fresh_path


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def releasing(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function `fn`, giving its memory back when the task ends."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            release()
    return run


_MADE: list[str] = []  # tables written by `kept` in this driver


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a result once to the folder that all executors share and read it back: the lineage ends
    there, so that a lost executor costs one task and not the whole chain. `forget_since` removes such tables."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _MADE.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def made_so_far() -> int:
    return len(_MADE)


def forget_since(spark: SparkSession, mark: int, *spare: DataFrame) -> None:
    """Remove the tables that `kept` wrote after `mark` (`made_so_far`) but for the spared ones. Call it when what was
    computed from them is stored itself."""
    held = {df.kept_path for df in spare}
    gone = [p for p in _MADE[mark:] if p not in held]
    for p in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _MADE[mark:] = [p for p in _MADE[mark:] if p in held]


MARKS = 1 << 24  # bits, whatever the table


def marked_rows(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows of `df` whose keys may be in the stored table `wanted`, by a bitmap of fixed size that is sent to them (at
    most 2**18 words): all that are in it and few others while it is small beside the bitmap. For a join that follows."""
    mark = F.pmod(F.xxhash64(*keys), F.lit(MARKS))
    words = wanted.select(mark.alias("__mark")).groupBy(F.expr("shiftright(__mark, 6)").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, int(__mark % 64)))").alias("__bits"))
    marked = df.withColumn("__mark", mark).join(F.broadcast(words), F.expr("shiftright(__mark, 6) = __word"))
    return marked.where("bit_get(__bits, int(__mark % 64)) = 1").select(*df.columns)


def map_batches(df: DataFrame, fn: Callable[[list[list]], list[list]], columns: list[str], schema: str, rows: int = 2_000) -> DataFrame:
    """Apply `fn` to lists of column values, at most `rows` rows at a time; it returns the output columns as lists."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, out.types)], schema=out)

    return df.select(*columns).mapInArrow(releasing(run), schema)


def by_size(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of parts of a batch whose rows have about `most` of the given sizes together (null: 0); a larger
    row is a part of its own."""
    total = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, end - at
        at = end


def salts_for(rows: int, per_salt: int = 50_000) -> int:
    """How many parts to deal a table into so that one part holds about `per_salt` rows of any key."""
    return max(1, -(-rows // per_salt))


def rank_within(df: DataFrame, key: str, order: list[str], rows: int, name: str = "rank", per_salt: int = 50_000) -> DataFrame:
    """Number the rows of every key from 0 without gaps; a key of any size is dealt over salts, ranked inside
    them and shifted by the sizes of the salts before. `df` must be stored, since it is read twice."""
    from pyspark.sql import Window
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts_for(rows, per_salt))))
    sizes = salted.groupBy(key, "__salt").count()
    before = sizes.withColumn("__before", F.sum("count").over(Window.partitionBy(key).orderBy("__salt")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order))
    return (salted.withColumn("__inside", inside).join(before, [key, "__salt"])
            .withColumn(name, F.col("__before") + F.col("__inside") - 1).drop("__salt", "__before", "__inside"))
