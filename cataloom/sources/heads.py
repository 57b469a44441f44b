"""Folders of objects of which only the first bytes are read.

A data source for image validation: sizes come from listings, size limits are pushed down to them, and of each
remaining object twelve bytes are fetched, enough for the magic numbers. A task lists and reads one folder, or one
part of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .. import lexicon as lx
from .readers import is_image

HEAD = 12
SCHEMA = pa.schema([("path", pa.string()), ("length", pa.int64()), ("head", pa.binary()), ("bytes_read", pa.int64())])
MOST = 2**63 - 1


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a plain local path."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class Folder(InputPartition):
    """The files of one folder whose name falls into one of `parts`."""

    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class HeadReader(DataSourceReader):
    """Reads heads of objects between the pushed-down sizes."""

    def __init__(self, uri: str, parts: int):
        self.uri, self.parts, self.low, self.high = uri, parts, 0, MOST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute == ("length",):
                continue  # every object has one
            if getattr(f, "attribute", None) != ("length",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThanOrEqual, LessThan)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Folders only: files are listed by the tasks."""
        system, root = located(self.uri)
        folders, found = [root], []
        while folders:
            folder = folders.pop()
            found.append(folder)
            folders += [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.Directory]
        return [Folder(f, p, self.parts) for f in sorted(found) for p in range(self.parts)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.uri)
        files = [i for i in system.get_file_info(fs.FileSelector(partition.path))
                 if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and zlib.crc32(i.base_name.encode()) % partition.parts == partition.part]
        wanted = sorted((i for i in files if self.low <= i.size <= self.high), key=lambda i: i.path)
        for at in range(0, len(wanted), 1_000):
            some = wanted[at:at + 1_000]
            heads = []
            for i in some:
                with system.open_input_file(i.path) as f:
                    heads.append(f.read_at(min(HEAD, i.size), 0))
            yield pa.RecordBatch.from_arrays([pa.array([i.path for i in some]), pa.array([i.size for i in some], pa.int64()), pa.array(heads, pa.binary()),
                                              pa.array([len(h) for h in heads], pa.int64())], schema=SCHEMA)


class ObjectHeads(DataSource):
    """Format `object_heads`: path, length, head (the first twelve bytes) and bytes_read of the files under a folder.

    Options: `path`, a folder or URI of a file system that all executors reach; `parts`, tasks per folder (default 1).
    """

    @classmethod
    def name(cls) -> str:
        return "object_heads"

    def schema(self) -> str:
        return "path string, length long, head binary, bytes_read long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeadReader(self.options["path"], int(self.options.get("parts", 1)))


def read_object_heads(spark: SparkSession, folder: str, limits: tuple[int, int] | None = None, parts: int = 1) -> DataFrame:
    """Heads of the objects under a folder; with `limits`, of those whose size lies within, and no other is opened."""
    spark.dataSource.register(ObjectHeads)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    heads = spark.read.format("object_heads").option("path", folder).option("parts", parts).load()
    return heads if limits is None else heads.where((F.col("length") >= limits[0]) & (F.col("length") <= limits[1]))


def read_image_heads(spark: SparkSession, folder: str, limits: tuple[int, int] = lx.IMAGE_BYTES, parts: int = 1) -> DataFrame:
    """Paths and sizes of the images under a folder: right size, right magic bytes. What an object weighs does not matter."""
    heads = read_object_heads(spark, folder, limits, parts)
    return heads.where(is_image(F.col("head"), F.col("length"), limits)).select("path", "length")


def write_objects(df: DataFrame, folder: str, name: str, content: str, folders: int = 16) -> DataFrame:
    """Write each row's bytes as an object `folder/<00..>/<name>`; returns (path, length) once read.

    Names are dealt over sub-folders by their hash; a name that stands twice is one object, and a task that runs again
    writes the same objects. A null content is an empty object, a null name is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        made: set[str] = set()
        for batch in batches:
            paths, sizes = [], []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n is None:
                    continue
                sub = f"{root}/{zlib.crc32(n.encode()) % folders:02d}"
                if sub not in made:
                    system.create_dir(sub, recursive=True)
                    made.add(sub)
                with system.open_output_stream(f"{sub}/{n}") as f:
                    f.write(c or b"")
                paths.append(f"{sub}/{n}")
                sizes.append(len(c or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])
    return df.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "path string, length long")
