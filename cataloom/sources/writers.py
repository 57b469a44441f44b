"""Writers of data sets, tables, vocabularies and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """JSON lines, one folder per partition value; null fields are left out."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_vocab(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vocabulary rows (kind, value, n, idx), one folder per kind."""
    vocab.write.mode(mode).partitionBy("kind").parquet(path)


def write_report_tables(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Small report tables as one JSON file each under `path/<name>`."""
    for name, df in tables.items():
        df.coalesce(1).write.mode(mode).json(f"{path}/{name}")
