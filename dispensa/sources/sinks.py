"""Sinks: CSV report export (A3) and JSON result export (A4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, headers: Sequence[str] | None = None, single_file: bool = False) -> None:
    """A3: every field quoted, ``"`` doubled, CRLF line ends, a header row.

    Values are written as displayed (cast to text first).  ``single_file``
    coalesces to one file for a report download (only for small reports);
    otherwise each partition writes its own part file in parallel.
    """
    names = list(headers) if headers else df.columns
    out = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(df.columns, names)])
    if single_file:
        out = out.coalesce(1)
    (out.write.mode("error").option("header", True).option("quoteAll", True).option("quote", '"')
        .option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path))


def read_csv_export(spark, path: str) -> DataFrame:
    """Read back an ``export_csv`` folder (all columns as text)."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("lineSep", "\r\n").option("multiLine", True).csv(path))


def export_json(df: DataFrame, path: str) -> None:
    """A4: result rows as JSON lines, non-ASCII text left unescaped; null
    fields are written."""
    df.write.mode("error").option("ignoreNullFields", False).json(path)
