"""A1 typed table scan.

``load`` reads one pharmacy table with its fixed schema, so that no type is
inferred and a column-pruned projection reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensa import model


def load(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read ``base/name`` (Parquet by default) with the table's declared schema."""
    schema = model.SCHEMAS[name]
    return spark.read.schema(schema).format(fmt).load(f"{base.rstrip('/')}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast and order the columns of ``df`` to the declared schema of ``name``.

    Missing nullable columns become typed nulls; extra columns are dropped.
    """
    schema = model.SCHEMAS[name]
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
