"""Parquet scans (SRC3); CSV files are read by ``csv_files``.  Sinks are the caller's ``df.write``: the reference only
displays results, so there is no sink operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _nan_to_null(df: DataFrame) -> DataFrame:
    fixes = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
             for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes) if fixes else df


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """SRC3: one parquet table of the driver's test data, NaN read as NULL."""
    return _nan_to_null(spark.read.parquet(table_path(sf_dir, table)))


def table_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"
