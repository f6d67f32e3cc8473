"""Tables laid out once for many joins (JN1, JN2): bucketed and sorted by a key.

``colocated`` writes a frame as ``buckets`` hash buckets by its key, each bucket one sorted file in the shared folder, and registers it in the
session's catalog.  Frames laid out by the same key and number of buckets are joined and aggregated by it
without an exchange: bucket i of one only meets bucket i of the other.  The write shuffles each frame once; every
later job saves that shuffle.

Give as many buckets as partitions that the larger table should have.  A key that holds a large share of all rows makes a large bucket, since
equal keys must share one: join such frames with ``plans.skew`` instead (``frequent_keys`` finds them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cartlytics.session import shared_folder


def layout_name(table: str, origin: str, keys: Sequence[str], buckets: int) -> str:
    """The catalog name of a table's layout: one for each origin (such as a folder), key and number of buckets."""
    mark = hashlib.md5("|".join([origin, *keys, str(buckets)]).encode()).hexdigest()[:12]
    return f"cartlytics_{table}_{mark}"


def colocated(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` as the catalog table ``name``, bucketed and sorted by ``keys``; written if the session does not have it yet."""
    spark: SparkSession = df.sparkSession
    if not spark.catalog.tableExists(name):
        (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
         .option("path", f"{shared_folder(spark)}/{name}").mode("overwrite").saveAsTable(name))
    return spark.table(name)
