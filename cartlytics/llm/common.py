"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlytics.session import materialise, release, shared_folder  # noqa: F401


def ship(module: str) -> None:
    """Pickle the functions of ``module`` by value, so that executors need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` records, so that a worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that begin with ``stems`` and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


class WordIds(dict):
    """word -> unsigned 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        import xxhash

        self.limit, self.hash = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.hash(word.encode("utf-8", "surrogatepass"))
        return value

    def array(self, words: list[str]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x):
    """Finaliser of a 64-bit multiplicative hash, on a numpy array of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def per_process(name: str, make):
    """``make()``, once for each Python worker process: tasks that run in it later find the same
    object.  Kept in a module of its own, as shipped functions have no lasting globals."""
    import types

    kept = sys.modules.setdefault("_cartlytics_kept", types.ModuleType("_cartlytics_kept"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)
