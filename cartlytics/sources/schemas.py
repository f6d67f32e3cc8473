"""Fixed schemas of the domain relations (SRC1/SRC2, PRF2).

CSV input is never type-inferred: inference costs a full extra scan and can
change between files.  Timestamps are naive (TIMESTAMP_NTZ).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS, _DT = T.TimestampNTZType(), T.DateType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        ("customer_id", _S), ("customer_unique_id", _S),
        ("customer_zip_code_prefix", _I), ("customer_city", _S), ("customer_state", _S)),
    "orders": _schema(
        ("order_id", _S), ("customer_id", _S), ("order_status", _S),
        ("order_purchase_timestamp", _TS), ("order_approved_at", _TS),
        ("order_delivered_carrier_date", _TS), ("order_delivered_customer_date", _TS),
        ("order_estimated_delivery_date", _TS)),
    "order_items": _schema(
        ("order_id", _S), ("order_item_id", _I), ("product_id", _S), ("seller_id", _S),
        ("shipping_limit_date", _TS), ("price", _D), ("freight_value", _D)),
    "ab_users_data": _schema(
        ("user_id", _L), ("order_id", _L), ("action", _S), ("time", _TS),
        ("date", _DT), ("group", _I)),
    "ab_orders": _schema(
        ("order_id", _L), ("creation_time", _TS), ("product_ids", _S)),
    "ab_products": _schema(
        ("product_id", _L), ("name", _S), ("price", _D)),
}


#: The driver's tables that the library reads.
TEST_TABLES: dict[str, T.StructType] = {
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D), ("c_mktsegment", _S)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I), ("l_extendedprice", _D), ("l_shipdate", _TS)),
    "part": _schema(("p_partkey", _L), ("p_retailprice", _D)),
}


def fits(column: str, want: T.DataType, got: T.DataType) -> bool:
    """Id columns may be string or integral, numbers of any width, dates may stand for times; all else as fixed."""
    if column.endswith("_id") or column == "group":
        return isinstance(got, (T.StringType, T.IntegralType))
    if isinstance(want, (T.TimestampNTZType, T.TimestampType)):
        return isinstance(got, (T.TimestampNTZType, T.TimestampType, T.DateType))
    if isinstance(want, T.DoubleType):
        return isinstance(got, T.NumericType)
    return type(got) is type(want)


def _verdicts(got: T.StructType, want: T.StructType, require: list[str] | None) -> list[tuple[str, str | None, str | None, str]]:
    """(column, wanted, found, verdict) of every column of either schema."""
    expected, actual = {f.name: f.dataType for f in want.fields}, {f.name: f.dataType for f in got.fields}
    out = []
    for c in require or list(expected):
        found = actual.get(c)
        verdict = "missing" if found is None else "ok" if fits(c, expected[c], found) else "wrong type"
        out.append((c, expected[c].simpleString(), found and found.simpleString(), verdict))
    return out + [(c, None, t.simpleString(), "extra") for c, t in actual.items() if c not in expected]


def schema_report(given: dict[str, DataFrame | list[T.StructType]], schemas: dict[str, T.StructType] = SCHEMAS, require: dict[str, list[str]] | None = None) -> DataFrame:
    """PRF2: rows (table, column, wanted, found, files, verdict); verdict is ok, wrong type, missing or extra.

    ``given``: a frame for each table, or the schemas of its files (``file_schemas``); files with the
    same type for a column are one row, so that files that disagree show as several."""
    counted: dict[tuple, int] = {}
    spark = None
    for table, found in given.items():
        schemas_of = found if isinstance(found, list) else [found.schema]
        spark = spark or (None if isinstance(found, list) else found.sparkSession)
        for got in schemas_of:
            for row in _verdicts(got, schemas[table], (require or {}).get(table)):
                counted[(table, *row)] = counted.get((table, *row), 0) + 1
    spark = spark or SparkSession.getActiveSession()
    rows = [(t, c, w, g, n, v) for (t, c, w, g, v), n in counted.items()]
    return spark.createDataFrame(rows, "table string, column string, wanted string, found string, files long, verdict string")


def file_schemas(spark: SparkSession, path: str) -> list[T.StructType]:
    """The schema of each Parquet file below a path, from its footer."""
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").toLocalIterator()]
    return [spark.read.parquet(f).schema for f in files]


def check_schema(df: DataFrame, name: str, require: list[str] | None = None) -> list[str]:
    """PRF2 as a list of problems; ``require`` restricts the check to the columns an operator uses."""
    out = []
    for column, wanted, found, verdict in _verdicts(df.schema, SCHEMAS[name], require):
        if verdict == "missing":
            out.append(f"{name}: missing column {column}")
        elif verdict == "wrong type":
            out.append(f"{name}.{column}: expected {wanted}, got {found}")
    return out
