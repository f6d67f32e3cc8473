"""CSV scans by header names (SRC1, SRC2), with a quarantine.

The header says where each column is: the cells are read as text by name, and cast to the relation's fixed types with
``try_cast``.  Columns may stand in any order; columns that the relation does not have (an exported index without a name, too)
are left out; columns that the file does not have are NULL.  No type is inferred.

A row is bad if a cell is neither a token for a missing value nor of its column's type, or if the line does not have as many
cells as the header.  ``read_csv_table`` is lazy and keeps bad rows with NULL in the bad cells.  ``load_csv_table`` reads
the files once, writes one table to the shared folder, and gives three views of it: the good rows, the quarantine (each bad line
once, with its file and the names of its bad columns), and the counts, which ``DataFrame.observe`` took in that same pass.

All files of one path have one header; a file with another one is an error, never a row of wrong values.  Several paths, or
``align_files``, have a header each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlytics.session import materialise
from cartlytics.sources.schemas import SCHEMAS

# The texts that stand for a missing value, as the common data-frame readers have them.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
               "None", "n/a", "nan", "null")
SHAPE = "_cells"  # the fault of a line with too many or too few cells


@dataclass
class CsvLoad:
    rows: DataFrame        # the relation's columns, good rows only
    quarantine: DataFrame  # file, line, faults
    counts: DataFrame      # column, bad_cells; _rows and _bad_rows are totals


def _reader(spark: SparkSession, sep: str, multi_line: bool):
    return spark.read.option("sep", sep).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")


def header_of(spark: SparkSession, path, sep: str = ",", multi_line: bool = False) -> list[str]:
    """The cells of the first line."""
    first = _reader(spark, sep, multi_line).option("header", False).csv(path).head(1)
    if not first:
        raise ValueError(f"{path}: no header line")
    names = [(c or "").strip().lstrip("﻿") for c in first[0]]
    named = [n.lower() for n in names if n]
    if len(named) != len(set(named)):
        raise ValueError(f"{path}: a column name stands twice in the header")
    return names


def files_by_header(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> dict[tuple[str, ...], list[str]]:
    """The files below a path, by header.  Only names and first lines are read; one small job a file."""
    out: dict[tuple[str, ...], list[str]] = {}
    for row in spark.read.format("binaryFile").load(path).select("path").orderBy("path").toLocalIterator():
        out.setdefault(tuple(header_of(spark, row["path"], sep, multi_line)), []).append(row["path"])
    return out


def cast_cell(raw: Column, wanted: T.DataType, timestamp_format: str) -> Column:
    """The cell as its type, NULL if it is not of it."""
    cell = F.trim(raw)
    if isinstance(wanted, T.StringType):
        return raw
    if isinstance(wanted, T.IntegralType):
        number = cell.try_cast("double")
        whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0 ** 53), number)  # 3.0, as files with missing numbers have it
        return F.coalesce(cell.try_cast(wanted), whole.try_cast(wanted))
    if isinstance(wanted, T.TimestampNTZType):
        return F.coalesce(F.try_to_timestamp(cell, F.lit(timestamp_format)).cast("timestamp_ntz"), cell.try_cast("timestamp_ntz"))
    if isinstance(wanted, (T.DoubleType, T.FloatType)):
        number = cell.try_cast(wanted)
        return F.when(~F.isnan(number), number)
    return cell.try_cast(wanted)


def _tagged(spark: SparkSession, path, header: Sequence[str], schema: T.StructType, timestamp_format: str, null_tokens: Sequence[str],
            sep: str, multi_line: bool) -> DataFrame:
    """The relation's columns, and _file, _line (of bad rows), _faults."""
    cells = [f"c{i}" for i in range(len(header))]
    raw_schema = T.StructType([*[T.StructField(c, T.StringType()) for c in cells], T.StructField("_corrupt", T.StringType())])
    # a row that repeats the header is one: the header line of each file is read as a row and then left out
    raw = _reader(spark, sep, multi_line).option("header", False).option("columnPruning", False).option("columnNameOfCorruptRecord", "_corrupt").schema(raw_schema).csv(path)
    is_header = F.lit(True)
    for c, n in zip(cells, header, strict=True):
        is_header = is_header & (F.ltrim(F.coalesce(F.trim(c), F.lit(""))) == n if n else F.coalesce(F.trim(c), F.lit("")).isin("", "﻿"))
    other = F.lit(0)
    for c in cells:
        other = other + F.coalesce(F.trim(c).isin([n for n in header if n]).cast("int"), F.lit(0))
    # the names of the header in another order: a file with a header of its own
    strange = ~is_header & (other >= max(2, sum(1 for n in header if n)))
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"))
    error = F.raise_error(F.concat(F.lit("another header in "), F.col("_file"))).cast("boolean")
    raw = raw.where(F.when(strange, error).otherwise(~F.coalesce(is_header, F.lit(False))))
    at = {n.lower(): c for n, c in zip(header, cells, strict=True) if n}
    values, faults = [], []
    for f in schema.fields:
        cell = at.get(f.name.lower())
        if cell is None:
            values.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        given = F.when(~F.trim(cell).isin(list(null_tokens)), F.col(cell))
        typed = cast_cell(given, f.dataType, timestamp_format)
        values.append(typed.cast(f.dataType).alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            faults.append(F.when(given.isNotNull() & typed.isNull(), F.lit(f.name)))
    line = F.coalesce("_corrupt", F.to_csv(F.struct(*[F.col(c) for c in cells]), {"sep": sep}))
    # a line of another length says nothing about its cells
    found = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit(SHAPE))).otherwise(F.array_compact(F.array(*faults).cast("array<string>")))
    out = raw.select(*values, "_file", line.alias("_line"), found.alias("_faults"))
    return out.withColumn("_line", F.when(F.size("_faults") > 0, F.col("_line")))


def _scan(spark: SparkSession, paths, name: str, timestamp_format: str, null_tokens: Sequence[str], require: Sequence[str],
          sep: str, multi_line: bool, align_files: bool) -> DataFrame:
    schema, parts = SCHEMAS[name], []
    for path in [paths] if isinstance(paths, str) else list(paths):
        groups = files_by_header(spark, path, sep, multi_line) if align_files else {tuple(header_of(spark, path, sep, multi_line)): path}
        for header, files in groups.items():
            lacking = sorted(set(require) - {h.lower() for h in header})
            if lacking:
                raise ValueError(f"{name}: {files} lacks {', '.join(lacking)}")
            parts.append(_tagged(spark, files, header, schema, timestamp_format, null_tokens, sep, multi_line))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_csv_table(spark: SparkSession, path, name: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss", keep_corrupt: bool = False,
                   null_tokens: Sequence[str] = NULL_TOKENS, require: Sequence[str] = (), sep: str = ",", multi_line: bool = False,
                   align_files: bool = False) -> DataFrame:
    """SRC1/SRC2: the relation ``name`` from CSV files with a header, lazily; bad cells are NULL, and with ``keep_corrupt`` the
    line of a bad row stays in ``_corrupt_record``.  ``require``: columns without which the scan is an error."""
    tagged = _scan(spark, path, name, timestamp_format, null_tokens, require, sep, multi_line, align_files)
    kept = [*SCHEMAS[name].names, *([F.col("_line").alias("_corrupt_record")] if keep_corrupt else [])]
    return tagged.select(*kept)


def load_csv_table(spark: SparkSession, path, name: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss", null_tokens: Sequence[str] = NULL_TOKENS,
                   require: Sequence[str] = (), sep: str = ",", multi_line: bool = False, align_files: bool = False) -> CsvLoad:
    """SRC1/SRC2 in one pass over the files: good rows, quarantine and counts (see the module)."""
    tagged = _scan(spark, path, name, timestamp_format, null_tokens, require, sep, multi_line, align_files)
    seen = Observation()
    columns = [SHAPE, *SCHEMAS[name].names]
    tagged = tagged.observe(seen, F.count(F.lit(1)).alias("_rows"), F.count_if(F.size("_faults") > 0).alias("_bad_rows"),
                            *[F.count_if(F.array_contains("_faults", c)).alias(c) for c in columns])
    written = materialise(tagged.withColumn("_bad", F.size("_faults") > 0))
    got = seen.get
    counts = spark.createDataFrame([(c, int(got[c])) for c in ["_rows", "_bad_rows", *columns]], "column string, bad_cells long")
    return CsvLoad(rows=written.where(~F.col("_bad")).select(*SCHEMAS[name].names),
                   quarantine=written.where("_bad").select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_faults").alias("faults")),
                   counts=counts)
