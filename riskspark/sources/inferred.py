"""CSV files whose column types are found from their cells.

The cells are read as text and counted by form in one aggregation (partial
per task, one row in all): missing, whole number, other number, truth value.
From the counts follows the least type that holds every cell, by the rules
of the usual data frame tools:

* whole numbers only: ``bigint``; numbers: ``double``; truth values only:
  ``boolean``; anything else: ``string``.
* A blank cell or one of ``MISSING`` is NULL in every column.  Whole numbers
  with missing cells are ``double``, unless ``keep_int`` asks for a nullable
  ``bigint``; truth values with missing cells are ``string``.
* A column of missing cells only is ``double``; without any row ``string``.
* Whole numbers outside the range of ``bigint`` make a column ``string``.

Rows with too few or too many cells take no part; they are kept apart as
written (``bad_rows``).  A file whose header differs from the first is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "__raw_line"

# Cells that mean "missing".
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Cells that are truth values.
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
INT = r"^\s*[+-]?[0-9]+\s*$"
FLOAT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def _reader(spark: SparkSession):
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("encoding", "UTF-8").option("enforceSchema", False))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; a row of the wrong width stands as written in a last column."""
    names = _reader(spark).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RAW]])
    return _reader(spark).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).csv(path)


def _cells(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != RAW]


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _missing(column: str) -> Column:
    return _name(column).isNull() | _name(column).isin(*MISSING)


def _parted(raw: DataFrame, good: bool) -> DataFrame:
    """The rows of the right width, or the others.  Spark refuses a query of
    the line as written alone, so the first cell is always looked at."""
    looked_at = F.length(F.concat_ws("", _name(_cells(raw)[0]))) >= 0
    return raw.filter(looked_at & (F.col(RAW).isNull() if good else F.col(RAW).isNotNull()))


def column_kinds(raw: DataFrame, keep_int: bool = False) -> DataFrame:
    """(column, kind, n_rows, n_missing) of every column of ``read_raw``."""
    good = _parted(raw, True)
    counts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(_cells(raw)):
        cell, there = _name(c), ~_missing(c)
        whole = there & cell.rlike(INT)
        counts += [F.count_if(_missing(c)).alias(f"missing_{i}"),
                   F.count_if(whole & cell.try_cast("bigint").isNotNull()).alias(f"int_{i}"),
                   F.count_if(whole & cell.try_cast("bigint").isNull()).alias(f"big_{i}"),
                   F.count_if(there & cell.rlike(FLOAT)).alias(f"number_{i}"),
                   F.count_if(there & cell.isin(*TRUE, *FALSE)).alias(f"bool_{i}")]
    n = F.col("n")
    rows = []
    for i, c in enumerate(_cells(raw)):
        missing, present = F.col(f"missing_{i}"), n - F.col(f"missing_{i}")
        kind = (F.when(n == 0, "string").when(present == 0, "double")
                .when((F.col(f"bool_{i}") == n), "boolean")
                .when((F.col(f"int_{i}") == present) & (F.lit(keep_int) | (missing == 0)), "bigint")
                .when((F.col(f"number_{i}") == present) & (F.col(f"big_{i}") == 0), "double")
                .otherwise("string"))
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("kind"), n.alias("n_rows"), missing.alias("n_missing")))
    return good.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _typed(column: str, kind: str) -> Column:
    cell = F.when(~_missing(column), _name(column))
    if kind == "boolean":
        cell = cell.isin(*TRUE)
    elif kind != "string":
        cell = F.trim(cell).try_cast(kind)
    return cell.alias(column)


def read_inferred(spark: SparkSession, path: str, keep_int: bool = False) -> DataFrame:
    """The rows of the right width, every column in the type its cells have."""
    raw = read_raw(spark, path)
    kinds = {r["column"]: r["kind"] for r in column_kinds(raw, keep_int).collect()}     # a row per column
    return _parted(raw, True).select(*[_typed(c, kinds[c]) for c in _cells(raw)])


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line): the rows with too few or too many cells, as written."""
    return _parted(read_raw(spark, path), False).select(F.col(RAW).alias("line"))
