"""The relational operators as functions on DataFrames, for those who build plans without SQL text.

Each is a declaration: Spark chooses how to carry it out. What Spark has no word for are the two that keep the *first* of equal
rows: they aggregate with ``min_by`` over a stated order, which combines before the shuffle, where a window would not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalar import truth


def scan(spark: SparkSession, path: str, columns: Sequence[str] = (), where: str | None = None) -> DataFrame:
    """A Parquet table; the columns and the condition reach the files."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def keep(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is true as MySQL sees it: numbers other than 0, text that isn't empty."""
    return df.where(truth(f"({condition})"))


def project(df: DataFrame, **columns: str | Column) -> DataFrame:
    return df.select(*((F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """inner, left, right, full, cross, left_semi or left_anti; on: a condition or common columns."""
    if how == "cross":
        return left.crossJoin(right)
    return left.join(right, F.expr(on) if isinstance(on, str) else on, how)


def aggregate(df: DataFrame, by: Sequence[str], **what: str) -> DataFrame:
    """Groups by expressions; without any, one row even of no rows."""
    made = [F.expr(x).alias(n) for n, x in what.items()]
    return df.groupBy(*map(F.expr, by)).agg(*made) if by else df.agg(*made)


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """By expressions, each with DESC after it or not; NULL is lowest."""
    return df.orderBy(*(F.expr(k[:-5]).desc() if k.upper().endswith(" DESC") else F.expr(k).asc() for k in keys))


def page(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(count) if offset else df.limit(count)


def top(df: DataFrame, count: int, *keys: str) -> DataFrame:
    """Spark keeps so many rows of each partition only."""
    return ordered(df, *keys).limit(count)


def union(first: DataFrame, *others: DataFrame, distinct: bool = False) -> DataFrame:
    """By position, with the first one's names."""
    for o in others:
        first = first.union(o)
    return first.distinct() if distinct else first


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Written once and read back: later plans start here, also if executors are lost."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def windowed(df: DataFrame, partition: Sequence[str], order: Sequence[str], **what: str) -> DataFrame:
    w = Window.partitionBy(*map(F.expr, partition))
    w = w.orderBy(*(F.expr(k[:-5]).desc() if k.upper().endswith(" DESC") else F.expr(k).asc() for k in order)) if order else w
    return df.select("*", *(F.expr(x).over(w).alias(n) for n, x in what.items()))


def _first(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    whole = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.expr(order)).alias("row")
    return df.groupBy(*keys).agg(whole).select("row.*")


def distinct_first(df: DataFrame, keys: Sequence[str], order: str, ignore_case: bool = True) -> DataFrame:
    """Of rows with equal keys, whatever their case, the one that comes first: its spelling stands for the group."""
    kinds = {f.name: f.dataType for f in df.schema}
    fold: Callable[[str], Column] = lambda k: F.lower(F.col(k)) if ignore_case and isinstance(kinds[k], T.StringType) else F.col(k)
    return _first(df, [fold(k).alias(f"_key{n}") for n, k in enumerate(keys)], order)


def first_match(candidates: DataFrame, target: Sequence[str], order: str) -> DataFrame:
    """One change for each target row: its first candidate."""
    return _first(candidates, [F.col(k).alias(f"_key{n}") for n, k in enumerate(target)], order)
