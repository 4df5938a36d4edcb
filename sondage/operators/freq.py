"""Frequency tables of columns, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, union
from ..types import KEYED, columns_of


def table(df: DataFrame, column: str) -> DataFrame:
    """column_name, value (string), freq of the values that are not null; grouped in the column's own type."""
    grouped = df.where(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(F.count("*").alias("freq"))
    return grouped.select(F.lit(column).alias("column_name"), F.col("v").cast("string").alias("value"), "freq")


def tables(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return union([table(df, c) for c in (columns_of(df.schema, *KEYED) if columns is None else columns)])


def grouped(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The frequency tables of all columns from one pass: column_name, value (string), freq. Cache it to use it often."""
    columns = columns_of(df.schema, *KEYED) if columns is None else columns
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    counted = df.select(F.inline(cells)).where("value is not null").groupBy("i", "value").agg(F.count("*").alias("freq"))
    return counted.select(F.array(*[F.lit(c) for c in columns])[F.col("i")].alias("column_name"), "value", "freq")


def distinct_of(frequencies: DataFrame) -> DataFrame:
    """distinct_values, unique_count (values that occur once), their ratio and top_frequency of frequency tables."""
    ratio = F.when(F.col("distinct_values") > 0, F.round(F.try_divide("unique_count", "distinct_values"), 6))
    found = frequencies.groupBy("column_name").agg(F.count("*").alias("distinct_values"), F.count_if(F.col("freq") == 1).alias("unique_count"), F.max("freq").alias("top_frequency"))
    return found.select("column_name", "distinct_values", "unique_count", ratio.alias("uniqueness_ratio"), "top_frequency")


def ranked_of(frequencies: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """column_name, rank, value, freq: the k most (or least) frequent values; ties go to the smaller value as a string."""
    w = Window.partitionBy("column_name").orderBy(F.desc("freq") if descending else F.asc("freq"), "value")
    # the planner keeps k rows a column in every task before they are shuffled
    return frequencies.select("column_name", F.row_number().over(w).alias("rank"), "value", "freq").where(F.col("rank") <= k)


def exact_distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """distinct_values, unique_count (values that occur once) and their ratio, top_frequency."""
    columns = columns_of(df.schema, *KEYED) if columns is None else columns
    none = F.struct(F.lit(0).cast("long").alias("distinct_values"), F.lit(0).cast("long").alias("unique_count"), F.lit(None).cast("double").alias("uniqueness_ratio"), F.lit(None).cast("long").alias("top_frequency"))
    found = distinct_of(grouped(df, columns))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    out = names.join(F.broadcast(found), "column_name", "left")
    return out.select("column_name", *[F.coalesce(c, none[c]).alias(c) for c in ("distinct_values", "unique_count", "uniqueness_ratio", "top_frequency")])


def keys(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """distinct_ratio and pk_candidate: no null, and distinct values for 99 of 100 rows."""
    columns = columns_of(df.schema, *KEYED) if columns is None else columns
    parts = []
    for c in columns:
        groups = df.groupBy(col(c).alias("v")).agg(F.count("*").alias("n"))
        parts.append(groups.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values")).select(F.lit(c).alias("column_name"), "*"))
    ratio = F.when(F.col("rows") > 0, F.round(F.try_divide("distinct_values", "rows"), 6)).otherwise(0.0)
    pk = (F.coalesce("rows", F.lit(0)) > 0) & (F.col("nulls") == 0) & (F.col("distinct_values") >= 0.99 * F.col("rows"))
    return union(parts).select("column_name", "distinct_values", ratio.alias("distinct_ratio"), F.coalesce(pk, F.lit(False)).alias("pk_candidate"))


def _ranked(df: DataFrame, columns: list[str] | None, k: int, descending: bool) -> DataFrame:
    columns = columns_of(df.schema, *KEYED) if columns is None else columns
    order = F.desc("freq") if descending else F.asc("freq")
    # each column's k first before the union, so that windows see few rows
    few = union([table(df, c).orderBy(order, "value").limit(k) for c in columns])
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(order, "value"))
    return few.select("column_name", rank.alias("rank"), "value", "freq")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values; ties go to the smaller value as a string."""
    return _ranked(df, columns, k, True)


def bottom_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The k least frequent values of columns with at least k distinct ones."""
    few = _ranked(df, columns, k, False)
    return few.withColumn("n", F.count("*").over(Window.partitionBy("column_name"))).where(F.col("n") >= k).drop("n")
