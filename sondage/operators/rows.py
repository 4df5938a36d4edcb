"""Whole rows: completeness and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col


def completeness(df: DataFrame) -> DataFrame:
    """Least, largest and mean share of columns with a value (4 decimals); null without rows."""
    share = sum((F.when(col(c).isNotNull(), 1).otherwise(0) for c in df.columns), F.lit(0)) / F.lit(max(len(df.columns), 1))
    return df.agg(F.round(F.min(share), 4).alias("row_completeness_min"), F.round(F.max(share), 4).alias("row_completeness_max"), F.round(F.avg(share), 4).alias("row_completeness_mean"))


def duplicates(df: DataFrame, most_columns: int = 50) -> DataFrame:
    """duplicate_row_count (rows beyond the first of their kind) and duplicate_rate; 0 for wider tables.

    Rows are grouped by 128 bits of hashes, so that the shuffle holds no values.
    """
    if len(df.columns) > most_columns or not df.columns:
        return df.limit(0).agg(F.lit(0).cast("long").alias("duplicate_row_count"), F.lit(0.0).alias("duplicate_rate"))
    values = [F.to_json(col(c)) if f.dataType.simpleString().startswith(("map", "variant")) else col(c) for c, f in zip(df.columns, df.schema.fields)]
    # hashing passes over nulls, so their places are hashed as well
    nulls = [sum((F.when(col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(df.columns[at : at + 60])), F.lit(0).cast("long")) for at in range(0, len(df.columns), 60)]
    groups = df.groupBy(F.xxhash64(*nulls, *values).alias("h1"), F.xxhash64(F.lit(1), *nulls, *values).alias("h2")).agg(F.count("*").alias("n"))
    extra, rows = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(extra.alias("duplicate_row_count"), F.coalesce(F.try_divide(extra, rows), F.lit(0.0)).alias("duplicate_rate"))
