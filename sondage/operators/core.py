"""Aggregates of single columns, in long form: one row per column, from few jobs of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LARGEST_DOUBLE, col, count_where, day, long_form, union
from ..types import DATES, NUMERIC, ORDERED, columns_of

#: Metrics by canonical type; further ones can be added (name -> builder of a Column from a column name).
REGISTRY: dict[str, dict[str, object]] = {
    "numeric": {
        "mean": lambda c: F.avg(col(c).cast("double")),
        "sum": lambda c: F.sum(col(c).cast("double")),
        "zero_count": lambda c: count_where(col(c) == 0),
        "negative_count": lambda c: count_where(col(c) < 0),
        "infinite_count": lambda c: count_where(F.abs(col(c).cast("double")) > LARGEST_DOUBLE),
    },
    "string": {
        "min_length": lambda c: F.min(F.length(col(c))),
        "max_length": lambda c: F.max(F.length(col(c))),
        "avg_length": lambda c: F.avg(F.length(col(c))),
        "empty_count": lambda c: count_where(col(c) == ""),
        "whitespace_count": lambda c: count_where((F.length(col(c)) > 0) & (F.length(F.trim(col(c))) == 0)),
        "leading_trailing_whitespace_count": lambda c: count_where((col(c) != F.trim(col(c))) & (col(c) != "")),
    },
    "boolean": {"true_count": lambda c: F.sum(col(c).cast("int")).cast("long")},
}


def counts(df: DataFrame, columns: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """total_rows, non_null, null_count, null_rate (0 without rows) of columns of any type."""
    columns = df.columns if columns is None else columns
    out = long_form(df, columns, {"total_rows": lambda c: F.count(F.lit(1)), "non_null": lambda c: F.count(col(c))}, batch)
    nulls = F.col("total_rows") - F.col("non_null")
    return out.select("*", nulls.alias("null_count"), F.coalesce(F.try_divide(nulls, F.col("total_rows")), F.lit(0.0)).alias("null_rate"))


def extremes(df: DataFrame, columns: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """min and max as strings (of the values' own order), for types that have one."""
    columns = columns_of(df.schema, *ORDERED) if columns is None else columns
    return long_form(df, columns, {"min": lambda c: F.min(col(c)).cast("string"), "max": lambda c: F.max(col(c)).cast("string")}, batch)


def numeric(df: DataFrame, columns: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """min, max, mean, sum (double) and the counts of zeros, negatives and infinities (NaN included)."""
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    ends = {"min": lambda c: F.min(col(c)).cast("double"), "max": lambda c: F.max(col(c)).cast("double")}
    return long_form(df, columns, ends | REGISTRY["numeric"], batch)


def moments(df: DataFrame, columns: list[str] | None = None, bias_corrected: bool = False, batch: int | None = None) -> DataFrame:
    """stddev and variance of a sample, skewness and kurtosis (excess) of the population or bias-corrected."""
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    x = lambda c: col(c).cast("double")
    metrics = {"n": lambda c: F.count(col(c)), "stddev": lambda c: F.stddev_samp(x(c)), "variance": lambda c: F.var_samp(x(c)), "skewness": lambda c: F.skewness(x(c)), "kurtosis": lambda c: F.kurtosis(x(c))}
    out = long_form(df, columns, metrics, batch)
    if bias_corrected:
        n, g1, g2 = F.col("n"), F.col("skewness"), F.col("kurtosis")
        out = out.withColumns({
            "skewness": F.when(n > 2, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1),
            "kurtosis": F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
        })
    return out.drop("n")


QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def order_statistics(df: DataFrame, values: dict[str, Column], ranks: dict[str, list[int]], ranges: int = 32) -> DataFrame:
    """column_name, rank (from 0), value (double): the values at the ranks of each expression, nulls left out.

    Values are counted, cut into ranges by approximate quantiles, and running counts are taken inside each range and
    shifted by the totals of the ranges before, so that no task holds all values of a column.
    """
    names = list(values)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), values[c].cast("double").alias("v")) for i, c in enumerate(names)])
    counted = df.select(F.inline(cells)).where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    bounds = {r["i"]: sorted(set(r["q"])) for r in counted.groupBy("i").agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], F.lit(1000)).alias("q")).collect()}
    at = F.array(*[F.array(*[F.lit(b) for b in bounds.get(i, [])]).cast("array<double>") for i in range(len(names))])
    dealt = counted.withColumn("part", F.size(F.filter(F.get(at, F.col("i")), lambda b: b < F.col("v"))))
    own = dealt.withColumn("before", F.sum("n").over(Window.partitionBy("i", "part").orderBy("v")) - F.col("n"))
    totals = dealt.groupBy("i", "part").agg(F.sum("n").alias("t"))
    shift = totals.select("i", "part", (F.sum("t").over(Window.partitionBy("i").orderBy("part")) - F.col("t")).alias("shift"))  # one row a range
    placed = own.join(F.broadcast(shift), ["i", "part"]).select("i", "v", "n", (F.col("before") + F.col("shift")).alias("before"))
    asked = F.array(*[F.array(*[F.lit(r) for r in ranks.get(c, [])]).cast("array<long>") for c in names])
    found = F.filter(F.get(asked, F.col("i")), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    rows = placed.select("i", "v", F.explode(found).alias("rank"))
    return rows.select(F.array(*[F.lit(c) for c in names])[F.col("i")].alias("column_name"), "rank", F.col("v").alias("value"))


def exact_quantiles(df: DataFrame, values: dict[str, Column], at: dict[str, float]) -> DataFrame:
    """column_name and a column for each of ``at``, interpolated between the values at the two places around it."""
    n = {r["column_name"]: r["n"] for r in long_form(df, values, {"n": lambda c: F.count(values[c])}).collect()}
    places = {c: {k: q * (n[c] - 1) for k, q in at.items()} for c in values if n[c]}
    ranks = {c: sorted({r for p in x.values() for r in (math.floor(p), math.ceil(p))}) for c, x in places.items()}
    found = order_statistics(df, values, ranks).collect() if ranks else []
    value = {(r["column_name"], r["rank"]): r["value"] for r in found}

    def one(c: str, p: float) -> float:
        low, high = value[c, math.floor(p)], value[c, math.ceil(p)]
        return low if low == high else low + (high - low) * (p - math.floor(p))

    rows = [(c, *[one(c, places[c][k]) if c in places else None for k in at]) for c in values]
    return df.sparkSession.createDataFrame(rows, "column_name string, " + ", ".join(f"{k} double" for k in at))


def quantiles(df: DataFrame, columns: list[str] | None = None, exact: bool = False, accuracy: int = 10_000, batch: int | None = None) -> DataFrame:
    """p5, p25, median, p75, p95; exact ones interpolate, approximate ones are values of the column."""
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    if exact:
        return exact_quantiles(df, {c: col(c).cast("double") for c in columns}, QUANTILES)
    at = F.array(*[F.lit(q) for q in QUANTILES.values()])
    out = long_form(df, columns, {"q": lambda c: F.percentile_approx(col(c).cast("double"), at, F.lit(accuracy))}, batch)
    return out.select("column_name", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)])


def spread(profile: DataFrame) -> DataFrame:
    """Adds iqr, range, cv and the box plot's fences to rows with quantiles, min, max, mean and stddev."""
    iqr = F.col("p75") - F.col("p25")
    return profile.select(
        "*",
        F.round(iqr, 6).alias("iqr"),
        F.round(F.col("max") - F.col("min"), 6).alias("range"),
        F.when(F.col("mean") != 0, F.round(F.abs(F.try_divide(F.col("stddev"), F.col("mean"))), 6)).alias("cv"),
        F.round(F.col("p25") - 1.5 * iqr, 6).alias("lower_fence"),
        F.round(F.col("p75") + 1.5 * iqr, 6).alias("upper_fence"),
    )


def strings(df: DataFrame, columns: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """Lengths and the counts of empty, blank and padded strings; trimming is of spaces."""
    return long_form(df, columns_of(df.schema, "string") if columns is None else columns, REGISTRY["string"], batch)


def booleans(df: DataFrame, columns: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """true_count, false_count, true_rate, false_rate of the values, imbalance_ratio (only if both occur)."""
    columns = columns_of(df.schema, "boolean") if columns is None else columns
    out = long_form(df, columns, {"non_null": lambda c: F.count(col(c))} | REGISTRY["boolean"], batch)
    t, n = F.coalesce("true_count", F.lit(0)), F.col("non_null")
    f = n - t
    rate = lambda x: F.round(F.try_divide(x, n), 6)
    return out.select("column_name", t.alias("true_count"), f.alias("false_count"), rate(t).alias("true_rate"), rate(f).alias("false_rate"), F.when((t > 0) & (f > 0), F.round(F.try_divide(F.greatest(t, f), F.least(t, f)), 4)).alias("imbalance_ratio"))


def dates(df: DataFrame, as_of: str | Column, columns: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """min_date, max_date, date_range_days, freshness_days (to as_of), distinct values and the guessed granularity."""
    columns = columns_of(df.schema, *DATES) if columns is None else columns
    out = long_form(df, columns, {"min_date": lambda c: F.min(day(col(c))), "max_date": lambda c: F.max(day(col(c))), "distinct_values": lambda c: F.count_distinct(col(c))}, batch)
    today = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    days = F.datediff("max_date", "min_date")
    return out.select("*", days.alias("date_range_days"), F.datediff(today, F.col("max_date")).alias("freshness_days"), granularity(days, F.col("distinct_values")).alias("granularity_guess"))


def granularity(days: Column, distinct: Column) -> Column:
    """daily, weekly, monthly or yearly, by the number of values that such a series would have."""
    near = lambda every, low, high: F.try_divide(distinct, days / every).between(low, high)
    return (
        F.when((days >= 7) & near(1, 0.7, 1.3), "daily")
        .when((days >= 28) & near(7, 0.7, 1.3), "weekly")
        .when((days >= 60) & near(30, 0.7, 1.3), "monthly")
        .when((days >= 365) & near(365, 0.5, 1.5), "yearly")
        .otherwise("unknown")
    )


def distincts(df: DataFrame, columns: list[str] | None = None, exact: bool = False, rsd: float = 0.02, batch: int | None = None) -> DataFrame:
    """approx_distinct and distinct_mode. Exact counts come from one grouped pass a column, see freq.exact_distinct."""
    columns = df.columns if columns is None else columns
    if exact:
        from .freq import exact_distinct

        return exact_distinct(df, columns).select("column_name", F.col("distinct_values").alias("approx_distinct"), F.lit("exact").alias("distinct_mode"))
    return long_form(df, columns, {"approx_distinct": lambda c: F.approx_count_distinct(col(c), rsd)}, min(batch or 8, 8)).select("*", F.lit("approx").alias("distinct_mode"))


def sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mergeable HyperLogLog sketches: column_name, sketch; union them with F.hll_union_agg."""
    return union([df.agg(F.hll_sketch_agg(col(c).cast("string")).alias("sketch")).select(F.lit(c).alias("column_name"), "sketch") for c in columns])
