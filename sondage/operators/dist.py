"""Distributions: histograms, cumulative shares, lengths, leading digits, MAD, density, quantile plots, row order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, chi_square_p, col, leading_digit, long_form, normal_quantile, union
from ..types import NUMERIC, columns_of
from .core import exact_quantiles, order_statistics


def _ends(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    x = lambda c: F.when(F.abs(col(c).cast("double")) < float("inf"), col(c).cast("double"))
    rows = long_form(df, columns, {"low": lambda c: F.min(x(c)), "high": lambda c: F.max(x(c))}).collect()
    return {r["column_name"]: (r["low"], r["high"]) for r in rows if r["low"] is not None}


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 10, ends: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Equal-width bins: column_name, bin, bin_start, bin_end (4 decimals), count; empty bins are left out.

    All columns are bucketed in one pass. A constant column is one bin. NaN and infinities are left out.
    """
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    ends = _ends(df, columns) if ends is None else ends
    some = [c for c in columns if c in ends]
    if not some:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, bin_start double, bin_end double, count long")
    x = {c: col(c).cast("double") for c in some}
    numbers = [F.when(F.abs(x[c]) < float("inf"), F.lit(i * 128) + bucket(x[c], *ends[c], bins)) for i, c in enumerate(some)]
    cells = df.select(F.explode(F.array(*numbers)).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count("*").alias("count"))
    meta = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(a)).alias("low"), F.lit((b - a) / bins).alias("width"), F.lit(float(b)).alias("high")) for c, (a, b) in ((c, ends[c]) for c in some)])
    at = cells.select(meta[F.floor(F.col("cell") / 128).cast("int")].alias("m"), (F.col("cell") % 128).cast("int").alias("bin"), "count")
    flat = F.col("m.width") == 0
    return at.select(
        F.col("m.name").alias("column_name"),
        "bin",
        F.round(F.col("m.low") + (F.col("bin") - 1) * F.col("m.width"), 4).alias("bin_start"),
        F.round(F.when(flat, F.col("m.high")).otherwise(F.col("m.low") + F.col("bin") * F.col("m.width")), 4).alias("bin_end"),
        "count",
    )


def cdf(bins: DataFrame) -> DataFrame:
    """Of histogram rows: column_name, x (the bin's end), cumulative_pct (6 decimals)."""
    w = Window.partitionBy("column_name")
    share = F.sum("count").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("count").over(w)
    return bins.select("column_name", F.col("bin_end").alias("x"), F.round(share, 6).alias("cumulative_pct"))


def length_histogram(df: DataFrame, columns: list[str] | None = None, most: int = 30) -> DataFrame:
    """column_name, length, count; over ``most`` distinct lengths they are put in buckets of equal width."""
    columns = columns_of(df.schema, "string") if columns is None else columns
    parts = [df.where(col(c).isNotNull()).groupBy(F.length(col(c)).alias("length")).agg(F.count("*").alias("count")).select(F.lit(c).alias("column_name"), "*") for c in columns]
    w = Window.partitionBy("column_name")
    rows = union(parts).select("*", F.count("*").over(w).alias("n"), F.min("length").over(w).alias("low"), F.max("length").over(w).alias("high"))
    width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / F.lit(most))).cast("int")
    start = F.when(F.col("n") <= most, F.col("length")).otherwise(F.col("low") + F.floor((F.col("length") - F.col("low")) / width).cast("int") * width)
    return rows.groupBy("column_name", start.alias("length")).agg(F.sum("count").alias("count"))


def benford_digits(df: DataFrame, columns: list[str] | None = None, least: int = 100) -> DataFrame:
    """column_name, digit 1 to 9, n, observed and expected share (4 decimals) of positive values' leading digits.

    Columns with fewer than ``least`` such values have no rows.
    """
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    numbers = [F.when(col(c) > 0, F.lit(i * 16) + leading_digit(col(c))) for i, c in enumerate(columns)]
    cells = df.select(F.explode(F.array(*numbers)).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(c) for c in columns])
    seen = cells.select(names[F.floor(F.col("cell") / 16).cast("int")].alias("column_name"), (F.col("cell") % 16).cast("int").alias("digit"), "n")
    totals = seen.groupBy("column_name").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("digit", "n"))).alias("by")).where(F.col("total") >= least)
    rows = totals.select("column_name", "total", "by", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("digit"))
    n = F.coalesce(F.col("by")[F.col("digit")], F.lit(0))
    return rows.select("column_name", "digit", n.alias("n"), F.round(n / F.col("total"), 4).alias("observed"), F.round(F.log10(1 + 1 / F.col("digit")), 4).alias("expected"), "total")


def benford_test(digits: DataFrame) -> list[tuple[str, float, float]]:
    """(column, chi-square, p-value) of benford_digits' rows: nine a column."""
    share = F.log10(1 + 1 / F.col("digit")) * F.col("total")
    rows = digits.groupBy("column_name").agg(F.sum(F.pow(F.col("n") - share, 2) / share).alias("chi2")).collect()
    return [(r["column_name"], r["chi2"], round(chi_square_p(r["chi2"], 8), 6)) for r in rows]


def mad(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """mad: the median of the distances to the median (6 decimals); null for fewer than 3 values."""
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    x = {c: col(c).cast("double") for c in columns}

    def medians(values: dict[str, Column]) -> dict[str, float]:
        if exact:
            rows = exact_quantiles(df, values, {"m": 0.5})
        else:
            rows = long_form(df, values, {"m": lambda c: F.percentile_approx(values[c], F.lit(0.5))})
        return {r["column_name"]: r["m"] for r in rows.collect()}

    middle = medians(x)
    found = medians({c: F.abs(x[c] - F.lit(middle[c])) for c in columns})
    count = {r["column_name"]: r["n"] for r in long_form(df, columns, {"n": lambda c: F.count(col(c))}).collect()}
    return df.sparkSession.createDataFrame([(c, round(found[c], 6) if count[c] >= 3 else None) for c in columns], "column_name string, mad double")


def _scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float, float, float]]:
    """n, min, max, mean and deviation of the columns that a curve can be drawn of: 5 values, not all alike, all finite."""
    x = lambda c: col(c).cast("double")
    ends = {"n": lambda c: F.count(x(c)), "low": lambda c: F.min(x(c)), "high": lambda c: F.max(x(c)), "mean": lambda c: F.avg(x(c)), "sigma": lambda c: F.stddev_samp(x(c))}
    rows = long_form(df, columns, ends).collect()
    return {r["column_name"]: tuple(r)[1:] for r in rows if r["n"] >= 5 and r["sigma"] and math.isfinite(r["sigma"]) and r["low"] != r["high"]}


def densities(df: DataFrame, columns: list[str] | None = None, points: int = 50) -> DataFrame:
    """column_name, x (4 decimals), y (8): Gaussian density at evenly spaced points; Silverman's width.

    All columns take one pass. Columns of fewer than 5 values, of one value or with infinite ones have no rows.
    """
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    scales = _scales(df, columns)
    some = [c for c in columns if c in scales]
    if not some:
        return df.sparkSession.createDataFrame([], "column_name string, x double, y double")
    at, meta = [], []
    for c in some:
        n, low, high, _, sigma = scales[c]
        h = 1.06 * sigma * n**-0.2
        at.append([low + i * (high - low) / (points - 1) for i in range(points)])
        meta.append((c, -0.5 / h**2, 1 / (h * math.sqrt(2 * math.pi) * n)))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("v")) for i, c in enumerate(some)])
    rows = df.select(F.inline(cells)).where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    grid = F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in at])
    scale = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("k"), F.lit(f).alias("f")) for c, k, f in meta])
    rows = rows.select("i", "v", "n", F.posexplode(grid[F.col("i")]).alias("p", "x"))
    sums = rows.groupBy("i", "p").agg(F.sum(F.col("n") * F.exp(F.pow(F.col("x") - F.col("v"), 2) * scale[F.col("i")]["k"])).alias("s"))
    return sums.select(scale[F.col("i")]["name"].alias("column_name"), F.round(grid[F.col("i")][F.col("p")], 4).alias("x"), F.round(F.col("s") * scale[F.col("i")]["f"], 8).alias("y"))


def quantile_plots(df: DataFrame, columns: list[str] | None = None, points: int = 50) -> DataFrame:
    """column_name, theoretical, actual (4 decimals): quantiles against a normal distribution of the same mean and deviation."""
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    scales = _scales(df, columns)
    ranks, theory = {}, []
    for c, (n, _, _, mean, sigma) in scales.items():
        ranks[c] = sorted({round(i * (n - 1) / (points - 1)) for i in range(points)} if n > points else range(n))
        theory += [(c, i, round(mean + sigma * normal_quantile((i + 0.5) / n), 4)) for i in ranks[c]]
    if not ranks:
        return df.sparkSession.createDataFrame([], "column_name string, theoretical double, actual double")
    places = df.sparkSession.createDataFrame(theory, "column_name string, rank long, theoretical double")
    found = order_statistics(df, {c: col(c).cast("double") for c in ranks}, ranks)
    return found.join(F.broadcast(places), ["column_name", "rank"]).select("column_name", "theoretical", F.round("value", 4).alias("actual"))


def kde(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """densities() of one column: x, y."""
    return densities(df, [column], points).select("x", "y")


def qq_plot(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """quantile_plots() of one column: theoretical, actual."""
    return quantile_plots(df, [column], points).select("theoretical", "actual")


def monotonic(df: DataFrame, columns: list[str], order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Whether the values that are not null never fall or never rise, in file order or in that of ``order``.

    Of all rows, or of the first ``limit`` ones. Rows are cut into ranges of their order; each range tells whether it holds
    and its ends, which are compared with those of the next, so that no task sees a whole column.
    is_monotonic_increasing and is_monotonic_decreasing are null for fewer than 3 values or a single distinct one.
    """
    place = [col(c) for c in order] if order else [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    by = [f"o{i}" for i in range(len(place))]
    parts = []
    for c in columns:
        rows = df.select(col(c).alias("v"), *[p.alias(b) for p, b in zip(place, by)]).where("v is not null")
        if limit is not None:
            rows = rows.orderBy(*by).limit(limit)
        # ranges of the order, each sorted in a task of its own
        rows = rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
        w = Window.partitionBy("part").orderBy(*by)
        own = rows.select("part", "v", *by, F.lag("v").over(w).alias("u"))
        at = F.struct(*by)
        rise, fall = (F.bool_and(F.col("u").isNull() | x) for x in (F.col("v") >= F.col("u"), F.col("v") <= F.col("u")))
        ends = own.groupBy("part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.min_by("v", at).alias("first"), F.max_by("v", at).alias("last"), rise.alias("up"), fall.alias("down"))
        after = ends.select("*", F.lag("last").over(Window.orderBy("part")).alias("u"))  # one row a range
        up = F.bool_and(F.col("up") & (F.col("u").isNull() | (F.col("first") >= F.col("u"))))
        down = F.bool_and(F.col("down") & (F.col("u").isNull() | (F.col("first") <= F.col("u"))))
        row = after.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), up.alias("up"), down.alias("down"))
        told = (F.col("n") >= 3) & (F.col("low") < F.col("high"))
        parts.append(row.select(F.lit(c).alias("column_name"), F.when(told, F.col("up")).alias("is_monotonic_increasing"), F.when(told, F.col("down")).alias("is_monotonic_decreasing")))
    return union(parts)
