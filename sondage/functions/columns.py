"""Column expressions and small numeric functions that several operators use."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expressions in one aggregation; larger generated code is slow to compile.
MOST_EXPRESSIONS = 48
LARGEST_DOUBLE = 1.7976931348623157e308


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col(quoted(name))


def count_where(cond: Column) -> Column:
    """How often cond holds; null over no rows, as a sum of cases is."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def long_form(df: DataFrame, columns: Iterable[str], metrics: dict[str, Callable[[str], Column]], batch: int | None = None) -> DataFrame:
    """One row per column: column_name and the metrics, from few aggregations of bounded size over df."""
    columns, parts = list(columns), []
    step = max(1, min(MOST_EXPRESSIONS // max(len(metrics), 1), batch or MOST_EXPRESSIONS))
    for i in range(0, len(columns), step):
        some = columns[i : i + step]
        row = df.agg(*[f(c).alias(f"{n}__{m}") for n, c in enumerate(some) for m, f in metrics.items()])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}__{m}").alias(m) for m in metrics]) for n, c in enumerate(some)])
        parts.append(row.select(F.inline(rows)))
    return union(parts)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bucket(x: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal-width bin, 1 to bins; the largest value falls in the last."""
    width = (high - low) / bins
    if width <= 0:
        return F.lit(1)
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.floor((x - F.lit(low)) / F.lit(width)).cast("int") + 1))


def leading_digit(x: Column) -> Column:
    """First digit that is not 0 of the decimal notation; null without one."""
    return F.nullif(F.regexp_extract(F.abs(x).cast("string"), r"^[0.]*([1-9])", 1), F.lit("")).cast("int")


def day(x: Column) -> Column:
    return x.cast("date")


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function by a rational approximation (Abramowitz and Stegun 26.2.17/23)."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return z if p > 0.5 else -z


def chi_square_p(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))
