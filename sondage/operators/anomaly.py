"""Rules over column profiles: anomalies, suggested constraints and the quality score, as Column predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds

Rule = Callable[[Thresholds, Column], Column]


def _c(name: str) -> Column:
    return F.col(name)


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _is(*kinds: str) -> Column:
    return _c("canonical_type").isin(*kinds)


def _iqr(_: Thresholds, n: Column) -> Column:
    width = _c("p75") - _c("p25")
    return (width != 0) & ((_number("min") < _c("p25") - 1.5 * width) | (_number("max") > _c("p75") + 1.5 * width))


def _z(_: Thresholds, n: Column) -> Column:
    far = F.greatest(F.abs(_c("mean") - _number("min")), F.abs(_number("max") - _c("mean")))
    return (_c("stddev") != 0) & (F.try_divide(far, _c("stddev")) > 3)


def _mad(_: Thresholds, n: Column) -> Column:
    far = F.greatest(F.abs(_number("min") - _c("median")), F.abs(_number("max") - _c("median")))
    return (_c("mad") > 0) & (F.try_divide(0.6745 * far, _c("mad")) > 3.5)


#: Name and predicate; null counts as not met. n is the number of profiled rows.
RULES: dict[str, Rule] = {
    "high_null_rate": lambda t, n: _c("null_rate") > t.high_null_rate,
    "single_value": lambda t, n: _c("distinct_values") == 1,
    "all_unique": lambda t, n: (n > 1) & (F.try_divide(_c("distinct_values"), n) > t.all_unique_ratio) & (_c("distinct_values") <= t.all_unique_hll_guard * n),
    "empty_string_dominant": lambda t, n: _is("string") & (_c("max_length") == 0),
    "zero_variance": lambda t, n: _is("integer", "float") & (_c("stddev") == 0) & (_c("distinct_values") > 1),
    "near_constant": lambda t, n: (n > 1) & (F.try_divide(_c("top_frequency"), n) > t.near_constant_rate),
    "high_cardinality": lambda t, n: _is("string") & (_c("distinct_values") > t.high_cardinality_distinct),
    "has_negatives": lambda t, n: _c("negative_count") > 0,
    "future_dates": lambda t, n: _is("date", "datetime") & (F.substring("max", 1, 10).try_cast("date") > _c("as_of")),
    "benford_anomaly": lambda t, n: _is("integer", "float") & (_c("benford_pvalue") < 0.01) & (n > 1000),
    "iqr_outliers": _iqr,
    "zscore_outliers": _z,
    "high_skewness": lambda t, n: F.abs("skewness") > t.skewness,
    "boolean_imbalance": lambda t, n: _is("boolean") & (n > 0) & ((F.try_divide(_c("true_count"), n) < 0.01) | (F.try_divide(_c("true_count"), n) > 0.99)),
    "stale_data": lambda t, n: _c("freshness_days") > 90,
    "mad_outliers": _mad,
    "suspicious_uniform_length": lambda t, n: _is("string") & (n > 1) & (_c("min_length") == _c("max_length")) & (_c("min_length") > 0),
    "low_cardinality_numeric": lambda t, n: _is("integer", "float") & (n >= 100) & (_c("distinct_values") < 10),
    "has_leading_trailing_whitespace": lambda t, n: _c("leading_trailing_whitespace_count") > 0,
}
#: What the rules read, with types; columns that a profile lacks count as null.
INPUTS = {
    "canonical_type": "string", "null_rate": "double", "distinct_values": "long", "total_rows": "long", "max_length": "long", "min_length": "long", "stddev": "double",
    "mean": "double", "median": "double", "p25": "double", "p75": "double", "mad": "double", "min": "string", "max": "string", "top_frequency": "long", "negative_count": "long",
    "skewness": "double", "true_count": "long", "freshness_days": "double", "benford_pvalue": "double", "leading_trailing_whitespace_count": "long", "as_of": "date",
    "nullable": "boolean",
}


def completed(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns({k: F.lit(None).cast(t) for k, t in INPUTS.items() if k not in profiles.columns})


def flags(profiles: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Adds ``anomalies``, the names of the rules that hold, in the rules' order."""
    t, n = thresholds or Thresholds(), F.col("total_rows")
    full = completed(profiles)
    names = F.array_compact(F.array(*[F.when(F.coalesce(rule(t, n), F.lit(False)), F.lit(name)) for name, rule in RULES.items()]))
    return full.select(*profiles.columns, names.alias("anomalies"))


def quality(columns: DataFrame, duplicate_rate: Column | float = 0.0) -> DataFrame:
    """quality_score of one table from its columns' null_rate and anomalies: 100 less the penalties, 1 decimal."""
    rate = duplicate_rate if isinstance(duplicate_rate, Column) else F.lit(duplicate_rate)
    found, nulls = F.sum(F.size("anomalies")), F.avg("null_rate")
    score = 100 - F.least(F.lit(30.0), 3.0 * found) - F.least(F.lit(20.0), 40 * nulls) - F.least(F.lit(15.0), 100 * F.max(rate))
    return columns.agg(F.when(F.count(F.lit(1)) == 0, F.lit(100.0)).otherwise(F.round(F.greatest(F.lit(0.0), score), 1)).alias("quality_score"))


def _ident(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def suggestions(profiles: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """table_name, column_name, constraint_type, expression, confidence, evidence, out of flagged profiles.

    profiles: table_name and column_name, the rules' inputs and anomalies. values: column_name, value of all values of
    columns with at most 10, none of them redacted, for the lists of allowed values.
    """
    p = completed(profiles)
    table, column = F.col("table_name"), F.col("column_name")
    alter, named = F.concat(F.lit("ALTER TABLE "), _ident(table)), lambda k, tail="": F.concat(F.lit(k), F.concat_ws("_", table, column), F.lit(tail))
    rows = F.col("total_rows") > 0
    add = lambda name, body: F.concat(alter, F.lit(" ADD CONSTRAINT "), name, body)
    out = lambda df, kind, text, conf, why: df.select("table_name", "column_name", F.lit(kind).alias("constraint_type"), text.alias("expression"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence"), why.alias("evidence"))
    parts = [
        out(p.where(rows & (F.col("null_rate") == 0) & F.col("nullable")), "NOT NULL", F.concat(alter, F.lit(" ALTER COLUMN "), _ident(column), F.lit(" SET NOT NULL")), 0.95, F.concat(F.lit("no null in "), F.col("total_rows"), F.lit(" rows"))),
        out(p.where(F.array_contains("anomalies", "all_unique")), "UNIQUE", add(named("uq_"), F.concat(F.lit(" UNIQUE ("), _ident(column), F.lit(")"))), 0.90, F.concat(F.col("distinct_values"), F.lit(" distinct values"))),
        out(p.where(rows & F.col("canonical_type").isin("integer", "float") & (F.col("min").try_cast("double") >= 0) & (F.coalesce("negative_count", F.lit(0)) == 0)), "CHECK", add(named("ck_", "_nonneg"), F.concat(F.lit(" CHECK ("), _ident(column), F.lit(" >= 0)"))), 0.85, F.concat(F.lit("least value "), F.col("min"))),
    ]
    if values is not None:
        lists = values.where("value <> '[REDACTED]'").groupBy("column_name").agg(F.array_sort(F.collect_set("value")).alias("v"))
        few = p.where((F.col("canonical_type") == "string") & F.col("distinct_values").between(2, 10)).join(lists, "column_name").where(F.size("v") == F.col("distinct_values"))
        texts = F.array_join(F.transform("v", lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))), ", ")
        sure = F.when(F.col("total_rows") >= 100, 0.90).when(F.col("total_rows") >= 20, 0.80).otherwise(0.70)
        parts.append(out(few, "ENUM", add(named("ck_", "_enum"), F.concat(F.lit(" CHECK ("), _ident(column), F.lit(" IN ("), texts, F.lit("))"))), sure, F.concat(F.col("distinct_values"), F.lit(" values in "), F.col("total_rows"), F.lit(" rows"))))
    from ..functions.columns import union

    return union(parts)
