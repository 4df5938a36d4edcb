"""The registered queries of the profiling operators, each over whole tables, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anomaly, assoc, core, dist, freq, patterns, rows
from .plans import graph, incremental, relationships
from .sources.readers import ParquetSource, discover, limited_values, sample
from .types import canonical_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
ORDERS = ["o_orderkey", "o_custkey", "o_totalprice"]
#: Tables with nulls and repeated rows, made alike in both engines.
NULLED = "SELECT l_orderkey, nullif(l_linenumber, 3) AS n, nullif(l_returnflag, 'R') AS flag, nullif(l_quantity, 10.0) AS q, l_shipdate FROM lineitem"
AS_OF = "2025-01-01"
_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("n"), F.nullif("l_returnflag", F.lit("R")).alias("flag"), F.nullif("l_quantity", F.lit(10.0)).alias("q"), "l_shipdate")


def each(columns: list[str], row: str, table: str, join: str = " UNION ALL ") -> str:
    """row for every column, with {c} as its name."""
    return join.join(f"SELECT '{c}' AS column_name, {row.replace('{c}', c)} FROM {table}" for c in columns)


NUMERIC_ROW = "round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}::DOUBLE), 4) AS mean, round(sum({c}::DOUBLE), 2) AS sum, sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)::BIGINT AS zero_count, sum(CASE WHEN {c} < 0 THEN 1 ELSE 0 END)::BIGINT AS negative_count, sum(CASE WHEN abs({c}::DOUBLE) > 1.7976931348623157e308 THEN 1 ELSE 0 END)::BIGINT AS infinite_count"


def _numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    out = core.numeric(df, columns)
    return out.select("column_name", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean")], F.round("sum", 2).alias("sum"), "zero_count", "negative_count", "infinite_count")


@query(each(LINE, NUMERIC_ROW, "lineitem"))
def core_numeric_stats(spark, sf_dir):
    return _numeric(read(spark, sf_dir, "lineitem"), LINE)


@query(each(["c_acctbal", "c_nationkey", "c_custkey"], NUMERIC_ROW, "customer"))
def zero_negative_counts(spark, sf_dir):
    return _numeric(read(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey", "c_custkey"])


@query(
    "SELECT 'value' AS column_name, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END)::BIGINT AS zero_count, sum(CASE WHEN v < 0 THEN 1 ELSE 0 END)::BIGINT AS negative_count, sum(CASE WHEN abs(v) > 1.7976931348623157e308 THEN 1 ELSE 0 END)::BIGINT AS infinite_count "
    "FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'inf'::DOUBLE WHEN event_id % 11 = 0 THEN '-inf'::DOUBLE ELSE 1.5 END AS v FROM events)"
)
def infinite_count(spark, sf_dir):
    x = read(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(1.5)
    return core.numeric(x.select(v.alias("value")), ["value"]).select("column_name", "zero_count", "negative_count", "infinite_count")


COUNT_ROW = "count(*)::BIGINT AS total_rows, count({c})::BIGINT AS non_null, (count(*) - count({c}))::BIGINT AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_rate"


@query(each(["l_orderkey", "n", "flag", "q", "l_shipdate"], COUNT_ROW, f"({NULLED})"))
def null_counts(spark, sf_dir):
    return core.counts(nulled(spark, sf_dir)).withColumn("null_rate", F.round("null_rate", 6))


@query(each(["vec_id", "embedding", "label"], COUNT_ROW, "embeddings"))
def semi_structured_counts(spark, sf_dir):
    return core.counts(read(spark, sf_dir, "embeddings")).withColumn("null_rate", F.round("null_rate", 6))


@query(each(["p_name", "p_brand", "p_type"], "min({c}) AS min, max({c}) AS max", "part"))
def string_extremes(spark, sf_dir):
    return core.extremes(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


MOMENT_ROW = "round(stddev_samp({c}::DOUBLE), 4) AS stddev, round(var_samp({c}::DOUBLE), 2) AS variance, round({skew}, 6) AS skewness, round({kurt}, 6) AS kurtosis"


def _moments(df: DataFrame, columns: list[str], corrected: bool) -> DataFrame:
    out = core.moments(df, columns, corrected)
    return out.select("column_name", F.round("stddev", 4).alias("stddev"), F.round("variance", 2).alias("variance"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query(each(LINE, MOMENT_ROW.replace("{skew}", "skewness({c})").replace("{kurt}", "kurtosis({c})"), "lineitem"))
def moments_bias_corrected(spark, sf_dir):
    return _moments(read(spark, sf_dir, "lineitem"), LINE, True)


@query(each(["o_totalprice", "o_custkey"], MOMENT_ROW.replace("{skew}", "skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1))").replace("{kurt}", "kurtosis_pop({c})"), "orders"))
def moments_population(spark, sf_dir):
    return _moments(read(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], False)


QUANTILE_ROW = ", ".join(f"round(quantile_cont({{c}}::DOUBLE, {q}), 4) AS {n}" for n, q in core.QUANTILES.items())


@query(each(LINE, QUANTILE_ROW, "lineitem"))
def quantiles_exact(spark, sf_dir):
    out = core.quantiles(read(spark, sf_dir, "lineitem"), LINE, exact=True)
    return out.select("column_name", *[F.round(q, 4).alias(q) for q in core.QUANTILES])


@query(each(LINE, ", ".join(f"true AS {q}" for q in core.QUANTILES), "(SELECT 1)"))
def quantiles_approx(spark, sf_dir):
    """Whether each approximate quantile is a value of the column at most 1 / 1000 of the rows from its place."""
    df = read(spark, sf_dir, "lineitem")
    found = {r["column_name"]: r for r in core.quantiles(df, LINE).collect()}
    shares = lambda c, q: (F.count_if(F.col(c) < found[c][q]) / F.count(c), F.count_if(F.col(c) <= found[c][q]) / F.count(c))

    def near(c: str, q: str, at: float):
        below, upto = shares(c, q)
        return ((below - 0.001 <= at) & (upto + 0.001 >= at)).alias(q)

    row = df.agg(*[F.struct(F.lit(c).alias("column_name"), *[near(c, q, at) for q, at in core.QUANTILES.items()]).alias(c) for c in LINE])
    return row.select(F.inline(F.array(*LINE)))


@query(
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b, max(o_totalprice) - min(o_totalprice) AS r, abs(stddev_samp(o_totalprice) / avg(o_totalprice)) AS cv FROM orders) "
    "SELECT 'o_totalprice' AS column_name, round(b - a, 4) AS iqr, round(r, 4) AS range, round(cv, 6) AS cv, round(a - 1.5 * (b - a), 4) AS lower_fence, round(b + 1.5 * (b - a), 4) AS upper_fence FROM q"
)
def iqr_box_plot(spark, sf_dir):
    df, c = read(spark, sf_dir, "orders"), ["o_totalprice"]
    out = core.spread(core.quantiles(df, c, exact=True).join(core.numeric(df, c), "column_name").join(core.moments(df, c), "column_name"))
    return out.select("column_name", *[F.round(x, 4).alias(x) for x in ("iqr", "range")], "cv", *[F.round(x, 4).alias(x) for x in ("lower_fence", "upper_fence")])


STRING_ROW = "min(length({c}))::INTEGER AS min_length, max(length({c}))::INTEGER AS max_length, round(avg(length({c})), 4) AS avg_length, sum(CASE WHEN {c} = '' THEN 1 ELSE 0 END)::BIGINT AS empty_count, sum(CASE WHEN length({c}) > 0 AND length(trim({c})) = 0 THEN 1 ELSE 0 END)::BIGINT AS whitespace_count, sum(CASE WHEN {c} <> trim({c}) AND {c} <> '' THEN 1 ELSE 0 END)::BIGINT AS leading_trailing_whitespace_count"
PADDED = "SELECT CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '   ' WHEN doc_id % 3 = 0 THEN ' ' || lang || ' ' ELSE lang END AS padded, text, source FROM documents"


@query(each(["padded", "text", "source"], STRING_ROW, f"({PADDED})"))
def string_profile(spark, sf_dir):
    x, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    padded = F.when(i % 5 == 0, "").when(i % 7 == 0, "   ").when(i % 3 == 0, F.concat(F.lit(" "), "lang", F.lit(" "))).otherwise(F.col("lang"))
    return core.strings(x.select(padded.alias("padded"), "text", "source")).withColumn("avg_length", F.round("avg_length", 4))


BOOLEAN_ROW = "count_if({c})::BIGINT AS true_count, count_if(NOT {c})::BIGINT AS false_count, round(count_if({c}) / count({c}), 6) AS true_rate, round(count_if(NOT {c}) / count({c}), 6) AS false_rate, CASE WHEN count_if({c}) > 0 AND count_if(NOT {c}) > 0 THEN round(greatest(count_if({c}), count_if(NOT {c})) / least(count_if({c}), count_if(NOT {c})), 4) END AS imbalance_ratio"


@query(each(["good", "bad"], BOOLEAN_ROW, "(SELECT quality = 1 AS good, toxic = 1 AS bad FROM labels)"))
def boolean_profile(spark, sf_dir):
    return core.booleans(read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad")))


def _dates_sql(column: str, table: str) -> str:
    near = lambda every, a, b: f"n / (days / {every}.0) BETWEEN {a} AND {b}"
    return (
        f"SELECT '{column}' AS column_name, a AS min_date, b AS max_date, days::INTEGER AS date_range_days, date_diff('day', b, DATE '{AS_OF}')::INTEGER AS freshness_days, n AS distinct_values, "
        f"CASE WHEN days >= 7 AND {near(1, 0.7, 1.3)} THEN 'daily' WHEN days >= 28 AND {near(7, 0.7, 1.3)} THEN 'weekly' WHEN days >= 60 AND {near(30, 0.7, 1.3)} THEN 'monthly' WHEN days >= 365 AND {near(365, 0.5, 1.5)} THEN 'yearly' ELSE 'unknown' END AS granularity_guess "
        f"FROM (SELECT min({column})::DATE AS a, max({column})::DATE AS b, date_diff('day', min({column})::DATE, max({column})::DATE) AS days, count(DISTINCT {column})::BIGINT AS n FROM {table})"
    )


@query(" UNION ALL ".join(_dates_sql(c, t) for c, t in (("o_orderdate", "orders"), ("ts", "events"), ("l_shipdate", "lineitem"))))
def date_profile(spark, sf_dir):
    parts = [core.dates(read(spark, sf_dir, t), AS_OF, [c]) for c, t in (("o_orderdate", "orders"), ("ts", "events"), ("l_shipdate", "lineitem"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*)::BIGINT AS distinct_values, count_if(f = 1)::BIGINT AS unique_count, round(count_if(f = 1) / count(*), 6) AS uniqueness_ratio, max(f)::BIGINT AS top_frequency FROM (SELECT {c}, count(*) AS f FROM ({NULLED}) WHERE {c} IS NOT NULL GROUP BY 1)" for c in ("n", "flag", "q", "l_orderkey")
    )
)
def exact_distinct(spark, sf_dir):
    return freq.exact_distinct(nulled(spark, sf_dir), ["n", "flag", "q", "l_orderkey"])


@query(each(_LINEITEM, "count(DISTINCT {c})::BIGINT AS distinct_values, 'approx' AS distinct_mode, true AS near", "lineitem"))
def approx_distinct(spark, sf_dir):
    """Exact distinct values, and whether the sketch's are within four of its standard errors, 2 % each."""
    df = read(spark, sf_dir, "lineitem")
    both = core.distincts(df).join(freq.exact_distinct(df, df.columns).select("column_name", "distinct_values"), "column_name")
    return both.select("column_name", "distinct_values", "distinct_mode", (F.abs(F.col("approx_distinct") / F.col("distinct_values") - 1) <= 0.08).alias("near"))


KEY_ROW = "count(DISTINCT {c})::BIGINT AS distinct_values, round(count(DISTINCT {c}) / count(*), 6) AS distinct_ratio, (count(*) = count({c}) AND count(DISTINCT {c}) >= 0.99 * count(*)) AS pk_candidate"


@query(each(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], KEY_ROW, "customer"))
def pk_candidates(spark, sf_dir):
    return freq.keys(read(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def _ranked_sql(columns: list[str], table: str, order: str, least: int = 0) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY freq {order}, value)::INTEGER AS rank, value, freq FROM (SELECT {c}::VARCHAR AS value, count(*)::BIGINT AS freq FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) QUALIFY row_number() OVER (ORDER BY freq {order}, value) <= 5 AND count(*) OVER () >= {least})" for c in columns
    )


@query(_ranked_sql(["l_returnflag", "l_linenumber", "l_linestatus"], "lineitem", "DESC"))
def top_values(spark, sf_dir):
    return freq.top_values(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber", "l_linestatus"])


@query(_ranked_sql(["p_brand", "p_type", "p_size"], "part", "ASC", 5))
def bottom_values(spark, sf_dir):
    return freq.bottom_values(read(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


def _bins_sql(columns: list[str], table: str, bins: int = 10) -> str:
    one = lambda c: (
        f"SELECT '{c}' AS column_name, b AS bin, round(lo + (b - 1) * w, 4) AS bin_start, round(lo + b * w, 4) AS bin_end, count(*)::BIGINT AS count FROM (SELECT lo, w, least({bins}, greatest(1, floor(({c} - lo) / w)::INTEGER + 1))::INTEGER AS b "
        f"FROM {table}, (SELECT min({c})::DOUBLE AS lo, (max({c})::DOUBLE - min({c})::DOUBLE) / {bins} AS w FROM {table}) WHERE {c} IS NOT NULL) GROUP BY lo, w, b"
    )
    return " UNION ALL ".join(map(one, columns))


@query(_bins_sql(LINE, "lineitem"))
def histogram(spark, sf_dir):
    return dist.histogram(read(spark, sf_dir, "lineitem"), LINE)


@query(f"SELECT column_name, bin_end AS x, round(sum(count) OVER (PARTITION BY column_name ORDER BY bin) / sum(count) OVER (PARTITION BY column_name), 6) AS cumulative_pct FROM ({_bins_sql(['o_totalprice', 'o_custkey'], 'orders')})")
def cdf(spark, sf_dir):
    return dist.cdf(dist.histogram(read(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]))


def _lengths_sql(column: str, table: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, CASE WHEN n <= 30 THEN l ELSE lo + ((l - lo) // w) * w END::INTEGER AS length, sum(c)::BIGINT AS count FROM (SELECT *, greatest(1, ceil((hi - lo + 1) / 30.0))::BIGINT AS w FROM "
        f"(SELECT l, c, count(*) OVER () AS n, min(l) OVER () AS lo, max(l) OVER () AS hi FROM (SELECT length({column}) AS l, count(*) AS c FROM {table} WHERE {column} IS NOT NULL GROUP BY 1))) GROUP BY 2"
    )


@query(" UNION ALL ".join((_lengths_sql("text", "documents"), _lengths_sql("lang", "documents"), _lengths_sql("source", "documents"))))
def length_histogram(spark, sf_dir):
    return dist.length_histogram(read(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query(
    "WITH d AS (SELECT regexp_extract(abs(o_totalprice)::VARCHAR, '^[0.]*([1-9])', 1)::INTEGER AS digit FROM orders WHERE o_totalprice > 0), n AS (SELECT digit, count(*) AS n FROM d GROUP BY 1) "
    "SELECT 'o_totalprice' AS column_name, g::INTEGER AS digit, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n), 4) AS observed, round(log10(1 + 1.0 / g), 4) AS expected, (SELECT sum(n) FROM n)::BIGINT AS total FROM range(1, 10) r(g) LEFT JOIN n ON n.digit = g"
)
def benford_digits(spark, sf_dir):
    return dist.benford_digits(read(spark, sf_dir, "orders"), ["o_totalprice"])


# the tail of the normal distribution by Abramowitz and Stegun 7.1.26, which is right to six decimals
_TAIL = "(0.254829592 * t - 0.284496736 * t ** 2 + 1.421413741 * t ** 3 - 1.453152027 * t ** 4 + 1.061405429 * t ** 5) * exp(-x * x)"
_CHI2 = "SELECT sum((o - e) ** 2 / e) AS chi2 FROM (SELECT d, count(n.digit) AS o, any_value(total) * log10(1 + 1.0 / d) AS e FROM range(1, 10) r(d) CROSS JOIN (SELECT count(*) AS total FROM digits) LEFT JOIN digits n ON n.digit = r.d GROUP BY d)"


@query(
    " UNION ALL ".join(
        f"(WITH digits AS (SELECT nullif(regexp_extract(abs({c})::VARCHAR, '^[0.]*([1-9])', 1), '')::INTEGER AS digit FROM orders WHERE {c} > 0), chi AS ({_CHI2}), "
        "z AS (SELECT chi2, (((chi2 / 8) ** (1.0 / 3) - (1 - 2.0 / 72)) / sqrt(2.0 / 72)) / sqrt(2) AS z FROM chi), u AS (SELECT chi2, z, abs(z) AS x, 1 / (1 + 0.3275911 * abs(z)) AS t FROM z) "
        f"SELECT '{c}' AS column_name, round(chi2, 4) AS chi2, round(CASE WHEN z >= 0 THEN 0.5 * {_TAIL} ELSE 1 - 0.5 * {_TAIL} END, 4) AS benford_pvalue FROM u)"
        for c in ("o_totalprice", "o_custkey")
    )
)
def benford_pvalue(spark, sf_dir):
    found = dist.benford_test(dist.benford_digits(read(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]))
    return spark.createDataFrame([(c, round(x, 4), round(p, 4)) for c, x, p in found], "column_name string, chi2 double, benford_pvalue double")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(quantile_cont(abs({c} - m), 0.5), 6) AS mad FROM lineitem, (SELECT quantile_cont({c}, 0.5) AS m FROM lineitem)" for c in ("l_quantity", "l_extendedprice")))
def mad(spark, sf_dir):
    return dist.mad(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


@query(
    "WITH v AS (SELECT o_totalprice AS v FROM orders), s AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high, 1.06 * stddev_samp(v) * count(*) ** -0.2 AS h FROM v), "
    "p AS (SELECT low + i * (high - low) / 49 AS x, h, n FROM s, range(50) r(i)) "
    "SELECT round(x, 4) AS x, round(sum(exp(-0.5 * ((x - v) / h) ** 2)) / (any_value(h) * sqrt(2 * pi()) * any_value(n)), 8) AS y FROM p, v GROUP BY x"
)
def kde(spark, sf_dir):
    return dist.kde(read(spark, sf_dir, "orders"), "o_totalprice")


# the inverse normal distribution by Abramowitz and Stegun 26.2.23
_Z = "t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))"


@query(
    "WITH s AS (SELECT count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM orders), o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders), "
    "q AS (SELECT DISTINCT round_even(k * (n - 1) / 49.0, 0)::BIGINT AS i, n, m, d FROM s, range(50) r(k)), z AS (SELECT i, m, d, (i + 0.5) / n AS p, sqrt(-2 * ln(least((i + 0.5) / n, 1 - (i + 0.5) / n))) AS t FROM q) "
    f"SELECT round(m + d * (CASE WHEN p > 0.5 THEN 1 ELSE -1 END) * ({_Z}), 4) AS theoretical, round(v, 4) AS actual FROM z JOIN o USING (i)"
)
def qq_plot(spark, sf_dir):
    return dist.qq_plot(read(spark, sf_dir, "orders"), "o_totalprice")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, bool_and(u IS NULL OR v >= u) AS is_monotonic_increasing, bool_and(u IS NULL OR v <= u) AS is_monotonic_decreasing FROM (SELECT {c} AS v, lag({c}) OVER (ORDER BY o_orderkey) AS u FROM orders)"
        for c in ("o_orderkey", "o_totalprice")
    )
)
def monotonicity(spark, sf_dir):
    return dist.monotonic(read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], order=["o_orderkey"])


def _pairs_sql(columns: list[str], row: Callable[[str, str], str]) -> str:
    return " UNION ALL ".join(row(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :])


@query(_pairs_sql(LINE, lambda a, b: f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 4) AS pearson FROM lineitem"))
def pearson(spark, sf_dir):
    return assoc.pearson(read(spark, sf_dir, "lineitem"), LINE)


_SPEARMAN = _pairs_sql(ORDERS, lambda a, b: f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr(x::DOUBLE, y::DOUBLE), 4) AS spearman FROM (SELECT rank() OVER (ORDER BY {a}) AS x, rank() OVER (ORDER BY {b}) AS y FROM orders WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query(_SPEARMAN)
def spearman(spark, sf_dir):
    return assoc.spearman(read(spark, sf_dir, "orders"), ORDERS)


@query(_SPEARMAN)
def spearman_distributed(spark, sf_dir):
    return assoc.spearman(read(spark, sf_dir, "orders"), ORDERS, distributed=True)


def _bin(c: str, t: str) -> str:
    return f"least(10, greatest(1, floor(({c} - (SELECT min({c}) FROM {t})) / (((SELECT max({c}) FROM {t}) - (SELECT min({c}) FROM {t}))::DOUBLE / 10))::INTEGER + 1))"


@query(
    _pairs_sql(
        ["l_quantity", "l_extendedprice", "l_discount"],
        lambda a, b: f"SELECT '{a}' AS col1, '{b}' AS col2, round(greatest(0, least(1, (SELECT sum(n / t * ln(n * t / (a * b))) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY i) AS a, sum(n) OVER (PARTITION BY j) AS b FROM c)) / sqrt((SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n, (SELECT sum(n) FROM c) AS t FROM c GROUP BY i)) * (SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n, (SELECT sum(n) FROM c) AS t FROM c GROUP BY j))))), 4) AS nmi FROM (SELECT 1), (SELECT 1) WHERE true".replace(
            "FROM c", f"FROM (SELECT {_bin(a, 'lineitem')} AS i, {_bin(b, 'lineitem')} AS j, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)"
        ),
    )
)
def nmi(spark, sf_dir):
    return assoc.nmi(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


def _cramer_sql(a: str, b: str, table: str, full: bool) -> str:
    cells = f"(SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"
    more = "+ (max(t) - sum(ra * rb / t))" if full else ""
    return f"SELECT '{a}' AS col1, '{b}' AS col2, round(sqrt((sum(pow(n - ra * rb / t, 2) / (ra * rb / t)) {more}) / (max(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 4) AS cramers_v FROM (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb FROM {cells})"


@query(_pairs_sql(["l_returnflag", "l_linestatus", "l_half"], lambda a, b: _cramer_sql(a, b, "(SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'A' OR l_linenumber > 3 THEN 'x' ELSE l_linestatus END AS l_half FROM lineitem)", False)))
def cramers_v(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem")
    half = F.when((F.col("l_returnflag") == "A") | (F.col("l_linenumber") > 3), "x").otherwise(F.col("l_linestatus"))
    return assoc.cramers_v(x.select("l_returnflag", "l_linestatus", half.alias("l_half")))


@query(_cramer_sql("p_brand", "p_type", "part", True))
def cramers_v_full(spark, sf_dir):
    return assoc.cramers_v(read(spark, sf_dir, "part"), ["p_brand", "p_type"], full_chi2=True)


def _fd_sql(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS from_column, '{b}' AS to_column FROM (SELECT count(DISTINCT {b}) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}) HAVING max(n) = 1" for a in columns for b in columns if a != b)


@query(_fd_sql(["n_nationkey", "n_name", "n_regionkey"], "nation"))
def functional_dependencies(spark, sf_dir):
    return assoc.functional_dependencies(read(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


_SHARE = "((l_orderkey IS NOT NULL)::INTEGER + (n IS NOT NULL)::INTEGER + (flag IS NOT NULL)::INTEGER + (q IS NOT NULL)::INTEGER + (l_shipdate IS NOT NULL)::INTEGER) / 5.0"


@query(f"SELECT round(min({_SHARE})::DOUBLE, 4) AS row_completeness_min, round(max({_SHARE})::DOUBLE, 4) AS row_completeness_max, round(avg({_SHARE})::DOUBLE, 4) AS row_completeness_mean FROM ({NULLED})")
def row_completeness(spark, sf_dir):
    return rows.completeness(nulled(spark, sf_dir))


@query("SELECT sum(n - 1)::BIGINT AS duplicate_row_count, round(sum(n - 1) / sum(n), 6) AS duplicate_rate FROM (SELECT count(*) AS n FROM (SELECT nullif(l_returnflag, 'R') AS f, l_linestatus, l_quantity FROM lineitem) GROUP BY f, l_linestatus, l_quantity)")
def duplicate_rows(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(F.nullif("l_returnflag", F.lit("R")).alias("f"), "l_linestatus", "l_quantity")
    return rows.duplicates(x).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


def _patterns_sql(column: str, table: str) -> str:
    trim = f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
    one = lambda n, e, t: f"SELECT '{column}' AS column_name, '{n}' AS pattern, round(r, 3) AS score FROM (SELECT avg(CASE WHEN regexp_matches({trim}, '{e}') THEN 1.0 ELSE 0.0 END) AS r FROM {table} WHERE {column} IS NOT NULL) WHERE r >= {max(t, 0.1)}"
    return " UNION ALL ".join(one(n, e, t) for n, (e, t) in patterns.PATTERNS.items())


MADE = "SELECT 'user' || o_orderkey || '@mail.example' AS mail, '10.0.' || (o_orderkey % 250) || '.' || (o_custkey % 250) AS ip, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE '555-123-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') END AS phone, ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' AS day, o_orderpriority AS plain FROM orders"


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    s = lambda c: c.cast("string")
    return x.select(
        F.concat(F.lit("user"), s(k), F.lit("@mail.example")).alias("mail"),
        F.concat(F.lit("10.0."), s(k % 250), F.lit("."), s(F.col("o_custkey") % 250)).alias("ip"),
        F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit("555-123-"), F.lpad(s(k % 10000), 4, "0"))).alias("phone"),
        F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ")).alias("day"),
        F.col("o_orderpriority").alias("plain"),
    )


@query(" UNION ALL ".join([*(_patterns_sql(c, f"({MADE})") for c in ("mail", "ip", "phone", "day", "plain")), _patterns_sql("url", "pages")]))
def string_patterns(spark, sf_dir):
    return patterns.detect(_made(spark, sf_dir)).unionByName(patterns.detect(read(spark, sf_dir, "pages"), ["url"]))


@query(f"SELECT column_name, rank, CASE WHEN column_name IN ('mail', 'phone') THEN '[REDACTED]' ELSE value END AS value, freq FROM ({_ranked_sql(['mail', 'phone', 'plain'], f'({MADE})', 'DESC')})")
def pii_masking(spark, sf_dir):
    x = _made(spark, sf_dir).select("mail", "phone", "plain")
    return patterns.masked(freq.top_values(x), patterns.detect(x)).select("column_name", "rank", "value", "freq")


def _profiles(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """The rules' inputs of numeric and string columns, exact, one row a column."""
    numbers = [c for c in columns if canonical_of(df.schema[c].dataType) in ("integer", "float")]
    strings = [c for c in columns if canonical_of(df.schema[c].dataType) == "string"]
    out = core.counts(df, columns).join(freq.exact_distinct(df, columns).drop("unique_count", "uniqueness_ratio"), "column_name")
    if numbers:
        n = core.numeric(df, numbers).withColumns({k: F.col(k).cast("string") for k in ("min", "max")})
        out = out.join(n, "column_name", "left").join(core.moments(df, numbers), "column_name", "left").join(core.quantiles(df, numbers, exact=True), "column_name", "left").join(dist.mad(df, numbers), "column_name", "left")
    if strings:
        out = out.join(core.strings(df, strings), "column_name", "left")
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, canonical_of(df.schema[c].dataType))])
    return out.withColumns({"canonical_type": kinds[F.col("column_name")], "table_name": F.lit(table), "nullable": F.lit(True)})


CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment"]
_STATS = {c: ("integer" if c in CUSTOMER[:2] else "float" if c == "c_acctbal" else "string") for c in CUSTOMER}


def _flags_sql() -> str:
    """Rules on the customers' columns, those that concern the column's type, in the rules' order."""
    parts = []
    for c, t in _STATS.items():
        rules = [("high_null_rate", f"(count(*) - count({c})) / count(*) > 0.5"), ("single_value", f"count(DISTINCT {c}) = 1"), ("all_unique", f"count(*) > 1 AND count(DISTINCT {c}) / count(*) > 0.99")]
        if t == "string":
            rules += [("empty_string_dominant", f"max(length({c})) = 0"), ("near_constant", f"max(f) / count(*) > 0.95"), ("high_cardinality", f"count(DISTINCT {c}) > 10000"), ("suspicious_uniform_length", f"min(length({c})) = max(length({c})) AND min(length({c})) > 0"), ("has_leading_trailing_whitespace", f"count_if({c} <> trim({c})) > 0")]
        else:
            far = f"greatest(abs(min({c}) - avg({c})), abs(max({c}) - avg({c})))"
            m = f"(SELECT quantile_cont({c}, 0.5) FROM customer)"
            rules += [
                ("zero_variance", f"stddev_samp({c}) = 0 AND count(DISTINCT {c}) > 1"), ("near_constant", "max(f) / count(*) > 0.95"), ("has_negatives", f"count_if({c} < 0) > 0"),
                ("iqr_outliers", f"min({c}) < quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) OR max({c}) > quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
                ("zscore_outliers", f"{far} / stddev_samp({c}) > 3"), ("high_skewness", f"abs(skewness({c})) > 2"),
                ("mad_outliers", f"0.6745 * greatest(abs(min({c}) - {m}), abs(max({c}) - {m})) / (SELECT quantile_cont(abs({c} - {m}), 0.5) FROM customer) > 3.5"), ("low_cardinality_numeric", f"count(*) >= 100 AND count(DISTINCT {c}) < 10"),
            ]
        names = ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in rules)
        parts.append(f"SELECT '{c}' AS column_name, concat_ws(',', {names}) AS anomalies FROM (SELECT *, count(*) OVER (PARTITION BY {c}) AS f FROM customer)")
    return " UNION ALL ".join(parts)


@query(_flags_sql())
def anomaly_flags(spark, sf_dir):
    flagged = anomaly.flags(_profiles(read(spark, sf_dir, "customer"), CUSTOMER, "customer"))
    return flagged.select("column_name", F.concat_ws(",", "anomalies").alias("anomalies"))


@query(f"SELECT round(100 - least(30, 3 * sum(CASE WHEN anomalies = '' THEN 0 ELSE len(string_split(anomalies, ',')) END)), 1)::DOUBLE AS quality_score FROM ({_flags_sql()})")
def quality_score(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    flagged = anomaly.flags(_profiles(df, CUSTOMER, "customer"))
    return anomaly.quality(flagged, rows.duplicates(df).first()["duplicate_rate"])


def _suggest_sql() -> str:
    t = 'ALTER TABLE "customer"'
    one = lambda c, kind, text, conf, cond: f"SELECT 'customer' AS table_name, '{c}' AS column_name, '{kind}' AS constraint_type, {text} AS expression, {conf}::DOUBLE AS confidence FROM customer HAVING {cond}"
    parts = [one(c, "NOT NULL", f"'{t} ALTER COLUMN \"{c}\" SET NOT NULL'", 0.95, f"count(*) = count({c}) AND count(*) > 0") for c in CUSTOMER]
    parts += [one(c, "UNIQUE", f"'{t} ADD CONSTRAINT uq_customer_{c} UNIQUE (\"{c}\")'", 0.9, f"count(*) > 1 AND count(DISTINCT {c}) / count(*) > 0.99") for c in CUSTOMER]
    parts += [one(c, "CHECK", f"'{t} ADD CONSTRAINT ck_customer_{c}_nonneg CHECK (\"{c}\" >= 0)'", 0.85, f"min({c}) >= 0") for c in CUSTOMER[:3]]
    listed = lambda c: f"(SELECT string_agg('''' || v || '''', ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM customer))"
    parts += [one(c, "ENUM", f"'{t} ADD CONSTRAINT ck_customer_{c}_enum CHECK (\"{c}\" IN (' || {listed(c)} || '))'", "(CASE WHEN count(*) >= 100 THEN 0.9 WHEN count(*) >= 20 THEN 0.8 ELSE 0.7 END)", f"count(DISTINCT {c}) BETWEEN 2 AND 10") for c in CUSTOMER[3:]]
    return " UNION ALL ".join(parts)


@query(_suggest_sql())
def suggested_constraints(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    values = freq.top_values(df, CUSTOMER[3:], 10).select("column_name", "value")
    return anomaly.suggestions(anomaly.flags(_profiles(df, CUSTOMER, "customer")), values).drop("evidence")


def _overlap_sql(left: str, right: str) -> str:
    return (
        f"SELECT o AS overlap_count, l AS left_distinct, r AS right_distinct, round(o / l, 6) AS left_contained, round(o / r, 6) AS right_contained, CASE WHEN least(1.0, o / 1000.0) > 0.1 THEN least(1.0, 0.5 + 0.5 * least(1.0, o / 1000.0)) ELSE least(1.0, o / 1000.0) END::DOUBLE AS confidence FROM "
        f"(SELECT (SELECT count(*) FROM ({left} INTERSECT {right}))::BIGINT AS o, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({left})))::BIGINT AS l, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({right})))::BIGINT AS r)"
    )


@query(_overlap_sql("SELECT l_orderkey FROM lineitem", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"))
def value_overlap(spark, sf_dir):
    return relationships.overlap(read(spark, sf_dir, "lineitem"), ["l_orderkey"], read(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), ["o_orderkey"])


@query(_overlap_sql("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber < 3"))
def multi_column_overlap(spark, sf_dir):
    x, keys = read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]
    return relationships.overlap(x.where("l_linenumber = 1"), keys, x.where("l_linenumber < 3"), keys)


def _bare(df: DataFrame, name: str) -> dict:
    """A profile with what relationships need."""
    flagged = {r["column_name"]: r for r in anomaly.flags(_profiles(df, df.columns, name)).select("column_name", "canonical_type", "anomalies").collect()}
    return {"name": name, "columns": [{"name": c, "canonical_type": r["canonical_type"], "anomalies": r["anomalies"]} for c, r in flagged.items()]}


@query(
    "SELECT 'labels' AS source_table, 'doc_id' AS source_columns, 'documents' AS target_table, 'doc_id' AS target_columns, 'inferred' AS relationship_type, (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents))::BIGINT AS overlap_count"
)
def inferred_relationships(spark, sf_dir):
    tables = {"documents": read(spark, sf_dir, "documents").select("doc_id", "lang"), "labels": read(spark, sf_dir, "labels").unionByName(read(spark, sf_dir, "labels").where("doc_id % 2 = 0"))}
    found = relationships.discover_relationships([_bare(df, n) for n, df in tables.items()], tables.__getitem__, limit=None)
    return _related(spark, found)


def _related(spark: SparkSession, found: list[dict]) -> DataFrame:
    data = [(r["source_table"], ",".join(r["source_columns"]), r["target_table"], ",".join(r["target_columns"]), r["relationship_type"], r["overlap_count"]) for r in found]
    return spark.createDataFrame(data, "source_table string, source_columns string, target_table string, target_columns string, relationship_type string, overlap_count long")


@query(
    "SELECT 'sales' AS source_table, 'ss_customer_sk' AS source_columns, 'customer' AS target_table, 'customer_sk' AS target_columns, 'semantic_fk' AS relationship_type, (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer))::BIGINT AS overlap_count"
)
def semantic_relationships(spark, sf_dir):
    tables = {"sales": read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ss_customer_sk"), "o_totalprice"), "customer": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_sk"), "c_name")}
    return _related(spark, relationships.discover_relationships([_bare(df, n) for n, df in tables.items()], tables.__getitem__, limit=None))


@query(
    "SELECT 'parts' AS source_table, 'l_orderkey,l_linenumber' AS source_columns, 'lines' AS target_table, 'l_orderkey,l_linenumber' AS target_columns, 'inferred_composite' AS relationship_type, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3 INTERSECT SELECT l_orderkey, l_linenumber FROM lineitem))::BIGINT AS overlap_count"
)
def composite_relationships(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    tables = {"lines": x, "parts": x.where("l_linenumber < 3")}
    profiles = [_bare(df, n) for n, df in tables.items()]
    profiles[0]["constraints"] = {"primary_key": ["l_orderkey", "l_linenumber"]}
    return _related(spark, relationships.discover_relationships(profiles, tables.__getitem__, limit=None))


@query("SELECT 'nation' AS table_name, substr(sha256('n_name:string|n_nationkey:integer|n_regionkey:integer'), 1, 16) AS column_hash UNION ALL SELECT 'events', substr(sha256('event_id:integer|event_type:string|props:string|ts:datetime|user_id:integer|value:float'), 1, 16)")
def schema_hash(spark, sf_dir):
    source = ParquetSource(spark, sf_dir)
    infos = [discover(source, t) for t in ("nation", "events")]
    return spark.createDataFrame([(i.name, incremental.column_hash([(c.name, c.canonical_type) for c in i.columns])) for i in infos], "table_name string, column_hash string")


@query(
    "WITH now AS (SELECT count(*) AS n, max(ts) AS t, max(event_id) AS e FROM events), p(state, column_, known, hash, old_t, old_e, old_n) AS ("
    "SELECT 'new', 'ts', false, true, NULL, NULL, NULL UNION ALL SELECT 'altered', 'ts', true, false, t, NULL, n FROM now UNION ALL SELECT 'later', 'ts', true, true, TIMESTAMP '1900-01-01', NULL, n FROM now "
    "UNION ALL SELECT 'longer', 'ts', true, true, t, NULL, 1 FROM now UNION ALL SELECT 'same', 'ts', true, true, t, NULL, n FROM now UNION ALL SELECT 'number', 'event_id', true, true, NULL, 9, n FROM now UNION ALL SELECT 'same_number', 'event_id', true, true, NULL, e, n FROM now) "
    "SELECT state, CASE WHEN NOT known THEN 'new_table' WHEN NOT hash THEN 'schema_changed' WHEN old_t <> t OR old_e <> e THEN 'watermark_advanced' WHEN old_n <> n THEN 'row_count_changed' ELSE 'unchanged' END AS reason FROM p, now"
)
def delta_check(spark, sf_dir):
    df, info = read(spark, sf_dir, "events"), discover(ParquetSource(spark, sf_dir), "events")
    now = incremental.column_hash([(c.name, c.canonical_type) for c in info.columns])
    same = {"column_hash": now, "row_count": df.count(), "watermark_value": incremental.watermark(df, "ts")}
    priors = {"new": None, "altered": same | {"column_hash": "0"}, "later": same | {"watermark_value": "1900-01-01"}, "longer": same | {"row_count": 1}, "same": same}
    found = [(k, incremental.check_delta(df, info, p, "ts").reason) for k, p in priors.items()]
    for k, old in (("number", "9"), ("same_number", incremental.watermark(df, "event_id"))):
        found.append((k, incremental.check_delta(df, info, same | {"watermark_value": old}, "event_id").reason))
    return spark.createDataFrame(found, "state string, reason string")


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M') AS watermark, count(*)::BIGINT AS row_count FROM events")
def watermark(spark, sf_dir):
    return read(spark, sf_dir, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("watermark"), F.count("*").alias("row_count"))


@query("SELECT 'value' AS column_name, count(*)::BIGINT AS rows, count(value)::BIGINT AS non_null, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, min(value) AS least, max(value) AS largest FROM events")
def merge_partial_stats(spark, sf_dir):
    """Statistics of seven parts of the table, merged."""
    parts = incremental.partials(read(spark, sf_dir, "events").withColumn("part", F.col("event_id") % 7), ["value"], "part")
    out = incremental.merge_partials(parts.drop("part"))
    return out.select("column_name", "rows", "non_null", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.col("m2") / (F.col("non_null") - 1)), 6).alias("stddev"), "least", "largest")


@query("SELECT 'value' AS column_name, event_id % 3 AS kind, count(*)::BIGINT AS rows, round(avg(round(value, 3)) + 1000000000, 4) AS mean, round(var_pop(round(value, 3)) * count(*), 2) AS m2 FROM events GROUP BY event_id % 3")
def merge_partials_far_from_zero(spark, sf_dir):
    """Of values moved by a billion, whose squares hold no digit of their deviations."""
    df = read(spark, sf_dir, "events").select((F.col("event_id") % 7).alias("part"), (F.col("event_id") % 3).alias("kind"), (F.round("value", 3) + F.lit(1e9)).alias("value"))
    out = incremental.merge_partials(incremental.partials(df, ["value"], "part", "kind").drop("part"), "kind")
    return out.select("column_name", "kind", "rows", F.round("mean", 4).alias("mean"), F.round("m2", 2).alias("m2"))


@query("SELECT count(*)::BIGINT AS total_row_count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, round(var_samp(value), 4) AS variance, min(value) AS min, max(value) AS max, round(sum(value), 2) AS sum FROM events")
def merge_profiles(spark, sf_dir):
    """The profile of the earlier events merged with that of the later ones, against one pass over all."""
    df = read(spark, sf_dir, "events")

    def part(some: DataFrame) -> dict:
        row = core.numeric(some, ["value"]).join(core.moments(some, ["value"]), "column_name").join(core.counts(some, ["value"]), "column_name").first().asDict()
        return {"name": "events", "total_row_count": row["total_rows"], "columns": [row | {"name": "value"}]}

    mid = df.agg(F.percentile_approx("ts", 0.6).alias("m")).first()["m"]
    out = incremental.merge_profiles(part(df.where(F.col("ts") <= F.lit(mid))), part(df.where(F.col("ts") > F.lit(mid))), exact=True)
    c = out["columns"][0]
    return spark.createDataFrame([(out["total_row_count"], round(c["mean"], 6), round(c["stddev"], 6), round(c["variance"], 4), c["min"], c["max"], round(c["sum"], 2))], "total_row_count long, mean double, stddev double, variance double, min double, max double, sum double")


_TABLES = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]}


def _schema_sql(what: str) -> str:
    cols = " UNION ALL ".join(f"SELECT '{t}' AS t, unnest({names}) AS c" for t, names in _TABLES.items())
    u = "'urn:profiler:mydb:public'"
    if what == "nodes":
        return f"WITH x AS ({cols}) SELECT 'urn:profiler:mydb' AS id, 'Database' AS label UNION ALL SELECT {u}, 'Schema' UNION ALL SELECT DISTINCT {u} || ':' || t, 'Table' FROM x UNION ALL SELECT {u} || ':' || t || ':' || c, 'Column' FROM x"
    return f"WITH x AS ({cols}) SELECT 'urn:profiler:mydb' AS source, {u} AS target, 'HAS_SCHEMA' AS label UNION ALL SELECT DISTINCT {u}, {u} || ':' || t, 'HAS_TABLE' FROM x UNION ALL SELECT {u} || ':' || t, {u} || ':' || t || ':' || c, 'HAS_COLUMN' FROM x"


def _table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = ParquetSource(spark, sf_dir)
    return spark.createDataFrame([(t, c.name) for t in _TABLES for c in discover(source, t).columns], "table_name string, column_name string")


@query(_schema_sql("nodes"))
def graph_nodes(spark, sf_dir):
    return graph.schema_nodes(_table_columns(spark, sf_dir), "MyDB", "public")


@query(_schema_sql("edges"))
def graph_edges(spark, sf_dir):
    return graph.schema_edges(_table_columns(spark, sf_dir), "MyDB", "public")


@query("SELECT * FROM (SELECT 'nation' AS table_name, count(*)::BIGINT AS row_count, 3 AS columns FROM nation UNION ALL SELECT 'orders', count(*)::BIGINT, 6 FROM orders UNION ALL SELECT 'documents', count(*)::BIGINT, 5 FROM documents)")
def fast_profile(spark, sf_dir):
    source = ParquetSource(spark, sf_dir)
    return spark.createDataFrame([(t, source.read(t).count(), len(discover(source, t).columns)) for t in ("nation", "orders", "documents")], "table_name string, row_count long, columns int")


def _drawn(df: DataFrame, rows: DataFrame, size) -> DataFrame:
    """Of a sample: whether its size is right, and whether it holds columns of 2 and 50 values and a mean as the table does."""
    share = lambda t: t.agg(F.avg((F.col("l_linestatus") == "O").cast("int")).alias("two"), F.count_distinct("l_quantity").alias("many"), F.avg("l_extendedprice").alias("mean"), F.max("n").alias("most"), F.count("*").alias("rows")).first()
    counted = lambda t: t.withColumn("n", F.lit(0))
    a, b = share(counted(df)), share(counted(rows))
    most = rows.groupBy("l_quantity").count().agg(F.max("count")).first()[0] / b["rows"]
    whole = df.groupBy("l_quantity").count().agg(F.max("count")).first()[0] / a["rows"]
    near = abs(a["two"] - b["two"]) < 0.03 and abs(b["mean"] / a["mean"] - 1) < 0.05 and a["many"] == b["many"] and most < whole + 0.02
    return df.sparkSession.createDataFrame([(bool(size(b["rows"])), bool(near))], "size_is_right boolean, balanced boolean")


_BALANCED = "SELECT true AS size_is_right, true AS balanced"


@query(_BALANCED)
def sample_exact(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return _drawn(df, sample(df, 10_000), lambda n: n == 10_000)


@query(_BALANCED)
def sample_bernoulli(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return _drawn(df, sample(df, 10_000, method="bernoulli"), lambda n: abs(n - 10_000) < 500)


@query(_BALANCED)
def sample_random(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return _drawn(df, sample(df, 10_000, method="random"), lambda n: n == 10_000)


@query("SELECT 10000::BIGINT AS rows, count(DISTINCT l_quantity)::BIGINT AS distinct_values, true AS balanced FROM lineitem")
def sample_values(spark, sf_dir):
    """Up to 10 000 values of a column of 50 values: all of them are there, none much oftener than in the table."""
    df = read(spark, sf_dir, "lineitem")
    drawn = limited_values(df, "l_quantity").groupBy("value").agg(F.count("*").alias("n"))
    whole = df.groupBy(F.col("l_quantity").alias("value")).agg((F.count("*") / df.count()).alias("share"))
    far = F.max(F.abs(F.col("n") / 10_000 - F.col("share")))
    return drawn.join(whole, "value").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_values"), (far < 0.01).alias("balanced"))


_CUSTOMER = {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{t}' AS canonical_type, (count(*) - count({c}))::BIGINT AS null_count, count(DISTINCT {c})::BIGINT AS distinct_values, count({c}) = count(*) AND count(DISTINCT {c}) >= 0.99 * count(*) AS pk_candidate, "
        + (f"round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, NULL::INTEGER AS max_length" if t != "string" else f"NULL::DOUBLE AS mean, NULL::DOUBLE AS median, max(length({c}))::INTEGER AS max_length")
        + " FROM customer"
        for c, t in _CUSTOMER.items()
    )
)
def profile_columns(spark, sf_dir):
    """What the profile of a whole table tells of its columns, one row a column."""
    from .config import Config
    from .plans.profile import profile_table

    source = ParquetSource(spark, sf_dir)
    config = Config(sample_size=0, as_of=AS_OF, exact_distinct=True, exact_quantiles=True)
    found = profile_table(source.read("customer"), discover(source, "customer"), config, order=["c_custkey"])
    short = lambda v: None if v is None else round(float(v), 4)
    rows = [(c["name"], c["canonical_type"], c["null_count"], c["distinct_values"], c["pk_candidate"], short(c.get("mean")), short(c.get("median")), c.get("max_length")) for c in found["columns"]]
    return spark.createDataFrame(rows, "name string, canonical_type string, null_count long, distinct_values long, pk_candidate boolean, mean double, median double, max_length int")
