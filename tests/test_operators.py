"""Operators on small tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.config import Thresholds
from sondage.functions.columns import chi_square_p, normal_quantile
from sondage.operators import anomaly, assoc, core, dist, freq, patterns, rows
from sondage.sources.readers import limited_values, sample


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def known(spark):
    i = F.col("i")
    return spark.range(1, 1001).select(F.col("id").alias("i")).select(
        i.alias("id"), F.when(i <= 800, i).alias("with_nulls"), (i <= 700).alias("is_active"), ((i - 1) % 10).cast("string").alias("dept"),
        F.date_add(F.lit("2020-01-01").cast("date"), ((i - 1) % 366).cast("int")).alias("created"), (i * 100.0).alias("amount"),
    )


def test_counts_and_core(known):
    c = by_column(core.counts(known))
    assert (c["with_nulls"]["null_count"], c["with_nulls"]["null_rate"], c["id"]["null_count"]) == (200, 0.2, 0)
    n = by_column(core.numeric(known))
    assert (n["id"]["min"], n["id"]["max"], n["id"]["mean"], n["amount"]["mean"]) == (1, 1000, 500.5, 50050)
    assert by_column(core.moments(known))["id"]["stddev"] == pytest.approx(288.819436, rel=1e-6)
    b = by_column(core.booleans(known))["is_active"]
    assert (b["true_count"], b["true_rate"], b["imbalance_ratio"]) == (700, 0.7, round(7 / 3, 4))
    assert by_column(core.quantiles(known, ["id"], exact=True))["id"]["median"] == 500.5


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a long, s string, b boolean")
    assert by_column(core.counts(empty))["a"]["null_rate"] == 0.0
    assert by_column(core.numeric(empty))["a"]["zero_count"] is None
    assert by_column(core.booleans(empty))["b"]["true_rate"] is None
    assert dist.histogram(empty).count() == 0
    assert rows.duplicates(empty).first().asDict() == {"duplicate_row_count": 0, "duplicate_rate": 0.0}
    assert freq.keys(empty, ["a"]).first()["pk_candidate"] is False


def test_frequencies(spark, known):
    d = by_column(freq.exact_distinct(known, ["dept", "id"]))
    assert (d["dept"]["distinct_values"], d["id"]["unique_count"]) == (10, 1000)
    assert [r["freq"] for r in freq.top_values(known, ["dept"]).collect()] == [100] * 5
    k = by_column(freq.keys(known, ["id", "dept"]))
    assert k["id"]["pk_candidate"] and not k["dept"]["pk_candidate"]
    few = spark.createDataFrame([("a",), ("b",)], "v string")
    assert freq.bottom_values(few, ["v"]).count() == 0


def test_granularity(spark):
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "d string").select(F.col("d").cast("date").alias("d"))
    daily = core.dates(days(*[f"2024-01-{i:02}" for i in range(1, 31)]), "2024-02-01").first()
    assert (daily["date_range_days"], daily["granularity_guess"], daily["freshness_days"]) == (29, "daily", 2)
    assert core.dates(days(*[f"2024-{i:02}-01" for i in range(1, 13)]), "2024-12-31").first()["granularity_guess"] == "monthly"
    one = core.dates(days("2024-01-01"), "2024-01-01").first()
    assert (one["date_range_days"], one["granularity_guess"]) == (0, "unknown")


def test_histogram_and_cdf(spark):
    bins = dist.histogram(spark.range(1, 101).select(F.col("id").cast("double").alias("v")))
    assert bins.agg(F.sum("count")).first()[0] == 100 and bins.count() == 10
    assert [r["cumulative_pct"] for r in dist.cdf(bins).orderBy("x").collect()][-1] == 1.0
    flat = dist.histogram(spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "v double")).collect()
    assert [(r["bin_start"], r["bin_end"], r["count"]) for r in flat] == [(5.0, 5.0, 3)]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (2.0,), (None,)], "v double")
    assert dist.histogram(odd).agg(F.sum("count")).first()[0] == 2


def test_mad_kde_qq(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 2, 4, 6, 9)], "v double")
    assert dist.mad(v).first()["mad"] == 1.0
    assert dist.mad(v.limit(2)).first()["mad"] is None
    n = spark.range(1, 201).select(F.col("id").cast("double").alias("v"))
    points = dist.kde(n, "v").orderBy("x").collect()
    step = points[1]["x"] - points[0]["x"]
    assert len(points) == 50 and 0.7 < sum(p["y"] for p in points) * step < 1.1
    actual = [r["actual"] for r in dist.qq_plot(n, "v").orderBy("theoretical").collect()]
    assert len(actual) == 50 and actual == sorted(actual)
    assert dist.kde(v.limit(3), "v").count() == 0


def test_benford(spark):
    shaped = spark.range(1, 1001).select(F.pow(F.lit(10.0), F.col("id") / 1000 * 4).alias("v"))
    assert dist.benford_test(dist.benford_digits(shaped))[0][2] > 0.01
    flat = spark.range(0, 1800).select((F.col("id") % 9 + 1).cast("double").alias("v"))
    assert dist.benford_test(dist.benford_digits(flat))[0][2] < 0.01
    assert dist.benford_digits(flat.limit(50)).count() == 0
    assert chi_square_p(0, 8) == 1.0 and chi_square_p(100, 8) < 0.001 and 0.01 < chi_square_p(15.51, 8) < 0.15
    assert normal_quantile(0.975) == pytest.approx(1.96, abs=1e-2)


def test_monotonic(spark):
    t = spark.range(0, 100).select("id", (-F.col("id")).alias("down"), F.lit(1).alias("flat"))
    m = by_column(dist.monotonic(t, ["id", "down", "flat"], order=["id"]))
    assert (m["id"][1], m["id"][2]) == (True, False) and (m["down"][1], m["down"][2]) == (False, True) and m["flat"][1] is None


def test_associations(spark):
    i = F.col("id") + 1
    t = spark.range(0, 200).select(i.alias("a"), (2 * i).alias("b"), (i % 7).alias("c"), (i * i * i).alias("d"), F.lit(3).alias("k"))
    p = {(r[0], r[1]): r[2] for r in assoc.pearson(t).collect()}
    assert p["a", "b"] == 1.0 and abs(p["a", "c"]) < 0.5 and p["a", "k"] is None
    for how in (False, True):
        assert {(r[0], r[1]): r[2] for r in assoc.spearman(t, ["a", "d"], distributed=how).collect()} == {("a", "d"): 1.0}
    n = {(r[0], r[1]): r[2] for r in assoc.nmi(t).collect()}
    assert n["a", "b"] > 0.8 and all(0 <= x <= 1 for x in n.values()) and ("a", "k") not in n
    cats = spark.createDataFrame([("A", "1")] * 50 + [("B", "2")] * 50, "x string, y string")
    assert assoc.cramers_v(cats).first()["cramers_v"] == 0.7071
    assert assoc.cramers_v(cats, full_chi2=True).first()["cramers_v"] == 1.0
    assert assoc.cramers_v(cats.withColumn("x", F.lit("A")), ["x", "y"]).first()["cramers_v"] == 0.0
    assert assoc.pearson(t, ["a"]).count() == 0


def test_functional_dependencies(spark):
    t = spark.createDataFrame([(1, "Engineering", 101, 90000.0), (1, "Engineering", 102, 85000.0), (2, "Marketing", 201, 75000.0), (2, "Marketing", 202, 80000.0), (3, "Finance", 301, 95000.0)], "dept_id int, dept_name string, emp_id int, salary double")
    found = {tuple(r) for r in assoc.functional_dependencies(t).collect()}
    assert {("dept_id", "dept_name"), ("dept_name", "dept_id"), ("emp_id", "dept_id")} <= found and ("dept_id", "emp_id") not in found


def test_rows(spark):
    t = spark.createDataFrame([(1, 2, 3), (4, None, 6), (7, None, None)], "a int, b int, c int")
    assert rows.completeness(t).first().asDict() == {"row_completeness_min": 0.3333, "row_completeness_max": 1.0, "row_completeness_mean": 0.6667}
    d = spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "carol"), (1, "alice"), (2, "bob")], "id int, name string")
    assert rows.duplicates(d).first().asDict() == {"duplicate_row_count": 2, "duplicate_rate": 0.4}
    assert rows.duplicates(d, most_columns=1).first()["duplicate_row_count"] == 0


def test_patterns_and_masking(spark):
    t = spark.createDataFrame([(f"u{i}@x.org", f"10.0.0.{i}", f"{i:03}-12-3456", f" https://x.org/{i}\t", "plain") for i in range(20)], "mail string, ip string, ssn string, url string, p string")
    found = {(r["column_name"], r["pattern"]) for r in patterns.detect(t).collect()}
    assert found == {("mail", "email"), ("ip", "ipv4"), ("ssn", "ssn"), ("url", "url")}
    top = {r["column_name"]: r["value"] for r in patterns.masked(freq.top_values(t, k=1), patterns.detect(t)).collect()}
    assert top["mail"] == top["ssn"] == "[REDACTED]" and top["p"] == "plain"


def test_anomaly_rules(spark):
    base = {"column_name": "c", "canonical_type": "integer", "null_rate": 0.0, "distinct_values": 50, "total_rows": 1000, "mean": 5.0, "stddev": 1.0, "median": 5.0, "p25": 4.0, "p75": 6.0, "mad": 1.0, "min": "2", "max": "8", "top_frequency": 30, "negative_count": 0, "skewness": 0.1}
    schema = "column_name string, canonical_type string, null_rate double, distinct_values long, total_rows long, mean double, stddev double, median double, p25 double, p75 double, mad double, min string, max string, top_frequency long, negative_count long, skewness double"

    def flags(**changes):
        return set(anomaly.flags(spark.createDataFrame([base | changes], schema), Thresholds()).first()["anomalies"])

    assert flags() == set()
    assert flags(null_rate=0.51) == {"high_null_rate"} and flags(null_rate=0.5) == set()
    assert flags(distinct_values=1) == {"single_value", "low_cardinality_numeric"}
    assert flags(distinct_values=995) == {"all_unique"} and flags(distinct_values=1051) == set()
    assert flags(max="30") == {"iqr_outliers", "zscore_outliers", "mad_outliers"}
    assert flags(negative_count=3, skewness=-2.5, top_frequency=960) == {"has_negatives", "high_skewness", "near_constant"}
    assert flags(stddev=0.0) == {"zero_variance"}


def test_quality(spark):
    t = spark.createDataFrame([(0.0, ["x"]), (0.5, ["y", "z"])], "null_rate double, anomalies array<string>")
    assert anomaly.quality(t, 0.05).first()[0] == 100 - 9 - 10 - 5
    assert anomaly.quality(t.limit(0)).first()[0] == 100.0


def test_sampling(spark):
    t = spark.range(0, 5000).repartition(3)
    a, b = ({r[0] for r in sample(x, 100).collect()} for x in (t, t.repartition(7)))
    assert a == b and len(a) == 100
    assert sample(t, 0).count() == sample(t, 9999).count() == 5000
    assert 30 < sample(t, 100, method="bernoulli").count() < 250
    means = [sample(t, 1000, method="random", seed=s).agg(F.avg("id")).first()[0] for s in range(3)]
    assert all(math.isclose(m, 2499.5, rel_tol=0.1) for m in means)


def test_samples_draw_repeated_rows_as_others(spark, tmp_path):
    t = spark.range(0, 20_000).select((F.col("id") % 20).alias("v"), (F.col("id") % 2).cast("string").alias("w"))
    t.repartition(5).write.parquet(f"{tmp_path}/t")
    for x in (t, spark.read.parquet(f"{tmp_path}/t")):
        for draw in (sample(x, 2000), limited_values(x, "v", 2000).withColumnRenamed("value", "v")):
            n = {r["v"]: r["n"] for r in draw.groupBy("v").agg(F.count("*").alias("n")).collect()}
            assert sum(n.values()) == 2000 and len(n) == 20 and all(60 < k < 145 for k in n.values())
    again = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(map(tuple, sample(again, 50).collect())) == sorted(map(tuple, sample(again, 50).collect()))
    means = [sample(spark.range(100_000).select((F.col("id") + F.lit(7919 * i)).alias("v")), 10_000).agg(F.avg(F.col("v") - 7919 * i)).first()[0] for i in range(5)]
    assert np.std(means) / np.mean(means) < 0.05
    odd = spark.createDataFrame([(i, {"a": i}) for i in range(50)], "id long, m map<string,int>")
    assert sample(odd, 10).count() == 10


def test_order_statistics(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=3000).round(1), rng.integers(0, 3, 3000)
    t = spark.createDataFrame([(float(a), int(b), None) for a, b in zip(x, y)] + [(None, 1, None)], "x double, y int, z double").repartition(4)
    q = by_column(core.quantiles(t, ["x", "y", "z"], exact=True))
    for name, at in core.QUANTILES.items():
        assert q["x"][name] == pytest.approx(np.quantile(x, at)) and q["y"][name] == pytest.approx(np.quantile([*y, 1], at)) and q["z"][name] is None
    m = by_column(dist.mad(t, ["x", "y", "z"]))
    assert m["x"]["mad"] == pytest.approx(np.median(np.abs(x - np.median(x)))) and m["z"]["mad"] is None
    assert {r["column_name"] for r in dist.densities(t, ["x", "y", "z"]).collect()} == {"x", "y"}


def test_monotonic_over_many_ranges(spark):
    t = spark.range(0, 30_000, 1, 6).select("id", F.when(F.col("id") == 17_777, 0).otherwise(F.col("id")).alias("dip"), (F.col("id") / 100).cast("long").alias("steps"))
    m = by_column(dist.monotonic(t, ["id", "dip", "steps"], order=["id"]))
    assert [m[c][1] for c in ("id", "dip", "steps")] == [True, False, True] and not any(m[c][2] for c in ("id", "dip", "steps"))


def test_frequencies_of_all_columns(spark, known):
    g = freq.grouped(known, ["dept", "id", "with_nulls"])
    d = by_column(freq.distinct_of(g))
    assert (d["dept"]["distinct_values"], d["id"]["unique_count"], d["with_nulls"]["distinct_values"]) == (10, 1000, 800)
    assert [r["value"] for r in freq.ranked_of(g, 3).where("column_name = 'dept'").orderBy("rank").collect()] == ["0", "1", "2"]
    assert freq.exact_distinct(known.limit(0), ["dept"]).first()["distinct_values"] == 0
