"""Association of columns: Pearson, Spearman, mutual information, Cramér's V and functional dependencies."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MOST_EXPRESSIONS, bucket, col, union
from ..types import NUMERIC, columns_of
from .dist import _ends


def _pairs(columns: list[str], most: int) -> list[tuple[str, str]]:
    return list(combinations(columns[:most], 2))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient over rows with both values; null where it is undefined, in any ANSI mode."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, columns: list[str] | None = None, most: int = 20) -> DataFrame:
    """col1, col2, pearson (4 decimals) of every pair of the first ``most`` numeric columns; null if undefined."""
    pairs, parts = _pairs(columns_of(df.schema, *NUMERIC) if columns is None else columns, most), []
    for i in range(0, len(pairs), MOST_EXPRESSIONS // 2):
        some = pairs[i : i + MOST_EXPRESSIONS // 2]
        row = df.agg(*[correlation(col(a).cast("double"), col(b).cast("double")).alias(f"r{n}") for n, (a, b) in enumerate(some)])
        parts.append(row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.round(F.nanvl(F.col(f"r{n}"), F.lit(None)), 4).alias("pearson")) for n, (a, b) in enumerate(some)]))))
    return union(parts) if parts else df.sparkSession.createDataFrame([], "col1 string, col2 string, pearson double")


def _min_ranks(rows: DataFrame, c: str, ranges: int = 64) -> DataFrame:
    """value -> rank (1 + the number of smaller values), from the value frequencies, in ranges of values.

    Running sums are taken inside each range and shifted by the totals of the ranges before, so that no single task
    sees all values. The ranges' bounds are approximate quantiles of the distinct values.
    """
    freq = rows.groupBy(col(c).alias("v")).agg(F.count("*").alias("n"))
    bounds = freq.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], F.lit(1000))).first()[0] or []
    below = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col("v"))) if bounds else F.lit(0)
    dealt = freq.withColumn("part", below)
    own = dealt.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("v")) - F.col("n"))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("t"))
    shift = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("shift"))  # one row a range
    return own.join(F.broadcast(shift), "part").select(F.col("v").alias(c), (F.col("before") + F.col("shift") + 1).alias(f"rank_{c}"))


#: Rows that one task may sort for ranks.
SORTED_ROWS = 2_000_000


def spearman(df: DataFrame, columns: list[str] | None = None, most: int = 20, distributed: bool | None = None) -> DataFrame:
    """col1, col2, spearman (4 decimals): correlation of minimum ranks over the rows where both have a value.

    ``distributed`` ranks by value frequencies in ranges of values; otherwise by one sorted window a column. By default
    tables of more than SORTED_ROWS rows are ranked in ranges.
    """
    if distributed is None:
        distributed = df.limit(SORTED_ROWS + 1).count() > SORTED_ROWS
    pairs, parts = _pairs(columns_of(df.schema, *NUMERIC) if columns is None else columns, most), []
    for a, b in pairs:
        rows = df.select(col(a).cast("double").alias("x"), col(b).cast("double").alias("y")).where("x is not null and y is not null")
        if distributed:
            ranked = rows.join(_min_ranks(rows, "x"), "x").join(_min_ranks(rows, "y"), "y").select(F.col("rank_x").alias("x"), F.col("rank_y").alias("y"))
        else:
            ranked = rows.select(F.rank().over(Window.orderBy("x")).alias("x"), F.rank().over(Window.orderBy("y")).alias("y"))
        r = correlation(F.col("x").cast("double"), F.col("y").cast("double"))
        parts.append(ranked.agg(F.round(F.nanvl(r, F.lit(None)), 4).alias("spearman")).select(F.lit(a).alias("col1"), F.lit(b).alias("col2"), "spearman"))
    return union(parts) if parts else df.sparkSession.createDataFrame([], "col1 string, col2 string, spearman double")


def nmi(df: DataFrame, columns: list[str] | None = None, most: int = 20, bins: int = 10) -> DataFrame:
    """col1, col2, nmi (4 decimals, 0 to 1): mutual information of equal-width bins over the root of the entropies.

    All pairs are counted in one pass over integer cells. Constant columns have no pairs; 0 if an entropy is 0.
    """
    columns = columns_of(df.schema, *NUMERIC) if columns is None else columns
    ends = _ends(df, columns[:most])
    columns = [c for c in columns[:most] if c in ends and ends[c][0] < ends[c][1]]
    pairs = _pairs(columns, most)
    if not pairs:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, nmi double")
    x = {c: F.when(F.abs(col(c).cast("double")) < float("inf"), bucket(col(c).cast("double"), *ends[c], bins) - 1) for c in columns}
    binned = df.select(*[x[c].alias(f"b{i}") for i, c in enumerate(columns)])
    at = {c: F.col(f"b{i}") for i, c in enumerate(columns)}
    size = bins * bins
    cells = binned.select(F.explode(F.array(*[F.lit(n * size) + at[a] * bins + at[b] for n, (a, b) in enumerate(pairs)])).alias("cell"))
    cells = cells.where("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))
    cells = cells.select(F.floor(F.col("cell") / size).cast("int").alias("pair"), F.floor((F.col("cell") % size) / bins).alias("i"), (F.col("cell") % bins).alias("j"), F.col("n").cast("double").alias("n"))
    sums = lambda k: F.sum("n").over(Window.partitionBy("pair", *k))
    cells = cells.select("*", sums([]).alias("all"), sums(["i"]).alias("a"), sums(["j"]).alias("b"), F.count("*").over(Window.partitionBy("pair", "i")).alias("ni"), F.count("*").over(Window.partitionBy("pair", "j")).alias("nj"))
    t = F.col("all")
    # an entropy's term is spread evenly over the cells of its row or column
    sums_ = cells.groupBy("pair").agg(
        F.sum(F.col("n") / t * F.log(F.col("n") * t / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(F.col("a") / t * F.log(F.col("a") / t) / F.col("ni"))).alias("hx"),
        (-F.sum(F.col("b") / t * F.log(F.col("b") / t) / F.col("nj"))).alias("hy"),
    )
    value = F.when((F.col("hx") < 1e-12) | (F.col("hy") < 1e-12), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("mi"), F.sqrt(F.col("hx") * F.col("hy"))))), 4))
    names = F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2")) for a, b in pairs])
    return sums_.select(names[F.col("pair")]["col1"].alias("col1"), names[F.col("pair")]["col2"].alias("col2"), value.alias("nmi"))


def cramers_v(df: DataFrame, columns: list[str] | None = None, most: int = 5, full_chi2: bool = False) -> DataFrame:
    """col1, col2, cramers_v (4 decimals). Chi-square sums over cells that occur, or over all (``full_chi2``).

    Columns default to the first ``most`` string columns with 2 to 49 distinct values; 0 for degenerate tables.
    """
    if columns is None:
        strings = columns_of(df.schema, "string")
        from .freq import exact_distinct

        few = {r["column_name"] for r in exact_distinct(df, strings).where("distinct_values > 1 and distinct_values < 50").collect()} if strings else set()
        columns = [c for c in strings if c in few][:most]
    parts = []
    for a, b in combinations(columns[:most], 2):
        cells = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
        over = lambda *k: F.sum("n").over(Window.partitionBy(*k))
        cells = cells.select("*", over(F.lit(0)).alias("all"), over("a").alias("ra"), over("b").alias("rb"))  # cells of two short value lists
        e = F.col("ra") * F.col("rb") / F.col("all")
        row = cells.agg(F.sum(F.pow(F.col("n") - e, 2) / e).alias("chi2"), F.sum(e).alias("seen"), F.max("all").alias("all"), F.count_distinct("a").alias("k1"), F.count_distinct("b").alias("k2"))
        chi2 = F.col("chi2") + ((F.col("all") - F.col("seen")) if full_chi2 else F.lit(0.0))
        k = F.least("k1", "k2") - 1
        parts.append(row.select(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.when((k > 0) & (F.col("all") > 0), F.round(F.sqrt(F.try_divide(chi2, F.col("all") * k)), 4)).otherwise(0.0).alias("cramers_v")))
    return union(parts) if parts else df.sparkSession.createDataFrame([], "col1 string, col2 string, cramers_v double")


def functional_dependencies(df: DataFrame, columns: list[str] | None = None, most: int = 8, most_values: int = 50) -> DataFrame:
    """from_column, to_column where each value of the first goes with a single value of the second.

    Candidates: the first ``most`` string, integer or boolean columns with 2 to ``most_values`` distinct values. Rows where
    either is null are left out. One pass collects the pairs' distinct values; their number is bounded.
    """
    if columns is None:
        kinds = columns_of(df.schema, "string", "integer", "boolean")
        from .freq import exact_distinct

        few = {r["column_name"] for r in exact_distinct(df, kinds).where(f"distinct_values > 1 and distinct_values <= {most_values}").collect()} if kinds else set()
        columns = [c for c in kinds if c in few][:most]
    pairs = list(permutations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "from_column string, to_column string")
    combos = df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).distinct()
    number = {c: i for i, c in enumerate(columns)}
    rows = combos.select(F.inline(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(f"c{number[a]}").alias("a"), F.col(f"c{number[b]}").alias("b")) for n, (a, b) in enumerate(pairs)])))
    per = rows.where("a is not null and b is not null").groupBy("pair", "a").agg(F.count_distinct("b").alias("n"))
    names = F.array(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in pairs])
    held = per.groupBy("pair").agg(F.max("n").alias("n")).where("n = 1")
    return held.select(names[F.col("pair")]["f"].alias("from_column"), names[F.col("pair")]["t"].alias("to_column"))
