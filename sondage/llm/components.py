"""Distributed union-find with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

SALTS = 4


def join_hot(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins ``many`` (any number of rows a key) to ``one`` (one row a key) without gathering a hot key in one task.

    The key is dealt out over ``salts`` tasks by a hash of ``spread``; as both sides are shuffled anew by key and salt,
    adaptive execution can split what is still too large.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hot_keys(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The keys of more than ``most`` rows and the number of parts to deal each into; at most 1 key for ``most`` rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("salts"))


def join_dealt(many: DataFrame, one: DataFrame, key: str, spread: str, hot: DataFrame) -> DataFrame:
    """Joins ``many`` to ``one`` (one row a key); the keys of ``hot`` are dealt into as many parts as it says.

    Only rows of hot keys are copied. ``hot`` is a written table of hot_keys(), whose size that function bounds.
    """
    hot = F.broadcast(hot.select(key, "salts"))
    left = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    return edges.join(F.broadcast(least), "a") if few else join_hot(edges, least, "a", "b")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both.where("b > a"), least, few).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = _with_least(edges, least, few).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60, broadcast_rows: int = 0) -> DataFrame:
    """Labels of the nodes of ``edges`` (a, b: long): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star until no edge changes; a component that is a path of n nodes takes O(log n)
    rounds. Nodes without an edge get no row, nor does the smallest node of a component. Self-loops, repeated and
    reversed edges are allowed; rows with a null end are ignored; without edges the result is empty. Up to ``broadcast_rows`` edges, the nodes' least neighbours are broadcast.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = scratch.write(now), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, few = mark, 2 * mark[0] <= broadcast_rows
        new = scratch.write(_small_star(_large_star(now, few), few))
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
