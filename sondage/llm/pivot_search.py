"""Exact top-k by inner product with pivot-table elimination.

For integer vectors |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so a lower bound of a distance is an upper bound of a score. The
pivot table holds each vector's distances to PIVOTS pivots; by the triangle inequality max_p |d(q, p) - d(x, p)| bounds
d(q, x) from below, less what rounding can add: a part in 10^12 of the largest pivot distance. A block of queries takes
the candidates of a group in the order of their bounds, tile by tile, and ends when no bound that is left reaches the
k-th best score of any query; equal scores go to the smaller id, so an equal bound is still evaluated.

Vectors lie in the cell of their nearest pivot, cells are cut into chunks of bounded size. A first pass searches one
chunk of each query's own cell for a threshold; the second sends a query only to cells whose range of pivot distances
can hold a better score, and a chunk only to the parts of queries that are sent there, so the answer is exact for any
pivots. They are fitted on a bounded sample of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import by_groups
from .shared import Scratch
from .vectors import ragged

PIVOTS, SAMPLE = 32, 2000
#: Vectors of a chunk, queries of a part of them, and candidates that a block of queries evaluates at once.
CHUNK, QUERIES, BATCH, TILE = 4096, 16_384, 128, 256
#: Rounding of a bound as a share of the largest distance to a pivot, and of a score's bound as a share of the norms.
ROUNDING, SLACK = 1e-12, 1e-9


def _pivots(rows: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """Farthest-first pivots for each length of vectors, out of the ``sample`` rows with the smallest hash of the id."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    found, by_size = ragged(some["v"]), {}
    for size in {len(x) for _, x in found}:
        x = np.stack([v for _, v in found if len(v) == size])
        at, best = [int(np.argmax((x * x).sum(1)))], np.full(len(x), np.inf)
        while len(at) < min(n, len(x)):
            best = np.minimum(best, ((x - x[at[-1]]) ** 2).sum(1))
            at.append(int(best.argmax()))
        by_size[size] = x[at]
    return by_size


def _table(pivots) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ragged(batch.column(1))
            for size in sorted({len(x) for _, x in rows}):
                at = np.array([i for i, x in rows if len(x) == size])
                x = np.stack([v for _, v in rows if len(v) == size])
                p = pivots.value.get(size, np.zeros((1, size)))
                d = np.sqrt(np.maximum(((x[:, None] - p[None]) ** 2).sum(2), 0)) if len(x) * p.size < 1 << 24 else np.concatenate([np.sqrt(((c[:, None] - p[None]) ** 2).sum(2)) for c in np.array_split(x, 1 + len(x) * p.size // (1 << 24))])
                cell = d.argmin(1) + size * 4096
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(cell.astype(np.int64)), pa.array((x * x).sum(1)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in d], pa.binary())],
                    names=["id", "asks", "cell", "norm", "x", "d"],
                )

    return run


def _upper_bounds(asked: np.ndarray, held: np.ndarray, asked_norm: np.ndarray, held_norm: np.ndarray) -> np.ndarray:
    """By query and candidate, no less than their inner product. asked, held: distances to the pivots, by row."""
    low = np.zeros((len(asked), len(held)))
    for p in range(asked.shape[1]):
        np.maximum(low, np.abs(asked[:, p, None] - held[None, :, p]), out=low)
    low = np.maximum(low - ROUNDING * (asked.max(1)[:, None] + held.max(1)[None]), 0)
    both = asked_norm[:, None] + held_norm[None]
    return (both - low * low) / 2 + SLACK * (both + 1)


def _search(k: int):
    """Groups of candidates and queries (kind 1); gives up to k rows a query: those that may be among its best."""

    def act(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, rows, ids, norm, floor = (table[c].to_numpy() for c in ("kind", "row", "id", "norm", "floor"))
        xs, ds = table["x"], table["d"]
        out: list[tuple[np.ndarray, ...]] = []
        for s, e in zip(starts.tolist(), starts[1:].tolist()):
            at = np.flatnonzero(kind[s:e] == 1)
            of = np.flatnonzero(kind[s:e] == 0)
            if not len(at) or not len(of):
                continue
            x = np.stack([np.frombuffer(v.as_buffer()) for v in xs[s:e]])
            d = np.stack([np.frombuffer(v.as_buffer()) for v in ds[s:e]])
            # doubles hold the products exactly below 2^53; larger ones are summed as integers
            if float(np.abs(x).max()) ** 2 * x.shape[1] >= 2**53:
                x = x.astype(np.int64)
            cand_id, cand_row = ids[s:e][of], rows[s:e][of]
            for a in range(0, len(at), BATCH):
                block = at[a : a + BATCH]
                me, least = rows[s:e][block], floor[s:e][block].copy()
                top = _upper_bounds(d[block], d[of], norm[s:e][block], norm[s:e][of])
                top[me[:, None] == cand_row[None]] = -np.inf
                order = np.argsort(-top.max(0), kind="stable")
                tiles = [order[i : i + TILE] for i in range(0, len(order), TILE)]
                # by query and tile, the largest bound from that tile on
                rest = np.maximum.accumulate(np.stack([top[:, t].max(1) for t in tiles], 1)[:, ::-1], 1)[:, ::-1]
                got_q, got_c, got_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                for n, tile in enumerate(tiles):
                    open_ = np.flatnonzero((rest[:, n] >= least) & (rest[:, n] > -np.inf))
                    if not len(open_):
                        break
                    score = (x[block[open_]] @ x[of[tile]].T).astype(np.int64)
                    q, c = np.nonzero((top[open_][:, tile] >= least[open_][:, None]) & (score >= np.maximum(least[open_], -(2.0**63))[:, None]) & (top[open_][:, tile] > -np.inf))
                    got_q, got_c, got_s = np.concatenate([got_q, open_[q]]), np.concatenate([got_c, tile[c]]), np.concatenate([got_s, score[q, c]])
                    order = np.lexsort((cand_row[got_c], cand_id[got_c], -got_s, got_q))
                    got_q, got_c, got_s = got_q[order], got_c[order], got_s[order]
                    place = np.arange(len(got_q)) - np.searchsorted(got_q, got_q)
                    full = place == k - 1
                    least[got_q[full]] = np.maximum(least[got_q[full]], got_s[full].astype(np.float64))
                    got_q, got_c, got_s = got_q[place < k], got_c[place < k], got_s[place < k]
                out.append((me[got_q], ids[s:e][block][got_q], cand_row[got_c], cand_id[got_c], got_s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", "query_id", "row", "id", "score"])

    return lambda batches: by_groups(batches, ["cell", "chunk", "part"], act)


def top_k(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "v", pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """The k highest integer inner products of each query with all other rows: query_id, rank int, id, score long.

    Queries are the rows for which ``asks`` holds. Components must be whole numbers held as doubles. Ties go to the
    smaller id; with fewer than k others all are given. Null or empty vectors, those with null or non-finite components
    and null ids take no part; vectors of different lengths are not compared. Rows that share an id are vectors of their
    own: each is a query with ranks from 1, and finds the others. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivot-search")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).where("id is not null")
    fitted = spark.sparkContext.broadcast(_pivots(rows, pivots, sample))
    made = rows.mapInArrow(_table(fitted), "id long, asks boolean, cell long, norm double, x binary, d binary")
    made = scratch.write(made.withColumn("row", F.monotonically_increasing_id()))
    # at most PIVOTS rows for each length of vectors
    sizes = made.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).orderBy("cell").collect()
    before = np.concatenate([[0], np.cumsum([r["q"] for r in sizes])]).tolist()
    meta = [(r["cell"], -(-r["n"] // CHUNK), max(1, r["q"]), b) for r, b in zip(sizes, before)]
    meta = F.broadcast(spark.createDataFrame(meta, "cell long, chunks long, q long, before long"))
    held = made.join(meta, "cell").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")))
    # queries of neighbouring cells share a part
    held = held.withColumn("part", F.floor((F.col("before") + F.pmod(F.xxhash64("row", F.lit(2)), F.col("q"))) / QUERIES))
    fields = ["row", "id", "norm", "x", "d"]
    stored = held.select("cell", "chunk", F.lit(0).alias("kind"), *fields, F.lit(0.0).alias("floor"))

    def searched(asked: DataFrame) -> DataFrame:
        """asked: cell, chunk, part, the fields and floor. A chunk goes to the parts that ask it."""
        asked = scratch.write(asked)
        pairs = scratch.write(asked.select("cell", "chunk", "part").distinct())
        every = stored.join(pairs, ["cell", "chunk"]).unionByName(asked.withColumn("kind", F.lit(1)))
        every = every.repartition("cell", "chunk", "part").sortWithinPartitions("cell", "chunk", "part")
        return every.mapInArrow(_search(k), "query long, query_id long, row long, id long, score long")

    # first pass: the k-th best of one chunk of the query's own cell
    own = held.where("asks")
    floors = searched(own.select("cell", F.pmod(F.xxhash64("row", F.lit(1)), F.col("chunks")).alias("chunk"), "part", *fields, F.lit(float("-inf")).alias("floor")))
    floors = floors.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).select(F.col("query").alias("row"), "floor")
    asked = scratch.write(own.select("cell", "part", *fields).join(floors, "row", "left").fillna(float("-inf"), ["floor"]).select(*fields, "floor", "cell", "part"))
    # second pass: cells that may hold more; their ranges of pivot distances are PIVOTS rows
    ranges = spark.sparkContext.broadcast(_ranges(made))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            norm, floor, own_size = batch.column(2).to_numpy(), batch.column(5).to_numpy(), batch.column(6).to_numpy() // 4096
            for size in np.unique(own_size):
                at = np.flatnonzero(own_size == size)
                d = np.stack([np.frombuffer(batch.column(4)[int(i)].as_buffer()) for i in at])
                for cell, (low, high, most) in ranges.value.items():
                    if cell // 4096 == size:
                        gap = np.maximum(low[None] - d, d - high[None]).max(1)
                        gap = np.maximum(gap - ROUNDING * (d.max(1) + high.max()), 0)
                        top = (norm[at] + most - gap * gap) / 2
                        top = np.minimum(top, np.sqrt(norm[at] * most)) + SLACK * (norm[at] + most + 1)
                        some = pa.array(at[top >= floor[at]])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), cell)), *(batch.column(c).take(some) for c in (0, 1, 2, 3, 4, 5, 7))], names=["cell", *fields, "floor", "part"])

    routed = asked.mapInArrow(route, "cell long, row long, id long, norm double, x binary, d binary, floor double, part long").join(meta.select("cell", "chunks"), "cell")
    routed = routed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    out = searched(routed.select("cell", "chunk", "part", *fields, "floor")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _ranges(made: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """The least and largest distance to each pivot and the largest squared norm of each cell; a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            cells, norm = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for cell in np.unique(cells):
                at = np.flatnonzero(cells == cell)
                d = np.stack([np.frombuffer(batch.column(2)[int(i)].as_buffer()) for i in at])
                old = held.get(int(cell), [d[0], d[0], 0.0])
                held[int(cell)] = [np.minimum(old[0], d.min(0)), np.maximum(old[1], d.max(0)), max(old[2], float(norm[at].max()))]
        rows = [(c, p, float(a), float(b), n) for c, (low, high, n) in held.items() for p, (a, b) in enumerate(zip(low, high))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["cell", "pivot", "low", "high", "most"])

    parts = made.select("cell", "norm", "d").mapInArrow(run, "cell long, pivot long, low double, high double, most double")
    out: dict[int, list] = {}
    for r in parts.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most")).orderBy("cell", "pivot").collect():
        x = out.setdefault(r["cell"], [[], [], 0.0])
        x[0].append(r["low"])
        x[1].append(r["high"])
        x[2] = max(x[2], r["most"])
    return {c: (np.array(a), np.array(b), m) for c, (a, b, m) in out.items()}
