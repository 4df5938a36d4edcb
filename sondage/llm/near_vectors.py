"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the signed axis of the
largest component. FOLD hashes make a bucket code, TABLES codes are made, and each is probed by as many further codes as
it has hashes, each with one axis replaced by the runner-up. Vectors that share a code of a table are candidates; their
cosine is computed in double precision.

Equal vectors are one representative with a weight, so copies make no pairs. Buckets are compared in pairs of blocks of
bounded size. Links are counted and joined into trees inside the block, and a pair counts only in the first code that it
shares, so that no pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import by_groups, mix
from .components import components, join_hot
from .shared import Scratch
from .vectors import ragged

TABLES, FOLD = 10, 3
#: Vectors of a block of a bucket, and of a tile of it that is compared at once.
BLOCK, TILE = 2048, 64


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        half *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, fold: int = FOLD, seed: int = 5) -> np.ndarray:
    """Bucket codes (int64), by vector and table: home first, then a probe for each hash with its runner-up axis."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    wide = np.zeros((n, size))
    wide[:, :d] = x / np.linalg.norm(x, axis=1)[:, None]
    out = np.zeros((n, tables, fold + 1), np.int64)
    rng = np.random.default_rng(seed)
    for t in range(tables):
        axes = np.zeros((n, fold, 2), np.uint64)
        for k in range(fold):
            y = wide
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], size))
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            v = np.take_along_axis(y, two, 1)
            swap = np.abs(v[:, 0]) < np.abs(v[:, 1])
            two[swap], v[swap] = two[swap][:, ::-1], v[swap][:, ::-1]
            axes[:, k] = two * 2 + (v < 0)
        for probe in range(fold + 1):
            h = np.full(n, np.uint64(t + 1))
            for k in range(fold):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + axes[:, k, int(k == probe - 1)] + np.uint64(1))
            out[:, t, probe] = h.view(np.int64)
    return out


_PREPARED = "id long, f1 long, f2 long, unit binary, codes binary, keys array<long>"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, v): fingerprints, unit, codes and keys of each vector; nulls for those that link with nothing."""
    for batch in batches:
        rows = [(i, x) for i, x in ragged(batch.column(1)) if x.any()]
        rest = np.ones(batch.num_rows, bool)
        rest[[i for i, _ in rows]] = False
        if rest.any():
            alone = [batch.column(0).filter(pa.array(rest)), *(pa.nulls(int(rest.sum()), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(alone, names=["id", "f1", "f2", "unit", "codes", "keys"])
        # equal lengths are what can be compared; the length is part of the fingerprint and of the codes
        for size in sorted({len(x) for _, x in rows}):
            at = np.array([i for i, x in rows if len(x) == size])
            x = np.stack([x for _, x in rows if len(x) == size]) + 0.0
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(x).max(1)
                unit = x / scale[:, None]
            h = np.full(len(x), np.uint64(size))
            g = np.full(len(x), np.uint64(size + 77))
            for c in range(size):
                bits = x[:, c].copy().view(np.uint64)
                h, g = mix(h * np.uint64(0x9E3779B97F4A7C15) + bits), mix(g + bits * np.uint64(0xD6E8FEB86659FD93))
            lists = codes(unit).reshape(len(x), -1) ^ np.int64(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array([r.tobytes() for r in unit], pa.binary()), pa.array([r.tobytes() for r in lists], pa.binary()), pa.array(list(lists), pa.list_(pa.int64()))],
                names=["id", "f1", "f2", "unit", "codes", "keys"],
            )


def _linked(similarity: float):
    def act(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, i, j, own, rep, w = (table[x].to_numpy() for x in ("key", "i", "j", "own", "rep", "w"))
        raw, lists = table["unit"], table["codes"]
        ids, links, roots = [], [], []
        for s, e in zip(starts.tolist(), starts[1:].tolist()):
            if e - s < 2:
                continue
            x = np.stack([np.frombuffer(v.as_buffer()) for v in raw[s:e]])
            c = np.stack([np.frombuffer(v.as_buffer(), np.int64) for v in lists[s:e]]).reshape(e - s, TABLES, FOLD + 1)
            left = np.flatnonzero(own[s:e] == i[s])
            right = left if i[s] == j[s] else np.flatnonzero(own[s:e] == j[s])
            n = np.sqrt((x * x).sum(1))
            hit = np.zeros((len(left), len(right)), bool)
            wl, wr = w[s:e][left], w[s:e][right]
            n_left, n_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
            for at in range(0, len(left), TILE):
                tile = left[at : at + TILE]
                near = (x[tile] @ x[right].T) / (n[tile][:, None] * n[right][None]) >= similarity
                if i[s] == j[s]:
                    near[np.arange(len(tile)), at + np.arange(len(tile))] = False
                hit[at : at + TILE] = near
                p, q = np.nonzero(near)
                if not len(p):
                    continue
                t_here = np.nonzero((c[tile[p[0]]] == key[s]).any(1))[0][0]
                ok, a, b = np.ones(len(p), bool), c[tile[p]], c[right[q]]
                for t in range(t_here + 1):  # most pairs meet in the first table already
                    live = np.flatnonzero(ok)
                    if not len(live):
                        break
                    same = a[live, t][:, :, None] == b[live, t][:, None, :]
                    met = np.where(same, a[live, t][:, :, None], np.iinfo(np.int64).max).min((1, 2))
                    ok[live] = met == key[s] if t == t_here else ~same.any((1, 2))
                n_left += np.bincount(at + p[ok], wr[q[ok]], len(left)).astype(np.int64)
                if i[s] != j[s]:
                    n_right += np.bincount(q[ok], wl[p[ok]], len(right)).astype(np.int64)
            if not hit.any():
                continue
            # links of this block as trees: each vector gets the least one that it reaches here
            name_l, name_r = rep[s:e][left].copy(), rep[s:e][right].copy()
            while True:
                new_l, new_r = name_l.copy(), name_r.copy()
                for at in range(0, len(left), TILE):
                    part = np.where(hit[at : at + TILE], name_l[at : at + TILE, None], np.iinfo(np.int64).max)
                    np.minimum(new_r, part.min(0), out=new_r)
                for at in range(0, len(left), TILE):
                    part = np.where(hit[at : at + TILE], new_r[None], np.iinfo(np.int64).max).min(1)
                    new_l[at : at + TILE] = np.minimum(new_l[at : at + TILE], part)
                if (new_l == name_l).all() and (new_r == name_r).all():
                    break
                name_l, name_r = new_l, new_r
            ids.append(rep[s:e][left])
            links.append(n_left)
            roots.append(name_l)
            if i[s] != j[s]:
                ids.append(rep[s:e][right])
                links.append(n_right)
                roots.append(name_r)
        if ids:
            out = [np.concatenate(v) for v in (ids, links, roots)]
            some = (out[1] > 0) | (out[0] != out[2])
            yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in out], names=["rep", "links", "root"])

    return lambda batches: by_groups(batches, ["key", "i", "j"], act)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.95) -> DataFrame:
    """One row per vector: id, n_links long, component_id long, kept boolean.

    Vectors of the same length are linked when their cosine is at least ``similarity``; a component is what links
    reach, named by its smallest id, which is kept. Null, empty and zero vectors and those with null or non-finite
    components are linked with nothing and kept. Equal vectors are linked. Ids are integers; a null id is kept as it is,
    unlinked. Rows that share an id are vectors of their own. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "near-vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    made = scratch.write(rows.where("id is not null").mapInArrow(_prepared, _PREPARED))
    groups = made.where("f1 is not null").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.max("unit").alias("unit"), F.max("codes").alias("codes"), F.max("keys").alias("keys"))
    groups = scratch.write(groups.withColumn("rep", F.monotonically_increasing_id()))
    reps = groups.select("rep", "w", "unit", "codes", "keys")
    keys = reps.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    shared = scratch.write(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    met = join_hot(keys, shared, "key", "rep")
    met = met.withColumn("g", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")
    met = met.join(reps.drop("keys"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = scratch.write(met.mapInArrow(_linked(similarity), "rep long, links long, root long"))
    labels = components(scratch, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_group = groups.select("f1", "f2", "id", "w", "rep").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    of_group = scratch.write(of_group.select("f1", "f2", "id", "rep", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    # a component is named by its smallest id
    least = of_group.groupBy("component").agg(F.min("id").alias("component_id"))
    of_group = join_hot(of_group, least, "component", "rep").select("f1", "f2", "n_links", "component_id")
    # adaptive execution splits the rows of a vector with many copies
    found = made.select("id", "f1", "f2").join(of_group, ["f1", "f2"], "left").select("id", "n_links", "component_id")
    out = found.unionByName(rows.where("id is null").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
