"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

Each distinct shingle set gets a signature of ``SLOTS`` minima, each kept as 16 bits. The signature distance of two
documents is the number of slots in which they differ. The slots are split into chunks; by the pigeonhole principle two
signatures within the distance threshold r = chunks * e + a agree on one of the first a + 1 chunks but for e slots, or on
one of the others but for e - 1. The allowed chunk errors are enumerated by leaving out every choice of e (or e - 1)
slots, so that each document has a fixed number of keys and every pair within r meets in one. r lies over three standard
deviations above the mean distance of a pair at the similarity threshold.

Equal sets are one representative from the start, so copies make no pairs. Then links are looked for in steps, all
confirmed on the full sets: each representative against its leader, the first one of the buckets that it shares most of;
then all pairs within r of different components, in blocks of bounded size, first among those of the same leader, then in
buckets among those of different ones. What each has that its leader lacks, and lacks that its leader has, gives the
intersection of two with the same leader, so a large group that is alike but not near is confirmed within its blocks and
no pair of it leaves them but links. Groups of one component can add nothing, however large.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import NOT_SPACE, binary_list, by_groups, mix, texts_shingles
from .components import components, hot_keys, join_dealt, join_hot
from .shared import Scratch

SLOTS, CHUNKS = 64, 16
WIDTH = SLOTS // CHUNKS
BLOCK = 1024
#: Ids that a join may broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 250_000
#: Pairs of one leader that are confirmed in a task.
PAIRS = 256
#: Bytes of a block's differences from a leader, and hashes that are counted at once.
BLOCK_BYTES, COLUMNS = 1 << 24, 4096
_ODD = np.random.default_rng(7).integers(0, 2**63, SLOTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def distance_threshold(similarity: float) -> int:
    """Mean distance at the similarity plus 3.3 standard deviations."""
    miss = 1 - similarity
    return min(SLOTS - 1, math.ceil(SLOTS * miss + 3.3 * math.sqrt(SLOTS * miss * similarity)))


def chunk_keys(signature: np.ndarray, r: int) -> np.ndarray:
    """The keys (int64) of each signature, by row; signatures within distance r share at least one."""
    e, a = divmod(r, CHUNKS)
    wide, out = signature.astype(np.uint64).reshape(len(signature), CHUNKS, WIDTH), []
    for c in range(CHUNKS):
        errors = min(e if c <= a else e - 1, WIDTH)
        if errors < 0:
            continue
        for n, left in enumerate(itertools.combinations(range(WIDTH), WIDTH - errors)):
            h = np.full(len(signature), np.uint64((c * 64 + n) * 0x9E3779B97F4A7C15 % 2**64))
            for slot in left:
                h = mix(h ^ wide[:, c, slot] + np.uint64((slot + 1) * 0xD6E8FEB86659FD93 % 2**64))
            out.append(h)
    return np.stack(out, 1).view(np.int64)


def _fingerprint(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of each set's hashes, one of them mixed again."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (h, mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)))]
    return np.stack([mix(s[offsets[1:]] - s[offsets[:-1]]) for s in sums], 1).view(np.int64)


def _signatures(docs: DataFrame, k: int, r: int, table: np.ndarray) -> DataFrame:
    """Of (id, print, text): id, print, n (set size), f1, f2 (fingerprint of the set), sig (binary), keys (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, h, cut in texts_shingles(batch.column(2), table, k):
                n = np.diff(cut)
                some = np.flatnonzero(n)
                sig = np.zeros((len(some), SLOTS), np.uint16)
                if len(some):
                    for j in range(SLOTS):
                        sig[:, j] = mix(np.minimum.reduceat(h * _ODD[j], cut[:-1][some])).astype(np.uint16)
                keys = np.zeros((len(n), 0), np.int64)
                found = chunk_keys(sig, r)
                bounds = np.concatenate([[0], np.cumsum((n > 0) * found.shape[1])]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.ravel()))
                whole = np.zeros((len(n), SLOTS), np.uint16)
                whole[some] = sig
                print_ = _fingerprint(h, cut)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(n.astype(np.int64)), pa.array(print_[:, 0].copy()), pa.array(print_[:, 1].copy()), binary_list(whole.ravel(), np.arange(len(n) + 1) * SLOTS), keys],
                    names=["id", "print", "n", "f1", "f2", "sig", "keys"],
                )

    return docs.mapInArrow(run, "id long, print long, n long, f1 long, f2 long, sig binary, keys array<long>")


def _sets(docs: DataFrame, k: int, table: np.ndarray) -> DataFrame:
    """Of (node, text): node and the sorted shingle hashes as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, h, cut in texts_shingles(batch.column(1), table, k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), binary_list(h, cut)], names=["node", "items"])

    return docs.mapInArrow(run, "node long, items binary")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of written ``nodes`` (node, id, print), out of docs (id, print, text)."""
    return docs.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, ["id", "print"]).select("node", "text")


def _compared(scratch: Scratch, pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, table: np.ndarray) -> DataFrame:
    """Of pairs (a, b): a, b, near (100 * intersection >= percent * union of their full sets), size (of a's set), plus and
    minus (the hashes that only b has and that only a has). reps: node, id, print."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = scratch.write(reps.select("node", "id", "print").join(nodes, "node"))
    sets = scratch.write(_sets(_texts_of(docs, nodes), k, table))
    if sets.count() > nodes.count():  # equal rows that share an id
        sets = scratch.write(sets.dropDuplicates(["node"]))
    one, two = (sets.select(F.col("node").alias(x), F.col("items").alias(f"s{x}")) for x in "ab")
    # a leader of many is dealt into parts
    both = join_dealt(pairs.join(two, "b"), one, "a", "b", scratch.write(hot_keys(pairs, "a", PAIRS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, size, plus, minus = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                found = p[at] == q
                lacks = np.ones(len(p), bool)
                lacks[at[found]] = False
                same = int(found.sum())
                near.append(100 * same >= percent * (len(p) + len(q) - same))
                size.append(len(p))
                plus.append(q[~found].tobytes())
                minus.append(p[lacks].tobytes())
            columns = [pa.array(near, pa.bool_()), pa.array(size, pa.int64()), pa.array(plus, pa.binary()), pa.array(minus, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["a", "b", "near", "size", "plus", "minus"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, near boolean, size long, plus binary, minus binary")


def confirm(scratch: Scratch, pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, table: np.ndarray = NOT_SPACE) -> DataFrame:
    """Those (a, b) of pairs with 100 * intersection >= percent * union of their full sets. reps: node, id, print."""
    return _compared(scratch, pairs, docs, reps, k, percent, table).where("near").select("a", "b")


def _blocked(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """rows with i, j and mine, grouped by key, i and j: each group of a key is cut into blocks, and each pair i <= j of
    blocks is a group of its own, to which the members of both are copied. mine is the block of the row."""
    rows = rows.withColumn("g", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("g", "other")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _within(left: np.ndarray, right: np.ndarray, sig: np.ndarray, n: np.ndarray, apart: list[np.ndarray], r: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (p, q) of rows of left and right whose signatures are within r, whose sizes n allow a link and whose values
    differ in every array of ``apart``; a bounded number at a time."""
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        ok = 100 * np.minimum.outer(n[x], n[right]) >= percent * np.maximum.outer(n[x], n[right])
        for values in apart:
            ok &= values[x][:, None] != values[right][None]
        p, q = np.nonzero(ok)
        p, q = x[p], right[q]
        for c in range(0, len(p), 50_000):
            u, v = p[c : c + 50_000], q[c : c + 50_000]
            close = (sig[u] != sig[v]).sum(1) <= r
            yield u[close], v[close]


def _in_common(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of sets[p] and sets[q]; each set is of distinct hashes."""
    lengths = [len(s) for s in sets]
    _, code, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    code, row = (np.cumsum(times > 1) - 1)[code[times[code] > 1]], row[times[code] > 1]
    by_code = np.argsort(code, kind="stable")
    code, row = code[by_code], row[by_code]
    x, at_x = np.unique(p, return_inverse=True)
    y, at_y = np.unique(q, return_inverse=True)
    total = np.zeros((len(x), len(y)), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        some = slice(*np.searchsorted(code, [first, first + COLUMNS]))
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[row[some], code[some] - first] = 1
        total += holds[x] @ holds[y].T
    return total[at_x, at_y].astype(np.int64)


def _linked_of_leaders(rows: DataFrame, r: int, percent: int) -> DataFrame:
    """Pairs (a < b) of different components with the same leader that are within distance r and near on their full sets.

    rows: lead, members, bytes (of the differences of all of them), rep, comp, n, sig, size (the leader's), plus, minus.
    """
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    rows = _blocked(rows, "lead", blocks).select("lead", "i", "j", "mine", "rep", "comp", "n", "size", "sig", "plus", "minus")

    def links(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j, mine, rep, comp, n, size = (table[x].to_numpy() for x in ("i", "j", "mine", "rep", "comp", "n", "size"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, SLOTS)
        for s, e in zip(starts, starts[1:]):
            if (comp[s:e] == comp[s]).all():
                continue
            left = s + np.flatnonzero(mine[s:e] == i[s])
            right = left if i[s] == j[s] else s + np.flatnonzero(mine[s:e] == j[s])
            plus, minus = ([np.frombuffer(v.as_buffer(), np.uint64) for v in table[x][s:e]] for x in ("plus", "minus"))
            less = np.array([len(m) for m in minus])
            pairs = [np.stack([p, q]) for p, q in _within(left, right, sig, n, [comp], r, percent)]
            p, q = np.concatenate([np.zeros((2, 0), np.int64), *pairs], 1)
            p, q = (x[rep[p] < rep[q]] for x in (p, q)) if i[s] == j[s] else (p, q)
            if not len(p):
                continue
            # of the leader's set both have what neither lacks
            same = size[p] - less[p - s] - less[q - s] + _in_common(minus, p - s, q - s) + _in_common(plus, p - s, q - s)
            near = 100 * same >= percent * (n[p] + n[q] - same)
            p, q = rep[p[near]], rep[q[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return rows.mapInArrow(lambda batches: by_groups(batches, ["lead", "i", "j"], links, 2 * BLOCK), "a long, b long")


def _within_blocks(rows: DataFrame, r: int, percent: int) -> DataFrame:
    """Pairs (a < b) of different components and leaders within distance r in the same bucket. rows: key, members, rep,
    lead, comp, n, sig. A pair comes from the first key that it shares only."""
    rows = _blocked(rows, "key", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")).select("key", "i", "j", "mine", "rep", "lead", "comp", "n", "sig")

    def pairs(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, i, j, mine, rep, lead, comp, n = (table[x].to_numpy() for x in ("key", "i", "j", "mine", "rep", "lead", "comp", "n"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, SLOTS)
        keys = chunk_keys(sig, r)
        out = [np.zeros((0, 2), np.int64)]
        for s, e in zip(starts, starts[1:]):
            if e - s < 2 or (comp[s:e] == comp[s]).all():
                continue
            left = s + np.flatnonzero(mine[s:e] == i[s])
            right = left if i[s] == j[s] else s + np.flatnonzero(mine[s:e] == j[s])
            found = [np.zeros((0, 2), np.int64)]
            for u, v in _within(left, right, sig, n, [comp, lead], r, percent):
                first = (keys[u] == keys[v]).argmax(1)
                of_key = keys[u, first] == key[s]
                u, v = rep[u[of_key]], rep[v[of_key]]
                found.append(np.stack([np.minimum(u, v), np.maximum(u, v)], 1))
            out.append(np.unique(np.concatenate(found), axis=0))
        found = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    return rows.mapInArrow(lambda batches: by_groups(batches, ["key", "i", "j"], pairs), "a long, b long").distinct()


def _relabelled(scratch: Scratch, labels: DataFrame, linked: DataFrame) -> DataFrame:
    """Labels (node, component) after further links (a, b): only the components that they touch are joined anew."""
    end = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = linked.join(end("a"), "a", "left").join(end("b"), "b", "left")
    joined = components(scratch, between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return scratch.write(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(joined))


def _print(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: float, table: np.ndarray) -> DataFrame:
    """One row per row of docs: id, print (a hash of id and text), n (set size), component (long)."""
    percent = round(100 * similarity)
    r = distance_threshold(similarity)
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _print(id_col, text_col).alias("print"), F.col(text_col).cast("string").alias("text"))
    sigs = scratch.write(_signatures(texts, k, r, table))
    some = sigs.where("n > 0 and id is not null")
    # a set is a node of its own; it is read from the row with the smallest id
    reps = some.groupBy("f1", "f2").agg(F.min(F.struct("id", "print")).alias("at"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("keys").alias("keys"))
    reps = scratch.write(reps.select(F.monotonically_increasing_id().alias("node"), "at.id", "at.print", "f1", "f2", "n", "sig", "keys"))
    keys = reps.select(F.col("node").alias("rep"), "id", F.explode("keys").alias("key"))
    # the set with the smallest id leads: of copies the earliest, which the others were made from
    leaders = keys.groupBy("key").agg(F.min(F.struct("id", "rep"))["rep"].alias("leader"), F.count("*").alias("members")).where("members > 1")
    shared = scratch.write(join_hot(keys.drop("id"), scratch.write(leaders), "key", "rep"))
    # the first of a bucket with which a set shares the most keys
    first = shared.where("leader <> rep").groupBy("rep", "leader").count()
    first = first.groupBy("rep").agg((-F.max(F.struct("count", (-F.col("leader")).alias("l")))["l"]).alias("leader"))
    pairs = scratch.write(first.select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    compared = scratch.write(_compared(scratch, pairs, texts, reps, k, percent, table))
    labels = components(scratch, compared.where("near").select("a", "b"))
    # what is still apart, of the same leader
    led = compared.select(F.col("b").alias("rep"), F.col("a").alias("lead"), "size", "plus", "minus")
    led = led.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    sums = [F.count("*").alias("members"), F.sum(F.octet_length("plus") + F.octet_length("minus")).alias("bytes")]
    mixed = scratch.write(led.groupBy("lead").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), *sums).where("c1 <> c2").drop("c1", "c2"))
    led = led.join(F.broadcast(mixed), "lead") if mixed.count() <= BROADCAST_ROWS else join_hot(led, mixed, "lead", "rep")
    led = led.join(reps.select(F.col("node").alias("rep"), "n", "sig"), "rep")
    labels = _relabelled(scratch, labels, scratch.write(_linked_of_leaders(led, r, percent)))
    # and of different leaders, in a bucket; a leader's own pairs are those of the first step
    named = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(pairs.select(F.col("b").alias("rep"), F.col("a").alias("lead")), "rep", "left")
    named = scratch.write(named.select("key", "members", "rep", F.coalesce("component", "rep").alias("comp"), F.coalesce("lead", "rep").alias("lead")))
    ends = [f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("comp", "lead")]
    several = named.groupBy("key").agg(*ends).where("min_comp <> max_comp and min_lead <> max_lead").select("key")
    mixed = join_hot(named, several, "key", "rep").join(reps.select(F.col("node").alias("rep"), "n", "sig"), "rep")
    more = scratch.write(_within_blocks(mixed, r, percent).join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    labels = _relabelled(scratch, labels, scratch.write(confirm(scratch, more, texts, reps, k, percent, table)))
    of_set = scratch.write(reps.select("f1", "f2", "node", "id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # a component is named by its smallest id
    least = of_set.groupBy("component").agg(F.min("id").alias("name"))
    of_set = join_hot(of_set, least, "component", "node").select("f1", "f2", "name")
    out = sigs.select("id", "print", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("f1")).alias("f1"), "f2")
    # adaptive execution splits the rows of a set with many copies
    return out.join(of_set, ["f1", "f2"], "left").select("id", "print", "n", F.coalesce("name", "id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, table: np.ndarray = NOT_SPACE) -> DataFrame:
    """One row per row of docs: id, n_shingles long, component_id long, kept boolean.

    Documents are linked when the Jaccard similarity of their sets of distinct k-word shingles is at least
    ``similarity`` (a whole percentage); a component is what links reach, named by its smallest id, whose rows are kept. A
    text of 1 to k - 1 words is one shingle. Null, empty and wordless texts have an empty set, are linked with nothing and
    kept. Ids are integers; a null id is kept as it is, unlinked. Rows that share an id are documents of their own, linked
    by their own texts only. Other columns are not looked at.
    """
    out = _components(docs, id_col, text_col, k, similarity, table)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, table: np.ndarray = NOT_SPACE) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with the same columns; equal rows stay or go together."""
    out = _components(docs, id_col, text_col, k, similarity, table)
    gone = Scratch(docs.sparkSession, "near-gone").write(out.where(F.col("component") != F.col("id")).select("id", "print").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), _print(id_col, text_col).alias("print"))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["id", "print"], "left_anti").select("doc.*")
