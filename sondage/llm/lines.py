"""Fuzzy line dedup with DataFrame functions only.

A line's shingles are its runs of SHINGLE characters; all of them (as UTF-16 units) are hashed, whatever the line's length. A
hash deals its shingle to one of BANDS bands and one of ROWS rows there, and the least hash of each row is kept
(one-permutation MinHash; an empty row takes the value of another one of its band). The rows of a band make one key. Links
are looked for in two steps, both verified by the Jaccard similarity of all shingles: each line against the leaders of its
buckets; then all lines of one leader that are still apart, in blocks of bounded size. What each has more and less than the
leader gives the intersection of two lines, so these pairs are verified where they are joined, and only links are rows; bounds
from numbers and bit masks, which lose no pair, rule out most of them first. Distributed union-find keeps one line of each
component: the one that comes first.

Equal lines are one node from the start, named by a 64-bit hash; lines whose hash another line has too get a second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, hot_keys, join_dealt, join_hot
from .shared import Scratch

SHINGLE, BANDS, ROWS, BLOCK = 10, 8, 3, 1024
#: Rows that a join may broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 250_000
#: Pairs of one line that are verified in a task.
PAIRS = 256
#: Lines of one leader in a block.
TOGETHER = BLOCK
#: Words of 64 bits for each set of shingles that one of two lines has alone; a power of two.
WORDS = 4
MASKS = [f"{kind}{i}" for kind in ("own", "lacks") for i in range(WORDS)]


def _once(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """node and line; if the repeated lines are few enough to be broadcast, each line once, else with its copies."""
    repeated = groups.where("copies > 1").select("node", F.col("tag").alias("first"))
    if repeated.count() > BROADCAST_ROWS:
        return lines.select("node", "line")
    rows = lines.join(F.broadcast(repeated), "node", "left")
    return rows.where(F.col("first").isNull() | (F.col("first") == F.xxhash64("id", "row", "place"))).select("node", "line")


def _few(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _lines(docs: DataFrame, twins: DataFrame | None = None) -> DataFrame:
    """Of (id, row, text): id, row, place, line, node (a hash of it) and check (another), for lines that are not blank.

    twins: nodes that different lines had; those lines are named by their second hash.
    """
    rows = docs.select("id", "row", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.trim("line") != "")
    rows = rows.select("id", "row", "place", "line", F.xxhash64("line").alias("node"), F.xxhash64(F.lit(7), "line").alias("check"))
    if twins is None:
        return rows
    named = rows.join(F.broadcast(twins.select("node", F.lit(True).alias("twin"))), "node", "left")
    return named.select("id", "row", "place", "line", F.when(F.col("twin"), F.col("check")).otherwise(F.col("node")).alias("node"), "check")


def _signatures(lines: DataFrame, k: int) -> DataFrame:
    """Of (node, line): node, band and the least hashes m0.. of its rows, for each band that has a shingle."""
    # inline() keeps the optimizer from encoding the line once for each use
    rows = lines.select("node", F.inline(F.array(F.struct(F.encode("line", "UTF-16BE").alias("units")))))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length("units") / 2).cast("int") - k))
    rows = rows.select("node", "units", F.explode(starts).alias("i"))
    rows = rows.select("node", F.hash(F.substring("units", F.col("i") * 2 + 1, F.lit(2 * k))).alias("v"))
    rows = rows.select("node", "v", F.pmod("v", F.lit(BANDS)).alias("band"), F.pmod(F.expr("v div 64"), F.lit(ROWS)).alias("row"))
    return rows.groupBy("node", "band").agg(*[F.min(F.when(F.col("row") == i, F.col("v"))).alias(f"m{i}") for i in range(ROWS)])


def _keys(signatures: DataFrame) -> DataFrame:
    """node and key, one for each band that has a shingle."""
    full = [F.coalesce(*[F.col(f"m{(i + d) % ROWS}") for d in range(ROWS)]) for i in range(ROWS)]
    return signatures.select("node", F.xxhash64("band", *full).alias("key"))


def _shared(scratch: Scratch, keys: DataFrame) -> DataFrame:
    """node, key, n (the bucket's size) and what else keys has, for the buckets of several nodes; the rest follows from the key."""
    rest = [c for c in keys.columns if c not in ("node", "key")]
    sums = [F.min("node").alias("head"), F.max("node").alias("last"), F.bit_xor("node").alias("x"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in rest]]
    buckets = scratch.write(keys.groupBy("key").agg(*sums).where("n > 1"))
    # the nodes of a bucket of three are known from these sums
    third = F.col("head").bitwiseXOR(F.col("last")).bitwiseXOR(F.col("x"))
    nodes = F.when(F.col("n") == 2, F.array("head", "last")).otherwise(F.array(F.col("head"), F.col("last"), third))
    small = buckets.where("n < 4").select(F.explode(nodes).alias("node"), "key", "n", *rest)
    large = buckets.where("n > 3").select("key", "n")
    large = keys.join(F.broadcast(large), "key") if large.count() <= BROADCAST_ROWS else join_hot(keys, large, "key", "node")
    return scratch.write(small.unionByName(large.select("node", "key", "n", *rest)))


def _led(scratch: Scratch, shared: DataFrame) -> DataFrame:
    """shared with a, the leader of each bucket.

    A bucket is led by the line of the largest buckets: of lines that were made from one by edits, the one whose least
    hashes most others have, which is nearest to all of them. Ties go by a hash.
    """
    weight = shared.groupBy("node").agg(F.sum("n").alias("w"))
    rows = shared.join(weight, "node")
    leaders = scratch.write(rows.groupBy("key").agg(F.max_by("node", F.struct("w", F.xxhash64("node"), "node")).alias("a")))
    return scratch.write(join_hot(shared, leaders, "key", "node"))


def _apart(compared: DataFrame, labels: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The near pairs (a < b) of different components among the lines of one leader. compared: what _verified() gives.

    A leader's lines are cut into blocks of about TOGETHER lines, and each pair of blocks is a group of its own. Leaders whose
    lines are of one component can add nothing. Both lines have of the leader's shingles those that neither lacks, and of
    others those that both own. The bounds before the last one lose no pair: a bit that one mask has and the other lacks is
    of a shingle that only one of both sets has.
    """
    more = ["size", "common", "of_leader", "own", "lacks", *MASKS]
    rows = compared.select("a", F.col("b").alias("node"), *more).join(_few(labels), "node", "left").withColumn("c", F.coalesce("component", "node"))
    several = rows.groupBy("a").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n")).where("c1 <> c2")
    several = scratch.write(several.select("a", "n"))
    rows = rows.join(F.broadcast(several), "a") if several.count() <= BROADCAST_ROWS else join_hot(rows, several, "a", "node")
    rows = rows.withColumn("g", F.ceil(F.col("n") / F.lit(TOGETHER)).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    side = lambda x: [F.col("node").alias(x), *[F.col(m).alias(f"{m}_{x}") for m in ("c", *more)]]
    one = rows.select("a", F.col("mine").alias("i"), F.explode(F.sequence("mine", F.col("g") - 1)).alias("j"), *side("x"))
    two = rows.select("a", F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("i"), F.col("mine").alias("j"), *side("y"))
    needed = f"{percent} * (size_x + size_y)"
    unlike = {kind: " + ".join(f"bit_count({m}_x ^ {m}_y)" for m in MASKS if m.startswith(kind)) for kind in ("own", "lacks")}
    # of two sets the union has half of their sizes and what only one has, the intersection half of the sizes less that
    of_both = f"of_leader_x - (size(lacks_x) + size(lacks_y) + {unlike['lacks']}) / 2"
    of_none = f"(size(own_x) + size(own_y) - ({unlike['own']})) / 2"
    exact = "of_leader_x - size(array_union(lacks_x, lacks_y)) + size(array_intersect(own_x, own_y))"
    bounds = ["least(common_x, common_y) + least(size_x - common_x, size_y - common_y)", f"{of_both} + {of_none}", exact]
    kept = " and ".join(["c_x <> c_y", "(i < j or x < y)", *[f"{100 + percent} * ({x}) >= {needed}" for x in bounds]])
    pairs = one.join(two, ["a", "i", "j"]).where(kept)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _spelled(docs: DataFrame, twins: DataFrame | None, ends: DataFrame) -> DataFrame:
    """node and line, once each. ends: node and tag, the one of its places to read it from."""
    rows = _lines(docs, twins).select("node", "line", F.xxhash64("id", "row", "place").alias("tag"))
    return rows.join(_few(ends), ["node", "tag"]).select("node", "line").distinct()


def _shingles(line: Column, k: int) -> Column:
    """All runs of k characters (code points, of which each match takes one); the whole line if it is shorter."""
    return F.when(F.length(line) < k, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{k}}}))."), F.lit(1)))


def _with(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns; inline() keeps the optimizer from making them once for each use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _mask(hashes: Column, word: int) -> Column:
    """64 bits, those of the hashes that fall to a word of them."""
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(63).cast("int"))
    mine = lambda v: F.shiftright(v, 6).bitwiseAND(WORDS - 1) == word
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda m, v: F.when(mine(v), m.bitwiseOR(bit(v))).otherwise(m))


def _verified(scratch: Scratch, pairs: DataFrame, spelled: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, near: whether their shingle sets have 100 * intersection >= percent * union; own: hashes of what b has and a
    lacks; lacks: of what a has and b lacks; size, common, of_leader: numbers of b's shingles, of those that a has, and of a's;
    MASKS: bits of own and lacks, each shingle's one. own, lacks and MASKS are null where a has one pair only, as no other
    line is told from its differences. spelled: node and line.
    """
    two = spelled.select(F.col("node").alias("b"), F.col("line").alias("lb"))
    leaders = scratch.write(pairs.groupBy(F.col("a").alias("node")).agg((F.count("*") > 1).alias("several")))
    one = spelled.join(_few(leaders), "node").select(F.col("node").alias("a"), F.col("line").alias("la"), "several")
    # lines are shipped, not sets, which are eight times as large
    hot = scratch.write(hot_keys(pairs, "a", PAIRS))
    sets = join_dealt(pairs.join(two, "b"), one, "a", "b", hot)
    # sets of numbers are told apart faster than those of strings
    sets = _with(sets, **{f"t{x}": _shingles(F.col(f"l{x}"), k) for x in "ab"})
    sets = _with(sets, **{f"s{x}": F.transform(f"t{x}", lambda v: F.xxhash64(v)) for x in "ab"})
    sets = _with(sets, of_leader=F.size(F.array_distinct("sa")), more=F.array_except("sb", "sa"), less=F.array_except("sa", "sb"))
    sets = sets.select("a", "b", "of_leader", "several", "more", "less", (F.col("of_leader") - F.size("less")).alias("common"))
    sets = sets.withColumn("size", F.col("common") + F.size("more"))
    near = 100 * F.col("common") >= percent * (F.col("size") + F.size("less"))
    of = lambda m: F.col("more" if m.startswith("own") else "less")
    rest = {m: of(m) for m in ("own", "lacks")} | {m: _mask(of(m), int(m[-1])) for m in MASKS}
    return scratch.write(sets.select("a", "b", near.alias("near"), "size", "common", "of_leader", *[F.when(F.col("several"), c).alias(m) for m, c in rest.items()]))


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """One row per line that is repeated or near another: id, row, place (from 0), kept: id, row and place of the line that
    its component keeps.

    Lines are what newlines separate; blank ones are left out. Two lines are linked when they are equal or the Jaccard
    similarity of their sets of runs of k characters is at least ``similarity`` (the whole line is the only run of a
    shorter one); the kept line of a component is the one with the smallest id, then row, then place. row is a hash of id
    and text: rows that share an id are documents of their own, equal rows one document. Null texts and ids have no lines;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    percent = round(100 * similarity)
    texts = docs.select(F.col(id_col).alias("id"), _row(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where("id is not null and text is not null")
    read, twins = lambda: _lines(texts, twins), None
    while True:
        lines = scratch.write(read().select("id", "row", "place", "node", "check", F.xxhash64("id", "row", "place").alias("tag")))
        sums = [F.count("*").alias("copies"), F.min("tag").alias("tag"), F.min("check").alias("c1"), F.max("check").alias("c2")]
        groups = scratch.write(lines.groupBy("node").agg(*sums))
        if twins is not None or not (again := groups.where("c1 <> c2").select("node")).take(1):
            break
        twins = scratch.write(again)
    # many lines have few keys each: the aggregation is faster without its small first map
    with scratch.settings({"spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}):
        keys = scratch.write(_keys(_signatures(_once(read(), groups), k)))
    shared = _led(scratch, _shared(scratch, keys))
    scratch.drop(keys)
    pairs = scratch.write(shared.where("a <> node").select("a", F.col("node").alias("b")).distinct())
    scratch.drop(shared)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    spelled = scratch.write(_spelled(texts, twins, scratch.write(ends.join(groups.select("node", "tag"), "node"))))
    compared = _verified(scratch, pairs, spelled, k, percent)
    scratch.drop(spelled)
    links = scratch.write(compared.where("near").select("a", "b"))
    # what is still apart: lines of one leader, all with all
    more = scratch.write(_apart(compared, scratch.write(components(scratch, links, broadcast_rows=BROADCAST_ROWS)), scratch, percent).distinct())
    scratch.drop(compared)
    labels = scratch.write(components(scratch, links.unionByName(more), broadcast_rows=BROADCAST_ROWS))
    # lines of components of several lines, copies included
    named = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
    named = named.unionByName(groups.where("copies > 1").select("node", F.col("node").alias("component")).join(named, "node", "left_anti"))
    named = scratch.write(named)
    at = lines.select("node", "id", "row", "place")
    at = scratch.write(at.join(F.broadcast(named), "node") if named.count() <= BROADCAST_ROWS else join_hot(at, named, "node", "id"))
    kept = scratch.write(at.groupBy("component").agg(F.min(F.struct("id", "row", "place")).alias("kept"), F.count("*").alias("n")))
    out = join_hot(at, kept.where("n > 1").select("component", "kept"), "component", "id")
    return out.select("id", "row", "place", "kept")


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def _stays(gone: Column) -> Column:
    """Of an array of places: a byte for each place up to the last one, "0" for those of the array."""
    runs = F.transform(gone, lambda p, i: F.concat(F.repeat(F.lit("1"), p - F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)), F.lit("0")))
    return F.array_join(runs, "").cast("binary")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = 0.8, drop_emptied: bool = False) -> DataFrame:
    """docs with the same columns and rows, whose texts lack the lines that repeat or nearly repeat an earlier one.

    Blank lines and unrepeated ones stay, in their order; a text may become empty. Null texts stay null, rows with a null
    id stay as they are. Rows that share an id are documents of their own, but equal rows are one: they keep the same lines.
    With ``drop_emptied`` the rows go whose lines all repeat others; texts that had no line stay.
    """
    scratch = Scratch(docs.sparkSession, "gone")
    repeated = line_components(docs, id_col, text_col, k, similarity).where(F.struct("id", "row", "place") != F.col("kept"))
    gone = repeated.groupBy("id", "row").agg(F.array_sort(F.collect_set("place")).alias("places"))
    gone = scratch.write(gone.select("id", "row", _stays(F.col("places")).alias("stays")))
    # the document's own columns are held apart, whatever their names
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), _row(id_col, text_col).alias("row")).join(_few(gone), ["id", "row"], "left")
    text = F.col("doc")[text_col]
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.substring("stays", i + 1, F.lit(1)) != F.lit(b"0")), "\n")
    if drop_emptied:
        rows = rows.where(F.col("stays").isNull() | (F.trim(F.replace(left, F.lit("\n"), F.lit(""))) != ""))
    left = F.when(F.col("stays").isNull(), text).otherwise(left)
    return rows.select(*[left.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
