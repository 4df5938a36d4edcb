"""Near-duplicates, components and searches against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import lines, minhash, near_vectors, pivot_search
from sondage.llm.components import components
from sondage.llm.shared import Scratch


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _join(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = _find(parent, a), _find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: _find(parent, i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (9, 8), (8, 9)]
    df = spark.createDataFrame(edges + [(None, 1), (1, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(Scratch(spark, "t"), df).collect()}
    want = _join({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(Scratch(spark, "t"), df.limit(0)).count() == 0


def _texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [None, "", " \t\n", "one", "one", "one two", "One  TWO", "a b c", "x " * 500, "x " * 700]
    base = [[word() for _ in range(rng.randrange(20, 120))] for _ in range(n)]
    for b in base:
        out.append(" ".join(b))
        for _ in range(rng.randrange(4)):
            c = list(b)
            for _ in range(rng.randrange(5)):
                c[rng.randrange(len(c))] = word()
            out.append(" ".join(c))
    hub = [word() for _ in range(60)]  # a large group of near copies around the threshold
    for _ in range(150):
        c = list(hub)
        for _ in range(rng.randrange(5)):
            c[rng.randrange(len(c))] = word()
        out.append(" ".join(c))
    return out + [out[12]] * 40


@pytest.mark.parametrize(("k", "similarity"), [(3, 0.85), (5, 0.8)])
def test_minhash(spark, k, similarity):
    texts = _texts()
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= round(100 * similarity) * len(sets[a] | sets[b])]
    want = _join(sets, near)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"rep": F.lit(1), "n": F.lit(None), "key": F.lit("k")}).repartition(5)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, k=k, similarity=similarity).collect()}
    assert len(got) == len(texts)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_of_rows_that_share_an_id(spark):
    rng = random.Random(9)
    a, b = (" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(100)) for _ in range(2))
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, "alone"), (4, None), (None, a), (5, b), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"print": F.lit("p"), "doc": F.lit(1)})
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (0, 0, True), (5, 2, False), (5, 2, False)])
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, a), (2, b), (4, "alone"), (4, None), (None, a)], key=str)


def test_pigeonhole():
    rng = np.random.default_rng(0)
    for r in (minhash.distance_threshold(0.85), minhash.distance_threshold(0.8), 5):
        a = rng.integers(0, 1 << 16, (400, minhash.SLOTS), dtype=np.uint16)
        b = a.copy()
        for row in b:
            at = rng.choice(minhash.SLOTS, r, replace=False)
            row[at] ^= 1
        assert (minhash.chunk_keys(a, r) == minhash.chunk_keys(b, r)).any(1).all()


def _vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 24))
    hub = rng.normal(size=24)
    x = np.concatenate([x, hub + 0.12 * rng.normal(size=(120, 24)), x[:20] * 3, x[:10]])
    rows = [v.astype(np.float32).tolist() for v in x]
    rows += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [-0.0] * 24]
    return rows


def _usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def test_near_vectors(spark):
    rows = _vectors()
    good = {i: np.array(v, float) for i, v in enumerate(rows) if _usable(v) and any(v)}
    cos = lambda a, b: a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) if len(a) == len(b) else 0
    near = [(a, b) for a in good for b in good if a < b and cos(good[a], good[b]) >= 0.95]
    want = _join(range(len(rows)), near)
    links = {i: sum(i in p for p in near) for i in range(len(rows))}
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("codes", F.lit(1)).repartition(4)
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(df).collect()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (links[i], want[i], want[i] == i) for i in want}
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_near_vectors_that_share_an_id_and_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 40)
    monkeypatch.setattr(near_vectors, "TILE", 16)
    rng = np.random.default_rng(5)
    hub = rng.normal(size=16)
    x = np.concatenate([hub + 0.13 * rng.normal(size=(130, 16)), rng.normal(size=(30, 16))])
    ids = [*range(150), *range(0, 50, 5)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(None, x[0].tolist()), (7, None)]
    cos = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
    near = [(a, b) for a in range(160) for b in range(a) if cos[a, b] >= 0.95]
    root = _join(range(160), near)
    name = {r: min(ids[m] for m in root if root[m] == r) for r in set(root.values())}
    want = [(ids[m], sum(m in p for p in near), name[root[m]], name[root[m]] == ids[m]) for m in range(160)] + [(None, 0, None, True), (7, 0, 7, True)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("size", [16, 64, 256, 768])
def test_codes_find_pairs_at_the_similarity(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(600, size))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * b / np.linalg.norm(b, axis=1)[:, None]
    ca, cb = (near_vectors.codes(v).reshape(600, -1) for v in (a, b))
    met = [bool(set(p) & set(q)) for p, q in zip(ca.tolist(), cb.tolist())]
    assert np.mean(met) >= 0.99


@pytest.mark.parametrize("scale", [64, 3e8])
def test_top_k(spark, scale):
    rows = [None if v is None else [None if c is None else math.floor(c * scale) * 1.0 if math.isfinite(c) else c for c in v] for v in _vectors()]
    rows += [[1.0] * 24] * 30  # ties
    ids = [7 * i for i in range(len(rows))]
    good = {i: v for i, v in zip(ids, rows) if _usable(v)}
    df = spark.createDataFrame(list(zip(ids, rows)), "vec_id long, v array<double>").withColumn("cell", F.lit("clash")).repartition(3)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivot_search.top_k(df, F.col("vec_id") % 5 == 0, k=20, pivots=8).collect()}
    want = {}
    for q in (i for i in good if i % 5 == 0):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scores[:20])}
    assert got == want
    assert pivot_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_with_outliers_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    x = np.floor(64 * rng.normal(size=(1500, 16)))
    for i, scale in enumerate((1e3, 1e5, 1e7, 1e8)):
        x[7 * i] = np.floor(rng.normal(size=16) * scale)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[33].tolist()), (20, x[20].tolist()), (21, x[21].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    got = pivot_search.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    want = []
    ids = np.array([i for i, _ in rows])
    whole = np.array([v for _, v in rows]).astype(np.int64)
    for n, (q, _) in enumerate(rows):
        if q % 20 == 0:
            score = whole @ whole[n]
            best = [m for m in np.lexsort((ids, -score)) if m != n][:20]
            want += [(q, r + 1, int(ids[m]), int(score[m])) for r, m in enumerate(best)]
    assert found == sorted(want)


def test_lines(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(80)] + ["z" * 300, "y" * 300 + "x", "y" * 300 + "w", "é" * 40]
    docs = [(None, "a\nb"), (900, None), (901, ""), (902, "\n\n"), (903, "\n".join(base))]
    for d in range(60):
        own = []
        for _ in range(rng.randrange(1, 9)):
            x = rng.choice(base) if rng.random() < 0.6 else " ".join(word() for _ in range(12))
            if rng.random() < 0.3 and len(x) > 60:
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice("qwv") + x[at + 1 :]
            own += [x, ""] if rng.random() < 0.2 else [x]
        docs.append((d, "\n".join(own)))
    k = lines.SHINGLE
    shingle = lambda x: frozenset(x[i : i + k] for i in range(len(x) - k + 1)) if len(x) >= k else frozenset([x])
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None and d[1] is not None)):
        for p, x in enumerate(t.split("\n")):
            if x.strip(" "):
                first.setdefault(x, (i, p))
    own = list(first)
    sets = [shingle(x) for x in own]
    near = [(a, b) for a in range(len(own)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = _join(range(len(own)), near)
    kept = {}
    for i, x in enumerate(own):
        kept[root[i]] = min(kept.get(root[i], (10**9, 0)), first[x])
    place = {x: kept[root[i]] for i, x in enumerate(own)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"line": F.lit(1), "place": F.lit("p"), "row": F.lit(0), "stays": F.lit("s"), "doc": F.lit("d"), "id": F.lit(-1), "_other": F.lit(None).cast("string")}).repartition(4)
    out = lines.drop_repeated_lines(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in docs:
        want = t if i is None or t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or place[x] == (i, p))
        assert got[i] == want
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def _kept_lines(spark, own):
    """The numbers of the lines that stay, of lines in documents of their own."""
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in lines.drop_repeated_lines(df).where("text <> ''").collect()}


def _jaccard(x, y, k=lines.SHINGLE):
    x, y = ({t[i : i + k] for i in range(len(t) - k + 1)} for t in (x, y))
    return len(x & y) / len(x | y)


def test_lines_of_few_words_are_all_verified(spark):
    rng = random.Random(5)
    own, copies = [], []
    while len(own) < 300:
        x = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(9, 15))) for _ in range(8))
        at = rng.randrange(len(x))
        y = x[:at] + "q" + x[at + 1 :]
        if 0.8 <= _jaccard(x, y) < 1:
            own.append(x)
            copies.append(y)
    kept = _kept_lines(spark, own + copies)
    assert kept >= set(range(300)) and len(kept) <= 300 + 3


def test_lines_near_the_bounds_of_a_sample(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    own = [word(n) for n in range(13, 27) for _ in range(15)]
    own += [" ".join(word(n) for _ in range(words)) for n in range(9, 23) for words in (6, 15, 16, 23, 24, 25) for _ in range(3)]
    own += [(" ".join(word(n) for _ in range(6)) + " " + word(32))[:96] for n in (11, 12) for _ in range(15)]
    own += ["short\rline of"]
    kept = _kept_lines(spark, own + [x + "." for x in own[:-1]] + own[-1:])
    assert kept >= set(range(len(own))) and len(kept) <= len(own) + 3


def test_lines_in_buckets_of_dissimilar_ones(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    opening = " ".join(word() for _ in range(26))
    own = [opening + " " + " ".join(word() for _ in range(10)) for _ in range(60)]
    chains = []
    for _ in range(20):
        x = [word() for _ in range(40)]
        chains.append([" ".join(x)])
        for step in range(3):
            x = x[:-2] + [word(), word()] if step == 1 else [word(), word()] + x[2:] if step == 0 else x[:19] + [word()] + x[20:]
            chains[-1].append(" ".join(x))
    assert max(_jaccard(a, b) for n, a in enumerate(own) for b in own[:n]) < 0.75
    rows = own + [x[:-1] + "q" for x in own[10:40]] + [x for c in chains for x in c]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if _jaccard(rows[a], rows[b]) >= 0.8]
    root = _join(range(len(rows)), near)
    assert _kept_lines(spark, rows) == {i for i in root if root[i] == i}


def test_near_lines_of_every_length(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    own, copies = [], []
    for low, high in ((10, 26), (26, 61), (61, 400)):
        n = len(own) + 200
        while len(own) < n:
            x = " ".join(word(rng.randrange(1, 12)) for _ in range(80))[: rng.randrange(low, high)].strip()
            cut = rng.randrange(max(1, len(x) - 2), len(x) + 1)
            y = rng.choice([x[:cut], x + "q", "q" + x, x[: len(x) - 1] + "q"])
            if rng.random() < 0.1:
                x, y = (t.replace(" ", rng.choice("\r \x85")) for t in (x, y))
            if len(x) >= low and len(y) >= 10 and 0.8 <= _jaccard(x, y) < 1:
                own.append(x)
                copies.append(y)
    kept = _kept_lines(spark, own + copies)
    assert kept >= set(range(600))
    missed = [i - 600 for i in kept if i >= 600]
    for part in range(3):
        assert sum(i // 200 == part for i in missed) <= 2


def test_lines_with_one_hash_get_another(spark):
    df = spark.createDataFrame([(1, 5, "one\ntwo\none"), (2, 6, "two")], "id long, row long, text string")
    plain = {(r["id"], r["place"]): r for r in lines._lines(df).collect()}
    twins = spark.createDataFrame([(plain[1, 0]["node"],)], "node long")
    named = {(r["id"], r["place"]): r for r in lines._lines(df, twins).collect()}
    assert named.keys() == plain.keys()
    for at, r in named.items():
        assert r["node"] == (plain[at]["check"] if r["line"] == "one" else plain[at]["node"])


def test_long_text_and_rows_that_share_an_id(spark):
    own = [f"line number {i} of a very long text {i * i}" for i in range(3000)]
    rows = [(1, "\n".join(own)), (2, "\n".join(["first", *own, "", "last"])), (2, "\n".join(own[:5])), (3, "same\nrow"), (3, "same\nrow"), (3, None)]
    got = [(r["doc_id"], r["text"]) for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), similarity=1.0).collect()]
    assert sorted(got, key=str) == sorted([rows[0], (2, "first\n\nlast"), (2, ""), *rows[3:]], key=str)


def test_written_tables_leave_no_shuffles(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = files()
    df = Scratch(spark, "t").write(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count())
    assert len(df.collect()) == 7 and files() <= before


def test_few_or_many_lines_of_one_leader(spark, monkeypatch):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(12)], []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = word()
        texts += [" ".join(words), " ".join(words) + " x"[: i % 3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for together in (lines.BLOCK, 2):
        monkeypatch.setattr(lines, "TOGETHER", together)
        found.append(sorted((r["id"], r["kept"]["id"]) for r in lines.line_components(df).collect()))
    sets = {i: {t[j : j + 10] for j in range(len(t) - 9)} for i, t in enumerate(texts)}
    want = _join(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert found[0] == found[1] == sorted((i, c) for i, c in want.items() if list(want.values()).count(c) > 1)


def test_bounds_of_lines_of_one_leader_lose_no_pair(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefgh\U0001f600é") for _ in range(6))
    base, own = [word() for _ in range(30)], []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(2, 7)):
            words[rng.randrange(len(words))] = word()
        own += [" ".join(words), " ".join(words[: rng.randrange(20, 31)]) + " same end of a line"]
    lead, own = " ".join(base), dict(enumerate(own, 1))
    spelled = spark.createDataFrame([(0, lead), *own.items()], "node long, line string")
    scratch = Scratch(spark, "bounds")
    compared = lines._verified(scratch, spark.createDataFrame([(0, i) for i in own], "a long, b long"), spelled, 10, 80)
    got = {r["b"]: r for r in compared.collect()}
    sets = {i: {x[j : j + 10] for j in range(len(x) - 9)} for i, x in [(0, lead), *own.items()]}
    for i in own:
        r, a, b = got[i], sets[0], sets[i]
        assert (r["of_leader"], r["size"], r["common"], len(r["own"]), len(r["lacks"])) == (len(a), len(b), len(a & b), len(b - a), len(a - b))
        assert r["near"] == (10 * len(a & b) >= 8 * len(a | b))
        assert sum(bin(r[f"own{w}"] & (1 << 64) - 1).count("1") for w in range(lines.WORDS)) == len({v & 255 for v in r["own"]})
    none = spark.createDataFrame([], "node long, component long")
    pairs = {tuple(r) for r in lines._apart(compared, none, scratch, 80).collect()}
    assert pairs == {(x, y) for x in own for y in own if x < y and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])}
    assert len(pairs) > 20


def test_a_lone_pair_of_a_leader_keeps_no_differences(spark):
    text = "a line of some words that are told apart, number "
    own = {i: text + x for i, x in enumerate(("one", "two", "three", "four and more than that", "four and more than this"))}
    pairs = [(0, 1), (0, 2), (3, 4)]
    spelled = spark.createDataFrame(list(own.items()), "node long, line string")
    compared = lines._verified(Scratch(spark, "lone"), spark.createDataFrame(pairs, "a long, b long"), spelled, 10, 80)
    got = {(r["a"], r["b"]): r for r in compared.collect()}
    sets = {i: {x[j : j + 10] for j in range(len(x) - 9)} for i, x in own.items()}
    for a, b in pairs:
        r, x, y = got[a, b], sets[a], sets[b]
        assert (r["of_leader"], r["size"], r["common"], r["near"]) == (len(x), len(y), len(x & y), 10 * len(x & y) >= 8 * len(x | y))
        if a == 3:
            assert all(r[m] is None for m in ("own", "lacks", *lines.MASKS))
        else:
            assert (len(r["own"]), len(r["lacks"])) == (len(y - x), len(x - y))


def test_components_with_and_without_broadcasts(spark):
    rng = random.Random(51)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = _join(range(500), edges)
    least = {}
    for i in range(500):
        least[root[i]] = min(least.get(root[i], i), i)
    want = {(i, least[root[i]]) for i in range(500) if least[root[i]] != i}
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (0, 100, 100_000):
        assert {tuple(r) for r in components(Scratch(spark, "c"), df, broadcast_rows=most).collect()} == want
