"""Toxicity, quality and the pipeline: held-out accuracy, exact neighbours, odd inputs."""

import pickle
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import quality, toxicity
from sondage.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def _odd(spark):
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, "!!! ***", None, "s", 7), (3, "word " * 50_000, "xx", None, 250_000), (4, "you idiot", "en", "s", 9), (4, "you idiot", "en", "s", 9)]
    rows = [(10**6 + r[0], *r[1:]) for r in rows]  # without labels
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("clash"), "label": F.lit(1), "x": F.lit(2)})


def test_toxicity_held_out(spark):
    out = QUERIES["op7_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = out.where("held_out").join(labels, "doc_id").agg(*[F.count_if(F.expr(c)) for c in ("toxic = 1 and predicted = 1", "toxic = 1", "toxic = 0 and predicted = 1", "toxic = 0")]).first()
    assert r[0] / r[1] > 0.75 and r[2] / r[3] < 0.03
    assert out.count() == 1000 and out.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_odd_inputs(spark, tables):
    docs, labels = tables
    both = docs.select("doc_id", "text").where("doc_id >= 0").unionByName(_odd(spark).select("doc_id", "text"))
    got = toxicity.fit_and_score(both, labels, F.lit(True)).where("doc_id >= 1000000").collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] < 10**6 + 4}) == 1
    plain = next(r["score"] for r in got if r["doc_id"] == 10**6)
    assert all(r["score"] > 5 * plain and r["neighbours"] for r in got if r["doc_id"] == 10**6 + 4)
    alone = toxicity.fit_and_score(_odd(spark), labels.limit(0), F.lit(True)).collect()
    assert len(alone) == 6 and len({r["score"] for r in alone}) == 1
    assert toxicity.fit_and_score(_odd(spark).limit(0), labels, F.lit(True)).count() == 0


def test_toxicity_where_most_labels_are_toxic(spark):
    rows = [(i, ("vile " if i % 2 else "kind ") + f"word{i % 7} text", i % 2) for i in range(80)] + [(100 + i, f"vile word{i % 5} text", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.fit_and_score(df, df.select("doc_id", "toxic"), F.lit(True)).collect()}
    assert min(got[i] for i, _, t in rows if t) > max(got[i] for i, _, t in rows if not t)


def test_block_max_is_exact():
    rng = np.random.default_rng(0)
    terms = [np.sort(rng.choice(40, rng.integers(0, 5), replace=False)) for _ in range(700)]
    vectors = [(t, rng.integers(1, 4, len(t)).astype(float)) for t in terms]
    model = toxicity.Model(np.arange(40, dtype=np.uint64), rng.uniform(1, 5, 40), vectors, np.arange(700), (rng.random(700) < 0.3).astype(float), 0.3, 10)
    some = [i for i, (t, _) in enumerate(vectors) if len(t)]
    full = np.zeros((len(some), 40))
    for n, i in enumerate(some):
        t, w = model.weigh(*vectors[i])
        full[n, t] = w
    for n, i in enumerate(some[:150]):
        cosine = np.round(full @ full[n], 9)
        order = np.lexsort((np.arange(len(some)), -cosine))[:11]
        got_n, got_c = model.nearest(*vectors[i])
        want = order[cosine[order] > 0]
        assert np.allclose(got_c, cosine[want], atol=2e-9) and set(got_n[got_c > got_c[-1] + 1e-8]) <= set(want)


def test_many_words_are_looked_up_quickly():
    rng = np.random.default_rng(4)
    terms = [np.sort(rng.choice(1000, 60, replace=False)) for _ in range(6400)]
    vectors = [(t, rng.integers(1, 4, 60).astype(float)) for t in terms]
    model = toxicity.Model(np.arange(1000, dtype=np.uint64), rng.uniform(1, 5, 1000), vectors, np.arange(6400), (rng.random(6400) < 0.3).astype(float), 0.3)
    began = time.process_time()
    for i in range(200):
        model.nearest(*vectors[i])
    assert time.process_time() - began < 200 * 0.003


def test_own_votes_leave_the_example_out(spark):
    rng = np.random.default_rng(1)
    vectors = [(np.sort(rng.choice(12, rng.integers(0, 4), replace=False)),) for _ in range(90)]
    vectors = [(t, np.ones(len(t))) for (t,) in vectors]
    y = (rng.random(90) < 0.4).astype(float)
    model = toxicity.Model(np.arange(12, dtype=np.uint64), rng.uniform(1, 5, 12), vectors, np.arange(90), y, 0.4, 5)
    some = [i for i, (t, _) in enumerate(vectors) if len(t)]
    full = np.zeros((len(some), 12))
    for n, i in enumerate(some):
        t, w = model.weigh(*vectors[i])
        full[n, t] = w
    got = toxicity._own_votes(spark, spark.sparkContext.broadcast(model))
    for n in range(len(some)):
        cosine = np.round(full @ full[n], 9)
        cosine[n] = 0
        near = np.lexsort((np.arange(len(some)), -cosine))[:5]
        near = near[cosine[near] > 0]
        assert abs(got[n] - model.vote(near, cosine[near])) < 1e-6


def test_quality_held_out(spark):
    out = QUERIES["op5_quality_classifier"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = out.where("held_out").join(labels, "doc_id").agg(F.avg(((F.col("quality") == 1) == F.col("keep")).cast("int"))).first()
    assert r[0] > 0.9 and out.count() == 1000


def test_quality_odd_inputs(spark, tables):
    docs, labels = tables
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    got = quality.score(docs.where("doc_id >= 0").select(names).unionByName(_odd(spark).select(names)), labels, F.lit(True)).where("doc_id >= 1000000").collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    alone = quality.score(_odd(spark), labels.limit(0), F.lit(True)).collect()
    assert [r["keep"] for r in alone] == [True] * 6
    assert quality.score(_odd(spark).limit(0), labels, F.lit(True)).count() == 0


def test_co_training_uses_the_other_view():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    x = (y * 2 + rng.normal(size=2000))[:, None].repeat(len(quality.FEATURES), 1)
    kinds = [y * 3 + rng.integers(0, 3, 2000), rng.integers(0, 5, 2000)]
    size, known = rng.random((2000, 1)), np.arange(2000) % 5 == 0
    part = lambda rows: (x[rows], size[rows], [k[rows] for k in kinds])
    model = quality.CoTrained(*part(known), y[known]).train(quality.LocalPool(part(~known)))
    taught = model.taught(model.encoded(part(~known)))
    assert all((v >= 0).sum() > 20 and (v[v >= 0] == y[~known][v >= 0]).mean() > 0.9 for v in taught)
    t, m, p = model.score(x, rng.random((2000, 1)), kinds)
    assert ((p > 0.5) == y).mean() > max(((t > 0.5) == y).mean(), 0.95) - 0.01 and ((m > 0.5) == y).mean() > 0.95


def test_tasks_get_a_model_without_the_labelled_pages():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000)
    page = rng.normal(size=(4000, len(quality.FEATURES))) + y[:, None], rng.random((4000, 1)), [y, y]
    model = quality.CoTrained(*page, y)
    sent = pickle.dumps(model)
    assert len(sent) < 100_000 and (pickle.loads(sent).sums(page) == model.sums(page)).all()
    assert len(model.z[0]) == 4000  # the driver keeps them


def test_pool_of_a_table_sums_as_a_local_one(spark):
    rng = np.random.default_rng(2)
    n = 500
    y = rng.integers(0, 2, n)
    page = rng.normal(size=(n, len(quality.FEATURES))) + y[:, None], rng.random((n, 1)), [y * 2 + rng.integers(0, 2, n), rng.integers(0, 4, n)]
    rows = [(page[0][i].tobytes(), int(page[2][0][i]), int(page[2][1][i]), float(np.expm1(page[1][i, 0]))) for i in range(n)]
    table = quality.TablePool(spark.createDataFrame(rows, "x binary, lang int, source int, size double").repartition(3))
    model = quality.CoTrained(*page, y)
    assert (table.total("histogram", model) == quality.LocalPool(page).total("histogram", model)).all()
    one = quality.CoTrained(*page, y).train(quality.LocalPool(page), 2)
    two = quality.CoTrained(*page, y).train(table, 2)
    assert np.allclose(one.text.w, two.text.w) and np.allclose(one.meta.w, two.meta.w) and one.rules


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        counts.append(docs.count())
        assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] <= counts[3]
    empty = (F.col("text").isNull()) | (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) == "")
    assert docs.where(empty).count() <= spark.read.parquet(f"{SF}/documents.parquet").where(empty).count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == counts[4]
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first() == last.agg(F.sum("length")).first()


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = _odd(spark).select(names).unionByName(spark.createDataFrame([(None, "no id", "en", "s", 5)], ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "string", "string", "string", "long")))))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.columns == names and docs.count() == n, name
