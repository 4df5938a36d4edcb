"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The vocabulary is every word that the labelled examples show to be commoner in toxic texts (likelihood ratio); it has no
bound but theirs. Words that tell nothing are left out, as the cosine of whole texts, in which toxic words are one in fifty,
hardly finds toxic texts at all (figures in the README). Inverse document frequencies are counted over all documents.
Labelled examples are an inverted index whose postings lie in blocks of BLOCK examples, each with the largest weight of
every word. A text looks up the blocks in the order of their upper bounds, some at once, and stops when no block can hold a
nearer example than the k-th, so the neighbours are the exact ones. The votes are weighted by distance; a logistic curve fitted on the
examples' own leave-one-out votes, which are taken in tasks, makes probabilities of them. Evidence: the nearest examples'
ids and the words that were looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import ALNUM, LOWER, buffers, chunks, span_hashes, word_bounds
from .shared import Scratch

FIT_ROWS, K, BLOCK = 12_000, 15, 64
#: A word of the vocabulary has so high a likelihood ratio (a chance of about 1 in 70) and occurs in so many toxic examples.
LEAST_RATIO, LEAST_TEXTS = 6.0, 2
#: Blocks that are looked up first; if more than twice as many are left by their bounds, all of them are, word by word.
FIRST_BLOCKS = 8
#: Answers that a worker keeps.
MOST_KEPT = 50_000


def _text_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, last + 1, the text and the hash of each word."""
    data, offsets = buffers(column)
    for first, last, part, cut in chunks(data, offsets):
        part = LOWER[part]
        high = np.zeros(len(part), bool)
        high[1:] = (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)
        part = part + 32 * high.astype(np.uint8)  # capitals of Latin-1
        starts, ends, text = word_bounds(part, cut, ALNUM)
        h = span_hashes(part, starts, ends)
        yield first, last, text, h


def _distinct(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((word, text))
    text, word = text[order], word[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    return text[at], word[at], np.diff(np.append(at, len(text)))


class Model:
    """The index over the examples, and the calibration."""

    def __init__(self, words: np.ndarray, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, prior: float, k: int = K):
        self.words, self.idf, self.prior, self.k = words, idf, prior, k
        some = [i for i, (t, _) in enumerate(vectors) if len(t)]  # an example without a word has cosine 0 with all
        self.ids, self.labels = ids[some], labels[some].astype(np.float64)
        blocks = -(-len(some) // BLOCK)
        # postings by block, then word, then example; those of a block and a word lie between two places
        number = np.repeat(np.arange(len(some)), [len(vectors[i][0]) for i in some])
        both = [self.weigh(*vectors[i]) for i in some]
        term, weight = (np.concatenate([np.zeros(0, t), *(v[j] for v in both)]) for j, t in ((0, np.int64), (1, np.float64)))
        order = np.lexsort((number, term))
        self.lists = number[order], weight[order]  # the same by word, for texts that no bound shortens
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))]).astype(np.int64)
        order = np.lexsort((number, term, number // BLOCK))
        number, term, weight = number[order], term[order], weight[order]
        self.top = np.zeros((len(words), blocks))
        np.maximum.at(self.top, (term, number // BLOCK), weight)
        count = np.bincount(number // BLOCK * len(words) + term, minlength=blocks * len(words))
        self.places = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        self.postings = (number % BLOCK).astype(np.int32), weight
        self.vectors = [vectors[i] for i in some]
        self.rest, self.rest_toxic = len(vectors) - len(some), float(labels.sum() - self.labels.sum())
        self.curve = np.array([0.0, 1.0])
        self.kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / max(np.sqrt((w * w).sum()), 1e-12)

    def nearest(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines (9 decimals) of the k + 1 nearest examples with a cosine over 0; ties go to the smaller number.

        Texts of the same direction have the same neighbours, so each worker keeps the answers that it has found.
        """
        terms, w = self.weigh(terms, counts)
        key = terms.tobytes() + np.round(w, 9).tobytes()
        if key in self.kept:
            return self.kept[key]
        bound = np.ceil((w @ self.top[terms]) * 1e9 - 1e-3) / 1e9
        got_n, got_c, k = np.zeros(0, np.int64), np.zeros(0), self.k + 1
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        at, size = 0, FIRST_BLOCKS
        while at < len(order):
            blocks = order[at:]
            if len(got_c) == k:
                blocks = blocks[bound[blocks] >= got_c[-1]]  # of a tie the smaller number counts
            if not len(blocks):
                break
            if at and len(blocks) > size:
                size = len(blocks)
                cosine = np.round(self._all_cosines(terms, w)[blocks], 9)
            else:
                blocks = blocks[:size]
                cosine = np.round(self._cosines(blocks, terms, w), 9)
            least = np.partition(cosine, -k, axis=None)[-k] if cosine.size > k else 0.0  # less is not among the k best
            row, place = np.nonzero((cosine > 0) & (cosine >= least))
            n, c = np.concatenate([got_n, blocks[row] * BLOCK + place]), np.concatenate([got_c, cosine[row, place]])
            best = np.lexsort((n, -c))[:k]
            got_n, got_c = n[best], c[best]
            at, size = at + size, 2 * size
        if len(self.kept) >= MOST_KEPT:
            self.kept.clear()
        self.kept[key] = got_n, got_c
        return got_n, got_c

    def _cosines(self, blocks: np.ndarray, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """By block, the cosines of its examples: the sums of their postings of the terms."""
        first = (blocks[:, None] * len(self.words) + terms).ravel()
        start, many = self.places[first], self.places[first + 1] - self.places[first]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(start - ends + many, many)
        example, weight = self.postings
        cell = example[at] + np.repeat(np.repeat(np.arange(len(blocks)) * BLOCK, len(terms)), many)
        weight = weight[at] * np.repeat(np.tile(w, len(blocks)), many)
        return np.bincount(cell, weight, len(blocks) * BLOCK).reshape(-1, BLOCK)

    def _all_cosines(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """By block, the cosines of the examples of all blocks."""
        out, (example, weight) = np.zeros(self.top.shape[1] * BLOCK), self.lists
        for x, a, b in zip(w.tolist(), self.ends[terms].tolist(), self.ends[terms + 1].tolist()):
            out[example[a:b]] += x * weight[a:b]
        return out.reshape(-1, BLOCK)

    def own_vote(self, i: int) -> float:
        """The vote on the i-th example by the others."""
        n, c = self.nearest(*self.vectors[i])
        return self.vote(n[n != i][: self.k], c[n != i][: self.k])

    def vote(self, n: np.ndarray, c: np.ndarray) -> float:
        """Share of toxic neighbours, weighted by distance, with one neighbour's weight of the prior."""
        w = c * c / (1.05 - np.minimum(c, 1))
        return float((w @ self.labels[n] + self.prior) / (w.sum() + 1))

    def calibrate(self, votes: np.ndarray) -> np.ndarray:
        """The logistic curve of the examples' own votes; those without a word have the prior for one."""
        if not len(votes):
            return self.curve
        weight = np.append(np.ones(len(votes)), [self.rest] * (self.rest > 0))
        votes = np.append(votes, [self.prior] * (self.rest > 0))
        y = np.append(self.labels, [self.rest_toxic / self.rest] if self.rest else [])
        x = np.stack([np.ones(len(votes)), _logit(votes)], 1)
        a = np.array([0.0, 1.0])
        for _ in range(50):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-x @ a))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
            a = a + np.linalg.solve(h, x.T @ (weight * (y - p)) - (a - [0, 1]))
        return a if np.isfinite(a).all() and a[1] > 0 else self.curve

    def score(self, vote: np.ndarray, curve: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(curve[0] + curve[1] * _logit(vote))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, text, word in _text_words(batch.column(1)):
            t, w, n = _distinct(text, word)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t + first)), batch.column(2).take(pa.array(t + first)), pa.array(w.view(np.int64)), pa.array(n)], names=["id", "label", "word", "n"])


def _known(words: np.ndarray):
    """Of (id, text): id, and lists of the vocabulary's words in the text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, text, word in _text_words(batch.column(1)):
                at = np.minimum(np.searchsorted(words, word), len(words) - 1)
                ok = words[at] == word if len(words) else np.zeros(len(word), bool)
                t, w, n = _distinct(text[ok], at[ok])
                ends = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=last - first))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int64))) for v in (w, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], names=["id", "terms", "counts"])

    return run


def _own_votes(spark: SparkSession, model) -> np.ndarray:
    """The votes on the examples by the others, taken in tasks: at most FIT_ROWS numbers."""
    n = len(model.value.vectors)
    if not n:
        return np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [model.value.own_vote(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["id", "vote"])

    parts = 2 * spark.sparkContext.defaultParallelism
    found = spark.range(0, n, 1, parts).mapInArrow(run, "id long, vote double").toArrow()
    out = np.zeros(n)
    out[found["id"].to_numpy()] = found["vote"].to_numpy()
    return out


def fit_and_score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, k: int = K, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: id, score double (0 to 1), predicted int, neighbours (array of long), words int.

    Examples: the ``rows`` labelled documents with the smallest hash of the id (the documented bound) among those of
    ``labels`` for which ``learn`` holds; labels other than 0 and 1 are left out, a document labelled twice counts as
    toxic if one label says so. Document frequencies are counted over all documents. Texts without a vocabulary word, null
    and empty ones get the score of a vote with no neighbours. Without examples of both kinds every score is the share of
    toxic examples. Whole texts are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    marked = scratch.write(marked.orderBy(F.xxhash64("id"), "id").limit(rows))
    examples = scratch.write(texts.join(F.broadcast(marked), "id").select("id", "text", "label").mapInArrow(_example_words, f"id {kind}, label int, word long, n long"))
    # the words that tell: G squared of having the word against the label, for words commoner in toxic texts
    n = marked.groupBy("label").count().collect()
    n0, n1 = (float(sum(r["count"] for r in n if r["label"] == v)) for v in (0, 1))
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    seen = examples.groupBy("word").agg(F.sum(F.col("label")).cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    share = F.lit(n1 / max(n0 + n1, 1))
    a, b, m = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    g2 = 2 * (part(a, m * share) + part(b, m * (1 - share)) + part(F.lit(n1) - a, (F.lit(n0 + n1) - m) * share) + part(F.lit(n0) - b, (F.lit(n0 + n1) - m) * (1 - share)))
    # at most the words of ``rows`` examples
    chosen = seen.where((a * n0 > b * n1) & (a >= LEAST_TEXTS)).where(g2 >= LEAST_RATIO).select("word").toArrow()
    words = np.sort(chosen["word"].to_numpy().view(np.uint64)) if n0 and n1 else np.zeros(0, np.uint64)
    held = scratch.write(texts.mapInArrow(_known(words), f"id {kind}, terms array<long>, counts array<long>"))
    df = {r["t"]: r["n"] for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row for each word of the vocabulary
    total = held.count()
    idf = np.log((total + 1) / (np.array([df.get(i, 0) for i in range(len(words))], np.float64) + 1)) + 1
    known = held.join(F.broadcast(marked), "id").select("id", "label", "terms", "counts")
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows).toArrow().to_pydict()  # ids may repeat
    order = np.argsort(np.array(known["id"])) if known["id"] else []
    vectors = [(np.array(known["terms"][i], np.int64), np.array(known["counts"][i], np.float64)) for i in order]
    labelled = [np.array([known[c][i] for i in order], t) for c, t in (("id", None), ("label", np.float64))]
    fitted = Model(words, idf, vectors, *labelled, prior, k)
    model = spark.sparkContext.broadcast(fitted)
    curve = fitted.calibrate(_own_votes(spark, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            terms, counts = batch.column(1), batch.column(2)
            ends, flat, many = terms.offsets.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy().astype(np.float64)
            votes, near = np.full(batch.num_rows, m.prior), [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(np.diff(ends)).tolist():
                found = [x[: m.k] for x in m.nearest(flat[ends[i] : ends[i + 1]], many[ends[i] : ends[i + 1]])]
                votes[i], near[i] = m.vote(*found), m.ids[found[0]].tolist()
            score = m.score(votes, curve) if len(m.words) else votes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(near, pa.list_(pa.int64())), pa.array(np.diff(ends).astype(np.int32))], names=["id", "score", "predicted", "neighbours", "words"])

    # few bytes a text, but work for each: dealt out by number of tasks, not by size
    dealt = held.repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"id {kind}, score double, predicted int, neighbours array<long>, words int").withColumnRenamed("id", id_col)
