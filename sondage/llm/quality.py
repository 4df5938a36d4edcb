"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

The text view measures the content (kinds of characters, words, repetition); the metadata view sees language, source and
length as recorded. Both are logistic regressions over binned features, fitted to a bounded sample of labelled pages. In
every round each view scores all unlabelled pages, and those that it is surest of, a share of each class, count as
labelled for the other. The views are fitted anew by Newton steps whose sums are taken in tasks over all these pages, so
the driver holds sums only, whatever the number of pages. At the end each view is calibrated, and a logistic combination
of the calibrated views, fitted on labelled pages that neither learned from, scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import LOWER, NOT_SPACE, buffers, byte_class, chunks, shingles, span_hashes, word_bounds
from .shared import Scratch

FIT_ROWS, ROUNDS, STEPS, SURE, SHARE = 12_000, 5, 3, 0.95, 0.02
#: Bins of a logit from -30 to 30, by which the limits of the surest pages are found.
LOGITS = 6000
FEATURES = ("size", "upper", "digit", "symbol", "pipe", "stop", "space", "newline", "other", "control", "word_length", "distinct_words", "repeated_words", "distinct_shingles", "repeated_lines", "words", "line_length")
_KIND = np.full(256, 3, np.uint8)  # symbols
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[124] = 0, 1, 2, 4
_KIND[[ord(c) for c in ".,;:'\"?-()"]], _KIND[[32, 9]], _KIND[10], _KIND[128:] = 5, 6, 7, 8
_KIND[[*range(0, 9), *range(11, 32), 127]] = 9
_LINE = byte_class((10, 10))


def text_features(column: pa.Array) -> np.ndarray:
    """By text, the FEATURES of its whole content; all 0 for an empty or null text."""
    data, offsets = buffers(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for first, last, part, cut in chunks(data, offsets):
        n, m = np.maximum(np.diff(cut), 1).astype(float), last - first
        kind = _KIND[part]
        count = [np.diff(np.concatenate([[0], np.cumsum(kind == k)])[cut]).astype(float) for k in range(10)]
        low = LOWER[part]
        starts, ends, text = word_bounds(low, cut, NOT_SPACE)
        words = np.bincount(text, minlength=m).astype(float)
        h = span_hashes(low, starts, ends)
        same = np.bincount(text[1:], (h[1:] == h[:-1]) & (text[1:] == text[:-1]), m) if len(h) else np.zeros(m)
        distinct = np.diff(shingles(h, text, m, 1)[1])
        threes = np.diff(shingles(h, text, m, 3)[1])
        a, b, line_of = word_bounds(part, cut, _LINE)
        lines = np.bincount(line_of, minlength=m).astype(float)
        lines_distinct = np.diff(shingles(span_hashes(part, a, b), line_of, m, 1)[1])
        letters = np.maximum(count[0] + count[1], 1)
        w = np.maximum(words, 1)
        out[first:last] = np.stack(
            [np.log1p(np.diff(cut)), count[0] / letters, count[2] / n, count[3] / n, count[4] / n, count[5] / n, count[6] / n, count[7] / n, count[8] / n, count[9] / n,
             np.bincount(text, ends - starts, m) / w, distinct / w, same / w, threes / np.maximum(w - 2, 1), (lines - lines_distinct) / np.maximum(lines, 1), np.log1p(words), np.log1p(n / np.maximum(lines, 1))], 1)
    return out


class View:
    """Logistic regression over one-hot bins of numeric features and hashed categories."""

    def __init__(self, bins: int = 12, buckets: int = 64):
        self.bins, self.buckets = bins, buckets
        self.edges: list[np.ndarray] = []
        self.w = np.zeros(1)

    def prepare(self, x: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]

    def encode(self, x: np.ndarray, kinds: list[np.ndarray]) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for c, e in zip(x.T, self.edges):
            parts.append(np.eye(len(e) + 1)[np.searchsorted(e, c, "right")])
        parts += [np.eye(self.buckets)[k % self.buckets] for k in kinds]
        return np.concatenate(parts, 1)

    def fit(self, z: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.w = np.zeros(z.shape[1])
        eye = ridge * np.eye(z.shape[1])
        eye[0, 0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (y - p) - eye @ self.w
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + eye
            step = np.linalg.solve(h, g)
            self.w = self.w + step
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, z: np.ndarray) -> np.ndarray:
        return np.clip(z @ self.w, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve over the columns of x and a constant, with a small ridge."""
    v = View()
    v.fit(np.concatenate([np.ones((len(x), 1)), x], 1), y, 0.1)
    return v.w


Page = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


class Pool(Protocol):
    """Unlabelled pages, wherever they are."""

    def total(self, what: str, model: CoTrained) -> np.ndarray:
        """The sum of ``getattr(model, what)(page)`` over the pages."""


class CoTrained:
    """Both views, the rules by which they label pages for each other, and the calibrated mixture."""

    def __init__(self, x: np.ndarray, size: np.ndarray, kinds: list[np.ndarray], y: np.ndarray):
        """Of labelled pages (y: 0 or 1). Every fourth is left out for calibration."""
        self.text, self.meta = View(), View(8)
        self.text.prepare(x)
        self.meta.prepare(size)
        every = np.arange(len(y))
        self.held = every[3::4] if len(y) >= 40 else every
        self.own = np.setdiff1d(every, self.held) if len(y) >= 40 else every
        self.y = y.astype(float)
        self.z = [self.text.encode(x, []), self.meta.encode(size, kinds)]
        for view, z in zip((self.text, self.meta), self.z):
            view.fit(z[self.own], self.y[self.own])
        # by round, for each view: its weights, and the logits below and above which its word counts
        self.rules: list[list[tuple[np.ndarray, float, float]]] = []

    def __getstate__(self) -> dict:
        """What tasks need; the labelled pages, of which the encoded ones are large, stay on the driver."""
        return self.__dict__ | {"z": [], "y": None, "own": None, "held": None}

    def encoded(self, page: Page) -> list[np.ndarray]:
        x, size, kinds = page
        return [self.text.encode(x, []), self.meta.encode(size, kinds)]

    def histogram(self, page: Page) -> np.ndarray:
        """By view, the number of pages in each bin of the logit, of those that it has not taught the other yet."""
        z = self.encoded(page)
        bins = [np.clip((v.logit(x) + 30) * (LOGITS / 60), 0, LOGITS - 1).astype(int) for v, x in zip((self.text, self.meta), z)]
        return np.stack([np.bincount(b[y < 0], minlength=LOGITS) for b, y in zip(bins, self.taught(z)[::-1])]).astype(float)

    def taught(self, z: list[np.ndarray]) -> list[np.ndarray]:
        """By view, the labels that the other one gives: 0, 1, or -1 for none; the first rule that speaks decides."""
        out = [np.full(len(z[0]), -1), np.full(len(z[0]), -1)]
        for rule in self.rules:
            for teacher, (w, low, high) in enumerate(rule):
                logit, labels = np.clip(z[teacher] @ w, -30, 30), out[1 - teacher]
                labels[(labels < 0) & (logit >= high)] = 1
                labels[(labels < 0) & (logit <= low)] = 0
        return out

    def sums(self, page: Page) -> np.ndarray:
        """Of the pages that each view is taught: their number, gradient and second derivatives, one after the other."""
        z = self.encoded(page)
        parts = []
        for view, x, y in zip((self.text, self.meta), z, self.taught(z)):
            x, y = x[y >= 0], y[y >= 0]
            p = _sigmoid(view.logit(x))
            parts += [[float(len(y))], x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
        return np.concatenate(parts)

    def train(self, pool: Pool, rounds: int = ROUNDS) -> CoTrained:
        share = float(self.y[self.own].mean())
        sure = float(np.log(SURE / (1 - SURE)))
        for _ in range(rounds):
            seen = pool.total("histogram", self)
            if not seen.sum():
                break
            rule = []
            for view, n in zip((self.text, self.meta), seen):
                edges = np.arange(LOGITS + 1) * (60 / LOGITS) - 30
                # of each class a share as in the labelled pages, with all that score like the last one, and sure ones only
                above, below = np.append(np.cumsum(n[::-1])[::-1], 0), np.concatenate([[0], np.cumsum(n)])
                high = edges[np.flatnonzero(above >= SHARE * n.sum() * share)[-1]]
                low = edges[np.flatnonzero(below >= SHARE * n.sum() * (1 - share))[0]]
                rule.append((view.w.copy(), min(float(low), -sure), max(float(high), sure)))
            self.rules.append(rule)
            for _ in range(STEPS):
                self._step(pool.total("sums", self))
        yt = self.y[self.held]
        logits = [v.logit(z[self.held])[:, None] for v, z in zip((self.text, self.meta), self.z)]
        self.cal = [_curve(v, yt) for v in logits]
        self.mix = _curve(np.concatenate([c[0] + c[1] * v for c, v in zip(self.cal, logits)], 1), yt)
        self.z = []
        return self

    def _step(self, sums: np.ndarray) -> None:
        """A Newton step of both views; what they are taught weighs no more than the labelled pages, however many."""
        at = 0
        for view, z in zip((self.text, self.meta), self.z):
            d = z.shape[1]
            n, g, h = sums[at], sums[at + 1 : at + 1 + d], sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
            at += 1 + d + d * d
            weight = min(1.0, len(self.own) / max(n, 1.0))
            x, p = z[self.own], _sigmoid(view.logit(z[self.own]))
            ridge = np.eye(d)
            ridge[0, 0] = 1e-6
            g = x.T @ (self.y[self.own] - p) + weight * g - ridge @ view.w
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + weight * h + ridge
            view.w = view.w + np.linalg.solve(h, g)

    def score(self, x: np.ndarray, size: np.ndarray, kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text and metadata probabilities of good quality, and the combined one."""
        t, m = (c[0] + c[1] * v.logit(z) for c, v, z in zip(self.cal, (self.text, self.meta), self.encoded((x, size, kinds))))
        return _sigmoid(t), _sigmoid(m), _sigmoid(self.mix[0] + self.mix[1] * t + self.mix[2] * m)


class LocalPool:
    def __init__(self, page: Page):
        self.page = page

    def total(self, what: str, model: CoTrained) -> np.ndarray:
        return getattr(model, what)(self.page)


class TablePool:
    """Pages of a written table with x, lang, source, size; sums go to the driver in two steps, one row a partition first."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def total(self, what: str, model: CoTrained) -> np.ndarray:
        shared = self.rows.sparkSession.sparkContext.broadcast(model)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = getattr(shared.value, what)(_page(batch.slice(at, 4096)))
                    out = part if out is None else out + part
            if out is not None:
                yield _one_row(out)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for v in batch.column(0):
                    part = np.frombuffer(v.as_buffer())
                    out = part.copy() if out is None else out + part
            if out is not None:
                yield _one_row(out)

        parts = self.rows.mapInArrow(add, "sums binary")
        few = max(1, round(self.rows.rdd.getNumPartitions() ** 0.5))
        found = parts.repartition(few).mapInArrow(merge, "sums binary").toArrow()["sums"]
        shared.destroy()
        shape = (2, LOGITS) if what == "histogram" else (-1,)
        if not len(found):
            return np.zeros((2, LOGITS)) if what == "histogram" else np.zeros(sum(1 + d + d * d for d in (z.shape[1] for z in model.z)))
        return sum(np.frombuffer(v.as_buffer()) for v in found).reshape(shape)


def _one_row(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(sums).tobytes()], pa.binary())], names=["sums"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer()) for v in column]) if len(column) else np.zeros((0, len(FEATURES)))


def _size(column: pa.Array) -> np.ndarray:
    n = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return np.log1p(np.maximum(np.nan_to_num(n), 0))[:, None]


def _page(batch: pa.RecordBatch) -> Page:
    """Of a batch with x, lang, source (numbers of the kinds) and size."""
    kinds = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lang", "source")]
    return _matrix(batch.column("x")), _size(batch.column("size")), kinds


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, p_text, p_meta, score (double, 0 to 1: good quality), keep boolean (score >= threshold).

    Learns from the ``rows`` labelled documents with the smallest hash of the id among those of ``labels`` for which
    ``learn`` holds (the documented bound), and from all documents without a label. Labels other than 0 and 1 are ignored;
    contradicting ones count as 0. Null texts count as empty, null metadata as a kind of its own. Without labels of both
    kinds every document scores 1 and is kept. A score that is just the threshold keeps its document. Repeated rows get a
    row each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    kind = docs.schema[id_col].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), *(batch.column(i) for i in (2, 3, 4))], names=["id", "x", "lang", "source", "size"])

    number = lambda c: F.when(F.col(c).isNull(), 0).otherwise(1 + F.crc32(F.col(c).cast("string").cast("binary")) % (1 << 20)).cast("int")
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), number(lang_col).alias("lang"), number(source_col).alias("source"), F.col(size_col).cast("double").alias("size")]
    held = scratch.write(docs.select(*columns).mapInArrow(features, f"id {kind}, x binary, lang int, source int, size double"))
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(learn.cast("int")).alias("learn"))
    all_marked = scratch.write(marked)
    first = [F.xxhash64("id"), F.col("id")]
    known = scratch.write(all_marked.where("learn = 1").join(held.select("id"), "id", "left_semi").select("id", "y").orderBy(*first).limit(rows))
    sample = held.join(F.broadcast(known), "id").orderBy(*first).limit(rows).toArrow().combine_chunks()  # ids may repeat
    y = sample["y"].to_numpy()
    model = None
    if {0, 1} <= set(y.tolist()):
        free = scratch.write(held.join(all_marked, "id", "left_anti").select("x", "lang", "source", "size"))
        model = CoTrained(*_page(sample.to_batches()[0]), y).train(TablePool(free))
    fitted = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if fitted.value is None:
                t = m = p = np.ones(batch.num_rows)
            else:
                t, m, p = fitted.value.score(*_page(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (t, m, p)), pa.array(p >= threshold)], names=["id", "p_text", "p_meta", "score", "keep"])

    return held.mapInArrow(run, f"id {kind}, p_text double, p_meta double, score double, keep boolean").withColumnRenamed("id", id_col)
