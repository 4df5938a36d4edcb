"""Language identification by nearest centroids.

Texts are counted as hashed byte trigrams of their lower-cased letters, weighted by TF-IDF and normalised. Each language
has several centroids, from spherical k-means over a bounded sample of its labelled texts; a text gets the language of
the centroid with the highest cosine. A distance over the language's own limit (a high quantile of its labelled texts'
distances) marks the text as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import buffers, chunks

DIMS, CENTROIDS, FIT_ROWS, QUANTILE = 4096, 4, 300, 0.995
_CLASS = np.zeros(256, np.uint8)  # letters keep their byte, all else is a space
_CLASS[:] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigrams(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, last + 1, the counts of the DIMS trigram buckets by text (float32), and whether it has
    an ASCII letter. A text counts as if it stood between spaces."""
    data, offsets = buffers(column)
    for first, last, part, cut in chunks(data, offsets, size, 512):
        out = np.zeros((last - first, DIMS), np.float32)
        plain = np.zeros(last - first, bool)
        for a, b, text, ends in _pieces(part, cut):
            x = _CLASS[text]
            x[1:] += 32 * ((text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E)).astype(np.uint8)  # capitals of Latin-1
            doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            plain[a + doc[(x >= 97) & (x <= 122)]] = True
            h = (x[:-2].astype(np.uint32) * 0x9E3779B1 + x[1:-1].astype(np.uint32) * 0x85EBCA6B + x[2:].astype(np.uint32) * 0xC2B2AE35).astype(np.uint32)
            h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
            ok = (doc[:-2] == doc[2:]) & ((x[:-2] != 32) | (x[1:-1] != 32)) & ((x[1:-1] != 32) | (x[2:] != 32))
            n = np.bincount(doc[:-2][ok] * DIMS + h[ok], minlength=(b - a) * DIMS)
            out[a:b] += n.reshape(b - a, DIMS).astype(np.float32)
        yield first, last, out, plain


def _pieces(part: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last + 1 text, their bytes with a space at both ends of each, and offsets: up to 256 texts at a time.

    A long text comes alone, in parts that overlap by two bytes.
    """
    n, a, most = len(cut) - 1, 0, 1 << 20
    while a < n:
        b = min(n, a + 256)
        if cut[b] - cut[a] > 2 * most and b - a > 1:
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + most, "right")) - 1)
        size = np.diff(cut[a : b + 1])
        ends = np.concatenate([[0], np.cumsum(size + 2)])
        text = np.full(ends[-1], 32, np.uint8)
        text[np.arange(size.sum()) + 2 * np.repeat(np.arange(b - a), size) + 1] = part[cut[a] : cut[b]]
        if b - a == 1:
            for s in range(0, max(1, len(text) - 2), most):
                yield a, b, text[s : s + most + 2], np.array([0, min(most + 2, len(text) - s)])
        else:
            yield a, b, text, ends
        a = b


def _log_tf(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spherical(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows: farthest-first seeds, then mean directions."""
    at = [0]
    while len(at) < min(k, len(x)):
        at.append(int((x @ x[at].T).max(1).argmin()))
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], of: np.ndarray, centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.names, self.of, self.centroids, self.limits = idf, names, of, centroids, limits

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, cosine, whether it is beyond the language's limit."""
        cosine = _unit(_log_tf(counts) * self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return self.of[best], score, 1 - score > self.limits[self.of[best]]


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows for which ``learn`` holds and whose label is not null.

    Document frequencies are counted over all of them; the centroids are fitted on the ``rows`` of each language with the
    smallest hash of the id, the documented bound.
    """
    labelled = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, c, _ in trigrams(batch.column(0)):
                df += (c > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMS), -1)), pa.array(np.append(df, n))], names=["gram", "n"])

    counted = {r["gram"]: r["n"] for r in labelled.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    df = np.array([counted.get(i, 0) for i in range(DIMS)], np.float64)
    idf = np.log((counted.get(-1, 0) + 1) / (df + 1)) + 1
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    keys = labelled.select("id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("id", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, c, _ in trigrams(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([np.minimum(r, 65535).astype(np.uint16).tobytes() for r in c], pa.binary())], names=["lang", "counts"])

    chosen = labelled.join(F.broadcast(keys.select("id").distinct()), "id", "left_semi").select("lang", "text")
    sample = chosen.mapInArrow(vectors, "lang string, counts binary").limit(keys.count()).toArrow()  # ids may repeat
    names = sorted(set(sample["lang"].to_pylist()))
    lang = np.array([names.index(x) for x in sample["lang"].to_pylist()], np.int64)
    counts = np.stack([np.frombuffer(x, np.uint16) for x in sample["counts"].to_pylist()]).astype(np.float32) if names else np.zeros((0, DIMS), np.float32)
    x = _unit(_log_tf(counts) * idf.astype(np.float32))
    x, lang = x[counts.any(1)], lang[counts.any(1)]
    names_used = [i for i in range(len(names)) if (lang == i).any()]
    found = [_spherical(x[lang == i], centroids) for i in names_used]
    limits = [float(np.quantile(1 - (x[lang == i] @ c.T).max(1), QUANTILE)) for i, c in zip(names_used, found)]
    of = np.concatenate([np.full(len(c), i) for i, c in enumerate(found)]) if found else np.zeros(0, np.int64)
    return Model(idf.astype(np.float32), [names[i] for i in names_used], of, np.concatenate(found) if found else np.zeros((0, DIMS), np.float32), np.array(limits))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred string, score double (cosine, 0 to 1), rejected boolean.

    lang_pred is a learned value, ``und`` where the text is null or has no letter or nothing was learned; such rows score
    0 and are rejected. Equal cosines go to the language that sorts first. Whole texts are counted, however long.
    """
    spec = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spec.value
        names = np.array([*model.names, "und"], object)
        for batch in batches:
            for first, last, c, plain in trigrams(batch.column(1)):
                if model.names:
                    number, score, far = model.predict(c)
                else:
                    number, score, far = np.zeros(last - first, np.int64), np.zeros(last - first), np.ones(last - first, bool)
                none = np.zeros(last - first, bool) | (not model.names)
                for i in np.flatnonzero(~plain).tolist():
                    text = batch.column(1)[first + i].as_py()
                    none[i] = none[i] or not any(ch.isalpha() for ch in text or "")
                number, score, far = np.where(none, len(model.names), number), np.where(none, 0.0, score), far | none
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(names[number].tolist(), pa.string()), pa.array(score), pa.array(far)], names=["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
