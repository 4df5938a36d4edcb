"""Licence scans with a positional rare-token index.

The index holds the words of the licence templates with their places. Over all documents the document frequency of every
licence word is counted first. A template is led to by the places of its highest-IDF words, two more of them than may differ
in a match, so that no match escapes: at least two of them stand where they belong. Each file's words among these, its
highest-IDF licence words, are looked up; every occurrence at word p whose posting says place o of template t votes for t
beginning at p - o. Where two votes agree, but for a shift of up to SHIFT words, the whole template is compared, as one run
or as two that are shifted against each other, and the template's mandatory key phrases must stand there in full. Phrases
that are looked for exactly have postings as well, that of their rarest word, and all their words must follow each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ALNUM, LOWER, buffers, chunks, span_hashes, word_bounds


@dataclass(frozen=True)
class Template:
    """Words of a notice, its label, and the phrases of it that must stand in full."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Notices as licences and their users word them (fixed values).
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("granted free of charge", "without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("required by applicable law",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("proprietary", "all rights reserved", ("all rights reserved",)),
)
#: Phrases that are looked for exactly, with their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Share of a template's words that must agree, and the words that may be missing or added in its middle.
MATCHED, SHIFT = 0.8, 2


class Index:
    """Postings of templates and phrases by hash of the word."""

    def __init__(self, templates: tuple[Template, ...], phrases: tuple[tuple[str, str], ...]):
        self.templates, self.phrases = templates, phrases
        words = sorted({w for t in templates for w in t.text.split()} | {w for p, _ in phrases for w in p.split()})
        raw = " ".join(words).encode()
        lengths = np.array([len(w.encode()) for w in words])
        starts = np.cumsum(lengths + 1) - lengths - 1
        hashes = span_hashes(np.frombuffer(raw, np.uint8), starts, starts + lengths)
        order = np.argsort(hashes)
        self.words = [words[i] for i in order]
        self.hashes = hashes[order]
        self.number = {w: i for i, w in enumerate(self.words)}
        self.spelled = [np.array([self.number[w] for w in t.text.split()], np.int64) for t in templates]
        self.keys = [[np.array([self.number[w] for w in k.split()]) for k in t.keys] for t in templates]
        self.phrase_words = [np.array([self.number[w] for w in p.split()], np.int64) for p, _ in phrases]

    def rare(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings of the rare words: by word number (and -1) their first one, and by posting the template and the place.

        Templates come first, then the phrases.
        """
        found = []
        for t, ids in enumerate(self.spelled):
            most = len(ids) - math.ceil(MATCHED * len(ids) - 1e-9)
            places = np.argsort(-idf[ids], kind="stable")[: most + 2]
            found += [(int(ids[o]), t, int(o)) for o in places]
        for p, ids in enumerate(self.phrase_words):
            lead = int(np.argmax(idf[ids]))
            found.append((int(ids[lead]), len(self.spelled) + p, lead))
        w, t, o = np.array(sorted(found), np.int64).T
        return np.searchsorted(w, np.arange(len(self.words) + 1)), t, o

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of word hashes: the licence word's number, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _words(column: pa.Array, index: Index) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, last + 1, licence word numbers of all words, offsets of the texts' words."""
    data, offsets = buffers(column)
    for first, last, part, cut in chunks(data, offsets):
        part = LOWER[part]
        starts, ends, text = word_bounds(part, cut, ALNUM)
        yield first, last, index.numbers(span_hashes(part, starts, ends)), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=last - first))])


def document_frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents and, for each licence word, of those that hold it; over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(index.words), np.int64)
        for batch in batches:
            n += batch.num_rows
            for first, last, ids, cut in _words(batch.column(0), index):
                at = np.flatnonzero(ids >= 0)
                text = np.searchsorted(cut, at, "right") - 1
                df += np.bincount(np.unique(text * len(df) + ids[at]) % len(df), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(df)), -1)), pa.array(np.append(df, n))], names=["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {r["word"]: r["n"] for r in counted}
    return by_word.get(-1, 0), np.array([by_word.get(i, 0) for i in range(len(index.words))], np.int64)


def _hits(ids: np.ndarray, rare: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By occurrence of a rare word and posting of it: the word's place, the template, and where the template would begin."""
    first, templates, places = rare
    count = np.append(np.diff(first), 0)  # -1, no licence word, has none
    here = np.flatnonzero(count[ids])
    n = count[ids[here]]
    at = np.repeat(here, n)
    posting = np.repeat(first[ids[here]] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return at, templates[posting], at - places[posting]


def _compared(ids: np.ndarray, spelled: np.ndarray, at: int) -> tuple[float, int, int]:
    """The largest share of the template's words that agree, begun at ``at``, and the span of words that it takes.

    The template may be one run, or two of which the second is shifted by up to SHIFT words.
    """

    def agree(start: int) -> np.ndarray:
        places = np.arange(start, start + len(spelled))
        inside = (places >= 0) & (places < len(ids))
        out = np.zeros(len(spelled), bool)
        out[inside] = ids[places[inside]] == spelled[inside]
        return out

    own = agree(at)
    best, end = int(own.sum()), at + len(spelled)
    left = np.concatenate([[0], np.cumsum(own)])
    for shift in range(-SHIFT, SHIFT + 1):
        if shift:
            other = agree(at + shift)
            both = left + other.sum() - np.concatenate([[0], np.cumsum(other)])
            if both.max() > best:
                best, end = int(both.max()), at + len(spelled) + shift
    return best / len(spelled), max(0, at), min(len(ids), end)


def _find(ids: np.ndarray, index: Index, templates: np.ndarray, starts: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(label, first word, last word + 1, share of words that agree) of the templates that votes lead to in a document."""
    votes: dict[tuple[int, int], int] = {}
    for vote in zip(templates.tolist(), starts.tolist()):
        votes[vote] = votes.get(vote, 0) + 1
    out = []
    for (t, at), n in votes.items():
        if n + sum(votes.get((t, at + d), 0) for d in range(-SHIFT, SHIFT + 1) if d) < 2:
            continue
        share, low, high = _compared(ids, index.spelled[t], at)
        if share >= MATCHED and all(_phrase_in(ids[low:high], k) for k in index.keys[t]):
            out.append((index.templates[t].label, low, high, share))
    return sorted(out)


def _phrase_in(ids: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(ids) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([ids[i : i + n] == w for i, w in enumerate(phrase)]).any())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word (long), base_labels, labels (string), score
    double, spans (array of label, first, last + 1 word, score).

    A-Z is lowered; words are runs of digits, letters and all that is not ASCII. n_base counts the places of all phrases,
    overlapping ones too; first_word and last_word are the smallest and largest start, null without one. labels holds
    those of the phrases and of the templates, distinct, sorted, joined by commas; "" without any. score: 1 with a phrase,
    else the largest share of a template's words that agree, 0 without one. Null is the empty text: no words, no labels.
    Repeated rows, and rows that share an id, get a row each.
    """
    index = Index(templates, phrases)
    n, df = document_frequencies(docs, index, text_col)
    idf = np.log((n + 1) / (df + 1))
    rare = index.rare(idf)
    n_templates = len(index.spelled)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, ids, cut in _words(batch.column(1), index):
                m = last - first
                found: list[list[tuple[str, int]]] = [[] for _ in range(m)]
                spans: list[list] = [[] for _ in range(m)]
                place, template, start = _hits(ids, rare)
                text = np.searchsorted(cut, place, "right") - 1
                for p, (spelled, (_, label)) in enumerate(zip(index.phrase_words, phrases)):
                    mine = (template == n_templates + p) & (start >= cut[text]) & (start + len(spelled) <= cut[text + 1])
                    at, of = start[mine], text[mine]
                    for i, w in enumerate(spelled):
                        same = ids[at + i] == w
                        at, of = at[same], of[same]
                    for t, x in zip(of.tolist(), (at - cut[of]).tolist()):
                        found[t].append((label, x))
                led = np.flatnonzero(template < n_templates)
                bounds = np.searchsorted(text[led], np.arange(m + 1))
                for t in np.flatnonzero(np.diff(bounds)).tolist():
                    some = led[bounds[t] : bounds[t + 1]]
                    spans[t] = _find(ids[cut[t] : cut[t + 1]], index, template[some], start[some] - cut[t])
                base = [sorted({x for x, _ in f}) for f in found]
                every = [sorted({*b, *(s[0] for s in sp)}) for b, sp in zip(base, spans)]
                score = [1.0 if f else max((s[3] for s in sp), default=0.0) for f, sp in zip(found, spans)]
                columns = [
                    batch.column(0).slice(first, m),
                    pa.array(np.diff(cut).astype(np.int64)),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([min((p for _, p in f), default=None) for f in found], pa.int64()),
                    pa.array([max((p for _, p in f), default=None) for f in found], pa.int64()),
                    pa.array([",".join(b) for b in base], pa.string()),
                    pa.array([",".join(e) for e in every], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array([[{"label": s[0], "first": s[1], "last": s[2], "score": s[3]} for s in sp] for sp in spans], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, last long, score double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
