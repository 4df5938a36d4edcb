"""Byte-level BPE encoding by forced-boundary splitting, and decoding.

A byte pair that stands inside no token of the vocabulary can never be inside a token of an encoding, so a piece is cut
there with certainty; what lies between cuts is encoded by itself and the ids are concatenated. Pieces come from the
pre-tokenizer's pattern, which is a certain cut as well. Fragments of equal bytes have equal ids, so each worker keeps
those that it has seen, up to a bound.

Nulls count as the empty text, which has no ids and decodes to the empty text. Texts are never cut short; ties do not
occur. A special token's string in a text becomes its id, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Unicode's White_Space, which is what the pattern's \s means in the tokenizers library.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same pattern as the library has it.
WHOLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps.
MOST_KEPT = 150_000


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Bpe:
    """Encoder and decoder of one tokenizer file (its JSON text), for one process."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE tokenizer without prefix space or normalizer is needed")
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = {raw(k): v for k, v in model["vocab"].items() if all(c in to_byte for c in k)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {bytes([b]): i for i, b in enumerate(sorted(range(256), key=lambda b: vocab.get(bytes([b]), b)))}
        for a, b in pairs:
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        self.id_of_rank = np.array([vocab[k] for k in ranks], np.uint32)
        special = {k: len(ranks) + i for i, k in enumerate(self.special)}
        self.id_of_rank = np.array([*self.id_of_rank.tolist(), *self.special.values()], np.uint32)
        self._whole = tiktoken.Encoding("whole", pat_str=WHOLE, mergeable_ranks=ranks, special_tokens=special)
        self._core = self._whole._core_bpe
        self._cuts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._find = regex.compile(PATTERN).findall
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            inside[list(token[:-1]), list(token[1:])] = True
        #: forced[a, b]: bytes a and b are in no token next to each other.
        self.forced = ~inside
        self._kept: dict[str, bytes] = {}
        most = max(self.bytes_of, default=0) + 1
        self._table = [self.bytes_of.get(i, b"") for i in range(most)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that are not kept yet; fragments of all of them are found in one go."""
        raw = [p.encode() for p in pieces]
        ends = np.cumsum([len(x) for x in raw])
        data = b"".join(raw)
        b = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = self.forced[b[:-1], b[1:]]
        cut[ends] = cut[0] = True
        at = np.flatnonzero(cut)
        last = np.cumsum(cut[1:])[ends - 1].tolist()  # fragments up to the end of each piece
        at = at.tolist()
        core = self._core.encode_single_piece
        found = [core(data[i:j]) for i, j in zip(at, at[1:])]
        ids = self.id_of_rank[[r for x in found for r in x]].tobytes()
        out, f, i = {}, 0, 0
        for p, to in zip(pieces, last):
            n = i
            for x in found[f:to]:
                n += 4 * len(x)
            out[p] = ids[i:n]
            f, i = to, n
        return out

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        kept, pieces = self._kept, self._find(text)
        ids = list(map(kept.get, pieces))
        if None in ids:
            new = self._learn(list({p for p, i in zip(pieces, ids) if i is None}))
            ids = [i or new[p] for p, i in zip(pieces, ids)]
            if len(kept) + len(new) > MOST_KEPT:
                kept.clear()
            kept.update(new if len(text) < 1 << 20 else {})
        return b"".join(ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._cuts is None or not self._cuts.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._cuts.finditer(text):
            out += [self._plain(text[at : m.start()]), np.uint32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode_whole(self, text: str | None) -> np.ndarray:
        """The same ids by one call of the library's encoder; for operators that need ids but not this method."""
        return self.id_of_rank[self._whole.encode_to_numpy(text, allowed_special="all", disallowed_special=())] if text else self.id_of_rank[:0]

    def decode(self, ids: bytes) -> str:
        table = self._table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_OPEN: dict[int, Bpe] = {}


def opened(text: str) -> Bpe:
    """The worker's encoder for this tokenizer; built once a process."""
    key = hash(text)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Bpe(text)
    return _OPEN[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id column, ids (binary: little-endian unsigned 32-bit), n_tokens long, decoded string.

    ``path``: the tokenizer's JSON file; the driver reads it and ships it to the workers (1.5 MB). Repeated rows are
    encoded each; an empty table gives an empty one. No shuffle.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(spec.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [bpe.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    names=["id", "ids", "n_tokens", "decoded"],
                )

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with SHA-256 digests made beside the ids, so that neither ids nor texts leave the workers.

    Rows: the id column, n_tokens long, ids_sha256 and decoded_sha256 string (lowercase hex).
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(spec.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows = []
            for x in batch.column(1):
                ids = bpe.encode(x.as_py())
                rows.append((len(ids) // 4, sha(ids), sha(bpe.decode(ids).encode("utf-8"))))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
