"""Packing by concatenate and cut: prefix sums over partition token totals give global offsets, then fixed windows.

Pass one encodes each document once, ends it with the closing id, and writes the ids with the document's place in its
partition. The totals of the partitions (one row each) get running sums, which turn local places into global offsets.
Pass two cuts at the multiples of the window length. A window over the end of a partition is a boundary record: both
sides give pieces with the same sequence_id, and their offsets fit because they are global. Only the last window of
all is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import opened, read_tokenizer
from .shared import Scratch


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = opened(spec.value), TaskContext.get().partitionId(), 0
        end = np.uint32(end_id)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                ids = [np.append(bpe.encode_whole(x), end) for x in rows.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                # two bytes an id where they suffice halve what is written between the passes
                kind = "<u4" if len(bpe._table) > 1 << 16 else "<u2"
                held = [x.astype(kind).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(local), pa.array(n), pa.array(held, pa.binary())], names=["id", "part", "local", "n", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _placed(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """The written rows of pass one with ``base``, the ids in all partitions before theirs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    held = scratch.write(_encoded(docs, path, id_col, text_col, end_id))
    totals = held.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return held.join(F.broadcast(base), "part")  # one row for each partition of the input


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids.

    Rows: id column, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long) and ids (array of int). Each id
    lies in exactly one piece. A null or empty text has the closing id alone; repeated rows are packed each; an empty
    table gives no rows; texts are whole, however long, and one document may fill many sequences.
    """
    return _pieces(_placed(docs, path, id_col, text_col, end_id), docs, id_col, length, True)


def pack_layout(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As pack, without the ids themselves."""
    return _pieces(_placed(docs, path, id_col, text_col, end_id), docs, id_col, length, False)


def _pieces(held: DataFrame, docs: DataFrame, id_col: str, length: int, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                n, first = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                last = (first + n - 1) // length
                count = last - first // length + 1
                doc = np.repeat(np.arange(len(n)), count)
                seq = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + (first // length)[doc]
                begin = np.maximum(seq * length, first[doc])
                stop = np.minimum((seq + 1) * length, (first + n)[doc])
                ids, own, crc, whole = rows.column(3), -1, np.zeros(len(doc), np.int64), []
                for i, (d, s, e) in enumerate(zip(doc.tolist(), (begin - first[doc]).tolist(), (stop - first[doc]).tolist())):
                    if d != own:
                        own, raw = d, ids[d].as_py()
                        x = np.frombuffer(raw, "<u4" if len(raw) == 4 * n[d] else "<u2").astype("<u4")
                        whole.append(x)
                    crc[i] = zlib.crc32(x[s:e])
                columns = [rows.column(0).take(pa.array(doc)), *map(pa.array, (begin - first[doc], stop - begin, crc, n[doc], seq, begin - seq * length))]
                # the pieces of the rows follow each other, as their ids do
                ends = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(whole).astype(np.int32)))] if with_ids else []
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(columns + lists, names=names + ["ids"] * with_ids)

    longs = [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *longs, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    out = held.select("id", "n", (F.col("base") + F.col("local")).alias("first"), "ids").mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """The packed sequences of ``pack``: sequence_id, ids (array of int, padded to ``length``), n_ids long.

    Groups hold at most ``length`` pieces, those of boundary windows from several partitions included.
    """
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    parts = parts.select("sequence_id", ids.alias("ids"), F.size(ids).cast("long").alias("n_ids"))
    return parts.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), (F.lit(length) - F.col("n_ids")).cast("int"))))
