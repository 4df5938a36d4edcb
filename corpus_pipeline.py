"""From raw documents to packed training sequences: five stages, each an operator of sondage.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Null and empty texts pass the first four stages, as nothing shows them to be toxic, bad or copies, and are packed as a
closing id alone. Rows with a null id pass them unlooked at. Ids are those of one document each; rows that share an id go
together in the first two stages, and are documents of their own in the others. Without labels nothing is predicted toxic
or bad. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import lines, minhash, packing, quality, toxicity
from sondage.llm.shared import Scratch, tables, without

TOKENIZER = "byte_bpe_50k.json"
#: Packing depends on byte-pair encoding and the classifiers on fitted models, which SQL does not express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Learns from all labelled documents that are still there."""
    scored = toxicity.fit_and_score(docs, tables(spark, sf_dir, "labels"), F.lit(True))
    return without(docs, scored.where("predicted = 1").select("doc_id"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    scored = quality.score(docs, tables(spark, sf_dir, "labels"), F.lit(True))
    return without(docs, scored.where("not keep").select("doc_id"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of equal or nearly equal lines one stays; documents whose lines all repeat others go."""
    return lines.drop_repeated_lines(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicate documents the one with the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids, with their ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table; each result is written and read again, but for the last."""
    docs, scratch = tables(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
