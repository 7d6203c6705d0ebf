"""From raw documents to token ids: language ID, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes all that its predecessor kept. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from copresence.llm import exact_dedup, language_id, mixing, queries, simhash, tree_bpe
from copresence.llm.common import saved
from copresence.session import prepare


#: Rows of one Arrow batch: whole texts are long, and a batch stands in memory several times.
BATCH_ROWS = 1000


def _modest(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null or no letter, or no language clear at all."""
    _modest(spark)
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks the longest stays; of ties the smallest id, of repeated rows one. Null counts as empty."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays; null and empty texts link like any other."""
    _modest(spark)
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, whole and once each; texts without words (null, empty) are never taken.

    Whole rows meet the taken ids in a merge join at every size, so the stage costs one shuffle of its input, always.
    """
    taken = mixing.mix(docs, queries.domain(), queries.MIX_SHARE, queries.mix_weights(spark), epochs=1)
    ids = saved(taken.select(F.col("doc_id").alias("_id")).distinct(), "taken").hint("merge")
    return docs.join(ids, F.col("doc_id").eqNullSafe(ids["_id"]), "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digests of ids and of the decoded bytes; a null text counts as empty, repeated rows stay."""
    _modest(spark)
    return tree_bpe.encoded(docs, public_tokenizers.path(queries.BYTE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Training a network, 64-bit hashes and byte-pair merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return saved(STAGES[-1][1](spark, docs, sf_dir), "encoded")
