"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from copresence.llm import (embed_dedup, exact_dedup, hard_negatives, language_id, manifest, mixing, quality_rules, secret_scan, simhash, sql,
                            substring_dedup, token_store, tree_bpe, url_filter)
from copresence.session import prepare

#: verdict and rule, host before the first slash
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
WORD_VOCABULARY = "word_bpe_49k.json"
WORD_IDS = 49_408
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Target weights of the mix; sources weigh the same within a language.
DOMAIN_WEIGHTS = {"hub": 2, "odd": 3, "even": 3}
LANG_WEIGHTS = {"en": 4, "de": 3, "fr": 2, "es": 2}
MIX_SHARE = 0.6
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
MIX_EPOCHS = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def domain() -> Column:
    """The large first source is a domain of its own, the others fall in two by their number."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(F.col("source") == "src0", "hub").when(F.when(number != "", number).otherwise("0").cast("int") % 2 == 1, "odd").otherwise("even")


def mix_weights(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "domain": spark.createDataFrame(list(DOMAIN_WEIGHTS.items()), "domain string, weight long"),
        "lang": spark.createDataFrame(list(LANG_WEIGHTS.items()), "lang string, weight long"),
    }


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_groups(_table(spark, sf_dir, "embeddings"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), domain(), MIX_SHARE, mix_weights(spark), MIX_EPOCHS)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, keys = token_store.store(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), WORD_IDS)
    return token_store.read(keys, folder, WORD_IDS, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.element_at("shares", F.col("lang_pred")).alias("lang_share"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.scored(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, with_ids=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    claims = {"n_chars": manifest.tampered(F.col("n_chars"))}
    return manifest.manifest(docs, MANIFEST_FIELDS, claims=claims).folded()


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = "CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END"
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", moved)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(_table(spark, sf_dir, "documents"))


QUERIES = {name: fn for name, fn in globals().items() if name.startswith("op")}
ORACLE: dict[str, str] = sql.ORACLE
