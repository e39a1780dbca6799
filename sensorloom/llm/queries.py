"""One named query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom import session
from sensorloom.llm import (
    decontam,
    langid,
    mixing,
    ngram_lm,
    pii,
    prefix_trie,
    quality,
    repair,
    sharding,
    simhash,
    token_files,
    toxicity,
    vectors,
)
from sensorloom.llm.common import table
from sensorloom.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"

_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(session.configure(spark), sf_dir)

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


@query
def op1_sharding(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


@query
def op2_near_vectors(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


@query
def op6_language(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_token_files(spark, sf_dir):
    folder = session.scratch_path(spark, "tokens")
    path = public_tokenizers.path(TOKENIZER)
    return token_files.digest(table(spark, sf_dir, "documents"), folder, path)


@query
def op4_lm_score(spark, sf_dir):
    return ngram_lm.digest(table(spark, sf_dir, "documents"))


@query
def op4_lm_score_trigrams(spark, sf_dir):
    return ngram_lm.digest(table(spark, sf_dir, "documents"), order=3)


@query
def op5_decontamination(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_personal_data(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


@query
def op12_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_repair(spark, sf_dir):
    return repair.digest(table(spark, sf_dir, "conversations"))
