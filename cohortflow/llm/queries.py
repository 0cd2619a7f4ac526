"""The registered queries of this subpackage: production parameters, whole tables, contract columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, filter_audit, url_filter
from .divergence import source_divergence
from .embedding_dedup import near_vectors
from .filter_audit import filter_interactions
from .language_model import score_texts
from .minhash import near_duplicates
from .mixing import BLOCK, SEED, mix_order
from .packing import pack
from .paragraph_sketch import LONGEST, fingerprints
from .quality import quality
from .records import token_records
from .secrets import find_secrets, report
from .shared import table
from .toxicity import toxicity
from .url_filter import judge_urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_secrets(table(spark, sf_dir, "documents")))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, bands=32, rows=8)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_order(table(spark, sf_dir, "documents"), block=BLOCK, seed=SEED)
    return mixed.select("doc_id", "source", *[c for c in mixed.columns if c.startswith("mix_")])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"), longest=LONGEST)
    recovered = {f"n_{name}": F.size(name).cast("long") for name in ("only_own", "only_edited", "next_own", "next_other")}
    return found.withColumns(recovered).drop("only_own", "only_edited", "next_own", "next_other")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": divergence.SQL, "op12_url_filter": url_filter.sql(), "op13_filter_audit": filter_audit.SQL}
