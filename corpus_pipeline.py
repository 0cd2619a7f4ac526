"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, read back from Parquet, and returns a
DataFrame. All but the last return the columns of ``documents``.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each group of near-duplicates the one with the smallest doc_id stays.
3. secrets: spans found by the secret scan are replaced by their kind.
4. mixing: rows are stored in the order of a Pfair schedule of their sources; none is dropped.
5. packing: texts are encoded and packed into windows in stored order; one row per piece.

A doc_id goes in stages 1 and 2 only if all of its rows are rejected; null doc_ids count as one id in stage 1 and always stay
in stage 2. Null texts are empty. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.minhash import near_duplicates
from cohortflow.llm.mixing import in_mixed_order
from cohortflow.llm.packing import pack
from cohortflow.llm.quality import quality
from cohortflow.llm.queries import TOKENIZER
from cohortflow.llm.secrets import redact_secrets
from cohortflow.llm.shared import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality(docs, table(spark, sf_dir, "labels"))
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = F.col("_metadata.file_name")  # part-N-...: N as a number, as its digits grow beyond 99999
    stored = docs.select("doc_id", "text", F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long").alias("stored_part"), name.alias("stored_file"), F.col("_metadata.row_index").alias("stored_row"))
    return pack(stored, TOKENIZER, order=["stored_part", "stored_file", "stored_row"])


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("secrets", hide_secrets), ("mixing", mix), ("packing", pack_windows)]
ORACLE_SQL = None  # MinHash, tokenizer and packing have no SQL form; tests hold the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
