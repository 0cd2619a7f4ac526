"""The provided tables seen as a panel of stays, diagnoses, admissions, features of sites; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("icustayid"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("bloc"),
        F.when(F.col("event_type").isin("purchase", "view"), F.col("value")).otherwise(0.0).alias("iv"), F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0).alias("vaso"),
        F.hour("ts").cast("long").alias("state"), F.when(F.col("user_id") % 5 == 0, 1).otherwise(0).alias("y90"), "event_id", "value", "event_type",
    )


PANEL = """panel AS (SELECT user_id AS icustayid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bloc,
 CASE WHEN event_type IN ('purchase', 'view') THEN value ELSE 0 END AS iv, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS vaso,
 CAST(hour(ts) AS BIGINT) AS state, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS y90, event_id, value, event_type FROM events)"""


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber").alias("seq_num"), F.lpad(((F.col("l_partkey") * 37) % 100000).cast("string"), 5, "0").alias("icd9_code"))


DIAGNOSES = "dx AS (SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, lpad(CAST((l_partkey * 37) % 100000 AS VARCHAR), 5, '0') AS icd9_code FROM lineitem)"


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hadm_id"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 3 + 1).alias("site"), F.col("label").cast("long").alias("label"))


FEATURES = "feat AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, vec_id % 3 + 1 AS site, CAST(label AS BIGINT) AS label FROM embeddings)"


def centres(points: DataFrame, k: int = 10) -> DataFrame:
    return points.where(F.col("id") < k).select(F.col("id").alias("k"), F.col("x").alias("c"))


CENTRES = "cen AS (SELECT id AS k, x AS c FROM feat WHERE id < 10)"


def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(b < 2500, "1").when(b < 8500, "2").otherwise("3").alias("severity"))


SEVERITY = "sev AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 2500 THEN '1' WHEN c_acctbal < 8500 THEN '2' ELSE '3' END AS severity FROM customer)"
