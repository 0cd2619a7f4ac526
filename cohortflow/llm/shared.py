"""The shared folder, and lineage cut through tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset one is made in local mode, whose tasks share this machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return f"{conf.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, run once, written to the shared folder as Parquet and read from there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by shared_dir once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one run in the shared folder, which cut lineage and survive lost executors; drop what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, shared_dir(spark, name), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, run once and read back; keeping under a name again replaces what is read, not what was written before."""
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete all tables kept under these names."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in store.listStatus(at):
            if found.getPath().getName().rpartition("-")[0] in names:
                store.delete(found.getPath(), True)


def steady_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, except that plans stay as they were made: loops of many small joins run as few jobs there."""
    steady = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if steady.conf.isModifiable(key):
            steady.conf.set(key, value)
    steady.conf.set("spark.sql.adaptive.enabled", "false")
    return steady


def semi(df: DataFrame, few: DataFrame, key: str, most: int = 1_000_000, join: str = "left_semi") -> DataFrame:
    """Rows of df whose key is in ``few`` (a written table of ids, and little else): a broadcast of ``most`` rows at most, a shuffled join beyond."""
    return df.join(F.broadcast(few) if few.count() <= most else few, key, join)


def few(df: DataFrame, n: int, draw: Column, ties: list[str]) -> DataFrame:
    """The n rows of the least digests ``draw`` (a 64-bit hash), equal ones by the columns ``ties``.

    df is counted first; a bound on the digest leaves about n rows in all, so what is sorted does not grow with df's rows or partitions.
    """
    total = df.count()
    share = (n + 8 * n**0.5 + 64) / max(1, total)
    spread = F.pmod(draw, F.lit(1 << 32))
    bounded = df if share >= 1 else df.where(spread < F.lit(int(share * (1 << 32))))
    return bounded.withColumn("few_draw", spread).orderBy("few_draw", *ties).limit(n).drop("few_draw")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id", remainder: int = 0) -> F.Column:
    """Whether crc32(doc_id as text) mod 5 is ``remainder``; a null id counts as an empty text."""
    return (F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5) == remainder
