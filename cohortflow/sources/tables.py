"""Scans with existence checks, multi-site scans, and sinks. All paths are resolved by Spark's own file systems."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_if_there(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame | None:
    """The table at path, or None if there is none."""
    if not exists(spark, path):
        return None
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """A CSV file with a header, under a given schema: no pass for inference, and values that do not parse are null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", **options)


def _narrowest(c: str) -> Column:
    """The narrowest of int, bigint, double and string that holds all values of a column of texts; string if there is none."""
    v = F.trim(F.col(f"`{c}`"))
    fits = lambda kind: F.bool_and(v.try_cast(kind).isNotNull() | v.isNull())
    return F.when(F.count(v) == 0, "string").when(fits("int"), "int").when(fits("bigint"), "bigint").when(fits("double"), "double").otherwise("string")


def inferred_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file with a header whose columns get the narrowest of int, bigint, double and string that holds every value: one pass over all rows decides, so no
    sample can be wrong, and the table is then read under that schema."""
    text = spark.read.csv(path, header=True, **options)
    kinds = text.agg(*[_narrowest(c).alias(c) for c in text.columns]).first() if text.columns else []
    schema = ", ".join(f"`{c}` {kind}" for c, kind in zip(text.columns, kinds))
    return csv(spark, path, schema, **options) if schema else text


def database_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options) -> DataFrame:
    """A table of a database by JDBC. With a numeric ``key``, its least and greatest value are asked first and ranges of it are read side by side; Spark pushes filters
    and columns down to the database."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return reader.option("dbtable", table).load()
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = spark.read.format("jdbc").options(url=url, **options).option("query", f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}").load().first()
    if low is None:
        return reader.option("dbtable", table).load()
    return reader.option("dbtable", table).options(partitionColumn=key, lowerBound=low, upperBound=high + 1, numPartitions=partitions).load()


def to_database(df: DataFrame, url: str, table: str, mode: str = "overwrite", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """name: the lines of a file, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def sites(spark: SparkSession, paths: dict[str, str], kind: str = "parquet") -> DataFrame:
    """The tables of all sites as one plan with a column site_id; columns that a site lacks are null."""
    found = None
    for site, path in paths.items():
        part = spark.read.format(kind).load(path).withColumn("site_id", F.lit(site))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    if found is None:
        raise ValueError("no sites")
    return found


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_view(df: DataFrame, name: str) -> None:
    """A materialised view: the query's rows as a table, dropped and made again."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def write_csv_for_spreadsheets(df: DataFrame, path: str) -> None:
    """CSV files that begin with a UTF-8 byte order mark, which spreadsheets want: the mark is part of each file's header line."""
    names = df.columns
    marked = df.select(*[F.col(c).alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(names)])
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One table below folder for each name: a stored model, a step's state, or the sheets of a report."""
    for name, df in tables.items():
        (df.write.mode("overwrite").option("header", True) if kind == "csv" else df.write.mode("overwrite")).format(kind).save(f"{folder.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables that write_tables stored; a name that is not there raises."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}


def write_lines(df: DataFrame, path: str) -> None:
    """The one text column of df as lines."""
    df.write.mode("overwrite").text(path)


def run_folder(root: str, name: str, at: datetime | None = None) -> str:
    """Where a run's output goes: root, name and the time."""
    return f"{root.rstrip('/')}/{name}_{(at or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
