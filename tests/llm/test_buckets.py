"""Buckets of rows in doc_id order, for ids of any spread."""

import random

import pytest
from pyspark.sql import functions as F

from cohortflow.llm import paragraph_sketch
from cohortflow.llm.shared import Scratch

N = 120_000
SPREADS = {
    "shards": "cast(id div 700 as bigint) * 4294967296L + id % 700",
    "even": "id",
    "random": "xxhash64(id)",
    "clustered": "case when id % 3 = 0 then id % 1000 else 1000000000000L + id * id end",
    "equal": "case when id % 3 = 0 then 5L else id * 10 end",
    "extremes": "case when id % 3 = 0 then 9223372036854775807L when id % 3 = 1 then -9223372036854775807L else id end",
}


@pytest.mark.parametrize("name", sorted(SPREADS))
def test_no_bucket_is_large_and_all_ascend(spark, name):
    keyed = spark.range(N).select(F.expr(SPREADS[name]).alias("key"), F.xxhash64(F.lit("t"), "id").alias("turn"))
    placed, levels = paragraph_sketch.in_buckets(keyed, Scratch(spark, "test"))
    found = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "turn")).alias("low"), F.max(F.struct("key", "turn")).alias("high")).orderBy("bucket").collect()
    assert sum(r["n"] for r in found) == N and max(r["n"] for r in found) <= 2 * paragraph_sketch.BUCKET_ROWS and 1 <= levels <= 5
    assert all(tuple(a["high"]) <= tuple(b["low"]) for a, b in zip(found, found[1:]))


def test_next_rows_of_numbered_shards(spark, monkeypatch):
    monkeypatch.setattr(paragraph_sketch, "BUCKET_ROWS", 5)
    rng = random.Random(2)
    rows = [((i // 7) << 32 | i % 7 if i % 10 else None, f"text {rng.random()} of {i}") for i in range(400)]
    found = paragraph_sketch.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    ids = {t: i for i, t in rows}
    after = {r["text"]: r["next_text"] for r in found}
    walk, at = [], min((t for i, t in rows if i is None), key=lambda t: [r["text"] for r in found].index(t))
    for _ in rows:
        walk.append(at)
        at = after[at]
    assert len(set(walk)) == len(rows)  # one round through all rows
    numbers = [-1 if ids[t] is None else ids[t] for t in walk]
    turn = numbers.index(min(numbers))
    turned = numbers[turn:] + numbers[:turn]
    assert sum(b < a for a, b in zip(turned, turned[1:])) <= 1 and sorted(turned) == sorted(numbers)
