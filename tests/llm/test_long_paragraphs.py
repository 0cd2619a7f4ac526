"""Long paragraphs without sentence ends are cut by content: an edit changes only what is near to it."""

import random

from pyspark.sql import functions as F

from cohortflow.llm import paragraph_sketch, queries


def lines():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghilmnorstuß") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    return {
        "words": " ".join(rng.choice(words) for _ in range(4000)),
        "no spaces": "".join(rng.choice("0123456789abcdefXYZ+/") for _ in range(20_000)),
        "han": "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(20_000)),
        "cyrillic": "".join(chr(rng.randint(0x430, 0x44F)) for _ in range(20_000)),
        "one letter": "x" * 20_000,
        "hard": "я" * 9_000,
    }


def test_pieces_are_whole_bounded_and_local(spark):
    rows = []
    for name, t in lines().items():
        at = len(t) // 3
        rows += [(name, 0, t), (name, 1, t[:at] + "new Ünits" + t[at + 4 :])]
    found = spark.createDataFrame(rows, "name string, side int, text string").select("name", "side", "text", paragraph_sketch.pieces(F.col("text")).alias("p")).collect()
    by = {(r["name"], r["side"]): r for r in found}
    assert all("".join(r["p"]) == r["text"] and max(map(len, r["p"])) <= paragraph_sketch.HARD for r in found)
    for name in ("words", "no spaces", "han", "cyrillic"):
        a, b = by[name, 0]["p"], by[name, 1]["p"]
        assert len(a) > 20 and sum(len(x) for x in set(a) - set(b)) < len(by[name, 0]["text"]) / 8, name


def test_an_edited_long_line_stays_near(spark, tmp_path):
    text = lines()["words"]
    docs = spark.createDataFrame([(1, text), (2, "other\n" + lines()["han"][:2000])], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op10_fingerprints(spark, str(tmp_path)).collect()}
    assert 0.7 < found[1]["near_edited"] < 0.95 and found[1]["near_next"] == 0 and found[1]["n_next_own"] > found[1]["n_only_own"] > 0
