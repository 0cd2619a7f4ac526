"""How far each source's use of words lies from the other sources of its language, counted in DuckDB shards.

One pass in Spark tasks turns texts into counts a (lang, source, term). The counts are dealt to shards by a hash of lang and term, so a shard holds
all there is to know about its terms. In each shard DuckDB adds the counts up, drops terms of too few documents, and, once Spark has added up every source's
total, works out the shard's part of every sum over terms for each pair of sources, and its highest terms. Spark adds the parts and ranks.

With p = 1 + floor(10^9 (count + 1) / (N + V)) and f(p, q) = floor((p - q)^2 / q), a pair's sum over all V terms is taken from the terms that occur:
every term counts f(p0, q0), the value where neither source has it; a term of one source adds f(p, q0) - f(p0, q0) or f(p0, q) - f(p0, q0); a term of both
adds f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). Everything is whole numbers, so shards of any cut give the same sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch
from .words import slices

TOP = 200
LEAST_DOCUMENTS = 3
ROWS_A_SHARD = 400_000
SCALE = 1_000_000_000
HELD = 200_000  # counts that a task gathers before it hands them on
PIECE = 4 << 20  # bytes of a text that are split at a time
COUNTED = 500_000  # rows that a shard takes in before it adds them up
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
#: A-Z to a-z; what is no letter and no byte of a longer character becomes a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text's bytes with terms between spaces, cut at spaces where it is long."""
    plain, at = text.translate(TERM_BYTES), 0
    while len(plain) - at > size:
        stop = plain.rfind(b" ", at + 1, at + size)
        stop = stop if stop > 0 else plain.find(b" ", at + size)
        if stop < 0:
            break
        yield plain[at:stop]
        at = stop
    yield plain[at:] if at else plain


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), and a row without term with the documents of each (lang, source)."""
    held: dict[tuple, tuple[Counter, Counter, list[int]]] = {}

    def counts() -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, documents, rows) in held.items():
            n = len(total) + 1
            yield pa.record_batch([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([None, *total], pa.binary()).cast(pa.string()),
                pa.array([0, *total.values()], pa.int64()), pa.array([rows[0], *map(documents.__getitem__, total)], pa.int64()),
            ], schema=COUNTS)
        held.clear()

    size = 0
    for batch in batches:
        for part in slices(batch):
            names = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
            for key, text in zip(names, part.column("text").to_pylist(), strict=True):
                total, documents, rows = held.setdefault(key, (Counter(), Counter(), [0]))
                before, rows[0] = len(total), rows[0] + 1
                own: set[bytes] = set()
                for piece in pieces(text):
                    terms = piece.split()
                    total.update(terms)
                    own.update(terms)
                documents.update(own)
                size += len(total) - before
                if size >= HELD:
                    yield from counts()
                    size = 0
    yield from counts()


def _shard() -> duckdb.DuckDBPyConnection:
    """A database in memory on one thread; it never writes to disk."""
    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    con.execute("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // q")
    con.execute(f"CREATE MACRO share(n, total, terms) AS (1 + ({SCALE}::HUGEINT * (n + 1)) // (total + terms))::BIGINT")
    return con


def _taken(con: duckdb.DuckDBPyConnection, batches: Iterator[pa.RecordBatch], sql: str) -> None:
    """Run sql, which reads ``given``, over the batches, about COUNTED rows at a time."""
    waiting, rows = [], 0

    def run() -> None:
        con.register("given", pa.Table.from_batches(waiting))
        con.execute(sql)
        con.unregister("given")
        waiting.clear()

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            rows += batch.num_rows
        if rows >= COUNTED:
            run()
            rows = 0
    if waiting:
        run()


def kept_terms(least: int):
    """A shard's terms of at least ``least`` documents of their lang: counts by source, and by lang (source is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _shard()
        con.execute("CREATE TABLE counted (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        _taken(con, batches, "INSERT INTO counted SELECT lang, source, term, sum(n)::BIGINT, sum(docs)::BIGINT FROM given GROUP BY ALL")
        kept = f"""
            WITH terms AS (SELECT lang, term, sum(n)::BIGINT AS n FROM counted GROUP BY lang, term HAVING sum(docs) >= {least})
            SELECT lang, NULL::VARCHAR AS source, term, n FROM terms
            UNION ALL SELECT lang, source, term, sum(c.n)::BIGINT FROM counted c SEMI JOIN terms USING (lang, term) GROUP BY ALL"""
        yield from con.sql(kept).to_arrow_table().to_batches(max_chunksize=50_000)
        con.close()

    return run


def shard_sums(top: int):
    """A shard's part of each pair's sum, and its ``top`` highest terms of each source.

    Rows without term give the sources of a lang with their totals; rows without source the counts of a whole lang.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _shard()
        con.execute("CREATE TABLE rows (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, total BIGINT, lang_total BIGINT, terms BIGINT)")
        _taken(con, batches, "INSERT INTO rows SELECT lang, source, term, n, total, lang_total, terms FROM given")
        con.execute("CREATE TABLE sources AS SELECT DISTINCT lang, source, total, lang_total, terms, share(0, total, terms) AS p0 FROM rows WHERE term IS NULL AND terms > 0")
        con.execute("CREATE TABLE used AS SELECT r.lang, r.source, r.term, share(r.n, s.total, s.terms) AS p, s.p0 FROM rows r JOIN sources s USING (lang, source) WHERE r.term IS NOT NULL")
        con.execute("CREATE TABLE langs AS SELECT r.lang, r.term, share(r.n, any_value(s.lang_total), any_value(s.terms)) AS q FROM rows r JOIN sources s USING (lang) WHERE r.source IS NULL GROUP BY r.lang, r.term, r.n")
        sums = f"""
            WITH levels AS (SELECT lang, source, p, p0, count(*) AS k FROM used GROUP BY ALL),
            parts AS (
                SELECT a.lang, a.source, b.source AS item, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0)) AS value
                FROM used a JOIN used b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
                UNION ALL SELECT l.lang, l.source, s.source, sum(k * (f(l.p, s.p0) - f(l.p0, s.p0))) FROM levels l JOIN sources s ON l.lang = s.lang AND l.source <> s.source GROUP BY ALL
                UNION ALL SELECT l.lang, s.source, l.source, sum(k * (f(s.p0, l.p) - f(s.p0, l.p0))) FROM levels l JOIN sources s ON l.lang = s.lang AND l.source <> s.source GROUP BY ALL
            )
            SELECT lang, source, 'pair' AS part, item, sum(value)::BIGINT AS value FROM parts GROUP BY ALL
            UNION ALL (
                SELECT lang, source, 'term', term, f(p, q) FROM used JOIN langs USING (lang, term) WHERE p > q
                QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {top}
            )"""
        yield from con.sql(sums).to_arrow_table().to_batches(max_chunksize=50_000)
        con.close()

    return run


def source_divergence(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCUMENTS, rows_a_shard: int = ROWS_A_SHARD) -> DataFrame:
    """For each (lang, source): every other source of the lang (part ``pair``) and its ``top`` most over-used terms (part ``term``), by divergence.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a lang keeps those in at least ``least`` of its rows.
    Value of a pair: f summed over all kept terms, p of the group against q of the item (0 if the lang keeps none). Value of a term that the
    group has and whose p is above the lang's q: f(p, q). rank counts from 1 a group and part, by value descending, then item ascending.

    Null texts, langs and sources are empty ones; each row is a document of its own, repeated or not, whatever its doc_id; a group without terms still has
    its pairs; an empty table gives no rows; other columns are not read.

    Tables written are the counts that tasks pass on, kept terms by source, and totals a source; shards follow the number of counts. A shard
    gets a term at most once a source from each HELD counts of a task. Sources come to each shard as rows, pairs of sources are added up inside a shard.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").cast("binary").alias("text"))
    counts = scratch.keep(texts.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long"), "counts")
    least_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least_shards, math.ceil(counts.count() / rows_a_shard))
    kept = counts.where("term is not null").repartition(shards, "lang", "term").mapInArrow(kept_terms(least), "lang string, source string, term string, n long")
    kept = scratch.keep(kept, "kept")

    added = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = counts.where("term is null").select("lang", "source").distinct()
    own = added.where("source is not null").select("lang", "source", "total")
    whole = added.where("source is null").select("lang", F.col("total").alias("lang_total"), "terms")
    sources = scratch.keep(groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0), "sources")

    shards = max(least_shards, math.ceil(kept.count() / rows_a_shard))
    none = F.lit(None)
    heads = sources.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", none.cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "lang_total", "terms")
    body = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "source", "term", "n", *[none.cast("long").alias(c) for c in ("total", "lang_total", "terms")])
    parts = scratch.keep(heads.unionByName(body).repartitionById(shards, "shard").drop("shard").mapInArrow(shard_sums(top), "lang string, source string, part string, item string, value long"), "parts")

    p0 = lambda total: f"1L + cast({SCALE}L div ({total} + terms) as bigint)"
    nowhere = F.expr(f"if(terms = 0, 0L, terms * ((p - q) * (p - q) div q))")
    both = sources.select("lang", "source", "terms", F.expr(f"if(terms = 0, 1L, {p0('total')})").alias("p"))
    others = sources.select("lang", F.col("source").alias("item"), F.expr(f"if(terms = 0, 1L, {p0('total')})").alias("q"))
    base = both.join(others, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", nowhere.alias("value"))
    pairs = base.unionByName(parts.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
used AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}) USING (lang, term) GROUP BY ALL),
terms AS (SELECT lang, term, sum(n) AS n FROM used GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS terms, sum(n) AS lang_total FROM terms GROUP BY lang),
sources AS (SELECT d.lang, d.source, coalesce(any_value(s.terms), 0) AS terms, any_value(s.lang_total) AS lang_total, coalesce(any_value(u.total), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN sizes s USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL) u USING (lang, source) GROUP BY ALL),
dense AS (SELECT s.lang, s.source, t.term, coalesce(u.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(u.n, 0) + 1)) // (s.total + s.terms) AS p, 1 + ({SCALE}::HUGEINT * (t.n + 1)) // (s.lang_total + s.terms) AS q
    FROM sources s JOIN terms t USING (lang) LEFT JOIN used u USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM rows
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}
"""
