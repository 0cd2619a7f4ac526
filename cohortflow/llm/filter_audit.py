"""Every order of the corpus filters, walked as a trie whose nodes are the surviving documents.

All orders of a set of filters leave the same documents, so a node of the permutation trie is known by the set applied so far: 32 states
and 80 edges stand for the 120 orders of five filters. The walk goes depth first. Each state's survivors are a persisted DataFrame, cut from those of the
state it was first reached from, one aggregation counts what each filter still open removes there, and the state is released once all below it is done.
What is reported for the orders is put together from the edges' counts.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
EDGES = "part string, state string, filter string, removed long, good_lost long, toxic_lost long"


def judged_texts(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's digest and what each row fails by itself; texts don't leave the scan.

    A: under 200 words; B: less than half of the words distinct; C: over 2 % of code points in A-Z; D: one of ``#$%&*|``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    return judged.select(
        "doc_id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"),
        (F.size("words") < 200).alias("fails_A"), (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("fails_B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 2 * F.length("text").cast("long")).alias("fails_C"), F.col("text").rlike(r"[#$%&*|]").alias("fails_D"),
    )


def judged_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, fails_A to fails_E, good and toxic of each row as a written table. E: the text of a smaller doc_id."""
    judged = scratch.keep(judged_texts(docs), "judged")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    joined = judged.join(first, "digest", "left").join(known, "doc_id", "left")
    none = F.lit(False)
    return scratch.keep(joined.select("part", *[f"fails_{x}" for x in "ABCD"], F.coalesce(F.col("doc_id") > F.col("first"), none).alias("fails_E"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")), "rows")


def walk(rows: DataFrame, scratch: Scratch, filters: str = FILTERS) -> DataFrame:
    """EDGES: what each filter removes from each state's survivors, in each part that it removes anything from."""
    done: set[frozenset] = set()

    def counted(survivors: DataFrame, state: frozenset) -> DataFrame:
        still = [x for x in filters if x not in state]
        lost = lambda x: F.struct(F.lit(x).alias("filter"), *[F.count_if(F.col(f"fails_{x}") & c).alias(n) for n, c in (("removed", F.lit(True)), ("good_lost", F.col("good")), ("toxic_lost", F.col("toxic")))])
        each = survivors.groupBy("part").agg(F.array(*map(lost, still)).alias("lost")).select("part", F.inline("lost"))
        return each.select("part", F.lit("".join(sorted(state))).alias("state"), "filter", "removed", "good_lost", "toxic_lost")

    def visit(survivors: DataFrame, state: frozenset) -> None:
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        scratch.keep(counted(held, state), f"edges{''.join(sorted(state))}")
        done.add(state)
        for x in filters:
            below = state | {x}
            if x not in state and below not in done and len(below) < len(filters):
                visit(held.where(f"not fails_{x}"), below)
        held.unpersist()

    visit(rows, frozenset())
    return rows.sparkSession.read.schema(EDGES).parquet(f"{scratch.root}/edges*")


def filter_interactions(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part (source), filter_order and step what the step's filter does; kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    part: every source value, null as an empty string. Null texts are empty; words lie between ASCII white space. Each row of docs is one document. A null doc_id
    has no label, never fails E, and is no smaller id of any text; equal rows of one id don't fail E by each other. Of several labels of an id the largest
    counts; labels without an id are not read. Parts without a removal have zeros; an empty table gives no rows; other columns are not read.

    Two tables of narrow rows are written; equal texts are found by their SHA-256, whose first ids are aggregated before they are joined. Survivors hold a
    row a document and are spread as these tables are; a lost one is cut again from the written rows. Edges have 80 rows a part.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "filters")
    rows = judged_rows(docs, labels, scratch)
    edges = walk(rows, scratch, filters)
    sets = ["".join(s) for k in range(len(filters)) for s in combinations(filters, k)]
    weights = {(s, x): factorial(len(s)) * factorial(len(filters) - 1 - len(s)) for s in sets for x in filters if x not in s}
    grid = F.broadcast(spark.createDataFrame([(s, x, w) for (s, x), w in weights.items()], "state string, filter string, orders long"))  # 80 rows
    steps = [("".join(o), k + 1, "".join(sorted(o[:k])), o[k]) for o in permutations(filters) for k in range(len(filters))]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state string, filter string"))  # 600 rows

    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("documents"))
    counts = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "state", "filter"), F.struct("removed", "good_lost", "toxic_lost")))).alias("edge"))  # 80 entries at most
    whole = sizes.join(counts, "part", "left").withColumn("key", F.explode(F.array(*[F.lit(f"{s}>{x}") for s, x in weights])))
    known = lambda c: F.coalesce(F.col("edge")[F.col("key")][c], F.lit(0).cast("long")).alias(c)
    edge = whole.select("part", "documents", F.split("key", ">")[0].alias("state"), F.split("key", ">")[1].alias("filter"), known("removed"), known("good_lost"), known("toxic_lost")).join(grid, ["state", "filter"])
    one = Window.partitionBy("part", "filter")
    edge = edge.withColumns({
        "shapley": F.sum(F.col("removed") * F.col("orders")).over(one),
        "redundant": F.max(F.when(F.col("state") == "", F.col("removed"))).over(one) - F.col("removed"),
        "unique_fails": F.max(F.when(F.length("state") == len(filters) - 1, F.col("removed"))).over(one),
    })
    path = Window.partitionBy("part", "filter_order").orderBy("step")
    out = edge.join(steps, ["state", "filter"]).withColumn("kept", F.col("documents") - F.sum("removed").over(path))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
judged AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM words JOIN firsts USING (text) LEFT JOIN known USING (doc_id)),
cube AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
met AS (SELECT part, o, step, n, good, toxic, list_contains([fails[y] FOR y IN o[1:step - 1]], true) AS gone, fails[o[step]] AS failing, len(list_filter(fails, lambda v: v)) AS failures FROM cube, steps),
summed AS (SELECT part, o, step, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed, sum(n) FILTER (gone AND failing) AS redundant,
    sum(n) FILTER (failing AND failures = 1) AS unique_fails, sum(n) FILTER (NOT gone AND failing AND good) AS good_lost, sum(n) FILTER (NOT gone AND failing AND toxic) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, list_aggregate([substr('ABCDE', y, 1) FOR y IN o], 'string_agg', '') AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley FROM summed
"""
