"""Mixing sources to target weights by Pfair scheduling.

A source's rows form turns of half a block. With target share ``w`` its i-th turn of a period (from 1) is released at slot ``floor((i - 1) * slots / q)``
of that period and due at ``ceil(i * slots / q)``, where q is what the period owes the source; in every slot the released turn with the earliest
deadline goes next. What periods owe are differences of rounded running sums of the target shares, so at each period's start every
source is less than one turn away from its target, however long the schedule, and inside a period, where the quotas fill the slots exactly and
every turn meets its window, less than one more: less than one block in all. Periods don't depend on each other, so Spark schedules them
side by side, each by one SQL expression.

A source that has run out leaves its slots empty; the others keep their order and nothing is dropped.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

PERIOD = 1000  # slots of a period, or more if a source's share is below one in so many
BLOCK = 32
SEED = 17
ROWS_A_BUCKET = 2_000
STEP = 500  # slots whose turns are gathered in one array before they are put together
TURNS = "array<struct<s:int,k:bigint,pos:bigint>>"


def rounded_sums(shares: list[float]) -> list[float]:
    """Running sums of shares from 0, scaled to end at 1."""
    sums, total = [0.0], math.fsum(shares)
    for i in range(len(shares)):
        sums.append(math.fsum(shares[: i + 1]) / total if i + 1 < len(shares) else 1.0)
    return sums


def schedule_sql(sources: int, slots: int, turn: int) -> str:
    """SQL for a period's turns in order, by earliest deadline first: source, number of its turn, and rows of all sources before it.

    Columns: had and owed (arrays: each source's turns before the period, and in it) and sizes (rows of each source).
    """
    due = f"cast(((done + 1) * {slots}L + owed[s] - 1L) div owed[s] as bigint)"
    ready = f"filter(transform(acc.done, (done, s) -> if(done < owed[s] and (done * {slots}L) div owed[s] <= t, named_struct('due', {due}, 's', s), null)), x -> x is not null)"
    k = "had[c] + acc.done[c]"
    rows = f"greatest(0L, least({turn}L, sizes[c] - {turn}L * ({k})))"
    moved = f"named_struct('done', transform(acc.done, (x, s) -> if(s = c, x + 1L, x)), 'pos', acc.pos + {rows}, 'turns', concat(acc.turns, array(named_struct('s', c, 'k', {k}, 'pos', acc.pos))))"
    step = f"transform(array(array_min({ready}).s), c -> {moved})[0]"
    run = f"aggregate(sequence(part * {STEP}, least({slots}, (part + 1) * {STEP}) - 1), named_struct('done', whole.done, 'pos', whole.pos, 'turns', cast(array() as {TURNS})), (acc, t) -> {step})"
    start = f"named_struct('done', transform(owed, x -> 0L), 'pos', aggregate(zip_with(had, sizes, (h, n) -> least(n, {turn}L * h)), 0L, (a, x) -> a + x), 'parts', cast(array() as array<{TURNS}>))"
    grow = f"transform(array({run}), r -> named_struct('done', r.done, 'pos', r.pos, 'parts', concat(whole.parts, array(r.turns))))[0]"
    return f"aggregate(sequence(0, {(slots - 1) // STEP}), {start}, (whole, part) -> {grow}, whole -> flatten(whole.parts))"


def schedule(docs: DataFrame, shares: list[float], rows: list[int], turn: int, period: int = PERIOD) -> DataFrame:
    """mix_s, mix_turn, mix_slot, mix_first (rows of all sources before it) until all sources but the last to end have ended. shares add up to 1."""
    slots = max(period, math.ceil(1 / min(shares, default=1)))
    ends = sorted((math.ceil(n / turn) + 1) / (w * slots) for n, w in zip(rows, shares))
    periods = math.ceil(ends[-2]) if len(ends) > 1 else 0
    sums, literal = rounded_sums(shares), lambda values, kind: f"array({', '.join(f'cast({x!r} as {kind})' for x in values)})"
    had = lambda e: f"transform(sequence(1, {len(shares)}), i -> cast(floor(({e}) * {float(slots)!r} * c[i] + 0.5) - floor(({e}) * {float(slots)!r} * c[i - 1] + 0.5) as bigint))"
    each = docs.sparkSession.range(periods).withColumns({"c": F.expr(literal(sums, "double")), "sizes": F.expr(literal(rows, "bigint"))})
    each = each.withColumns({"had": F.expr(had("cast(id as double)")), "then": F.expr(had("cast(id as double) + 1.0D"))}).withColumn("owed", F.expr("zip_with(then, had, (a, b) -> a - b)"))
    turns = each.select("id", F.posexplode(F.expr(schedule_sql(len(shares), slots, turn))).alias("at", "x"))
    return turns.select(F.col("x.s").alias("mix_s"), F.col("x.k").alias("mix_turn"), (F.col("id") * slots + F.col("at")).alias("mix_slot"), F.col("x.pos").alias("mix_first"))


def mix_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, seed: int = SEED, period: int = PERIOD) -> DataFrame:
    """docs with columns mix_source_rank, mix_turn, mix_slot, mix_release, mix_due and mix_position.

    weights: a target share for each source; by default the square root
    of its rows, which lifts small sources. Sources without a weight, or of weight 0, follow after all others, in ascending order. mix_position numbers
    all rows from 0 in mixed order. A turn has block / 2 rows (block is even). Within a
    source rows come in the order of a seeded digest of doc_id and text. While every source lasts, after any slot each has had its share of all
    rows with less than ``block`` too few or too many; so a turn i (from 0) of share w lies between the slots mix_release = floor((i - 2) / w) and
    mix_due = ceil((i + 3) / w). Those three are null for turns after all other sources have ended.

    A null source is a source of its own; null ids and texts sort by empty strings; repeated rows each get a
    position; an empty table stays empty; other columns, also of clashing names, pass through untouched except for
    the six names above, which are replaced. The names and sizes of sources go through the driver; a slot costs time in proportion to their number, and
    periods grow to one over the smallest share. Row numbers come from buckets of the digest, so that no source meets in one task.
    """
    if block < 2 or block % 2:
        raise ValueError("a block has an even number of rows")
    turn = block // 2
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    names = ("mix_source_rank", "mix_turn", "mix_slot", "mix_release", "mix_due", "mix_position")
    docs = docs.drop(*names)
    columns = docs.columns
    hidden = {c: f"own_{i}_{uuid.uuid4().hex}" for i, c in enumerate(columns) if c.lower().startswith("mix_")}  # they must not meet the names used here
    docs = docs.withColumnsRenamed(hidden)
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).count().orderBy(F.col("source").asc_nulls_first()).collect()
    given = [(r["source"], r["count"], math.sqrt(r["count"]) if weights is None else float(weights.get(r["source"], 0))) for r in sizes]
    if any(not 0 <= w < math.inf for *_, w in given):
        raise ValueError("weights are finite and not negative")
    mixed, others = [x for x in given if x[2] > 0], [x for x in given if x[2] <= 0]
    total = math.fsum(w for *_, w in mixed)
    shares, rows = [w / total for *_, w in mixed], [n for _, n, _ in mixed]
    lasting = max(range(len(mixed)), key=lambda i: (rows[i] / shares[i], i), default=None)
    listed, after = [], sum(rows)
    for i, (name, n, _) in enumerate(mixed):  # mix_tail: where the rows of a source begin, less its rank, once all others have ended
        listed.append((name, i, shares[i], n, sum(rows) - n if i == lasting else None))
    for i, (name, n, _) in enumerate(others, len(mixed)):
        listed.append((name, i, None, n, after))
        after += n
    numbered = spark.createDataFrame(listed, "mix_name string, mix_s int, mix_w double, mix_n long, mix_tail long")
    numbered = F.broadcast(numbered) if len(listed) <= 100_000 else numbered
    plan = scratch.keep(schedule(docs, shares, rows, turn, period).where(F.col("mix_turn") * turn < F.array(*map(F.lit, rows or [0]))[F.col("mix_s")]), "schedule")

    text = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), "UTF-8"))
    share = F.conv(F.substring("mix_key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    bucket = F.floor(share * F.ceil(F.col("mix_n") / ROWS_A_BUCKET))
    keyed = docs.join(numbered, F.col("source").cast("string").eqNullSafe(F.col("mix_name"))).withColumn("mix_key", digest).withColumn("mix_bucket", bucket)
    counted = keyed.groupBy("mix_s", "mix_bucket").count()
    before = counted.select("mix_s", "mix_bucket", F.coalesce(F.sum("count").over(Window.partitionBy("mix_s").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("mix_before"))
    within = Window.partitionBy("mix_s", "mix_bucket").orderBy("mix_key")
    ranked = keyed.withColumn("mix_row", F.row_number().over(within)).join(before, ["mix_s", "mix_bucket"]).withColumn("mix_source_rank", F.col("mix_before") + F.col("mix_row") - 1)
    ranked = ranked.withColumn("mix_turn", F.floor(F.col("mix_source_rank") / turn))
    placed = ranked.join(F.broadcast(plan) if plan.count() <= 1_000_000 else plan, ["mix_s", "mix_turn"], "left")
    scheduled = lambda x: F.when(F.col("mix_slot").isNotNull(), x)
    return placed.withColumns({
        "mix_release": scheduled(F.greatest(F.floor((F.col("mix_turn") - 2) / F.col("mix_w")), F.lit(0))),
        "mix_due": scheduled(F.ceil((F.col("mix_turn") + 3) / F.col("mix_w"))),
        "mix_position": F.coalesce(F.col("mix_first") + F.col("mix_source_rank") % turn, F.col("mix_tail") + F.col("mix_source_rank")),
    }).select(*[F.col(hidden.get(c, c)).alias(c) for c in columns], *names)


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, same columns, stored in mixed order: partitions follow each other by position and each is sorted,
    so the order of part files and of rows within them is the mix."""
    return mix_order(docs, **options).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)
