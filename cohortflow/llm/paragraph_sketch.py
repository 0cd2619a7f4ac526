"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A text is cut into paragraphs (lines; long ones again at sentence ends; with ``longest`` given, what is still longer is cut by
content, so that an edit touches only pieces nearby). A paragraph's digest is a 64-bit
hash whose low 12 bits hold its length. A fingerprint has groups of cells, as many as a power of two that follows its number of
digests; a digest goes to a group by its hash and there into one cell of each of three tables, where a cell keeps a count, the xor of digests and
the xor of their check hashes. A fingerprint of more groups folds to fewer by adding them up. Two
fingerprints of one number of groups subtract cell by cell, which cancels everything that the texts share; peeling then
takes digests out of cells that hold just one, until nothing is left. If something is left, or if the numbers of digests alone
say that something would be, the sketch was too small, and both texts are sketched again with the groups of the longer and larger tables.

As cells are sums and xors, the difference of two fingerprints is computed from both texts' digests in one grouped sum, the
other side's with a negative count; it equals what subtracting the two published strings gives. Only SQL functions are used. The
texts are shuffled once, by ranges of doc_id, to meet the next text; afterwards only digests are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

# A line; a long one is cut at the first sentence end after 128 characters. It never goes back, so it takes linear time.
PIECES = r"[^\n]{1,128}+[^\n.!?]*+[.!?]*+"
LONGEST = 1024  # characters from which the registered query cuts a paragraph by content
# Bits of a long paragraph: up to a vowel, an even digit, white space or a character beyond Latin letters, so they fall alike after an edit.
BITS = r"[\x21-\u036F&&[^aeiouAEIOU02468]]{0,64}+[\s\S]|[\x21-\u036F]{1,64}"
CUT_ONE_IN = 128  # a cut follows one in so many runs of three bits, by their hash
HARD = 2048  # no piece is longer, whatever the content; below LENGTHS, so that whole lengths count
GROUP = 16  # digests of a group, at most on average
CELLS = 32  # of each of the three tables of a group, in a fingerprint
SEED = 100
HOPEFUL = 64  # a pair whose numbers of digests differ by more a group is not tried at fingerprint size
RETRIES = ((64, 200), (256, 300), (1024, 400))  # cells of each table, and seed; what is left even then is compared digest by digest
ROUNDS = 24
BUCKET_ROWS = 2000
FAN, NUMBERS, MOST_LEVELS = 64, 200, 8  # quantiles of a range; numbers kept for its parts, of which 190 at most are used; 200 ** 8 fits a long
LENGTHS = 4095
LOAD = 200_000  # digests of a partition


def pieces(paragraph: Column) -> Column:
    """A long paragraph in pieces of HARD characters at most, cut where the hash of the last three bits says so. Linear in its length."""
    let = lambda value, then: F.flatten(F.transform(F.array(value), then))
    hit = lambda bits, i: F.pmod(F.xxhash64(F.get(bits, i - 2), F.get(bits, i - 1), F.get(bits, i)), F.lit(CUT_ONE_IN)) == 0
    last = lambda bits: F.size(bits) - 1
    ends = lambda bits: F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last(bits)), lambda i: hit(bits, i)), F.array(last(bits))))
    piece = lambda bits, cuts, end, k: F.array_join(F.slice(bits, F.coalesce(F.get(cuts, k - 1), F.lit(-1)) + 2, end - F.coalesce(F.get(cuts, k - 1), F.lit(-1))), "")
    short = lambda p: F.regexp_extract_all(p, F.lit(rf"[\s\S]{{1,{HARD}}}"), F.lit(0))
    return let(F.regexp_extract_all(paragraph, F.lit(BITS), F.lit(0)), lambda bits: let(ends(bits), lambda cuts: F.flatten(F.transform(cuts, lambda end, k: short(piece(bits, cuts, end, k))))))


def digests(text: Column, longest: int | None = None) -> Column:
    """The set of paragraph digests of a text, ascending; paragraphs of more than ``longest`` characters are cut by content."""
    parts = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    if longest:
        parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= longest, F.array(p)).otherwise(pieces(p))))
    parts = F.filter(parts, lambda p: F.trim(p) != "")
    one = lambda p: F.xxhash64(p).bitwiseAND(F.lit(~LENGTHS)).bitwiseOR(F.least(F.length(p), F.lit(LENGTHS)).cast("long"))
    return F.array_sort(F.array_distinct(F.transform(parts, one)))


def groups_sql(n: str) -> str:
    """Groups for n digests: the power of two that leaves GROUP a group at most, on average."""
    return f"shiftleft(1L, if({n} <= {GROUP}, 0, length(bin(({n} - 1) div {GROUP}))))"


def cells_sql(key: str, groups: str, cells: int, seed: int) -> str:
    """A digest's three cells, numbered through all groups."""
    own = f"pmod(xxhash64({key}, 7L), {groups}) * {3 * cells}L"
    return "array(" + ", ".join(f"{own} + pmod(xxhash64({key}, {seed + j}L), {cells}L) + {j * cells}L" for j in range(3)) + ")"


CHECK = "xxhash64(k, -1L)"


def peel_sql(cells: str, size: int, seed: int, groups: str) -> str:
    """Peels an array of the cells (c, n, k, h) of a difference of which the empty ones are left out: struct of rest
    (cells that are not empty at the end), and of mine and other, the digests that only that side has."""
    let = lambda name, value, then: f"transform(array({value}), {name} -> {then})[0]"
    pure = f"array_distinct(transform(filter(acc.cells, c -> (c.n = 1L or c.n = -1L) and c.h = xxhash64(c.k, -1L)), c -> named_struct('n', c.n, 'k', c.k, 'h', c.h, 'p', {cells_sql('c.k', groups, size, seed)})))"
    take = "filter(transform(acc.cells, c -> aggregate(filter(found, e -> array_contains(e.p, c.c)), c, (a, e) -> named_struct('c', a.c, 'n', a.n - e.n, 'k', a.k ^ e.k, 'h', a.h ^ e.h))), c -> c.n <> 0L or c.k <> 0L or c.h <> 0L)"
    side = lambda name, sign: f"concat(acc.{name}, transform(filter(found, e -> e.n = {sign}L), e -> e.k))"
    next_round = f"named_struct('over', false, 'cells', {take}, 'mine', {side('mine', 1)}, 'other', {side('other', -1)})"
    stop = "named_struct('over', true, 'cells', acc.cells, 'mine', acc.mine, 'other', acc.other)"
    step = f"if(acc.over or size(acc.cells) = 0, acc, {let('found', pure, f'if(size(found) = 0, {stop}, {next_round})')})"
    start = f"named_struct('over', false, 'cells', {cells}, 'mine', cast(array() as array<bigint>), 'other', cast(array() as array<bigint>))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (acc, r) -> {step}, acc -> named_struct('rest', size(acc.cells), 'mine', acc.mine, 'other', acc.other))"


def characters(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(LENGTHS).cast("long")))


def printed(keyed: DataFrame, parts: int) -> DataFrame:
    """row, fingerprint, edited_fingerprint of keyed (row, k0, k1): groups, characters, then the cells that are not empty, in hexadecimal."""
    sides = [f"named_struct('s', {s}, 'g', {groups_sql(f'size(k{s})')}, 'k', k{s})" for s in (0, 1)]
    each = keyed.repartition(parts, "row").select("row", F.explode(F.expr(f"array({', '.join(sides)})")).alias("x")).select("row", "x.s", "x.g", F.explode("x.k").alias("k"))
    put = each.withColumn("c", F.explode(F.expr(cells_sql("k", "g", CELLS, SEED)))).groupBy("row", "s", "c").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("k").alias("k"), F.bit_xor(F.expr(CHECK)).alias("h"))
    text = F.expr("array_join(transform(array_sort(cells), e -> concat_ws('.', hex(e.c), hex(e.n), hex(e.k), hex(e.h))), '-')")
    listed = put.groupBy("row", "s").agg(F.collect_list(F.struct("c", "n", "k", "h")).alias("cells")).select("row", "s", text.alias("cells"))
    return listed.groupBy("row").agg(F.max(F.when(F.col("s") == 0, F.col("cells"))).alias("cells0"), F.max(F.when(F.col("s") == 1, F.col("cells"))).alias("cells1"))


def differences(pairs: DataFrame, cells: int, seed: int, larger: bool, parts: int) -> DataFrame:
    """row, pair, rest, mine, other, from pairs (row, pair, a, b: digests of both texts), by the difference of their sketches with the groups of the
    smaller text, or of the larger. Pairs without any difference have no row."""
    groups = groups_sql(f"{'greatest' if larger else 'least'}(size(a), size(b))")
    sides = "concat(transform(a, x -> named_struct('s', 1L, 'k', x)), transform(b, x -> named_struct('s', -1L, 'k', x)))"
    spread = pairs.repartition(parts, "row").select("row", "pair", F.expr(groups).alias("groups"), F.explode(F.expr(sides)).alias("x")).select("row", "pair", "groups", "x.s", "x.k")
    put = spread.withColumn("c", F.explode(F.expr(cells_sql("k", "groups", cells, seed)))).groupBy("row", "pair", "groups", "c")
    left = put.agg(F.sum("s").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor(F.expr(CHECK)).alias("h")).where("n <> 0 or k <> 0 or h <> 0")
    met = left.groupBy("row", "pair", "groups", F.expr(f"c div {3 * cells}").alias("g")).agg(F.collect_list(F.struct("c", "n", "k", "h")).alias("cells"))
    peeled = met.select("row", "pair", F.expr(peel_sql("cells", cells, seed, "groups")).alias("d"))
    return peeled.groupBy("row", "pair").agg(F.sum("d.rest").alias("rest"), F.flatten(F.collect_list("d.mine")).alias("mine"), F.flatten(F.collect_list("d.other")).alias("other"))


def _bounds(values: str, kept: str) -> Column:
    """Ascending bounds from quantiles: every ``kept``-th of them; one that stands several times is closed off, so that it gets a range of its own."""
    some = f"filter({values}, (x, i) -> i % {kept} = 0)"
    return F.expr(f"array_sort(array_distinct(concat({some}, transform(filter({values}, (x, i) -> i > 0 and x = {values}[i - 1]), x -> try_add(x, 1L)), filter({values}, (x, i) -> i > 0 and x = {values}[i - 1]))))")


def in_buckets(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """keyed (key, turn, ...) with bucket, which ascends with key, then turn, and the levels of its numbers: of ranges of over 2 * BUCKET_ROWS rows quantiles
    are taken again, of keys, or of turns where a range has one key, until none is left that can be cut. Only rows of equal key and turn stay together."""
    placed, levels = keyed.withColumn("bucket", F.lit(0).cast("long")), 0
    fractions = [i / FAN for i in range(FAN)]
    while levels < MOST_LEVELS:
        seen = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).withColumn("one", F.col("low") == F.col("high"))
        big = scratch.keep(seen.where(F.col("n") > 2 * BUCKET_ROWS).withColumn("step", F.greatest(F.lit(1), F.floor(FAN * BUCKET_ROWS / F.col("n")))), "big")
        kinds = [r["one"] for r in big.select("one").distinct().collect()]
        if not kinds:
            break
        found = []
        for one in kinds:
            some = big.where(F.col("one") == one)
            rows = placed.join(F.broadcast(some) if some.count() <= 100_000 else some, "bucket")
            # quantiles are doubles: of how far keys lie from the least of the range, and never over the greatest, so that a frequent key is met exactly in the end
            value = F.col("turn") if one else F.expr("cast(cast(key as decimal(20,0)) - cast(low as decimal(20,0)) as double)")
            cut = rows.groupBy("bucket", "step", "one", "low", "high").agg(F.percentile_approx(value, fractions, 20 * FAN).alias("q"), (F.min(value) < F.max(value)).alias("more")).where("more")
            if not one:
                cut = cut.withColumn("q", F.expr("transform(q, r -> cast(least(cast(low as decimal(38,0)) + cast(r as decimal(38,0)), cast(high as decimal(38,0))) as bigint))"))
            found.append(cut.select("bucket", "one", _bounds("q", "step").alias("bounds")))
        table = scratch.keep(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "bounds")
        rows = table.count()
        if not rows:
            break
        levels += 1
        joined = placed.join(F.broadcast(table) if rows <= 100_000 else table, "bucket", "left")
        passed = F.size(F.filter("bounds", lambda b: b <= F.when(F.col("one"), F.col("turn")).otherwise(F.col("key"))))
        placed = joined.withColumn("bucket", F.col("bucket") * NUMBERS + F.coalesce(passed, F.lit(0))).drop("bounds", "one")
    return placed, levels


def with_next(docs: DataFrame, longest: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text) with the text's digests k0, and next_text and k2, those of the row after it.

    Order: doc_id ascending (null first), then a digest of the text, then text; the row after the last is the first. The first row of each bucket is
    also dealt to the bucket before, to follow its last row.
    """
    least = -(1 << 63)
    scratch = scratch or Scratch(docs.sparkSession, "next")
    whole = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"), F.xxhash64(whole).alias("turn"), digests(whole, longest).alias("k0"))
    placed, levels = in_buckets(keyed, scratch)
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("key", "turn")).alias("first")).withColumn("run", F.expr(f"bucket div {NUMBERS ** ((levels + 1) // 2)}"))
    firsts = scratch.keep(firsts, "firsts")
    # the bucket before: in runs of buckets that share half of their levels, whose first looks to the run before; only the table of runs, about a root of the buckets, is in one task
    runs = firsts.groupBy("run").agg(F.max("bucket").alias("last"))
    everything = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("run", F.coalesce(F.lag("last").over(Window.orderBy("run")), F.max("last").over(everything)).alias("last"))
    before = firsts.join(runs, "run").select("bucket", "first", F.coalesce(F.lag("bucket").over(Window.partitionBy("run").orderBy("bucket")), F.col("last")).alias("bucket_before"))
    before = scratch.keep(before, "before")
    dealt = placed.withColumn("first", F.struct("key", "turn")).join(F.broadcast(before) if before.count() <= 1_000_000 else before, ["bucket", "first"], "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("bucket_before").alias("bucket"), F.lit(1).alias("guest"))
    both = dealt.select("doc_id", "key", "turn", "text", "k0", F.explode(F.when(F.col("bucket_before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("to"))
    rows = both.select("doc_id", "key", "turn", "text", "k0", "to.bucket", "to.guest")
    order = Window.partitionBy("bucket").orderBy("guest", "key", "turn", "text")
    return rows.withColumns({"next_text": F.lead("text").over(order), "k2": F.lead("k0").over(order)}).where("guest = 0").select("doc_id", "text", "k0", F.coalesce("next_text", "text").alias("next_text"), F.coalesce("k2", "k0").alias("k2"))


def fingerprints(docs: DataFrame, longest: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited form, with the differing digests recovered by peeling and the likenesses that they give.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next text.
    Likeness of two texts: the share of their characters, paragraph marks aside, that lies in paragraphs which both have; 1 for
    two texts without any. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the digests
    that one side alone has: only_own and only_edited for the edited text, next_own and next_other for the next text.

    One row for each row of docs. Null texts are empty; null ids sort first; repeated rows follow each other;
    a lone row is its own next; an empty table gives none; other columns are not read. Pairs whose cells do not all come out
    are sketched again with more cells and other hashes, and at last compared digest by digest, so none is left with part of an answer. Without ``longest``
    a paragraph has no upper length and counts LENGTHS characters at most; the registered query gives LONGEST.
    """
    scratch = Scratch(docs.sparkSession, "sketch")
    rows = with_next(docs, longest, scratch).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4)
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(n_chars / 4) as int))"))
    rows = rows.withColumn("edited", F.when(cut > 0, edited).otherwise(F.col("text")))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "k0", digests(F.col("edited"), longest).alias("k1"), "k2")
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = max(1, math.ceil((rows.agg(F.sum(F.size("k0"))).first()[0] or 0) / LOAD))
    pairs = rows.select("row", F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), F.col("k0").alias("a"), F.col(f"k{p}").alias("b")) for p in (1, 2)])).alias("x")).select("row", "x.pair", "x.a", "x.b")
    pairs = pairs.where(F.col("a") != F.col("b"))
    hopeful = F.expr(f"abs(size(a) - size(b)) <= {HOPEFUL} * {groups_sql('least(size(a), size(b))')}")
    found = scratch.keep(differences(pairs.where(hopeful), CELLS, SEED, False, 2 * parts), "found")
    failed = found.where("rest > 0").select("row", "pair").union(pairs.where(~hopeful).select("row", "pair"))
    done = [found.where("rest = 0")]
    for cells, seed in RETRIES:
        failed = scratch.keep(failed, "failed")
        if failed.isEmpty():
            break
        found = scratch.keep(differences(pairs.join(failed, ["row", "pair"], "left_semi"), cells, seed, True, 2 * parts), "found")
        done.append(found.where("rest = 0"))
        failed = found.where("rest > 0").select("row", "pair")
    else:
        exact = pairs.join(scratch.keep(failed, "failed"), ["row", "pair"], "left_semi")
        done.append(exact.select("row", "pair", F.lit(0).cast("long").alias("rest"), F.array_except("a", "b").alias("mine"), F.array_except("b", "a").alias("other")))
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    side = lambda p, name: F.max_by(name, F.when(F.col("pair") == p, F.lit(1)))
    by_row = settled.groupBy("row").agg(*[side(p, name).alias(f"{name}{p}") for p in (1, 2) for name in ("mine", "other")])
    whole = rows.join(by_row, "row", "left").join(printed(rows.select("row", "k0", "k1"), parts), "row", "left")
    none = F.array().cast("array<long>")
    near = lambda p: F.coalesce(F.lit(1.0) - F.try_divide(characters(F.coalesce(f"mine{p}", none)) + characters(F.coalesce(f"other{p}", none)), characters(F.col("k0")) + characters(F.col(f"k{p}"))), F.lit(1.0))
    shown = lambda s: F.concat_ws(":", F.expr(f"hex({groups_sql(f'size(k{s})')})"), F.hex(characters(F.col(f"k{s}"))), F.coalesce(f"cells{s}", F.lit("")))
    recovered = [F.coalesce(c, none).alias(name) for c, name in (("mine1", "only_own"), ("other1", "only_edited"), ("mine2", "next_own"), ("other2", "next_other"))]
    return whole.select("doc_id", "n_chars", "edited_sha256", shown(0).alias("fingerprint"), shown(1).alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"), *recovered)
