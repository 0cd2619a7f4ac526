"""Near-duplicate embeddings by cross-polytope hashing, with every candidate verified in double precision.

A vector is turned by pseudo-random rotations (three rounds of sign flips and a fast Hadamard transform); its hash is the
nearest of the 2 * dims signed axes. Several of them make a bucket of one table; how many follows the number of vectors, so that accidental
meetings do not grow with their square, and the number of tables follows from the share of pairs at the threshold that meet in one, so that
a pair there is missed with probability MISS at most. A vector stands in its own
bucket of each table and, by multiprobe, in those that the next nearest axes give. Two vectors meet where
one stands in the other's own bucket.

Equal vectors are one class with a weight. Each class is verified against one other, of its buckets' smallest members the one
that it meets most often; then buckets that still hold several components are compared in chunks. Tasks give links that join what
was apart, never pairs. Links are counted last, within each component, by matrix products of chunks: all its pairs are
verified, so a component of m different vectors costs m * m products, and copies cost nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runs import GROUP, apart, group_bounds, in_groups, pairs_of, whole_groups
from .shared import Scratch

PROBES = 8
MISS = 1e-4
CHUNK = 512
NEAREST = 4
LEAST_WIDTH = 32
SEED = 20_011
ELEMENTS = 1 << 20  # of vectors held at a time
SMALL = 48  # rows of a group below which pairs are listed for all groups at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


def width_of(dims: int) -> int:
    """The next power of two; short vectors are padded to LEAST_WIDTH, as flips and transforms of few dims give few different rotations."""
    return max(LEAST_WIDTH, 1 << max(0, dims - 1).bit_length())


@lru_cache(8)
def _signs(width: int, tables: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, hashes, 3, width))


def codes(units: np.ndarray, table: int, tables: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of unit vectors in one table: first the own bucket, then the probed ones."""
    n, dims = units.shape
    width = width_of(dims)
    padded = np.zeros((n, width))
    padded[:, :dims] = units
    nearest, losses = [], []
    for flips in _signs(width, tables, hashes)[table]:
        turned = padded
        for s in flips:
            turned = hadamard(turned * s)
        both = np.concatenate((turned, -turned), axis=1)
        top = min(NEAREST, 2 * width)
        at = np.argpartition(-both, top - 1, axis=1)[:, :top]
        value = np.take_along_axis(both, at, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        at, value = np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)
        nearest.append(at)
        losses.append((value[:, :1] - value) ** 2)
    choices = [c for c in itertools.product(range(nearest[0].shape[1]), repeat=hashes) if sum(x > 0 for x in c) <= 2]
    loss = np.stack([sum(losses[h][:, c[h]] for h in range(hashes)) for c in choices], 1)
    loss[:, 0] = -1.0
    code = np.stack([sum(nearest[h][:, c[h]].astype(np.int64) * (2 * width) ** h for h in range(hashes)) for c in choices], 1)
    best = np.argsort(loss, axis=1, kind="stable")[:, : probes + 1]
    return np.take_along_axis(code, best, 1)


def unit_rows(flat: np.ndarray, n: int) -> np.ndarray:
    rows = flat.reshape(n, -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _flat(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False)


def plan(width: int, vectors: int, least: float, probes: int = PROBES, miss: float = MISS) -> tuple[int, int]:
    """Tables and hashes for so many vectors: hashes so that there are as many buckets as vectors, then tables by trial on made pairs at the threshold."""
    hashes = min(6, max(2, math.ceil(math.log(max(2, vectors)) / math.log(max(2, 2 * width)))))
    rng = np.random.default_rng(SEED + 1)
    a, b = rng.standard_normal((2, 4096, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-12)[:, None]
    x, y = codes(a, 0, 1, hashes, probes), codes(least * a + np.sqrt(max(0.0, 1 - least * least)) * b, 0, 1, hashes, probes)
    met = ((x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)).mean()
    return max(1, math.ceil(math.log(miss) / math.log(min(0.9999, max(1e-4, 1 - met))))), hashes


def _buckets(classes: DataFrame, plans: dict[int, tuple[int, int]], probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                where, (tables, hashes) = np.flatnonzero(dims == d), plans[width_of(d)]
                step = max(1, (1 << 16) // width_of(d))
                for at in range(0, len(where), step):
                    part = batch.take(pa.array(where[at : at + step]))
                    units, vec = unit_rows(_flat(part.column("vector")), part.num_rows), part.column("doc").to_numpy()
                    for t in range(tables):
                        found = codes(units, t, tables, hashes, probes)
                        n, width = found.shape
                        own = np.zeros((n, width), bool)
                        own[:, 0] = True
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n * width, d, np.int32)), pa.array(np.full(n * width, t, np.int32)), pa.array(found.ravel()), pa.array(np.repeat(vec, width)), pa.array(own.ravel())], names=["dims", "hash_table", "code", "doc", "own"])

    found = classes.select("doc", "dims", "vector").mapInArrow(run, "dims int, hash_table int, code long, doc long, own boolean")
    return found.select("doc", "own", F.xxhash64("code", "hash_table", "dims").alias("bucket"))


def _starred(least: float):
    """Pairs (a, b) with their vectors, to those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, other = batch.column("dims").to_numpy(), batch.column("other_dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero((dims == d) & (other == d))))
                if part.num_rows:
                    cosine = np.einsum("ij,ij->i", unit_rows(_flat(part.column("vector")), part.num_rows), unit_rows(_flat(part.column("other")), part.num_rows))
                    yield part.select(["a", "b"]).filter(pa.array(cosine >= least))

    return run


def _each_width(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole groups, apart by the length of their vectors: table, bounds, unit vectors."""
    for table, bounds in whole_groups(batches, keys, rows):
        dims = table.column("dims").to_numpy()
        for d in (kinds := np.unique(dims)).tolist():
            part = table if len(kinds) == 1 else table.take(pa.array(np.flatnonzero(dims == d)))
            yield part, bounds if len(kinds) == 1 else group_bounds(part, keys), unit_rows(_flat(part.column("vector")), part.num_rows)


def _hits(units: np.ndarray, bounds: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one group that link, the lower first."""
    sizes = np.diff(bounds)
    small = np.flatnonzero(sizes <= SMALL)
    kept = np.repeat(sizes <= SMALL, sizes)
    where = np.flatnonzero(kept)
    for x, y in pairs_of(np.concatenate(([0], np.cumsum(sizes[small]))), max(1000, ELEMENTS // units.shape[1])):
        x, y = where[x], where[y]
        near = np.einsum("ij,ij->i", units[x], units[y]) >= least
        yield x[near], y[near]
    for g in np.flatnonzero(sizes > SMALL).tolist():
        own = units[bounds[g] : bounds[g + 1]]
        x, y = np.nonzero(np.triu(own @ own.T >= least, 1))
        yield x + bounds[g], y + bounds[g]


def _joining(least: float, rows: int):
    """Links (a, b) between components that meet in one bucket's chunk or pair of chunks; what one link joins is not linked again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds, units in _each_width(batches, GROUP, rows):
            doc, (_, own) = table.column("doc").to_numpy(), np.unique(table.column("component").to_numpy(), return_inverse=True)
            root, found = list(range(int(own.max()) + 1)), ([], [])

            def top(i: int, root=root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for x, y in _hits(units, bounds, least):
                cross = own[x] != own[y]
                x, y = x[cross], y[cross]
                _, first = np.unique(own[x] * np.int64(len(root)) + own[y], return_index=True)
                for i, j in zip(x[first].tolist(), y[first].tolist()):
                    a, b = top(int(own[i])), top(int(own[j]))
                    if a != b:
                        root[b] = a
                        found[0].append(int(doc[i]))
                        found[1].append(int(doc[j]))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return run


def _counting(least: float, rows: int):
    """doc, links: those with others of its component's chunk or pair of chunks, each by the other's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds, units in _each_width(batches, ["component", "low", "high"], rows):
            doc, chunk, low, high, weight = (table.column(c).to_numpy() for c in ("doc", "chunk", "low", "high", "weight"))
            links = np.zeros(len(doc))
            for x, y in _hits(units, bounds, least):
                keep = (low[x] == high[x]) | (chunk[x] != chunk[y])
                links += np.bincount(x[keep], weight[y[keep]], len(doc)) + np.bincount(y[keep], weight[x[keep]], len(doc))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(links[some].astype(np.int64))], names=["doc", "links"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, probes: int = PROBES, miss: float = MISS) -> DataFrame:
    """vec_id, n_links (other vectors at a cosine of ``least`` or more), component_id (the smallest vec_id reachable), kept.

    One row for each of vectors (vec_id, embedding). Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without a vec_id, link with nothing; vectors of different lengths never link; rows that share a
    vec_id and differ count as links of that id. An empty table gives none; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    keyed = rows.select("vec_id", F.when(valid, F.col("vector")).alias("vector")).withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.reverse("vector"))})
    grouped = keyed.where("vector is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    # rows that share a vec_id may be several classes, so a class is known by its digests
    classes = scratch.keep(grouped.select("k1", "k2", F.col("id"), F.xxhash64("k1", "k2").alias("doc"), "weight", F.size("vector").alias("dims"), "vector"), "classes")
    width = F.when(F.col("dims") <= LEAST_WIDTH, LEAST_WIDTH).otherwise(F.expr("shiftleft(1, length(bin(dims - 1)))"))
    plans = {int(w): plan(int(w), n, least, probes, miss) for w, n in classes.groupBy(width).count().collect()}
    held = max(64, ELEMENTS // max(plans, default=1))

    spread = scratch.keep(_buckets(classes, plans, probes), "spread")
    met = spread.groupBy("bucket").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("own").alias("any_own")).where("first < last and any_own").select("bucket", "first")
    members = scratch.keep(spread.select("doc", "bucket").join(met, "bucket"), "members")
    scratch.drop("spread")
    votes = members.where("doc <> first").groupBy("doc", "first").agg(F.count(F.lit(1)).alias("votes"))
    chosen = votes.groupBy("doc").agg(F.max_by("first", F.struct("votes", "first")).alias("first"))
    mine = classes.select(F.col("doc").alias("a"), "dims", "vector")
    theirs = classes.select(F.col("doc").alias("b"), F.col("dims").alias("other_dims"), F.col("vector").alias("other"))
    both = chosen.select(F.col("doc").alias("a"), F.col("first").alias("b")).join(mine, "a").join(theirs, "b")
    star = scratch.keep(both.mapInArrow(_starred(least), "a long, b long"), "star")
    joined = scratch.keep(components(star, scratch), "joined")
    labelled = members.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    rest = apart(scratch.keep(labelled, "labelled"), scratch, CHUNK)
    scratch.drop("members")
    shown = in_groups(rest.join(classes.select("doc", "dims", "vector"), "doc"))
    more = scratch.keep(shown.mapInArrow(_joining(least, held), "a long, b long"), "more")
    joined = scratch.keep(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch), "joined")
    scratch.drop("labelled", "star", "more", "open", "edges", "up", "labels")

    sizes = joined.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / (2 * CHUNK)).alias("chunks"))
    dealt = joined.join(sizes, "component").select(F.col("node").alias("doc"), "component", "chunks", F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks")).alias("chunk"))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0L, chunks - 1)"))).select("doc", "component", "chunk", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"))
    given = in_groups(dealt.join(classes.select("doc", "dims", "weight", "vector"), "doc"), ["component", "low", "high"])
    links = given.mapInArrow(_counting(least, held), "doc long, links long").groupBy("doc").agg(F.sum("links").alias("links"))
    named = classes.select("k1", "k2", "id", "doc", "weight").join(links, "doc", "left").join(joined.withColumnRenamed("node", "doc"), "doc", "left")
    named = scratch.keep(named.select("k1", "k2", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("class_links"), F.coalesce("component", "doc").alias("component")), "named")
    least_ids = named.groupBy("component").agg(F.min("id").alias("class_component"))
    named = scratch.keep(named.join(least_ids, "component").select("k1", "k2", "class_links", "class_component"), "named")
    scratch.drop("joined", "classes")
    own = keyed.select("vec_id", F.when(F.col("vector").isNotNull(), F.col("k1")).alias("k1"), F.when(F.col("vector").isNotNull(), F.col("k2")).alias("k2"))
    out = own.join(named, ["k1", "k2"], "left").select("vec_id", F.coalesce("class_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("class_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
