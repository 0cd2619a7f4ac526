"""Near-duplicate documents by circulant MinHash, with exact Jaccard verification.

A permutation places each shingle on a circle of 2**32 points. A second permutation ranks the points;
the k-th coordinate of a signature is the least rank of the text's points after turning the circle
k steps. Two permutations so make all coordinates. Runs of ``rows`` coordinates form bands; texts that
share a band meet in a bucket.

Texts with the same set of shingles are one class, which is compared once. Each class is first verified, on full sets, against one
other: of its buckets' smallest members the one that it meets most often, twice at least. What links is joined, so a group of copies costs one
comparison a copy. Buckets that still hold several components are then compared in chunks: signatures
tell which classes can still link across components, and only these meet again with their full sets, in the same chunks. Tasks give
links that join what was apart, never pairs. A bucket's largest component is not dealt against itself, so a hot bucket
costs its size times the number of strangers in it; only many strangers in one bucket cost their square, in tasks of bounded size.

What may be missed: a pair of likeness J shares no band with probability (1 - J**rows)**bands, which for the defaults and a likeness of 0.80 is
8e-5 and falls fast above, and a signature rules out a pair at the threshold with probability below 1e-6 (SURE standard deviations). A pair that is missed
still ends in one component if a third text links with both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runs import GROUP, apart, in_groups, lists_of, matrix_of, pairs_of, whole_groups
from .shared import Scratch, semi
from .shingles import mix64, sets_of

TURN = 0x9E3779B1  # a step of the circle
CHUNK = 512
SURE = 5.0  # standard deviations below the threshold at which a signature rules a pair out
RUN = 16_000
BLOCK_PAIRS = 100_000


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of coordinates for each set; sets must not be empty."""
    out = np.empty((len(sets), coordinates), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= RUN):
            n, j = n + len(sets[j]), j + 1
        lengths = np.array([len(s) for s in sets[i:j]])
        starts = np.cumsum(lengths) - lengths
        points = (mix64(np.concatenate(sets[i:j]) ^ np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)
        ranks, high = np.empty_like(points), np.empty_like(points)
        for k in range(coordinates):
            np.add(points, np.uint32(k * TURN & 0xFFFFFFFF), out=ranks)
            np.multiply(ranks, np.uint32(0x7FEB352D), out=ranks)
            np.right_shift(ranks, 15, out=high)
            np.bitwise_xor(ranks, high, out=ranks)
            np.multiply(ranks, np.uint32(0x846CA68B), out=ranks)
            out[i:j, k] = np.minimum.reduceat(ranks, starts)
        i = j
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of each signature's bands."""
    n, coordinates = signature.shape
    parts = signature.reshape(n, coordinates // rows, rows).astype(np.uint64)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        keys = mix64(keys + parts[:, :, r] + np.uint64(1))
    return keys


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, bands and a byte of each coordinate (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in sets_of(batches, words):
            some = [i for i, s in enumerate(sets) if len(s)]
            signature = signatures([sets[i] for i in some], bands * rows)
            keys = band_keys(signature, rows)
            place = np.full(len(sets), -1)
            place[some] = np.arange(len(some))
            where = pa.array(place, mask=place < 0)
            marks = pa.array([r.tobytes() for r in signature.astype(np.uint8)], pa.binary()).take(where)
            digests = [np.array([int(f(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for f in (mix64, lambda s: mix64(s ^ np.uint64(0xD6E8FEB8)))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, digests), _lists(keys).take(where), marks], names=["doc_id", "n_shingles", "k1", "k2", "bands", "marks"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, marks binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc and its set, for rows of one doc_id those of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in sets_of(batches, words):
            some = [i for i, s in enumerate(sets) if len(s)]
            kept = [sets[i] for i in some]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
            flat = pa.array(np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc", "shingles"])

    return docs.mapInArrow(run, "doc long, shingles array<long>")


def _near(table: pa.Table, bounds: np.ndarray, percent: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different components that sizes and signatures let link; in a pair of chunks only across them."""
    component, chunk, low, high, n = (table.column(c).to_numpy() for c in ("component", "chunk", "low", "high", "n_shingles"))
    marks = matrix_of(table.column("marks"), np.uint8)
    for x, y in pairs_of(bounds, BLOCK_PAIRS):
        keep = (component[x] != component[y]) & ((low[x] == high[x]) | (chunk[x] != chunk[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[keep], y[keep]
        keep = (marks[x] == marks[y]).mean(1) >= least
        yield x[keep], y[keep]


def _hopeful(percent: int, least: float):
    """Rows of buckets that have a partner which signatures let link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, GROUP):
            some = np.zeros(table.num_rows, bool)
            for x, y in _near(table, bounds, percent, least):
                some[x] = some[y] = True
            if some.any():
                yield from table.filter(pa.array(some)).to_batches()

    return run


def _compare(percent: int, least: float):
    """Links (a, b) that join components within each bucket's chunk or pair of chunks, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, GROUP, 2_000):
            doc, own = table.column("doc").to_numpy(), table.column("component").to_numpy()
            sets, label = [x.view(np.uint64) for x in lists_of(table.column("shingles"))], np.unique(own, return_inverse=True)[1]
            found: tuple[list, list] = ([], [])
            for left, right in _near(table, bounds, percent, least):
                firsts, starts = np.unique(left, return_index=True)
                for x, several in zip(firsts.tolist(), np.split(right, starts[1:])):
                    several = several[label[several] != label[x]]
                    if not len(several):
                        continue
                    flat, sizes = np.concatenate([sets[y] for y in several]), np.array([len(sets[y]) for y in several])
                    hit = sets[x][np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)] == flat
                    same = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
                    for y in several[100 * same >= percent * (len(sets[x]) + sizes - same)].tolist():
                        if label[x] != label[y]:
                            found[0].append(int(doc[x]))
                            found[1].append(int(doc[y]))
                            label[label == label[y]] = label[x]
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (it is doc_id itself); one row for each of docs.

    Links join texts whose sets of ``words``-word shingles (A-Z in lower case; a shorter text is one shingle) have
    100 * intersection >= percent * union. Texts that are null, empty or without words have no shingles and link with nothing. Rows that
    share a doc_id count as one document. A row without a doc_id takes no part: component_id null, kept true.
    An empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(_signed(rows_in, words, bands, rows), "signed")
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "k1", "k2"]
    least = F.min_by(F.struct(F.col("doc_id").alias("doc"), "bands", "marks"), "doc_id").alias("least")
    classes = scratch.keep(whole.groupBy(*key).agg(least).select(*key, "least.*"), "classes")
    repeated = not whole.groupBy("doc_id").count().where("count > 1").isEmpty()
    texts = rows_in.dropDuplicates() if repeated else rows_in
    spread = scratch.keep(classes.select("doc", F.posexplode("bands").alias("band", "at")).select("doc", F.xxhash64("at", "band").alias("bucket")), "spread")
    met = spread.groupBy("bucket").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    members = scratch.keep(spread.join(met, "bucket"), "members")
    scratch.drop("spread")

    votes = members.where("doc <> first").groupBy("doc", "first").agg(F.count(F.lit(1)).alias("votes")).where("votes >= 2")
    pairs = scratch.keep(votes.groupBy("doc").agg(F.max_by("first", F.struct("votes", -F.col("first"))).alias("first")), "pairs")
    sets_of_ids = lambda ids: scratch.keep(_sets(semi(texts, scratch.keep(ids.distinct(), "wanted"), "doc_id"), words), "sets")
    sets = sets_of_ids(pairs.select(F.col("doc").alias("doc_id")).union(pairs.select("first")))
    both = pairs.join(sets, "doc").join(sets.select(F.col("doc").alias("first"), F.col("shingles").alias("others")), "first")
    same = F.size(F.array_intersect("shingles", "others"))
    star = scratch.keep(both.where(100 * same >= percent * (F.size("shingles") + F.size("others") - same)).select(F.col("doc").alias("a"), F.col("first").alias("b")), "star")
    scratch.drop("sets", "pairs")
    joined = scratch.keep(components(star, scratch), "joined")

    labelled = members.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    labelled = scratch.keep(labelled, "labelled")
    scratch.drop("members")
    rest = apart(labelled, scratch, CHUNK)
    sigma = (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    test = (percent, percent / 100 - SURE * sigma)
    schema = "doc long, bucket long, component long, chunk long, low long, high long"
    shown = in_groups(rest.join(classes.select("doc", "n_shingles", "marks"), "doc").select("doc", "bucket", "component", "chunk", "low", "high", "n_shingles", "marks"))
    hopeful = scratch.keep(shown.mapInArrow(_hopeful(*test), f"{schema}, n_shingles long, marks binary"), "hopeful")
    sets = sets_of_ids(hopeful.select(F.col("doc").alias("doc_id")))
    more = scratch.keep(in_groups(hopeful.join(sets, "doc")).mapInArrow(_compare(*test), "a long, b long"), "more")
    joined = scratch.keep(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch), "joined")
    scratch.drop("sets", "wanted", "labelled", "hopeful", "star", "more", "open", "edges", "up", "labels")
    named = scratch.keep(classes.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select(*key, F.coalesce("component", "doc").alias("found")), "named")
    scratch.drop("classes")
    found = signed.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("found"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
