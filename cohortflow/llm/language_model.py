"""Scoring texts by a class-factored recurrent language model.

The probability of a token is that of its class, given all of the text before it, times its share of the class:

* a gated recurrent network, trained by truncated backpropagation, gives the classes and, for the LEARNED most frequent words, the words of a class: both
  are softmax layers over its state. Its classes of learned words are runs of words by frequency, of about equal mass by the root of the count;
* all other words are classed by shape, and their shares are counts over all training texts, smoothed by 0.5, with one place for unseen words in each.

The network is trained on every token of every training text once: texts are dealt to ROUNDS rounds by a digest; in a round each task learns from its
whole texts, beginning from the same weights, and a grouped sum of fixed size averages the tasks' weights, each by its tokens.

The ``HEAD`` most frequent words, bounded whatever the corpus, go to all tasks;
the counts of all other words stay in a table of the size of the vocabulary, to which the texts' rare words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recurrent import Layout, Learner, flattened, score, start, unflattened
from .shared import Scratch, held_out
from .words import plain_texts, slices, split_words

HEAD = 65_536
LEARNED, LEARNED_CLASSES, MOST_WORDS = 2_048, 40, 96  # words with a softmax of their own, their classes, and the words of a class
SHAPES = 8
HIDDEN, WIDTH = 12, 12
ROUNDS = 2
UNIT, MOST_WEIGHT = 1 << 16, 1024.0  # sums of weights are whole numbers of 1 / UNIT (or coarser), so their order changes nothing
END = ""  # no word is empty


def shapes(words: pa.Array) -> np.ndarray:
    """0 to SHAPES - 1: letters a-z, letters then a stop or comma, by letters beyond ASCII, and all else."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    yes = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    out = np.full(n, 7)
    out[yes(r"^\p{L}+[.,]?$")] = 6
    for k, letters in enumerate(("äöüß", "éèêçà", "ñóíá")):  # letters that few languages share
        out[yes(rf"^\p{{L}}*[{letters}]\p{{L}}*[.,]?$")] = 3 + k
    out[yes(r"^[a-z]+[.,]$")] = 1
    out[yes(r"^[a-z]+$")] = 0
    out[pc.equal(words, END).to_numpy(zero_copy_only=False)] = 2
    return out


def classes_of(counts: np.ndarray) -> Layout:
    """Classes of learned words, whose counts fall: about equal sums of roots of counts, MOST_WORDS words at most."""
    words = min(len(counts), LEARNED)
    roots = np.sqrt(counts[:words].astype(float))
    share, firsts, mass, n = roots.sum() / LEARNED_CLASSES, [], 0.0, 0
    for w in range(words):
        if not firsts or mass >= share or n >= MOST_WORDS:
            firsts.append(w)
            mass, n = 0.0, 0
        mass, n = mass + roots[w], n + 1
    return Layout(words, np.array(firsts, np.int64), SHAPES)


def count_words(docs: DataFrame) -> DataFrame:
    """word, count over all texts (null: empty); the word "" stands for the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=8 << 20):
                flat, _ = split_words(pc.ascii_lower(plain_texts(part.column("text"))))
                found = flat.value_counts()
                words = pa.concat_arrays([found.field(0).cast(pa.string()), pa.array([END])])
                counts = np.append(found.field(1).to_numpy(), part.num_rows)
                yield pa.RecordBatch.from_arrays([words, pa.array(counts)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Coder:
    """Code and smoothed log10 count of each token of a batch, for words of the head; others by shape alone."""

    def __init__(self, words: list[str], counts: np.ndarray, layout: Layout):
        self.words, self.layout = pa.array(words, pa.large_string()), layout
        shaped = layout.words + shapes(self.words)
        self.codes = np.append(np.where(np.arange(len(words)) < layout.words, np.arange(len(words)), shaped), 0)
        self.logs = np.append(np.log10(counts + 0.5), 0.0)
        at = words.index(END) if END in words else len(words)
        self.end = int(self.codes[at]) if at < len(words) else layout.words + 2
        self.end_log, self.end_seen = (float(self.logs[at]), True) if at < len(words) else (float(np.log10(0.5)), False)

    def code(self, texts: pa.Array):
        """codes with ends, bounds with ends; per distinct word: place in head (or -1); word codes; bounds without ends; words."""
        flat, bounds = split_words(pc.ascii_lower(texts))
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        each = np.where(place >= 0, self.codes[place], 0)
        rare = np.flatnonzero(place < 0)
        each[rare] = self.layout.words + shapes(words.take(pa.array(rare)))
        n = len(bounds) - 1
        out = np.empty(len(codes) + n, np.int64)
        ends = bounds[1:] + np.arange(n)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside], out[ends] = each[codes], self.end
        return out, np.append(0, ends + 1), place, codes, bounds, words


_CODERS: dict[str, Coder] = {}


def _coder(key: str, head) -> Coder:
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(*head.value)
    return _CODERS[key]


def unit_of(tokens: float) -> float:
    """Units of a weight such that its sum over all tokens fits a long."""
    return min(float(UNIT), 2.0**62 / (MOST_WEIGHT * max(1.0, tokens)))


def trained(texts: DataFrame, coder_of, layout: Layout, counts: np.ndarray, mass: np.ndarray) -> dict[str, np.ndarray]:
    """The network after one pass over texts (text). counts: of the learned words; mass: tokens of each other class. A round brings one row a weight to the driver."""
    weights = start(layout, HIDDEN, WIDTH)
    both = np.concatenate((mass, np.add.reduceat(counts, layout.firsts) if layout.words else [])) + 1.0
    weights["bo"] = np.log(both / both.sum()).astype(np.float32)
    weights["bw"] = np.log(counts + 1.0).astype(np.float32) - np.float32(np.log(counts.mean() + 1.0) if len(counts) else 0.0)
    unit = unit_of(float(mass.sum() + counts.sum()))
    for turn in range(ROUNDS):
        mine = texts.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(ROUNDS)) == turn)
        sent = texts.sparkSession.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            coder, learner = coder_of(), Learner(sent.value, layout)
            for batch in batches:
                for part in slices(batch, size=10 << 20):
                    found, bounds, *_ = coder.code(plain_texts(part.column("text")))
                    learner.learn(found, bounds)
            sums = np.append(np.rint(np.clip(flattened(learner.m), -MOST_WEIGHT, MOST_WEIGHT).astype(float) * learner.tokens * unit), learner.tokens).astype(np.int64)
            if learner.tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["place", "total"])

        rows = mine.select("text").mapInArrow(learn, "place long, total long").groupBy("place").agg(F.sum("total")).collect()
        sums = np.array([total for _, total in sorted(map(tuple, rows))], float)
        if len(sums):
            weights = unflattened(sums[:-1] / unit / sums[-1], weights)
        sent.destroy()
    return weights


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs (doc_id, text).

    Rows with crc32(doc_id as text) mod 5 = 1 are held out: nothing is learned from them. Null texts are empty and consist of
    their end alone; a null doc_id counts as an empty text in the split and stays null; repeated rows are scored each; with no training
    rows the network keeps its initial weights and every count is 0. Other columns are not read. No rows: none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id", 1).alias("held_out"))
    counts = scratch.keep(count_words(rows.where("not held_out")), "counts")
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = int(sizes[0]), int(sizes[1])
    # a bound below the HEAD-th count, from an approximate quantile with twice its error as a margin, so that what is sorted does not grow with partitions
    share = 1 - HEAD / max(1, distinct) - 2e-4
    least = counts.agg(F.percentile_approx("n", share, 10_000)).first()[0] if share > 0 else 0
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(HEAD).toPandas()
    words, heads = top["word"].tolist(), top["n"].to_numpy(np.int64)
    listed = spark.createDataFrame(top[["word"]]) if words else spark.createDataFrame([], "word string")
    rare = counts.join(F.broadcast(listed), "word", "left_anti")

    def by_shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kinds = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for batch in batches:
            found = shapes(batch.column("word").cast(pa.large_string()))
            mass += np.bincount(found, batch.column("n").to_numpy(), SHAPES).astype(np.int64)
            kinds += np.bincount(found, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(mass), pa.array(kinds)], names=["shape", "mass", "kinds"])

    tails = rare.select("word", "n").mapInArrow(by_shape, "shape long, mass long, kinds long").groupBy("shape").agg(F.sum("mass"), F.sum("kinds")).collect()
    mass, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in tails:
        mass[r[0]], kinds[r[0]] = r[1], r[2]
    layout = classes_of(heads)
    others = shapes(pa.array(words[layout.words :], pa.large_string()))
    mass += np.bincount(others, heads[layout.words :], SHAPES)
    kinds += np.bincount(others, minlength=SHAPES)
    below = np.log10(mass + 0.5 * (kinds + 1))
    head, key = spark.sparkContext.broadcast((words, heads, layout)), scratch.root
    network = trained(rows.where("not held_out"), lambda: _coder(key, head), layout, heads[: layout.words], mass)
    model = spark.sparkContext.broadcast(network)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, weights = _coder(key, head), model.value
        for batch in batches:
            for part in slices(batch, size=10 << 20):
                found, bounds, place, codes, plain, listing = coder.code(plain_texts(part.column("text")))
                n = part.num_rows
                doc = np.repeat(np.arange(n), np.diff(plain))
                at = place[codes]
                known, log = at >= 0, np.where(at >= 0, coder.logs[at], 0.0)
                inside = score(weights, layout, found, bounds) / np.log(10)
                owner, shaped = np.repeat(np.arange(n), np.diff(bounds)), found >= layout.words
                inside -= np.bincount(owner[shaped], below[found[shaped] - layout.words], n)
                inside += np.bincount(doc, np.where(at >= layout.words, log, 0.0), n)
                if coder.end >= layout.words:
                    inside += coder.end_log
                seen = np.bincount(doc, log, n) + coder.end_log
                rare = np.flatnonzero(~known)
                pairs, tf = np.unique(doc[rare] * np.int64(1 << 32) + codes[rare], return_counts=True)
                whose, which = pairs >> 32, pairs & 0xFFFFFFFF
                offsets = np.searchsorted(whose, np.arange(n + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([listing.take(pa.array(which)).cast(pa.string()), pa.array(tf.astype(np.int32))], names=["word", "tf"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(bounds)), pa.array(np.bincount(doc[known], minlength=n) + int(coder.end_seen)), pa.array(seen), pa.array(inside), tail],
                    names=["doc_id", "held_out", "n_tokens", "known", "seen", "inside", "tail"],
                )

    judged = rows.mapInArrow(judge, "doc_id long, held_out boolean, n_tokens long, known long, seen double, inside double, tail array<struct<word:string,tf:int>>")
    judged = scratch.keep(judged.withColumn("row", F.monotonically_increasing_id()), "judged")
    wanted = judged.select("row", F.explode("tail").alias("x")).select("row", "x.word", "x.tf")
    met = wanted.join(counts, "word", "left").select("row", "tf", (F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log"), F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0).alias("known"))
    tail_sums = met.groupBy("row").agg(F.sum("log").alias("tail_seen"), F.sum("known").alias("tail_known"))
    out = judged.drop("tail").join(tail_sums, "row", "left")
    seen = F.col("seen") + F.coalesce("tail_seen", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (seen - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))).alias("base_score"), (F.col("inside") + F.coalesce("tail_seen", F.lit(0.0))).alias("score"),
    )
