"""Toxicity scores by a counterfactual-regularised classifier.

Features of a text are its distinct words and the beginnings of longer ones, and of a beginning also whether several distinct words have it; each
is a slot of a table of fixed size, by hash. Grouped counts over all labelled training rows choose the slots that tell most (by
their chi-square statistic); a logistic model over them is fitted on a bounded sample of labelled rows. Each sampled
sentence that names a group of people also stands with its identity terms swapped for every other member of their group in the same language,
and the model pays for every change of score between the two forms; so neutral mentions of
a group weigh nothing, and what else stands in the text decides. Adjectives that often mean something else ("black", "old") count as identity terms
before a word for people only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, few, held_out, semi
from .words import plain_texts, slices, split_words

SLOTS = 1 << 20  # of words and beginnings; as many again say that several words share a beginning
FEATURES = 8_192
SAMPLE_ROWS = 20_000
BEGINNINGS = (3, 4, 5, 6, 7)
LEAST_ROWS = 5
LEAST_CHI = 6.6
PENALTY = 10.0
RIDGE = 1e-4
STEPS = 800
# Identity terms, in groups of one language whose members are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslimisch", "christlich", "jüdisch"),
    ("muslime", "christen", "juden"),
    ("ausländer", "einwanderer", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs"),
    ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
# Identity terms before one of PEOPLE only.
BEFORE_PEOPLE = (("black", "white", "asian", "latino", "african", "european"), ("old", "young", "disabled", "blind", "deaf"), ("straight", "gay", "lesbian", "bisexual"))
PEOPLE = ("people", "person", "women", "men", "woman", "man", "girls", "boys", "folks", "community", "families")
PLACE = {term: (group, i) for group in IDENTITY for i, term in enumerate(group)}
PLACE_BEFORE = {term: (group, i) for group in BEFORE_PEOPLE for i, term in enumerate(group)}
TERM = re.compile(rf"(?<![^\W\d_])(?:({'|'.join(PLACE_BEFORE)})(?=\s+(?:{'|'.join(PEOPLE)})(?![^\W\d_]))|({'|'.join(PLACE)}))(?![^\W\d_])")
SENTENCE_END = re.compile(r"(?<=[.!?\n])\s+")
KEPT_WORDS = 100_000  # whose slots a Python worker remembers
SLICE = 3 << 20
_PLACE: dict[str, int] = {}
_SLOTS = np.empty((KEPT_WORDS, 1 + len(BEGINNINGS)), np.int32)


def slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % SLOTS


def _slots_of_words(words: list[str]) -> np.ndarray:
    """A row of slots for each word: its own, then those of its beginnings, -1 where it is too short."""
    at = np.fromiter((_PLACE.get(w, -1) for w in words), np.int64, len(words))
    out = _SLOTS[at]
    for i in np.flatnonzero(at < 0).tolist():
        word = words[i]
        out[i] = (slot(word), *(slot(word[:k] + "+") if len(word) > k else -1 for k in BEGINNINGS))
        if len(_PLACE) < KEPT_WORDS:
            _SLOTS[len(_PLACE)] = out[i]
            _PLACE[word] = len(_PLACE)
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of each feature of each text, ascending, each once."""
    words, bounds = split_words(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "))
    coded = words.dictionary_encode()
    table = _slots_of_words(coded.dictionary.to_pylist())
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
    met = np.unique(owner << 32 | coded.indices.to_numpy())
    slots = table[met & 0xFFFFFFFF]
    both = (((met >> 32)[:, None] * (2 * SLOTS)) + slots)[slots >= 0]
    found, counts = np.unique(both, return_counts=True)
    found = np.concatenate((found, found[counts > 1] + SLOTS))
    return found // (2 * SLOTS), found % (2 * SLOTS)


def swapped(sentence: str) -> list[str]:
    """The sentence, in lower case, with each identity term replaced by the next of its group, the one after that, and so on; empty without any."""
    low = sentence.lower()
    groups = [(PLACE_BEFORE if m[1] else PLACE)[m[0]][0] for m in TERM.finditer(low)]
    other = lambda m, k: (at := (PLACE_BEFORE if m[1] else PLACE)[m[0]])[0][(at[1] + k) % len(at[0])]
    return [TERM.sub(lambda m, k=k: other(m, k), low) for k in range(1, max(map(len, groups), default=1))]


def fit(rows: list[np.ndarray], labels: np.ndarray, changed: list[tuple[np.ndarray, np.ndarray]], times: np.ndarray, width: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over feature sets, by accelerated gradient steps.

    The loss is the mean log loss, plus ``penalty`` times the mean squared change of the linear score
    between a sentence and its counterfactual, plus a small ridge. changed: the features that a swap takes away, and those that it
    adds; times: how often that swap stands in the sample.
    """
    index = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.asarray(times, float) / max(1.0, float(np.sum(times)))
    gone = np.concatenate([*(np.concatenate(c) for c in changed), np.empty(0, np.int64)]).astype(np.int64)
    sign = np.concatenate([*(np.append(np.ones(len(a)), -np.ones(len(b))) for a, b in changed), np.empty(0)])
    pair = np.repeat(np.arange(len(changed)), [len(a) + len(b) for a, b in changed])
    n = max(1, len(rows))
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    ahead, ahead_b = w.copy(), b

    def curved(v: np.ndarray, v_b: float) -> tuple[np.ndarray, float]:
        """A bound of the loss's curvature, applied to a direction."""
        z = (np.bincount(owner, v[index], len(rows)) + v_b) / (4 * n)
        out = np.bincount(index, z[owner], width) + RIDGE * v
        if changed:
            moved = np.bincount(pair, sign * v[gone], len(changed))
            out += 2 * penalty * np.bincount(gone, sign * (share * moved)[pair], width)
        return out, float(z.sum())

    v, v_b, most = np.random.default_rng(0).standard_normal(width), 1.0, 1.0
    for _ in range(60):  # the largest curvature, so that steps cannot diverge
        v, v_b = curved(v, v_b)
        most = float(np.sqrt(v @ v + v_b * v_b)) + 1e-12
        v, v_b = v / most, v_b / most
    rate = 1 / (1.2 * most)
    for step in range(STEPS):
        z = np.bincount(owner, ahead[index], len(rows)) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / n
        gradient = np.bincount(index, error[owner], width) + RIDGE * ahead
        if changed:
            moved = np.bincount(pair, sign * ahead[gone], len(changed))
            gradient += 2 * penalty * np.bincount(gone, sign * (share * moved)[pair], width)
        new, new_b = ahead - rate * gradient, ahead_b - rate * error.sum()
        pull = step / (step + 3)
        ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return w, b


def _feature_counts(labelled: DataFrame) -> DataFrame:
    """slot, n (labelled rows with it), toxic (those that are). A task counts into tables of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2 * SLOTS), np.int64)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                doc, found = features(plain_texts(part.column("text")))
                counts[0] += np.bincount(found, minlength=2 * SLOTS)
                counts[1] += np.bincount(found[part.column("toxic").to_numpy()[doc] == 1], minlength=2 * SLOTS)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["slot", "n", "toxic"])

    return labelled.select("text", "toxic").mapInArrow(run, "slot long, n long, toxic long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _encoded(chosen: np.ndarray):
    """Of labelled rows: the places of their features among the chosen slots. Of their sentences with identity terms: what each swap takes away and adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(texts: pa.Array) -> list[np.ndarray]:
            doc, found = features(texts)
            at = np.searchsorted(chosen, found)
            keep = chosen[np.minimum(at, len(chosen) - 1)] == found
            doc, at = doc[keep], at[keep].astype(np.int32)
            order = np.lexsort((at, doc))
            return np.split(at[order], np.searchsorted(doc[order], np.arange(1, len(texts)))) if len(texts) else []

        empty = np.empty(0, np.int32)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                texts = plain_texts(part.column("text"))
                out = [(int(y), x.tobytes(), b"") for x, y in zip(places(texts), part.column("toxic").to_pylist())]
                before, after = [], []
                for text in texts.to_pylist():
                    if TERM.search(text.lower()):
                        for sentence in SENTENCE_END.split(text):
                            forms = swapped(sentence)
                            before += [sentence] * len(forms)
                            after += forms
                pairs = zip(places(pa.array(before, pa.large_string())), places(pa.array(after, pa.large_string())))
                out += [(None, np.setdiff1d(a, b).astype(empty.dtype).tobytes(), np.setdiff1d(b, a).astype(empty.dtype).tobytes()) for a, b in pairs]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["toxic", "first", "second"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, width: int = FEATURES, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs (doc_id, text).

    Labels of rows with crc32(doc_id as text) mod 5 = 0 are never read. Only texts are inputs of a score; null texts are empty and get
    the score of a text without any feature. Labels that are null are left out; a doc_id labelled twice trains twice; repeated
    rows are scored each; a null doc_id counts as an empty text in the split and stays null. Without training labels each score is
    0.5. Other columns are not read. The fit sees ``sample_rows`` rows at most, drawn by a digest of doc_id; the
    choice of features counts all labelled training rows, and takes the ``width`` slots that tell most of those with LEAST_ROWS
    rows and a chi-square statistic above LEAST_CHI (1 % by chance); what is rarer says nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    known = scratch.keep(known, "known")
    labelled = semi(rows, known, "doc_id", join="inner")
    counts = scratch.keep(_feature_counts(labelled.select(F.concat(F.lit("row "), F.coalesce("text", F.lit(""))).alias("text"), "toxic")), "counts")
    whole = counts.where(F.col("slot") == slot("row")).first()  # every row has this word added
    n, bad = (int(whole["n"]), int(whole["toxic"])) if whole else (0, 0)
    if not n:
        scored = rows.select("doc_id", F.lit(0.5).alias("score"))
        return scored.select("doc_id", held_out().alias("held_out"), "score", F.lit(1).alias("predicted"))
    a, b, c, d = F.col("toxic"), F.col("n") - F.col("toxic"), F.lit(bad) - F.col("toxic"), F.lit(n - bad) - F.col("n") + F.col("toxic")
    cross = (a * d - b * c).cast("double")
    chi = F.try_divide(F.lit(float(n)) * cross * cross, (a + b).cast("double") * (c + d) * (a + c) * (b + d))
    telling = counts.where(F.col("n") >= LEAST_ROWS).select("slot", chi.alias("chi")).where(F.col("chi") > LEAST_CHI).orderBy(F.desc("chi"), "slot").limit(width)
    chosen = np.array(sorted({r[0] for r in telling.collect()} | {slot(t) for t in (*PLACE, *PLACE_BEFORE)}), np.int64)

    drawn = few(known, sample_rows, F.xxhash64("doc_id", F.lit(3)), ["doc_id", "toxic"])
    sample = semi(rows, scratch.keep(drawn, "drawn"), "doc_id", join="inner").select("text", "toxic").mapInArrow(_encoded(chosen), "toxic int, first binary, second binary")
    sample = sample.groupBy("toxic", "first", "second").count().toPandas()
    lists = lambda column: [np.frombuffer(x, np.int32).astype(np.int64) for x in column]
    own, swaps = sample[sample["toxic"].notna()], sample[sample["toxic"].isna()]
    own = own.loc[own.index.repeat(own["count"])].sort_values(["first", "toxic"])
    swaps = swaps.sort_values(["first", "second"])
    at = lambda term: np.searchsorted(chosen, slot(term))[None]
    # every listed term is also swapped alone with the next of its group, so that none differs from it for want of examples
    alone = [(at(t), at(group[(i + 1) % len(group)])) for t, (group, i) in (*PLACE.items(), *PLACE_BEFORE.items())]
    changed = [*zip(lists(swaps["first"]), lists(swaps["second"])), *alone]
    times = np.concatenate((swaps["count"].to_numpy(float), np.ones(len(alone))))
    weights, bias = fit(lists(own["first"]), own["toxic"].to_numpy(float), changed, times, len(chosen), penalty)
    model = spark.sparkContext.broadcast((chosen, weights, bias))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values, base = model.value
        weight = np.zeros(2 * SLOTS)
        weight[slots] = values
        for batch in batches:
            for part in slices(batch, size=SLICE):
                doc, found = features(plain_texts(part.column("text")))
                z = base + np.bincount(doc, weight[found], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "score"])

    scored = rows.mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
