"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence is a logistic model over figures of its text. Around it stand two levels of place: host (or
source) and path. Grouped sums of soft labels give each host and each path of a host a posterior mean: a path is shrunk
towards its host, a host towards all documents, and the strengths of both shrinkages are estimated from
how much the groups' means vary beyond what their sizes explain. A document's posterior odds are its likelihood
ratio times the odds of its path, where its own contribution to the path and the host is taken out.

All grouping is by sums that are combined before the shuffle, so a host with a third of all rows is one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, few
from .words import plain_texts, slices, split_words

SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
RIDGE = 1e-3
STRENGTHS = (2.0, 10_000.0)  # the range of a shrinkage's prior rows
EVIDENCE = 12.0  # the most that a document's log odds can say
FIGURES = ("upper", "digits", "marks", "stops", "wide", "spaces", "word_length", "variety", "line_variety", "long_words", "short_lines", "size")

_KIND = np.zeros(256, np.uint8)  # classes of bytes
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()?"]] = 3
_KIND[[ord(c) for c in ".,;:?"]] = 4
_KIND[128:] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 6


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _variety(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes of each owner."""
    return np.bincount(np.unique(owner * np.int64(1 << 32) + codes) >> 32, minlength=n)


def figures(texts: pa.Array) -> np.ndarray:
    """One row of FIGURES for each text."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    size = np.diff(bounds)
    kinds = _KIND[data]
    counts = []
    for k in range(1, 7):
        running = np.concatenate(([0], np.cumsum(kinds == k)))
        counts.append(running[bounds[1:]] - running[bounds[:-1]])
    words, at = split_words(texts)
    own = np.repeat(np.arange(n), np.diff(at))
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    number = np.diff(at)
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    line_own = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    line_number = np.bincount(line_own, minlength=n)
    code = lambda x: x.dictionary_encode().indices.to_numpy().astype(np.int64)
    short = pc.binary_length(flat).to_numpy(zero_copy_only=False) < 20
    return np.stack(
        [
            *(_ratio(c, size) for c in counts),
            _ratio(np.bincount(own, lengths, n), number),
            _ratio(_variety(code(words), own, n), np.maximum(number, 1) ** 0.75),
            _ratio(_variety(code(flat), line_own, n), line_number),
            _ratio(np.bincount(own, lengths > 20, n), number),
            _ratio(np.bincount(line_own, short, n), line_number),
            np.log1p(number),
        ],
        1,
    )


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised figures within +-4, their squares, and a bias."""
    z = np.clip((x - mean) / scale, -4, 4)
    return np.concatenate((z, z * z, np.ones((len(z), 1))), 1)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a logistic model with a small ridge, by damped Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = expanded(x, mean, scale)
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a / len(a) + RIDGE * np.eye(len(w))
        move = np.linalg.solve(curve, a.T @ (p - y) / len(a) + RIDGE * w)
        w = w - move * min(1.0, 4.0 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return mean, scale, w


def _strength(total: str, n: str, mean: Column) -> Column:
    """Prior rows of a shrinkage, by moments over groups of two rows or more: how far their means vary beyond sampling."""
    some = F.col(n) >= 2
    spread = F.sum(F.when(some, F.col(n) * (F.col(total) / F.col(n) - mean) ** 2))
    count, rows, squares = F.sum(F.when(some, 1)), F.sum(F.when(some, F.col(n))), F.sum(F.when(some, F.col(n) * F.col(n)))
    noise = F.avg(F.when(some, mean * (1 - mean)))
    between = F.try_divide(spread - count * noise, rows - F.try_divide(squares, rows))
    low, high = STRENGTHS
    found = F.try_divide(noise, between) - 1
    return F.when((between > 0) & found.isNotNull(), F.least(F.greatest(found, F.lit(low)), F.lit(high))).otherwise(F.lit(high))


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, evidence (the text's own log odds of being good), host_mean, path_mean, score (posterior), kept (score >= threshold).

    docs: doc_id, text and whatever host and path are made of (by default the columns source and lang). One row for each
    row; a null host or path is a group of its own, null texts are empty, a null doc_id stays null and has no label;
    labels that are null are left out; a doc_id with several labels takes their mean. Without labels of
    both kinds the evidence is 0, every posterior is the prior and all is kept. Extra columns are not read. No rows: none.
    The fit sees ``sample_rows`` labelled rows at most, drawn by a digest of doc_id; all sums run over all rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = figures(plain_texts(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), lists], names=["doc_id", "host", "path", "figures"])

    measured = scratch.keep(rows.mapInArrow(measure, "doc_id long, host string, path string, figures array<double>").join(known, "doc_id", "left"), "measured")
    drawn = few(measured.where("label is not null"), sample_rows, F.xxhash64("doc_id", F.lit(5)), ["doc_id", "label"]).select("figures", "label").toPandas()
    y = (drawn["label"].to_numpy(float) >= 0.5).astype(float) if len(drawn) else np.zeros(0)
    fitted = 0 < y.sum() < len(y)
    base = float(y.mean()) if fitted else 1.0
    if fitted:
        mean, scale, w = fit(np.stack(drawn["figures"].to_numpy()), y)
        z = [F.least(F.greatest((F.col("figures")[i] - float(mean[i])) / float(scale[i]), F.lit(-4.0)), F.lit(4.0)) for i in range(len(FIGURES))]
        odds = sum((float(w[i]) * z[i] + float(w[len(FIGURES) + i]) * z[i] * z[i] for i in range(len(FIGURES))), F.lit(float(w[-1])))
        prior = float(np.log(base / (1 - base)))
    else:
        odds, prior = F.lit(0.0), 0.0
    evidence = F.least(F.greatest(odds, F.lit(-EVIDENCE)), F.lit(EVIDENCE))
    soft = F.coalesce("label", F.lit(1.0) / (1 + F.exp(-F.col("evidence")))) if fitted else F.coalesce("label", F.lit(1.0))
    judged = measured.withColumn("evidence", evidence).withColumn("soft", soft)

    paths = judged.groupBy("host", "path").agg(F.sum("soft").alias("path_sum"), F.count(F.lit(1)).alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    overall = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n")).first()
    m0 = (float(overall["s"] or 0) + 1) / (float(overall["n"] or 0) + 2)
    k_host = hosts.agg(_strength("host_sum", "host_n", F.lit(m0)).alias("k")).first()["k"]
    placed = scratch.keep(paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "path", "path_sum", "path_n", "host_sum", "host_n"), "places")
    shrunk_host = (F.col("host_sum") + k_host * m0) / (F.col("host_n") + k_host)
    k_path = placed.withColumn("host_mean", shrunk_host).agg(_strength("path_sum", "path_n", F.col("host_mean")).alias("k")).first()["k"]
    small = F.broadcast if placed.count() <= 20_000 else (lambda x: x)  # beyond that many places, a shuffled join
    out = judged.alias("d").join(small(placed.alias("p")), F.col("d.host").eqNullSafe(F.col("p.host")) & F.col("d.path").eqNullSafe(F.col("p.path")))
    host_mean = (F.col("host_sum") - F.col("soft") + k_host * m0) / (F.col("host_n") - 1 + k_host)
    path_mean = (F.col("path_sum") - F.col("soft") + k_path * F.col("host_mean")) / (F.col("path_n") - 1 + k_path)
    out = out.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    place_odds = F.ln(F.col("path_mean") / F.greatest(1 - F.col("path_mean"), F.lit(1e-9)))
    posterior = F.col("evidence") + place_odds - prior
    score = F.lit(1.0) / (1 + F.exp(-posterior)) if fitted else F.col("path_mean")
    out = out.withColumn("score", score)
    return out.select("doc_id", "evidence", "host_mean", "path_mean", "score", (F.col("score") >= threshold if fitted else F.lit(True)).alias("kept"))
