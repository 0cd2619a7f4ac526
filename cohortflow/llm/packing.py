"""Order-preserving packing of documents into token windows.

A dynamic programme over the possible cuts of a run of documents (document ends, sentence ends, and
every ``LOOSE`` tokens inside long stretches without either) minimises, over all windows of at
most ``window`` tokens, padding plus a penalty for each cut that truncates a document. With
``best[i] + position[i]`` in a queue kept monotone, the best start of a window that ends at j is
the queue's head, so each cut costs amortised constant time. Windows whose length is a power
of two are not padded, and are tried beside the queue.

A task keeps one block of documents at a time and carries the last, still open window into the
next block, so memory does not follow the partition and every partition pays for one last window only.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import encoder, plain_texts, slices

END_ID = 2
WINDOW = 4096
SENTENCE_PENALTY = 8  # of a cut, in tokens of padding
LOOSE_PENALTY = 48
LOOSE = 128
BLOCK = 1_500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def tail_lengths(length: int, window: int = WINDOW) -> list[int]:
    """How the last window is cut: whole, or into powers of two if that costs less."""
    bits = [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]
    return bits if (len(bits) - 1) * LOOSE_PENALTY < padding(length, window) else [length]


def best_cuts(positions: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices of the chosen cuts, ascending, from index 0 to the last. positions ascend strictly from
    0, neighbours at most ``window`` apart."""
    n = len(positions)
    at, penalty = positions.tolist(), penalties.tolist()
    exact: list[list[int] | None] = [None] * n
    size = 1
    while size < window:
        i = np.searchsorted(positions, positions - size)
        for j in np.flatnonzero(positions[np.minimum(i, n - 1)] == positions - size).tolist():
            if (own := exact[j]) is None:
                exact[j] = [int(i[j])]
            else:
                own.append(int(i[j]))
        size *= 2
    best, came = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque()
    key = 0
    for j in range(1, n):
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j - 1))
        here = at[j]
        low = here - window
        while at[queue[0][1]] < low:
            queue.popleft()
        cost, start = queue[0]
        cost += window - here
        if (own := exact[j]) is not None:
            for i in own:
                if best[i] < cost:
                    cost, start = best[i], i
        cost += penalty[j]
        best[j], came[j] = cost, start
        key = cost + here
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def with_loose(positions: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """More possible cuts, every LOOSE tokens (or as many as a small window allows), in stretches of over twice that, so that no stretch exceeds a window."""
    step = max(1, min(LOOSE, window // 2))
    gaps = np.diff(positions)
    wide = np.flatnonzero(gaps > min(2 * step, window))
    if not len(wide):
        return positions, penalties
    more = np.concatenate([np.arange(positions[i] + step, positions[i + 1] - step // 2, step) for i in wide])
    positions = np.concatenate((positions, more))
    order = np.argsort(positions, kind="stable")
    return positions[order], np.concatenate((penalties, np.full(len(more), LOOSE_PENALTY)))[order]


class Packer:
    """Packs documents given in order; each is (doc_id, ids with the end id, sentence cuts inside it)."""

    def __init__(self, sequences: int, window: int = WINDOW):
        self.window, self.sequence, self.waiting, self.tokens = window, sequences, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray, cuts: np.ndarray) -> list[tuple]:
        self.waiting.append((doc_id, 0, len(ids), ids, cuts))
        self.tokens += len(ids)
        return self._close(False) if self.tokens >= BLOCK else []

    def finish(self) -> list[tuple]:
        return self._close(True) if self.tokens else []

    def _close(self, last: bool) -> list[tuple]:
        ends = np.cumsum([len(x[3]) for x in self.waiting])
        inner = [x[4] + e - len(x[3]) for x, e in zip(self.waiting, ends.tolist())]
        sentences = np.concatenate(inner)
        sentences = np.setdiff1d(sentences, ends)
        positions = np.concatenate(([0], ends, sentences))
        order = np.argsort(positions, kind="stable")
        penalties = np.concatenate((np.zeros(len(ends) + 1, np.int64), np.full(len(sentences), SENTENCE_PENALTY)))[order]
        positions, penalties = with_loose(positions[order].astype(np.int64), penalties, self.window)
        windows = positions[best_cuts(positions, penalties, self.window)]
        if last:
            stop = windows[-1]
            windows = np.concatenate((windows[:-1], windows[-2] + np.cumsum(tail_lengths(int(stop - windows[-2]), self.window))))
        else:
            windows = windows[:-1]
        pieces, w, at, kept = [], 0, 0, []
        for doc_id, start, total, ids, cuts in self.waiting:
            done = 0
            while done < len(ids):
                if w + 1 >= len(windows):
                    kept.append((doc_id, start + done, total, ids[done:], cuts[cuts > done] - done))
                    break
                take = min(len(ids) - done, int(windows[w + 1]) - at)
                pieces.append((doc_id, start + done, take, zlib.crc32(ids[done : done + take].astype("<u4").tobytes()), total, self.sequence, at - int(windows[w])))
                done, at = done + take, at + take
                if at == windows[w + 1]:
                    w, self.sequence = w + 1, self.sequence + 1
        self.waiting, self.tokens = kept, sum(len(x[3]) for x in kept)
        return pieces


def pack(docs: DataFrame, tokenizer: str, order: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens; one row per piece (PIECES).

    Documents follow each other by ``order`` (columns of docs; by default doc_id), dealt to tasks in
    ranges of it. A null text is empty and gives its end id alone; a null doc_id sorts first and stays
    null; repeated rows are packed each; columns besides these are not read; no rows, no pieces.
    Sequence ids are the task's number times 2**40 plus a count, so they ascend with the order.
    """
    keys = order or ["doc_id"]
    extra = [c for c in keys if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId() << 40, window)
        end = np.array([END_ID], use.dtype)
        for batch in batches:
            for part in slices(batch):
                ids, bounds, after, closes = use.encode(plain_texts(part.column("text")))
                cuts = after[closes] if after is not None else np.empty(0, np.int64)
                among = np.searchsorted(cuts, bounds)
                pieces: list[tuple] = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = cuts[among[i] : among[i + 1]] - bounds[i]
                    pieces += packer.add(doc_id, np.concatenate((ids[bounds[i] : bounds[i + 1]], end)), own[own > 0])
                if pieces:
                    yield _batch(pieces)
        if pieces := packer.finish():
            yield _batch(pieces)

    ranges = [F.col(c).asc_nulls_first() for c in keys]
    if not order:
        ranges.append(F.xxhash64("text"))  # deals rows of one doc_id to several tasks
    return rows.repartitionByRange(*ranges).sortWithinPartitions(*ranges, *([] if "text" in keys else [F.col("text")])).select("doc_id", "text").mapInArrow(run, PIECES)


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names=names)
