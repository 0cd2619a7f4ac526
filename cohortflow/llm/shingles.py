"""Word shingles of whole texts as 64-bit hashes, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .words import plain_texts, slices, split_words

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text (A-Z in lower case), and each text's bounds among them."""
    flat, bounds = split_words(pc.ascii_lower(texts))
    coded = flat.dictionary_encode()
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return of[coded.indices.to_numpy()], bounds


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its set of shingles of ``words`` words, ascending; a shorter text is one shingle, none without words."""
    hashes, bounds = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        rolled = mix64(rolled + hashes[j : n - words + 1 + j] + np.uint64(2 * j + 1)) if len(rolled) else rolled
    for i in range(len(bounds) - 1):
        start, end = int(bounds[i]), int(bounds[i + 1])
        if end - start >= words:
            yield np.unique(rolled[start : end - words + 1])
        elif end > start:
            one = mix64(np.full(1, end - start, np.uint64))
            for h in hashes[start:end]:
                one = mix64(one + h)
            yield one
        else:
            yield hashes[:0]


def sets_of(batches: Iterator[pa.RecordBatch], words: int, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows with their texts' shingle sets; memory follows ``size`` and the longest text."""
    for batch in batches:
        for part in slices(batch, size=size):
            yield part, list(shingle_sets(plain_texts(part.column("text")), words))
