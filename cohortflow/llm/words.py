"""Vectorised word and token helpers used inside Arrow batches.

Texts arrive as Arrow string arrays, nulls count as empty texts, and whole texts are
processed. Everything here works on one slice of a batch at a time, so memory follows
``SLICE_BYTES`` and the longest single text, not the partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

SLICE_BYTES = 4 << 20


def plain_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.offset:  # some of Arrow's string functions misread a cast array that starts within its buffers
        column = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text each, at least one row."""
    n = batch.num_rows
    if n == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space (0x09-0x0D, 0x20), and each text's bounds among them."""
    listed = pc.ascii_split_whitespace(texts)
    flat, bounds = listed.flatten(), listed.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    real = pc.not_equal(pc.binary_length(flat), 0)
    keep = real.to_numpy(zero_copy_only=False)
    if not keep.all():
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        flat = flat.filter(real)
    return flat, bounds


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: starts[0], starts[0]+1, ..., then the next run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class WordEncoder:
    """Token ids of whole texts by a ``tokenizers`` file, in Arrow batches.

    If the tokenizer never joins text across white space (``by_words``), each distinct word of
    a slice is encoded once and the ids are gathered, which gives the same ids as encoding
    the text; other tokenizers encode the texts as they are. The word cache is bounded.

    Words of Latin letters alone take a shorter way through the same model if its tokens mark
    word ends: they are put in lower case here, so normaliser and splitting pattern have nothing
    to do, and a full stop or comma after them is looked up by itself.
    """

    PROBES = ("Ab cd", "x1 .y", "é ù", "a\n\nb", "a\t b", "it 's", "A ́b", "1 2.5 ,", "don't  GO\r\nß x")
    SHORT_PROBES = ("The", "Àuxquelles", "straße", "internationalization", "a", "ÿØþ", "zzzzxqj")
    SEPARATOR = "\x01"
    LETTERS = "^[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+$"

    def __init__(self, path: str, cache_words: int = 150_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        one = self._whole([self.SEPARATOR])[0]
        self.separator_id = int(one[0]) if len(one) == 1 else None
        joined = [np.concatenate(self._whole(p.split())).tolist() for p in self.PROBES]
        self.by_words = self.separator_id is not None and joined == [x.tolist() for x in self._whole(list(self.PROBES))]
        self.short = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.by_words and suffix:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.final = np.zeros(max(vocabulary.values()) + 1, bool)
            self.final[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.short = Tokenizer.from_file(path)
            self.short.normalizer = normalizers.Sequence([])
            self.short.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            stopped = [[w, w + ".", w + ",", w + ".,"] for w in self.SHORT_PROBES]
            marks = {m: self._whole([m])[0].tobytes() for m in (".", ",", ".,")}
            same = all(
                [x.tobytes() for x in self._whole(forms)] == [core := self._short_words([forms[0].lower()])[0], *(core + marks[m] for m in (".", ",", ".,"))]
                for forms in stopped
            )
            if not same:
                self.short = None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, ids: np.ndarray, ends: np.ndarray, skip: int) -> list[bytes]:
        """The bytes of each run of ids that stops at one of ``ends``; ``skip`` ids stand between runs."""
        data, width, found, at = ids.tobytes(), self.width, [], 0
        for end in (ends * width).tolist():
            found.append(data[at:end])
            at = end + skip * width
        return found

    def _short_words(self, words: list[str], run: int = 256) -> list[bytes]:
        """Ids of lower-case words of letters, each of which ends at its one token with the word-end mark."""
        found: list[bytes] = []
        for e in self.short.encode_batch_fast([" ".join(words[i : i + run]) for i in range(0, len(words), run)], add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            found += self._cut(ids, np.flatnonzero(self.final[ids]) + 1, 0)
        return found

    def _any_words(self, words: list[str], run: int = 256) -> list[bytes]:
        """Ids of any words, sent in runs with a separator between them."""
        plain = [w for w in words if self.SEPARATOR not in w]
        sep, found = f" {self.SEPARATOR} ", []
        for e in self.tokenizer.encode_batch_fast([sep.join(plain[i : i + run]) for i in range(0, len(plain), run)], add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            found += self._cut(ids, np.append(np.flatnonzero(ids == self.separator_id), len(ids)), 1)
        if len(plain) == len(words):
            return found
        given = iter(found)
        return [self._whole([w])[0].tobytes() if self.SEPARATOR in w else next(given) for w in words]

    def _lookup(self, words: list[str], encode) -> list[bytes]:
        cache = self.cache
        parts = [cache.get(w) for w in words]
        missing = [i for i, p in enumerate(parts) if p is None]
        if missing:
            fresh = [words[i] for i in missing]
            got = encode(fresh)
            for i, p in zip(missing, got, strict=True):
                parts[i] = p
            room = self.cache_words - len(cache)
            if room > 0:
                cache.update(zip(fresh[:room], got[:room]))
        return parts

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has."""
        if self.short is None:
            parts = self._lookup(_listed(words), self._any_words)
            return np.frombuffer(b"".join(parts), self.dtype), np.fromiter(map(len, parts), np.int64, len(parts)) // self.width
        cores = pc.ascii_rtrim(words, ".,")
        latin = pc.match_substring_regex(cores, self.LETTERS).to_numpy(zero_copy_only=False)
        cores = pc.if_else(pa.array(latin), cores, words)
        marks = pc.binary_length(words).to_numpy() - pc.binary_length(cores).to_numpy()
        parts: list[bytes] = [b""] * len(words)
        where = np.flatnonzero(latin)
        coded = pc.utf8_lower(cores.take(pa.array(where))).dictionary_encode()
        own = self._lookup(_listed(coded.dictionary), self._short_words)
        for i, code in zip(where.tolist(), coded.indices.to_numpy().tolist()):
            parts[i] = own[code]
        stopped = np.flatnonzero(marks)
        if len(stopped):
            ids_of = {}
            for i, word, n in zip(stopped.tolist(), _listed(words.take(pa.array(stopped))), marks[stopped].tolist()):
                tail = word[-n:]
                if tail not in ids_of:
                    ids_of[tail] = self._any_words([tail])[0]
                parts[i] += ids_of[tail]
        other = np.flatnonzero(~latin)
        if len(other):
            for i, p in zip(other.tolist(), self._lookup(_listed(words.take(pa.array(other))), self._any_words)):
                parts[i] = p
        return np.frombuffer(b"".join(parts), self.dtype), np.fromiter(map(len, parts), np.int64, len(parts)) // self.width

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Ids of all texts in a row, each text's bounds among them, the position after each
        word's ids, and whether that word ends a sentence (both None if not ``by_words``)."""
        if not self.by_words:
            each = self._whole(texts.to_pylist())
            lengths = np.array([len(x) for x in each], np.int64)
            return (np.concatenate(each) if each else np.empty(0, self.dtype)), np.concatenate(([0], np.cumsum(lengths))), None, None
        flat, bounds = split_words(texts)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        pool, lengths = self.word_ids(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        each = lengths[codes]
        ids = pool[expand(starts[codes], each)]
        after = np.cumsum(each)
        closes = pc.match_substring_regex(coded.dictionary, "[.!?…。]$").to_numpy(zero_copy_only=False)
        return ids, np.concatenate(([0], after))[bounds], after, closes[codes]


def _listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache_words: int = 150_000) -> WordEncoder:
    """One encoder for each Python worker and file."""
    key = (path, cache_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, cache_words)
    return _ENCODERS[key]
