"""Token-ID output as length-delimited binary records with a separate offset index.

A data file is a run of frames::

    u64 payload length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

all little-endian, where a masked checksum is the crc32 rotated right by 15 bits plus a
constant, so that checksums of data holding checksums stay meaningful. A payload is
``i64 doc_id | u8 flags (1: doc_id is null) | u8 bytes per id | u32 number of ids | ids``.

The index file beside it has one fixed-size entry per record (offset and length of the
frame, ids of all records before it in this file, number of ids, doc_id, flags), so any record
can be fetched in any order without touching the others.

Each task writes its own files under a name that holds the task attempt, and a manifest row
names the files of the attempt that succeeded; files of lost attempts are never read. The files are
written through ``pyarrow.fs``, so the folder can be any store that it knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import shared_dir
from .words import encoder, plain_texts, slices

END_ID = 2
MASK_DELTA = 0xA282EAD8
PART_BYTES = 32 << 20
HEAD, PAYLOAD_HEAD = struct.Struct("<QI"), struct.Struct("<qBBI")
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u4"), ("before", "<u8"), ("n_tokens", "<u4"), ("doc_id", "<i8"), ("flags", "u1")])
MANIFEST = "shard int, file string, first_doc long, n_records long, n_tokens long, n_bytes long"
FOUND = "doc_id long, before long, n_tokens long, ids_crc32 long, shard int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = PAYLOAD_HEAD.pack(doc_id or 0, doc_id is None, ids.dtype.itemsize, len(ids)) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview) -> tuple[int | None, np.ndarray]:
    """The record in exactly these bytes; ValueError if any length or checksum is wrong."""
    n, crc = HEAD.unpack_from(data)
    payload = bytes(data[HEAD.size : HEAD.size + n])
    if masked(bytes(data[:8])) != crc or len(data) != HEAD.size + n + 4 or masked(payload) != struct.unpack_from("<I", data, HEAD.size + n)[0]:
        raise ValueError("a record's length or checksum is wrong")
    doc_id, flags, width, count = PAYLOAD_HEAD.unpack_from(payload)
    if PAYLOAD_HEAD.size + width * count != n:
        raise ValueError("a record's number of ids is wrong")
    return (None if flags & 1 else doc_id), np.frombuffer(payload, f"<u{width}", count, PAYLOAD_HEAD.size)


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store, at


def write_records(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Encode every text of docs (doc_id, text) and write the records in ascending order of doc_id.

    Returns the manifest (one row for each file; it is small and already on disk). Null texts are
    empty and give a record that holds the end id alone; a null doc_id sorts first; rows of the same
    doc_id each give a record, ordered by a digest of the text. Other columns are not read. No rows: an empty manifest.
    Rows are dealt by ranges of doc_id, so files follow each other in that order whatever the skew of
    other columns; a task holds one slice of its rows at a time.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, name = task.partitionId(), f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        use = encoder(tokenizer)
        end = np.array([END_ID], use.dtype)
        offset = before = records = 0
        first = None
        with store.open_output_stream(f"{at}/{name}.rec") as data, store.open_output_stream(f"{at}/{name}.idx") as index:
            for batch in batches:
                for part in slices(batch):
                    ids, bounds, *_ = use.encode(plain_texts(part.column("text")))
                    frames, entries = [], np.zeros(part.num_rows, ENTRY)
                    for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                        own = np.concatenate((ids[bounds[i] : bounds[i + 1]], end))
                        frames.append(frame(doc_id, own))
                        entries[i] = (offset, len(frames[-1]), before, len(own), doc_id or 0, doc_id is None)
                        offset, before = offset + len(frames[-1]), before + len(own)
                        first = doc_id if records == 0 and i == 0 else first
                    records += part.num_rows
                    data.write(b"".join(frames))
                    index.write(entries.tobytes())
        if records:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "first_doc": [first], "n_records": [records], "n_tokens": [before], "n_bytes": [offset]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string())] + [(c, pa.int64()) for c in ("first_doc", "n_records", "n_tokens", "n_bytes")]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the digest deals rows of one doc_id to several tasks
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_index(manifest: DataFrame, folder: str, block: int = 1024) -> DataFrame:
    """One row per record: shard, file, offset, length, before, n_tokens, doc_id; read it in any order,
    or shuffle it and give it to read_records for a shuffled pass over the data. Its partitions follow the bytes of data, PART_BYTES each."""
    size = manifest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    blocks = manifest.withColumn("at", F.explode(F.expr(f"sequence(0L, n_records - 1, {block}L)"))).select("shard", "file", "at", F.least(F.lit(block), F.col("n_records") - F.col("at")).alias("n"))
    blocks = blocks.repartition(max(1, -(-int(size) // PART_BYTES)), "shard", "at")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, at = _open(folder)
                with store.open_input_file(f"{at}/{row['file']}.idx") as index:
                    got = np.frombuffer(index.read_at(int(row["n"]) * ENTRY.itemsize, int(row["at"]) * ENTRY.itemsize), ENTRY)
                doc = pa.array(got["doc_id"], mask=(got["flags"] & 1).astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(got), pa.int32()), pa.array([row["file"]] * len(got)), *(pa.array(got[c].astype(np.int64)) for c in ("offset", "length", "before", "n_tokens")), doc], names=["shard", "file", "offset", "length", "before", "n_tokens", "doc_id"])

    return blocks.mapInArrow(entries, "shard int, file string, offset long, length long, before long, n_tokens long, doc_id long")


def read_records(entries: DataFrame, folder: str, run: int = 8 << 20) -> DataFrame:
    """The records of index rows: doc_id, before, n_tokens, ids_crc32, shard, all of them from the record itself
    except for before and shard. Neighbouring rows of one file are fetched by one read of up to ``run`` bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _open(folder)
        for batch in batches:
            rows, out, i = batch.to_pylist(), [], 0
            while i < len(rows):
                j, first = i + 1, rows[i]
                stop = first["offset"] + first["length"]
                while j < len(rows) and rows[j]["file"] == first["file"] and rows[j]["offset"] == stop and stop - first["offset"] < run:
                    stop += rows[j]["length"]
                    j += 1
                with store.open_input_file(f"{at}/{first['file']}.rec") as data:
                    got = memoryview(data.read_at(stop - first["offset"], first["offset"]))
                for r in rows[i:j]:
                    doc_id, ids = unframe(got[r["offset"] - first["offset"] :][: r["length"]])
                    out.append((doc_id, r["before"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), r["shard"]))
                i = j
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "before", "n_tokens", "ids_crc32", "shard"])

    return entries.select("shard", "file", "offset", "length", "before").mapInArrow(read, FOUND)


def token_records(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as records, then read all of them back: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before: the file's first id from a running sum over the
    manifest (one row per file), plus the record's own place in its file from the index.
    """
    folder = shared_dir(docs.sparkSession, "records")
    manifest = write_records(docs, folder, tokenizer)
    base = manifest.select("shard", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)).alias("base"))
    found = read_records(read_index(manifest, folder), folder)
    return found.join(base, "shard").select("doc_id", (F.coalesce("base", F.lit(0)) + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
