"""Secret scans with structural confirmation.

Base patterns (assignments, access keys, hex runs) are reported as they match. Further candidates are
decoded, and reported only if their inside proves what they are:

* ``pem``: a private-key block whose base64 body decodes to a key structure,
* ``der``: base64 or hex that decodes to a private key in DER, every nested length filling
  its parent exactly, in one of the shapes PKCS#8, PKCS#1 or SEC 1,
* ``openssh``: base64 that decodes to the OpenSSH key container with fitting length fields,
* ``jwt``: a signed token whose header and claims decode to JSON objects, the header naming its algorithm.

A key outside of a ``pem`` span may be wrapped over lines: its own length fields say how many characters belong to it,
and these must end where a run ends. Whole texts are scanned. Cheap linear patterns first find the texts in which a kind can occur at all.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import plain_texts, slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "jwt")
SPANS = "array<struct<kind:string,start:long,end:long>>"

# Only A-Z and a-z count as the other case of a letter here.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# How a key begins: 0x30, its length, then 0x02 or 0x30; or the OpenSSH magic. Nothing is asked of a longer length's bytes.
KEY64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=\\r))(?:M[A-H][AEIMQUYcgkosw048][Cw]|MI[E-T][A-Za-z0-9+/_-]|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{4}")
KEY16 = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?(30[0-9A-Fa-f]{6})")
RUN64, RUN16, GAP = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+"), re.compile(r"(?:\s|\\[nr])+")
END64, END16 = re.compile(r"={0,2}(?![A-Za-z0-9+/_=-])"), re.compile(r"(?![0-9A-Za-z])")
LEAST64, LEAST16 = 40, 64
PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:[^\S\n]*\S*")
PEM_EDGE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]*")

# Whatever a kind's pattern matches, this matches too.
MAY_HAVE = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]",
    "access": "AKIA[A-Z0-9]{14}",
    "hex": "[0-9a-f]{16}",
    "pem": "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    "run": "M[A-H][AEIMQUYcgkosw048][Cw][A-Za-z0-9+/_-]{4}|MI[E-T][A-Za-z0-9+/_-]{5}|b3BlbnNzaC1rZXkt|30[0-9A-Fa-f]{6}",
    "jwt": r"ey[A-Za-z0-9_-]{6}[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{2}[A-Za-z0-9_-]*\.",
}
OPENSSH_MAGIC = b"openssh-key-v1\x00"


def decode64(text: str) -> bytes | None:
    body = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of each value in data[start:end]; None unless lengths fill it exactly."""
    found, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n = int.from_bytes(data[at : at + width], "big")
            if n < 0x80 or n >> 8 * (width - 1) == 0:
                return None
            at += width
        if at + n > end:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


def is_key_der(data: bytes) -> bool:
    """Whether data is one DER private key: PKCS#8, PKCS#1 or SEC 1, or an encrypted PKCS#8 container."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    items = der_items(data, *outer[0][1:])
    if not items or len(items) < 2:
        return False
    tags = [t for t, *_ in items]
    if tags[:2] == [0x30, 0x04]:
        inner = der_items(data, *items[0][1:])
        return len(items) == 2 and bool(inner) and inner[0][0] == 0x06
    if tags[0] != 0x02 or data[items[0][1] : items[0][2]] not in (b"\x00", b"\x01"):
        return False
    if tags[1] == 0x30 and len(items) >= 3 and tags[2] == 0x04:
        inner = der_items(data, *items[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    if tags == [0x02] * 9:
        return items[1][2] - items[1][1] >= 32
    return tags[1] == 0x04 and items[1][2] - items[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])


def der_length(head: bytes) -> int | None:
    """Length in bytes, header included, of the DER value that begins with head (6 bytes at least)."""
    n = head[1]
    if not n & 0x80:
        return n + 2
    width = n & 0x7F
    return 2 + width + int.from_bytes(head[2 : 2 + width], "big") if 1 <= width <= 4 else None


def is_key_openssh(data: bytes) -> bool:
    """Whether data is the OpenSSH container: magic, three strings, a key count, and as many public keys."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at = len(OPENSSH_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return keys >= 1 and at == len(data)


def taken(text: str, at: int, n: int, run: re.Pattern) -> tuple[str, int] | None:
    """The first n characters of the runs from ``at`` on, white space between them left out, and the end of the last."""
    parts = []
    while m := run.match(text, at):
        if m.end() - at >= n:
            return "".join([*parts, text[at : at + n]]), at + n
        parts.append(m[0])
        n -= m.end() - at
        if not (gap := GAP.match(text, m.end())):
            return None
        at = gap.end()
    return None


def begun(text: str, at: int, n: int, run: re.Pattern) -> str:
    """The first n characters, or all, of the runs from ``at`` on, white space between them left out."""
    parts = []
    while n > 0 and (m := run.match(text, at)):
        parts.append(text[at : min(m.end(), at + n)])
        n -= len(parts[-1])
        if n <= 0 or not (gap := GAP.match(text, m.end())):
            break
        at = gap.end()
    return "".join(parts)


def key64(text: str, at: int) -> tuple[str, int] | None:
    """Kind and end of the key that begins at ``at`` in base64."""

    known, whole = b"", False  # the bytes decoded so far, and whether the text holds no more

    def number(i: int, size: int = 4) -> int | None:
        """The bytes from i on as a number; decodes twice as much whenever more is asked for, so a key costs time in proportion to its length."""
        nonlocal known, whole
        while len(known) < i + size and not whole:
            asked = max(i + size, 2 * len(known), 96) // 3 * 3 + 3
            found = begun(text, at, asked // 3 * 4, RUN64)
            known, whole = decode64(found[: len(found) // 4 * 4]) or b"", len(found) < asked // 3 * 4
        if len(known) >= i + size:
            return int.from_bytes(known[i : i + size], "big")
        tail = decode64(begun(text, at, -(-(i + size) * 4 // 3), RUN64)) or b""  # the last three characters or fewer
        return int.from_bytes(tail[i : i + size], "big") if len(tail) >= i + size else None

    if text.startswith("M", at):
        n = None if number(0, 6) is None else der_length(known)
        if not n:
            return None
    else:
        n, left, counted = len(OPENSSH_MAGIC), 3, False  # three strings and a count, then a string for each key and one for all private ones
        while left or not counted:
            if (length := number(n)) is None:
                return None
            if left:
                n, left = n + 4 + length, left - 1
            elif not length:
                return None
            else:
                n, left, counted = n + 4, length + 1, True
    found = taken(text, at, -(-n * 4 // 3), RUN64)
    if not found or len(found[0]) < LEAST64 or not (end := END64.match(text, found[1])):
        return None
    data = decode64(found[0])
    kind = data and ("der" if is_key_der(data) else "openssh" if is_key_openssh(data) else None)
    return (kind, end.end()) if kind else None


def key16(text: str, at: int) -> int | None:
    """End of the DER key that begins at ``at`` in hexadecimal."""
    head = taken(text, at, 12, RUN16)
    n = head and der_length(bytes.fromhex(head[0]))
    found = taken(text, at, 2 * n, RUN16) if n and 2 * n >= LEAST16 else None
    return found[1] if found and END16.match(text, found[1]) and is_key_der(bytes.fromhex(found[0])) else None


def is_pem_body(body: str) -> bool:
    """Whether the text between the edges of a block holds a key; headers go with their lines, or with one word if lines are joined by spaces."""
    body = body.replace("\\r", "\n").replace("\\n", "\n")
    for bare in ("\n".join(x for x in body.split("\n") if ":" not in x), PEM_HEADER.sub(" ", body)):
        data = decode64("".join(bare.split()))
        if data and (is_key_der(data) or is_key_openssh(data) or "ENCRYPTED" in body):
            return True
    return False


def is_jwt(header: str, claims: str) -> bool:
    try:
        head, body = (json.loads(decode64(x) or b"") for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str, kinds: frozenset[str] | set[str] = frozenset(BASE_KINDS)) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the base patterns, leftmost non-overlapping for each kind."""
    found = []
    if "assign" in kinds:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "access" in kinds:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if "hex" in kinds:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return found


def confirmed_spans(text: str, kinds: set[str]) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of candidates whose decoded structure confirms them."""
    found = []
    if "pem" in kinds:
        begun = None
        for m in PEM_EDGE.finditer(text):
            if m[1] == "BEGIN":
                begun = m
            elif begun is not None and begun[2] == m[2]:
                if is_pem_body(text[begun.end() : m.start()]):
                    found.append((begun.start(), KINDS.index("pem"), m.end()))
                begun = None
    if "run" in kinds:
        blocks = sorted((s, e) for s, _, e in found)
        runs, block, stop = [], 0, 0
        for m in KEY16.finditer(text):
            if m.start(1) >= stop and (end := key16(text, m.start(1))):
                runs.append((m.start(1), "der", stop := end))
        stop = 0
        for m in KEY64.finditer(text):
            if m.start() >= stop and (key := key64(text, m.start())):
                runs.append((m.start(), key[0], stop := key[1]))
        for start, kind, end in sorted(runs):
            while block < len(blocks) and blocks[block][1] <= start:
                block += 1
            if block == len(blocks) or start < blocks[block][0]:
                found.append((start, KINDS.index(kind), end))
    if "jwt" in kinds:
        found += [(m.start(), KINDS.index("jwt"), m.end()) for m in JWT.finditer(text) if is_jwt(m[1], m[2])]
    return found


def all_spans(text: str, kinds: set[str] = frozenset(MAY_HAVE)) -> list[tuple[int, int, int]]:
    return sorted(base_spans(text, kinds) + confirmed_spans(text, kinds))


def _spans_of(texts: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """Row, text and spans of each text that has any."""
    may = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in MAY_HAVE.items()}
    some = sum(m.astype(int) for m in may.values())
    for i in some.nonzero()[0].tolist():
        text = texts[i].as_py()
        if found := all_spans(text, {k for k, m in may.items() if m[i]}):
            yield i, text, found


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, spans), one row for each row of docs.

    Spans are in code points, end exclusive, by start, then by kind in the order of KINDS. Null and empty
    texts have none; null ids stay null; repeated rows are each reported; other columns are not read.
    One narrow pass: no shuffle, one slice of a batch in memory.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for i, _, found in _spans_of(plain_texts(part.column("text"))):
                    spans[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every reported span replaced by ``[kind]``; overlapping spans become one, named by the first.

    All columns and rows stay; n_chars, where there is such a column, counts the new text. Null texts stay null.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                column = part.column("text")
                changed = {}
                for i, text, found in _spans_of(plain_texts(column)):
                    out, at, stop = [], 0, -1
                    for s, k, e in found:
                        if s >= stop:
                            out += [text[at:s], f"[{KINDS[k]}]"]
                        at = stop = max(stop, e)
                    changed[i] = "".join(out) + text[at:]
                if changed:
                    texts = column.to_pylist()
                    for i, text in changed.items():
                        texts[i] = text
                    part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(texts, column.type))
                    if (at := part.schema.get_field_index("n_chars")) >= 0:
                        counts = part.column(at).to_pylist()
                        for i, text in changed.items():
                            counts[i] = len(text)
                        part = part.set_column(at, part.schema.field(at), pa.array(counts, part.column(at).type))
                yield part

    return docs.mapInArrow(run, schema)


def _is(kind: str):
    return lambda span: span["kind"] == kind


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets' rows."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *counts[3:])
