"""Secret scanning with structural confirmation.

Three base kinds are found by pattern alone. The others are candidates that are
reported only if their structure holds: a signed token's first two segments must
decode to JSON objects and its header must name an algorithm; a key block must
decode to a key encoding whose tags and nested lengths fit to the last byte; the
same is asked of bare base64 or hex runs.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices

#: Kinds in the order that breaks ties of position.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der")
BASE_KINDS = KINDS[:3]

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A segment starts with a brace, alone or after blanks, in base64; decoding decides.
_OBJECT = r"(?:e[w-z0-3]|C[QSXgin]|D[QSX]|I[ACH])[A-Za-z0-9_-]+"
_JWT = re.compile(rf"(?<![A-Za-z0-9_.-])({_OBJECT})\.({_OBJECT})\.([A-Za-z0-9_-]*)")
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\+[nr])*")
_ESCAPE = re.compile(r"\\+[nr]")
_LOCK = re.compile(r"^DEK-Info: *([A-Z0-9-]+), *([0-9A-Fa-f]+) *$", re.M)
#: Ciphers of locked keys and the bytes of their blocks, which are those of their start vectors.
_CIPHERS = {
    "DES-CBC": 8, "DES-EDE3-CBC": 8, "RC2-CBC": 8, "IDEA-CBC": 8, "BF-CBC": 8,
    "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16, "CAMELLIA-128-CBC": 16, "CAMELLIA-192-CBC": 16, "CAMELLIA-256-CBC": 16, "SEED-CBC": 16,
}
_RUN = re.compile(r"(?<![A-Za-z0-9+_-])(?=M[A-Za-z0-9]|b3BlbnNza)[A-Za-z0-9+/_-]{56,}={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{78,}")


def decode_base64(text: str) -> bytes | None:
    """Standard or URL alphabet, padding optional; None if it isn't base64."""
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at ``at``; None unless it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or at + more > end:
            return None
        n = int.from_bytes(data[at : at + more], "big")
        at += more
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        got = _der(data, at, end)
        if got is None:
            return None
        out.append(got)
        at = got[2]
    return out


def _openssh(data: bytes) -> bool:
    """The private key container: its length-prefixed fields fill it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16 or any(not field() for _ in range(count)):
        return False
    return bool(field())


def is_private_key(data: bytes | None) -> bool:
    """Whether these bytes are a private key's encoding, its nested lengths exact."""
    if not data or len(data) < 32:
        return False
    if _openssh(data):
        return True
    top = _der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if tags[:1] == [0x02] and len(tags) >= 6 and set(tags) <= {0x02, 0x30}:  # RSA or DSA integers
        return data[parts[0][1] : parts[0][2]] in (b"\0", b"\1")
    if tags[:2] == [0x02, 0x04]:  # elliptic curve: version 1, octets
        return data[parts[0][1] : parts[0][2]] == b"\1" and parts[1][2] - parts[1][1] >= 16
    if tags[:3] == [0x02, 0x30, 0x04]:  # algorithm and wrapped key
        inner = _children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags == [0x30, 0x04]:  # encrypted wrapped key
        inner = _children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06
    return False


def key_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of the blocks between a BEGIN line and its END, in linear time.

    A body holds no five dashes, so the next ones decide whether it is closed.
    """
    at = 0
    while m := _BEGIN.search(text, at):
        stop = text.find("-----", m.end())
        if stop < 0:
            return
        while text.startswith("-", stop + 5) and text.startswith("-----", stop + 1):
            stop += 1
        end = f"-----END {m[1]}-----"
        if text.startswith(end, stop) and _BODY.fullmatch(text, m.end(), stop):
            yield m.start(), stop + len(end), text[m.end() : stop]
            at = stop + len(end)
        else:
            at = stop


def is_locked_key(head: str, data: bytes | None) -> bool:
    """Whether a block's head names a known cipher with a start vector of its size, and the data are whole cipher blocks."""
    lock = _LOCK.search(head)
    size = _CIPHERS.get(lock[1], 0) if lock else 0
    return "Proc-Type: 4,ENCRYPTED" in head and bool(size) and len(lock[2]) == 2 * size and bool(data) and len(data) >= 32 and len(data) % size == 0


def is_signed_token(header: str, payload: str) -> bool:
    """Whether both segments decode to JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads(decode_base64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def scan(text: str) -> list[tuple[int, int, int]]:
    """All (start, end, kind's number) in code points, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    out += [(m.start(), m.end(), 3) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    taken: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for start, end, body in key_blocks(text):
            lines = _ESCAPE.sub("\n", body).splitlines()
            data = decode_base64("".join(x for x in lines if ":" not in x))
            if is_private_key(data) or is_locked_key("\n".join(x for x in lines if ":" in x), data):
                taken.append((start, end))
                out.append((start, end, 4))

    def free(m: re.Match) -> bool:
        i = bisect_right(taken, (m.start(), len(text) + 1))
        return (i == 0 or taken[i - 1][1] <= m.start()) and (i == len(taken) or taken[i][0] >= m.end())

    out += [(m.start(), m.end(), 5) for m in _RUN.finditer(text) if free(m) and is_private_key(decode_base64(m[0]))]
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and free(m) and is_private_key(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), 5))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for part in slices(batch, "text"):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan(t)] if t else [] for t in part.column("text").to_pylist()]
            cols = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(item))], [*part.schema.names[:-1], "spans"])


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: the secrets of its whole text by start, then kind.

    A null or empty text has no spans; null ids and repeated rows come back as
    they are. Other columns are not looked at. One scan, no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches, f"doc_id long, spans {SPANS}")


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for t in batch.column("text").to_pylist():
            if t:
                out, at = [], 0
                for a, b, k in scan(t):
                    if b > at:
                        if a >= at:
                            out += [t[at:a], f"[{KINDS[k]}]"]
                        at = b
                t = "".join([*out, t[at:]])
            texts.append(t)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with each secret in ``text`` replaced by its kind in brackets.

    Spans that overlap are replaced as one. A null text stays null.
    """
    return docs.mapInArrow(_redacted, docs.schema)
