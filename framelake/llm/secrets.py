"""Secret scan with structural confirmation.

Base spans come from three patterns (assignments, access ids, hex runs). Beyond them, every run of token
characters is a candidate: it is decoded (base64, base64url, hex) and reported only if what comes out has
a structure that text doesn't have by chance:

- jwt: three dotted parts anywhere in the run (the third may be empty), the first a JSON object with a string "alg", the second a JSON object;
- der: an ASN.1 SEQUENCE whose nested lengths all add up, with at least two elements;
- ssh: length-prefixed strings that fill the blob, the first a known key name; or an OpenSSH key file, whose
  cipher, options, public keys and private part fill it likewise;
- pem: a BEGIN/END pair with the same label around base64 that decodes to either of these; or, where headers
  name a cipher and its start value, to whole blocks of it.

Spans are kind:start:end in code points, end exclusive. Nulls: a null text is an empty one; a null doc_id
stays null. Equal rows each give a row. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Maximal runs, so a lower bound here drops just the runs that are too short.
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s*[A-Za-z][A-Za-z0-9-]{0,40}:[^\n]{0,1000}\n)*)([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
DEK = re.compile(r"^\s*DEK-Info:[ \t]*[A-Z0-9-]+,([0-9A-Fa-f]+)\s*$", re.M)
#: In a dotted run: where a token's header may start, a whole part, and the third part's beginning.
HEAD = re.compile(r"ey(?=[A-Za-z0-9+/_-]+={0,2}\Z)")
WHOLE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
SIGNATURE = re.compile(r"[A-Za-z0-9+/_-]*")
PARTS = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: Names of SSH key types (fixed values).
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_HEADER = b"openssh-key-v1\0"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def decoded(word: str) -> bytes | None:
    """The bytes of a base64 or base64url word, padded or not."""
    word = word.rstrip("=").translate({45: "+", 95: "/"})
    if len(word) % 4 == 1:
        return None
    try:
        return base64.b64decode(word + "=" * (-len(word) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes, at: int, end: int, depth: int) -> int:
    """How many ASN.1 elements fill data[at:end] exactly, nested ones too; 0 if they don't."""
    n = 0
    while at < end:
        if at + 2 > end or data[at] == 0 or data[at] & 0x1F == 0x1F:
            return 0
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > end:
                return 0
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > end:
            return 0
        if tag & 0x20 and (depth > 16 or not _elements(data, at, at + size, depth + 1)):
            return 0
        at += size
        n += 1
    return n


def is_der(data: bytes) -> bool:
    if len(data) < 16 or data[0] != 0x30:
        return False
    head = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    return _elements(data, 0, len(data), 0) == 1 and _elements(data, head, len(data), 0) >= 2


def _strings(data: bytes, at: int, count: int | None = None) -> tuple[list[bytes], int] | None:
    """(length-prefixed strings from a place on, where they end): so many of them, or as many as fill the rest; None if they don't fit."""
    out = []
    while len(out) < count if count is not None else at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def _is_key_file(data: bytes) -> bool:
    """An OpenSSH key file: cipher, key derivation and its options, a number of public keys, the private part."""
    head = _strings(data, len(SSH_HEADER), 3)
    if head is None or not head[0][0] or not head[0][1]:
        return False
    at = head[1]
    n = int.from_bytes(data[at : at + 4], "big")
    rest = _strings(data, at + 4)
    return rest is not None and n >= 1 and len(rest[0]) == n + 1 and all(map(is_ssh, rest[0][:-1])) and len(rest[0][-1]) % 8 == 0


def is_ssh(data: bytes) -> bool:
    if data.startswith(SSH_HEADER):
        return _is_key_file(data)
    if data[4 : 4 + int.from_bytes(data[:4], "big")] not in SSH_NAMES:
        return False
    return _strings(data, 0) is not None


def is_jwt(word: str) -> bool:
    parts = word.split(".")
    if len(parts) != 3 or not parts[0].startswith("ey") or not parts[1]:
        return False
    try:
        head, body = (json.loads(decoded(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def signed_tokens(word: str) -> list[tuple[int, int]]:
    """The spans in a run of token characters that are signed tokens; the run may have more around them."""
    found, parts, at = [], word.split("."), 0
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p) + 1)
    while at + 2 < len(parts):
        head, body = parts[at : at + 2]
        if "ey" in head and WHOLE.fullmatch(body) and (decoded(body) or b"").lstrip().startswith(b"{"):
            last = SIGNATURE.match(parts[at + 2])[0]
            for m in HEAD.finditer(head):
                if is_jwt(f"{m[0]}{head[m.end():]}.{body}.{last}"):
                    found.append((starts[at] + m.start(), starts[at + 2] + len(last)))
                    at += 2
                    break
        at += 1
    return found


def _structure(data: bytes | None) -> int | None:
    if data is None:
        return None
    return 5 if is_der(data) else 6 if is_ssh(data) else None


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """The spans that decoding confirms, beyond the base patterns."""
    found: list[tuple[int, int, int]] = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data, start = decoded(re.sub(r"\s+", "", m[3])), DEK.search(m[2])
            enciphered = start and data and len(start[1]) in (16, 32) and len(data) % (len(start[1]) // 2) == 0
            if enciphered or _structure(data) is not None:
                found.append((m.start(), 3, m.end()))
    for m in CANDIDATE.finditer(text):
        word = m[0]
        tokens = signed_tokens(word) if word.count(".") >= 2 else []
        found += [(m.start() + a, 4, m.start() + b) for a, b in tokens]
        for p in PARTS.finditer(word):
            if any(a < p.end() and p.start() < b for a, b in tokens):
                continue
            kind = _structure(decoded(p[0]))
            if kind is None and len(p[0]) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", p[0]):
                kind = _structure(bytes.fromhex(p[0]))
            if kind is not None:
                found.append((m.start() + p.start(), kind, m.start() + p.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans; over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                cols: list[list] = [[] for _ in range(5)]
                for t in b.column(1).to_pylist():
                    base = base_spans(t or "")
                    row = [sum(k == x for _, k, _ in base) for x in range(3)]
                    row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + confirmed_spans(t or ""))]
                    for c, v in zip(cols, row):
                        c.append(v)
                arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return secret_spans(docs)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """text with every span (overlapping ones as one) replaced by mark."""
    out, at = [], 0
    for a, _, b in sorted(base_spans(text) + confirmed_spans(text)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
