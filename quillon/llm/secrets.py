"""Secret scan with structural confirmation.

Three base kinds are found by pattern: ``assign`` (a credential's name, a sign and a value), ``access`` (an access key
id) and ``hex`` (a long lower-case hex run). The method adds kinds that are reported only once what they hold has been
decoded and parsed:

* ``der``: a base64 or hex run that is one private key in DER (PKCS#1, PKCS#8 or SEC 1), with every nested length
  filling its parent exactly;
* ``openssh``: a base64 run that is an OpenSSH private key, its length-prefixed fields in order;
* ``pem``: a PEM private-key block whose body is one of these two, or encrypted with the headers that say so;
* ``jwt``: three dot-separated parts whose header is a JSON object with a known ``alg`` and whose payload is an object;
* ``encoded``: a base64 or hex run that decodes to ASCII text in which a base ``assign`` or ``access``, a ``pem`` or a
  ``jwt`` is found.

A base64 run has 16 characters or more (the shortest ``assign`` has 12 bytes) and may go on over lines, which end with LF,
CRLF or these as escapes (``\\n``). Where a run as a whole holds nothing, each of its lines of 16 characters or more may
begin a key or text that ends with any later line, the last one that fits.

Spans are code points, end exclusive. Null text counts as empty. Every row gives one row; rows with one doc_id are
scanned each for itself. Other columns are not read. No row moves between tasks, texts are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "der", "openssh", "pem", "jwt", "encoded")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{24,}")
BREAK = r"(?:\r?\n|(?:\\+r)?\\+n)"
BREAKS = re.compile(BREAK)
#: No base64 of a key or of ASCII text begins with n, r or t, so one of them after a backslash is the end of an escape.
BASE64 = re.compile(rf"(?:(?<=\\)[nrt])?([A-Za-z0-9+/_-]{{16,}}(?:{BREAK}[A-Za-z0-9+/_-]+)*={{0,2}})")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:[A-Za-z0-9+/=\s:,]|\\+[nrt/]|-(?!----))*)-----END \1PRIVATE KEY-----")
ESCAPE = re.compile(r"\\+([nrt/])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?:(?<=\\)[nrt])?(?=([A-Za-z0-9_-]{16,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
NOT_TEXT = re.compile(rb"[^\x20-\x7e\t\n\r]")
ALGORITHMS = {"none", "HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES256K", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA"}
_RUN = bytes(120 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_-") else 32 for i in range(256))
_HEX_RUN = bytes(120 if chr(i) in "0123456789abcdefABCDEF" else 32 for i in range(256))
MAGIC = b"openssh-key-v1\0"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of kind) of the base kinds, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found


def unbase64(run: str) -> bytes | None:
    run = re.sub(r"\s", "", run).rstrip("=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run.translate({45: 43, 95: 47}) + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill `data` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
            if n < 0x80 or n >> (8 * (wide - 1)) == 0:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1])
    if not items or items[0][0] != 0x02:
        return False
    tags = [t for t, _ in items]
    if len(items) >= 9 and tags[:9] == [0x02] * 9 and items[0][1] in (b"\0", b"\1"):  # PKCS#1: version and eight numbers
        return len(items[1][1]) >= 32
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: version, algorithm, key
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and der_items(items[2][1]) is not None
    return tags[:2] == [0x02, 0x04] and items[0][1] == b"\1" and 16 <= len(items[1][1]) <= 66 and all(t in (0xA0, 0xA1) and der_items(c) for t, c in items[2:])  # SEC 1


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins with `head`."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    wide = head[1] & 0x7F if head[1] & 0x80 else 0
    return (2 + wide + int.from_bytes(head[2 : 2 + wide], "big") if wide else 2 + head[1]) if wide <= 4 else None


def openssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that `data` begins with."""
    if not data.startswith(MAGIC):
        return None
    at = len(MAGIC)
    for field in range(3):  # cipher, key derivation, its options
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data) or field < 2 and not n:
            return None
        at += 4 + n
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):  # public keys, then the private part
        if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) > len(data):
            return None
        at += 4 + n
    return at


def json_object(part: str) -> dict | None:
    try:
        got = json.loads(unbase64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def decoded_kind(data: bytes | None) -> int | None:
    if not data:
        return None
    if is_private_der(data):
        return 3
    if openssh_size(data) == len(data):
        return 4
    return 7 if not NOT_TEXT.search(data) and text_holds(data.decode("ascii")) else None


def text_holds(text: str) -> bool:
    return bool(base_spans(text) or container_spans(text))


def container_spans(text: str) -> list[tuple[int, int, int]]:
    """PEM blocks and JWT."""
    found = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            body = ESCAPE.sub(lambda e: {"n": "\n", "r": "\r", "t": "\t", "/": "/"}[e[1]], m[2]).replace("\r\n", "\n").strip()
            head, body = re.split(r"\n[^\S\n]*\n", body, maxsplit=1) if "DEK-Info:" in body and re.search(r"\n[^\S\n]*\n", body) else ("", body)
            data = unbase64(body)
            if head and "ENCRYPTED" in head and data or decoded_kind(data) in (3, 4) or m[1] == "ENCRYPTED " and data and (outer := der_items(data)) and len(outer) == 1 and outer[0][0] == 0x30 and der_items(outer[0][1]):
                found.append((*m.span(), 5))
    if "." in text:
        for m in JWT.finditer(text):
            header = json_object(m[1])
            if header and isinstance(header.get("alg"), str) and header["alg"] in ALGORITHMS and json_object(m[2]) is not None and (m[3] or header["alg"] == "none"):
                found.append((m.start(1), m.end(3), 6))
    return found


def line_kinds(run: str, ends: list[int]) -> list[tuple[int, int, int]]:
    """(first line, last line, kind) of what whole lines of a base64 run hold; `ends`: where each line ends in `run`, which
    has neither breaks nor padding. The size of a key follows from its first bytes, that of text from the first byte that
    is none, so a line is decoded once as a beginning, and not once for each possible end."""
    found, i, at_end = [], 0, {e: j for j, e in enumerate(ends)}
    text_from = text_to = 0  # what has been read as text without a find
    while i < len(ends):
        a, hit = ends[i - 1] if i else 0, None
        if ends[i] - a >= 16:
            head = unbase64(run[a : a + 20]) or unbase64(run[a : a + 16]) or b""
            size, kind = der_size(head), 3
            if head[:12] == MAGIC[:12]:
                size, kind = openssh_size(unbase64(run[a:]) or unbase64(run[a:-1]) or b""), 4
            j = at_end.get(a - (-size * 4 // 3)) if size else None
            if j is not None and decoded_kind(unbase64(run[a : ends[j]])) == kind:
                hit = j, kind
            elif not NOT_TEXT.search(head) and not (a < text_to and (a - text_from) % 4 == 0):
                n, bad = 256, None
                while not (bad := NOT_TEXT.search(data := unbase64(run[a : a + n]) or unbase64(run[a : a + n][:-1]) or b"")) and a + n < len(run):
                    n *= 4
                size = bad.start() if bad else len(data)
                j = bisect.bisect_right(ends, size, key=lambda e: (e - a) * 3 // 4) - 1
                while j >= i and (ends[j] - a) % 4 == 1:
                    j -= 1
                if j >= i and text_holds((unbase64(run[a : ends[j]]) or b"").decode("ascii", "replace")):
                    hit = j, 7
                elif j >= i:
                    text_from, text_to = a, ends[j]
        if hit:
            found.append((i, *hit))
        i = hit[0] + 1 if hit else i + 1
    return found


def confirmed_spans(text: str, flat: bytes) -> list[tuple[int, int, int]]:
    found = container_spans(text)
    if b"x" * 16 in flat.translate(_RUN):
        for m in BASE64.finditer(text):
            breaks = [x.span() for x in BREAKS.finditer(m[1])]
            starts, stops = [0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(m[1])]
            lines = [m[1][a:b].rstrip("=") for a, b in zip(starts, stops, strict=True)]
            run = "".join(lines)
            kind = decoded_kind(unbase64(run))
            if kind is not None:
                found.append((*m.span(1), kind))
            elif breaks:  # lines that do not belong together
                found += [(m.start(1) + starts[i], m.start(1) + stops[j], k) for i, j, k in line_kinds(run, list(itertools.accumulate(map(len, lines))))]
    if b"x" * 24 in flat.translate(_HEX_RUN):
        for m in ANY_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and (kind := decoded_kind(bytes.fromhex(m[0]))) is not None:
                found.append((*m.span(), kind))
    return found


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that the method adds), each as (start, end, index of kind), sorted by start, then kind."""
    base = base_spans(text)
    flat = text.encode("latin-1", "replace")
    if b"x" * 24 in flat.translate(_HEX_RUN):
        base += [(*m.span(), 2) for m in HEX.finditer(text)]
    order = lambda x: (x[0], x[2])
    return sorted(base, key=order), sorted(set(confirmed_spans(text, flat)), key=order)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            base, more = scan(text.as_py() or "")
            counts = [sum(k == i for *_, k in base) for i in range(3)]
            spans = joined(sorted(base + more, key=lambda x: (x[0], x[2])))
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), spans, len(more)))
        if rows:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed) for each row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan_rows, SCHEMA)
