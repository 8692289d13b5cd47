"""Secrets in documents: patterns, and encoded keys or tokens whose structure is confirmed."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .storage import free_name, give_back

#: The base patterns, with the least length of what they must hold.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the same spans as all runs of which the short ones are dropped
MIN_ASSIGN, MIN_ACCESS = 12, 18
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "signed_token", "private_key", "encoded_key")

_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?:\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+)?")
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40})PRIVATE KEY( BLOCK|)-----")
_ARMOURED = re.compile(r"[\sA-Za-z0-9+/=:,.-]*")
_HEX_KEY = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")
_IS_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_IS_B64 = bytes(104 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 32 for b in range(256))


def decode_base64(s: str) -> bytes | None:
    """Either alphabet, padded or not; None if it is not base64."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of a whole sequence of DER elements; None if a length doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the data and holds a private key: a version, then key parts with fitting nested lengths."""
    top = der_elements(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_elements(top[0][1])
    if not parts or len(parts) < 3:
        return False
    tags = [t for t, _ in parts]
    if tags[0] == 0x02 and len(parts[0][1]) == 1:
        if tags[1] == 0x30 and tags[2] == 0x04:  # algorithm, then the key as octets
            algorithm = der_elements(parts[1][1])
            return bool(algorithm) and algorithm[0][0] == 0x06
        if tags[1] == 0x04:  # elliptic curve: octets, then tagged parameters
            return all(t in (0xA0, 0xA1) for t in tags[2:])
        return len(parts) >= 6 and all(t == 0x02 for t in tags)  # the integers of an RSA or DSA key
    return False


def is_ssh_key(data: bytes) -> bool:
    """The magic of the private format, then fields whose nested lengths fit."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, kdf, options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 8 > len(data) or not 1 <= int.from_bytes(data[at : at + 4], "big") <= 16:
        return False
    return at + 8 + int.from_bytes(data[at + 4 : at + 8], "big") <= len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and len(data) >= 16 and (data[0] == 0x30 and is_der_key(data) or is_ssh_key(data))


def is_signed_header(part: str) -> bool:
    """A JSON object that names an algorithm. One nested too deeply to be parsed is none."""
    try:
        header = json.loads(decode_base64(part) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def signed_tokens(text: str) -> Iterator[re.Match]:
    """Tokens whose header decodes; behind one that does not, the next may be the header."""
    at = 0
    while m := _SIGNED.search(text, at):
        holds = is_signed_header(m[1])
        if holds:
            yield m
        at = m.end() if holds else m.end(1)


def armoured_keys(text: str) -> Iterator[tuple[int, int]]:
    """Armoured private keys: an end mark with the nearest begin mark of its kind before it, and a body that is a key."""
    begun: dict[tuple[str, str], re.Match] = {}
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begun = {m.groups()[1:]: m}
        elif start := begun.pop(m.groups()[1:], None):
            body = text[start.end() : m.start()]
            lines = [x for x in body.split("\n") if ":" not in x]
            sealed = "ENCRYPTED" in body or "ENCRYPTED" in m[2] or m[3]  # such a body has no structure to see
            if _ARMOURED.fullmatch(body) and (sealed or is_key(decode_base64(re.sub(r"\s+", "", "".join(lines))))):
                yield start.start(), m.end()


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans of signed tokens, armoured keys and bare encoded keys whose structure holds."""
    found = [("signed_token", m.start(), m.end()) for m in signed_tokens(text)]
    found += [("private_key", a, b) for a, b in armoured_keys(text)]
    covered = sorted((a, b) for _, a, b in found)
    for m in _ENCODED.finditer(text):
        at = bisect_right(covered, (m.start(), len(text)))
        if at and m.start() < covered[at - 1][1]:
            continue
        as_hex = _HEX_KEY.fullmatch(m[0])
        if as_hex and is_key(bytes.fromhex(m[0])) or m[0][:2] in ("MI", "MH", "MC", "b3", "MG", "MD", "ME", "MF") and is_key(decode_base64(m[0])):
            found.append(("encoded_key", m.start(), m.end()))
    return found


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) as (kind, start, end) in code points, by start and then kind."""
    if not text:
        return [], []
    raw = text.encode()
    base = []
    low = raw.lower()
    if any(h in low for h in ASSIGN_HINTS):
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"h" * 16 in raw.translate(_IS_HEX):
        base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    more = confirmed(text) if b"h" * 24 in raw.translate(_IS_B64) or b"eyJ" in raw or b"-----BEGIN" in raw else []
    rank = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=rank), sorted(base + more, key=rank)


FOUND = "n_assign long, n_access long, n_hex long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
    give_back()
    for texts in batches:
        out = []
        for text in texts:
            base, spans = find_secrets(text)
            kinds = [k for k, _, _ in base]
            out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), as_rows(base), as_rows(spans)))
        yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base", "spans"])
        del texts, out
        give_back()


def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    give_back()
    for texts in batches:
        yield texts.map(redact)
        del texts
        give_back()


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping spans replaced by mask."""
    if not text:
        return text
    out, done = [], 0
    for _, start, end in find_secrets(text)[1]:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join(out) + text[done:]


def joined(spans: str):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, column: str, text_col: str = "text") -> DataFrame:
    """docs with a struct `column`: counts of the base kinds, base spans and all spans.

    Base kinds are patterns (assign, access, hex), leftmost and non-overlapping for each kind, the too short dropped. Further kinds are
    reported only after decoding: signed tokens whose header names an algorithm, armoured private keys, and bare base64
    or hex whose bytes parse as a key with fitting nested lengths. Spans of different kinds may overlap.
    Null and empty texts have no spans; every row is scanned alone, repeated ones too; texts of any length are read
    whole; an empty table gives none. All columns of docs stay.
    """
    return docs.withColumn(column, pandas_udf(_found, FOUND)(F.col(text_col)))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in `text` and `n_chars` set to the new length of changed texts. All rows and columns stay.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty table stays empty. Texts of any
    length are read whole.
    """
    name = free_name(docs, "_clean")
    clean = docs.withColumn(name, pandas_udf(_redacted, "string")(F.col("text")))
    changed = ~F.col(name).eqNullSafe(F.col("text"))
    put = {"text": F.col(name), "n_chars": F.when(changed, F.length(name)).otherwise(F.col("n_chars"))}
    return clean.select(*[put[c].alias(c) if c in put else F.col(c) for c in docs.columns])
