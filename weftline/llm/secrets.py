"""Secret scan with structural confirmation.

Three plain kinds are reported as they match: assignments to secret-like names, access key ids and long hex runs.
Four further kinds are candidates until their structure confirms them: a PEM block or a bare base64 or hex run is
decoded, and must parse as a private key whose nested lengths fill one another exactly; an OpenSSH key must hold its
magic and length-prefixed fields; a signed token's header and payload must decode to JSON objects, the header with
an algorithm.

Spans are code points, end exclusive; within a kind matches are leftmost and do not overlap, across kinds they may.
Edge cases: a null text is read as empty and has no spans; repeated rows are scanned alike; an empty table gives an
empty result; input columns named like an output column are replaced. Every pattern is linear in the text, and a
worker holds a few megabytes of text, or one text, at a time; only texts that can hold a secret go to one.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_column, without

#: Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "key", "ssh", "jwt")
SPAN = "struct<kind:string,start:int,end:int>"

_NAME = re.compile(r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
_ASSIGN = re.compile(rf"""({_NAME.pattern})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----")
#: The first byte of every key encoding is 0x30, so its base64 begins with M and its hex with 30.
_DER64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-P][A-Za-z0-9+/_-]{38,}={0,2}")
_DERHEX = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){31,}(?![0-9A-Fa-f])")
_SSH64 = re.compile(r"(?<![A-Za-z0-9+/_-])b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]{40,}={0,2}")
#: Looks ahead, so that a part may begin a token though one before it does not.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=(([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*))")
#: Base64 that may hold a PEM text, on one line or in lines of 40 characters at least, the last one excepted.
_LONG64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{40})(?:[A-Za-z0-9+/_-]{40,}\r?\n[ \t]*)*[A-Za-z0-9+/_-]+={0,2}")
_BLANK = re.compile(r"(?:\r?\n|(?:\\r)?\\n){2}")
_SSH_MAGIC = b"openssh-key-v1\0"
#: The ciphers of encrypted PEM keys, by name, and the bytes of a block.
_CIPHER = re.compile(r"DEK-Info: *(?:(?P<wide>(?:AES|CAMELLIA)-(?:128|192|256)-CBC|SEED-CBC)|(?:DES|DES-EDE3|BF|CAST5|IDEA|RC2)-CBC), *(?:[0-9A-Fa-f]{2})+(?![0-9A-Za-z])")
#: Patterns of Java that find every text in which ``scan`` can find something: an assignment, and a run of 32 characters of
#: base64 (of hex too), or of 14 before a dot, as the header of a token has at least.
_ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14}(?:[A-Za-z0-9+/_-]{18}|[A-Za-z0-9+/_-]*+\.[A-Za-z0-9_-])"


def _decoded(text: str) -> bytes | None:
    """The bytes of base64 text in either alphabet, with or without padding."""
    text = re.sub(r"\s|\\[rn]", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the fields that fill data[start:end] exactly, or None."""
    found = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or end - start < n:
                return None
            length, start = int.from_bytes(data[start : start + n], "big"), start + n
        if end - start < length:
            return None
        found.append((tag, start, start + length))
        start += length
    return found


def is_private_key(data: bytes | None) -> bool:
    """Whether the bytes are one PKCS#1, PKCS#8, SEC1 or encrypted PKCS#8 key with consistent nested lengths."""
    outer = _fields(data, 0, len(data)) if data else None
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = _fields(data, *outer[0][1:])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    nested = lambda i: _fields(data, *inner[i][1:])
    oid_first = lambda i: bool((x := nested(i)) and x[0][0] == 0x06)
    if tags[0] == 0x02 and inner[0][2] - inner[0][1] == 1:
        if tags[1:3] == [0x30, 0x04]:
            return oid_first(1)
        if tags[1:2] == [0x04]:
            return inner[1][2] - inner[1][1] >= 16
        return len(tags) >= 6 and set(tags[:9]) == {0x02}
    return tags == [0x30, 0x04] and oid_first(0)


def is_ssh_key(data: bytes | None) -> bool:
    """Whether the bytes are an OpenSSH private key container whose length-prefixed fields fit."""
    if not data or not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)
    for _ in range(3):  # cipher, key derivation, its options
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at + 4 > len(data):
            return False
    return 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def is_signed_token(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads(_decoded(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def pem_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of the private keys in PEM form.

    What follows the headers of an encrypted one must be whole blocks of the cipher that they name.
    """
    found = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            end = text.find("-----", m.end())
            foot = m[0].replace("BEGIN", "END")
            if end >= 0 and text.startswith(foot, end):
                body = text[m.end() : end]
                if "Proc-Type:" in body:
                    *head, body = _BLANK.split(body)
                    cipher, data = _CIPHER.search("".join(head)), _decoded(body)
                    good = bool(cipher and data) and len(data) % (16 if cipher["wide"] else 8) == 0
                else:
                    data = _decoded(body)
                    good = is_private_key(data) or is_ssh_key(data)
                if good:
                    found.append((m.start(), end + len(foot)))
    return found


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind as listed."""
    text = text or ""
    found = []
    if _NAME.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += [("pem", *span) for span in pem_keys(text)]
    for m in _LONG64.finditer(text):
        data = _decoded(m[0]) if len(m[0]) >= 100 else None
        if data and b"PRIVATE KEY-----" in data and pem_keys(data.decode("latin-1")):
            found.append(("pem", *m.span()))
    found += [("key", *m.span()) for m in _DER64.finditer(text) if is_private_key(_decoded(m[0]))]
    found += [("key", *m.span()) for m in _DERHEX.finditer(text) if is_private_key(bytes.fromhex(m[0]))]
    if "b3BlbnNzaC1rZXktdjEA" in text:
        found += [("ssh", *m.span()) for m in _SSH64.finditer(text) if is_ssh_key(_decoded(m[0]))]
    if text.count(".") > 1:
        reach = 0
        for m in _JWT.finditer(text):
            if m.start() >= reach and is_signed_token(m[2], m[3]):
                found.append(("jwt", *m.span(1)))
                reach = m.end(1)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _candidate(text: str) -> Column:
    """The text if something may be found in it, else null; told in the JVM, so that other texts go to no worker."""
    holds = lambda part: F.contains(text, F.lit(part))
    assigned = (holds(":") | holds("=")) & F.rlike(text, F.lit(_ASSIGNED))
    return F.when(holds("AKIA") | holds("PRIVATE KEY-----") | assigned | F.rlike(text, F.lit(_RUN)), F.col(text))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with every secret of ``text`` as an array of (kind, start, end)."""
    df = without(df, out)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    spans = lambda texts: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in scan(t)] for t in texts], kind)
    return df.withColumn(out, text_column(df.sparkSession, f"array<{SPAN}>", lambda: spans)(_candidate(text)))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping secrets replaced by ``mark``; null stays null."""
    if not text or not (spans := scan(text)):
        return text
    out, at, reach = [], 0, 0
    for _, start, end in spans:
        if start >= reach:
            out += [text[at:start], mark]
        reach = at = max(reach, end)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with the secrets in ``text`` replaced; all rows stay, texts without secrets are unchanged."""
    def changed(texts: list[str | None]) -> pa.Array:
        new = [redact(t, mark) for t in texts]
        return pa.array([n if n != t else None for n, t in zip(new, texts)], pa.string())

    clean = text_column(df.sparkSession, "string", lambda: changed)(_candidate(text))
    return df.withColumn(text, F.coalesce(clean, F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
