"""Secret scan: base patterns, and encoded keys confirmed by their structure.

Base spans (`assign`, `access`, `hex`) are plain patterns. Structural spans are
reported only if a candidate decodes and its parts agree:

* `pem`: a PEM armour of a private key whose body is valid base64 and holds a key structure; line breaks may be
  written as backslash and n, and header lines may come first. An encrypted body is ciphertext: there the headers
  must name a cipher with its vector, and the body be whole blocks;
* `jwt`: three base64url parts, of which the first is a JSON object with `alg` and the second a JSON object;
* `keyb64` / `keyhex`: a base64 run, on one line or wrapped at 64 or 76 columns, or a hexadecimal run, also with
  0x or colons, that decodes to a private-key structure.

A key structure is DER whose nested lengths fill the value exactly and whose
members are those of PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA, or an
OpenSSH container whose length-prefixed members fill it exactly.

Defined cases: a null text is an empty text; empty texts give no spans; a row is
returned for every input row, repeated rows and null ids included; extra columns
are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_of, text_or_empty

# The kinds in the order in which equal starts are listed, and the base patterns.
KINDS = ("assign", "access", "hex", "pem", "jwt", "keyb64", "keyhex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
PEM_HEADER = re.compile(r"([A-Za-z0-9-]+):[ \t]*(.*)")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:(?:[A-Za-z0-9+/]{64}\r?\n)+|(?:[A-Za-z0-9+/]{76}\r?\n)+)[A-Za-z0-9+/]{1,76}={0,2}(?![A-Za-z0-9+/=])")
B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{44,}={0,2}")
HEXKEY = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9a-fA-F]{2}){32,}|(?:[0-9a-fA-F]{2}:){31,}[0-9a-fA-F]{2})(?![0-9A-Za-z])")

#: Characters that a signed token, and an encoded key, have at least.
LEAST_TOKEN, LEAST_KEY = 13, 44

# Encodings of the object ids of password-based encryption (PKCS#5, PKCS#12), and block bytes by the name of a cipher.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
CIPHER_BLOCKS = {"DES": 8, "AES": 16}
SEQUENCE, INTEGER, OCTETS, OBJECT_ID, CONTEXT0, CONTEXT1 = 0x30, 0x02, 0x04, 0x06, 0xA0, 0xA1


def der_members(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, value) of each member of a DER byte string that they fill exactly, else None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length = int.from_bytes(data[at : at + n], "big")
            if length < 0x80 or length >> (8 * (n - 1)) == 0:  # DER takes the shortest form
                return None
            at += n
        if at + length > len(data):
            return None
        found.append((tag, data[at : at + length]))
        at += length
    return found


def is_der_key(data: bytes) -> bool:
    """PKCS#1, DSA or SEC 1 private key, or a PKCS#8 envelope around a value that is itself well-formed or encrypted."""
    outer = der_members(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    inner = der_members(outer[0][1])
    tags = [tag for tag, _ in inner or ()]
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8: the way of encryption, then whole blocks
        way = der_members(inner[0][1])
        return bool(way) and way[0][0] == OBJECT_ID and way[0][1].startswith(PASSWORD_BASED) and len(inner[1][1]) >= 32 and len(inner[1][1]) % 8 == 0
    if not inner or inner[0][0] != INTEGER or len(inner[0][1]) != 1:
        return False
    if tags == [INTEGER] * 6:  # DSA: version, three numbers of the domain, both keys
        return inner[0][1] == b"\0" and all(len(value) >= 16 for _, value in inner[1:])
    if tags[:9] == [INTEGER] * 9:  # RSA: version and eight numbers
        return all(value for _, value in inner[:9])
    if len(inner) >= 2 and inner[0][1] == b"\x01" and tags[1] == OCTETS and set(tags[2:]) <= {CONTEXT0, CONTEXT1}:
        return len(inner[1][1]) >= 16 and all(der_members(value) for _, value in inner[2:])
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8: algorithm identifier, then the key
        algorithm = der_members(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID and bool(der_members(inner[2][1]))
    return False


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH container: magic, cipher, kdf, options, key count, public keys, private block; lengths fill it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), []

    def take() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return False
        fields.append(data[at : at + n])
        at += n
        return True

    if not (take() and take() and take()) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(take() for _ in range(keys + 1)) and at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, with or without padding; None if it isn't."""
    body = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_json_object(part: str, key: str | None = None) -> bool:
    try:
        got = json.loads(from_base64(part) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and (key is None or key in got)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind that are long enough."""
    found = []
    low = text.lower()
    if any(w in low for w in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def is_pem_body(body: str) -> bool:
    """Whether what stands in a private key's armour is one: header lines, if any, then base64."""
    lines = body.replace("\\r", "").replace("\\n", "\n").split("\n")
    headers, rest = {}, []
    for line in map(str.strip, lines):
        found = PEM_HEADER.fullmatch(line)
        if found and not rest:
            headers[found[1].lower()] = found[2]
        elif line:
            rest.append(line)
    data = from_base64("".join("".join(rest).split()))
    if "ENCRYPTED" not in headers.get("proc-type", ""):
        return is_key(data)
    cipher, _, vector = headers.get("dek-info", "").partition(",")
    block = CIPHER_BLOCKS.get(cipher[:3].upper())
    return bool(data and block) and len(data) % block == 0 and len(vector) == 2 * block and re.fullmatch("[0-9a-fA-F]+", vector) is not None


def pem_spans(text: str) -> list[tuple[int, int, str]]:
    """Armours of private keys; one begins with the last opening line before its closing one."""
    begins, found, missing = list(PEM_BEGIN.finditer(text)), [], set()
    for i, m in enumerate(begins):
        close = f"-----END {m[1]}-----"
        if close in missing:
            continue
        end = text.find(close, m.end())
        if end < 0:
            missing.add(close)
        elif (i + 1 == len(begins) or end < begins[i + 1].start()) and is_pem_body(text[m.end() : end]):
            found.append((m.start(), end + len(close), "pem"))
    return found


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose decoded structure is a private key or a signed token."""
    found = pem_spans(text) if "PRIVATE KEY-----" in text else []
    longest = max(map(len, text.split()), default=0)  # no candidate holds a blank within a line
    if longest >= LEAST_TOKEN:
        for m in JWT.finditer(text):
            if is_json_object(m[1], "alg") and is_json_object(m[2]) and (not m[3] or from_base64(m[3])):
                found.append((m.start(), m.end(), "jwt"))
    for kind, pattern in (("keyb64", WRAPPED), ("keyb64", B64), ("keyhex", HEXKEY)) if longest >= LEAST_KEY else ():
        within = sorted(found)
        for m in pattern.finditer(text):
            i = bisect_right(within, (m.start(), len(text) + 1, "")) - 1
            if i >= 0 and m.start() < within[i][1]:
                continue
            if is_key(bytes.fromhex(m[1].replace(":", "")) if kind == "keyhex" else from_base64("".join(m[0].split()))):
                found.append((m.start(), m.end(), kind))
    return found


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then by kind as listed."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    more = structural_spans(text)
    return base, sorted(base + more, key=order) if more else base


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each group of overlapping spans replaced by the kind of its first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i < len(spans) and spans[i][0] < max(end, start + 1):
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind} removed]"]
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, text, counts of base kinds, base and all spans, and the redacted text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in chunks(batches):
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "spans", "redacted")}
            for text in column_of(batch, "text").to_pylist():
                base, every = spans_of(text)
                kinds = [kind for *_, kind in base]
                for kind in ("assign", "access", "hex"):
                    rows[f"n_{kind}"].append(kinds.count(kind))
                rows["base"].append(listed(base))
                rows["spans"].append(listed(every))
                rows["redacted"].append(redact(text, every) if every else None)
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "id"), *(pa.array(rows[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")), *(pa.array(rows[k], pa.string()) for k in ("base", "spans", "redacted"))],
                ["id", *rows],
            )

    found = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = found.mapInArrow(scan, f"id {id_type}, n_assign long, n_access long, n_hex long, base string, spans string, redacted string")
    return found.withColumnRenamed("id", id_col)


def digest_rows(docs: DataFrame) -> DataFrame:
    """The columns that op2 returns."""
    found = scan_secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redact_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with every span of a secret replaced in the text, n_chars counted anew; all rows and columns stay.

    Texts without a span, null texts included, are left as they are.
    """
    names = docs.columns
    at = names.index(text_col)
    schema = docs.schema

    def run(batches):
        for batch in chunks(batches, at):
            texts = batch.column(at)
            new, sizes = texts.to_pylist(), batch.column(names.index(size_col)).to_pylist() if size_col in names else None
            for i, text in enumerate(new):
                if text and (spans := spans_of(text)[1]):
                    new[i] = redact(text, spans)
                    if sizes is not None:
                        sizes[i] = len(new[i])
            columns = list(batch.columns)
            columns[at] = pa.array(new, texts.type)
            if sizes is not None:
                columns[names.index(size_col)] = pa.array(sizes, batch.column(names.index(size_col)).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
