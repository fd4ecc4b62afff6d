"""Secret scans with structural confirmation.

Base patterns give assignments, access key ids and long hex runs.  Beyond them, a
candidate is reported only if it decodes and its structure holds: a signed token's
header must be JSON that names an algorithm, a key must parse as nested DER lengths or
as the length-prefixed fields of an OpenSSH key.  Candidates are runs of base64 (either
alphabet) or hex digits (any case), over real or escaped line ends, with their armour where
they have one.  A key may be glued to other digits: it is tried from every place where one
can start, and ends where its own lengths say.  A run is decoded once to look for armoured
keys and tokens inside.  An encrypted key in armour is known by its cipher's header line.

Spans are code points, end exclusive.  Texts that cannot hold a match are passed over by
substring tests that admit every match.

Defined cases: a null or empty text has no spans; overlapping spans of different kinds
all stay, but for keys found again inside their armour; repeated rows and null ids each give their row; columns other than id and text
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order that ties of the start follow; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]++|-(?!----))*+)-----END \1-----", re.ASCII)
_DEK = re.compile(r"[A-Z0-9-]+,[0-9A-Fa-f]{16,32}")
_DOTTED = re.compile(r"[A-Za-z0-9_-]{12,}(?:\.[A-Za-z0-9_-]*){2,}")
# A run of base64 or hex digits, either alphabet, over real or escaped line ends.
_BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}+(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)*+")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{48,}+")
_STANDARD = str.maketrans("-_", "+/")
# Where an ASN.1 sequence can start, in base64 and in hex.
_DER_BASE64, _DER_HEX = re.compile(r"M[A-I]"), re.compile(r"(?=30)")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# One byte per class of character, so that a long run is found by a substring search.
_AS_HEX = bytes(49 if chr(b) in "0123456789abcdefABCDEF" else 48 for b in range(256))
_AS_BASE64 = bytes(49 if b < 128 and (chr(b).isalnum() or chr(b) in "+/-_") else 48 for b in range(256))
_SSH_MAGIC = b"openssh-key-v1\x00"
_SSH_BASE64, _SSH_HEX = (re.compile(re.escape(x)) for x in (base64.b64encode(_SSH_MAGIC).decode(), _SSH_MAGIC.hex()))
# "-----BEGIN " at the three places of a base64 group, and the start of a token's header once more encoded.
_NESTED = ("LS0tLS1CRUdJTi", "0tLS0tQkVHSU4g", "tLS0tLUJFR0lOI", "ZXlK")


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER items that fill ``data`` exactly, else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size = int.from_bytes(data[at:at + wide], "big")
            if size < 0x80:
                return None
            at += wide
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1, SEC 1 or PKCS#8: one sequence that starts with a small version number."""
    outer = _der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = _der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [tag for tag, _ in inner]
    if tags == [0x30, 0x04]:  # an encrypted PKCS#8 key: algorithm, then octets
        algorithm = _der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[0] != 0x02 or len(inner[0][1]) != 1 or inner[0][1][0] > 3:
        return False
    if len(inner) >= 6 and set(tags[:6]) == {0x02}:
        return True
    if tags[1] == 0x04:
        return 16 <= len(inner[1][1]) <= 66
    if tags[1] == 0x30 and len(inner) >= 3 and tags[2] == 0x04:
        algorithm = _der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def openssh_size(read: Callable[[int, int], bytes]) -> int | None:
    """Bytes of the OpenSSH private key that ``read`` starts with, None if there is none.

    The magic, then cipher, kdf and kdf options as prefixed strings, a key count, as
    many public keys and the private part.
    """
    if read(0, len(_SSH_MAGIC)) != _SSH_MAGIC:
        return None

    def number(at: int) -> int | None:
        got = read(at, at + 4)
        return int.from_bytes(got, "big") if len(got) == 4 else None

    at, left, counted = len(_SSH_MAGIC), 3, False
    while left:
        size = number(at)
        if size is None:
            return None
        at, left = at + 4 + size, left - 1
        if not left and not counted:
            count = number(at)
            if not count:
                return None
            at, left, counted = at + 4, count + 1, True
    return at if len(read(at - 1, at)) == 1 else None


def is_openssh_private_key(data: bytes) -> bool:
    """The fields of an OpenSSH private key fill ``data`` exactly."""
    return openssh_size(lambda lo, hi: data[lo:hi]) == len(data)


def der_key_size(read: Callable[[int, int], bytes]) -> int | None:
    """Bytes of the DER private key that ``read`` starts with, None if there is none."""
    head = read(0, 10)
    if len(head) < 10 or head[0] != 0x30:
        return None
    wide = head[1] & 0x7F if head[1] & 0x80 else 0
    if wide > 4 or head[1] == 0x80:
        return None
    size = 2 + wide + (int.from_bytes(head[2:2 + wide], "big") if wide else head[1])
    if head[2 + wide] != 0x30 and head[2 + wide:4 + wide] != b"\x02\x01":
        return None
    body = read(0, size)
    return size if len(body) == size and is_der_private_key(body) else None


def _from_base64(digits: str, at: int) -> Callable[[int, int], bytes]:
    """Reader of bytes lo..hi of the base64 stream from digit ``at``; fewer where the digits end."""

    def read(lo: int, hi: int) -> bytes:
        part = digits[at + lo // 3 * 4:at + -(-hi // 3) * 4]
        part = part[:-1] if len(part) % 4 == 1 else part
        return base64.b64decode(part + "=" * (-len(part) % 4))[lo % 3:lo % 3 + hi - lo]

    return read


def _from_hex(digits: str, at: int) -> Callable[[int, int], bytes]:
    """Reader of bytes lo..hi of the hex stream from digit ``at``; fewer where the digits end."""

    def read(lo: int, hi: int) -> bytes:
        part = digits[at + 2 * lo:at + 2 * hi]
        return bytes.fromhex(part[:len(part) // 2 * 2])

    return read


def _decoded(run: str, url: bool = False) -> bytes | None:
    run = re.sub(r"\s+", "", run).rstrip("=")
    try:
        raw = (run + "=" * (-len(run) % 4)).encode()
        return base64.b64decode(raw, b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, claims: str) -> bool:
    """A JSON header naming an algorithm, and claims that decode to a JSON object."""
    try:
        head, body = (json.loads((_decoded(p, True) or b"").decode("utf-8")) for p in (header, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def is_pem_body(body: str) -> bool:
    """Base64 lines that decode to a key, or a key encrypted as its header lines say."""
    head: dict[str, str] = {}
    lines = []
    for line in body.replace("\\r", "").replace("\\n", "\n").split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            head[name.strip()] = value.strip()
        else:
            lines.append(line)
    key = _decoded("".join(lines))
    if not key:
        return False
    if "ENCRYPTED" in head.get("Proc-Type", ""):
        return bool(_DEK.fullmatch(head.get("DEK-Info", ""))) and len(key) >= 32 and len(key) % 8 == 0
    return is_der_private_key(key) or is_openssh_private_key(key)


def _pems(text: str) -> Iterator[tuple[str, int, int]]:
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            if is_pem_body(m[2]):
                yield "pem", *m.span()


def _token_start(header: str, claims: str) -> int | None:
    """Where a signed token's header starts: at once, or at a later ``eyJ`` if something is glued before it."""
    if is_signed_token(header, claims):
        return 0
    at = header.find("eyJ", 1)
    while at >= 0:
        tail = header[len(header) - (len(header) - at) % 4 - 4:]
        if (_decoded(tail, True) or b"").rstrip().endswith(b"}") and is_signed_token(header[at:], claims):
            return at
        at = header.find("eyJ", at + 1)
    return None


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at, free = m[0].split("."), m.start(), m.start()
        for header, claims, seal in zip(parts, parts[1:], parts[2:]):
            glued = _token_start(header, claims) if at >= free and header and claims else None
            if glued is not None:
                free = at + len(header) + len(claims) + len(seal) + 2
                yield "jwt", at + glued, free
            at += len(header) + 1


def _keys(digits: str, starts: re.Pattern, size: Callable, reader: Callable, width: Callable[[int], int]) -> Iterator[tuple[int, int]]:
    """Digit spans of the keys in a run: every start is tried, and the length in the key says where it ends."""
    free = 0
    for m in starts.finditer(digits):
        n = size(reader(digits, m.start())) if m.start() >= free else None
        if n is not None:
            free = m.start() + width(n)
            yield m.start(), free


def _in_run(digits: str) -> Iterator[tuple[str, int, int]]:
    """(kind, first, last) in digits of one run: keys in base64 or hex, then what is armoured inside the base64."""
    wide = lambda n: -(-n * 4 // 3)
    for kind, base, hexed, size in (("der", _DER_BASE64, _DER_HEX, der_key_size), ("ssh", _SSH_BASE64, _SSH_HEX, openssh_size)):
        yield from ((kind, a, b) for a, b in _keys(digits, base, size, _from_base64, wide))
        for m in _HEX_RUN.finditer(digits):
            yield from ((kind, m.start() + a, m.start() + b) for a, b in _keys(
                m[0].lower(), hexed, size, _from_hex, lambda n: 2 * n))
    if any(mark in digits for mark in _NESTED):
        for phase in range(4):
            inner = _from_base64(digits, phase)(0, len(digits)).decode("latin-1")
            for kind, a, b in (*_pems(inner), *_tokens(inner)):
                yield kind, phase + a * 4 // 3, min(phase + wide(b), len(digits))


def _runs(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of keys in runs of digits; a run goes on over line ends."""
    for m in _RUN.finditer(text):
        firsts, places, at, pieces = [], [], 0, []
        start = m.start()
        for end, nxt in [*((b.start(), b.end()) for b in _BREAK.finditer(text, *m.span())), (m.end(), m.end())]:
            firsts.append(at)
            places.append(start)
            pieces.append(text[start:end])
            at, start = at + end - start, nxt
        place = lambda i: places[k := bisect_right(firsts, i) - 1] + i - firsts[k]  # noqa: B023, E731
        for kind, a, b in _in_run("".join(pieces).translate(_STANDARD)):
            end = place(b - 1) + 1
            pad = 0
            while pad < (a - b) % 4 and text[end + pad:end + pad + 1] == "=":
                pad += 1
            yield kind, place(a), end + pad


def _structured(text: str, data: bytes) -> Iterator[tuple[str, int, int]]:
    armoured = list(_pems(text))
    yield from armoured
    looks = data.translate(_AS_BASE64)
    if b"1" * 12 in looks and "." in text:
        yield from _tokens(text)
    if b"1" * 40 in looks:
        for kind, a, b in _runs(text):
            if not any(x <= a and b <= y for _, x, y in armoured):
                yield kind, a, b


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    data = text.encode("utf-8", "surrogatepass")
    if b"1" * 24 in data.translate(_AS_HEX):
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += _structured(text, data)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): every row with its spans as array<struct<kind, start, end>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in secret_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[key, "spans"])

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(
        run, f"`{key}` {rows.schema[0].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>")


def span_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, and the base and all spans as joined text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        key, *[of_kind(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"))


def redact(text: str | None) -> str | None:
    """The text with every run of overlapping spans replaced by the name of its first kind."""
    spans = secret_spans(text)
    if not spans:
        return text
    out, at, reach = [], 0, 0
    for kind, start, end in spans:
        if start >= reach:
            out += [text[max(at, reach):start], f"[{kind.upper()} REMOVED]"]
        reach = max(reach, end)
        at = reach
    return "".join(out) + text[reach:]


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets taken out of the texts; a column of lengths follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([redact(t.as_py()) for t in batch.column(text)], pa.string())
            yield batch.set_column(batch.schema.get_field_index(text), text, column)

    out = docs.mapInArrow(run, docs.schema)
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(length).isNotNull(), F.length(F.col(text)).cast(kind)))
    return out.select(*docs.columns)

