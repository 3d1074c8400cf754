"""Secret scan: base patterns, then structural confirmation of encoded candidates.

A candidate in base64, base64url or hex is decoded and parsed; it is reported only if
the bytes have the structure of a key (PEM armour, DER with exactly nested lengths, the
OpenSSH key container) or of a signed token (JSON header naming an algorithm).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order that breaks ties between spans of one start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "jwt")
ORDER = {k: i for i, k in enumerate(KINDS)}


def _either_case(word: str) -> str:
    """ASCII letters in either case, without Unicode's case folding."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of fewer than 24 fails whole, so asking for 24 at once finds the same spans.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Encoded keys start with a SEQUENCE and a version or an algorithm, with the magic of
#: OpenSSH's container, or with the armour of PEM; at least so many digits are asked.
CODE, CODE_LEAST = re.compile(r"[A-Za-z0-9+/_-]+"), 40
CODE_KEY = re.compile(r"M[A-P][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")
HEX_RUN, HEX_LEAST = re.compile(r"[0-9A-Fa-f]+"), 64
HEX_KEY = re.compile(r"30[0-9A-Fa-f]{20}|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100|2[Dd]2[Dd]2[Dd]2[Dd]2[Dd]424547494[Ee]")
PAD = re.compile("={0,2}")
BREAK = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def decode_base64(s: str) -> bytes | None:
    """Bytes of base64 or base64url with or without padding, or None."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill raw[at:end] exactly, or None."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or end - at < k:
                return None
            n = int.from_bytes(raw[at : at + k], "big")
            at += k
            if n < 0x80 or n >> (8 * (k - 1)) == 0:  # DER takes the shortest form
                return None
        if n > end - at:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_der_key(raw: bytes) -> bool:
    """PKCS#1, PKCS#8 (also encrypted) or SEC1 private keys: one SEQUENCE over the
    whole, its items with nested lengths that fit, and the shape of such a key."""
    top = der_items(raw, 0, len(raw)) if raw[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    items = der_items(raw, *top[0][1:])
    if not items:
        return False
    for tag, a, b in items:
        if tag & 0x20 and der_items(raw, a, b) is None:
            return False
    tags = [t for t, _, _ in items]
    if tags[:1] == [2]:
        version = int.from_bytes(raw[items[0][1] : items[0][2]], "big")
        if len(items) >= 9 and all(t == 2 for t in tags[:9]) and version in (0, 1):
            return True  # PKCS#1
        if tags[1:3] == [0x30, 4] and version in (0, 1):
            inner = der_items(raw, *items[1][1:])
            return bool(inner) and inner[0][0] == 6  # PKCS#8: algorithm's OID
        return tags[1:2] == [4] and version == 1 and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC1
    if tags == [0x30, 4]:
        inner = der_items(raw, *items[0][1:])
        return bool(inner) and inner[0][0] == 6 and raw[items[0][1] + 2 : items[0][2]][:7] == b"\x2a\x86\x48\x86\xf7\x0d\x01"  # encrypted PKCS#8
    return False


def openssh_end(raw: bytes) -> int | None:
    """Where a container that starts here ends: the magic, then length-prefixed cipher,
    KDF, options, keys and a private part."""
    magic = b"openssh-key-v1\x00"
    if not raw.startswith(magic):
        return None
    at = len(magic)

    def field() -> int | None:
        nonlocal at
        if len(raw) - at < 4:
            return None
        n = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if n > len(raw) - at:
            return None
        at += n
        return n

    if any(field() is None for _ in range(3)) or len(raw) - at < 4:
        return None
    keys = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 64 and all(field() is not None for _ in range(keys + 1)) else None


def is_openssh_key(raw: bytes) -> bool:
    return openssh_end(raw) == len(raw)


def is_signed_token(s: str) -> bool:
    """Header and payload are JSON objects, the header names an algorithm, and there is
    a signature unless the algorithm is none."""
    head, body, sign = s.split(".")
    try:
        h, b = (json.loads(decode_base64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(h, dict) and isinstance(b, dict) and isinstance(h.get("alg"), str)):
        return False
    return h["alg"].lower() == "none" or len(decode_base64(sign) or b"") >= 16


def key_kind(raw: bytes | None) -> str | None:
    if not raw:
        return None
    return "der" if is_der_key(raw) else "openssh" if is_openssh_key(raw) else None


def der_size(raw: bytes) -> int | None:
    """Bytes of the SEQUENCE that starts here, if it begins as a private key does."""
    k = raw[1] & 0x7F if raw[1] & 0x80 else 0
    if raw[0] != 0x30 or k > 4 or raw[1] == 0x80:
        return None
    body = raw[2 + k :]
    if body[:2] != b"\x02\x01" and body[:1] != b"\x30":
        return None
    return 2 + k + (int.from_bytes(raw[2 : 2 + k], "big") if k else raw[1])


def _joined(text: str, at: int, run: re.Pattern[str], need: int | None) -> list[tuple[int, int]]:
    """The pieces of a run from ``at`` over wrapped lines: all as wide as the first, but
    the last one; no more of them than ``need`` digits take."""
    end = run.match(text, at).end()
    pieces, width, have = [(at, end)], end - at, end - at
    while (need is None or have < need) and (line := BREAK.match(text, end)) and (m := run.match(text, line.end())) and m.end() - m.start() <= width:
        end = m.end()
        pieces.append((m.start(), end))
        have += end - m.start()
        if end - m.start() < width:
            break
    return pieces


def encoded_spans(text: str, start: re.Pattern[str], run: re.Pattern[str], least: int, armoured: list[Span]) -> list[Span]:
    """Keys in base64 or hex at any place of a run, also over wrapped lines. Lines within
    armour that was reported already aren't joined."""
    out: list[Span] = []
    coded = run is CODE

    def decode(code: str) -> bytes | None:
        return decode_base64(code[: len(code) - (len(code) % 4 == 1)]) if coded else bytes.fromhex(code[: len(code) & ~1])

    at = 0
    while m := start.search(text, at):
        at, first = m.start() + 1, decode(m[0])
        size = der_size(first) if first and first[0] == 0x30 else None
        if first is None or (first[0] == 0x30 and size is None):
            continue
        need = None if size is None else (4 * size + 2) // 3 if coded else 2 * size
        pieces = _joined(text, m.start(), run, need)
        if len(pieces) > 1 and any(a <= m.start() < b for a, b, _ in armoured):
            continue
        code = "".join(text[a:b] for a, b in pieces)
        if len(code) < max(need or 0, least) or (need is not None and need < least):
            continue
        raw, kind = decode(code[:need]), None
        if raw is None:
            continue
        if size is not None:
            kind = "der" if is_der_key(raw) else None
        elif (end := openssh_end(raw)) is not None:
            kind, need = "openssh", (4 * end + 2) // 3 if coded else 2 * end
        elif raw.startswith(b"-----BEGIN ") and pem_spans(raw.decode("latin-1")):
            kind, need = "pem", len(code)
        if kind:
            for a, b in pieces:
                at = min(b, a + need)
                need -= at - a
                if not need:
                    break
            if coded:
                at = PAD.match(text, at).end()
            out.append((m.start(), at, kind))
    return out


def pem_spans(text: str) -> list[Span]:
    """Armour around what parses as a key, or with the headers of an enciphered one
    around whole blocks of a cipher. Armour holds no armour, so each is looked through
    up to the next one's begin only."""
    out: list[Span] = []
    begins = [*PEM_BEGIN.finditer(text)]
    for i, m in enumerate(begins):
        mark = f"-----END {m[1]}-----"
        at = text.find(mark, m.end(), begins[i + 1].start() if i + 1 < len(begins) else len(text))
        if at < 0:
            continue
        lines = [x.strip() for x in text[m.end() : at].replace("\\n", "\n").split("\n")]
        heads = dict(x.replace(" ", "").split(":", 1) for x in lines if ":" in x)
        raw = decode_base64("".join(x for x in lines if ":" not in x))
        enciphered = heads.get("Proc-Type") == "4,ENCRYPTED" and "," in heads.get("DEK-Info", "")
        if (enciphered and raw and len(raw) >= 16 and len(raw) % 8 == 0) or key_kind(raw):
            out.append((m.start(), at + len(mark), "pem"))
    return out


def structural_spans(text: str) -> list[Span]:
    out = pem_spans(text) if "-----BEGIN " in text else []
    armoured = list(out)
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[0])]
    out += encoded_spans(text, CODE_KEY, CODE, CODE_LEAST, armoured)
    return out + encoded_spans(text, HEX_KEY, HEX_RUN, HEX_LEAST, armoured)


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(set(spans), key=lambda s: (s[0], ORDER[s[2]], s[1])))


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and the spans that the structure of their bytes confirms."""
    return (base_spans(text), structural_spans(text)) if text else ([], [])


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keep every other column and add n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, ends exclusive. Spans of one start come in the order of
    KINDS, equal ones once. Null and empty texts have no spans (the digest is that of an
    empty string); an empty table gives an empty result. A narrow map over whole texts; repeated rows are
    scanned one by one; input columns with the names of results are replaced.
    """
    new = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    kept = [f for f in docs.schema.fields if f.name not in (*new, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in new]
            for x in b.column(text):
                base, more = scan_text(x.as_py())
                for c, k in zip(cols, BASE_KINDS, strict=False):
                    c.append(sum(s[2] == k for s in base))
                cols[3].append(hashlib.sha256(render(base).encode()).hexdigest())
                cols[4].append(render(base + more))
            arrays = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + arrays, names=[f.name for f in kept] + [*new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.select(*[f"`{f.name}`" for f in kept], text).mapInArrow(run, ", ".join([*fields, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"]))
