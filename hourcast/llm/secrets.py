r"""Secret scan with structural confirmation.

Base kinds come from patterns alone: ``assign`` (a named value), ``access`` (an
access key id), ``hex`` (a run of hexadecimal digits).  Further kinds are
reported only when what they encode has the structure it must have:

* ``pem``: an armoured key whose base64 body decodes to nested DER lengths
  that fill it, or to an ``openssh-key-v1`` envelope;
* ``jwt``: three base64url parts, the first a JSON object with ``alg``, the
  second a JSON object, the third a signature of a size (none for alg none);
* ``ssh``: a run that decodes to length-prefixed fields which fill it, the
  first a key type, or to an ``openssh-key-v1`` envelope;
* ``der``: a run that decodes to a DER sequence of a private key, every nested
  length in place.

A run is base64, base64url or hexadecimal (RUN_BASE64 or RUN_HEX letters at
least), on one line or wrapped, the first line of FIRST_LINE letters at least.
Each is decoded once, whatever it begins with; a run whose bytes hold an
armoured key counts as ``pem``.  A key may take some of the lines of a run, as
its own lengths say.  What lies in a ``pem`` span is not reported again.

Spans are kind:start:end in code points of the whole text, end exclusive, over
the whole match.  Null and empty texts have no spans.  Each row is scanned by
itself, so repeated rows and null ids give rows of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hourcast.llm.common import ship

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# no armour begins inside another: a lone first line must not hide the key after it
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([^-]*+(?:-(?!----BEGIN )[^-]*+)*?)-----END \1-----")
# what source text and JSON write for a line break, a slash or another character, and between parts of a string
BREAK = re.compile(r"\\+[nrt]|\\+\r?\n")
ESCAPED = re.compile(r"\\+(?:u00([0-9A-Fa-f]{2})|(?=/))")
JOIN = re.compile(r"""\\*["'`]\s*[+.,&]?\s*\\*["'`]""")
# a line break between quoted strings, a written one, or a plain one
WRAP = r"""(?:(?:\\+[nrt])*\\*["'][ \t]*[+.,&]?[ \t]*\\?\r?\n[ \t]*[+.,&]?[ \t]*\\*["']|(?:\\+[nrt])+[ \t]*|[ \t]*\\*\r?\n[ \t]*)"""
# what JSON can begin with: a brace, white space, a byte order mark
JWT = re.compile(r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))((?:e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f]|77u_)[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
FIRST_LINE, RUN_BASE64, RUN_HEX = 16, 40, 60
KINDS = ["assign", "access", "hex", "pem", "jwt", "ssh", "der"]
BASE = KINDS[:3]
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")
#: Fields of a public key by its type; others have two at least.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
ENVELOPE = b"openssh-key-v1\0"
#: Bytes that show what a run may be: an envelope's mark, the longest key type.
HEAD = 48
SIGNATURE_BYTES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114), "none": (0,)}
NESTED = 16


def unbase64(text: str, url: bool = False) -> bytes | None:
    body = text.rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def unhex(text: str) -> bytes | None:
    return None if len(text) % 2 else bytes.fromhex(text)


@dataclass(frozen=True)
class Code:
    """Runs of some letters; ``letters`` of them stand for ``size`` bytes."""

    of: str
    least: int
    letters: int
    size: int
    decode: Callable[[str], bytes | None]

    @cached_property
    def run(self) -> re.Pattern:
        return re.compile(rf"[{self.of}]{{{FIRST_LINE},}}+(?:{WRAP}[{self.of}]++)*+=?=?")

    @cached_property
    def line(self) -> re.Pattern:
        return re.compile(rf"([{self.of}]++)(?:{WRAP})?")

    def width(self, n: int) -> int:
        return -(-n * self.letters // self.size)

    def begin(self, text: str) -> bytes:
        """The bytes of ``text``, without a letter left over."""
        return self.decode(text[: len(text) - (len(text) % self.letters == 1)]) or b""


CODES = [
    Code("A-Za-z0-9+/", RUN_BASE64, 4, 3, unbase64),
    Code("A-Za-z0-9_-", RUN_BASE64, 4, 3, partial(unbase64, url=True)),
    Code("0-9A-Fa-f", RUN_HEX, 2, 1, unhex),
]


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The items that fill ``data`` exactly, nested ones checked as well; None if lengths don't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            n, at = int.from_bytes(data[at : at + more], "big"), at + more
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        body, at = data[at : at + n], at + n
        if tag & 0x20 and (depth == NESTED or der_items(body, depth + 1) is None):
            return None
        out.append((tag, body))
    return out


def is_private_der(data: bytes) -> bool:
    """A sequence that opens as a private key does: a small version, then integers, a name of an algorithm, or the key's bytes."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(top[0][1]) or []
    tags = [t for t, _ in inner]
    if len(inner) >= 3 and tags[0] == 0x02 and len(inner[0][1]) == 1 and inner[0][1][0] <= 1:
        return tags[1] == 0x30 and tags[2] == 0x04 or tags[1] == 0x04 or len(inner) >= 5 and set(tags[:5]) == {0x02}
    # an encrypted key: its algorithm, then the bytes
    return tags == [0x30, 0x04] and (der_items(inner[0][1]) or [(0, b"")])[0][0] == 0x06


def ssh_fields(data: bytes) -> list[bytes] | None:
    out, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return None
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at + n > len(data):
            return None
        out.append(data[at : at + n])
        at += n
    return out


def is_ssh(data: bytes) -> bool:
    fields = ssh_fields(data)
    return bool(fields) and len(fields) >= 2 and fields[0] in SSH_TYPES


def unescaped(body: str) -> str:
    """``body`` as the string holds it that JSON or source text writes so."""
    body = BREAK.sub("\n", body)
    return JOIN.sub("\n", ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else "", body))


def is_envelope(data: bytes) -> bool:
    return data.startswith(ENVELOPE)


def is_pem(body: str) -> bool:
    body = unescaped(body)
    lines = [x for x in body.strip().splitlines() if ":" not in x]  # without the headers of old armours
    encrypted = "ENCRYPTED" in body
    data = unbase64("".join("".join(lines).split()))
    if not data or len(data) < 16:
        return False
    return is_envelope(data) or is_private_der(data) or encrypted and len(data) % 8 == 0


def is_jwt(head: str, claims: str, signature: str) -> bool:
    parts = []
    for x in (head, claims):
        try:
            parts.append(json.loads(unbase64(x, url=True) or b""))
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(x, dict) for x in parts) or not isinstance(alg := parts[0].get("alg"), str):
        return False
    got = unbase64(signature, url=True) if signature else b""
    return got is not None and (len(got) in SIGNATURE_BYTES[alg] if alg in SIGNATURE_BYTES else len(got) >= 16)


def sizes(head: bytes, peek: Callable[[int], int | None]) -> Iterator[int]:
    """How many bytes a key that begins with ``head`` may take, by its own lengths; ``peek`` gives the number at a place."""
    if head[:1] == b"\x30" and len(head) > 6:
        more = head[1] & 0x7F if head[1] >= 0x80 else 0
        if more <= 4:
            yield 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
    elif is_envelope(head):
        at, left, counted = len(ENVELOPE), 3, False  # cipher, its key's derivation and options; a number of keys; those and the private part
        while left and (n := peek(at)) is not None:
            at, left = at + 4 + n, left - 1
            if not left and not counted and (keys := peek(at)) is not None:
                at, left, counted = at + 4, keys + 1, True
        if counted and not left:
            yield at
    elif head[:3] == b"\0\0\0" and len(head) > 4 and (kind := head[4 : 4 + head[3]]) in SSH_TYPES:
        at = fields = 0
        while (n := peek(at)) is not None:
            at, fields = at + 4 + n, fields + 1
            if fields >= SSH_FIELDS.get(kind, 2):
                yield at


def kind_of(data: bytes | None) -> int | None:
    if not data:
        return None
    return 5 if is_ssh(data) or is_envelope(data) else 6 if is_private_der(data) else None


def keys(lines: list[str], code: Code) -> Iterator[tuple[int, int, int]]:
    """(first line, kind, last line) of what the lines of a run encode."""
    whole, bounds = "".join(lines), [0, *accumulate(map(len, lines))]
    place = {b: k for k, b in enumerate(bounds)}
    # armoured keys inside: lines before them may shift the groups of letters
    starts = {bounds[k] % code.letters: k for k in range(len(lines) - 1, -1, -1)}
    for k in starts.values():
        data = code.begin(whole[bounds[k] :])
        if b"PRIVATE KEY-----" in data:
            for m in PEM.finditer(data.decode("latin-1")):
                if is_pem(m[2]):
                    yield bisect_right(bounds, bounds[k] + m.start() // code.size * code.letters) - 1, 3, bisect_left(bounds, bounds[k] + code.width(m.end())) - 1
    k = 0
    while k < len(lines):
        off = bounds[k]

        def peek(at: int, off: int = off) -> int | None:
            a = off + at // code.size * code.letters
            data = code.begin(whole[a : a + 4 * code.letters])[at % code.size :][:4]
            return int.from_bytes(data, "big") if len(data) == 4 else None

        head = code.begin(whole[off : off + code.width(HEAD)])
        last = kind = None
        if head[:1] == b"\x30" or head[:4] == ENVELOPE[:4] or head[:3] == b"\0\0\0":
            if kind := kind_of(code.decode(lines[k])):
                last = k
            for n in sizes(head, peek):
                if (end := place.get(off + code.width(n))) is not None and end > k and (found := kind_of(code.decode(whole[off : bounds[end]]))):
                    last, kind = end - 1, found
                    break
        if kind:
            yield k, kind, last
            k = last
        k += 1


def encoded(text: str) -> set[tuple[int, int, int]]:
    """Spans of base64, base64url and hexadecimal runs that decode to keys."""
    out = set()
    for code in CODES:
        for m in code.run.finditer(text):
            if m.end() - m.start() < code.least:
                continue
            start = m.start()
            if text[start] in "nrt" and text[start - 1 : start] == "\\":  # of a written line break
                start += 1
            pieces = list(code.line.finditer(text, start, m.end()))
            lines = [x[1] for x in pieces]
            if sum(map(len, lines)) < code.least:
                continue
            for a, kind, b in keys(lines, code):
                out.add((pieces[a].start(), kind, m.end() if b == len(lines) - 1 else pieces[b].end(1)))
    return out


def outermost(spans: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Those that lie in no other of their kind and in no ``pem``."""
    out, reach = set(), {}
    for a, kind, b in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
        if b > max(reach.get(kind, 0), reach.get(3, 0)):
            out.add((a, kind, b))
            reach[kind] = b
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 3, m.end()) for m in PEM.finditer(text) if is_pem(m[2])]
    out += [(m.start(), 4, m.end()) for m in JWT.finditer(text) if is_jwt(*m.groups())]
    armoured = {x for x in out if x[1] == 3}
    out += outermost(armoured | encoded(text)) - armoured
    return sorted(out)


def digest_line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id long, kinds array<string>, starts array<long>, ends array<long>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, starts, ends): the spans of each row, in order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [scan(t) if t else [] for t in map(pa.StringScalar.as_py, batch.column("text"))]
            columns = [[[KINDS[k] for _, k, _ in s] for s in spans], [[a for a, _, _ in s] for s in spans], [[b for _, _, b in s] for s in spans]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True))],
                names=["doc_id", "kinds", "starts", "ends"],
            )

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(each, FOUND)


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def op1_secret_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                spans = [(a, KINDS.index(k), b) for k, a, b in zip(r["kinds"], r["starts"], r["ends"], strict=True)]
                n = [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))]
                base = digest_line([s for s in spans if s[1] < len(BASE)])
                rows.append((r["doc_id"], *n[:3], hashlib.sha256(base.encode()).hexdigest(), digest_line(spans), sum(n[3:])))
            names = [x.split()[0] for x in OUT.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    return find(docs).mapInArrow(digest, OUT)
