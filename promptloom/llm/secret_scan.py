"""Secret scans: patterns find candidates, structure confirms them.

Three base kinds are taken by pattern alone (``assign``, ``access``, ``hex``). Further kinds are
reported only where the decoded bytes hold together:

* ``der``  base64 or base64url (bare or in a PEM block) or hex that decodes to an ASN.1 sequence whose nested
  lengths fill it exactly and whose shape is that of a private key (PKCS#1, PKCS#8, EC);
* ``ssh``  base64, base64url or hex that decodes to an OpenSSH private key with its length-prefixed fields;
* ``jwt``  three base64url parts, the first two JSON objects, the first naming an algorithm.

Bare keys may be wrapped: lines, literals in quotes and ``\\n`` are joined, as are hex bytes set apart by colons,
blanks, commas, ``0x`` or ``\\x``. A key's own lengths say where it ends; there the run must end, or be parted.
A PEM block whose headers say that it is encrypted (``Proc-Type``, ``DEK-Info``) holds ciphertext without a
structure: it is confirmed by headers and base64 and is of the kind ``der``.

A text takes time in proportion to its length: runs of letters and their steps are joined once for all keys that may begin in
them, keys are read by the heads of their parts, and the patterns do not go back over what they have passed. A header of a
PEM block does not hold the mark of another's beginning.

Spans are in code points, end exclusive. Defined results: a null text has no spans, as has an empty
one; whole texts are searched, however long; repeated rows are scanned alike; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows

#: In this order where spans begin at the same place.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE = KINDS[:3]

# The base patterns.
_ASSIGN = re.compile(r"((?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD]))|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of fewer than 16 fails, and runs are maximal

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----((?:(?:\s|\\[nr])*+[A-Z][A-Za-z0-9-]*+:(?:(?!-----BEGIN )[^\n\\])*+(?:\n|\\n))*)([A-Za-z0-9+/=\s\\]{16,}+)-----END \1-----")
_SEALED = re.compile(r"Proc-Type:\s*+4,\s*+ENCRYPTED")
_CIPHER = re.compile(r"DEK-Info:\s*+[A-Za-z0-9-]++,[0-9A-Fa-f]")
#: What may part a wrapped key: a line's end or closed and opened quotes, with what stands around them.
_STEP = rf"(?:\\[rn])?(?:[\"'](?:\s|[,+.\\()])*+[\"']|\\[rn]|[^\S\r\n]*+[\r\n]\s*+)"
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=M|b3Bl)[A-Za-z0-9+/_-]{16}")
_LETTERS = re.compile(rf"(?:{_STEP})?([A-Za-z0-9+/_-]+)")
_HEX_STEP = r"(?:[\"'](?:\s|[,+.\\()])*+[\"']|[:,\s-]|\\[rn]){0,80}(?:0[xX]|\\x)?"
_HEX_KEY = re.compile(rf"(?:(?<![0-9A-Za-z])|(?<=0[xX])|(?<=\\x))(?:30|6[fF](?={_HEX_STEP}70{_HEX_STEP}65))(?={_HEX_STEP}[0-9A-Fa-f]{{2}})")
_BYTES = re.compile(rf"{_HEX_STEP}((?:[0-9A-Fa-f]{{2}})+)")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.ey[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*")
_SSH_MAGIC = b"openssh-key-v1\x00"


#: A key's sequences have at most ten parts (RFC 8017, 5958 and 5915).
MOST_PARTS = 10


def _parts(data, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements that fill ``data[at:end]`` exactly, as (tag, from, to), or None where a length does not fit.

    Only the heads of elements are read, so a long key costs no more than a short one.
    """
    out = []
    while at < end:
        head = data[at : min(end, at + 6)]
        if len(head) < 2 or head[0] & 0x1F == 0x1F or len(out) == MOST_PARTS:
            return None
        size, at = head[1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or 2 + width > len(head) or head[2] == 0:
                return None
            size = int.from_bytes(head[2 : 2 + width], "big")
            at += width
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((head[0], at, at + size))
        at += size
    return out


def is_private_key(data, size: int | None = None) -> bool:
    """Whether the first ``size`` bytes (all, if not given) are one DER sequence of the shape of a PKCS#1, PKCS#8 or EC private key."""
    outer = _parts(data, 0, len(data) if size is None else size)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = _parts(data, *outer[0][1:])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]
    first, second = parts[0][1:], parts[1][1:]
    version = data[first[0] : first[1]] if tags[0] == 0x02 and first[1] - first[0] == 1 else None
    if tags[:3] == [0x02, 0x30, 0x04] and version in (b"\x00", b"\x01"):  # PKCS#8
        algorithm = _parts(data, *second)
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[2][1] < parts[2][2]
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and version in (b"\x00", b"\x01"):  # PKCS#1
        return all(a < b for _, a, b in parts[:9])
    if tags[:2] == [0x02, 0x04] and version == b"\x01" and 16 <= second[1] - second[0] <= 66:  # EC
        return all(t in (0xA0, 0xA1) and _parts(data, a, b) is not None for t, a, b in parts[2:])
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        algorithm = _parts(data, *first)
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key: magic, three strings, a count and as many keys."""
    return _ssh_end(data) == len(data)


def _ssh_end(data) -> int | None:
    """Where an OpenSSH private key at the beginning of ``data`` ends, or None."""
    at = len(_SSH_MAGIC)
    if data[:at] != _SSH_MAGIC:
        return None

    def field() -> int | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return size

    cipher, kdf, options = field(), field(), field()
    if None in (cipher, kdf, options) or not cipher or not kdf:
        return None
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= count <= 16 and all(field() is not None for _ in range(count + 1)) else None


def _key_end(data) -> int | None:
    """Where the key at the beginning of ``data`` ends by its own lengths, or None."""
    head = data[:6]
    if head[:1] != b"\x30":
        return _ssh_end(data)
    size, at = (head[1] if len(head) > 1 else 0), 2
    if size >= 0x80:
        at = 2 + (size & 0x7F)
        size = int.from_bytes(head[2:at], "big") if 2 < at <= 6 else 0
    return at + size if size and at + size <= len(data) else None


def _decoded(text: str, urlsafe: bool = False) -> bytes | None:
    body = text.rstrip("=")
    if urlsafe:
        body = body.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token(text: str) -> bool:
    """Whether three dotted parts are a signed token: JSON header with ``alg``, JSON claims, a signature."""
    head, claims, signature = text.split(".")
    found = []
    for part in (head, claims):
        try:
            found.append(json.loads((_decoded(part, True) or b"").decode()))
        except (ValueError, RecursionError):
            return False
    algorithm = found[0].get("alg") if isinstance(found[0], dict) else None
    if not isinstance(algorithm, str) or not algorithm or not isinstance(found[1], dict):
        return False
    if algorithm.lower() == "none":
        return True
    return bool(signature) and _decoded(signature, True) is not None


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_private_key(data) else "ssh" if is_ssh_key(data) else None


class _Letters:
    """The bytes of base64 letters (a byte in 4/3 of them) from one on; slices decode what they need."""

    def __init__(self, letters: str, begin: int):
        self.letters, self.begin = letters, begin
        self.n = (len(letters) - begin) * 3 // 4
        self.head = b""
        self.head = self[:48]  # most slices lie in it

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.n)
        if b <= len(self.head):
            return self.head[a:b]
        if a >= b:
            return b""
        skip = a // 3
        letters = self.letters[self.begin + 4 * skip : self.begin + -(-4 * b // 3)]
        return _decoded(letters, True)[a - 3 * skip : b - 3 * skip]


class _Digits:
    """The bytes of hex digits from one on."""

    def __init__(self, digits: str, begin: int):
        self.digits, self.begin = digits, begin

    def __len__(self) -> int:
        return (len(self.digits) - self.begin) // 2

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(len(self))
        return bytes.fromhex(self.digits[self.begin + 2 * a : self.begin + 2 * b])


class _Chain:
    """Letters or digits parted by nothing but steps, joined once for all keys that begin among them."""

    def __init__(self, text: str, piece: re.Pattern):
        self.text, self.piece = text, piece
        self.starts: list[int] = []
        self.upto = -1

    def at(self, begin: int) -> int:
        """The place among the joined letters of the one at ``begin`` of the text."""
        if not self.starts or begin >= self.upto:
            self.starts, self.firsts, parts, n, end = [], [], [], 0, begin
            while m := self.piece.match(self.text, end):
                self.starts.append(m.start(1))
                self.firsts.append(n)
                parts.append(m[1])
                n, end = n + len(m[1]), m.end()
            self.upto, self.letters = end, "".join(parts)
        j = bisect_right(self.starts, begin) - 1
        return self.firsts[j] + begin - self.starts[j]

    def end(self, last: int) -> int:
        """Where in the text the letter at that place ends."""
        j = bisect_right(self.firsts, last) - 1
        return self.starts[j] + last - self.firsts[j] + 1


def _kind_at(data) -> tuple[str, int] | None:
    """The kind and the size of the key that ``data`` begins with."""
    size = _key_end(data)
    if not size:
        return None
    if data[:1] == b"\x30":
        return ("der", size) if is_private_key(data, size) else None
    return "ssh", size


def _base64_span(chain: _Chain, begin: int) -> tuple[int, str, int] | None:
    """The key whose base64 begins here, wrapped or not."""
    text, at = chain.text, chain.at(begin)
    got = _kind_at(_Letters(chain.letters, at))
    if not got:
        return None
    kind, size = got
    n = -(-size * 4 // 3)
    end, padding = chain.end(at + n - 1), -n % 4
    if end < len(text) and re.match(r"[A-Za-z0-9+/_-]", text[end]):  # goes on: not this key
        return None
    return begin, kind, end + padding if padding and text[end : end + padding] == "=" * padding else end


def _hex_span(chain: _Chain, begin: int) -> tuple[int, str, int] | None:
    """The key whose hex begins here, parted or not."""
    text, at = chain.text, chain.at(begin)
    got = _kind_at(_Digits(chain.letters, at))
    if not got:
        return None
    kind, size = got
    end = chain.end(at + 2 * size - 1)
    if end < len(text) and text[end].isascii() and text[end].isalnum():
        return None
    return begin - 2 if text[max(0, begin - 2) : begin].lower() in ("0x", "\\x") else begin, kind, end


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    out: list[tuple[int, str, int]] = []
    blocks: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\[nr]|\s", "", m[3])
            head = _SEALED.search(m[2])
            sealed = head and _CIPHER.search(m[2], head.end()) and _decoded(body)
            if kind := "der" if sealed else _key_kind(_decoded(body)):
                out.append((m.start(), kind, m.end()))
                blocks.append(m.span())
    begins = [a for a, _ in blocks]
    for pattern, span, piece in ((_BASE64, _base64_span, _LETTERS), (_HEX_KEY, _hex_span, _BYTES)):
        at, chain = 0, _Chain(text, piece)
        while m := pattern.search(text, at):
            at = m.start() + 1
            inside = bisect_right(begins, m.start())
            if inside and m.start() < blocks[inside - 1][1]:
                continue
            if got := span(chain, m.start()):
                out.append(got)
                at = got[2]
    if ".ey" in text:
        out += [(m.start(), "jwt", m.end()) for m in _JWT.finditer(text) if is_token(m[0])]
    return out


def spans(text: str | None) -> list[tuple[int, str, int]]:
    """All spans as (start, kind, end), by start and then kind."""
    if not text:
        return []
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


DIGEST = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_confirmed", T.LongType())]
)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, a digest of their spans, and all spans."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def make():
        def run(texts):
            found = [spans(t) for t in texts]
            base = [[s for s in f if s[1] in BASE] for f in found]
            out = {f"n_{k}": [sum(s[1] == k for s in f) for f in base] for k in BASE}
            out["base_sha256"] = [hashlib.sha256(_joined(f).encode()).hexdigest() for f in base]
            out["spans"] = [_joined(f) for f in found]
            out["n_confirmed"] = [len(f) - len(b) for f, b in zip(found, base)]
            return out

        return run

    return map_rows(rows, make, "text", DIGEST, ["doc_id"])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans become one mark.

    The columns stay as they are; a column named ``length`` is set to the new number of code points of
    the texts that change.
    """
    into = free_name(docs.columns, "redacted")

    def clean(value: str | None) -> str | None:
        found = spans(value)
        if not found:
            return None
        out, at = [], 0
        for start, _, end in found:
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join([*out, value[at:]])

    def make():
        return lambda texts: {into: [clean(t) for t in texts]}

    changed = map_rows(docs, make, text, T.StructType([T.StructField(into, T.StringType())]))
    new = F.col(f"`{into}`")

    def column(c: str):
        old = F.col(f"`{c}`")
        if c == text:
            return F.coalesce(new, old).alias(c)
        if c == length:
            return F.when(new.isNotNull(), F.length(new).cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old

    return changed.select(*(column(c) for c in docs.columns))
