"""Secret scan with a recursive decoding worklist.

A document's text is the first layer.  Of every layer all secrets are found, and every encoding in it is
unwrapped to a new layer: percent escapes, \\u \\x \\U and character references (numbers and HTML5 names), base64 (either
alphabet, on one line or over lines of one length), and gzip, zlib, bzip2, xz and zstd streams inside what was unwrapped.
Bytes are read as UTF-8, as UTF-16 where every second one is zero or a mark says so, else as Latin-1.  Layers go on a
worklist until none is new; a layer seen before in the document is not done again, so cycles end.  Each character of a
layer carries the span of the original text it came from, and a finding is reported by that span.

Streams of any size are unpacked whole, in windows of WINDOW bytes that share OVERLAP bytes, and one window at a time
is in memory at each depth.  A secret longer than OVERLAP may be found in two parts.

Defined results: null and empty texts have no findings; texts of any length are scanned whole; a secret found alike in
several layers at the same span is reported once, by the layer found first; rows are scanned each alone, so null or
repeated ids are carried as they are and repeated rows repeat; an empty table gives an empty result; columns but doc_id
and text, whatever their names, are not read; of a stream that ends or breaks too early what is there is scanned, and a
finding of rule ``stream_incomplete`` says so (of zlib, whose head is two letters, where it begins a layer): so does a
stream inside a stream that goes beyond a window.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.runtime import text_batches

WINDOW, OVERLAP = 16 << 20, 1 << 16

#: rule, literals of which one must be there, pattern; the group that matched is the secret; where a pattern has groups
#: and none matched, the match only steps over a run, so that no run is read twice. Secrets have no longest length.
RULES: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    ("cloud_key_id", ("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])")),
    ("assigned_secret", ("=", ":"), re.compile(r"(?i)(?:token|secret(?:[_-]?key)?|(?:api|access|private)[_-]?key|password|passwd|pwd|auth)\\?[\"']?\s*(?::=|=>|[=:])\s*(?:[\"']([^\"'\s]{8,})[\"']|\\?[\"']?([^\"'\s&;]{8,}))")),
    ("private_key", ("PRIVATE KEY",), re.compile(r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----")),
    ("forge_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})(?![A-Za-z0-9])")),
    ("chat_token", ("xox",), re.compile(r"(?<![A-Za-z0-9])(xox[abprs]-[A-Za-z0-9-]{10,})")),
    ("api_key", ("AIza",), re.compile(r"(?<![A-Za-z0-9])(AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])")),
    ("signed_token", ("eyJ",), re.compile(r"(?<![A-Za-z0-9])(?:(eyJ[A-Za-z0-9_-]{4,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,})|eyJ[A-Za-z0-9_-]*)")),
    ("payment_key", ("k_live_",), re.compile(r"(?<![A-Za-z0-9])([sr]k_live_[0-9A-Za-z]{16,})")),
    ("url_password", ("://",), re.compile(r"[A-Za-z0-9+.-]://[^\s:/@]*:([^\s:/@]{3,})@")),
]
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+|&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ONE_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
#: The shortest thing that a rule finds has 12 characters, 16 in base64.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Base64 over lines; _wrapped takes from it what has lines of one length.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"\\r|\\n|([A-Za-z0-9+/_-]+)")
_PACKED = re.compile(r"\x1f\x8b\x08|BZh[1-9]1AY&SY|x[\x01\x5e\x9c\xda]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_LATIN = re.compile(r"[\x00-\xff]+")
_FOUND = T.ArrayType(T.StructType().add("rule", "string").add("start", "integer").add("end", "integer").add("layers", "string").add("digest", "string"))


class Layer:
    """A text and, for each character, where in the original its source starts and ends."""

    def __init__(self, text: str, start: np.ndarray | None, end: np.ndarray | None, path: tuple[str, ...]):
        self.text, self.start, self.end, self.path = text, start, end, path

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        return self.start, self.end

    def replaced(self, parts: list[tuple[int, int, str, list[tuple[int, int]] | None]], kind: str) -> Layer:
        """With spans (from, to) put as other text; sources: spans in this layer of each new character, or None for all of it."""
        start, end = self.ends()
        out, s, e, at = [], [], [], 0
        for a, b, new, sources in parts:
            out += [self.text[at:a], new]
            s.append(start[at:a])
            e.append(end[at:a])
            if sources is None:
                lo, hi = self.span(a, b)
                s.append(np.full(len(new), lo))
                e.append(np.full(len(new), hi))
            else:
                s.append(np.array([start[x:y].min() for x, y in sources], int))
                e.append(np.array([end[x:y].max() for x, y in sources], int))
            at = b
        out.append(self.text[at:])
        s.append(start[at:])
        e.append(end[at:])
        return Layer("".join(out), np.concatenate(s), np.concatenate(e), (*self.path, kind))

    def cut(self, a: int, b: int, new: str, sources: list[tuple[int, int]] | None, kind: str) -> Layer:
        """Only the new text of one span."""
        lo, hi = self.span(a, b)
        if sources is None:
            return Layer(new, np.full(len(new), lo), np.full(len(new), hi), (*self.path, kind))
        start, end = self.ends()
        return Layer(new, np.array([start[x:y].min() for x, y in sources], int), np.array([end[x:y].max() for x, y in sources], int), (*self.path, kind))


def _wide(raw: bytes) -> str | None:
    """The name of the UTF-16 that bytes seem to be."""
    if len(raw) < 8 or len(raw) % 2:
        return None
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if raw[0] == 0xFF else "utf-16-be"
    for name, zeros in (("utf-16-le", raw[1::2]), ("utf-16-be", raw[::2])):
        if 10 * zeros.count(0) >= 6 * len(zeros) and 10 * (raw.count(0) - zeros.count(0)) < len(zeros):
            return name
    return None


def _characters(raw: bytes, where: list[tuple[int, int]] | None) -> tuple[str, list[tuple[int, int]] | None]:
    """Bytes as text; and each character's source, from each byte's."""
    for name in filter(None, (_wide(raw), "utf-8")):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if where is None:
            return text, None
        out, at = [], 0
        for c in text:
            n = len(c.encode(name))
            out.append((where[at][0], where[at + n - 1][1]))
            at += n
        return text, out
    return raw.decode("latin-1"), where


def _percent(layer: Layer) -> Layer | None:
    parts = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m.group().replace("%", ""))
        new, sources = _characters(raw, [(m.start() + 3 * i, m.start() + 3 * i + 3) for i in range(len(raw))])
        parts.append((m.start(), m.end(), new, sources))
    return layer.replaced(parts, "url") if parts else None


def _escaped(layer: Layer) -> Layer | None:
    parts = []
    for m in _ESCAPE.finditer(layer.text):
        if m.group()[0] == "&":
            body = m.group()[2:-1]
            if m.group()[1] != "#":
                if (new := html5.get(m.group()[1:])) is not None:
                    parts.append((m.start(), m.end(), new, [m.span()] * len(new)))
                continue
            code = int(body[1:], 16) if body[0] in "xX" else int(body)
            if code < 0x110000 and not 0xD800 <= code < 0xE000:
                parts.append((m.start(), m.end(), chr(code), [m.span()]))
            continue
        units = [(int(x.group(1) or x.group(2) or x.group(3), 16), m.start() + x.start(), m.start() + x.end()) for x in _ONE_ESCAPE.finditer(m.group())]
        new, sources, i = [], [], 0
        while i < len(units):
            code, a, b = units[i]
            if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
                code, b, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
            new.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
            sources.append((a, b))
            i += 1
        parts.append((m.start(), m.end(), "".join(new), sources))
    return layer.replaced(parts, "unicode") if parts else None


def _wrapped(m: re.Match) -> list[list[tuple[int, int]]]:
    """The spans of lines of blocks in m, all but the first and last of a block of one length; each with and without its last line."""
    lines = [x.span(1) for x in _LINE.finditer(m.string, *m.span()) if x.group(1)]
    out, i = [], 0
    while i + 1 < len(lines):
        size = lambda k: lines[k][1] - lines[k][0]
        # the first line may have lost some of its length to a name before it
        width = max(size(i), size(i + 1))
        j = i + 1
        while j < len(lines) - 1 and size(j) == width:
            j += 1
        if width >= 16 and size(j) <= width:
            out.append(lines[i : j + 1])
        if width >= 16 and j - i > 1:
            out.append(lines[i:j])
        i = max(i + 1, j)
    return out


def _decoded(layer: Layer, lines: list[tuple[int, int]]) -> Layer | None:
    body = "".join(layer.text[a:b] for a, b in lines)
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body.translate(str.maketrans("-_", "+/")) + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        return None
    packed = _PACKED.match(raw[:12].decode("latin-1"))
    at = np.concatenate([np.arange(a, b) for a, b in lines]).tolist()
    where = [(at[i // 3 * 4 + i % 3], at[min(i // 3 * 4 + i % 3 + 1, len(at) - 1)] + 1) for i in range(len(raw))]
    new, sources = (raw.decode("latin-1"), where) if packed else _characters(raw, where)
    return layer.cut(lines[0][0], lines[-1][1], new, sources, "base64")


def _base64(layer: Layer) -> list[Layer]:
    out, done = [], []
    for m in _WRAPPED.finditer(layer.text):
        for lines in _wrapped(m):
            if (not done or done[-1][1] <= lines[0][0]) and (new := _decoded(layer, lines)):
                out.append(new)
                done.append((lines[0][0], lines[-1][1]))
    at = 0
    for m in _BASE64.finditer(layer.text):
        while at < len(done) and done[at][1] <= m.start():
            at += 1
        if at < len(done) and done[at][0] <= m.start():
            continue
        if new := _decoded(layer, [(m.start(), m.start() + len(m.group().rstrip("=")))]):
            out.append(new)
    return out


class Stream:
    """A packed stream at the head of some bytes; once it was read: the bytes used, those given, and whether it came to its end."""

    def __init__(self, raw: memoryview):
        self.raw, self.used, self.given, self.whole = raw, 0, 0, False
        heads = ((b"\x1f\x8b", "gzip"), (b"x", "zlib"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"))
        self.kind = next(name for head, name in heads if raw[: len(head)] == head)

    def pieces(self) -> Iterator[bytes]:
        """The content, in pieces of bounded size; what breaks ends it."""
        self.used = self.given = 0
        try:
            for piece in self._zstd() if self.kind == "zstd" else self._zlib() if self.kind in ("gzip", "zlib") else self._blocks():
                if piece:
                    self.given += len(piece)
                    yield piece
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            self.used = self.used or len(self.raw)

    def _zlib(self) -> Iterator[bytes]:
        d, rest = zlib.decompressobj(31 if self.kind == "gzip" else 15), self.raw
        while rest and not d.eof:
            yield d.decompress(rest, WINDOW)
            rest = d.unconsumed_tail
        self.used, self.whole = len(self.raw) - len(d.unused_data), d.eof

    def _blocks(self) -> Iterator[bytes]:
        d = bz2.BZ2Decompressor() if self.kind == "bzip2" else lzma.LZMADecompressor()
        yield d.decompress(self.raw, WINDOW)
        while not d.eof and not d.needs_input:
            yield d.decompress(b"", WINDOW)
        self.used, self.whole = len(self.raw) - len(d.unused_data), d.eof

    def _zstd(self) -> Iterator[bytes]:
        d, at, some = zstandard.ZstdDecompressor().decompressobj(), 0, 512
        while at < len(self.raw) and not d.eof:
            yield d.decompress(self.raw[at : at + some])
            at += some
        self.used, self.whole = min(at, len(self.raw)) - len(d.unused_data), d.eof

    def windows(self) -> Iterator[str]:
        """The content as text, in windows that overlap."""
        have = bytearray()
        for piece in self.pieces():
            have += piece
            while len(have) > WINDOW + OVERLAP:
                yield self._window(bytes(have[:WINDOW]))
                del have[: WINDOW - OVERLAP]
        if have:
            yield self._window(bytes(have))

    @staticmethod
    def _window(raw: bytes) -> str:
        # a character cut in two at an edge is not the window's
        a = next((i for i in range(min(4, len(raw))) if raw[i] & 0xC0 != 0x80), 0)
        try:
            return raw[a:].decode() if not _wide(raw) else _characters(raw, None)[0]
        except UnicodeDecodeError as e:
            cut = e.reason == "unexpected end of data" and e.end == len(raw) - a
            return _characters(raw[a : a + e.start] if cut else raw, None)[0]


def _packed(layer: Layer) -> tuple[list[Iterator[Layer]], bool]:
    """Layers of the streams in a layer, unpacked as they are asked for; and whether a stream did not come to its end."""
    out, broken = [], False
    for part in _LATIN.finditer(layer.text):
        text, base, at = part.group(), part.start(), 0
        data = memoryview(text.encode("latin-1"))
        while m := _PACKED.search(text, at):
            at = m.end()
            stream = Stream(data[m.start() :])
            for _ in stream.pieces():
                pass
            if stream.given:
                a, b = base + m.start(), base + m.start() + stream.used
                # two letters of a text can look like the head of a zlib stream
                broken |= not stream.whole and (stream.kind != "zlib" or a == 0)
                out.append(_windows(layer, stream, a, b))
                at = max(at, m.start() + stream.used) if stream.whole else at
    return out, broken


def _windows(layer: Layer, stream: Stream, a: int, b: int) -> Iterator[Layer]:
    for text in stream.windows():
        yield layer.cut(a, b, text, None, stream.kind)


def scan_text(text: str | None) -> list[dict]:
    """All findings in a text, in order of place."""
    if not text:
        return []
    work: list[Iterator[Layer]] = [iter([Layer(text, None, None, ())])]
    seen, found = set(), {}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        s, path = layer.text, ">".join(layer.path)
        for rule, needs, pattern in RULES:
            if any(x in s for x in needs):
                for m in pattern.finditer(s):
                    if pattern.groups and not m.lastindex:
                        continue
                    g = m.lastindex or 0
                    a, b = layer.span(*m.span(g))
                    key = (rule, a, b, hashlib.sha256(m.group(g).encode("utf-8", "surrogatepass")).hexdigest())
                    found.setdefault(key, path)
        new = [x for x in ("%" in s and _percent(layer), ("\\" in s or "&" in s) and _escaped(layer)) if x]
        more: list[Iterator[Layer]] = [iter([*new, *_base64(layer)])]
        if layer.path and _PACKED.search(s):
            streams, broken = _packed(layer)
            if broken:
                found.setdefault(("stream_incomplete", *layer.span(0, len(s)), ""), path)
            more += streams
        work += reversed(more)
    return [{"rule": r, "start": a, "end": b, "layers": p, "digest": d} for (r, a, b, d), p in sorted(found.items())]


_KIND = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string()), ("digest", pa.string())]))


@F.arrow_udf(_FOUND)
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([scan_text(t.as_py()) for t in texts], _KIND)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, rule, start, end (in characters of text), layers (encodings unwrapped, outermost first), digest (SHA-256): one row a finding."""
    text_batches(docs.sparkSession)
    return docs.select("doc_id", F.explode(_scan(F.col("text"))).alias("f")).select("doc_id", "f.*")
