"""Secret scan with a recursive decoding worklist.

Every layer of a text is scanned for three kinds of secrets (``assign``, ``access``, ``hex``) and searched for
encoded parts: percent escapes and Unicode or character escapes unwrap a whole layer, base64 runs become layers of
their own, and in all decoded bytes gzip, zlib, bzip2, xz and zstandard streams may begin anywhere, with any number of
members. Decoded bytes that aren't UTF-8 are read as Latin-1, and runs of UTF-16 and UTF-32 letters as such. New layers
join the worklist until none appears; layers seen before, by their content and place, are not taken again, so cycles
end, and the worklist is a stack of generators, so that no depth is too deep. Each layer keeps for each of its
characters the span of the original text it came from, and so every finding has a span there, in code points, end
exclusive; what a compressed stream holds has the span of the stream.

What a stream gives is scanned as it comes, in pieces of ``most_bytes`` that overlap by 4 096 bytes and don't part an
encoded run of up to four times that size; streams inside it are fed as it comes, whatever their size.

Cases: null and empty texts have no spans; very long texts are scanned whole; broken streams give what can be read of
them; repeated rows and repeated findings give equal results, a finding of one kind and span is listed once; empty
tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim, whole

#: The patterns of the three kinds, in the order they are listed.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
SHORTEST_VALUE = 6

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|apos|lt|gt|equals|colon|num|percnt);|U\+[0-9A-Fa-f]{4,6}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}(?:\r?\n[A-Za-z0-9+/_-]{12,})*={0,2}")
#: A short line that may end the run before it.
_LAST_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]{1,11})(?![A-Za-z0-9+/_-])={0,2}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_ZLIB = re.compile(rb"[\x08\x18\x28\x38\x48\x58\x68\x78](?!\xb5\x2f\xfd)")
_START = re.compile(_MAGIC.pattern + rb"|" + _ZLIB.pattern)
_WORTH = re.compile(_MAGIC.pattern + rb"|(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|&[#a-z]|U\+|[A-Za-z0-9+/_-]{12}")
#: UTF-16 and UTF-32 of either byte order, with the place of the letter's byte and the bytes a letter.
_WIDE = ((re.compile(rb"(?:[\t\n\r\x20-\xff]\x00){6,}"), 0, 2), (re.compile(rb"(?:\x00[\t\n\r\x20-\xff]){6,}"), 1, 2), (re.compile(rb"(?:[\t\n\r\x20-\xff]\x00\x00\x00){6,}"), 0, 4), (re.compile(rb"(?:\x00\x00\x00[\t\n\r\x20-\xff]){6,}"), 3, 4))
#: What encoded runs are made of.
_ENCODED = bytes([10, 13, *range(33, 127)])
_URLSAFE = str.maketrans("-_", "+/")
_OUT = 1 << 20

FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("base", T.BooleanType())])


def scan(text: str) -> list[tuple[int, int, int]]:
    """Findings of one layer as (start, kind, end): leftmost and non-overlapping for each kind."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= SHORTEST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Place:
    """The span of a compressed stream in the original text; its end is known when the stream has ended."""

    numbers = itertools.count()

    def __init__(self, start: int, end: int):
        self.start, self.end, self.number = start, end, next(Place.numbers)


class Layer:
    """A decoded text; the original span of character i is starts[i] to ends[i], or all one place."""

    __slots__ = ("depth", "ends", "place", "starts", "text")

    def __init__(self, text, starts=None, ends=None, place=None, depth=0):
        self.text, self.starts, self.ends, self.place, self.depth = text, starts, ends, place, depth

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def arrays(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(start, end)
            return at, at + 1
        return self.starts[start:end], self.ends[start:end]


def _utf8(data: bytes) -> tuple[str, list[int]]:
    """Text of ``data``, read as Latin-1 if it isn't UTF-8, and the offset of each character's first byte."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    if len(text) == len(data):
        return text, list(range(len(data) + 1))
    offsets, at = [], 0
    for ch in text:
        offsets.append(at)
        at += len(ch.encode("utf-8"))
    return text, [*offsets, at]


def _percent(token: str, raw: bool) -> tuple[str, list[int]]:
    data = bytes.fromhex(token.replace("%", ""))
    text, offsets = (data.decode("latin-1"), list(range(len(data) + 1))) if raw else _utf8(data)
    return text, [3 * b for b in offsets]


def _escape(token: str, raw: bool) -> tuple[str, list[int]] | None:
    """The text of one match of the escape pattern, and where each character of it begins in the token. raw: bytes stay bytes."""
    try:
        if token[:2] == "\\u" and token[2] != "{":
            units = [int(token[i + 2 : i + 6], 16) for i in range(0, len(token), 6)]
            text, offsets, i = "", [], 0
            while i < len(units):
                offsets.append(6 * i)
                if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                    text += chr(0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00)
                    i += 2
                else:
                    text += "�" if 0xD800 <= units[i] < 0xE000 else chr(units[i])
                    i += 1
            return text, [*offsets, len(token)]
        if token[:2] == "\\x":
            data = bytes.fromhex(token.replace("\\x", ""))
            text, offsets = (data.decode("latin-1"), list(range(len(data) + 1))) if raw else _utf8(data)
            return text, [4 * b for b in offsets]
        if raw and token[:2] == "&#":  # a page would show a letter of Windows in the place of some bytes
            code = int(token[2:-1].lstrip("xX"), 16 if token[2] in "xX" else 10)
            return (chr(code), [0, len(token)]) if code < 256 else None
        if token[0] == "&":
            text = html.unescape(token)
            return None if text == token else (text, [*[0] * len(text), len(token)])
        code = int(token.strip("\\uU+{}"), 16)
        return None if 0xD800 <= code < 0xE000 else (chr(code), [0, len(token)])
    except (ValueError, OverflowError):
        return None


def _unwrapped(layer: Layer, pattern: re.Pattern, decode, raw: bool = False) -> Layer | None:
    """The whole layer with each match of ``pattern`` decoded; None if nothing changes."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m.group(), raw)
        if not got:
            continue
        text, offsets = got
        if layer.place:
            parts += [layer.text[at : m.start()], text]
            at = m.end()
            continue
        if m.start() > at:
            s, e = layer.arrays(at, m.start())
            parts.append(layer.text[at : m.start()])
            starts.append(s)
            ends.append(e)
        s, e = layer.arrays(m.start(), m.end())
        bounds = [(offsets[i], max(offsets[i + 1], offsets[i] + 1)) if offsets[i] < offsets[i + 1] else (0, len(s)) for i in range(len(text))]
        parts.append(text)
        starts.append(np.array([s[a:b].min() for a, b in bounds], dtype=np.int64))
        ends.append(np.array([e[a:b].max() for a, b in bounds], dtype=np.int64))
        at = m.end()
    if not at:
        return None
    if layer.place:
        return Layer("".join(parts) + layer.text[at:], place=layer.place, depth=layer.depth + 1)
    if at < len(layer.text):
        s, e = layer.arrays(at, len(layer.text))
        parts.append(layer.text[at:])
        starts.append(s)
        ends.append(e)
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends), depth=layer.depth + 1)


def _stream_at(data: bytes | memoryview, at: int) -> bool:
    """Whether a compressed stream may begin there."""
    head = bytes(data[at : at + 10])
    if _ZLIB.match(head):
        return len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0 and not head[1] & 32
    return bool(_MAGIC.match(head))


class Stream:
    """Compressed bytes fed piece by piece: members and frames that follow each other, of any kind, are one stream.

    ``used`` counts the bytes that belong to it; ``over`` is set behind its last member or at the first fault.
    """

    def __init__(self) -> None:
        self.machine = self.read = None
        self.used = 0
        self.begun = self.over = self.whole = False
        self.held = b""

    def _open(self, head: bytes) -> None:
        if head[:2] == b"\x1f\x8b" or _ZLIB.match(head):
            self.machine, self.read, self.slice = zlib.decompressobj(47), lambda x: self.machine.decompress(x, _OUT), 1 << 14
        elif head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00":
            self.machine = bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor()
            self.read, self.slice = lambda x: self.machine.decompress(x, _OUT), 1 << 14
        else:
            self.machine = zstandard.ZstdDecompressor().decompressobj()
            self.read, self.slice = self.machine.decompress, 256  # it gives all it has at once

    def chunks(self, data: bytes | memoryview, last: bool) -> Iterator[bytes]:
        """What more of its bytes give, in chunks of bounded size; ``last`` says that no more bytes follow."""
        if self.held:
            data, self.held = self.held + bytes(data), b""
        rest = memoryview(data)
        try:
            while not self.over and (len(rest) or (self.machine and last)):
                if self.machine is None:
                    skip = next((i for i in range(len(rest)) if rest[i]), len(rest)) if self.begun else 0  # padding between members
                    if len(rest) - skip < 10 and not last:
                        self.held = bytes(rest)
                        return
                    if not _stream_at(rest, skip):
                        self.over = True
                        return
                    self.used += skip
                    rest = rest[skip:]
                    self._open(bytes(rest[:10]))
                    self.begun = True
                if not len(rest):
                    return
                part = rest[: self.slice]
                rest = rest[self.slice :]
                while True:
                    out = self.read(part)
                    if out:
                        yield out
                    if self.machine.eof:
                        self.whole = True
                        back = len(self.machine.unused_data)
                        self.used += len(part) - back
                        rest = memoryview(bytes(part[len(part) - back :]) + bytes(rest)) if back else rest
                        self.machine = None
                        break
                    tail = getattr(self.machine, "unconsumed_tail", b"")
                    if tail:
                        self.used += len(part) - len(tail)
                        part = tail
                    elif getattr(self.machine, "needs_input", True) and not (isinstance(out, bytes) and len(out) == _OUT):
                        self.used += len(part)
                        break
                    else:
                        self.used += len(part)
                        part = b""
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            self.over = True


class _Search:
    """The worklist of one text: generators of generators on a stack of its own, so that no depth of layers is too deep, and of every layer only one piece is in memory."""

    def __init__(self, most: int):
        self.most = most
        self.seen: set[bytes] = set()
        self.spans: dict[tuple[int, int, int], int] = {}
        self.placed: dict[tuple[int, int], tuple[Place, int]] = {}

    def run(self, layer: Layer) -> None:
        stack = [self.layer(layer)]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
            else:
                stack.append(step)

    def found(self) -> dict[tuple[int, int, int], int]:
        for (kind, _), (place, depth) in self.placed.items():
            key = (place.start, kind, place.end)
            self.spans[key] = min(self.spans.get(key, depth), depth)
        return self.spans

    def new(self, content: bytes | memoryview, mark: str) -> bool:
        """Whether content was not met before at the place that ``mark`` names."""
        key = hashlib.blake2b(content, digest_size=16, key=hashlib.blake2b(mark.encode(), digest_size=16).digest()).digest()
        if key in self.seen:
            return False
        self.seen.add(key)
        return True

    def layer(self, layer: Layer) -> Iterator[Iterator]:
        text = layer.text
        if not text:
            return
        if layer.depth:
            mark = f"text {layer.place.number}" if layer.place else f"text {layer.span(0, len(text))}"
            if not self.new(text.encode("utf-8", "surrogatepass"), mark):
                return
        for start, kind, end in scan(text):
            if layer.place:
                self.placed.setdefault((kind, layer.place.number), (layer.place, layer.depth))
            else:
                place = layer.span(start, end)
                found = (place[0], kind, place[1])
                self.spans[found] = min(self.spans.get(found, layer.depth), layer.depth)
        for pattern, decode, marks in ((_PERCENT, _percent, "%"), (_ESCAPE, _escape, ("\\", "&", "U+"))):
            if any(m in text for m in marks) and (made := _unwrapped(layer, pattern, decode)):
                yield self.layer(made)
                raw = _unwrapped(layer, pattern, decode, True) if pattern is _PERCENT or "\\x" in text or "&#" in text else made
                if raw:
                    yield self.streams(raw.text.encode("latin-1", "replace"), raw)
        yield from self.base64(layer)

    def streams(self, data: bytes, layer: Layer) -> Iterator[Iterator]:
        """Compressed streams that begin anywhere in the bytes of a layer, one character a byte."""
        view = memoryview(data)
        at = taken = 0  # inside what a stream took that ended in a fault only sure beginnings count
        while m := (_MAGIC if at < taken else _START).search(data, at):
            if at < taken <= m.start():
                at = taken
                continue
            at = m.start()
            stream = Stream() if _stream_at(view, at) else None
            if stream is None or not _alive(view[at:]) or not self.new(view[at:], f"stream {layer.place.number if layer.place else (layer.span(at, len(data)))}"):
                at += 1
                continue
            place = layer.place or Place(*layer.span(at, len(data)))
            yield self.fed(stream, [(view[at:], True)], place, layer.depth + 1)
            if not layer.place and stream.used:
                place.end = layer.span(at, at + stream.used)[1]
            if stream.whole:
                at += stream.used
            else:
                taken = max(taken, at + stream.used)
                at += 1

    def fed(self, stream: Stream, pieces, place: Place, depth: int) -> Iterator[Iterator]:
        """A whole stream: its content goes through an outlet chunk by chunk."""
        outlet = _Outlet(self, place, depth)
        for data, last in pieces:
            for chunk in stream.chunks(data, last):
                yield outlet.take(chunk)
        yield outlet.close()

    def base64(self, layer: Layer) -> Iterator[Iterator]:
        for m in _BASE64.finditer(layer.text):
            run = m.group()
            pieces = [(0, run)]
            if "\n" in run:
                at = 0
                for line in run.split("\n"):
                    pieces.append((at, line))
                    at += len(line) + 1
            last = None if run.endswith("=") else _LAST_LINE.match(layer.text, m.end())
            # Wrapped base64 ends so, but another word can follow too: both are tried, but for a number of letters that base64 can't have.
            if last and (len(re.sub(r"\s", "", run)) + len(last[1])) % 4 != 1:
                pieces.append((0, run + last.group()))
            for base, piece in pieces:
                letters = piece.rstrip("=\r\n")
                wrapped = "\n" in letters or "\r" in letters
                if wrapped:
                    letters = letters.replace("\n", "").replace("\r", "").replace("=", "")
                letters = letters.translate(_URLSAFE)
                for skip in range(min(4, len(letters) - 11)):
                    size = len(letters) - skip
                    size -= size % 4 == 1
                    try:
                        data = base64.b64decode(letters[skip : skip + size] + "=" * (-size % 4))
                    except (binascii.Error, ValueError):
                        break
                    if _worth(data):
                        yield self.data(data, layer, m.start() + base, piece if wrapped else None, skip, size)

    def data(self, data: bytes, layer: Layer, begin: int, piece: str | None, skip: int, size: int) -> Iterator[Iterator]:
        """What decoded base64 holds: streams, text of two bytes a character, and text. piece: the letters with line ends between."""
        if layer.place:
            raw = Layer("", place=layer.place, depth=layer.depth)
        else:
            quad = np.arange(len(data)) // 3 * 4 + skip
            to = np.minimum(quad + 3, skip + size - 1)
            if piece is not None:
                letters = np.flatnonzero(~np.isin(np.frombuffer(piece.encode("ascii"), np.uint8), np.frombuffer(b"\r\n=", np.uint8)))
                quad, to = letters[quad], letters[to]
            s, e = layer.arrays(begin, begin + int(to[-1]) + 1)
            raw = Layer("", s[quad], e[to], depth=layer.depth)
        yield self.streams(data, raw)
        yield from self.wide(data, raw)
        text, offsets = _utf8(data)
        if layer.place:
            yield self.layer(Layer(text, place=layer.place, depth=layer.depth + 1))
        else:
            at = np.array(offsets[:-1], dtype=np.int64)
            yield self.layer(Layer(text, raw.starts[at], raw.ends[np.array(offsets[1:], dtype=np.int64) - 1], depth=layer.depth + 1))

    def wide(self, data: bytes, raw: Layer) -> Iterator[Iterator]:
        """Runs of UTF-16 and UTF-32 letters in the bytes of a layer."""
        full = np.frombuffer(data, np.uint8) != 0 if b"\0" in data else np.ones(0, bool)
        bare = ~full
        steps = {2} if (full[:-3] & bare[1:-2] & full[2:-1] & bare[3:]).any() else set()
        steps |= {4} if (full[:-4] & bare[1:-3] & bare[2:-2] & bare[3:-1] & full[4:]).any() else set()
        for pattern, first, step in _WIDE:
            for m in pattern.finditer(data) if step in steps else ():
                text = m.group()[first::step].decode("latin-1")
                if raw.place:
                    yield self.layer(Layer(text, place=raw.place, depth=raw.depth + 1))
                else:
                    at = np.arange(m.start(), m.end(), step)
                    yield self.layer(Layer(text, raw.starts[at], raw.ends[at + step - 1], depth=raw.depth + 1))


class _Outlet:
    """Takes what a stream gives out: scans it piece by piece, and feeds a stream that begins in it, however long that is."""

    def __init__(self, search: _Search, place: Place, depth: int):
        self.search, self.place, self.depth = search, place, depth
        self.parts: list[bytes] = []
        self.size = 0
        self.inner: Stream | None = None
        self.outlet: _Outlet | None = None

    def take(self, chunk: bytes) -> Iterator[Iterator]:
        yield self.nested(chunk, False)
        self.parts.append(chunk)
        self.size += len(chunk)
        if self.size >= self.search.most:
            yield self.scanned(False)

    def close(self) -> Iterator[Iterator]:
        yield self.nested(b"", True)
        yield self.scanned(True)

    def nested(self, chunk: bytes, last: bool) -> Iterator[Iterator]:
        """Streams inside the stream; one that begins in the last bytes of a chunk is seen with the next."""
        data = self.head + chunk if (self.head) else chunk
        self.head = b""
        at = 0
        while True:
            if self.inner:
                before = self.inner.used
                for out in self.inner.chunks(memoryview(data)[at:], last):
                    yield self.outlet.take(out)
                if not self.inner.over and not last:
                    return
                yield self.outlet.close()
                at += max(1, self.inner.used - before)
                self.inner = self.outlet = None
            m = _START.search(data, at)
            if not m:
                self.head = b"" if last else data[max(at, len(data) - 9) :]
                return
            at = m.start()
            if len(data) - at < 64 and not last:
                self.head = data[at:]
                return
            view = memoryview(data)[at:]
            if _stream_at(view, 0) and _alive(view) and self.search.new(view, f"stream {self.place.number}"):
                self.inner, self.outlet = Stream(), _Outlet(self.search, self.place, self.depth + 1)
            else:
                at += 1

    head = b""

    def scanned(self, last: bool) -> Iterator[Iterator]:
        """All that was taken so far, but for an encoded run at its end that may go on; the last bytes are scanned again with what follows."""
        data = b"".join(self.parts)
        kept = b""
        if not last:
            kept = data[min(len(data.rstrip(_ENCODED)), max(0, len(data) - 4096)) :]
            if 2 * len(kept) > self.search.most:
                if len(data) < 4 * self.search.most:
                    self.parts = [data]
                    return
                kept = data[-4096:]
        self.parts, self.size = [kept], len(kept)
        if not data or not self.search.new(data, f"piece {self.place.number}"):
            return
        raw = Layer("", place=self.place, depth=self.depth)
        yield from self.search.wide(data, raw)
        yield self.search.layer(Layer(data.decode("utf-8", "replace"), place=self.place, depth=self.depth))


def _alive(data: memoryview) -> bool:
    """Whether the first bytes of what may be a stream make sense to its decompressor."""
    stream = Stream()
    for _ in stream.chunks(data[:1024], False):
        return True
    return not stream.over


def _worth(data: bytes) -> bool:
    """Whether decoded bytes can hold a finding or another layer."""
    return b"\0" in data or bool(_WORTH.search(data)) or any(_stream_at(data, m.start()) for m in _ZLIB.finditer(data) if len(data) - m.start() > 12)


def find(text: str | None, most_bytes: int = 1 << 22) -> list[tuple[str, int, int, int, bool]]:
    """All findings of a text as (kind, start, end, depth, base), by start, kind and end."""
    if not text:
        return []
    search = _Search(most_bytes)
    search.run(Layer(text))
    return [(KINDS[kind], start, end, depth, depth == 0) for (start, kind, end), depth in sorted(search.found().items())]


def findings(text: Column, most_bytes: int = 1 << 22) -> Column:
    """An array of (kind, start, end, depth, base) for a text column."""

    @F.arrow_udf(T.ArrayType(FOUND))
    def found(column: pa.Array) -> pa.Array:
        rows = [[dict(zip(FOUND.names, f, strict=True)) for f in find(x, most_bytes)] for x in column.to_pylist()]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("base", pa.bool_())])
        return pa.array(rows, pa.list_(kind))

    return found.asNondeterministic()(whole(text))


def as_text(found: Column) -> Column:
    """kind:start:end of an array of findings, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _covered(value: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``value`` with each run of overlapping spans replaced by one mark."""
    parts, end = [], 0
    for start, stop in sorted(spans):
        if start >= end:
            parts += [value[end:start], mark]
        end = max(end, stop)
    return "".join(parts) + value[end:]


def masked(text: Column, mark: str = "[SECRET]", most_bytes: int = 1 << 22) -> Column:
    """The text with every finding replaced by ``mark``; overlapping findings become one mark; null stays null."""

    @F.arrow_udf("string")
    def replaced(column: pa.Array) -> pa.Array:
        trim()
        out = []
        for x in column:
            value = x.as_py()
            found = find(value, most_bytes)
            out.append(_covered(value, [(f[1], f[2]) for f in found], mark) if found else value)
        return pa.array(out, pa.string())

    return replaced.asNondeterministic()(text)
