"""Secret scanning with a recursive decoding worklist.

A text is scanned as it stands.  Its URL and Unicode escapes are then decoded in place, and its
base64 stretches, in each of the four alignments, and compressed streams are unwrapped; every
layer so gained is scanned and unwrapped in turn until none gives a new one.  A layer that equals
one of its own ancestors ends its chain, so encodings that unwrap to themselves end, while an
encoding that is repeated is followed wherever it stands.  A layer knows its parent and how its
characters lie in it, by arithmetic or by a list of its escapes, so no map is held per character.

Decoded bytes are read one character a byte: all that is searched for is ASCII, which other bytes
only separate, so a byte that is no text spoils nothing around it.

Escapes of escapes are decoded level by level ``LEVELS`` times; what is left is then decoded in one
pass, in which each character that completes an escape is taken up at once.  A compressed stream is
read in windows that overlap, one at a time, however long it is.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
LEVELS = 8
WINDOW, OVERLAP, PIECE = 4 << 20, 1 << 16, 1 << 18  # bytes of a stream held at once, held again, unpacked at once
# Fixed value: the most that a byte of a gzip or zlib stream stands for.
EXPANSION = 1032
LEAST_INFLATED = 64 << 20  # bytes that any text's streams may hold
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORD_KEYS = ("passw", "secret", "token", "api_key", "apikey")
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U(0010[0-9A-Fa-f]{4}|000[0-9A-Fa-f]{5})|u\{(10[0-9A-Fa-f]{4}|0{0,3}[0-9A-Fa-f]{1,5})\})")
_AT_END = re.compile(f"(?:{_ESCAPE.pattern})$")
_ENDS = frozenset("0123456789abcdefABCDEF}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]")
_NOT_BASE64 = str.maketrans("", "", "\r\n \t")


@dataclass
class Layer:
    """``locate(a, b)`` gives the stretch of the parent's text from which ``text[a:b]`` comes."""

    text: str
    parent: Layer | None = None
    locate: Callable[[int, int], tuple[int, int]] | None = None
    packed: Stretch | None = None  # of bytes, which may themselves hold a compressed stream
    level: int = 0  # how often escapes have been decoded above

    def source(self, a: int, b: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            a, b = layer.locate(a, b)
            layer = layer.parent
        return a, b

    def repeats(self) -> bool:
        above = self.parent
        while above is not None:
            if len(above.text) == len(self.text) and above.text == self.text:
                return True
            above = above.parent
        return False


@dataclass
class Stretch:
    """Bytes of a stream from ``start`` on; ``source`` gives the stream again from its beginning."""

    data: bytes
    start: int
    last: bool
    source: Callable[[], Iterator[bytes]]
    done: list[int]  # up to where streams inside it have been read, for all its stretches


class Allowance:
    """What may still be unpacked for one text, and the streams that went beyond it.

    No single gzip or zlib stream does: only bytes packed several times over, or a bzip2 stream of
    equal bytes, can stand for more."""

    def __init__(self, size: int):
        self.left, self.cut = size, set()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base kinds in one layer, leftmost and not overlapping per kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _WORD_KEYS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def unescaped(layer: Layer) -> Layer | None:
    """The layer with its URL and Unicode escapes decoded in place."""
    text = layer.text
    if "%" not in text and "\\" not in text:
        return None
    if layer.level >= LEVELS and _ESCAPE.search(text):
        return settled(layer)
    out, new, end, at, size = [], [], [], 0, 0  # per escape: place in the new text, end in the old
    for m in _ESCAPE.finditer(text):
        out += (text[at : m.start()], chr(int(m[m.lastindex], 16)))
        size += m.start() - at
        new.append(size)
        end.append(m.end())
        size, at = size + 1, m.end()
    if not new:
        return None
    out.append(text[at:])

    def first(k: int) -> int:
        e = bisect_right(new, k) - 1
        # behind escape e; on it, its beginning is where the text before it ends
        return (end[e - 1] + k - new[e - 1] - 1 if e > 0 else k) if e >= 0 and new[e] == k else (end[e] + k - new[e] - 1 if e >= 0 else k)

    def locate(a: int, b: int) -> tuple[int, int]:
        e = bisect_right(new, b - 1) - 1
        return first(a), end[e] + b - 1 - new[e] if e >= 0 else b

    return Layer("".join(out), layer, locate, level=layer.level + 1)


def settled(layer: Layer) -> Layer:
    """The layer with all escapes decoded, and all that come of them, in time in proportion to it."""
    chars: list[str] = []
    starts: list[int] = []
    for k, c in enumerate(layer.text):
        chars.append(c)
        starts.append(k)
        # the longest escape has ten characters; a shorter one may end here too
        while c in _ENDS and (m := _AT_END.search("".join(chars[-10:]))):
            n = m.end() - m.start()
            c = chr(int(m[m.lastindex], 16))
            del chars[-n + 1 :], starts[-n + 1 :]
            chars[-1] = c
    ends = [*starts[1:], len(layer.text)]
    return Layer("".join(chars), layer, lambda a, b: (starts[a], ends[b - 1]), level=layer.level + 1)


class Inflation:
    """Content of the gzip, zlib or bzip2 stream at the start of a feed of bytes, and of those that
    follow it directly; what a broken stream gives before its fault counts."""

    def __init__(self, feed: Iterator[bytes], allowed: Allowance):
        self.feed, self.allowed = feed, allowed
        self.used = 0  # bytes of the streams that came to their end
        self.short = self.cut = False  # the feed ended inside a stream; more than is allowed

    def __iter__(self) -> Iterator[bytes]:
        held = b""
        while True:
            while len(held) < 4 and (more := next(self.feed, None)) is not None:
                held += more
            if not (m := _STREAM.match(held)):
                return
            block = m[0][:1] == b"B"
            unpack, fed = bz2.BZ2Decompressor() if block else zlib.decompressobj(47), len(held)
            try:
                while not unpack.eof:
                    if not self.allowed.left:
                        self.cut = True
                        return
                    part = unpack.decompress(held, min(PIECE, self.allowed.left))
                    held = b"" if block else unpack.unconsumed_tail
                    self.allowed.left -= len(part)
                    if part:
                        yield part
                    elif not unpack.eof and not held:
                        more = next(self.feed, None)
                        if more is None:
                            self.short = True
                            return
                        held, fed = more, fed + len(more)
            except (zlib.error, OSError, ValueError, EOFError):
                return
            held = unpack.unused_data
            self.used += fed - len(held)


def _pieces(raw: bytes, start: int = 0) -> Iterator[bytes]:
    for k in range(start, len(raw), PIECE):
        yield raw[k : k + PIECE]


def _behind(parts: Iterator[bytes], start: int) -> Iterator[bytes]:
    """The parts of a stream without its first bytes."""
    for part in parts:
        if start < len(part):
            yield part[start:]
        start = max(0, start - len(part))


def _windows(source: Callable[[], Iterator[bytes]]) -> Iterator[Stretch]:
    held, start, done = b"", 0, [0]
    for part in source():
        held += part
        if len(held) >= WINDOW:
            yield Stretch(held, start, False, source, done)
            start, held = start + len(held) - OVERLAP, held[-OVERLAP:]
    if held:
        yield Stretch(held, start, True, source, done)


def _streams(stretch: Stretch, layer: Layer, place: Callable[[int, int], tuple[int, int]], allowed: Allowance) -> Iterator[Layer]:
    """Layers of the streams that begin anywhere in a stretch; each comes from its whole stream.

    A stream that ends in the stretch and fits into a window is one layer.  Of another the windows
    are; where it goes on behind the stretch, it is read from the stream around it."""
    raw = stretch.data
    for m in _STREAM.finditer(raw):
        at = stretch.start + m.start()
        if at < stretch.done[0]:
            continue
        probe, held, size = Inflation(_pieces(raw, m.start()), allowed), [], 0
        for part in probe:
            size += len(part)
            if size <= WINDOW:
                held.append(part)
        if not size and not (probe.short and not stretch.last):
            continue
        inside = stretch.last or not probe.short
        # a stream that is cut off, or broken, is taken for all that follows
        end = m.start() + probe.used if probe.used and not (probe.short or probe.cut) else len(raw)
        whole = place(m.start(), end)
        if probe.cut:
            allowed.cut.add(layer.source(*whole))
        stretch.done[0] = stretch.start + end
        if inside and size <= WINDOW:
            plain = b"".join(held)
            yield Layer(plain.decode("latin-1"), layer, lambda a, b, whole=whole: whole, Stretch(plain, 0, True, lambda plain=plain: _pieces(plain), [0]))
            continue
        del held
        read: list[Inflation] = []

        def source(at=at, k=m.start(), inside=inside, read=read) -> Iterator[bytes]:
            read.append(Inflation(_pieces(raw, k) if inside else _behind(stretch.source(), at), allowed))
            return iter(read[-1])

        for window in _windows(source):
            yield Layer(window.data.decode("latin-1"), layer, lambda a, b, whole=whole: whole, window)
        if read[0].cut:
            allowed.cut.add(layer.source(*whole))
        stretch.done[0] = max(stretch.done[0], at + read[0].used)


def unwrap(layer: Layer, allowed: Allowance) -> Iterator[Layer]:
    """Layers directly under ``layer``."""
    if plain := unescaped(layer):
        yield plain
    if layer.packed:
        yield from _streams(layer.packed, layer, lambda a, b: (a, b), allowed)
    for m in _BASE64.finditer(layer.text):
        lines = m[0].translate(_NOT_BASE64)
        start, one = m.start(), len(lines) == m.end() - m.start()
        held = None if one else [k for k in range(*m.span()) if layer.text[k] not in "\r\n \t"]
        body = lines.replace("-", "+").replace("_", "/")
        for phase in range(4):
            size = len(body) - phase
            size -= size % 4 == 1
            raw = base64.b64decode(body[phase : phase + size] + "=" * (-size % 4))
            last = len(body) - 1

            def place(a: int, b: int, phase=phase, start=start, held=held, last=last) -> tuple[int, int]:
                p, q = phase + a // 3 * 4, min(last, phase + (b - 1) // 3 * 4 + 3)
                return (start + p, start + q + 1) if held is None else (held[p], held[q] + 1)

            yield Layer(raw.decode("latin-1"), layer, place)
            yield from _streams(Stretch(raw, 0, True, lambda raw=raw: _pieces(raw), [0]), layer, place, allowed)


_Span = tuple[str, int, int]


def all_spans(text: str | None, inflated: int | None = None) -> tuple[list[_Span], list[_Span], list[tuple[int, int]]]:
    """``(base, all, cut)``: spans ``(kind, start, end)`` in code points, by start, then kind, and
    places of compressed streams that hold more than may be unpacked, by default ``EXPANSION`` times
    the text, or ``LEAST_INFLATED`` bytes.  One layer of a chain is held at a time."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    allowed = Allowance(max(LEAST_INFLATED, EXPANSION * len(text)) if inflated is None else inflated)
    spans, chain = set(base), [unwrap(Layer(text), allowed)]
    while chain:
        inner = next(chain[-1], None)
        if inner is None:
            chain.pop()
        elif not inner.repeats():
            spans.update((kind, *inner.source(a, b)) for kind, a, b in base_spans(inner.text))
            chain.append(unwrap(inner, allowed))
    return base, sorted(spans, key=order), sorted(allowed.cut)


def secret_spans(text: str | None) -> tuple[list[_Span], list[_Span]]:
    """``(base, all)`` of ``all_spans()``."""
    return all_spans(text)[:2]


def _joined(spans: list[_Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", inflated: int | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cut)`` for every row.

    The counts and the digest cover the spans that stand in the text as it is; ``spans`` adds
    those found in unwrapped layers, a span of a compressed layer being its whole stream.  Null
    and empty texts have none; texts and streams are read whole, however long.  ``n_cut`` counts
    streams that unpack to more than a stream of their text's length can, or than ``inflated``
    bytes, and are not read to their end.  Repeated rows and rows with a null id are scanned like
    others; other columns are not read.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [all_spans(t, inflated) for t in pdf["text"]]
            counts = {f"n_{k}": [sum(s[0] == k for s in f[0]) for f in found] for k in KINDS}
            digest = [hashlib.sha256(_joined(f[0]).encode()).hexdigest() for f in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), **counts, "base_sha256": digest, "spans": [_joined(f[1]) for f in found], "n_cut": [len(f[2]) for f in found]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cut long")


def mask(text: str | None, replacement: str = "[SECRET]") -> str | None:
    """``text`` with every secret span, merged where they overlap, replaced, and with it every stream
    that could not be read to its end, as it may hold some."""
    if not text:
        return text
    out, at = [], 0
    _, spans, cut = all_spans(text)
    for start, end in sorted([s[1:] for s in spans] + cut):
        if start >= at:
            out += [text[at:start], replacement]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, replacement: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs`` with secrets in ``text_col`` replaced; a null text stays
    null, an empty table empty.  ``length_col``, if given, is set to the new number of characters;
    columns of any other name stay as they are."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: mask(t, replacement))

    out = docs.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))
    return out if length_col is None else out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
