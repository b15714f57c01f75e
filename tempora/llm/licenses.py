"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded
alignment decides.

Templates and documents are compared as bytes, in lower case and with every white space a blank.
Of each window of a template's grams the one with the least hash is a fingerprint; short notices
have shorter grams and windows.  All grams of a document are looked up, so a shared stretch of
gram + window - 1 bytes cannot be missed.  Where at least a share of a template's fingerprints lie
on a band of diagonals the whole template is aligned along it.  Of places that overlap the one
with the most matches less edits is reported, so that siblings compete; what tells a license from
its siblings, such as a version, must stand in the matched stretch as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

SHORT, SHORT_GRAM, SHORT_WINDOW = 100, 4, 2  # templates of fewer bytes than SHORT
GRAM, WINDOW = 8, 8
MIN_SHARE, MIN_COVERAGE, MIN_IDENTITY, BAND = 0.2, 0.8, 0.75, 0.2
NAME_BYTES = 120  # behind a notice that a name follows
_BITS = 20
_FOLD = bytes(32 if b in b"\t\n\x0b\x0c\r " else ord(chr(b).lower()) if b < 128 else b for b in range(256))
Template = tuple[str, str, str]


def fold(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


def grams(raw: bytes, size: int) -> np.ndarray:
    """A number for the ``size`` bytes at each place, mixed; ``size`` is at most 8."""
    c = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(c) < size:
        return c[:0]
    h = np.zeros(len(c) - size + 1, np.uint64)
    for k in range(size):
        h = h << np.uint64(8) | c[k : len(c) - size + 1 + k]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash, the last on ties, of each run of ``window``."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else [], np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


class FingerprintIndex:
    """Inverted index of the fingerprints of templates that share gram and window."""

    def __init__(self, bodies: dict[int, bytes], gram: int, window: int, min_share: float):
        self.gram = gram
        made = [(h, t, at) for t, body in bodies.items() for g in [grams(body, gram)] for at in winnow(g, window).tolist() for h in [g[at]]]
        made.sort(key=lambda m: int(m[0]))
        self.hash = np.array([m[0] for m in made], np.uint64)
        self.template, self.place = np.array([m[1] for m in made], np.int64), np.array([m[2] for m in made], np.int64)
        self.held = np.zeros(1 << _BITS, bool)
        self.held[self.hash >> np.uint64(64 - _BITS)] = True
        size = max(bodies, default=-1) + 1
        self.needed = np.maximum(1, np.ceil(np.bincount(self.template, minlength=size) * min_share)).astype(np.int64)
        self.band = np.array([band_of(bodies.get(t, b"")) for t in range(size)], np.int64)

    def candidates(self, raw: bytes) -> Iterator[tuple[int, int, int]]:
        """``(template, first diagonal, last diagonal)`` of bands that hold enough fingerprints."""
        g = grams(raw, self.gram)
        at = np.flatnonzero(self.held[g >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.hash):
            return
        lo, hi = np.searchsorted(self.hash, g[at], "left"), np.searchsorted(self.hash, g[at], "right")
        n = hi - lo
        if not n.any():
            return
        post = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        template, diagonal = self.template[post], np.repeat(at, n) - self.place[post]
        key = np.sort(template << np.int64(40) | diagonal + (1 << 32))
        t = key >> np.int64(40)
        enough = np.searchsorted(key, key + self.band[t], "right") - np.arange(len(key)) >= self.needed[t]
        if not enough.any():
            return
        first = np.flatnonzero(enough)
        last = np.searchsorted(key, key[first] + self.band[t[first]], "right") - 1
        open_t, open_a, open_b = None, 0, 0
        for a, b in zip(key[first].tolist(), key[last].tolist(), strict=True):
            which, da, db = a >> 40, (a & (1 << 40) - 1) - (1 << 32), (b & (1 << 40) - 1) - (1 << 32)
            if which == open_t and da <= open_b:
                open_b = db
            else:
                if open_t is not None:
                    yield open_t, open_a, open_b
                open_t, open_a, open_b = which, da, db
        yield open_t, open_a, open_b


def band_of(body: bytes) -> int:
    return max(8, int(len(body) * BAND))


class TemplateIndex:
    """Templates with the fingerprint indexes of the short and of the long ones."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, min_share: float = MIN_SHARE):
        self.names = [name for name, _, _ in templates]
        self.must = [re.compile(must.encode()) for _, must, _ in templates]
        self.bodies = [fold(text) for _, _, text in templates]
        short = {t: b for t, b in enumerate(self.bodies) if SHORT_GRAM <= len(b) < SHORT}
        long = {t: b for t, b in enumerate(self.bodies) if len(b) >= SHORT}
        self.indexes = [FingerprintIndex(short, SHORT_GRAM, SHORT_WINDOW, min_share), FingerprintIndex(long, GRAM, WINDOW, min_share)]

    def matches(self, text: str | None, min_coverage: float = MIN_COVERAGE, min_identity: float = MIN_IDENTITY) -> list[tuple[str, float, float, int, int]]:
        """``(license, coverage, identity, start, end)`` in code points."""
        raw = fold(text)
        # a template whose pattern stands nowhere needs no alignment
        wanted = [c for index in self.indexes for c in index.candidates(raw)]
        possible = {t for t in {c[0] for c in wanted} if self.must[t].search(raw)}
        wanted = [c for c in wanted if c[0] in possible]
        found = [place for c in wanted for place in self.equal(*c, raw)]
        equal = [(a, b) for _, _, a, b, _ in found]
        for t, low, top in wanted:
            size, slack = len(self.bodies[t]), band_of(self.bodies[t])
            # nothing that has to overlap an equal stretch as long as the template scores higher
            if any(b - a >= size and top + slack < b and low + size - 2 * slack > a for a, b in equal):
                continue
            found += [(*place, t) for place in self.places(t, raw, low, top, min_coverage, min_identity)]
        taken: list[tuple[int, int, int, int, int]] = []
        for same, edits, a, b, t in sorted(found, key=lambda m: (m[1] - m[0], m[2], m[3], m[4])):
            if all(b <= x or a >= y for _, _, x, y, _ in taken):
                taken.append((same, edits, a, b, t))
        if not taken:
            return []
        whole = (text or "").encode()
        named = [self.called(t, whole, raw, a, b) for _, _, a, b, t in taken]
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        out = [(name, round(s / len(self.bodies[t]), 6), round(s / (s + e), 6), int(chars[a]), int(chars[end])) for (s, e, a, b, t), (name, end) in zip(taken, named, strict=True)]
        return sorted(out, key=lambda m: (m[3], m[0]))

    def holds(self, t: int, raw: bytes, start: int, end: int) -> re.Match[bytes] | None:
        """What tells the license from its siblings, in the stretch or just behind it."""
        reach = NAME_BYTES if "id" in self.must[t].groupindex else 4
        return self.must[t].search(raw, start, min(len(raw), end + reach))

    def called(self, t: int, whole: bytes, raw: bytes, start: int, end: int) -> tuple[str, int]:
        """The license's name, and where its stretch ends."""
        if "id" not in self.must[t].groupindex:
            return self.names[t], end
        held = self.holds(t, raw, start, end)
        return whole[slice(*held.span("id"))].decode("utf-8", "replace"), max(end, held.end())

    def equal(self, t: int, low: int, top: int, raw: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        """Places that equal the template."""
        body = self.bodies[t]
        at = raw.find(body, max(0, low), max(0, top + len(body)))
        while at >= 0:
            if self.holds(t, raw, at, at + len(body)):
                yield len(body), 0, at, at + len(body), t
            at = raw.find(body, at + len(body), max(0, top + len(body)))

    def places(self, t: int, raw: bytes, low: int, top: int, min_coverage: float, min_identity: float) -> Iterator[tuple[int, int, int, int]]:
        """``(matches, edits, start, end)`` of places of the template along diagonals ``low..top``."""
        body, work = self.bodies[t], [(low, top)]
        while work:
            low, top = work.pop()
            # a run of diagonals wider than the template may hold several places
            if top - low > 2 * len(body):
                middle = (low + top) // 2
                work += [(low, middle + len(body) // 2), (middle - len(body) // 2, top)]
                continue
            same, edits, start, end = align(body, raw, (low + top) // 2, (top - low + 1) // 2 + band_of(body))
            if same < min_coverage * len(body) or same < min_identity * (same + edits):
                continue
            if self.holds(t, raw, start, end):
                yield same, edits, start, end
            # what lies before and behind may be further places
            if start - len(body) // 2 > low:
                work.append((low, start - len(body) // 2))
            if start + len(body) // 2 < top:
                work.append((start + len(body) // 2, top))


def align(pattern: bytes, raw: bytes, diagonal: int, band: int) -> tuple[int, int, int, int]:
    """``(matches, edits, start, end)`` of the best alignment of the whole of ``pattern`` to a
    stretch of ``raw`` that stays within ``band`` of ``diagonal``: most matches less edits."""
    m, n, width = len(pattern), len(raw), 2 * band + 1
    low = -(10**6)
    column = np.arange(width)
    score = np.where([0 <= diagonal - band + k <= n for k in range(width)], 0, low)
    same, start = np.zeros(width, np.int64), column + diagonal - band
    text = np.zeros(m + width, np.int16) - 1  # the stretch that the band can reach, none outside the document
    at = diagonal - band
    a, b = max(0, at), min(n, at + m + width)
    if a < b:
        text[a - at : b - at] = np.frombuffer(raw, np.uint8)[a:b]
    next_score, next_same, next_start = np.full(width, low), np.zeros(width, np.int64), np.zeros(width, np.int64)
    for i in range(m):
        here = text[i : i + width]  # what column k consumes
        equal = here == pattern[i]
        through = np.where(here >= 0, score + (2 * equal - 1), low)
        next_score[:-1], next_same[:-1], next_start[:-1] = score[1:], same[1:], start[1:]
        pick = next_score - 1 > through  # pattern byte without a partner
        score = np.where(pick, next_score - 1, through) + column
        same = np.where(pick, next_same, same + equal)
        start = np.where(pick, next_start, start)
        gap = np.maximum.accumulate(score)  # raw bytes without a partner
        source = np.maximum.accumulate(np.where(score == gap, column, 0))
        score, same, start = gap - column, same[source], start[source]
    k = int(np.argmax(score))
    return int(same[k]), int(same[k] - score[k]), max(0, int(start[k])), min(n, max(0, m + diagonal - band + k))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, min_coverage: float = MIN_COVERAGE, min_identity: float = MIN_IDENTITY, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, coverage, identity, start, end)``: a row per document row and place
    where at least ``min_coverage`` of a template's bytes match and ``min_identity`` of the
    alignment's columns are matches.

    Null, empty and short texts hold nothing.  Repeated rows report each; a null id is kept; of
    overlapping places the best is reported, equal ones by place and order of the templates.
    Whole texts are read, however long.  Other columns are not read.  An empty table gives an empty
    result.
    """
    templates = list(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = TemplateIndex(templates, min_share)
        for pdf in batches:
            hits = [(d, *m) for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True) for m in index.matches(t, min_coverage, min_identity)]
            yield pd.DataFrame(hits, columns=["doc_id", "license", "coverage", "identity", "start", "end"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInPandas(run, "doc_id long, license string, coverage double, identity double, start long, end long")
