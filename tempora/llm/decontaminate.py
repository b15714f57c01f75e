"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k = m * error_rate edits.  It is split into k + 1
pieces; an occurrence with at most k edits leaves one piece untouched, so every occurrence
holds an exact piece hit.  An Aho-Corasick automaton finds piece hits in each document, and
Myers' bit-parallel distance verifies the window that each hit implies.  An edit destroys at most
three of an item's character triples, so a window that lacks more than 3 k of them is passed over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one blank."""
    return " ".join((text or "").lower().split())


def _words_with_starts(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for word in text.split():
        at = text.index(word, at)
        yield at, word
        at += len(word)


def source_offsets(text: str) -> tuple[list[int], list[int]]:
    """For each character of ``normalise(text)``, start and end of what it stands for in ``text``."""
    starts, ends = [], []
    for at, word in _words_with_starts(text):
        if starts:
            starts.append(ends[-1])
            ends.append(at)
        for k, char in enumerate(word):
            n = len(char.lower())
            starts += [at + k] * n
            ends += [at + k + 1] * n
    return starts, ends


def myers_end(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and the first end of such."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score -= -1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def locate(pattern: str, window: str, budget: int) -> tuple[int, int, int] | None:
    """``(distance, start, end)`` of the best occurrence within ``budget`` edits."""
    at = window.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    distance, end = myers_end(pattern, window)
    if distance > budget:
        return None
    back, length = myers_end(pattern[::-1], window[:end][::-1][: len(pattern) + budget])
    return distance, end - length, end


def triples(text: str) -> np.ndarray:
    """A number for the three characters at each place; equal ones have equal numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (c[:-2] * np.uint32(961) + c[1:-1] * np.uint32(31) + c[2:]) if len(c) > 2 else c[:0]


class ItemIndex:
    """Pieces of a bounded block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        self.items: list[tuple[int, str, int]] = []
        self.triples: list[np.ndarray] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            k = int(len(text) * error_rate)
            self.items.append((item_id, text, k))
            self.triples.append(triples(text))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[text[a:b]].append((len(self.items) - 1, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item_id, edits, start, end)``: the best occurrence of each item, first on ties."""
        body = normalise(text)
        if not self.items or not body:
            return []
        diagonals: dict[int, set[int]] = defaultdict(set)
        for last, (size, owners) in self.automaton.iter(body):
            for item, offset in owners:
                diagonals[item].add(last + 1 - size - offset)
        found, held = [], triples(body) if diagonals else None
        for item, starts in diagonals.items():
            item_id, pattern, k = self.items[item]
            needed = len(self.triples[item]) - 3 * k
            best, done = None, -1
            for start in sorted(starts):
                lo, hi = max(0, start - k), min(len(body), start + len(pattern) + k)
                if hi <= done:
                    continue
                if needed > 0 and np.isin(self.triples[item], held[lo : hi - 2]).sum() < needed:
                    continue
                hit = locate(pattern, body[lo:hi], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], lo + hit[1], lo + hit[2])
                if best and best[0] == 0:
                    break
                done = hi if hit else done
            if best:
                found.append((item_id, *best))
        if found:
            starts, ends = source_offsets(text)
            found = [(i, e, starts[a], ends[b - 1]) for i, e, a, b in found]
        return sorted(found)


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, edits, start, end)``: one row per document row and item found in it.

    ``start``/``end`` are code points of the text as given, end exclusive.  Null and empty
    texts, of documents or items, match nothing; items shorter than 1/error_rate must occur
    exactly.  Repeated item rows count once, repeated document rows each report.  Other columns
    are not read; an empty table gives an empty result.  The items are read in blocks of at most about ``block_chars`` characters,
    each of which makes one pass over the documents, so that what a task holds stays bounded.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return _found(rows, "long", items, error_rate, item_col, item_text_col, block_chars)


def _found(rows: DataFrame, id_type: str, items: DataFrame, error_rate: float, item_col: str, item_text_col: str, block_chars: int) -> DataFrame:
    """``contaminated()`` for ``rows(doc_id, text)`` with ids of ``id_type``, long or string."""
    kind = "Int64" if id_type == "long" else "object"
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    out = None
    for block in range(blocks):
        held = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        held.sort(key=lambda r: (r[0] is None, r))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = ItemIndex(held, error_rate)
            for pdf in batches:
                hits = [(d, *m) for d, t in zip(pdf["doc_id"].astype(kind), pdf["text"], strict=True) for m in index.matches(t)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "edits", "start", "end"]).astype({"doc_id": kind, "item_id": "Int64"})

        part = rows.mapInPandas(run, f"doc_id {id_type}, item_id long, edits int, start long, end long")
        if blocks > 1:  # so that the driver holds one block at a time
            part = materialize(part, "matches")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs`` in which no item occurs, all columns kept, whatever their names.

    Whether an item occurs depends on the text alone, so rows are told apart by the text's digest;
    ids may be null or repeated.  Null and empty texts stay.  Without items all rows stay; an empty
    table stays empty.
    """
    digest, name = F.sha2(F.col(text_col).cast("string").cast("binary"), 256), free_name(docs, "text_digest")
    rows = docs.select(digest.alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    hit = _found(rows, "string", items, error_rate, item_col, item_text_col, block_chars).select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, digest).join(hit, name, "left_anti").select(*docs.columns)
