"""Repeated substrings by blockwise suffix sorting with difference-cover ranks.

Suffixes are needed to a depth of ``length`` bytes only.  They are dealt into buckets by
content: the bucket of the suffix at i is the least of the hashed ``GRAM``-byte strings inside
its first ``report`` bytes, so suffixes that agree that far meet in one bucket, at equal distance
from that string.  Buckets that hold one place are dropped before any text is moved.  What is left
is sorted one block of buckets at a time: a block's cover sample (columns of a difference cover,
counted from the bucket's string) is ranked first, to a depth that any two suffixes reach
after less than ``GAP`` bytes; every other suffix is then ordered by its first bytes, the rank
of the sample behind them, and its last bytes, so no tie is compared in full again.

A bucket of more than ``hot_rows`` places is never one task's: its rows are cut into pieces of few
suffixes, equal pieces become one with a count before they are shuffled, and a piece's bucket is
named by the bytes that all its suffixes share.  Pieces whose bucket is still too large are cut
again, at last into single suffixes, of which only counts are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize, partitions

LENGTH = 400
REPORT = 256  # bytes from which a repeat is reported, though not removed
GRAM = 64
COVER_PERIOD, COVER = 21, (3, 6, 7, 12, 14)  # every difference mod 21 is one of two members
GAP = 9  # most columns to the next cover column
BLOCK_ROWS = 6000
HOT_ROWS = 30_000
PIECES = (64, 8)  # suffixes of a piece, by level
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_names(raw: bytes) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    for k, c in enumerate(_C):
        n = 1 << k
        h = h[:-n] * c + h[n:]
        h ^= h >> np.uint64(31)
    return h


def buckets(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(name, at, first, last)``: the suffixes at ``first..last`` belong to the bucket of the
    string ``name`` that lies at ``at``; together they are all that have ``length`` bytes."""
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h, width = gram_names(raw), length - GRAM + 1
    n = len(h) - width + 1
    pad = -len(h) % width
    blocks = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    # the first place of the least hash at or after each window's start
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    name, first, last, at = [], [], [], []
    for a, b in zip([0, *change.tolist()], [*change.tolist(), n], strict=True):
        places = np.flatnonzero(h[a : b - 1 + width] == least[a]) + a
        i = a
        for p in places.tolist():  # more than one only where a string repeats within a window
            j = min(p, b - 1)
            if j >= i:
                name.append(least[a]), first.append(i), last.append(j), at.append(p)
                i = j + 1
            if i >= b:
                break
    return np.array(name, np.uint64), np.array(at, np.int64), np.array(first, np.int64), np.array(last, np.int64)


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Rank of each row of bytes among the rows; equal rows share it."""
    flat = np.ascontiguousarray(rows)
    if flat.shape[1] % 8 == 0 and flat.shape[1] <= 24:
        words = flat.view(np.uint64)
        order = np.lexsort(words.T)
        new = np.ones(len(order), bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new) - 1
        return out
    return np.unique(flat.view(np.dtype((np.void, flat.shape[1]))).ravel(), return_inverse=True)[1]


def equal_suffixes(bucket: np.ndarray, text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``wanted`` suffixes (row, distance) equal another to ``length`` bytes.

    The suffix at distance d starts ``d`` columns before the column of the bucket's string.
    """
    out = np.zeros(wanted.shape, bool)
    far, depth = wanted.shape[1] - 1, length - GAP
    sample, rank, size = -1, None, None
    for column in range(far, -1, -1):
        distance = far - column
        rows = np.flatnonzero(wanted[:, distance])
        if not len(rows):
            continue
        cover = column
        while cover % COVER_PERIOD not in COVER:
            cover += 1
        if cover != sample:
            sample = cover
            # all rows with a suffix between this cover column and the one before
            near = np.flatnonzero(wanted[:, distance : distance + GAP + 1].any(axis=1))
            here = np.concatenate([bucket[near, None].view(np.uint8).reshape(len(near), 8), text[near, cover : cover + depth]], axis=1)
            rank = np.full(len(text), -1, np.int64)
            rank[near] = _ranks(here)
            size = np.bincount(rank[near])
        rows = rows[size[rank[rows]] > 1]
        if not len(rows):
            continue
        key = np.zeros((len(rows), 24), np.uint8)
        key[:, :8] = rank[rows, None].view(np.uint8).reshape(len(rows), 8)
        head = cover - column
        key[:, 8 : 8 + head] = text[rows, column:cover]
        key[:, 8 + head : 8 + GAP] = text[rows, cover + depth : column + length]
        order = _ranks(key)
        out[rows, distance] = np.bincount(order)[order] > 1
    return out


def repeated_starts(bucket: np.ndarray, low: np.ndarray, top: np.ndarray, context: list[bytes], length: int = LENGTH, report: int = REPORT) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole buckets: which suffixes occur twice or more, to ``report`` and to
    ``length`` bytes, as boolean matrices (row, distance).

    Row r has the suffixes at distances ``low[r]..top[r]`` before its bucket's string;
    ``context[r]`` is its text from the first of them on, as far as the last one needs.
    """
    far = report - GRAM
    text = np.zeros((len(context), far + length), np.uint8)  # column `far` is where the bucket's string starts
    for r, c in enumerate(context):
        text[r, far - top[r] : far - top[r] + len(c)] = np.frombuffer(c, np.uint8)
    bucket = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    distance = np.arange(far + 1)
    short = equal_suffixes(bucket, text, (low[:, None] <= distance) & (distance <= top[:, None]), report)
    reach = np.fromiter(map(len, context), np.int64, len(context)) - top
    whole = short & (reach[:, None] + distance >= length)
    rows = np.flatnonzero(whole.any(axis=1))
    if length > report and len(rows):
        whole[rows] = equal_suffixes(bucket[rows], text[rows], whole[rows], length)
    return short, whole


def _anchors(rows: DataFrame, report: int) -> DataFrame:
    """``(name, tid, at, first, last)`` of all buckets of all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part, tids, sizes, held = pdf.iloc[start : start + 500], [], [], []
                for tid, text in zip(part["tid"], part["text"], strict=True):
                    held.append(buckets(text.encode(), report))
                    tids.append(tid)
                    sizes.append(len(held[-1][0]))
                name, at, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pd.DataFrame({"name": name.view(np.int64), "tid": np.repeat(np.array(tids, object), sizes), "at": at, "first": first, "last": last})

    return rows.mapInPandas(run, "name long, tid binary, at int, first int, last int")


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """``(tid, at, name, hot, low, top, context)`` of the wanted buckets of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 200):
                out = []
                for tid, text, wanted in zip(*(pdf[c].iloc[start : start + 200] for c in ("tid", "text", "wanted")), strict=True):
                    raw = text.encode()
                    out += [(tid, w["at"], w["name"], w["hot"], w["at"] - w["last"], w["at"] - w["first"], raw[w["first"] : w["last"] + length]) for w in wanted]
                yield pd.DataFrame(out, columns=["tid", "at", "name", "hot", "low", "top", "context"])

    return rows.mapInPandas(run, "tid binary, at int, name long, hot boolean, low int, top int, context binary")


def _sorted_blocks(contexts: DataFrame, owner: list[str], length: int, report: int, block_rows: int) -> DataFrame:
    """``(*owner, near, far, size)``: distances of repeated suffixes, as runs, by their length."""
    spark = contexts.sparkSession
    dealt = contexts.select(*owner, "name", "low", "top", "context").repartition(4 * partitions(spark), "name").sortWithinPartitions("name")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        low, top = (pdf[c].to_numpy(np.int64) for c in ("low", "top"))
        out = []
        for size, hit in zip((report, length), repeated_starts(pdf["name"].to_numpy(np.int64), low, top, list(pdf["context"]), length, report), strict=True):
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, near = np.nonzero(edge == 1)
            part = pdf[owner].iloc[row].reset_index(drop=True)
            out.append(part.assign(near=near, far=np.nonzero(edge == -1)[1] - 1, size=size))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= block_rows:
                names = held["name"].to_numpy()
                ends = np.flatnonzero(names[1:] != names[:-1]) + 1  # where a bucket ends
                if not len(ends):
                    break  # one bucket so far
                inside = ends[ends <= block_rows]
                cut = int(inside[-1] if len(inside) else ends[0])
                yield block(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield block(held)

    kinds = {"tid": "binary", "at": "int", "pid": "string"}
    return dealt.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in owner) + ", near int, far int, size int")


def _cut(rows: DataFrame, owner: list[str], width: int, length: int, report: int) -> DataFrame:
    """Rows cut into pieces of at most ``width`` suffixes; a piece's bucket is named by what every
    suffix of its range of distances must hold."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                part, out, of = pdf.iloc[start : start + 2000], [], []
                for r, (name, low, top, context) in enumerate(zip(part["name"], part["low"], part["top"], part["context"], strict=True)):
                    for g in range(low // width * width, top + 1, width):
                        lo, hi = max(low, g), min(top, g + width - 1)
                        shared = xxhash.xxh64_intdigest(context[top - g : top - g - width + 1 + report], name & (2**64 - 1) ^ g)
                        out.append((shared - (shared >> 63 << 64), lo, hi, context[top - hi : top - lo + length]))
                        of.append(r)
                new = pd.DataFrame(out, columns=["name", "low", "top", "context"])
                yield pd.concat([part[[*owner, "weight"]].iloc[of].reset_index(drop=True), new], axis=1)

    kinds = {"tid": "binary", "at": "int", "pid": "string"}
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in owner) + ", weight long, name long, low int, top int, context binary")


def _hot_runs(rows: DataFrame, length: int, report: int, block_rows: int, hot_rows: int, widths: tuple[int, ...] = PIECES) -> DataFrame:
    """``(tid, at, near, far, size)`` of the rows of buckets that are too large for a task."""
    owner, levels = ["tid", "at"], []
    rows = rows.withColumn("weight", F.lit(1).cast("long"))
    text, reach = F.col("context"), F.octet_length("context") - F.col("top") - length
    for width in widths:
        pid = F.md5(F.concat_ws(":", "name", "low", "top", F.md5(text)))
        cut = _cut(rows, owner, width, length, report).withColumn("piece", pid)
        members = cut.select(*owner, F.col("piece"))
        pieces = materialize(cut.groupBy(F.col("piece").alias("pid"), "name", "low", "top", "context").agg(F.sum("weight").alias("weight")), "pieces")
        twice = pieces.where("weight > 1")
        runs = twice.select("pid", F.col("low").alias("near"), F.col("top").alias("far"), F.lit(report).alias("size"))
        whole = twice.select("pid", F.greatest("low", -reach).alias("near"), F.col("top").alias("far"), F.lit(length).alias("size")).where("near <= far")
        sizes = materialize(pieces.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        few = pieces.join(sizes.where(F.col("n") <= hot_rows).select("name"), "name", "left_semi")
        levels.append((owner, members, runs.unionByName(whole).unionByName(_sorted_blocks(few, ["pid"], length, report, block_rows))))
        rows, owner = pieces.join(sizes.where(F.col("n") > hot_rows).select("name"), "name", "left_semi"), ["pid"]
        if sizes.where(F.col("n") > hot_rows).isEmpty():
            found = None
            break
    else:
        # single suffixes: to ``report`` bytes the name tells them apart, to ``length`` the text
        single = _cut(rows, owner, 1, length, report)
        full = single.where(F.octet_length(text) == length).withColumn("name", F.md5(text))
        parts = []
        for size, of in ((report, single), (length, full)):
            twice = materialize(of.groupBy("name").agg(F.sum("weight").alias("n")).where("n > 1").select("name"), "twice")
            parts.append(of.join(twice, "name", "left_semi").select("pid", F.col("low").alias("near"), F.col("top").alias("far"), F.lit(size).alias("size")))
        found = parts[0].unionByName(parts[1])
    for owner, members, runs in reversed(levels):
        runs = runs if found is None else runs.unionByName(found)
        found = members.join(materialize(runs.withColumnRenamed("pid", "piece"), "runs"), "piece").select(*owner, "near", "far", "size")
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, report: int = REPORT, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, kept)`` of every row.

    Every byte covered by a ``length``-byte string that starts at another place too, in any row,
    goes; ``kept`` is what remains, as bytes.  ``n_repeated`` counts the bytes that repeats of
    ``report`` bytes or more cover; the shorter of these stay in the text.  Null texts are empty.
    Repeated rows repeat each other and go as far as they reach ``length`` bytes.  Texts are told
    apart by themselves: rows that share an id, or have none, take part like others.  Texts of
    fewer than ``length`` bytes stay whole.  Other columns are not read.  An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("tid", F.unhex(F.md5("text")))
    # of equal texts one takes part; the others add no place that is new
    one = rows.where(F.col("n_bytes") >= report).groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = bucketed(one, "tid", "texts")
    anchors = materialize(_anchors(texts.select("tid", "text"), report), "anchors")
    place = F.xxhash64("tid", "at")
    names = anchors.groupBy("name").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b")
    shared = materialize(names.select("name", (F.col("n") > hot_rows).alias("hot")), "shared")
    wanted = anchors.join(shared, "name").groupBy("tid").agg(F.collect_list(F.struct("name", "at", "first", "last", "hot")).alias("wanted"))
    contexts = _contexts(texts.select("tid", "text").join(wanted, "tid"), length)
    if shared.where("hot").isEmpty():
        runs = _sorted_blocks(contexts, ["tid", "at"], length, report, block_rows)
    else:
        contexts = materialize(contexts, "contexts")
        hot = _hot_runs(contexts.where("hot").drop("hot"), length, report, block_rows, hot_rows)
        runs = _sorted_blocks(contexts.where("not hot"), ["tid", "at"], length, report, block_rows).unionByName(hot)
    span = F.struct((F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + F.col("size")).alias("end"))
    of_size = lambda size: F.array_sort(F.collect_list(F.when(F.col("size") == size, span)))
    spans = materialize(runs.groupBy("tid").agg(of_size(length).alias("spans"), of_size(report).alias("seen")), "spans")
    discard(anchors)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            for begin in range(0, len(pdf), 1000):
                out = []
                for tid, text, copies, spans, seen in zip(*(pdf[c].iloc[begin : begin + 1000] for c in ("tid", "text", "copies", "spans", "seen")), strict=True):
                    raw = text.encode()
                    all_of = [{"start": 0, "end": len(raw)}]
                    gone = (all_of if len(raw) >= length else []) if copies > 1 else _merged(spans)
                    again = all_of if copies > 1 else _merged([*seen, *spans])
                    keep = [raw[a["end"] : b["start"]] for a, b in zip([{"end": 0}, *gone], [*gone, {"start": len(raw)}], strict=True)]
                    kept = b"".join(keep)
                    out.append((tid, len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(s["end"] - s["start"] for s in again), kept))
                yield pd.DataFrame(out, columns=["tid", "n_removed", "n_spans", "cut_sha256", "n_repeated", "cut"])

    changed = texts.join(spans, "tid", "left").where("copies > 1 or spans is not null")
    changed = changed.mapInPandas(cut, "tid binary, n_removed long, n_spans long, cut_sha256 string, n_repeated long, cut binary")
    rows = rows.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(changed, "tid", "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("cut_sha256", "sha256").alias("kept_sha256"), zero("n_repeated"), F.coalesce("cut", F.col("text").cast("binary")).alias("kept"))


def _merged(spans: list) -> list[dict[str, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[dict[str, int]] = []
    for s in sorted(spans if spans is not None else (), key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    return out
