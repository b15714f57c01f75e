"""SimHash near-duplicate groups: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are the nodes.  They are dealt into tiles of one population count and
about ``tile_rows`` values; the more there are, the larger the tiles, as every tile travels to
each partner it has to meet.  Two fingerprints that
differ in at most ``radius`` bits have population counts at most ``radius`` apart, so tile
pairs further apart are never formed; the others are compared in full with numpy exclusive-or
and bit counts.  A tile pair reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, partitions
from .components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
LEAST_TILE, MOST_TILE = 4096, 1 << 20  # rows of a tile; the most are 8 MB, sorted and compared in about 150 MB
_BLOCK, _COLUMNS = 128, 1 << 16  # compared at once: 64 MB of differences at most


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of one text; 0 when it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    last = len(words) - shingle_words
    if last <= 0:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: last + 1].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)]
    total, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 4096):
        part = np.array(hashes[at : at + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp, pop)`` for every row; ``fp`` is the unsigned value held in a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter((fingerprint(t, shingle_words) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp.view(np.int64), "pop": np.bitwise_count(fp).astype(np.int32)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long, pop int")


def _flatten(root: np.ndarray) -> None:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return
        root[:] = up


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _link(a: np.ndarray, block: np.ndarray, cols: np.ndarray, cols_at: np.ndarray, radius: int, root: np.ndarray, out: list[tuple[int, int]]) -> None:
    """Adds to the forest ``root`` and to ``out`` what links rows ``block`` of ``a`` to ``cols``."""
    hit = np.bitwise_count(a[block][:, None] ^ cols[None, :]) <= radius
    while True:
        r, c = np.nonzero(hit)
        if not len(r):
            return
        _flatten(root)
        apart = root[block[r]] != root[cols_at[c]]
        if not apart.any():
            return
        r, c = r[apart], c[apart]
        hit = np.zeros_like(hit)
        hit[r, c] = True
        first_r, first_c = np.unique(r, return_index=True)[1], np.unique(c, return_index=True)[1]
        for k in np.union1d(first_r, first_c):
            i, j = int(block[r[k]]), int(cols_at[c[k]])
            x, y = _find(root, i), _find(root, j)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((i, j))


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest of the links between values of ``a`` and ``b`` (or within ``a``), as
    positions in ``a`` followed by ``b``."""
    whole = a if b is None else np.concatenate([a, b])
    off = 0 if b is None else len(a)
    other = a if b is None else b
    high = np.bitwise_count(other >> np.uint64(32)).astype(np.int16)
    order = np.argsort(high, kind="stable")
    high, other = high[order], other[order]
    a_high = np.bitwise_count(a >> np.uint64(32)).astype(np.int16)
    root, out = np.arange(len(whole)), []
    for h in np.unique(a_high):
        lo, hi = np.searchsorted(high, h - radius, "left"), np.searchsorted(high, h + radius, "right")
        if lo == hi:
            continue
        rows, cols, cols_at = np.flatnonzero(a_high == h), other[lo:hi], order[lo:hi] + off
        for at in range(0, len(rows), _BLOCK):
            for left in range(0, len(cols), _COLUMNS):
                _link(a, rows[at : at + _BLOCK], cols[left : left + _COLUMNS], cols_at[left : left + _COLUMNS], radius, root, out)
    return out


def tile_size(fingerprints: int, slots: int) -> int:
    """Rows of a tile that leave each of ``slots`` tasks a few tile pairs to compare."""
    return min(MOST_TILE, max(LEAST_TILE, int(fingerprints / (2 * slots) ** 0.5 / 2)))


def link_edges(nodes: DataFrame, radius: int = RADIUS, tile_rows: int | None = None) -> DataFrame:
    """``nodes(fp, pop)`` with distinct ``fp`` to linking edges ``(a, b)`` of fingerprints."""
    spark = nodes.sparkSession
    count = dict(nodes.groupBy("pop").count().collect())  # at most 65 rows
    tile_rows = tile_rows or tile_size(sum(count.values()), partitions(spark))
    chunks = F.create_map(*[F.lit(x) for p in range(65) for x in (p, -(-count.get(p, 0) // tile_rows))])
    tiled = (
        nodes.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.greatest(chunks[F.col("pop")], F.lit(1))).cast("int"))
        .groupBy("pop", "chunk")
        .agg(F.collect_list("fp").alias("tile"))
    )
    other = F.explode(F.sequence(F.greatest(F.col("pop") - radius, F.lit(0)), F.least(F.col("pop") + radius, F.lit(64))))
    near = tiled.withColumn("pop2", other).where(chunks[F.col("pop2")] > 0)
    near = near.withColumn("chunk2", F.explode(F.sequence(F.lit(0), chunks[F.col("pop2")] - 1)))
    mine, theirs = F.struct("pop", "chunk"), F.struct(F.col("pop2").alias("pop"), F.col("chunk2").alias("chunk"))
    dealt = near.select(F.least(mine, theirs).alias("low"), F.greatest(mine, theirs).alias("top"), (mine <= theirs).alias("is_low"), "tile")
    dealt = dealt.repartition(max(partitions(spark), 24), "low", "top")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = [np.asarray(x, np.int64).view(np.uint64) for x in pdf.sort_values("is_low", ascending=False)["tile"]]
        whole = np.concatenate(fps).view(np.int64)
        found = np.array(tile_links(fps[0], fps[1] if len(fps) > 1 else None, radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": whole[found[:, 0]], "b": whole[found[:, 1]]})

    return dealt.groupBy("low", "top").applyInPandas(compare, "a long, b long")


def _components(prints: DataFrame, radius: int, tile_rows: int | None) -> DataFrame:
    """``(fp, component)`` of the fingerprints in ``prints(fp, pop)``; a component is named by one
    of its fingerprints."""
    nodes = materialize(prints.select("fp", "pop").distinct(), "fingerprints")
    groups = connected_components(link_edges(nodes, radius, tile_rows))
    return nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, tile_rows: int | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Null and wordless texts have fingerprint zero and link like any other.  Repeated rows each
    get a row, and rows that share an id but not a fingerprint are told apart by the latter.
    Rows with a null id link, and link others, like any, but never name a component: where all
    ids are null, so is ``component_id``.  Other columns are not read.  An empty table gives an
    empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    # per fingerprint first, so that a fingerprint of very many rows is one row from here on
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labelled = materialize(least.join(_components(prints, radius, tile_rows), "fp"), "labelled")
    named = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialize(labelled.join(named, "component").select("fp", "component_id"), "named")
    discard(labelled)
    return prints.join(by_print, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, tile_rows: int | None = None) -> DataFrame:
    """One row of each near-duplicate group, all columns kept: one with the least id.

    Rows are told apart by a key of their own, so of repeated rows one stays, and rows with a
    null id are grouped like others; one of them stays if its group has no id.  Columns of any
    name stay as they are; an empty table stays empty.
    """

    def prints_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts)).view(np.int64))

    # written once, as the key of a row must be the same in every pass
    key, made = free_name(docs, "row_key"), free_name(docs, "row_print")
    print_of = F.pandas_udf(prints_of, "long")(F.col(text_col).cast("string"))
    held = materialize(docs.withColumn(key, F.monotonically_increasing_id()).withColumn(made, print_of), "rows")
    order = F.struct(F.col(id_col).cast("long").isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), F.col(key).alias("row"))
    prints = held.select(F.col(made).alias("fp"), F.bit_count(made).cast("int").alias("pop"), order.alias("least"))
    least = prints.groupBy("fp").agg(F.min("least").alias("least"))
    chosen = least.join(_components(prints, radius, tile_rows), "fp").groupBy("component").agg(F.min("least").alias("least"))
    return held.join(chosen.select(F.col("least.row").alias(key)), key, "left_semi").select(*[held[c] for c in docs.columns])
