"""Trie of conversation prefixes from sorted sequences, their common prefix lengths and
range-minimum tables.

A conversation is the sequence of its turns' digests.  Distinct sequences are sorted in ranges, so
those that share a prefix lie side by side.  In a block of sorted sequences, each candidate prefix
binary-searches how far to the left and to the right the common prefix lengths of neighbours stay at
or above its own length, on a sparse table of their minima.  That interval holds its members; what a
node tells is a difference of running sums, or a range minimum, over it.  Nodes whose interval
reaches over the edge of a block are put together from the parts that the blocks give; there are at
most twice as many of these in a block as turns in its first and last sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

WORD = r"[^\x20\x09-\x0D]+"
FAMILY, HEADS = 20, 4
DIGEST = 32  # characters of a turn's digest
BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 20  # of the sequences that a task holds at once
CHUNK_IDS = 8192
BROADCAST_ROWS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODES = "pid string, depth long, conv_id long, parent_pid string, parent_conv_id long, n_convs long, n_children long, n_leaves long, member_words long, node_words long, ends_sha256 string"


def turn_sequences(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, turns)``: digest and words of every turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("d"), words.alias("w")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Sequences that open with the first turns of the family's first conversation, as many as
    the id's checksum says, instead of their own first ones."""
    seqs = materialize(seqs, "turns")
    heads = seqs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    both = seqs.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_first"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, h)
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ``(sid, conv_id)`` to runs of ids, so that a sequence of very many members comes to
    the task that hashes it as few rows."""
    for pdf in batches:
        sid, ids = pdf["sid"].to_numpy(), pdf["conv_id"].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1]))) if len(sid) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(sid))
        cuts = [(a, min(a + CHUNK_IDS, e)) for s, e in zip(starts, ends, strict=True) for a in range(s, e, CHUNK_IDS)]
        yield pd.DataFrame({"sid": [sid[a] for a, _ in cuts], "least": [ids[a] for a, _ in cuts], "n": [b - a for a, b in cuts], "ids": [",".join(map(str, ids[a:b])) for a, b in cuts]})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids, sorted, to one row a sequence: members, least id and the digest of the ids."""
    sid, least, n, state = None, 0, 0, None
    for pdf in batches:
        out = []
        for s, a, k, ids in zip(pdf["sid"], pdf["least"], pdf["n"], pdf["ids"], strict=True):
            if s != sid:
                if sid is not None:
                    out.append((sid, least, n, state.hexdigest()))
                sid, least, n, state = s, a, 0, hashlib.sha256()
            elif n:
                state.update(b",")
            state.update(ids.encode())
            n += k
        yield pd.DataFrame(out, columns=["sid", "least", "n", "ends"])
    if sid is not None:
        yield pd.DataFrame([(sid, least, n, state.hexdigest())], columns=["sid", "least", "n", "ends"])


def members(seqs: DataFrame) -> DataFrame:
    """``(seq, words, least, n, ends)``: every distinct sequence once, with its conversations."""
    n = partitions(seqs.sparkSession)
    digests = F.array_join(F.transform("turns", lambda t: t["d"]), "")
    rows = seqs.select("conv_id", digests.alias("seq"), F.transform("turns", lambda t: t["w"]).alias("words"))
    rows = materialize(rows.withColumn("sid", F.md5("seq")), "sequences")
    runs = rows.select("sid", "conv_id").repartitionByRange(n, "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    runs = runs.mapInPandas(_chunks, "sid string, least long, n long, ids string")
    told = runs.repartition(n, "sid").sortWithinPartitions("sid", "least").mapInPandas(_digests, "sid string, least long, n long, ends string")
    texts = rows.groupBy("sid").agg(F.first("seq").alias("seq"), F.first("words").alias("words"))
    return texts.join(told, "sid").select("seq", "words", "least", "n", "ends")


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """``table[j][i]``: the least of the 2^j values from ``i`` on."""
    table = [values]
    while 2 * (1 << (len(table) - 1)) <= len(values):
        last, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(last[:-half], last[half:]))
    return table


def range_min(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]``, none of which is empty."""
    power = np.frexp(high - low)[1] - 1
    out = np.empty(len(low), table[0].dtype)
    for j in np.unique(power):
        at = power == j
        out[at] = np.minimum(table[j][low[at]], table[j][high[at] - (1 << j)])
    return out


def extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(low, high)``: the widest stretch around each ``at`` in which neighbours share ``depth``
    turns; ``table`` is that of the lengths shared with the neighbour before."""
    n = len(table[0])
    low, high = at.copy(), at + 1
    for j in range(len(table) - 1, -1, -1):
        step = 1 << j
        to = low - step + 1
        fits = to >= 1
        fits[fits] = table[j][to[fits]] >= depth[fits]
        low = np.where(fits, low - step, low)
        fits = high + step <= n
        fits[fits] = table[j][high[fits]] >= depth[fits]
        high = np.where(fits, high + step, high)
    return low, high


def shared_lengths(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before; 0 for the first."""
    out = np.zeros(len(size), np.int64)
    live, e = np.arange(1, len(size)), 0
    while len(live):
        live = live[(size[live] > e) & (size[live - 1] > e)]
        live = live[flat[start[live] + e] == flat[start[live - 1] + e]]
        e += 1
        out[live] = e
    return out


def block_nodes(pdf: pd.DataFrame, before: int, behind: int) -> pd.DataFrame:
    """Nodes of a block of sorted distinct sequences, of which the first shares ``before`` turns with
    the one before the block, and the last ``behind`` turns with the one behind it, -1 where there
    is none.  Nodes that reach over the edge have a ``pid`` and tell what this block adds to them."""
    n = len(pdf)
    size = np.array([len(s) // DIGEST for s in pdf["seq"]], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    raw = "".join(pdf["seq"]).encode()
    flat = np.unique(np.frombuffer(raw, f"S{DIGEST}"), return_inverse=True)[1] if raw else np.zeros(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(np.concatenate([np.asarray(w, np.int64) for w in pdf["words"]]))))  # words before a turn
    words = upto[start + size] - upto[start]
    shared = shared_lengths(flat, start, size)
    table = sparse_table(shared)
    real = shared.copy()
    real[0] = before
    count, least = pdf["n"].to_numpy(np.int64), pdf["least"].to_numpy(np.int64)
    leaf = np.append(shared[1:], behind) < size
    # candidates: what a sequence does not share with the one before; of the first one all prefixes
    first_depth = real + 1
    first_depth[0] = 0
    many = np.maximum(size - first_depth + 1, 0)
    at = np.repeat(np.arange(n), many)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first_depth[at]
    low, high = extents(table, at, depth)
    up_low, up_high = extents(table, at, np.maximum(depth - 1, 0))
    running = lambda v: np.concatenate(([0], np.cumsum(v)))
    over = lambda v: (r := running(v))[high] - r[low]
    n_convs = over(count)
    head = upto[start[low] + np.maximum(depth - 1, 0)] - upto[start[low]]  # words above the node
    member_words = over(count * words) - n_convs * head
    fresh = words - (upto[start + np.maximum(real, 0)] - upto[start])
    known = real[low] >= depth  # the block before has counted what the first sequence shares with it
    node_words = over(fresh) - fresh[low] + np.where(known, fresh[low], words[low] - head)
    key = low * (int(size.max()) + 2) + depth
    order = np.argsort(key)
    parent = order[np.searchsorted(key, up_low * (int(size.max()) + 2) + depth - 1, sorter=order) % max(len(order), 1)]
    n_children = np.bincount(parent[(depth > 0) & ~known], minlength=len(at)) if len(at) else np.zeros(0, np.int64)
    ends = np.where((size[low] == depth) & ~known, pdf["ends"].to_numpy(object)[low], NO_ENDS)
    smallest = sparse_table(least)
    open_at = lambda lo, hi, d: (((lo == 0) & (d <= before)), ((hi == n) & (d <= behind)))
    name = lambda i, d: hashlib.md5(pdf["seq"].iloc[i][: d * DIGEST].encode()).hexdigest() + f":{d}"

    def names(lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> np.ndarray:
        left, right = open_at(lo, hi, d)
        out, held = np.full(len(lo), None, object), {}
        for k in np.flatnonzero((left | right) & (d >= 0)):
            which = (0 if left[k] else n - 1, int(d[k]))
            if which not in held:
                held[which] = name(*which)
            out[k] = held[which]
        return out

    pid, parent_pid = names(low, high, depth), names(up_low, up_high, depth - 1)
    up = pd.array(range_min(smallest, up_low, up_high), "Int64")
    up[(depth == 0) | (parent_pid != None)] = pd.NA  # noqa: E711
    return pd.DataFrame({"pid": pid, "depth": depth, "conv_id": range_min(smallest, low, high), "parent_pid": parent_pid, "parent_conv_id": up, "n_convs": n_convs, "n_children": n_children, "n_leaves": over(leaf.astype(np.int64)), "member_words": member_words, "node_words": node_words, "ends_sha256": ends})


def shared_turns(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n : n + DIGEST] == b[n : n + DIGEST]:
        n += DIGEST
    return n // DIGEST


def trie_parts(ordered: DataFrame, block_rows: int, block_turns: int) -> DataFrame:
    """Nodes, and parts of those that reach over the edge of a block, of ``ordered(block, seq,
    words, least, n, ends)``: ranges of sorted sequences."""
    spark = ordered.sparkSession
    edges: dict[int, list[int]] = {}
    last = None
    # two sequences a range; only the lengths that neighbours share are kept
    for row in ordered.groupBy("block").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).orderBy("block").toLocalIterator():
        edges[row["block"]] = [-1, -1]
        if last is not None:
            edges[row["block"]][0] = edges[last[0]][1] = shared_turns(last[1], row["first"])
        last = (row["block"], row["last"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, block, rows, turns, before = [], None, 0, 0, -1  # of one range, not yet told
        for pdf in batches:
            blocks, size = pdf["block"].to_numpy(), pdf["seq"].str.len().to_numpy(np.int64) // DIGEST
            at = 0
            while at < len(pdf):
                if blocks[at] != block:
                    if held:
                        yield block_nodes(pd.concat(held, ignore_index=True), before, edges[block][1])
                    held, block, rows, turns, before = [], blocks[at], 0, 0, edges[blocks[at]][0]
                elif held and (rows >= block_rows or turns >= block_turns):
                    behind = shared_turns(held[-1]["seq"].iloc[-1], pdf["seq"].iloc[at])
                    yield block_nodes(pd.concat(held, ignore_index=True), before, behind)
                    held, rows, turns, before = [], 0, 0, behind
                end = min(at + block_rows - rows, int(np.searchsorted(blocks, block, "right")))
                end = min(end, at + 1 + int(np.searchsorted(np.cumsum(size[at:end]), block_turns - turns)))
                held.append(pdf.iloc[at:end])
                rows, turns, at = rows + end - at, turns + int(size[at:end].sum()), end
        if held:
            yield block_nodes(pd.concat(held, ignore_index=True), before, edges[block][1])

    spread = ordered.repartition(partitions(spark), "block").sortWithinPartitions("block", "seq")
    return spread.mapInPandas(run, _NODES)


def prefix_trie(seqs: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Nodes of the trie of ``seqs(conv_id, turns)``, one row each; see ``conversation_trie()``."""
    spark = seqs.sparkSession
    groups = materialize(members(seqs), "groups")
    ordered = groups.repartitionByRange(partitions(spark), "seq").withColumn("block", F.spark_partition_id())
    parts = materialize(trie_parts(materialize(ordered, "ordered"), block_rows, block_turns), "nodes")
    sums = ("n_convs", "n_children", "n_leaves", "member_words", "node_words")
    ends = F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256")
    open_nodes = parts.where("pid is not null").groupBy("pid", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_pid").alias("parent_pid"), *[F.sum(c).alias(c) for c in sums], ends)
    open_nodes = materialize(open_nodes, "open")
    names = open_nodes.select(F.col("pid").alias("_pid"), F.col("conv_id").alias("_conv"))
    if names.count() <= BROADCAST_ROWS:  # else the long side of a skewed key is split at run time
        names = F.broadcast(names)
    whole = parts.where("pid is null").drop("pid").unionByName(open_nodes.drop("pid").withColumn("parent_conv_id", F.lit(None).cast("long")))
    rows = whole.join(names, F.col("parent_pid") == F.col("_pid"), "left")
    saved = (F.col("member_words") - F.col("node_words")).alias("saved_tokens")
    return rows.select("conv_id", "depth", F.coalesce("_conv", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved, "ends_sha256")


def conversation_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``
    for every distinct prefix of the rebuilt conversations.

    Turns are ordered by ``turn``, null first, then by digest, repeated ones each a turn; null roles
    and texts are empty.  Rows with a null id belong to no conversation and are left out.  A
    conversation left without turns is a member of the root.  Other columns are not read.  An empty
    table has no root.  A conversation is held as a row of digests, 40 bytes a turn; members of a
    node are never gathered, but for the digest of those that end in it, into which their ids go
    in runs.
    """
    return prefix_trie(rebuilt(turn_sequences(conversations)), block_rows, block_turns)


def sql() -> str:
    """The same nodes as DuckDB SQL, by all prefixes of all conversations."""
    return rf"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS d, len(regexp_extract_all(text, '{WORD}')) AS w, turn FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k FROM o),
ids AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 20 AS b FROM t),
crc AS (SELECT c, b, h FROM ids JOIN (SELECT c AS c2, {_crc32_sql('c')} % 4 AS h FROM ids) ON c = c2),
r AS (SELECT c, k, d, w FROM crc JOIN k ON conv_id = b AND k <= h UNION ALL SELECT c, k, d, w FROM crc JOIN k ON conv_id = c AND k > h),
p AS (SELECT c, w, d, row_number() OVER (PARTITION BY c ORDER BY k) AS depth FROM r),
q AS (SELECT c, depth, w, string_agg(d, '') OVER (PARTITION BY c ORDER BY depth) AS path FROM p),
paths AS (SELECT c, depth, w, path FROM q UNION ALL SELECT c, 0, 0, '' FROM ids),
last AS (SELECT c, max(depth) AS d FROM paths GROUP BY 1),
nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = d) AS ends FROM paths JOIN last USING (c) GROUP BY 1, 2),
kids AS (SELECT left(path, CAST(32 * (depth - 1) AS INTEGER)) AS up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.up),
below AS (SELECT left(path, CAST(32 * a AS INTEGER)) AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN below ON n.path = top LEFT JOIN nodes u ON n.depth > 0 AND u.path = left(n.path, CAST(32 * (n.depth - 1) AS INTEGER))"""


def _crc32_sql(column: str) -> str:
    """crc32 of the decimal form, bit by bit, as DuckDB has no such function."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)::BIGINT[]), lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))))"
