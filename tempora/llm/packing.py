"""Best-fit packing planned on the histogram of piece lengths.

Documents are tokenised where they lie and reduced to pieces with a length and a checksum.
Only the histogram (at most ``capacity`` numbers) reaches the driver.  Best-fit decreasing
runs over counts: sequences with equal contents are one group, which is split only when a
length runs out inside it.  The plan is a table of (length, ranks from, first sequence,
offset); a piece takes its slot by its rank within its length.
"""

from __future__ import annotations

import bisect
import functools
import json
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 700_000


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """``(length, first_rank, first_sequence, offset)`` rows: ranks from ``first_rank`` on, up
    to the next row of that length, take consecutive sequences at ``offset``."""
    groups: dict[int, list[tuple[int, int]]] = {}  # space left -> [(first sequence, how many)]
    spaces: list[int] = []  # sorted keys of groups
    plan, fresh = [], 0

    def put(space: int, first: int, many: int) -> None:
        if space not in groups:
            groups[space] = []
            bisect.insort(spaces, space)
        groups[space].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
                used = min(many, left)
                if used < many:
                    put(space, first + used, many - used)
            else:
                space, per = capacity, capacity // length
                used = max(1, left // per) if left >= per else 1
                first, fresh = fresh, fresh + used
            plan.append((length, rank, first, capacity - space))
            rank, left = rank + used, left - used
            if space > length:
                put(space - length, first, used)
    return plan


class _Ids(dict):
    """Token ids, as little-endian bytes, of a word behind ``lead``; filled on demand, bounded."""

    def __init__(self, encode: Callable[[str], list[int]], lead: str, bare: _Ids | None = None):
        super().__init__()
        self.encode, self.lead, self.bare = encode, lead, self if bare is None else bare

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(string.punctuation)
        if core and len(core) < len(word) and core[-1].isalpha():
            ids = self[core] + self.bare[word[len(core) :]]  # punctuation after a letter is a piece of its own
        else:
            ids = _packed(self.encode(self.lead + word))
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


# Fixed value: the piece pattern of the byte-level pre-tokeniser.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WordwiseEncoder:
    """Ids of whole texts from ids of their blank-separated words.

    In a text whose only white space is single blanks and line ends between other characters,
    each blank starts a piece together with the word behind it and each line end is a piece of
    its own, so ids can be put together word by word; any other text is encoded as a whole.
    The file's vocabulary is in merge order, so its ids serve as ranks; the tests hold the ids
    against the ``tokenizers`` library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, added = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        self.encode = tiktoken.Encoding("words", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.bare = _Ids(self.encode, "")
        self.led = _Ids(self.encode, " ", self.bare)
        self.line_end = _packed(self.encode("\n"))
        self.added = {token: _packed([i]) for token, i in added.items()}

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; a special token's string stands for its id."""
        for token, ids in self.added.items():
            if token in text:
                return ids.join(map(self, text.split(token)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if text.replace("\n", " ").split(" ") != text.split():
            return _packed(self.encode(text))
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.bare[first] + b"".join(map(self.led.__getitem__, rest)))
        return self.line_end.join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordwiseEncoder:
    """One per worker process, kept over tasks."""
    return WordwiseEncoder(path)


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: full ones, of which the first may be shorter."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                ids = encode(text or "") + end
                for k, (start, n) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    out.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    Null and empty texts give one piece that holds the end id alone.  Repeated rows are packed
    each for itself; rows with a null id are packed like others.  Ties between pieces of one
    length are broken by id and piece and do not change the number of sequences.  An empty
    table gives no sequence.
    """
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, 2 * partitions(spark)))).cast("int")
    cut = materialize(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("salt", salt), "pieces")
    share = cut.groupBy("length", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = share.select("length", "salt", before.alias("before"))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = np.array(sorted(plan_slots(counts, capacity)), np.int64).reshape(-1, 4)
    plan_key = plan[:, 0] << 44 | plan[:, 1]
    held = spark.sparkContext.broadcast((plan_key, plan))  # bounded by the capacity, not by the data

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = held.value
        for pdf in batches:
            rank = pdf.pop("rank").to_numpy(np.int64)
            slot = rows[np.searchsorted(key, pdf["length"].to_numpy(np.int64) << 44 | rank, "right") - 1] if len(pdf) else rows[:0]
            yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), sequence_id=slot[:, 2] + rank - slot[:, 1], offset=slot[:, 3])

    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("local", local).join(share, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
