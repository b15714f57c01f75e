"""Phrase collocations by dynamic itemset counting.

Documents lie in ``shards`` shards, which are scanned in turn, round and round.  Single words are
counted from the first scan on.  A longer phrase is active from the scan behind that in which both
its parts, all words but the last and all but the first, have been found ``threshold`` times, and
counted for one full cycle, so its count is exact; phrases of all lengths are counted side by side,
and scanning ends when a cycle has activated none.  As no phrase is more frequent than its parts,
every frequent one is activated.

What has reached the threshold is told to the tasks by a filter of fixed size, whose bits are only
ever set: a phrase is active in a scan if the filter of that scan knows both parts, and its cycle is
over if the filter of one cycle before did.  What a filter knows by mistake costs a counter and
changes no count.

A word is known by a hash of 64 bits, seeded by its language; a longer phrase by the hash of all but
its last word together with the last word's.  Words of a text are found and hashed all at once, as
differences of running sums over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import delete
from .common import discard, materialize, scratch_path

THRESHOLD, LONGEST, TOP, SCALE, CONTAINED = 100, 5, 2000, 1000, 100
SHARDS = 3
FILTER_BITS = 26  # of the size of a filter: 8 MB
CHUNK_BYTES, HELD_BYTES, HELD_GRAMS = 1 << 20, 8 << 20, 1 << 20  # hashed at once; words and phrases summed at once
NO_LANGUAGE = "und"
_BREAK = 0xFF  # a byte of no UTF-8 text
# A to Z become lower case, what ends a piece becomes a break, a tab a blank
_FOLD = bytes(_BREAK if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BETWEEN = np.array([b in (32, _BREAK) for b in range(256)])
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_COUNTS = "word string, k int, a long, b long, n long"


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all words but the last and that of the last; as ``joined_column``."""
    h = (np.uint64(42) + _P5 + np.uint64(8)) ^ (_turn((a ^ _turn(b, 1)) * _P2, 31) * _P1)
    h = _turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def joined_column(a: Column, b: Column) -> Column:
    return F.xxhash64(a.bitwiseXOR(F.shiftleft(b, 1).bitwiseOR(F.shiftrightunsigned(b, 63))))


def _spread(x: np.ndarray) -> np.ndarray:
    """A value of its own for each of ``x``, all bits depending on all."""
    x = (x ^ (x >> np.uint64(31))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P1
    return x ^ (x >> np.uint64(32))


_LETTERS = _spread(np.arange(1, 257, dtype=np.uint64) * _P1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse, ``n`` at least."""
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", int(_P3)), ("down", pow(int(_P3), -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def words(text: bytes, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, piece, start, end)`` of the words of a folded text."""
    raw = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BETWEEN[raw], [True]))))
    start, end = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * up[: len(raw)], out=sums[1:])
    h = _spread(((sums[end] - sums[start]) * down[start]) ^ np.uint64(seed))
    piece = np.cumsum(raw == _BREAK, dtype=np.int32)
    return h, piece[start], start.astype(np.int32), end.astype(np.int32)


def chunks(texts: list[str]) -> Iterator[bytes]:
    """The folded texts, a break between them, in runs of about ``CHUNK_BYTES``."""
    held, size = [], 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield b"\xff".join(held).translate(_FOLD)
            held, size = [], 0
    if held:
        yield b"\xff".join(held).translate(_FOLD)


def known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter knows the keys: both of their bits are set."""
    size = len(bits).bit_length() + 2  # eight bits a byte
    out = np.ones(len(keys), bool)
    for at in (keys >> np.uint64(64 - size), keys & np.uint64((1 << size) - 1)):
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def active_grams(h: np.ndarray, piece: np.ndarray, now: np.ndarray, before: np.ndarray | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(k, a, b, hash)`` of the phrases to be counted among the words ``h`` of pieces."""
    # places at which a known phrase begins, its hash, and whether it was known a cycle before
    at = np.flatnonzero(known(now, h))
    key = h[at]
    old = known(before, key) if before is not None else np.zeros(len(at), bool)
    for k in range(2, longest + 1):
        beside = np.flatnonzero(at[1:] == at[:-1] + 1)  # both parts of a phrase of k words are known
        if k == 2:
            beside = beside[piece[at[beside]] == piece[at[beside] + 1]]
        if not len(beside):
            return
        both_old = old[beside] & old[beside + 1]
        at = at[beside]
        a, b = key[beside], h[at + k - 1]
        new = joined(a, b)
        yield k, a[~both_old], b[~both_old], new[~both_old]
        if k < longest:
            ok = known(now, new)
            at, key, old = at[ok], new[ok], both_old[ok]
            if before is not None:
                old &= known(before, key)


def summed(found: list[tuple[np.ndarray, ...]], k: int) -> pd.DataFrame:
    a, b, new = (np.concatenate(x) for x in zip(*found, strict=True))
    _, first, n = np.unique(new, return_index=True, return_counts=True)
    return pd.DataFrame({"word": None, "k": k, "a": a[first].view(np.int64), "b": b[first].view(np.int64), "n": n})


def spelled_words(held: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]], lang: str) -> pd.DataFrame:
    """Counts of the words of some texts, and in a last row of all."""
    h = np.concatenate([x[1] for x in held])
    _, first, n = np.unique(h, return_index=True, return_counts=True)
    offset = np.cumsum([0] + [len(x[1]) for x in held])
    of = np.searchsorted(offset, first, "right") - 1
    names = []
    for c, i in zip(of.tolist(), (first - offset[of]).tolist(), strict=True):
        text, _, start, end = held[c]
        names.append(f"{lang}\t{text[start[i] : end[i]].decode('utf-8', 'surrogatepass')}")
    told = pd.DataFrame({"word": names, "k": 1, "a": h[first].view(np.int64), "b": 0, "n": n})
    return pd.concat([told, pd.DataFrame({"word": [f"{lang}\t"], "k": 0, "a": 0, "b": 0, "n": len(h)})])


def scan(shard: DataFrame, now: Broadcast, before: Broadcast | None, count_words: bool, longest: int) -> DataFrame:
    """Counts of one scan, summed a bounded part at a time: phrases by ``(k, a, b)``; where words are
    counted, these by language and word, set apart by a tab, with k = 1 and their hash in a, and all
    words of a language with k = 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[int, list] = {}
        many = 0
        for pdf in batches:
            for lang, texts in pdf.groupby("lang", sort=False)["text"]:
                seed, held, size = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")), [], 0
                for text in chunks(texts.tolist()):
                    h, piece, start, end = words(text, seed)
                    for k, *found in active_grams(h, piece, now.value, None if before is None else before.value, longest):
                        grams.setdefault(k, []).append(found)
                        many += len(found[0])
                    if many >= HELD_GRAMS:
                        for k in list(grams):
                            yield summed(grams.pop(k), k)
                        many = 0
                    if count_words and len(h):
                        held.append((text, h, start, end))
                        size += len(text)
                        if size >= HELD_BYTES:
                            yield spelled_words(held, lang)
                            held, size = [], 0
                if held:
                    yield spelled_words(held, lang)
        for k in list(grams):
            yield summed(grams.pop(k), k)

    return shard.mapInPandas(run, _COUNTS)


def _bits(reached: DataFrame, size: int) -> np.ndarray:
    """The filter of the phrases in ``reached(k, a, b)``, summed into at most 2^(size - 6) numbers."""
    key = F.when(F.col("k") == 1, F.col("a")).otherwise(joined_column(F.col("a"), F.col("b")))
    at = reached.select(key.alias("key")).select(F.explode(F.array(F.shiftrightunsigned("key", 64 - size), F.col("key").bitwiseAND((1 << size) - 1))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    rows = at.groupBy(F.shiftright("at", 6).alias("place")).agg(F.bit_or(one).alias("bits")).toPandas()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[rows["place"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


def frequent_counts(docs: DataFrame, threshold: int, longest: int, shards: int, filter_bits: int) -> DataFrame:
    """``(lang, word, k, a, b, n)`` of all words and phrases found ``threshold`` times, and the number
    of words of each language, k = 0."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    docs.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path)
    held = spark.read.schema("lang string, text string, shard int").parquet(path)
    state, step = None, 0
    filters = [np.zeros(1 << (filter_bits - 3), np.uint8)]
    sent: list[Broadcast] = []
    while step < shards or not np.array_equal(filters[step], filters[step - shards]):
        sent.append(spark.sparkContext.broadcast(filters[step]))
        before = sent[step - shards] if step >= shards else None
        made = scan(held.where(F.col("shard") == step % shards).select("lang", "text"), sent[step], before, step < shards, longest)
        made = made.withColumns({"age": F.lit(1), "last": F.lit(0).cast("long")})
        if state is not None:
            made = made.unionByName(state.withColumns({"age": F.col("age") + 1, "last": F.col("n")}))
        sums = made.groupBy("word", "k", "a", "b").agg(F.sum("n").alias("n"), F.max("age").alias("age"), F.sum("last").alias("last"))
        # a counter whose cycle is over is kept if it has reached the threshold
        sums = materialize(sums.where((F.col("k") == 0) | (F.col("n") >= threshold) | (F.col("age") < shards)), "counters")
        if state is not None:
            discard(state)
        state = sums
        reached = sums.where(F.col("k").between(1, longest - 1) & (F.col("n") >= threshold) & (F.col("last") < threshold))
        filters.append(filters[step] | _bits(reached, filter_bits))
        if step >= shards:
            sent[step - shards].destroy()
            filters[step - shards] = None
        step += 1
    delete(spark, path)
    lang = F.regexp_extract("word", r"(?s)^(.*)\t[^\t]*$", 1)
    counts = state.where((F.col("k") == 0) | (F.col("n") >= threshold))
    return counts.select(lang.alias("lang"), F.substring_index("word", "\t", -1).alias("word"), "k", "a", "b", "n")


def spelled(counts: DataFrame, longest: int) -> DataFrame:
    """``(lang, words, f)`` of the words and phrases in ``frequent_counts()``."""
    singles = materialize(counts.where("k = 1").select("lang", F.array("word").alias("words"), F.col("a").alias("key"), F.col("n").alias("f")), "phrases1")
    lasts = singles.select(F.col("key").alias("b"), F.col("words").alias("last"))
    shorter, out = singles, singles.drop("key")
    for k in range(2, longest + 1):
        rows = counts.where(F.col("k") == k).select("a", "b", F.col("n").alias("f"))
        rows = rows.join(shorter.select("lang", "words", F.col("key").alias("a")), "a").join(lasts, "b")
        shorter = materialize(rows.select("lang", F.concat("words", "last").alias("words"), joined_column(F.col("a"), F.col("b")).alias("key"), "f"), f"phrases{k}")
        out = out.unionByName(shorter.drop("key"))
    return out


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, scale: int = SCALE, contained: int = CONTAINED, shards: int = SHARDS, filter_bits: int = FILTER_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its lowest-scoring cut, ``n`` all
    words of the language; the score is floor(scale a n / (l r)).  A phrase goes if a longer one
    that holds it occurs in at least ``contained`` percent of its places.  A null language is
    ``und``, null and empty texts have no words, repeated rows count each.  Other columns are not
    read.  An empty table, or one without frequent phrases, gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = frequent_counts(rows, threshold, longest, shards, filter_bits)
    phrases = materialize(spelled(counts, longest).withColumn("phrase", F.array_join("words", " ")), "phrases")
    told = phrases.where(F.size("words") > 1)
    part = lambda first, many: F.array_join(F.slice("words", first, many), " ")
    cuts = told.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", F.size("words").alias("size"), "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("words") - F.col("cut")).alias("right"))
    of = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    cuts = cuts.join(counts.where("k = 0").select("lang", "n"), "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", F.lit(scale).cast("decimal(19,0)") * exact("a") * exact("n")).withColumn("under", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("over div under").cast("long"))
    best = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inner = told.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def sql(threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, scale: int = SCALE, contained: int = CONTAINED) -> str:
    """The same phrases as DuckDB SQL, by counting every phrase of every length."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH p AS (SELECT lang, row_number() OVER () AS piece, words FROM (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents)),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
g AS (SELECT lang, words[i:i + k - 1] AS g, k FROM (SELECT *, unnest(range(1, {longest + 1})) AS k FROM s) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, any_value(k) AS k, count(*) AS f FROM g GROUP BY 1, 2),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND f >= {threshold}),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, n, l.f AS l, r.f AS r, CAST((CAST({scale} AS HUGEINT) * c.f * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, cut FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.g[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.g[cut + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts) WHERE nth = 1),
inside AS (SELECT lang, array_to_string(g[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < {contained} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}"""
