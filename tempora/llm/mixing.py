"""Mixing sources to target weights with hash-threshold histograms.

Every document has a place between 0 and 2^60, a hash of its id and text.  A mix takes whole copies
of a source's documents, and one more of those whose place lies below a threshold, so mixes of
growing budgets are nested.  A threshold is found without sorting: sizes are summed by source and by
the first bits of the place, the bucket in which the budget ends is found in that histogram, and only
the rows of this bucket are summed again by their next bits, until it holds one row.  Rows that
agree in id and text share a place; a number of their own, given once, goes on behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARE, WEIGHTS, MOST = 1.5, (5, 2, 1), 2
WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, PLACE_BITS, ROW_BITS = 12, 60, 72
BROADCAST_BYTES = 16 << 20
SALTS = 64


def place(id_col: Column, text: Column) -> Column:
    """60 bits of the digest of id and text."""
    whole = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(whole, 1, PLACE_BITS // 4), 16, 10).cast("long")


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, size, h, row)``, written once, as ``row`` must be the same in every pass."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    number = F.col(id_col).cast("long")
    rows = docs.select(number.alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), place(number, text).alias("h"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sized")


def weighed_sources(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``(source, source_size, weight)``: the weights in turn, by code point, null last.

    Sources are sorted in ranges; a source's rank is its place in its range behind those of the
    ranges before, so only counts of ranges meet in one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    held = materialize(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("nth", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("nth", 33).alias("part")
    before = held.groupBy(part).count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    ranked = held.select("source", "source_size", part, F.col("nth").bitwiseAND((1 << 33) - 1).alias("nth")).join(F.broadcast(before), "part")  # a row per task
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("before") + F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    return materialize(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "weighed")


def _level(sources: DataFrame, share: Fraction, most: int) -> tuple[Fraction, int]:
    """What is left for the sources below their limit, and their weight: ``(rest, weight)``.

    Sources whose limit lies below the level are filled up, which raises the level for the others,
    until none is above; a round sums the sources once.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    full, seen = F.lit(False), None
    while True:
        row = sources.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        rest, weight = share * int(row[0] or 0) - most * int(row[1] or 0), int(row[2] or 0)
        if row[3] == seen or not weight:
            return rest, weight
        seen = row[3]
        full = exact(F.col("source_size")) * exact(F.lit(most * weight * rest.denominator)) <= exact(F.col("weight")) * exact(F.lit(rest.numerator))


def targets(sources: DataFrame, shares: Sequence[float], most: int = MOST) -> DataFrame:
    """``sources`` with ``target_<k>``, ``copies_<k>`` and ``left_<k>`` of every share: the words to
    take, the whole copies in them and the rest."""
    size = F.col("source_size")
    for k, share in enumerate(shares):
        rest, weight = _level(sources, Fraction(share).limit_denominator(10**6), most)
        limit = (size * most).cast("double")
        target = F.least(limit, F.col("weight") * F.lit(float(rest)) / F.lit(float(weight))) if weight else limit
        copies = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
        sources = sources.withColumn(f"target_{k}", target).withColumn(f"copies_{k}", copies)
        sources = sources.withColumn(f"left_{k}", F.col(f"target_{k}") - F.col(f"copies_{k}") * size)
    return materialize(sources, "targets")


def _beside(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their source.  A table of sources up to ``BROADCAST_BYTES`` is
    broadcast; a larger one is repeated for salts, so that a source of very many rows spreads."""
    n, text = per_source.agg(F.count("*"), F.sum(F.octet_length("source"))).first()
    other = per_source.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if n * 16 * len(per_source.columns) + (text or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(other), same, how).drop("_source")
    other = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("h", "row"), F.lit(SALTS)).cast("int"))
    return rows.join(other, same & (F.col("salt") == F.col("_salt")), how).drop("_source", "_salt", "salt")


def thresholds(sized: DataFrame, sources: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(source, goal, h_cut, row_cut)``: rows below the cut are taken once more, so that their
    sizes come as near to what is left of the goal as whole documents allow.  A goal without a row
    has nothing left."""
    goals = F.explode(F.array(*[F.struct(F.lit(k).alias("goal"), F.col(f"left_{k}").alias("remain")) for k in range(len(shares))])).alias("g")
    aims = sources.select("source", goals).select("source", "g.*").where("remain > 0").withColumns({"hp": F.lit(0).cast("long"), "rp": F.lit(0).cast("long")})
    pool = sized.select("source", "h", "row", "size").withColumns({"hp": F.lit(0).cast("long"), "rp": F.lit(0).cast("long")})
    done, key = None, ["source", "hp", "rp"]
    for used in range(0, PLACE_BITS + ROW_BITS, LEVEL_BITS):
        by_row = used >= PLACE_BITS
        shift = (PLACE_BITS + ROW_BITS if by_row else PLACE_BITS) - LEVEL_BITS - used
        digit = F.shiftright("row" if by_row else "h", shift).bitwiseAND((1 << LEVEL_BITS) - 1)
        bars = pool.groupBy(*key, digit.alias("digit")).agg(F.sum("size").alias("t"), F.count("*").alias("n"))
        bars = bars.withColumn("before", F.sum("t").over(Window.partitionBy(*key).orderBy("digit")) - F.col("t"))
        bars = bars.select(*[F.col(c).alias(f"_{c}") for c in key], "digit", "t", "n", "before")
        within = (F.col("before") <= F.col("remain")) & (F.col("remain") < F.col("before") + F.col("t"))
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("hp") == F.col("_hp")) & (F.col("rp") == F.col("_rp"))
        longer = lambda c: F.shiftleft(c, LEVEL_BITS).bitwiseOR(F.col("digit"))
        found = aims.join(bars, same & within).select("source", "goal", "t", "n", (F.col("remain") - F.col("before")).alias("remain"), F.col("hp") if by_row else longer("hp").alias("hp"), longer("rp").alias("rp") if by_row else F.col("rp"))
        found = materialize(found, "edges")
        upto = F.col("rp" if by_row else "hp") + (2 * F.col("remain") >= F.col("t")).cast("long")
        cut = found.where("n = 1").select("source", "goal", (F.col("hp") if by_row else F.shiftleft(upto, shift)).alias("h_cut"), (F.shiftleft(upto, shift) if by_row else F.lit(0).cast("long")).alias("row_cut"))
        done = cut if done is None else done.union(cut)
        aims = found.where("n > 1").drop("t", "n")
        if aims.isEmpty():
            break
        # the rows of the buckets in which a budget ends, and of no other
        nodes = aims.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
        pool = pool.withColumn("digit", digit)
        pool = pool.withColumn("rp" if by_row else "hp", longer("rp" if by_row else "hp")).drop("digit")
        pool = materialize(pool.join(nodes, same, "left_semi"), "boundary")
    return done


def mixes(docs: DataFrame, shares: Sequence[float] = (SHARE,), weights: Sequence[int] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size)`` of every row of ``docs``, and ``target_<k>`` and ``taken_<k>``
    for every share: the words of its source that the mix of that share is to hold, and the words
    of this row that it holds, copies counted.

    A share is the mix's words over all words.  It is dealt to the sources by weight; no source
    gives more than ``most`` times its words, the excess goes to the others by weight.  A null
    source is one of its own, null and wordless texts have size 0, null ids are placed by their
    text.  Repeated rows are taken each for itself; which of them is taken may change between runs,
    the result does not, as they are equal.  Other columns are not read.  An empty table gives an
    empty result; a source without words has target 0.
    """
    sized = sized_rows(docs, id_col, text_col, source_col)
    sources = targets(weighed_sources(sized, weights), shares, most)
    cuts = thresholds(sized, sources, shares)
    pick = lambda k, c: F.max(F.when(F.col("goal") == k, F.col(c))).alias(f"{c}_{k}")
    wide = cuts.groupBy("source").agg(*[pick(k, c) for k in range(len(shares)) for c in ("h_cut", "row_cut")]).withColumnRenamed("source", "_source")
    per_source = sources.join(wide, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "weight")
    rows = _beside(sized, materialize(per_source, "cuts"))
    out = []
    for k in range(len(shares)):
        h, row = F.col(f"h_cut_{k}"), F.col(f"row_cut_{k}")
        below = F.coalesce((F.col("h") < h) | ((F.col("h") == h) & (F.col("row") < row)), F.lit(False))
        out += [F.col(f"target_{k}"), (F.col("size") * (F.col(f"copies_{k}") + below.cast("long"))).alias(f"taken_{k}")]
    return rows.select("doc_id", "size", "source_size", *out)


def mix(docs: DataFrame, share: float = SHARE, weights: Sequence[int] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: ``mixes()`` of one share."""
    return mixes(docs, (share,), weights, most, id_col, text_col, source_col).withColumnsRenamed({"target_0": "target", "taken_0": "taken"})


def sql(share: float = SHARE, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> str:
    """The same mix as DuckDB SQL, which sorts documents by place and sums their sizes up."""
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {list(weights)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS w FROM d GROUP BY 1),
o AS (SELECT *, {share} * sum(source_size) OVER () - {most} * (sum(source_size) OVER up - source_size) AS rest, sum(w) OVER () - (sum(w) OVER up - w) AS left_w FROM s WINDOW up AS (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, {most} * source_size * left_w <= rest * w AS full_up FROM o),
l AS (SELECT {share} * sum(source_size) - {most} * coalesce(sum(source_size) FILTER (full_up), 0) AS rest, sum(w) FILTER (NOT full_up) AS left_w FROM c),
t AS (SELECT source, source_size, least(CAST({most} * source_size AS DOUBLE), coalesce(w * CAST(l.rest AS DOUBLE) / CAST(l.left_w AS DOUBLE), {most} * source_size)) AS target FROM c, l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies, sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN target - copies * source_size > 0 AND 2 * (target - copies * source_size - before) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
