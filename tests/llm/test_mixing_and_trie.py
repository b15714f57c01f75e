"""Source mixing against its SQL, the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from tempora.llm import mixing, prefix_trie

DOCS = "doc_id long, text string, source string, size string, h string, row string, digit string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(spark, rows, **options):
    return mixing.mix(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS), **options).toPandas()


def mixed_by_sql(rows, **options):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64", "text": "string", "source": "string"}))
    return con.execute(mixing.sql(**options)).df()


def corpus(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "\U0001f600", None, ""]
    rows = [(k, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 3, 40, 200]))), rng.choice(sources + ["a"] * 6)) for k in range(300)]
    return rows + [(None, "x y z", "a")] * 40 + [(None, None, "b"), (7, "", "b"), (8, " \n", "empty")] + [(9, "long " * 5000, "b")] + [rows[3]] * 60


@pytest.mark.parametrize("share,weights,most", [(1.5, (5, 2, 1), 2), (0.3, (1, 4), 2), (2.0, (5, 2, 1), 2), (0.75, (3,), 1)])
def test_mix_equals_sql(spark, share, weights, most):
    rows = corpus(len(weights))
    made, told = mixed(spark, rows, share=share, weights=weights, most=most), mixed_by_sql(rows, share=share, weights=weights, most=most)
    order = ["doc_id", "size", "source_size", "taken"]
    left, right = (f.sort_values(order).reset_index(drop=True)[["doc_id", "size", "source_size", "target", "taken"]].astype(float) for f in (made, told))
    pd.testing.assert_frame_equal(left, right, rtol=1e-12)
    assert (made["taken"] <= most * made["size"]).all()


def test_mix_comes_near_its_targets_and_agrees_between_runs(spark):
    rows = corpus(5)
    made, again = mixed(spark, rows), mixed(spark, list(reversed(rows)))
    sums = made.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert ((sums["taken"] - sums["target"]).abs() <= sums["largest"] / 2 + 1e-6).all()
    assert abs(made["taken"].sum() - 1.5 * made["size"].sum()) <= made.groupby("source_size")["size"].max().sum()
    order = ["doc_id", "size", "source_size", "taken"]
    assert made.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True)[made.columns])


def test_copies_of_one_row_are_split(spark):
    """Equal rows share a place, so that only their numbers tell them apart."""
    made = mixed(spark, [(1, "a b c", "s")] * 200, share=0.5)
    assert made["taken"].sum() == 300


def test_mixes_of_growing_shares_are_nested(spark):
    rows = corpus(8)
    made = mixing.mixes(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS), shares=(0.2, 0.6, 1.1, 1.9)).toPandas()
    for k in range(3):
        assert (made[f"taken_{k}"] <= made[f"taken_{k + 1}"]).all()


def test_sources_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = corpus(2)
    whole = mixed(spark, rows)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    order = ["doc_id", "size", "source_size", "taken"]
    assert mixed(spark, rows).sort_values(order).reset_index(drop=True).equals(whole.sort_values(order).reset_index(drop=True))


def test_mix_of_nothing(spark):
    assert mixed(spark, [(1, "a", "s")]).shape[0] == 1
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixed(spark, [(1, None, None), (2, "", "s")])["taken"].sum() == 0


TURNS = "conv_id long, turn long, role string, text string, turns string, seq string"


def brute_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[conv].append(((turn is not None, turn or 0), digest, len(WORD.findall(text))))
    own = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(members) - 1) * (path[-1][1] if path else 0)
    ends = lambda path, members: hashlib.sha256(",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path)).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in nodes.items())


def trie(spark, rows, **options):
    made = prefix_trie.conversation_trie(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS), **options).fillna(-1, ["parent_conv_id"])
    return sorted(tuple(r) for r in made.collect())


def conversations(seed, ids=120, texts=("x y", "z", "", None)):
    rng, rows = random.Random(seed), []
    for c in [*rng.sample(range(200), ids), None]:
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["u", "a", None]), rng.choice(texts)) for t in range(rng.randrange(0, 7))]
    return rows + rows[:3]


@pytest.mark.parametrize("block_rows,block_turns", [(3, 1000), (1, 1), (1000, 5), (1 << 16, 1 << 20)])
def test_trie_equals_brute_force_at_any_block_size(spark, block_rows, block_turns):
    rows = conversations(block_rows)
    assert trie(spark, rows, block_rows=block_rows, block_turns=block_turns) == brute_trie(rows)


def test_trie_of_many_copies_and_long_texts(spark):
    """Copies outnumber a run of ids; a very long turn; conversations that only open like others."""
    rows = [(20 * c, t, "u", f"w{t} " * 3) for c in range(60) for t in range(3)] + [(20 * c + 1, 0, "u", "long " * 20_000) for c in range(5)] + [(5, 0, "a", "only")]
    old, prefix_trie.CHUNK_IDS = prefix_trie.CHUNK_IDS, 4
    try:
        assert trie(spark, rows, block_rows=2) == brute_trie(rows)
    finally:
        prefix_trie.CHUNK_IDS = old


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "u", "x")]) == []
    lone = [(c, 0, "u", "x") for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0]
    assert trie(spark, lone) == brute_trie(lone)
    assert len(brute_trie(lone)) == 1


def test_extents_equal_a_walk():
    import numpy as np

    rng = np.random.default_rng(4)
    shared = rng.integers(0, 5, 200)
    table, at, depth = prefix_trie.sparse_table(shared), np.repeat(np.arange(200), 6), np.tile(np.arange(6), 200)
    low, high = prefix_trie.extents(table, at, depth)
    for i, d, lo, hi in zip(at, depth, low, high, strict=True):
        a, b = i, i + 1
        while a > 0 and shared[a] >= d:
            a -= 1
        while b < 200 and shared[b] >= d:
            b += 1
        assert (a, b) == (lo, hi)
    assert (prefix_trie.range_min(table, low, high) == [shared[a:b].min() for a, b in zip(low, high, strict=True)]).all()
