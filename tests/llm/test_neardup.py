"""Near-duplicate records (4)."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbre.llm import neardup

SCHEMA = "record_set string, key long, text string"


def _runs(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    words = re.findall(r"[^\W_]+", plain)
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 12 else None


def _brute(rows, least=0.5):
    sets = [(r, k, _runs(t)) for r, k, t in rows]
    return {(r, min(k, j), max(k, j)) for i, (r, k, x) in enumerate(sets) for s, j, y in sets[:i] if r == s and x and y and len(x & y) >= least * len(x | y)}


def _corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(6))
    rows, key = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.randint(14, 60))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [word()], [w[at], word()]])
            rows.append(("a" if key % 2 else "b", key, " ".join(w)))
            key += 1
    rows += [("a", key, "Ñandú, LA (playa)! " * 6), ("a", key + 1, "nandu la playa " * 6), ("a", key + 2, "too short"), ("a", key + 3, None), ("a", key + 4, ""), ("a", key + 5, "ab cd ef " * 20_000)]
    return rows


def test_pairs_against_brute_force(spark):
    rows = _corpus()
    want = _brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit(1)).withColumn("blocks", F.lit(1))
    got = {tuple(r) for r in neardup.record_pairs(df.select("record_set", "key", "text")).collect()}
    assert got == want and len(want) > 40
    assert {tuple(r) for r in neardup.record_pairs(df).collect()} == got


def test_hot_blocks_are_dealt_without_loss(spark, monkeypatch):
    """Records that share a block, in tasks by pairs of trie nodes, give the same pairs."""
    rows = _corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in neardup.record_pairs(df).collect()}
    monkeypatch.setattr(neardup, "HOT", 1)
    monkeypatch.setattr(neardup, "HOT_SAMPLE", 1)
    assert {tuple(r) for r in neardup.record_pairs(df).collect()} == whole


@pytest.mark.parametrize("length, edits", [(100, 3), (200, 5), (40, 2)])
def test_edited_copies_of_a_frequent_text(spark, length, edits):
    """All shared words are frequent and the edits alone are rare: the copies are still found."""
    rng = random.Random(length)
    base, rows = [f"w{i}" for i in range(length)], []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(length), edits):
            w[at] = f"edit{i}x{at}"
        rows.append(("a", i, " ".join(w)))
    want = _brute(rows)
    got = {tuple(r) for r in neardup.record_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(want) > 100


def test_copies_and_groups(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("a", i, text) for i in range(5)] + [("a", 5, text + " eins zwei"), ("b", 6, text), ("a", 7, " ".join(f"v{i}" for i in range(30)))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in neardup.record_pairs(df).collect()} == _brute(rows)
    got = {r.key: r for r in neardup.groups(df).collect()}
    assert len({got[i].group for i in range(6)}) == 1 and len({got[i].cls for i in range(5)}) == 1
    assert got[6].group != got[0].group and got[7].links == 0 and got[5].links == 1 and len(got) == 8


def test_long_chains_become_one_group(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [("a", i, " ".join(words[i * 4 : i * 4 + 40])) for i in range(40)]
    got = neardup.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.group for r in got}) == 1 and len(got) == 40


def test_nothing(spark):
    assert neardup.record_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neardup.groups(spark.createDataFrame([("a", 1, None), ("a", 2, "x")], SCHEMA)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 90), st.integers(0, 128), st.integers(0, 2**32), st.booleans())
def test_trie_join_is_exact(n, budget, seed, sided):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size=(max(1, n // 6), 2), dtype=np.uint64)
    prints = base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, size=(n, 2), dtype=np.uint64))
    sides = rng.integers(0, 3, n) if sided else None
    near = lambda i, j: sum(int(a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= budget
    wanted = lambda i, j: sides is None or sides[i] == 2 or sides[i] != sides[j]
    got = sorted(zip(*(x.tolist() for x in neardup.trie_pairs(prints, budget, sides, leaf=4))))
    both = [(i, j) for j in range(n) for i in range(j) if near(i, j)]
    if sides is None:
        assert got == sorted(both)
    else:
        assert set(p for p in both if wanted(*p) and wanted(*p[::-1])) <= set(got) <= set(both) and len(got) == len(set(got))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(0, 400), st.integers(0, 2**32))
def test_parities_never_differ_in_more_bits_than_sets_in_runs(common, left, right, seed):
    value = np.unique(np.random.default_rng(seed).integers(0, 2**54, size=common + left + right, dtype=np.uint64))
    one, two = value[: common + left], np.concatenate([value[:common], value[common + left :]])
    starts, both, of = np.array([0, len(one)]), np.concatenate([one, two]), np.repeat([0, 1], [len(one), len(two)])
    a, b = neardup.fingerprints(both, starts)
    assert np.bitwise_count(a ^ b).sum() <= left + right
    a, b = neardup.whole_parities(both, of, 2)
    assert np.bitwise_count(a ^ b).sum() <= left + right


def test_trie_join_drops_nodes():
    """100,000 sets of which 500 have a twin with another run in the place of one, at a block that leaves room for that alone: few pairs of nodes are looked at, and no twin is lost."""
    rng, n, size = np.random.default_rng(5), 100_000, 30
    value = rng.integers(0, 2**54, size=(n, size), dtype=np.uint64)
    value[500:1000] = value[:500]
    value[500:1000, 0] = rng.integers(0, 2**54, size=500, dtype=np.uint64)
    prints = neardup.fingerprints(value.ravel(), np.arange(n) * size)
    walk = neardup.trie_walk(prints, neardup.slacks(np.full(n, 12), np.full(n, 3), 0.5))
    assert set(zip(range(500), range(500, 1000))) <= set(zip(walk.left.tolist(), walk.right.tolist()))
    assert walk.pruned > n and walk.seen < n * n / 40, (walk.seen, walk.pruned)


def test_trie_join_parts_by_slack():
    """Records without slack aren't compared with each other, and those of a late block only with what is close."""
    rng, n = np.random.default_rng(6), 4000
    prints = rng.integers(0, 2**63, size=(n, 2), dtype=np.uint64)
    slack = np.where(np.arange(n) < 100, 30.0, -4.0)
    prints[3999] = prints[0]
    walk = neardup.trie_walk(prints, slack)
    assert (0, 3999) in set(zip(walk.left.tolist(), walk.right.tolist())) and walk.seen < 100 * n * 1.2


def test_words_of_a_text():
    words, owner = neardup.word_hashes(["L'été, déjà_vu!", None, "ETE deja", "\x01"])
    assert owner.tolist() == [0, 0, 0, 0, 2, 2] and words[1] == words[4] and words[2] == words[5]


@pytest.mark.parametrize("text", ["日本 語 " * 10, "ß Straße " * 10])
def test_other_letters_are_words(text):
    assert len(neardup.word_hashes([text])[0]) == len(text.split())


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 80), st.integers(2, 80), st.integers(0, 15), st.integers(0, 2**32))
def test_budget_split_over_parts_is_exact(n, m, budget, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size=(3, 2), dtype=np.uint64)

    def near(k):
        prints = base[rng.integers(0, 3, k)]
        for _ in range(8):
            prints = prints ^ (np.uint64(1) << rng.integers(0, 64, size=(k, 2), dtype=np.uint64))
        return prints

    one, two = near(n), near(m)
    limits, neardup.PROBE, neardup.FOUND = (neardup.PROBE, neardup.FOUND), 0, 0
    try:
        for other in (two, None):
            walk, want = neardup._by_parts(one, other, budget + 1e-6), neardup._by_halves(one, other, budget + 1e-6)
            assert sorted(zip(walk.left.tolist(), walk.right.tolist())) == sorted(zip(want.left.tolist(), want.right.tolist()))
    finally:
        neardup.PROBE, neardup.FOUND = limits


def test_large_blocks_are_not_compared_pair_by_pair():
    """60,000 fingerprints with room for eleven bits, of which 300 have a twin that differs in ten: a small part of the pairs is looked at, and no twin is lost."""
    rng, n = np.random.default_rng(7), 60_000
    prints = rng.integers(0, 2**64, size=(n, 2), dtype=np.uint64)
    prints[300:600] = prints[:300] ^ np.array([0b11111 << 20, 0b11111 << 50], np.uint64)
    walk = neardup.trie_walk(prints, np.full(n, 5.5))
    assert set(zip(range(300), range(300, 600))) <= set(zip(walk.left.tolist(), walk.right.tolist())) and walk.seen < n * n / 100, walk.seen


def test_the_order_of_runs_counts_all_records(spark):
    """Of 40,000 records, the counts of the runs that all share are those of all of them."""
    df = spark.range(40_000).select(F.lit("a").alias("record_set"), F.col("id").alias("key"), F.concat(F.lit("a b c d e f g h i j k "), F.col("id").cast("string")).alias("text"))
    counted = neardup.count_runs(df)
    often = counted.where("kind = 0").groupBy("item").agg(F.sum("records").alias("records")).where("records > 1000").collect()
    assert [r.records for r in often] == [40_000] * 9
    order = neardup.run_order(counted)
    assert len(order.runs) == 9 and set(order.level.tolist()) == {int(2 * np.log2(40_000))}


def _keys(rng, n, blocks):
    size = rng.integers(10, 60, n)
    columns = (rng.integers(0, blocks, n), rng.integers(0, 2**62, n), size, (rng.random(n) * (size / 2)).astype(int), rng.integers(0, 2**63, n), rng.integers(0, 2**63, n), np.zeros(n), np.full(n, 2))
    return neardup.Keys(*(np.asarray(x).astype(kind) for x, kind in zip(columns, neardup._KINDS)))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_packed_keys_are_the_same_rows(n):
    keys = _keys(np.random.default_rng(n), n, 9)
    for rows in (keys, keys._replace(node=np.arange(n) - 7, side=(np.arange(n) % 3).astype(np.int8))):
        assert all(x.dtype == y.dtype and (x == y).all() for x, y in zip(neardup._unpack(neardup._pack(rows)), rows))


def test_rows_without_a_partner_are_left_out():
    """Of rows of blocks, all are kept that lie in a pair within both slacks and with enough runs left; some others go."""
    keys = _keys(np.random.default_rng(8), 600, 150)
    keys = neardup._take(keys, np.argsort(keys.block))
    kept = set(neardup._with_partner(keys, 0.5).cls.tolist())
    slack, rest, wanted = neardup.slacks(keys.n, keys.at, 0.5), keys.n - keys.at, set()
    for i in range(600):
        for j in range(i):
            if keys.block[i] == keys.block[j] and slack[i] + slack[j] >= 0 and 3 * min(rest[i], rest[j]) >= keys.n[i] + keys.n[j]:
                wanted |= {int(keys.cls[i]), int(keys.cls[j])}
    assert wanted <= kept and len(wanted) > 200 and len(kept) < 550


@pytest.mark.parametrize("value", [[], [5, 1, 5, 1, 9], [1 << 53, 0, 1 << 53, 0], [(1 << 53) + 1, 1, (1 << 53) + 1, 1]])
def test_equal_values_become_neighbours(value):
    value = np.array(value, np.uint64)
    order = neardup._grouped(value)
    own = value[order]
    assert sorted(order.tolist()) == list(range(len(value))) and (own[1:] != own[:-1]).sum() + 1 == max(1, len(set(value.tolist())))


def test_the_tables_of_block_keys_are_removed(spark):
    """What blocks are made of is the largest table, and not there any more when pairs are checked."""
    from pathlib import Path

    from lumbre.plans.tables import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in shared.iterdir()}
    assert neardup.record_pairs(spark.createDataFrame(_corpus(), SCHEMA)).count() > 40
    left = [p.name for p in shared.iterdir() if p.name not in before]
    assert not [x for x in left if x.startswith("sketches")] and sum(x.startswith("pairs") for x in left) == 1


def test_copies_met_by_several_workers_count_once(spark):
    """Rows of a class that stand twice in a block give the pairs that they give once; a text copied to all partitions has one sketch in what pairs are checked by."""
    keys = _keys(np.random.default_rng(9), 300, 20)
    keys = keys._replace(hi=keys.block.astype("<u8"), lo=keys.block.astype("<u8"))
    pairs = lambda k: sorted(zip(*(c.to_pylist() for c in neardup._join_keys(k, 0.5).columns)))
    twice = neardup._joined([keys, keys])
    assert len(neardup._once(twice).cls) == 300 and pairs(twice) == pairs(keys) and len(pairs(keys)) > 50
    words = " ".join(f"w{i}" for i in range(30))
    rows = [("a", i, words if i % 9 else words + " eins") for i in range(200)]
    got = [tuple(r) for r in neardup.record_pairs(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()]
    assert len(got) == len(set(got)) == 200 * 199 // 2
    _, links = neardup.class_links(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert links.count() == 1
