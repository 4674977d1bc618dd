"""Rankings (5), containers (8), mixtures (9) and text quality (10)."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbre.llm import mixture, pack, quality, ranking

NAN = float("nan")
SCORES = ["x", "y"]
RANKED = "g string, id string, x double, y double"


def _brute_vectors(rows):
    best = {}
    for g, i, *values in rows:
        own = best.setdefault((g, i), [None, None])
        for k, v in enumerate(values):
            if v is not None and v == v and (own[k] is None or v > own[k]):
                own[k] = v
    out = {}
    for (g, i), own in best.items():
        pct = []
        for k, v in enumerate(own):
            every = [o[k] for (h, _), o in best.items() if h == g and o[k] is not None]
            pct.append(0.0 if v is None else (sum(e < v for e in every) + sum(e == v for e in every) / 2) / len(every))
        out[g, i] = sorted(pct)
    return out


def _items(seed=0, n=60):
    rng = random.Random(seed)
    value = lambda scale: rng.choice([None, NAN, float(rng.randint(0, 9) * scale), rng.random() * scale])
    rows = [(rng.choice(["a", "b", None]), f"i{rng.randint(0, 25)}", value(1000), value(0.001)) for _ in range(n)]
    return rows + [("only", "i1", None, NAN)]


@pytest.mark.parametrize("bucket", [3, 100_000])
def test_leximin_against_brute_force(spark, bucket):
    rows = _items()
    df = spark.createDataFrame(rows, RANKED).withColumn("pct", F.lit(1)).withColumn("value", F.lit(1)).withColumn("n", F.lit(1))
    want = _brute_vectors(rows)
    got = ranking.ranked(df, ["g"], "id", SCORES, bucket).collect()
    assert {(r.g, r.id): pytest.approx(r.vector) for r in got} == want
    order = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        order[r.g].append(r.id)
    for g, ids in order.items():
        assert ids == [i for (h, i) in sorted((k for k in want if k[0] == g), key=lambda k: ([-v for v in want[k]], k[1])) for h in [h]]
    assert {r.g: r.id for r in ranking.first_of_each(df, ["g"], "id", SCORES, bucket).collect()} == {g: ids[0] for g, ids in order.items() if g != "only"}


@pytest.mark.parametrize("bucket", [2, 100_000])
def test_tied_items_are_led_by_the_first(spark, bucket):
    rows = [(f"g{g}", f"i{(i * 7 + g) % 9}", 1.0 if i < 6 else None, 2.0 if i < 6 else None) for g in range(12) for i in range(9)]
    df = spark.createDataFrame(rows, RANKED).repartition(5)
    first = {r.g: r.id for r in ranking.ranked(df, ["g"], "id", SCORES, bucket).where("position = 1").collect()}
    assert {r.g: r.id for r in ranking.first_of_each(df, ["g"], "id", SCORES, bucket).collect()} == first
    assert first == {g: min(i for h, i, x, _ in rows if h == g and x) for g in first} and len(first) == 12


def test_one_strong_score_does_not_lead(spark):
    rows = [("g", "spike", 1e9, 0.0), ("g", "even", 5.0, 0.5), ("g", "low", 1.0, 0.4), ("g", "spike2", 0.5, 0.9)]
    assert ranking.first_of_each(spark.createDataFrame(rows, RANKED), ["g"], "id", SCORES).first().id == "even"
    assert ranking.ranked(spark.createDataFrame([], RANKED), ["g"], "id", SCORES).count() == 0


def test_repeated_rows_change_nothing(spark):
    df = spark.createDataFrame(_items(), RANKED)
    key = lambda d: sorted(((r.g or "", r.id, r.position) for r in ranking.ranked(d, ["g"], "id", SCORES).collect()))
    assert key(df) == key(df.union(df))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 99), min_size=0, max_size=60), st.integers(0, 99))
def test_evolve_packs_all(sizes, seed):
    bins = pack.evolve(sizes, [], 100, seed, generations=6)
    room = Counter()
    for b, s in zip(bins, sizes):
        room[b] += s
    assert len(bins) == len(sizes) and all(v <= 100 for v in room.values())
    assert set(bins) == set(range(len(set(bins))))
    again = pack.evolve(sizes, [bins], 100, seed + 1, generations=6)
    assert len(set(again)) <= len(set(bins))


@pytest.mark.parametrize("seed", range(3))
def test_evolve_beats_best_fit_on_hard_sizes(seed):
    """Triplets of which each fills a container exactly, and sizes of which two or three make one."""
    rng = random.Random(seed)
    sizes = []
    for _ in range(100):
        a = rng.randint(778, 1000)
        b = rng.randint(512, (2048 - a) // 2)
        sizes += [a, b, 2048 - a - b]
    bins = []
    pack.best_fit(bins, [], sorted(range(300), key=lambda i: -sizes[i]), sizes, 2048)
    assert len(set(pack.evolve(sizes, [], 2048, seed))) <= len(bins) - 6 and len(bins) > pack.least_bins(sizes, 2048) + 10


def test_left_overs_of_shards_are_packed_together(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, 1, 1, rng.randint(5, 60)) for i in range(600)] + [(1, 1, 1, 33)] * 50, "doc_id long, parts int, part int, tokens int")
    rows = pack.containers_of(items, "doc_id", capacity=100, shard=40).cache()
    held = Counter()
    for r in rows.collect():
        held[r.container] += r.tokens
    assert max(held.values()) <= 100 and rows.count() == 650 and all(r.filled == held[r.container] for r in rows.collect())
    told = pack.report(rows, 100, 40).first()
    assert told.containers == len(held) and told.least <= told.containers <= told.least + 6 and told.containers < told.best_fit
    rows.unpersist()


def test_crossover_keeps_each_item_once():
    rng = random.Random(0)
    sizes = [rng.randint(1, 60) for _ in range(80)]
    packs = []
    for _ in range(2):
        bins, room = [], []
        pack.best_fit(bins, room, rng.sample(range(80), 80), sizes, 100)
        packs.append(bins)
    bins, room = pack.crossover(*packs, sizes, 100, rng)
    assert sorted(i for b in bins for i in b) == list(range(80)) and all(r == 100 - sum(sizes[i] for i in b) >= 0 for b, r in zip(bins, room))


def test_containers(spark):
    rng = random.Random(1)
    texts = ["hola mundo " * rng.randint(1, 60) for _ in range(150)] + ["palabra larga " * 400, "", None, "x"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")], "doc_id long, text string, tokens string")
    rows = pack.fill_containers(docs, capacity=200, shard=40).collect()
    held, parts = Counter(), defaultdict(list)
    for r in rows:
        held[r.container] += r.tokens
        parts[r.doc_id].append(r)
    assert all(v <= 200 for v in held.values()) and all(r.filled == held[r.container] for r in rows)
    assert set(parts) == set(range(len(texts))) - {152} and len(parts[3]) == 2
    big = sorted(parts[150], key=lambda r: r.part)
    assert len(big) == big[0].parts > 1 and [r.first_token for r in big] == [200 * i for i in range(len(big))] and all(r.tokens == 200 for r in big[:-1])
    assert all(r.parts == 1 for k, v in parts.items() if k != 150 for r in v)
    assert len(held) <= 1.1 * sum(held.values()) / 200 + 3
    assert {tuple(r) for r in pack.fill_containers(docs, capacity=200, shard=40).collect()} == set(map(tuple, rows))
    assert pack.fill_containers(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "weights, most, total, want",
    [
        ({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, 100, {"a": 10, "b": 90}),
        ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 40, "c": 1000}, 100, {"a": 10, "b": 40, "c": 50}),
        ({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, None, {"a": 10, "b": 10}),
        ({"a": 0.5, "b": 0.5}, {"b": 100}, None, {"a": 0, "b": 100}),
        ({"a": 1.0}, {"a": 5}, 100, {"a": 5}),
        ({}, {}, None, {}),
    ],
)
def test_water_fill(weights, most, total, want):
    assert mixture.water_fill(weights, most, total) == pytest.approx(want)


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "hola mundo " * rng.randint(5, 60), s) for i, s in enumerate(["a"] * 200 + ["b"] * 30 + ["c"] * 300 + [None] * 20)] + [(900, None, "a"), (901, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit(1)).withColumn("times", F.lit(1))
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixture.mixture(docs, targets).collect()
    caps, tokens = {"a": 1, "b": 3, "c": 2}, Counter()
    assert all(1 <= r.times <= caps[r.source] for r in mix) and len({r.doc_id for r in mix}) == len(mix)
    for r in mix:
        tokens[r.source] += r.tokens * r.times
    for s, w in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert tokens[s] / sum(tokens.values()) == pytest.approx(w / 0.9, abs=0.01)
    told = {r.source: r for r in mixture.report(docs, targets).collect()}
    assert all(told[s].tokens == tokens[s] for s in caps) and told["none"].reached_share == 0 and sum(r.reached_share for r in told.values()) == pytest.approx(1)
    assert {tuple(r) for r in mixture.mixture(docs, targets).collect()} == set(map(tuple, mix))
    large = {r.source: r for r in mixture.report(docs, targets, total=lambda even: 3 * even).collect()}
    assert large["b"].clamped and large["b"].repeats == 3 and large["b"].most_uses == 3 and not large["c"].clamped
    whole = sum(r.tokens for r in large.values())
    assert whole == pytest.approx(3 * sum(tokens.values()), rel=0.01) and large["b"].reached_share < 0.3 < large["a"].reached_share + large["c"].reached_share
    assert mixture.mixture(docs.limit(0), targets).count() == 0 and mixture.report(docs.limit(0), targets).count() == 4
    assert all(r.reached_share == 0 for r in mixture.report(docs, targets.limit(0)).collect())


PROSE = "El viejo puerto de la ciudad es tranquilo por la mañana. Los barcos salen antes del mediodía, y las calles se llenan de gente {}."
JUNK = ["a;b;3;;\n" * 20, '{"id":1,"x":2.5},\n' * 30, "https://x.example/1\n" * 20, "#uno #dos #tres " * 10, "| a | 1 | 2.5 |\n" * 12, "Clima\nMuseos\nComer\n" * 6, "%$# @!~ ;: " * 30, "12 34 56 " * 20]


def test_quality(spark):
    prose = [" ".join([PROSE.format(w)] * (i % 4 + 1)) for i, w in enumerate(["alegre", "curiosa", "amable", "joven", "mayor"] * 40)]
    prose += [prose[0].upper(), prose[1].replace("ñ", "n").replace("í", "i"), prose[2] + "\n- uno\n- dos\n" + prose[3], prose[2].replace("por la", "por\nla"), PROSE.format("sola")]
    rows = [(i, t, "es") for i, t in enumerate(prose)] + [(1000 + i, t, "es") for i, t in enumerate(JUNK)] + [(2000, None, "es"), (2001, "", None), (2002, prose[0], None), (2003, "x" * 100_000, "qq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_words", F.lit(1)).withColumn("grid", F.lit(1))
    got = {r.doc_id: r for r in quality.flagged(docs).collect()}
    assert {k for k, r in got.items() if r.not_prose} == {1000 + i for i in range(len(JUNK))} | {2001, 2003}
    assert len(got) == len(rows) and got[2000].n_words is None and got[2000].tails == [] and got[0].n_words == 25 and got[2001].n_words == 0
    assert got[0].line_end_punctuation == 1 and 0 <= got[0].symbol_ratio_pct <= 1 and "symbol_ratio:high" in got[1006].tails
    assert quality.flagged(docs.limit(0)).count() == 0
