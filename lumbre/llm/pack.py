"""Filling fixed-capacity containers with whole documents (problem 8).

A grouping genetic algorithm: an individual is a list of bins; crossover injects whole well-filled bins of one parent in the other, removes the bins
that hold the same documents, and best-fits the documents displaced. Documents are dealt to shards of a bounded size; each shard evolves on several
islands, which run as tasks of their own and send their best individual to the next island after every epoch.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm.tokens import VOCABULARY, token_count
from lumbre.plans.tables import materialise

CAPACITY = 2048
#: Documents of a shard, about; islands of a shard; epochs; individuals of an island; generations of an epoch, and of these without a better one, after which it ends.
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS, PATIENCE = 1000, 3, 3, 10, 150, 40
#: Fill below which a shard's containers are opened again and packed with those of other shards, and rounds of that at most.
LEFT_OVER, ROUNDS = 0.97, 6


def best_fit(bins: list[list[int]], room: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put each item in the bin it fills best, opening bins where it fits in none; ``room`` holds the bins' unused space."""
    free = sorted((r, b) for b, r in enumerate(room))
    for item in items:
        size = sizes[item]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(item)
        room[b] = left - size
        insort(free, (left - size, b))


def fitness(room: list[int], capacity: int) -> float:
    """Mean squared fill: of two packings in as many bins, the one with fuller full bins is better."""
    return sum((1 - r / capacity) ** 2 for r in room) / len(room) if room else 1.0


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: what the sum needs, and one for each item beyond half of the capacity."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def exchange(bins: list[list[int]], room: list[int], rest: list[int], sizes: list[int]) -> list[int]:
    """Swaps one or two displaced items for one or two smaller ones of a bin where that fills the bin better; returns what is displaced then, smaller items than before."""
    rest = sorted(rest, key=lambda i: sizes[i])
    for b in sorted(range(len(bins)), key=lambda b: room[b]):
        if not rest:
            break
        if not room[b]:
            continue
        ones = [(sizes[i], (i,)) for i in rest]
        offers = sorted(ones + [(sizes[i] + sizes[j], (i, j)) for n, i in enumerate(rest[:24]) for j in rest[n + 1 : 24]])
        totals = [size for size, _ in offers]
        held = bins[b][:24]
        best = (0, (), ())
        for out in [(i,) for i in held] + [(i, j) for n, i in enumerate(held) for j in held[n + 1 :]]:
            size = sum(sizes[i] for i in out)
            at = bisect_right(totals, size + room[b]) - 1
            if at >= 0 and totals[at] - size > best[0]:
                best = (totals[at] - size, out, offers[at][1])
        gain, out, into = best
        if gain:
            bins[b] = [i for i in bins[b] if i not in out] + list(into)
            room[b] -= gain
            rest = sorted([i for i in rest if i not in into] + list(out), key=lambda i: sizes[i])
    return rest


def crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> tuple[list[list[int]], list[int]]:
    """``one`` with well-filled bins of ``two`` injected; the displaced items are exchanged for smaller ones of fuller bins, then best-fitted."""
    fill = lambda b: sum(sizes[i] for i in b)
    full = sorted(two, key=lambda b: -fill(b))[: max(1, len(two) // 2)]
    chosen = rng.sample(full, max(1, min(len(full), rng.randint(1, 1 + len(full) // 3))))
    taken = {i for b in chosen for i in b}
    kept = [b for b in one if taken.isdisjoint(b)]
    rest = [i for b in one if not taken.isdisjoint(b) for i in b if i not in taken]
    # The emptiest bins left, and one at random, are dissolved too, so that their documents can fill the gaps.
    kept.sort(key=lambda b: -fill(b))
    for _ in range(min(rng.randint(1, 3), len(kept) - 1)):
        rest += kept.pop()
    if len(kept) > 1:
        rest += kept.pop(rng.randrange(len(kept)))
    bins = [list(b) for b in chosen] + [list(b) for b in kept]
    room = [capacity - fill(b) for b in bins]
    rest = exchange(bins, room, rest, sizes)
    best_fit(bins, room, sorted(rest, key=lambda i: -sizes[i]), sizes, capacity)
    return bins, room


def evolve(sizes: list[int], elites: list[list[int]], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[int]:
    """The bin of each item in the best individual found. elites: individuals, as the bin of each item, that join the first population."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    least = least_bins(sizes, capacity)
    pool = []

    def add(bins: list[list[int]], room: list[int]) -> None:
        pool.append((-len(bins), fitness(room, capacity), len(pool), bins, room))

    for elite in elites:
        bins: list[list[int]] = [[] for _ in range(max(elite, default=-1) + 1)]
        for item, b in enumerate(elite):
            bins[b].append(item)
        add(bins, [capacity - sum(sizes[i] for i in b) for b in bins])
    while len(pool) < population and not (pool and -max(pool)[0] <= least):
        bins, room = [], []
        start = list(order)
        if pool:  # all but the first start from a disturbed order
            start.sort(key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0))
        best_fit(bins, room, start, sizes, capacity)
        add(bins, room)
    still, best = 0, max(pool, key=lambda x: x[:2])
    for turn in range(generations):
        if -best[0] <= least or still >= PATIENCE:
            break
        pool.sort(key=lambda x: x[:2], reverse=True)
        one, two = (pool[min(rng.randrange(len(pool)), rng.randrange(len(pool)))] for _ in range(2))
        bins, room = crossover(one[3], two[3], sizes, capacity, rng)
        child = (-len(bins), fitness(room, capacity), turn, bins, room)
        if all(child[:2] != x[:2] for x in pool):
            pool[-1] = child
        still = still + 1 if child[:2] <= best[:2] else 0
        best = max(best, child, key=lambda x: x[:2])
    out = [0] * len(sizes)
    for b, items in enumerate(best[3]):
        for i in items:
            out[i] = b
    return out


def items_of(docs: DataFrame, key: str, text: str, capacity: int, vocabulary: str) -> DataFrame:
    """(key, parts, part, tokens): a document within the capacity is one part; a larger one is cut into parts of the capacity and a rest. Null texts give none."""
    sized = docs.select(F.col(key), token_count(F.col(text).cast("string"), vocabulary).alias("total")).where(F.col("total").isNotNull())
    sized = sized.withColumn("parts", F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)).cast("int"))
    rows = sized.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    return rows.select(key, "parts", "part", F.least(F.lit(capacity), F.col("total") - (F.col("part") - 1) * capacity).cast("int").alias("tokens"))


def _packed(items: DataFrame, shards: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(shard, bin, item): the items (a struct that begins with the tokens) dealt to shards and packed there."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(shards)).cast("int"))
    # About as many rows as a shard has are gathered, whatever the keys: copies of one row differ in their number.
    packed = materialise(dealt.groupBy("shard").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items")), "shards")
    state = packed.select("shard", F.col("items.tokens").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("elites"))
    schema = "shard int, island int, sizes array<int>, elites array<array<int>>, bins int"

    def epoch_of(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                best = []
                for s, island, sizes, elites in zip(rows["shard"], rows["island"], rows["sizes"], rows["elites"]):
                    best.append(evolve([int(x) for x in sizes], [[int(b) for b in e] for e in elites], capacity, seed=hash((seed, epoch, int(s), int(island)))))
                yield pd.DataFrame({"shard": rows["shard"], "island": rows["island"], "sizes": rows["sizes"], "elites": [[b] for b in best], "bins": [max(b, default=-1) + 1 for b in best]})

        return run

    for epoch in range(epochs):
        done = state.repartition(F.col("shard"), F.col("island")).mapInPandas(epoch_of(epoch), schema)
        if epoch < epochs - 1:  # each island gets its own best and that of the island before it
            done = materialise(done, "epoch")
            sent = done.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elites").alias("sent")).alias("m")
            state = done.join(sent, ["shard", "island"]).select("shard", "sizes", "island", F.concat("elites", "sent").alias("elites"))
    best = done.groupBy("shard").agg(F.min_by(F.col("elites")[0], F.struct("bins", "island")).alias("bin"))
    return packed.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "bin")).alias("x")).select("shard", "x.bin", F.col("x.items").alias("item"))


def fill_containers(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 7
) -> DataFrame:
    """(container, key, parts, part, first_token, tokens, filled): every part of every document in exactly one container.

    Only documents above the capacity are cut (parts > 1), into runs of tokens; ``filled`` is the container's content in tokens. Empty texts are items of size 0,
    null texts are left out; rows repeated under one key are items of their own. The same input and seed give the same containers. What a round leaves in
    poorly filled containers is packed again with that of other shards, until one shard holds it or a round doesn't make it less.
    """
    return containers_of(items_of(docs, key, text, capacity, vocabulary), key, capacity, shard, islands, epochs, seed)


def containers_of(items: DataFrame, key: str, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """``fill_containers`` for items (key, parts, part, tokens)."""
    items = materialise(items, "items")
    repeated = materialise(items.where(F.col("tokens") < capacity).groupBy(key, "part", "parts", "tokens").agg(F.count("*").cast("int").alias("rows")), "sizes")
    left = repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(F.struct("tokens", key, "part", "parts", "copy").alias("item"))
    whole = items.where(F.col("tokens") == capacity)
    done, n = [], left.count()
    for turn in range(ROUNDS):
        shards = max(1, -(-n // shard))
        rows = materialise(_packed(left, shards, capacity, islands, epochs, seed + turn), "packed")
        filled = rows.groupBy("shard", "bin").agg(F.sum("item.tokens").cast("int").alias("filled"))
        rows = rows.join(filled, ["shard", "bin"])
        kept = rows if shards == 1 else rows.where(F.col("filled") >= LEFT_OVER * capacity)
        done.append(kept.select(F.concat_ws("-", F.lit(turn), "shard", "bin").alias("container"), "item.*", "filled"))
        if shards == 1:
            break
        left = materialise(rows.where(F.col("filled") < LEFT_OVER * capacity).select("item"), "left")
        before, n = n, left.count()
        if not n:
            break
        if n > 0.9 * before or turn == ROUNDS - 1:  # these items fill containers no better: they stay as they are
            done.append(rows.where(F.col("filled") < LEFT_OVER * capacity).select(F.concat_ws("-", F.lit(turn), "shard", "bin").alias("container"), "item.*", "filled"))
            break
    full = whole.select(F.concat_ws("-", F.lit("full"), F.monotonically_increasing_id()).alias("container"), key, "parts", "part", "tokens", F.col("tokens").alias("filled"))
    out = reduce(DataFrame.unionByName, [x.select(full.columns) for x in [*done, full]])
    return out.select("container", key, "parts", "part", ((F.col("part") - 1) * capacity).alias("first_token"), "tokens", "filled")


def report(containers: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row (items, tokens, containers, least, best_fit, mean_fill): the containers beside the least number possible and that of best-fit by descending size in shards as large."""
    sized = containers.select("container", "tokens", F.xxhash64(*containers.columns).alias("h"))
    told = sized.agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.countDistinct("container").alias("containers"), F.count_if(F.col("tokens") * 2 > capacity).alias("halves"))
    shards = max(1, -(-containers.count() // shard))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for sizes in rows["sizes"]:
                bins: list[list[int]] = []
                best_fit(bins, [], list(range(len(sizes))), [int(x) for x in sizes], capacity)
                yield pd.DataFrame({"bins": [len(bins)]})

    dealt = sized.groupBy(F.pmod("h", F.lit(shards))).agg(F.sort_array(F.collect_list("tokens"), asc=False).alias("sizes")).select("sizes")
    plain = dealt.mapInPandas(run, "bins long").agg(F.sum("bins").alias("best_fit"))
    least = F.greatest(F.ceil(F.col("tokens") / capacity), F.col("halves")).alias("least")
    return told.crossJoin(plain).select("items", "tokens", "containers", least, "best_fit", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("mean_fill"))  # one row each
