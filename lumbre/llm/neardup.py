"""Near-duplicate records with small edits (problem 4).

Records with the same set of word runs form a class, represented once. All runs stand in one order, rare ones first, in which runs that occur together
(those of one frequent phrase, or of one rare word) are neighbours and make up a group. Two sets with enough runs in common share a run, so a group,
among the first part of both, whatever the texts are: a class is blocked under the groups of that part. In a block, each class has a fingerprint of its
runs from that group on: 128 bits, each the parity of the number of runs that fall on it, so that two fingerprints never differ in more bits than the
sets in runs. If the group is the first that two classes share, they may differ there in no more runs than the slacks of both allow, the less the later
the group stands. The fingerprints go through a binary trie self-join: pairs of trie nodes are walked down together, differing bits are added up, and a
pair of nodes is dropped as soon as these exceed the error budget, the slacks of all below. What remains is checked by parities of more bits, then
exactly on the sets of runs. No step loses a pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from lumbre.plans.tables import discard, materialise, release

#: Words of a run that is compared, least similarity, least words of a record (problem 4 states these).
RUN, LEAST, MIN_WORDS = 3, 0.5, 12
#: A run or word that stands in at least two, and one of so many, of all records counts as frequent; runs that a worker counts together. This steers only the number and sizes of blocks.
RARE, PORTION = 16_000, 2_000_000
#: Records of a block in one task, about; larger blocks are dealt by pairs of trie nodes.
HOT, HOT_SAMPLE = 262_144, 64
#: The trie's first nodes part fingerprints by their slack, SLACK to a node. Below those with a budget of at most FINE bits it is walked down in the steps of STEPS, below the others,
#: where nothing exceeds the budget so early, half a fingerprint at a time. Of at most LEAF fingerprints all pairs are compared. Where the nodes are large, the budget is split over
#: parts of the fingerprint instead, of at least PART bits, if the pairs are PROBE times as many as what is looked up, and FOUND times as many as what is found by a part.
SLACK, FINE, STEPS, LEAF = 3, 2.5, (8, 12, 16, 24, 40, 64, 128), 512
PART, PROBE, FOUND = 15, 48, 8
#: Pairs that are held at once, and those that fit a core's cache.
HELD, CACHED = 1 << 20, 1 << 17
#: Rounds in which the blocks are joined, each round a part of them, so that only this part of their rows is on disk at once.
ROUNDS = 8
#: Block keys that a worker packs together.
KEYS = 500_000
#: Bits of the parities of whole sets.
WHOLE = 512

#: Characters of texts that are worked on together, and words a worker remembers.
SLICE, REMEMBERED = 1_000_000, 300_000

_MARKS = re.compile("[̀-ͯ]+")
_WIDE = re.compile(r"[^\x00-\x7f]+")
#: ASCII letters and digits, and the cut between texts, are kept; other ASCII becomes a space.
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() or c == 1 else 32 for c in range(256))
_CUT = 1 << 54
_LOW = np.uint64(_CUT - 1)
_MASK = (1 << 64) - 1


class _Words(dict):
    """Numbers of words in the order seen; ``hashes`` has their hashes."""

    def __init__(self):
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(at, np.uint64)])
        self.hashes[at] = xxhash.xxh64_intdigest(word)
        self[word] = at
        return at


_known = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Letters(dict):
    """What runs of other characters than ASCII become: without marks, and with spaces for what is no letter or digit. An ASCII character is never decomposed or reordered, so each run stands alone."""

    def __missing__(self, found: str) -> str:
        plain = _MARKS.sub("", unicodedata.normalize("NFKD", found))
        plain = "".join(c if c.isascii() or c.isalnum() else " " for c in plain)
        if len(self) < REMEMBERED:
            self[found] = plain
        return plain


_letters = _Letters()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the text each belongs to; words without case, accents and punctuation."""
    global _known
    if len(_known) > REMEMBERED:
        _known = _Words()
    cut = _known[b"\x01"]
    joined = " \x01 ".join([(t or "").replace("\x01", " ") for t in texts]).lower()
    if not joined.isascii():
        joined = _WIDE.sub(lambda found: _letters[found[0]], joined)
    words = joined.encode().translate(_KEEP).split()
    at = np.fromiter(map(_known.__getitem__, words), dtype=np.int64, count=len(words))
    is_cut = at == cut
    return _known.hashes[at[~is_cut]], np.cumsum(is_cut)[~is_cut]


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about SLICE characters, each with the index of its first; at most 1000 texts, so that an index fits beside a hash."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or i - start == 999 or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def runs(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within a text, and its text."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, owner.dtype)
    end = len(words) - n + 1
    value = np.zeros(end, np.uint64)
    for i in range(n):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + words[i : i + end])
    inside = owner[:end] == owner[n - 1 :]
    return value[inside], owner[:end][inside]


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _grouped(value: np.ndarray) -> np.ndarray:
    """An order in which equal values are neighbours. The values' last bits are sorted with their indexes, several times faster than an argsort; that is done where two values have the same last bits."""
    bits = np.uint64(len(value).bit_length())
    packed = np.sort((value.astype(np.uint64, copy=False) << bits) | np.arange(len(value), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begun, own = packed >> bits, value[order]
    return np.argsort(value) if ((begun[1:] == begun[:-1]) & (own[1:] != own[:-1])).any() else order


def _sets(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, cut to 54 bits, of each text, ascending."""
    both = _distinct((owner.astype(np.uint64) << np.uint64(54)) | (value & _LOW))
    return both & _LOW, (both >> np.uint64(54)).astype(np.int64)


def _long_enough(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, owner = word_hashes(texts)
    keep = np.bincount(owner, minlength=len(texts)) >= MIN_WORDS
    inside = keep[owner]
    return words[inside], owner[inside], np.flatnonzero(keep)


def slacks(n: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """Of a set of n runs, the first ``at`` of which another set of similarity ``least`` or more lacks: the two sets' slacks make up the runs in which the rest may differ."""
    return n * ((1 - least) / (1 + least)) - at + 1e-6


def _class_sums(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each set of runs."""
    return np.add.reduceat(_mix(value + np.uint64(0x632BE59BD9B4E019)), starts)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, record_set, item, records, first): in how many records a run (kind 0) or word (kind 1) stands, and the least mark of these, by portions; and of each record (kind 2) its class and key.

    What stands in one record of a portion only is left out, so a count lacks at most one record a portion.
    """
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}

    def counts(least: int) -> Iterator[pd.DataFrame]:
        for kind, parts in held.items():
            if sum(len(x) for x, _ in parts) <= least:
                continue
            item, mark = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = _grouped(item)
            item, mark = item[order], mark[order]
            starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
            records, first = np.diff(np.append(starts, len(item))), np.minimum.reduceat(mark, starts)
            often = records > 1
            yield pd.DataFrame({"kind": kind, "record_set": None, "item": item[starts[often]].astype(np.int64), "records": records[often], "first": first[often]})

    for rows in batches:
        sets = rows["record_set"].tolist()
        salt = {name: np.uint64(xxhash.xxh64_intdigest(name or "")) for name in set(sets)}
        for start, texts in slices(rows["text"].tolist()):
            words, owner, kept = _long_enough(texts)
            if not len(kept):
                continue
            value, of = _sets(*runs(words, owner, RUN))
            marks = rows["mark"].to_numpy()[start : start + len(texts)]
            for kind, (item, own) in enumerate(((value, of), _sets(words, owner))):
                held[kind].append((item, marks[own]))
            mine = np.array([salt[sets[start + i]] for i in kept], dtype=np.uint64)
            classes = _mix(_class_sums(value, np.flatnonzero(np.append(True, of[1:] != of[:-1]))) ^ mine)
            yield pd.DataFrame({"kind": 2, "record_set": [sets[start + i] for i in kept], "item": classes.astype(np.int64), "records": 1, "first": rows["key"].to_numpy()[start + kept]})
            yield from counts(PORTION)
    yield from counts(0)


class Order(NamedTuple):
    """Frequent runs (hashes, ascending) with their level, from 1 to 63, and group; frequent words. All other runs have level 0."""

    runs: np.ndarray
    level: np.ndarray
    group: np.ndarray
    words: np.ndarray


def count_runs(texts: DataFrame) -> DataFrame:
    """What ``_counted`` gives of all texts (record_set, key, text)."""
    marked = texts.select("record_set", "key", "text", F.xxhash64("key", "record_set").alias("mark"))
    return materialise(marked.mapInPandas(_counted, "kind int, record_set string, item long, records long, first long"), "counted")


def run_order(counted: DataFrame) -> Order:
    """The order of runs, from the counts over all records. Frequent runs about as frequent as each other of which the least mark of a record is the same are a group: the more often they stand together, the likelier."""
    least = max(2, counted.where("kind = 2").count() // RARE)
    counts = counted.where("kind < 2").groupBy("kind", "item").agg(F.sum("records").alias("records"), F.min("first").alias("first"))
    rows = counts.where(F.col("records") >= least).toPandas().sort_values("item")  # at most RARE times the runs and words of a record
    own = rows[rows["kind"] == 0]
    level = np.minimum(63, 2 * np.log2(own["records"].to_numpy(float))).astype(np.uint64)
    group = _mix(own["first"].to_numpy(np.int64).astype(np.uint64) + level)
    return Order(own["item"].to_numpy(np.int64).astype(np.uint64), level, group, rows.loc[rows["kind"] == 1, "item"].to_numpy(np.int64).astype(np.uint64))


def _find(known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in ``known`` (ascending), and whether it does."""
    if not len(known):
        return np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
    return at, known[at] == value


def _one_bit(value: np.ndarray) -> np.ndarray:
    """The one bit of 128 that each run falls on, as two 64-bit halves."""
    bit = _mix(value ^ np.uint64(0x51ED270B)) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    return np.stack([np.where(bit < 64, one, np.uint64(0)), np.where(bit < 64, np.uint64(0), one)], 1)


def fingerprints(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 128 parities of each set of runs, as two 64-bit halves."""
    return np.bitwise_xor.reduceat(_one_bit(value), starts, axis=0)


def whole_parities(value: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The WHOLE parities of each of n sets of runs, as bytes."""
    bit = (_mix(value ^ np.uint64(0xA0761D65)) >> np.uint64(32)).astype(np.int64) & (WHOLE - 1)
    odd = np.bincount(of * WHOLE + bit, minlength=n * WHOLE).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, WHOLE), axis=1)


class Sketches(NamedTuple):
    """Of texts that are long enough: index, number of runs, sum of their hashes, parities; of their block keys: position of the text among those, key, runs before it, fingerprint from it on."""

    kept: np.ndarray
    sizes: np.ndarray
    sums: np.ndarray
    whole: np.ndarray
    of: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    prints: np.ndarray


def sketch_batch(texts: list[str | None], order: Order, least: float = LEAST) -> Sketches:
    """Sketches of at most 1000 texts."""
    words, owner, kept = _long_enough(texts)
    if not len(kept):
        none = np.zeros(0, np.int64)
        return Sketches(kept, none, np.zeros(0, np.uint64), np.zeros((0, WHOLE // 8), np.uint8), none, none, none, np.zeros((0, 2), np.uint64))
    # A run without a place in the order belongs to the group of its rare word, or is one of its own.
    most = np.uint64(2**64 - 1)
    rare = np.where(_find(order.words, words & _LOW)[1], most, _mix(words))
    end = len(words) - RUN + 1
    rare = np.min([rare[i : i + end] for i in range(RUN)], axis=0)[owner[:end] == owner[RUN - 1 :]]
    value, of = runs(words, owner, RUN)
    both, first = np.unique((of.astype(np.uint64) << np.uint64(54)) | (value & _LOW), return_index=True)
    value, of, rare = both & _LOW, (both >> np.uint64(54)).astype(np.int64), rare[first]
    at, known = _find(order.runs, value)
    group, level = np.where(rare == most, _mix(value), rare), np.zeros(len(value), np.uint64)
    if known.any():
        group[known], level[known] = order.group[at[known]], order.level[at[known]]
    place = (of.astype(np.uint64) << np.uint64(54)) | (level << np.uint64(48)) | (group & np.uint64((1 << 48) - 1))
    sort = np.argsort(place, kind="stable")
    place, value = place[sort], value[sort]  # ``of`` is the same in this order
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(starts, len(of)))
    heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    mine = np.searchsorted(starts, heads, side="right") - 1
    rank = heads - starts[mine]
    # Sets that share ``least`` of their runs miss too few of each other's to differ in all of these.
    top = rank <= (sizes - np.ceil(least * sizes - 1e-9).astype(np.int64))[mine]
    upto = np.concatenate([np.zeros((1, 2), np.uint64), np.bitwise_xor.accumulate(fingerprints(value, heads), axis=0)])
    ends = np.searchsorted(heads, np.append(starts[1:], len(of)))  # groups up to the end of each text
    prints = upto[ends[mine[top]]] ^ upto[np.flatnonzero(top)]
    nth = np.repeat(np.arange(len(starts)), sizes)
    return Sketches(kept, sizes, _class_sums(value, starts), whole_parities(value, nth, len(starts)), mine[top], _mix(place[heads[top]] & _LOW), rank[top], prints)


class Keys(NamedTuple):
    """Rows of blocks, by columns, so that many are one value of Spark's: block, class, runs of the class and those before the block, two halves of the fingerprint; node and side where the block is dealt by trie nodes."""

    block: np.ndarray
    cls: np.ndarray
    n: np.ndarray
    at: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    node: np.ndarray
    side: np.ndarray


_KINDS = Keys(*(np.dtype(x) for x in ("<u8", "<i8", "<i4", "<i4", "<u8", "<u8", "<i8", "<i1")))


def _take(keys: Keys, at: np.ndarray) -> Keys:
    return Keys(*(x[at] for x in keys))


def _pack(keys: Keys) -> bytes:
    """The rows as bytes; node and side only where a row has any but those of a whole block, and each class once where its rows follow each other."""
    new = np.flatnonzero(np.append(True, keys.cls[1:] != keys.cls[:-1])) if len(keys.cls) else np.zeros(0, np.int64)
    dealt = bool(keys.node.any())
    head = np.array([len(keys.cls), len(new), dealt], "<i8")
    columns = [keys.cls[new], keys.n[new], np.diff(np.append(new, len(keys.cls))).astype("<i4"), keys.at, keys.block, keys.hi, keys.lo, *([keys.node, keys.side] if dealt else [])]
    return b"".join(x.tobytes() for x in [head, *columns])


def _unpack(packed: bytes) -> Keys:
    rows, classes, dealt = np.frombuffer(packed, "<i8", 3).tolist()
    place = 24

    def read(kind: np.dtype, many: int) -> np.ndarray:
        nonlocal place
        place += many * kind.itemsize
        return np.frombuffer(packed, kind, many, place - many * kind.itemsize)

    cls, n, many = read(_KINDS.cls, classes), read(_KINDS.n, classes), read(_KINDS.n, classes)
    at, block, hi, lo = read(_KINDS.at, rows), read(_KINDS.block, rows), read(_KINDS.hi, rows), read(_KINDS.lo, rows)
    node, side = (read(_KINDS.node, rows), read(_KINDS.side, rows)) if dealt else (np.zeros(rows, _KINDS.node), np.full(rows, 2, _KINDS.side))
    return Keys(block, np.repeat(cls, many), np.repeat(n, many), at, hi, lo, node, side)


def _joined(parts: list[Keys]) -> Keys:
    return Keys(*(np.concatenate([x, *y]) for x, *y in zip(*parts))) if len(parts) > 1 else parts[0]


SKETCHES = "cls long, n int, whole binary, sample binary, " + ", ".join(f"keys{k} binary" for k in range(ROUNDS))


def _sketches(order: Order, least: float, sample: int, portion: int):
    """Of each class: cls, n, whole, at least once, and again where another worker meets a copy of its text. And, in rows of their own, for about ``portion`` block keys at a time, those of each round (packed Keys) and the blocks of one class of ``sample``."""

    def packed(held: list[Keys]) -> pa.RecordBatch:
        keys = _joined(held)
        turn = keys.block % np.uint64(ROUNDS)
        some = keys.block[_mix(keys.cls.view(np.uint64)) % np.uint64(sample) == 0]
        out = {"cls": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int32()), "whole": pa.nulls(1, pa.binary()), "sample": pa.array([some.tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(out | {f"keys{k}": pa.array([_pack(_take(keys, np.flatnonzero(turn == k)))], pa.binary()) for k in range(ROUNDS)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Keys] = []
        seen: set[int] = set()
        for rows in batches:
            sets = rows.column("record_set").to_pylist()
            salt = {name: np.uint64(xxhash.xxh64_intdigest(name or "")) for name in set(sets)}
            for start, texts in slices(rows.column("text").to_pylist()):
                s = sketch_batch(texts, order, least)
                if not len(s.kept):
                    continue
                mine = np.array([salt[sets[start + i]] for i in s.kept], dtype=np.uint64)
                cls = _mix(s.sums ^ mine).view(np.int64)  # as in _counted
                if len(seen) > REMEMBERED:
                    seen.clear()
                new = np.array([not (c in seen or seen.add(c)) for c in cls.tolist()])
                fresh = np.flatnonzero(new[s.of])
                of = s.of[fresh]
                columns = (s.keys[fresh] ^ mine[of], cls[of], s.sizes[of], s.at[fresh], s.prints[fresh, 0], s.prints[fresh, 1], np.zeros(len(of)), np.full(len(of), 2))  # record sets have blocks of their own
                held.append(Keys(*(np.asarray(x).astype(kind) for x, kind in zip(columns, _KINDS))))
                none = pa.nulls(int(new.sum()), pa.binary())
                out = {"cls": pa.array(cls[new]), "n": pa.array(s.sizes[new].astype(np.int32)), "whole": pa.array([w.tobytes() for w in s.whole[new]], pa.binary()), "sample": none}
                yield pa.RecordBatch.from_pydict(out | {f"keys{k}": none for k in range(ROUNDS)})
                if sum(len(x.cls) for x in held) >= portion:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return run


class Walk(NamedTuple):
    """Pairs that a trie join found, the node pairs it looked at and those it dropped."""

    left: np.ndarray
    right: np.ndarray
    seen: int
    pruned: int


def _nodes(prints: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of sorted fingerprints, at each of STEPS the bits of each node and the first child of each node above; and the first fingerprint of each of the last nodes."""
    depths, before, heads, new = [], 0, np.zeros(1, np.int64), np.append(True, np.zeros(len(prints) - 1, bool))
    for bits in STEPS:
        half = bits - 1 >> 6
        begun = prints[:, half] >> np.uint64(63 - (bits - 1 & 63))
        new = new | np.append(True, begun[1:] != begun[:-1])
        starts = np.flatnonzero(new)
        own = (prints[starts, half] << np.uint64(before & 63)) >> np.uint64(64 - bits + before)
        depths.append((own, np.append(np.searchsorted(starts, heads), len(starts))))
        heads, before = starts, bits
    return depths, np.append(heads, len(prints))


def _products(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of each of the ranges from a to b with those from c to d: number of the range, and the two members."""
    wide = d - c
    many = (b - a) * wide
    at = np.repeat(np.arange(len(a)), many)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return at, a[at] + nth // wide[at], c[at] + nth % wide[at]


def _step_down(one: np.ndarray, two: np.ndarray | None, budget: float) -> Walk:
    """Pairs of fingerprints (of ``one`` with ``two``, or within ``one``, both sorted), walked to step by step from the roots of their tries."""
    (left, ends), (right, stops) = _nodes(one), _nodes(one if two is None else two)
    root = np.zeros(1, np.int64)
    todo, found, seen, pruned = [(0, root, root, root)], [(root[:0], root[:0])], 0, 0
    while todo:
        step, u, v, differ = todo.pop()
        if step == len(STEPS):
            at, x, y = _products(ends[u], ends[u + 1], stops[v], stops[v + 1])
            keep = slice(None) if two is not None else x < y
            found.append((x[keep], y[keep]))
            continue
        (own, child), (other, below) = left[step], right[step]
        if len(u) > 1 and ((child[u + 1] - child[u]) * (below[v + 1] - below[v])).sum() > HELD:
            half = len(u) // 2
            todo += [(step, u[:half], v[:half], differ[:half]), (step, u[half:], v[half:], differ[half:])]
            continue
        at, x, y = _products(child[u], child[u + 1], below[v], below[v + 1])
        if two is None:
            keep = x <= y
            at, x, y = at[keep], x[keep], y[keep]
        differ = differ[at] + np.bitwise_count(own[x] ^ other[y])
        near = differ <= budget
        seen, pruned = seen + len(x), pruned + len(x) - int(near.sum())
        todo.append((step + 1, x[near], y[near], differ[near]))
    return Walk(*(np.concatenate(z) for z in zip(*found)), seen, pruned)


def _by_halves(one: np.ndarray, two: np.ndarray | None, budget: float, slack: np.ndarray | None = None, other_slack: np.ndarray | None = None) -> Walk:
    """As ``_step_down``, all pairs at once; with the slacks of both sides, only pairs that lie within these, or miss them by less than two bits."""
    other = one if two is None else two
    found, seen, pruned = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, 0
    rows = max(1, CACHED // max(1, len(other)))
    if slack is not None:
        low, high = (np.clip(np.floor(x), -8000, 16000).astype(np.int16) for x in (slack, slack if two is None else other_slack))
    for start in range(0, len(one), rows):
        part = one[start : start + rows]
        after = start if two is None else 0
        differ = np.bitwise_count(part[:, 0, None] ^ other[None, after:, 0])
        differ += np.bitwise_count(part[:, 1, None] ^ other[None, after:, 1])
        near = differ <= min(int(budget), 128)
        if slack is not None:
            near &= differ - low[start : start + rows, None] <= high[None, after:] + np.int16(1)
        x, y = np.divmod(np.flatnonzero(near), near.shape[1])
        seen, pruned = seen + near.size, pruned + near.size - len(x)
        x, y = x + start, y + after
        keep = slice(None) if two is not None else x < y
        found.append((x[keep], y[keep]))
    return Walk(*(np.concatenate(z) for z in zip(*found)), seen, pruned)


def _part(prints: np.ndarray, start: int, bits: int) -> np.ndarray:
    """The bits of fingerprints from ``start`` on."""
    high, low = prints[:, 0], prints[:, 1]
    if start >= 64:
        value = low << np.uint64(start - 64)
    else:
        value = (high << np.uint64(start)) | (low >> np.uint64(64 - start)) if start else high
    return value >> np.uint64(64 - bits)


def _by_parts(one: np.ndarray, two: np.ndarray | None, budget: float) -> Walk | None:
    """As ``_step_down``, with the budget split over parts of the fingerprint: what differs in at most ``budget`` bits differs, in one part of several, in at most one bit (or none).

    Each part is looked up in the others', once as it is and once with each bit turned. None where comparing all pairs takes no longer.
    """
    most, self_join = int(budget), two is None
    two = one if two is None else two
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    pairs = len(one) * len(two) // (2 if self_join else 1)
    turned = 0 if 128 // (most + 1) >= PART else 1
    parts = max(2, (most + 1 + turned) // (1 + turned))
    cuts = [128 * k // parts for k in range(parts + 1)]
    probes = len(small) * (parts + 128 * turned) + len(large) * parts
    if 128 // parts < PART or probes * PROBE > pairs:
        return None
    found, seen, near_ones = [], probes, 0
    for start, end in zip(cuts, cuts[1:]):
        key, mine = _part(large, start, end - start), _part(small, start, end - start)
        order, sort = np.argsort(key), np.argsort(mine)
        key, mine = key[order], mine[sort]
        turns = [np.uint64(0)] + ([np.uint64(1 << b) for b in range(end - start)] if turned else [])
        ranges = []
        for turn in turns:
            probe = mine ^ turn
            first = np.searchsorted(key, probe)
            hit = np.flatnonzero(key[np.minimum(first, len(key) - 1)] == probe)
            ranges.append((hit, first[hit], np.searchsorted(key, probe[hit], side="right")))
        at, first, last = (np.concatenate(x) for x in zip(*ranges))
        total = np.cumsum(last - first)
        seen += int(total[-1]) if len(total) else 0
        if (seen - probes) * FOUND > pairs:
            return None
        for lot in np.split(np.arange(len(at)), np.searchsorted(total, np.arange(HELD, total[-1], HELD))) if len(at) else []:
            nth, y, _ = _products(first[lot], last[lot], np.zeros(len(lot), np.int64), np.ones(len(lot), np.int64))
            x, y = sort[at[lot][nth]], order[y]
            if self_join:
                keep = x < y
                x, y = x[keep], y[keep]
            near = np.bitwise_count(small[x, 0] ^ large[y, 0]).astype(np.int64) + np.bitwise_count(small[x, 1] ^ large[y, 1]) <= most
            found.append(x[near] * len(large) + y[near])
    both = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    x, y = both // len(large), both % len(large)
    return Walk(*((x, y) if small is one else (y, x)), seen, max(0, pairs - len(both)))


def trie_walk(prints: np.ndarray, slack: np.ndarray, leaf: int = LEAF) -> Walk:
    """Pairs (i < j) of 128-bit fingerprints (n × 2) that differ in no more bits than their two slacks allow, by a self-join of their binary trie.

    Pairs of nodes are walked down together, first those of about one slack, then those of a beginning, adding up the differing bits, and dropped beyond the largest
    budget below them.
    """
    n = len(prints)
    part = np.floor(slack / SLACK).astype(np.int64) if n > leaf else np.zeros(n, np.int64)
    order = np.lexsort((prints[:, 1], prints[:, 0], part))
    prints, part = prints[order], part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if n else np.zeros(0, np.int64)
    most = np.maximum.reduceat(slack[order], starts) if n else slack
    ends = np.append(starts[1:], n)
    left, right, seen, pruned = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for u, v in zip(*(x.tolist() for x in np.triu_indices(len(starts)))):
        seen, budget = seen + 1, most[u] + most[v]
        if budget < 0:
            pruned += 1
            continue
        one, two = prints[starts[u] : ends[u]], None if u == v else prints[starts[v] : ends[v]]
        walk = (_by_parts(one, two, budget) if n > leaf else None) or (_step_down(one, two, budget) if budget <= FINE and n > leaf else None)
        walk = walk or _by_halves(one, two, budget, slack[order[starts[u] : ends[u]]], slack[order[starts[v] : ends[v]]])
        left.append(walk.left + starts[u])
        right.append(walk.right + starts[v])
        seen, pruned = seen + walk.seen, pruned + walk.pruned
    i, j = order[np.concatenate(left)], order[np.concatenate(right)]
    near = np.bitwise_count(prints[np.concatenate(left)] ^ prints[np.concatenate(right)]).sum(1) <= slack[i] + slack[j]
    return Walk(np.minimum(i, j)[near], np.maximum(i, j)[near], seen, pruned)


def trie_pairs(prints: np.ndarray, budget: int, sides: np.ndarray | None = None, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of fingerprints that differ in at most ``budget`` bits. sides: only pairs of side 0 with side 1, or within side 2, are wanted."""
    walk = trie_walk(prints, np.full(len(prints), budget / 2), leaf)
    i, j = walk.left, walk.right
    wanted = slice(None) if sides is None else (sides[i] == 2) | (sides[i] != sides[j])
    return i[wanted], j[wanted]


def _ends(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from those above in one of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _once(keys: Keys) -> Keys:
    """The rows, one of each class in a block and node: several workers may have met its text."""
    order = _grouped(_mix(keys.block ^ _mix(keys.cls.view(np.uint64) ^ _mix(keys.node.view(np.uint64)))))
    first, next_ = order[:-1], order[1:]
    again = (keys.block[first] == keys.block[next_]) & (keys.cls[first] == keys.cls[next_]) & (keys.node[first] == keys.node[next_])
    return _take(keys, np.sort(order[np.append(True, ~again)])) if again.any() else keys


def _with_partner(keys: Keys, least: float) -> Keys:
    """Rows sorted by block and node, without those that no other row of theirs lies near enough to: by their slacks, or by what is left of the longer set, which is too much for the shorter."""
    starts = _ends(keys.block, keys.node)
    nth = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys.block))))
    slack = slacks(keys.n, keys.at, least)
    early = slack >= 0
    most, shortest = np.maximum.reduceat(slack, starts), np.minimum.reduceat(np.where(early, keys.n, np.iinfo(np.int32).max), starts)
    # Two rows without slack never pair. One of n runs without slack pairs with m only if its runs from the block on are enough for both: m (least / (1 + least)) <= n - at - n (least / (1 + least)).
    room = (keys.n - keys.at + 1e-6) * ((1 + least) / least) - keys.n
    alone = np.diff(np.append(starts, len(keys.block)))[nth] == 1
    return _take(keys, np.flatnonzero(~alone & (early | ((slack + most[nth] >= 0) & (shortest[nth] <= room)))))


def _join_keys(keys: Keys, least: float) -> pa.RecordBatch:
    """Pairs of classes of whole blocks. Small blocks of one size go through together, others by their tries."""
    keys = _once(keys)
    keys = _take(keys, np.lexsort((keys.block, keys.node)) if keys.node.any() else _grouped(keys.block))
    if len(keys.block):
        keys = _with_partner(keys, least)
    prints, cls, side, n, at = np.stack([keys.hi, keys.lo], 1), keys.cls, keys.side, keys.n, keys.at
    starts = _ends(keys.block, keys.node)
    sizes = np.diff(np.append(starts, len(cls)))
    left, right, slack, rest = [], [], slacks(n, at, least), n - at

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        can = ((side[x] == 2) | (side[x] != side[y])) & (np.minimum(rest[x], rest[y]) + 1e-6 >= (n[x] + n[y]) * (least / (1 + least)))
        x, y = x[can], y[can]
        near = np.bitwise_count(prints[x] ^ prints[y]).sum(1) <= slack[x] + slack[y]
        left.append(x[near])
        right.append(y[near])

    for size in np.unique(sizes[sizes > 1]):
        first = starts[sizes == size]
        if size <= 32:
            i, j = np.triu_indices(size, 1)
            for part in np.array_split(first, max(1, len(first) * len(i) // 1_000_000)):
                keep((part[:, None] + i).ravel(), (part[:, None] + j).ravel())
        else:
            for start in first:
                own = slice(start, start + size)
                walk = trie_walk(prints[own], slack[own])
                keep(walk.left + start, walk.right + start)
    x, y = (cls[np.concatenate(z)] if z else np.zeros(0, np.int64) for z in (left, right))
    both = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})[x != y].drop_duplicates()
    return pa.RecordBatch.from_pandas(both, preserve_index=False)


def _join_buckets(least: float):
    """Pairs of classes of the blocks of each bucket; rows (bucket, keys) are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Keys] = []
        last = None
        for rows in batches:
            for bucket, packed in zip(rows.column("bucket").to_pylist(), rows.column("keys").to_pylist()):
                if bucket != last and held:
                    yield _join_keys(_joined(held), least)
                    held = []
                last = bucket
                held.append(_unpack(packed))
        if held:
            yield _join_keys(_joined(held), least)

    return run


def _deal(keys: Keys, block: np.ndarray, depth: np.ndarray, least: float) -> Keys:
    """The rows, and those of a large block (ascending, with the depth of its nodes) once for each pair of trie nodes of theirs, each of which is a task of its own.

    Those without slack can't pair with each other, so they go to one task each, by their node, where they meet all that have slack.
    """
    at, large = _find(block, keys.block)
    if not large.any():
        return keys
    parts = [_take(keys, np.flatnonzero(~large))]
    for deep in np.unique(depth[at[large]]).tolist():
        some = _take(keys, np.flatnonzero(large & (depth[at] == deep)))
        own, early = (some.hi >> np.uint64(64 - deep)).astype(np.int64), slacks(some.n, some.at, least) >= 0
        late = np.flatnonzero(~early)
        parts.append(_take(some, late)._replace(node=-(own[late] + 1), side=np.full(len(late), 1, _KINDS.side)))
        first = np.flatnonzero(early)
        mine = own[first]
        for node in range(1 << deep):
            side = np.where(mine == node, 2, np.where(mine < node, 0, 1)).astype(_KINDS.side)
            parts.append(_take(some, first)._replace(node=np.minimum(mine, node) * (1 << 20) + np.maximum(mine, node) + 1, side=side))
            parts.append(_take(some, first)._replace(node=np.full(len(first), -(node + 1)), side=np.zeros(len(first), _KINDS.side)))
    return _joined(parts)


def _dealt(block: np.ndarray, depth: np.ndarray, least: float, buckets: int):
    """(bucket, keys): packed rows by buckets, which hold whole blocks, or all of a pair of nodes of a large one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for packed in rows.column("keys").to_pylist():
                keys = _deal(_unpack(packed), block, depth, least)
                bucket = ((_mix(keys.block + _mix(keys.node.view(np.uint64))) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")  # rows of a class stay together
                bucket = bucket[order]
                cuts = np.append(_ends(bucket), len(bucket))
                values = [_pack(_take(keys, order[i:j])) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "keys": pa.array(values, pa.binary())})

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for packed in rows.column("sample").to_pylist():
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.frombuffer(packed, "<i8"))})


def candidate_pairs(sketches: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): distinct pairs of classes that share a block and lie within their error budget. Input: what ``_sketches`` gives."""
    packed = sketches.where(F.col("sample").isNotNull())
    # Blocks too large for one task, at most one for HOT rows, estimated from every 64th class; this steers only how the work is dealt.
    large = packed.select("sample").mapInArrow(_blocks, "block long").groupBy("block").agg((F.count("*") * HOT_SAMPLE).alias("size")).where(F.col("size") > HOT)
    large = large.select("block", F.least(F.ceil(F.log2(F.col("size") / HOT)) + 1, F.lit(20)).cast("int").alias("depth")).toPandas()
    block = large["block"].to_numpy(np.int64).astype(np.uint64)
    order, found = np.argsort(block), []
    deal = _dealt(block[order], large["depth"].to_numpy(np.int64)[order], least, 4 * int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for k in range(ROUNDS):
        rows = packed.select(F.col(f"keys{k}").alias("keys")).mapInArrow(deal, "bucket int, keys binary")
        both = rows.repartition("bucket").sortWithinPartitions("bucket")
        found.append(materialise(both.mapInArrow(_join_buckets(least), "a long, b long"), "pairs"))
        release(sketches.sparkSession)
    pairs = materialise(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    discard(*found)
    return pairs


def _run_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for start, texts in slices(rows["text"].tolist()):
            value, of = _sets(*runs(*word_hashes(texts), RUN))
            cuts = np.searchsorted(of, np.arange(1, len(texts)))
            yield rows[["cls"]].iloc[start : start + len(texts)].assign(runs=[s.astype(np.uint32).tobytes() for s in np.split(_mix(value), cuts)])


def _by_parities(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """The pairs whose whole parities differ in no more bits than the sets may in runs. own: cls, n, whole."""
    share = (1 - least) / (1 + least)

    @F.pandas_udf(BooleanType())
    def near(n: pd.Series, x: pd.Series, m: pd.Series, y: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(side), np.uint64).reshape(len(side), WHOLE // 64) for side in (x, y))
        return pd.Series(np.bitwise_count(one ^ two).sum(1) <= (n + m).to_numpy() * share + 1e-6)

    left, right = own.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("whole").alias("x")), own.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("whole").alias("y"))
    return materialise(pairs.join(left, "a").join(right, "b").where(near("n", "x", "m", "y")).select("a", "b"), "near")


@F.pandas_udf(DoubleType())
def _jaccard(one: pd.Series, two: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(one, two):
        x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
        both = np.concatenate([x, y])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        out.append(common / (len(both) - common))
    return pd.Series(out)


def class_links(texts: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """((record_set, key, cls), (a, b, similarity)): the class of each record of at least MIN_WORDS words, and the pairs of different classes that are similar enough."""
    texts = texts.select("record_set", F.col("key").cast("long").alias("key"), "text")
    counted = count_runs(texts)
    members = counted.where("kind = 2").select("record_set", F.col("first").alias("key"), F.col("item").alias("cls"))
    firsts = members.groupBy("record_set", "cls").agg(F.min("key").alias("key"))
    sketch = _sketches(run_order(counted), least, HOT_SAMPLE, KEYS)
    release(texts.sparkSession)
    sketches = materialise(texts.select("record_set", "text").mapInArrow(sketch, SKETCHES), "sketches")  # read where they lie: texts aren't shuffled to leave out copies
    own = materialise(sketches.where(F.col("cls").isNotNull()).select("cls", "n", "whole").dropDuplicates(["cls"]), "parities")
    release(texts.sparkSession)
    near = candidate_pairs(sketches, least)
    discard(sketches)  # the largest table; what follows needs ``own`` alone
    pairs = _by_parities(near, own, least)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    one = materialise(firsts.join(wanted, "cls", "left_semi"), "representatives")
    sets = materialise(texts.join(one, ["record_set", "key"]).select("cls", "text").mapInPandas(_run_sets, "cls long, runs binary"), "runs")
    left, right = sets.select(F.col("cls").alias("a"), F.col("runs").alias("x")), sets.select(F.col("cls").alias("b"), F.col("runs").alias("y"))
    links = pairs.join(left, "a").join(right, "b").withColumn("similarity", _jaccard("x", "y"))
    return members, materialise(links.where(F.col("similarity") >= least).select("a", "b", "similarity"), "links")


def record_pairs(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(record_set, key_a, key_b): all pairs of records, key_a < key_b, with at least ``least`` of their runs in common; exact copies are pairs as well.

    Input: record_set, key (unique in its set), text. Null texts and those under MIN_WORDS words never count.
    """
    members, links = class_links(texts, least)
    copied = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    both = copied.unionByName(links.select("a", "b"))
    left, right = members.select("record_set", F.col("cls").alias("a"), F.col("key").alias("i")), members.select(F.col("cls").alias("b"), F.col("key").alias("j"))
    rows = both.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("i") < F.col("j")))
    return rows.select("record_set", F.least("i", "j").alias("key_a"), F.greatest("i", "j").alias("key_b")).where("key_a < key_b").distinct()


def groups(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(record_set, key, cls, links, group): every record of at least MIN_WORDS words, with its class, the number of classes it is similar to, and its group, the least class that links lead to.

    Groups are found by passing the least class on along links and along the classes passed so far, which halves the way at each step; each step is written to the shared folder.
    """
    members, links = class_links(texts, least)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    label = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "label")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "l"), "b").select("a", "l").unionByName(label)
        step = near.groupBy("a").agg(F.min("l").alias("l"))
        jump = step.alias("s").join(step.select(F.col("a").alias("l"), F.col("l").alias("further")).alias("t"), "l", "left")
        new = materialise(jump.select("a", F.least("l", F.coalesce("further", "l")).alias("l")), "label")
        changed = new.join(label, ["a", "l"], "left_anti").limit(1).count()
        label = new
        if not changed:
            break
    rows = members.join(label.withColumnRenamed("a", "cls"), "cls", "left").join(degree.withColumnRenamed("a", "cls"), "cls", "left")
    return rows.select("record_set", "key", "cls", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("l", "cls").alias("group"))
