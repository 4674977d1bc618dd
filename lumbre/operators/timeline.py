"""Mixed timestamp formats and time zones, normalised (problem 7).

Every value's valid readings are generated as an array; a Viterbi pass over each source's records in their order chooses one for each, with penalties
for switching the order of day and month and for jumping back in time.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbre.functions.timestamps import READINGS, let, parts, readings, utc_form, valid_zone
from lumbre.plans.tables import materialise

#: Costs of another format than the record before, of an unlikely order, and, for each e-fold of days, of going back in time (at most MOST).
SWITCH, AGAINST, BACK, MOST = 2.0, 1.0, 1.0, 6.0
#: Record keys of a source in one task.
BLOCK = 100_000

_INFINITE = float("inf")


def _pass(last: tuple[str, int], now: tuple[str, int]) -> float:
    """Cost of one reading (format, time) after another."""
    gone = (last[1] - now[1]) / 86_400_000_000
    return SWITCH * (last[0] != now[0]) + (min(MOST, BACK * math.log1p(gone)) if gone > 0 else 0.0)


def _walk(rows: pd.DataFrame, start: int | None = None) -> tuple[list[float], list[list[int]], list[tuple[str, int]]]:
    """Least costs of each reading of the last record, for every record but the first the reading before each reading, and the last readings; from reading ``start`` of the first record."""
    costs: list[float] = []
    last: list[tuple[str, int]] = []
    back = []
    for formats, times, unlikely in zip(rows["formats"], rows["times"], rows["unlikely"]):
        now = list(zip(formats, times))
        against = [AGAINST * (form == unlikely) for form, _ in now]
        if not last:
            costs = [a if start in (None, i) else _INFINITE for i, a in enumerate(against)]
        else:
            ways = [[c + _pass(x, y) for c, x in zip(costs, last)] for y in now]
            source = [min(range(len(w)), key=w.__getitem__) for w in ways]
            costs = [w[s] + a for w, s, a in zip(ways, source, against)]
            back.append(source)
        last = now
    return costs, back, last


def _through(rows: pd.DataFrame) -> pd.DataFrame:
    """What one block costs from each reading of its first record to each of its last."""
    rows = rows.sort_values(["record_key", "row"], kind="stable")
    first, costs, last = list(zip(rows["formats"].iloc[0], rows["times"].iloc[0])), [], []
    for i in range(len(first)):
        one, _, last = _walk(rows, i)
        costs += one
    head = rows.iloc[:1][["field_name", "source", "block"]]
    return head.assign(costs=[costs], **{f"{end}_{what}": [[x[n] for x in ends]] for end, ends in (("first", first), ("last", last)) for n, what in enumerate(("formats", "times"))})


def _ends(blocks: pd.DataFrame) -> pd.DataFrame:
    """The readings of the first and last record of each block on the best way through all blocks of a source."""
    blocks = blocks.sort_values("block", ignore_index=True)
    costs: list[float] = []
    before: list[tuple[str, int]] = []
    ways = []
    for _, b in blocks.iterrows():
        first, last = list(zip(b["first_formats"], b["first_times"])), list(zip(b["last_formats"], b["last_times"]))
        into = [[c + _pass(x, y) for c, x in zip(costs, before)] for y in first] if before else [[0.0]] * len(first)
        source = [min(range(len(w)), key=w.__getitem__) for w in into]
        through = [[into[i][source[i]] + b["costs"][i * len(last) + j] for i in range(len(first))] for j in range(len(last))]
        start = [min(range(len(t)), key=t.__getitem__) for t in through]
        costs, before = [t[s] for t, s in zip(through, start)], last
        ways.append((source, start))
    at = min(range(len(costs)), key=costs.__getitem__)
    starts, ends = [], []
    for source, start in reversed(ways):
        ends.append(at)
        starts.append(start[at])
        at = source[start[at]]
    return blocks[["field_name", "source", "block"]].assign(start=starts[::-1], end=ends[::-1])


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """Index of the chosen reading of each record of a block, between the readings chosen for its ends."""
    rows = rows.sort_values(["record_key", "row"], kind="stable")
    _, back, _ = _walk(rows, int(rows["start"].iloc[0]))
    picks = [int(rows["end"].iloc[0])]
    for source in reversed(back):
        picks.append(source[picks[-1]])
    return rows[["row"]].assign(pick=picks[::-1])


def normalise(records: DataFrame, strict: bool = True, block: int = BLOCK) -> DataFrame:
    """(field_name, record_key, value, readings, pick, utc_form): the chosen reading of every record; null pick and form where the value has none.

    Input: field_name, record_key (long, the record order), source, value, zone, month_first. Where ``strict``, ``month_first`` (null counts as false) decides the
    order of slash dates; else both orders are read and it only makes one less likely. Null and unreadable values have no readings; values coarser than a day
    have none either. Rows repeated under one key are records of their own. Sources of any size are cut to blocks of ``block`` keys: first the cost of each
    block from each reading of its first record to each of its last is found, then the best way through all blocks, then the choices within each, which are those
    of the whole chain. Only records of several readings, and their neighbours, are walked through; the choice of the others is no choice.
    """
    records = records.select("field_name", "record_key", "source", "value", "zone", "month_first")
    order = F.coalesce("month_first", F.lit(False)) if strict else F.lit(None).cast("boolean")
    got = let(parts(F.col("value")), lambda p: readings(p, F.col("zone"), order))
    rows = records.withColumn("zone", valid_zone(F.col("zone"))).withColumn("readings", F.coalesce(got, F.array().cast(READINGS)))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "readings")
    unlikely = F.when(F.col("month_first"), F.lit("S:dmy")).otherwise(F.lit("S:mdy"))
    time = F.transform("readings", lambda r: F.coalesce(r["micros"], r["day"].cast("long") * 86_400_000_000))
    chain = rows.where(F.size("readings") > 0).select(
        "field_name", "record_key", "row", F.coalesce("source", F.lit("")).alias("source"), F.transform("readings", lambda r: r["format"]).alias("formats"), time.alias("times"), unlikely.alias("unlikely"),
        F.floor(F.col("record_key") / block).alias("block"), (F.size("readings") > 1).alias("several"),
    )
    keys = ["field_name", "source", "block"]
    beside = Window.partitionBy(*keys).orderBy("record_key", "row")
    either = F.col("several") | F.coalesce(F.lag("several").over(beside), F.lit(True)) | F.coalesce(F.lead("several").over(beside), F.lit(True))  # an end of the block has no neighbour
    near = materialise(chain.withColumn("near", either).where("near").drop("near", "several"), "near")
    schema = "field_name string, source string, block long, costs array<double>, first_formats array<string>, first_times array<long>, last_formats array<string>, last_times array<long>"
    blocks = near.groupBy(*keys).applyInPandas(_through, schema)
    ends = blocks.groupBy("field_name", "source").applyInPandas(_ends, "field_name string, source string, block long, start int, end int")
    picks = near.join(ends, keys).groupBy(*keys).applyInPandas(_choose, "row long, pick int")
    pick = F.coalesce("pick", F.when(F.size("readings") == 1, 0))
    rows = rows.join(picks, "row", "left").withColumn("pick", pick)
    return rows.select("field_name", "record_key", "value", "readings", "pick", utc_form(F.get("readings", F.col("pick"))).alias("utc_form"))


def certain(normalised: DataFrame) -> DataFrame:
    """(field_name, record_key, utc_form): values that name exactly one instant, or one day."""
    return normalised.where((F.size("readings") == 1) & F.col("utc_form").isNotNull()).select("field_name", "record_key", "utc_form")
