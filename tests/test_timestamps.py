import datetime as dt
import itertools
import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lumbre.functions.hosts import site_of
from lumbre.operators import timeline

SCHEMA = "field_name string, record_key long, source string, value string, zone string, month_first boolean"


def _forms(spark, values, zone="America/New_York", month_first=False, strict=True):
    rows = [("f", i, "s", v, zone, month_first) for i, v in enumerate(values)]
    got = {r.record_key: r for r in timeline.normalise(spark.createDataFrame(rows, SCHEMA), strict).collect()}
    return [(len(got[i].readings), got[i].utc_form) for i in range(len(values))]


@pytest.mark.parametrize(
    "value, form",
    [
        ("2022-02-02T00:17:56-05:00[America/Havana]", "2022-02-02T05:17:56Z"),
        ("2021-09-07 22:48:27 EDT", "2021-09-08T02:48:27Z"),
        ("1586043054363", "2020-04-04T23:30:54Z"),
        (" 1678670838 ", "2023-03-13T01:27:18Z"),
        ("26/01/2021 09:55:17 PM UTC-05:00", "2021-01-27T02:55:17Z"),
        ("20200729_100501", "2020-07-29T14:05:01Z"),
        ("20200710", "2020-07-10"),
        ("Feb 27, 2022 12:59 AM", "2022-02-27T05:59:00Z"),
        ("18 de junio de 2021", "2021-06-18"),
        ("4 de enero de 2021, 02:07:54", "2021-01-04T07:07:54Z"),
        ("Sat, 04 Mar 2023 02:34:18 GMT", "2023-03-04T02:34:18Z"),
        ("31-Mar-20", "2020-03-31"),
        ("9. Oct 2021", "2021-10-09"),
        ("Reviewed December 15, 2019", "2019-12-15"),
        ("3. März 2021", "2021-03-03"),
        ("2022-10-30T02:49:11.360", "2022-10-30T06:49:11Z"),
        ("2023-08-03T22:15-04:00", "2023-08-04T02:15:00Z"),
        ("02/08/2020, 08:54:05", "2020-08-02T12:54:05Z"),
    ],
)
def test_forms(spark, value, form):
    assert _forms(spark, [value]) == [(1, form)]


@pytest.mark.parametrize("value", [None, "", "ayer", "3 weeks ago", "enero de 2022", "N/A", "00/00/0000, 00:00:00", "31/11/2022 25:61", "2023-02-29", "13/13/2020", "2021-03-14 02:30:00", "x" * 20_000, "Feb 27, 2022 13:59 AM"])
def test_no_readings(spark, value):
    assert _forms(spark, [value]) == [(0, None)]


def test_clock_changes(spark):
    """Every wall minute around both changes, against the zone database."""
    zone = ZoneInfo("America/New_York")
    values = [f"2021-{d} {h:02}:{m:02}:00" for d in ("03-14", "11-07") for h in range(4) for m in (0, 30, 59)]
    for value, (n, form) in zip(values, _forms(spark, values)):
        wall = dt.datetime.fromisoformat(value)
        want = {u for f in (0, 1) for u in [wall.replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc)] if u.astimezone(zone).replace(tzinfo=None) == wall}
        assert n == len(want)
        if n == 1:
            assert form == want.pop().strftime("%Y-%m-%dT%H:%M:%SZ")


def test_no_zone(spark):
    assert _forms(spark, ["2021-05-05 10:00:00", "2021-05-05", "2021-05-05 10:00:00Z"], zone=None) == [(0, None), (1, "2021-05-05"), (1, "2021-05-05T10:00:00Z")]
    assert _forms(spark, ["2021-05-05 10:00:00"], zone="Nowhere/Land") == [(0, None)]


def test_month_first(spark):
    assert _forms(spark, ["01/02/2020", "13/02/2020"], month_first=True) == [(1, "2020-01-02"), (0, None)]
    assert _forms(spark, ["01/02/2020"], month_first=None) == [(1, "2020-02-01")]


def test_order_of_a_source_decides(spark):
    """Between days that read one way only, the ambiguous ones follow them."""
    got = _forms(spark, ["25/01/2020", "03/02/2020", "04/02/2020", "25/02/2020"], month_first=None, strict=False)
    assert [f for _, f in got] == ["2020-01-25", "2020-02-03", "2020-02-04", "2020-02-25"]
    got = _forms(spark, ["01/25/2020", "02/03/2020", "02/04/2020", "02/25/2020"], month_first=None, strict=False)
    assert [f for _, f in got] == ["2020-01-25", "2020-02-03", "2020-02-04", "2020-02-25"]


@pytest.mark.parametrize("block", [1, 3, 10])
def test_blocks_are_as_good_as_one(spark, block):
    values = [f"{d:02}/{m:02}/2020" for m in range(1, 7) for d in range(1, 29, 3)]
    rng = random.Random(block)
    values += [f"{rng.randint(1, 14):02}/{rng.randint(1, 12):02}/2020" for _ in range(30)]
    df = spark.createDataFrame([("f", i, f"s{i % 2}", v, None, None) for i, v in enumerate(values)], SCHEMA)
    key = lambda b: sorted((r.record_key, r.pick, r.utc_form) for r in timeline.normalise(df, strict=False, block=b).collect())
    assert key(block) == key(10**6)


def test_choice_is_the_cheapest_of_all(spark):
    """Against every combination of readings."""
    rng = random.Random(8)
    values = [f"{rng.randint(1, 13):02}/{rng.randint(1, 13):02}/2020" for _ in range(9)]
    df = spark.createDataFrame([("f", i, "s", v, None, None) for i, v in enumerate(values)], SCHEMA)
    rows = [r for r in timeline.normalise(df, strict=False, block=4).orderBy("record_key").collect() if r.readings]

    def cost(picks):
        read = [(r.readings[p].format, r.readings[p].day * 86_400_000_000) for r, p in zip(rows, picks)]
        return sum(timeline.AGAINST * (f == "S:mdy") for f, _ in read) + sum(timeline._pass(x, y) for x, y in zip(read, read[1:]))

    best = min(cost(p) for p in itertools.product(*[range(len(r.readings)) for r in rows]))
    assert cost([r.pick for r in rows]) == pytest.approx(best)


def test_planted_order_of_days_and_months(spark):
    """A site that writes its days one way, in the order of time: nearly all ambiguous dates come out right."""
    for shape in ("%d/%m/%Y", "%m/%d/%Y"):
        days = [datetime(2020, 1, 1) + timedelta(days=3 * i) for i in range(200)]
        df = spark.createDataFrame([("f", i, "s", d.strftime(shape), None, None) for i, d in enumerate(days)], SCHEMA)
        got = {r.record_key: r.utc_form for r in timeline.normalise(df, strict=False, block=30).collect()}
        assert sum(got[i] == d.strftime("%Y-%m-%d") for i, d in enumerate(days)) >= 196


def test_rows_under_one_key(spark):
    df = spark.createDataFrame([("f", 1, "s", "2020-01-01", None, None)] * 2 + [("f", 1, "s", "03/02/2020", None, None)], SCHEMA)
    assert sorted(r.utc_form for r in timeline.normalise(df).collect()) == ["2020-01-01", "2020-01-01", "2020-02-03"]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert timeline.certain(timeline.normalise(empty)).count() == 0
    extra = spark.createDataFrame([("f", 1, None, "2020-01-01", None, None)], SCHEMA).withColumn("readings", F.lit(1)).withColumn("pick", F.lit(2))
    assert [tuple(r) for r in timeline.certain(timeline.normalise(extra)).collect()] == [("f", 1, "2020-01-01")]


def test_sites(spark):
    urls = ["https://www.A.example/x", "http://m.a.example:80/", "https://u@b.example", "a", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(site_of(F.col("u"))).collect()] == ["a.example", "a.example", "b.example", "", "", ""]
