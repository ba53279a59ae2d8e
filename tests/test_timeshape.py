import datetime as dt
import zoneinfo
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.functions import timeshape as ts

NY = "America/New_York"


def run(spark, values, **kw):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, _v int")
    got = ts.normalise(df, "v", out="s", local_date="d", **kw).orderBy("_v").collect()
    return [(r.s, r.d) for r in got]


def iso(s):
    return None if s is None else dt.datetime.fromtimestamp(s, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


CASES = [
    ("2020-07-01T12:00:00Z", "2020-07-01T12:00:00Z"),
    ("  2020-07-01t12:00:00z ", "2020-07-01T12:00:00Z"),
    ("2020-07-01T12:00Z", "2020-07-01T12:00:00Z"),
    ("2020-07-01T12:00:00.123456789Z", "2020-07-01T12:00:00Z"),
    ("2020-07-01 12:00:00", "2020-07-01T16:00:00Z"),
    ("2020-01-01 12:00:00.5", "2020-01-01T17:00:00Z"),
    ("20200701T120000Z", "2020-07-01T12:00:00Z"),
    ("2020-07-01 12:00:00 +0545", "2020-07-01T06:15:00Z"),
    ("2020-07-01 12:00:00-0330", "2020-07-01T15:30:00Z"),
    ("2020-07-01T12:00:00+05:30", "2020-07-01T06:30:00Z"),
    ("Wed, 01 Jul 2020 12:00:00 GMT", "2020-07-01T12:00:00Z"),
    ("Wed, 01 Jul 2020 12:00:00 -0400", "2020-07-01T16:00:00Z"),
    ("July 1, 2020, 12:00 ET", "2020-07-01T16:00:00Z"),
    ("January 1, 2020, 12:00 ET", "2020-01-01T17:00:00Z"),
    ("Jul 1, 2020 12:05 AM EDT", "2020-07-01T04:05:00Z"),
    ("Jul 1, 2020 12:05 PM CEST", "2020-07-01T10:05:00Z"),
    ("7/1/2020 1:05 PM", "2020-07-01T17:05:00Z"),
    ("07/01/2020 13:05:06", "2020-07-01T17:05:06Z"),
    ("1593604800", "2020-07-01T12:00:00Z"),
    ("1593604800999", "2020-07-01T12:00:00Z"),
    # the hour that occurs twice means the first, the one that is missing the offset before
    ("2020-11-01 01:30:00", "2020-11-01T05:30:00Z"),
    ("2020-03-08 02:30:00", "2020-03-08T07:30:00Z"),
]
NONE = [None, "", "   ", "N/A", "pending", "-", "0000-00-00", "0000-00-00 00:00:00", "0", "0000000000", "2020-13-01 00:00:00", "2020-02-30", "25:00", "2020-07-01 24:00:00", "13/13/2020 10:00:00", "Foo 1, 2020, 12:00 ET", "2020-07-01 12:00:00 QQT", "x" * 5000]


def test_instants(spark):
    got = run(spark, [c for c, _ in CASES] + NONE)
    assert [iso(s) for s, _ in got] == [w for _, w in CASES] + [None] * len(NONE)


def test_dates(spark):
    values = ["2020-07-01", "20200701", "2020-183", "2020-W27-3", "1-Jul-20", "Jul 1, 2020", "Wed 1 Jul 2020", "07/01/2020", "2020-07-01T00:00:00", "2020-07-02T03:00:00Z", "2020-07-02T09:00:00+09:00"]
    assert {d for _, d in run(spark, values)} == {dt.date(2020, 7, 1)}
    assert [d for _, d in run(spark, ["0000-00-00", "TBD", None, "2020-366", "2021-366"])][:3] == [None] * 3


def test_day_first_and_zone_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("3/4/2021 10:00 AM", "Europe/London", True), ("3/4/2021 10:00 AM", NY, False), ("3/4/2021 10:00 AM", None, None)], "v string, z string, dmy boolean")
    got = ts.normalise(df, "v", zone=F.col("z"), zones=["Europe/London", NY], day_first=F.col("dmy"), out="s").collect()
    assert [iso(r.s) for r in got] == ["2021-04-03T09:00:00Z", "2021-03-04T15:00:00Z", None]
    assert got[0].z == "Europe/London"


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "v string, s int, mask string, kind string, _digits string, tz_zone string")
    out = ts.normalise(df, "v", out="s")
    assert out.count() == 0 and sorted(out.columns) == sorted(df.columns)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1971, 1, 1), dt.datetime(2060, 1, 1)), st.sampled_from([NY, "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "America/Los_Angeles"]))
def test_transitions_match_zoneinfo(t, zone):
    want = int(t.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds())
    local = int(t.replace(tzinfo=dt.timezone.utc).timestamp())
    segs = next(s for _, y, s in ts.transitions(zone) if y == t.year)
    assert [off for since, off in segs if since <= local][-1] == want


def test_layout_table_is_small_and_unique():
    rows = ts.layouts()
    assert len({r[0] for r in rows}) == len(rows) < 5000


@pytest.mark.parametrize("epoch", [0, 1593604800, 253402300799, -1])
def test_utc_text(spark, epoch):
    from pyspark.sql import functions as F

    want = (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=epoch)).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert spark.range(1).select(ts.utc_text(F.lit(epoch).cast("long")).alias("x")).first().x == want


def test_the_sessions_zone_does_not_matter(spark):
    values = [c for c, _ in CASES] + ["2020-07-01", "2020-183", "2020-W27-3"]
    want = run(spark, values)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert run(spark, values) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_release_is_the_one_read():
    """The tables agree with the folder whose release is reported."""
    base = ts._release()
    if base is None:
        pytest.skip("no wheel")
    import tzdata

    assert ts.zone_version() == tzdata.IANA_VERSION
    with (base / "America" / "New_York").open("rb") as f:
        own = zoneinfo.ZoneInfo.from_file(f)
    at = dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)
    assert ts._zone("America/New_York").utcoffset(at) == own.utcoffset(at)
    with pytest.raises(zoneinfo.ZoneInfoNotFoundError):
        ts._zone("No/Where")


def test_unknown_masks_are_counted(spark):
    df = spark.createDataFrame([("2024-01-02",), ("??7??",), ("??8??",), ("",), (None,)], "x string")
    assert [(r.n, r.example) for r in ts.unknown_masks(df, "x").collect()] == [(2, "??7??")]
