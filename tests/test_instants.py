from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tideline.operators import instants as I

SCHEMA = "k bigint, v string, zone string, epoch string"


def _us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


def _run(spark, values, zone="Asia/Shanghai"):
    d = spark.createDataFrame([(i, v, zone, "x") for i, v in enumerate(values)], SCHEMA)
    z = spark.createDataFrame([(zone,)], "zone string")
    got = {r.k: r.epoch_us for r in I.instants(d, "v", "zone", z).collect()}
    return [got.get(i) for i in range(len(values))]


def test_forms(spark):
    noon = _us(2025, 3, 4, 4, 5, 6)
    same = [
        "2025-03-04 12:05:06", " 2025/3/4  12:05:06\t", "2025-03-04T12:05:06+08:00", "2025-03-04T04:05:06Z", "20250304T040506Z", "20250304120506", "1741061106",
        "1741061106000", "1741061106000000", "1741061106.000", "2025年3月4日 12:05:06", "2025年03月04日12时05分06秒", "2025年3月4日 下午12:05:06", "北京时间 2025-03-04 12:05:06",
        "2025-03-04T04:05:06[Europe/London]", "Tue, 04 Mar 2025 04:05:06 GMT", "Mon, 03 Mar 2025 23:05:06 -0500", "Mar 4, 2025 12:05:06 PM", "Mar 4, 2025 3:05:06 PM AEDT",
        "2025-03-04 12:05:06 UTC+8", "04.03.2025 12:05:06", "２０２５－０３－０４　１２：０５：０６", "2025-03-04T04:05:06.000000+00:00", "2025-03-04T09:35:06+05:30",
    ]
    assert _run(spark, same) == [noon] * len(same)


def test_precision(spark):
    base = _us(2025, 3, 4, 4, 5, 6)
    v = ["2025-03-04 12:05:06.1", "2025-03-04 12:05:06,520", "2025-03-04T04:05:06.123456789Z", "1741061106123456", "1741061106.5", "2025-03-04 12:05"]
    assert _run(spark, v) == [base + 100_000, base + 520_000, base + 123_456, base + 123_456, base + 500_000, base - 6_000_000]


def test_none(spark):
    v = [None, "", " ", "--", "nan", "N/A", "yesterday", "5分钟前", "21:45", "2025-05-06", "2025-02-30 10:00:00", "2025-13-01 08:00:00", "2025-08-11 25:61:00", "0000-00-00 00:00:00", "Mar 4, 2025 13:05 PM", "12", "2025-03-04 12:05 XYZ", "2025-03-04T12:05:06[No/Zone]"]
    assert _run(spark, v) == [None] * len(v)


def test_half_days(spark):
    v = ["2025年1月2日 上午12:39", "2025年1月2日 下午12:39", "2025年1月2日 下午1:00", "Jan 2, 2025 12:00 AM"]
    assert _run(spark, v, "Etc/UTC") == [_us(2025, 1, 2, 0, 39), _us(2025, 1, 2, 12, 39), _us(2025, 1, 2, 13), _us(2025, 1, 2)]


def test_changes_of_offset(spark):
    # twice: the earlier instant; skipped: the offset from before
    assert _run(spark, ["2025-11-02 01:30:00", "2025-03-09 02:30:00"], "America/New_York") == [_us(2025, 11, 2, 5, 30), _us(2025, 3, 9, 7, 30)]
    assert _run(spark, ["2025-10-26 02:30:00", "2025-03-30 02:30:00"], "Europe/Berlin") == [_us(2025, 10, 26, 0, 30), _us(2025, 3, 30, 1, 30)]


def test_against_the_session_library(spark):
    v = [f"{y}-{m:02d}-{d:02d} {h:02d}:30:00" for y in (1975, 1999, 2025, 2060) for m in (3, 4, 10, 11) for d in range(1, 32) for h in (1, 2) if d < 31 or m in (3, 10)]
    for zone in ("America/New_York", "Australia/Sydney", "Europe/London"):
        want = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v string").select(
            "i", F.unix_micros(F.to_utc_timestamp(F.col("v").cast("timestamp"), zone)).alias("u")).orderBy("i").collect()
        assert _run(spark, v, zone) == [r.u for r in want]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Africa/Casablanca", "Australia/Lord_Howe", "Asia/Shanghai", "Europe/Dublin"])
def test_years_far_away(spark, zone):
    """Every year there is, against the library's zone rules."""
    years = [1, 1492, 1799, 1800, 1848, 1883, 1890, 1901, 1918, 1941, 1945, 1969, 1970, 2037, 2038, 2069, 2070, 2087, 2088, 2100, 2127, 2128, 2129, 2156, 2200, 2299, 2304, 2399, 2400, 2401, 9999]
    at = [datetime(y, m, d, h, 30) for y in years for m, d in ((1, 1), (3, 10), (3, 28), (4, 3), (7, 1), (10, 27), (11, 3), (12, 31)) for h in (0, 1, 2, 23)]
    z, epoch = ZoneInfo(zone), datetime(1970, 1, 1)
    want = [int((t - epoch - t.replace(tzinfo=z).utcoffset()).total_seconds()) * 1_000_000 for t in at]
    assert _run(spark, [f"{t.year:04d}-{t.month}-{t.day} {t.hour}:30:00" for t in at], zone) == want


def test_zones_in_values(spark):
    four = _us(2025, 3, 4, 4)
    v = ["2025-03-04 05:00 Europe/Berlin", "2025/03/04 05:00:00 europe/berlin", "2025-03-04 05:00 (Europe/Berlin)", "Mar 3, 2025 11:00 PM America/New_York", "2025-03-04T01:00:00 America/Argentina/Buenos_Aires", "2025-03-04 12:00 CST", "1969-07-20 20:17:40Z"]
    assert _run(spark, v) == [four] * 6 + [_us(1969, 7, 20, 20, 17, 40)]
    assert _run(spark, ["2025-03-03 22:00 CST", "2025-03-04 12:00 HKT"], "America/Chicago") == [four, four]
    assert _run(spark, ["2025-03-04 05:00 Europe/Nowhere", "-1741061106", "-1741061106.25", "-1741061106000"]) == [None, -1741061106000000, -1741061106250000, -1741061106000000]


def test_unknown_owner_and_empty(spark):
    d = spark.createDataFrame([(1, "2025-01-01 00:00:00", None, ""), (2, "2025-01-01T00:00:00Z", None, "")], SCHEMA)
    z = spark.createDataFrame([], "zone string")
    assert [r.k for r in I.instants(d, "v", "zone", z).collect()] == [2]
    assert I.instants(d.limit(0), "v", "zone", z).count() == 0
