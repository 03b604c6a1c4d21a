"""One instant in UTC from times written in many forms and zones.

Every value is parsed once into wall-clock fields and, where it names one, a
zone. Fixed offsets are subtracted; a wall time of a named zone is matched
against the zone's offset intervals, exploded to one row a local year so that
the as-of match is an equi-join on (zone, year): two intervals hold an
ambiguous time (the earlier instant counts), none a skipped one (the offset
before the change counts), one gives the offset.

The interval table is made from the IANA zone rules, so its size (zones x
years) does not depend on the data and it may be broadcast. It has the local years
FIRST_YEAR to LAST_YEAR: before them every zone has its first offset, and a later
year is looked up as the one of the last 28 that has the same days of the week
and as many days, as the rules that hold by then only ask for those.

Defined results: years 1 to 9999 count; null, blank, relative, date-only, time-only and impossible
values give no row; absent seconds are 0; digits finer than a microsecond are
cut; an owner without a known zone gives no row unless the value has its own
zone; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import calendar
import functools
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zone abbreviations and their offset in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "sast": 120, "msk": 180, "gst": 240, "pkt": 300, "ist": 330, "ict": 420, "wib": 420,
    "cst": 480, "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600,
    "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "brt": -180, "art": -180,
}
#: Stands for letters that are no zone.
NO_ZONE = 1 << 20
#: The zones' first change is later than the one, all announced changes (2087) earlier than the 28 years before the other.
FIRST_YEAR, LAST_YEAR = 1800, 2128
#: A year after LAST_YEAR by (day of the week it begins with, leap year): its like among the last 28.
LIKE_YEAR = {(date(y, 1, 1).isoweekday() % 7 + 1, calendar.isleap(y)): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@functools.cache
def zone_intervals(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(from, to, offset) in seconds of UTC, without gaps, for one zone; the first has no beginning."""
    z = ZoneInfo(zone)

    def off(t: int) -> int:
        return int((_EPOCH + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())

    step = 14 * 86400
    start = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp()) - 2 * 86400
    stop = int(datetime(LAST_YEAR + 1, 1, 1, tzinfo=timezone.utc).timestamp()) + 2 * 86400
    out, began, cur, t = [], -(1 << 50), off(start), start
    while t < stop:
        nxt = min(t + step, stop)
        if (o := off(nxt)) != cur:
            a, b = t, nxt
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if off(m) == cur else (a, m)
            out.append((began, b, cur))
            began, cur, t = b, off(b), b
            continue
        t = nxt
    return (*out, (began, stop, cur))


@functools.cache
def _names() -> dict[str, str]:
    return {z.lower(): z for z in sorted(available_timezones()) if not z.startswith(("posix/", "right/"))}


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """zone -> (zone, local year, [(local from, local to, offset)])."""
    begins = [int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in range(FIRST_YEAR, LAST_YEAR + 2)]
    for b in batches:
        rows = []
        for zone in b.column("zone").to_pylist():
            if zone not in _names():
                continue
            iv = zone_intervals(_names()[zone])
            for i, y in enumerate(range(FIRST_YEAR, LAST_YEAR + 1)):
                lo, hi = begins[i] - 86400, begins[i + 1] + 86400
                rows.append({"zone": zone, "year": y, "spans": [
                    {"a": a + o, "b": e + o, "off": o} for a, e, o in iv if a + o < hi and e + o > lo]})
        yield pa.RecordBatch.from_pylist(rows, _SPANS)


_SPANS = pa.schema([("zone", pa.string()), ("year", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("off", pa.int64())])))])


def interval_table(zones: DataFrame) -> DataFrame:
    """Offset intervals of the zones named (lower case), one row a local year.

    Names the zone rules do not know are left out, so there are at most as many
    zones as IANA has (about 600, of 329 years each).
    """
    return zones.select("zone").where("zone is not null").distinct().mapInArrow(
        _explode, "zone string, year int, spans array<struct<a:bigint,b:bigint,off:bigint>>")


def _clean(c: Column) -> Column:
    """Full-width signs to ASCII, white space of any kind to one blank."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "−‐‑–"
    ascii_ = "".join(chr(x) for x in range(0x21, 0x7F)) + "----"
    c = F.translate(c, wide, ascii_)
    return F.trim(F.regexp_replace(c, r"(?U)[\s​﻿]+", " "))


_ZONE = r"([a-z]{1,5}(?![a-z_/]))? ?(?:([+-]\d{1,2})(?::?(\d{2}))?)?(?: ?\([a-z]{2,5}\))? ?(?:[\[(]?((?<=\[)[a-z0-9_+\-/]+|[a-z_]+(?:/[a-z0-9_+\-]+)+)[\])]?)?"
_HALF = r"(凌晨|清晨|早上|早晨|上午|中午|下午|傍晚|晚上|晚间|am|pm)?"
_TIME = _HALF + r" ?(\d{1,2}) ?[:时点] ?(\d{1,2})(?: ?[:分] ?(\d{1,2}))?(?:(?<=\d)[.,](\d+))?(?:分|秒)?,? ?(?:(am|pm|a\.m\.|p\.m\.)(?![a-z]))?"
# a value becomes: wall time | fraction | half of the day | letters of the zone | hours | minutes | IANA name
_REST = "|$8|$4$9|$10|$11|$12|$13"
_SHAPES = [
    (r"^(?:北京时间:? ?)?(\d{4})[-/.年] ?(\d{1,2})[-/.月] ?(\d{1,2})日?[t,]? ?" + _TIME + " ?" + _ZONE + r"(?: ?北京时间)?$", "$1-$2-$3 $5:$6:$7" + _REST),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})[t,]? ?" + _TIME + " ?" + _ZONE + "$", "$3-$2-$1 $5:$6:$7" + _REST),
    (r"^(?:[a-z]{3,9},? )?([a-z]{3})[a-z]{0,6}\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4}),? (?:at )?" + _TIME + " ?" + _ZONE + "$", "$3-$1-$2 $5:$6:$7" + _REST),
    (r"^(?:[a-z]{3,9},? )?(\d{1,2})[ -]([a-z]{3})[a-z]{0,6}\.?[ -](\d{4}),? (?:at )?" + _TIME + " ?" + _ZONE + "$", "$3-$2-$1 $5:$6:$7" + _REST),
    (r"^(\d{4})(\d{2})(\d{2})[t ]?()(\d{2}):?(\d{2}):?(\d{2})?(?:[.,](\d+))?() ?" + _ZONE + "$", "$1-$2-$3 $5:$6:$7" + _REST),
]
_COUNT = r"^-?(?:\d{9,11}|\d{13}|\d{15,16}|\d{18,19})(?:\.\d+)?$"


def parsed(v: Column) -> Column:
    """The seven fields above in one string, or null."""
    out = F.lit(None).cast("string")
    for shape, order in reversed(_SHAPES):
        out = F.when(v.rlike(shape), F.regexp_replace(v, shape, order)).otherwise(out)
    # a count keeps its place: whole part and fraction
    return F.when(v.rlike(_COUNT), F.concat(F.lit("#"), v)).otherwise(out)


def instants(df: DataFrame, value: str, owner_zone: str, zones: DataFrame) -> DataFrame:
    """``df`` with epoch_us, rows without an instant left out.

    ``owner_zone`` is the column of the IANA name that holds where a value
    names no zone; ``zones`` has all such names in its column zone. Zones named
    in values are found by a light scan for brackets. The projections are kept
    small on purpose: one large generated method would not be compiled.
    """
    v = F.col(value)
    inside = df.where(v.contains("[") | v.contains("［") | (v.contains("/") & v.rlike("[A-Za-z]/[A-Za-z]")))
    inside = inside.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_clean(v)), F.lit(r"([a-z_]+(?:/[a-z0-9_+\-]+)+|(?<=\[)[a-z0-9_+\-/]+)"), F.lit(1)))).alias("zone"))
    every = zones.select(F.lower("zone").alias("zone")).unionAll(inside)
    every = every.unionAll(df.sparkSession.range(1).select(F.lit("asia/shanghai").alias("zone")))
    spans = interval_table(every).select(F.col("zone").alias("__zone"), F.col("year").alias("__year"), F.col("spans").alias("__spans"))

    d = df.withColumn("__v", F.lower(_clean(F.col(value))))
    d = d.withColumn("__p", F.split(parsed(F.col("__v")), r"\|"))
    part = lambda i: F.get(F.col("__p"), F.lit(i))
    wall = lambda fmt: F.unix_seconds(F.try_to_timestamp(F.concat(part(0), F.lit(" Z")), F.lit(fmt)))
    d = d.withColumns({
        "__wall": F.coalesce(wall("y-M-d H:m:[s] X"), wall("y-MMM-d H:m:[s] X")),
        "__us": F.rpad(F.substring(part(1), 1, 6), 6, "0").cast("bigint"),
    })
    h, half = F.pmod(F.expr("__wall div 3600"), F.lit(24)), part(2)
    clock12 = half.isin("am", "pm", "a.m.", "p.m.")
    late, early = half.isin("下午", "傍晚", "晚上", "晚间", "pm", "p.m."), half.isin("凌晨", "清晨", "早上", "早晨", "上午", "am", "a.m.")
    shift = F.when(half == "", 0).when(clock12 & (h > 12), None).when(late & (h < 12), 12).when(early & (h == 12), -12).when((half == "中午") & (h < 3), 12).otherwise(0)
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    minutes = F.concat(F.left(part(4), F.lit(1)), part(5)).try_cast("int")
    american = F.when((part(3) == "cst") & F.lower(owner_zone).rlike("^(america|us)/"), -360)
    named = F.when(part(6) != "", part(6)).when(F.col("__v").contains("北京时间"), "asia/shanghai").otherwise(F.lower(owner_zone))
    d = d.withColumns({
        "__local": F.col("__wall") + shift * 3600,
        "__fixed": F.when(part(4) != "", part(4).try_cast("int") * 60 + F.coalesce(minutes, F.lit(0))).when(part(3) != "", F.coalesce(american, F.element_at(known, part(3)), F.lit(NO_ZONE))),
        "__zone": named,
    })
    # the year the local time is in, and the one it is looked up in
    y = F.year(F.timestamp_seconds("__local"))
    begin = F.make_date(y, F.lit(1), F.lit(1))
    likes = F.create_map(*[F.lit(x) for (day, leap), year in LIKE_YEAR.items() for x in (day * 2 + leap, year)])
    leap = (F.dayofyear(F.make_date(y, F.lit(12), F.lit(31))) == 366).cast("int")
    like = F.element_at(likes, F.dayofweek(begin) * 2 + leap)
    late_year = F.when(y < FIRST_YEAR, FIRST_YEAR).when(y > LAST_YEAR, like).otherwise(y)
    d = d.withColumn("__year", late_year)
    moved = F.when(y > LAST_YEAR, F.datediff(begin, F.make_date(F.col("__year"), F.lit(1), F.lit(1))).cast("bigint") * 86400).otherwise(F.lit(0))
    d = d.withColumn("__at", F.col("__local") - moved)
    d = d.join(F.broadcast(spans), ["__zone", "__year"], "left")
    d = d.withColumn("__offset", F.when(F.col("__fixed").isNotNull(), F.col("__fixed") * 60).otherwise(F.coalesce(
        # the earlier of two instants has the larger offset; in a gap the last interval that ended holds
        F.expr("array_max(transform(filter(__spans, x -> __at >= x.a and __at < x.b), x -> x.off))"),
        F.expr("array_max(transform(filter(__spans, x -> x.b <= __at), x -> struct(x.b, x.off))).off"),
    )))
    number = F.ltrim(F.substring(part(0), 2, 40), F.lit("-"))
    k = F.split_part(number, F.lit("."), F.lit(1))
    fr = F.rpad(F.substring(F.split_part(number, F.lit("."), F.lit(2)), 1, 6), 6, "0").try_cast("bigint")
    n, n_digits = k.try_cast("bigint"), F.length(k)
    counted = F.when(n_digits <= 11, n * 1_000_000 + fr).when(n_digits == 13, n * 1000 + F.floor(fr / 1000)).when(n_digits <= 16, n).otherwise(F.floor(n / 1000))
    counted = counted * F.when(F.substring(part(0), 2, 1) == "-", -1).otherwise(1)
    at = F.when(F.left(part(0), F.lit(1)) == "#", counted).when(
        F.coalesce(F.col("__fixed"), F.lit(0)) != NO_ZONE, (F.col("__local") - F.col("__offset")) * 1_000_000 + F.col("__us"))
    d = d.select(*df.columns, at.cast("bigint").alias("epoch_us"))
    return d.where("epoch_us is not null")


def owned(df: DataFrame, src: str, key: str, value: str, owner: str | None, zones: DataFrame) -> DataFrame:
    """(src, row_key, v, zone): values with the zone of their owner, else of Asia/Shanghai."""
    d = df.select(F.lit(src).alias("src"), F.col(key).alias("row_key"), F.col(value).alias("v"), *([F.col(owner).alias("owner_name")] if owner else []))
    if not owner:
        return d.withColumn("zone", F.lit("Asia/Shanghai"))
    # one row an owner; whether this equi-join is broadcast is left to the planner's size check
    one = zones.groupBy("owner_name").agg(F.min("tz").alias("zone"))
    return d.join(one, "owner_name", "left").select("src", "row_key", "v", "zone")
