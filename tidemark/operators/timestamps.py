"""Mixed timestamp formats and time zones, normalised to one unambiguous form.

Values are rewritten to a small grammar with native column expressions. Local times
with a zone are placed by an as-of join with the zone's offset intervals, exploded
to one row per local year: two matching intervals mean an ambiguous time, none a
nonexistent one, one gives the offset directly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import fresh

#: Local years with exact offsets; outside, the nearest of these years' ends holds.
FIRST_YEAR, LAST_YEAR = 1900, 2100
DAY_US = 86_400_000_000
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_INTERVALS = "zone string, year int, spans array<struct<lo: bigint, hi: bigint, off: bigint>>"
_UNREAD = "[0-9Xx]*[Xx?_-][0-9Xx?_-]*"
_NAME = "[A-Za-z]{3,9}"
#: Dates by shape; the groups are year, month and day, or the two parts whose order the writer's habit decides.
SHAPES = (
    "(?<y1>\\d{4})-(?<m1>\\d{2})-(?<d1>\\d{2})",
    "(?<y2>\\d{4}|\\d{2})(?<m2>\\d{2})(?<d2>\\d{2})",
    "(?<d3>\\d{1,2})\\.(?<m3>\\d{1,2})\\.(?<y3>\\d{4}|\\d{2})",
    f"(?<m4>{_NAME})\\.? (?<d4>\\d{{1,2}}),? (?:(?<y4>\\d{{4}}|\\d{{2}})|{_UNREAD})",
    f"(?<d5>\\d{{1,2}})[ -](?<m5>{_NAME})\\.?[ -](?:(?<y5>\\d{{4}}|\\d{{2}})|{_UNREAD})",
    "0+ 0+ (?<y6>\\d{4}|\\d{2})",
    "(?<y7>\\d{4})",
    "(?<a8>\\d{1,2})/(?<b8>\\d{1,2})/(?<y8>\\d{4}|\\d{2})",
)


def _spans(name: str) -> list[tuple[float, float, int]]:
    """(UTC start, UTC end, offset) in seconds for the whole year range."""
    zone = ZoneInfo(name)
    off = lambda t: int(datetime.fromtimestamp(t, timezone.utc).astimezone(zone).utcoffset().total_seconds())
    base = datetime(FIRST_YEAR - 1, 12, 25, tzinfo=timezone.utc)
    start = int(base.timestamp())
    stop = int(datetime(LAST_YEAR + 1, 1, 8, tzinfo=timezone.utc).timestamp())
    out, begun, now = [], float("-inf"), off(start)
    for t in range(start, stop, 7 * 86_400):
        lo, hi = t, t + 7 * 86_400
        while off(lo) != off(hi):
            a, b = lo, hi
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if off(m) == off(lo) else (a, m)
            out.append((begun, b, now))
            begun, now, lo = b, off(b), b
    return [*out, (begun, float("inf"), now)]


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    far = 2**62
    for b in batches:
        rows = []
        for name in b["zone"]:
            try:
                spans = _spans(name)
            except Exception:  # no such zone
                continue
            for year in range(FIRST_YEAR, LAST_YEAR + 1):
                lo = datetime(year, 1, 1, tzinfo=timezone.utc) - timedelta(days=3)
                hi = datetime(year + 1, 1, 1, tzinfo=timezone.utc) + timedelta(days=3)
                a = float("-inf") if year == FIRST_YEAR else lo.timestamp()
                z = float("inf") if year == LAST_YEAR else hi.timestamp()
                near = [(s, e, o) for s, e, o in spans if s < z and e > a]
                rows.append((name, year, [{"lo": -far if s == float("-inf") else int((s + o) * 1_000_000), "hi": far if e == float("inf") else int((e + o) * 1_000_000), "off": o * 1_000_000} for s, e, o in near]))
        yield pd.DataFrame(rows, columns=["zone", "year", "spans"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """Local offset intervals of the zones in column ``zone``, one row per zone and local year.

    Unknown names, null and blank ones give no row. At most some 600 zone names exist,
    so the table has a fixed bound of about 120,000 short rows.
    """
    return zones.select("zone").where("zone is not null and zone <> ''").distinct().mapInPandas(_explode, _INTERVALS)


def _month(c: Column) -> Column:
    names = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.lower(c))


def _num(c: Column) -> Column:
    return c.try_cast("bigint")


def named_zone(value: Column) -> Column:
    """The zone name a value ends with, or ``''``."""
    return F.regexp_extract(F.trim(value), "[\\[( ]([A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)[\\])]?$", 1)


def parse(df: DataFrame, value: str, order: Column, noise: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the struct ``_p``: y, mo, d, us (time of day), off (minutes), abbr, zone, kind, epoch.

    ``kind`` is time, date, year, month_day or null for what can't be read.
    """
    s = F.trim(F.regexp_replace(F.col(f"`{value}`"), "[\\s\\u00a0]+", " "))
    s = F.regexp_replace(s, "^(?i:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? (?=[0-9A-Za-z])|" + "".join(f"{x}|" for x in noise) + "\\*+$", "")
    s = F.regexp_replace(s, "^(\\d{2})(\\d{2})(\\d{2})Z ([A-Za-z]{3,9}) (\\d{4}|\\d{2})$", "$1 $4 $5 $2:$3Z")
    s = F.regexp_replace(s, " (\\d{2})(\\d{2}) ?(?:hrs?|hours)$", " $1:$2")
    s = F.regexp_replace(s, "^(\\d{4})(\\d{2})(\\d{2})T(\\d{2})(\\d{2})(\\d{2})?", "$1-$2-$3T$4:$5:$6")
    s = F.regexp_replace(s, "^((?:19|20)\\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])([01]\\d|2[0-3])([0-5]\\d)$", "$1-$2-$3T$4:$5")
    s = F.regexp_replace(s, "^((?:19|20)\\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])([01]\\d|2[0-3])([0-5]\\d)([0-5]\\d)$", "$1-$2-$3T$4:$5:$6")
    s = F.regexp_replace(s, ":(?=[Z+\\-\\[( ]|$)", "")
    d = df.withColumn("_s", s).withColumn("_zone", named_zone(F.col("_s")))

    clock = "(?:T\\d{2}|[T ]\\d{1,2}[:.]\\d{2}(?:[:.]\\d{2}(?:[.,]\\d+)?)?(?: ?[AaPp]\\.?[Mm]\\.?)?)"
    offset = f"^(.*{clock}) ?(?:GMT|UTC)?([+-]\\d{{2}}):?(\\d{{2}})?$"
    short = f"^(.*{clock}) ?[\\[(]?([A-Z]{{2,5}})[\\])]?$"
    c = F.col("_s")
    sign = F.regexp_extract(c, offset, 2)
    mins = F.regexp_extract(c, offset, 3)
    off = F.when(sign != "", F.when(F.substring(sign, 1, 1) == "-", -1).otherwise(1) * (F.abs(_num(sign)) * 60 + F.coalesce(_num(mins), F.lit(0))))
    off = F.when(c.rlike(f"{clock}Z$"), F.lit(0)).otherwise(off)
    abbr = F.regexp_extract(c, short, 2)
    d = d.withColumn("_off", off).withColumn("_abbr", F.when(F.upper(abbr).isin("", "AM", "PM"), F.lit(None)).otherwise(abbr))
    body = F.when(F.col("_off").isNotNull(), F.when(c.rlike("Z$"), F.regexp_replace(c, "Z$", "")).otherwise(F.regexp_extract(c, offset, 1)))
    body = F.coalesce(body, F.when(F.col("_zone") != "", F.regexp_replace(c, "[\\[( ]+[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+[\\])]?$", "")), F.when(F.col("_abbr").isNotNull(), F.regexp_extract(c, short, 1)), c)
    timed = "^(.*?\\S)(?:T|, | )(\\d{1,2})(?:[:.](\\d{2})(?:[:.](\\d{2})(?:[.,](\\d{1,9}))?)?(?: ?([AaPp])\\.?[Mm]\\.?)?)?$"
    has_clock = body.rlike(f"{clock}$")
    parts = F.split(F.when(has_clock, F.regexp_replace(body, timed, "$1|$2|$3|$4|$5|$6")).otherwise(F.concat(body, F.lit("|||||"))), "\\|")
    d = d.withColumn("_t", parts).withColumn("_timed", has_clock)
    t = lambda i: F.get(F.col("_t"), F.lit(i))

    day = t(0)
    # One pattern for all shapes of a date; the parts that a shape lacks stay blank.
    shape = "^(?:" + "|".join(SHAPES) + ")$"
    part = lambda x: "".join(f"${{{g}}}" for g in re.findall(f"\\?<({x}\\d)>", shape))
    cut = F.regexp_replace(day, shape, "|".join(part(x) for x in "ymdab"))
    d = d.withColumn("_d", F.split(F.when(day.rlike(shape), cut), "\\|"))
    yy, mm, dy, one, two = (F.get(F.col("_d"), F.lit(i)) for i in range(5))
    slashed = one != ""
    mm = F.when(slashed, F.when(order == "MDY", one).when(order == "DMY", two)).otherwise(mm)
    dy = F.when(slashed, F.when(order == "MDY", two).when(order == "DMY", one)).otherwise(dy)
    y, dd = _num(F.when(F.length(yy) == 2, F.concat(F.lit("19"), yy)).otherwise(yy)), _num(dy)
    mo = F.coalesce(_num(mm), _month(mm)).cast("bigint")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    most = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(y.isNull() | leap, 29).otherwise(28)).otherwise(31)
    real = mo.between(1, 12) & (dd >= 1) & (dd <= most) & (y.isNull() | y.between(1, 9999))
    h12, half = _num(t(1)), F.lower(t(5))
    h = F.when(half == "", F.when(h12 <= 23, h12)).when(h12.between(1, 12), h12 % 12 + F.when(half == "p", 12).otherwise(0))
    mi, se = F.coalesce(_num(t(2)), F.lit(0)), F.coalesce(_num(t(3)), F.lit(0))
    us = F.when((mi <= 59) & (se <= 59), ((h * 60 + mi) * 60 + se) * 1_000_000 + _num(F.rpad(F.substring(t(4), 1, 6), 6, "0")))
    digits = F.length(c)
    count = _num(c)
    epoch = F.when(c.rlike("^\\d+$"), F.when(digits.between(9, 10), count * 1_000_000).when(digits.between(12, 13), count * 1000).when(digits.between(15, 16), count).when(digits.between(18, 19), F.floor(count / 1000)))
    plain = ~F.col("_timed")
    kind = (
        F.when(epoch.isNotNull(), "epoch")
        .when(F.col("_timed") & y.isNotNull() & real & us.isNotNull(), "time")
        .when(plain & (mm == "") & (dy == "") & y.between(1, 9999), "year")
        .when(plain & y.isNotNull() & real, "date")
        .when(plain & (yy == "") & real, "month_day")
    )
    packed = F.struct(y.alias("y"), mo.alias("mo"), dd.alias("d"), us.alias("us"), F.col("_off").alias("off"), F.col("_abbr").alias("abbr"), F.col("_zone").alias("zone"), kind.alias("kind"), epoch.alias("epoch"))
    return d.withColumn("_p", packed).drop("_s", "_zone", "_off", "_abbr", "_t", "_timed", "_d")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def utc_text(us: Column) -> Column:
    """Microseconds since 1970 as ``YYYY-MM-DDTHH:MM:SS.ffffffZ``, whatever the session's zone."""
    rest = F.pmod(us, F.lit(DAY_US))
    days = F.round((us - rest) / DAY_US).cast("bigint")
    sec = ((rest - rest % 1_000_000) / 1_000_000).cast("bigint")
    part = lambda c: _pad(c.cast("bigint"), 2)
    clock = F.concat(part(F.floor(sec / 3600)), F.lit(":"), part(F.floor(sec % 3600 / 60)), F.lit(":"), part(sec % 60), F.lit("."), _pad(rest % 1_000_000, 6))
    return F.concat(F.date_from_unix_date(days.cast("int")).cast("string"), F.lit("T"), clock, F.lit("Z"))


def normalize(df: DataFrame, value: str, zone: str, order: str, abbrevs: DataFrame, zones: DataFrame, out: str = "norm_date", status: str = "date_status", noise: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``value`` in one unambiguous form and how it was reached.

    ``zone`` and ``order`` (DMY or MDY) are the columns to fall back on, ``abbrevs``
    has the columns abbr and offset_minutes (each abbr once), ``zones`` a column zone
    with the fallback zones that occur. Times of day come out in UTC with microseconds,
    dates as precise as given. Status: exact, ambiguous or nonexistent (both take the
    offset in force before the change), date, year, month_day, or unresolved with a
    null result: null, blank or unreadable values, impossible dates, unknown zones or
    abbreviations, times without any zone. ``noise`` are patterns of the caller's own
    data that are cut from values first. Columns named like ``out`` or ``status``
    are kept, the new ones are then lengthened by ``_``. Every row comes out once.
    """
    out = fresh(out, df.columns)
    status = fresh(status, [*df.columns, out])
    # The row goes along as one value, so its columns can have any names.
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    p = parse(df.select(row.alias("_row"), F.col(f"`{value}`").alias("_value"), F.col(f"`{zone}`").alias("_fallback"), F.col(f"`{order}`").alias("_order")), "_value", F.col("_order"), noise)
    ab = abbrevs.where("abbr is not null").select(F.col("abbr").alias("_a"), F.col("offset_minutes").cast("bigint").alias("_am")).dropDuplicates(["_a"])
    p = p.join(ab, F.col("_p.abbr") == F.col("_a"), "left")
    fixed = F.coalesce(F.col("_p.off"), F.col("_am"))
    own = F.when(F.col("_p.zone") != "", F.col("_p.zone")).when(F.col("_p.abbr").isNull(), F.col("_fallback"))
    is_time = F.col("_p.kind") == "time"
    year = F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), F.col("_p.y"))).cast("int")
    p = p.withColumn("_z", F.when(is_time & fixed.isNull(), own)).withColumn("_y", year)
    seen = df.select(named_zone(F.col(f"`{value}`")).alias("zone")).distinct()
    spans = zone_intervals(zones.select("zone").unionByName(seen)).select(F.col("zone").alias("_iz"), F.col("year").alias("_iy"), "spans")
    # Bounded by the number of zone names and years, see zone_intervals.
    p = p.join(F.broadcast(spans), (F.col("_z") == F.col("_iz")) & (F.col("_y") == F.col("_iy")), "left")
    days = F.unix_date(F.when(is_time, F.make_date(F.col("_p.y").cast("int"), F.col("_p.mo").cast("int"), F.col("_p.d").cast("int")))).cast("bigint")
    p = p.withColumn("_local", days * DAY_US + F.col("_p.us"))
    hit = F.filter("spans", lambda x: (x["lo"] <= F.col("_local")) & (F.col("_local") < x["hi"]))
    before = F.filter("spans", lambda x: x["hi"] <= F.col("_local"))
    p = p.withColumn("_hit", hit)
    n = F.size("_hit")
    # Intervals are in time order: the first match, or for a skipped time the last one that is over, was in force before.
    off = F.when(n > 0, F.get("_hit", F.lit(0))["off"]).otherwise(F.element_at(F.when(F.size(before) > 0, before), -1)["off"])
    utc = F.when(is_time, F.col("_local") - F.coalesce(fixed * 60_000_000, off))
    utc = F.coalesce(F.when(F.col("_p.kind") == "epoch", F.col("_p.epoch")), utc)
    p = p.withColumn("_utc", utc)
    ymd = [_pad(F.col("_p.y"), 4), _pad(F.col("_p.mo"), 2), _pad(F.col("_p.d"), 2)]
    kind = F.col("_p.kind")
    text = F.when(F.col("_utc").isNotNull(), utc_text(F.col("_utc"))).when(kind == "date", F.concat_ws("-", *ymd)).when(kind == "year", ymd[0]).when(kind == "month_day", F.concat_ws("-", *ymd[1:]))
    # Told from the parts, not from the text, so that a filter on it stays small when it is pushed down.
    resolved = F.col("_utc").isNotNull() | F.coalesce(kind.isin("date", "year", "month_day"), F.lit(False))
    how = F.when(~resolved, "unresolved").when(is_time & fixed.isNull() & (n > 1), "ambiguous").when(is_time & fixed.isNull() & (n == 0), "nonexistent").when(is_time | (kind == "epoch"), "exact").otherwise(kind)
    return p.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], text.alias(out), how.alias(status))
