"""Times in mixed formats and zones to one unambiguous form.

Method: a value is reduced to a character-class *shape mask* (every digit ``9``, every
run of letters ``A``, blanks collapsed). Each distinct mask is mapped once to a parser,
which is no code but a slot layout: which digit run holds the year, which letter run the
month, and so on. The layouts form a small table, made from the grammar below and joined
by broadcast (its size is fixed by the grammar, not by the data). All conversion is then
plain column arithmetic, and civil times go through zone transition tables keyed by
(zone, year), built from the IANA release named by :func:`zone_version`.
"""

from __future__ import annotations

import datetime as dt
import importlib.resources
import itertools
import re
import zoneinfo
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTC_FORM = "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Years covered by the transition tables; outside, the nearest year's rule holds.
YEARS = (1970, 2069)

# English month abbreviations.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Minutes east of UTC of the zone abbreviations that news wires write.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Abbreviations that mean the civil time of a zone, whatever the season.
CIVIL = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}

_FIELDS = ("y", "mo", "d", "h", "mi", "s", "oh", "om")
_SLOT = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("n", T.IntegerType())])
LAYOUT = T.StructType(
    [T.StructField("mask", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("slash", T.BooleanType()),
     T.StructField("sign", T.IntegerType()), T.StructField("mon", T.IntegerType()), T.StructField("ampm", T.IntegerType()),
     T.StructField("zone", T.IntegerType())] 
    + [T.StructField(f, _SLOT) for f in _FIELDS]
)


def mask_of(value: Column) -> Column:
    """Shape mask of a cleaned value: ``9`` for one or two digits, one ``9`` per digit of
    longer runs, ``#`` for a mark of the half-day, ``A`` for any other run of letters."""
    m = F.regexp_replace(value, r"(?<=\d) ?[AP]\.?M\b\.?", " #")
    m = F.regexp_replace(m, "[A-Z]+", "A")
    m = F.regexp_replace(m, r"(?<!\d)\d\d?(?!\d)", "9")
    m = F.translate(m, "012345678", "9" * 9)
    # most values have the plain form already: no need to run four expressions over them
    return F.when(value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.lit("9999-9-9A9:9:9A")).otherwise(m)


def clean(value: Column) -> Column:
    """Trimmed, upper case, blanks collapsed, typed minus signs, no fractions of seconds."""
    plain = value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")
    v = F.upper(F.trim(F.regexp_replace(value, r"[\s\u00a0\u202f]+", " ")))
    v = F.translate(v, "−‐‑", "---")
    return F.when(plain, value).otherwise(F.regexp_replace(v, r"(:\d\d)[.,]\d{1,9}", "$1"))


def _dates() -> list[tuple[str, dict]]:
    """(mask, layout) of the date part. Digit runs are counted from 1 within the part."""
    out: list[tuple[str, dict]] = [
        ("9999-9-9", {"y": (1, 1, 4), "mo": (2, 1, 2), "d": (3, 1, 2)}),
        ("9999/9/9", {"y": (1, 1, 4), "mo": (2, 1, 2), "d": (3, 1, 2)}),
        ("99999999", {"y": (1, 1, 4), "mo": (1, 5, 2), "d": (1, 7, 2)}),
        ("9999-999", {"y": (1, 1, 4), "d": (2, 1, 3), "kind": "ordinal"}),
        ("9999-A9-9", {"y": (1, 1, 4), "mo": (2, 1, 2), "d": (3, 1, 1), "kind": "week"}),
        ("9999A9-9", {"y": (1, 1, 4), "mo": (2, 1, 2), "d": (3, 1, 1), "kind": "week"}),
    ]
    for y in ("9999", "9"):
        name, yy = {"mon": 1, "d": (1, 1, 2), "y": (2, 1, 4), "letters": 1}, (3, 1, 4)
        out += [(m, name) for m in (f"A 9, {y}", f"A 9 {y}", f"9 A {y}", f"9-A-{y}")]
        out += [(m, name | {"mon": 2, "letters": 2}) for m in (f"A 9 A {y}", f"A, 9 A {y}")]
        out.append((f"A, A 9, {y}", name | {"mon": 2, "letters": 2}))
        out.append((f"9/9/{y}", {"mo": (1, 1, 2), "d": (2, 1, 2), "y": yy, "slash": True}))
    return out


def _times() -> list[tuple[str, dict]]:
    return [
        ("9:9", {"h": (1, 1, 2), "mi": (2, 1, 2), "runs": 2}),
        ("9:9:9", {"h": (1, 1, 2), "mi": (2, 1, 2), "s": (3, 1, 2), "runs": 3}),
        ("999999", {"h": (1, 1, 2), "mi": (1, 3, 2), "s": (1, 5, 2), "runs": 1}),
        ("9999", {"h": (1, 1, 2), "mi": (1, 3, 2), "runs": 1}),
    ]


def _zones(compact: bool) -> list[tuple[str, dict]]:
    out: list[tuple[str, dict]] = [("", {}), ("A", {"zone": 1}), (" A", {"zone": 1})]
    for sign, s in (("+", 1), ("-", -1)):
        for gap in ("", " "):
            out += [(f"{gap}{sign}9:9", {"sign": s, "oh": (1, 1, 2), "om": (2, 1, 2)}), (f"{gap}{sign}9999", {"sign": s, "oh": (1, 1, 2), "om": (1, 3, 2)}), (f"{gap}{sign}9", {"sign": s, "oh": (1, 1, 2)})]
    return out[:2] if compact else out


@lru_cache(1)
def layouts() -> list[tuple]:
    """Rows of the mask table: one parser for each mask of the grammar."""
    rows: dict[str, dict] = {
        "9" * n: {"kind": k} for n, k in ((9, "epoch_s"), (10, "epoch_s"), (13, "epoch_ms"), (16, "epoch_us"), (19, "epoch_ns"))
    }
    for dmask, dl in _dates():
        runs = len(re.findall(r"9+", dmask))
        rows.setdefault(dmask, dl)
        if dl.get("kind"):
            continue
        for (tmask, tl), (sep, seps), half in itertools.product(_times(), (("A", 1), (" ", 0), (", ", 0)), (False, True)):
            solid = ":" not in tmask
            iso = dmask in ("9999-9-9", "99999999")
            if solid != (dmask == "99999999") or (sep == "A" and not iso) or (solid and sep != "A") or (half and sep == "A"):
                continue
            for zmask, zl in _zones(solid):
                if zmask == "A" and sep != "A":
                    continue
                row = {k: v for k, v in dl.items() if k != "letters"} | {"sign": zl.get("sign")}
                row |= {k: (tl[k][0] + runs, *tl[k][1:]) for k in ("h", "mi", "s") if k in tl}
                row |= {k: (zl[k][0] + runs + tl["runs"], *zl[k][1:]) for k in ("oh", "om") if k in zl}
                at = dl.get("letters", 0) + seps
                if half:
                    at += 1
                    row["ampm"] = at
                if zl.get("zone"):
                    row["zone"] = at + 1
                rows.setdefault(dmask + sep + tmask + (" #" if half else "") + zmask, row)
    return [(m, r.get("kind", "civil"), r.get("slash", False), r.get("sign"), r.get("mon"), r.get("ampm"), r.get("zone"), *(r.get(f) for f in _FIELDS)) for m, r in rows.items()]


_TABLES: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of fixed content, made once a session."""
    key = (spark.sparkContext.applicationId, id(spark), *name)
    if key not in _TABLES:
        _TABLES[key] = make()
    return _TABLES[key]


def mask_table(spark: SparkSession) -> DataFrame:
    return _once(spark, ("masks",), lambda: spark.createDataFrame(layouts(), LAYOUT))


def unknown_masks(df: DataFrame, column: str) -> DataFrame:
    """(mask, n, example) of values, neither null nor blank, whose shape has no parser; the most
    frequent first. What is counted here comes out of ``normalise`` as null."""
    d = df.select(F.col(column).cast("string").alias("raw")).where(F.trim("raw") != "").withColumn("m", mask_of(clean(F.col("raw"))))
    d = d.join(F.broadcast(mask_table(df.sparkSession).select("mask")), F.col("m") == F.col("mask"), "left_anti")
    return d.groupBy(F.col("m").alias("mask")).agg(F.count("*").alias("n"), F.min("raw").alias("example")).orderBy(F.desc("n"), "mask")


def _release() -> Path | None:
    """Folder of the release that the tables are made from: the wheel's, or None for this machine's."""
    try:
        return Path(str(importlib.resources.files("tzdata.zoneinfo")))
    except ModuleNotFoundError:
        return None


def zone_version() -> str:
    """IANA release behind the transition tables: the one they are really read from. They are
    made on the driver and sent along, so executors' own releases don't matter."""
    if _release():
        import tzdata

        return tzdata.IANA_VERSION
    for folder in map(Path, zoneinfo.TZPATH):
        if (folder / "tzdata.zi").exists():
            return (folder / "tzdata.zi").open().readline().split()[-1]
    return "unknown"


def _zone(name: str) -> ZoneInfo:
    base = _release()
    if base is None:
        return ZoneInfo(name)
    try:
        with (base / name).open("rb") as f:
            return ZoneInfo.from_file(f, key=name)
    except (FileNotFoundError, IsADirectoryError) as e:
        raise zoneinfo.ZoneInfoNotFoundError(f"no zone {name} in release {zone_version()}") from e


def _offset(zone: ZoneInfo, t: int) -> int:
    return int(dt.datetime.fromtimestamp(t, zone).utcoffset().total_seconds())


@lru_cache(None)
def transitions(name: str) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """(zone, year, [(civil second from which it holds, offset)]) of each year.

    Of a civil time that occurs twice the first is meant, and one that is skipped is
    read with the offset before the gap: a segment begins at the transition in the
    larger of both offsets.
    """
    zone = _zone(name)
    first = int(dt.datetime(YEARS[0], 1, 1, tzinfo=dt.timezone.utc).timestamp()) - 86400 * 3
    last = int(dt.datetime(YEARS[1] + 1, 1, 1, tzinfo=dt.timezone.utc).timestamp()) + 86400 * 3
    step, changes, before = 86400 * 4, [], _offset(zone, first)
    start = [(-(10**15), before)]
    for t in range(first, last, step):
        after = _offset(zone, t + step)
        if after != before:
            lo, hi = t, t + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == before else (lo, mid)
            changes.append((hi + max(before, after), after))
            before = after
    out = []
    for year in range(YEARS[0], YEARS[1] + 1):
        a = int(dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc).timestamp())
        b = int(dt.datetime(year + 1, 1, 1, tzinfo=dt.timezone.utc).timestamp())
        held = [c for c in start + changes if c[0] <= a][-1:]
        out.append((name, year, held + [c for c in changes if a < c[0] < b]))
    return out


ZONE_ROW = T.StructType(
    [T.StructField("tz_zone", T.StringType()), T.StructField("tz_year", T.IntegerType()),
     T.StructField("tz_segments", T.ArrayType(T.StructType([T.StructField("since", T.LongType()), T.StructField("offset", T.IntegerType())])))]
)


def zone_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    """Transition table of the given zones: at most ~600 IANA names times 100 years."""
    names = tuple(sorted({*zones, *CIVIL.values()}))
    return _once(spark, ("zones", *names), lambda: spark.createDataFrame([r for z in names for r in transitions(z)], ZONE_ROW))


def _get(slot: str) -> Column:
    return F.expr(f"try_cast(substring(try_element_at(_digits, _p.{slot}.g), _p.{slot}.p, _p.{slot}.n) AS INT)")


def normalise(
    df: DataFrame,
    column: str,
    *,
    zone: str | Column | None = "America/New_York",
    zones: list[str] | None = None,
    day_first: Column | None = None,
    out: str = "epoch_s",
    local_date: str | None = None,
    date_zone: str = "America/New_York",
) -> DataFrame:
    """Adds ``out``: seconds since 1970 UTC of a value in any known shape, else null.

    zone: the zone (name or column) of values that state none; a null zone leaves such
    values null. zones: all names the column may hold. day_first: condition under which
    ``a/b/c`` is day, month, year. local_date: name of a further date column; values
    without zone give the date as written, instants their date in ``date_zone``.

    Null, empty, zero and wordy values, impossible dates and unknown shapes give null.
    A civil time that occurs twice means the first; one that is skipped is read with the
    offset before the change. Fractions of seconds are dropped. Input columns are kept
    whatever their names, except ones called like the outputs, which are replaced.
    """
    spark = df.sparkSession
    keep = df.columns
    zone_col = F.lit(zone) if isinstance(zone, str) or zone is None else zone
    names = sorted({*(zones or []), *([zone] if isinstance(zone, str) else []), date_zone})
    # the input travels as one struct, so none of its columns can clash with helpers
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")
    swap_if = F.coalesce(day_first, F.lit(False)) if day_first is not None else F.lit(False)
    d = df.select(row, F.col(f"`{column}`").cast("string").alias("_raw"), zone_col.cast("string").alias("_fallback"), swap_if.alias("_dayfirst"))
    d = d.withColumn("_v", clean(F.col("_raw"))).withColumn("_mask", mask_of(F.col("_v")))
    table = mask_table(spark).select("mask", F.struct(*[c for c in LAYOUT.fieldNames() if c != "mask"]).alias("_p"))
    d = d.join(F.broadcast(table), F.col("_mask") == F.col("mask"), "left").drop("mask")
    some = F.col("_p").isNotNull()
    d = d.withColumn("_digits", F.when(some, F.regexp_extract_all("_v", F.lit(r"(\d+)"), 1)))
    d = d.withColumn("_letters", F.when(some, F.regexp_extract_all("_v", F.lit(r"([A-Z]+)"), 1)))
    d = d.withColumns({f"_{f}": _get(f) for f in _FIELDS})
    word = lambda slot: F.expr(f"try_element_at(_letters, _p.{slot})")
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    abbr = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    civil = F.create_map(*[F.lit(x) for k, v in CIVIL.items() for x in (k, v)])
    d = d.withColumn("_w", word("zone")).withColumn("_ap", word("ampm")).withColumn("_mon", F.try_element_at(months, F.substring(word("mon"), 1, 3)))
    d = d.withColumn("_y4", F.when(F.col("_y") < 100, F.col("_y") + 2000).otherwise(F.col("_y")))
    swap = F.col("_p.slash") & F.col("_dayfirst")
    kind = F.col("_p.kind")
    civil_date = F.expr("try_make_timestamp_ntz(_y4, _m4, _d4, 0, 0, 0)")
    d = d.withColumn("_m4", F.when(F.col("_p.mon").isNotNull(), F.col("_mon")).when(swap, F.col("_d")).otherwise(F.col("_mo")))
    d = d.withColumn("_d4", F.when(swap, F.col("_mo")).otherwise(F.col("_d")))
    plain = F.when(kind == "civil", F.to_date(civil_date))
    ordinal = F.when((kind == "ordinal") & F.col("_d").between(1, 366), F.date_add(F.expr("try_make_timestamp_ntz(_y4, 1, 1, 0, 0, 0)").cast("date"), F.col("_d") - 1))
    jan4 = F.expr("try_make_timestamp_ntz(_y4, 1, 4, 0, 0, 0)").cast("date")
    week = F.when((kind == "week") & F.col("_mo").between(1, 53) & F.col("_d").between(1, 7), F.date_add(jan4, F.col("_mo") * 7 - 7 + F.col("_d") - 1 - F.weekday(jan4)))
    d = d.withColumn("_date", F.coalesce(plain, ordinal, week))
    d = d.withColumn("_date", F.when(F.year("_date").between(1900, 2199) & (F.year("_date") == F.col("_y4")) | (kind == "week"), F.col("_date")))
    hour = F.when(F.col("_ap").isNull(), F.col("_h")).when(F.col("_ap").isin("AM", "PM") & F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap") == "PM", 12).otherwise(0))
    hour = F.when(F.col("_p.h").isNull(), F.lit(0)).otherwise(hour)
    minute = F.when(F.col("_p.mi").isNull(), F.lit(0)).otherwise(F.col("_mi"))
    second = F.when(F.col("_p.s").isNull(), F.lit(0)).otherwise(F.col("_s"))
    d = d.withColumn("_secs", F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60), hour * 3600 + minute * 60 + F.least(second, F.lit(59))))
    d = d.withColumn("_civil", F.unix_date("_date").cast("long") * 86400 + F.col("_secs"))
    stated = F.when(F.col("_p.sign").isNotNull(), F.col("_p.sign") * (F.col("_oh") * 3600 + F.coalesce(F.col("_om"), F.lit(0)) * 60))
    stated = F.coalesce(stated, F.try_element_at(abbr, F.col("_w")))
    d = d.withColumn("_stated", F.when(F.col("_p").isNotNull(), stated))
    d = d.withColumn("_tz", F.when(F.col("_p.zone").isNotNull(), F.try_element_at(civil, F.col("_w"))).when(F.col("_p.sign").isNull(), F.col("_fallback")))
    d = d.withColumn("_year", F.greatest(F.lit(YEARS[0]), F.least(F.lit(YEARS[1]), F.year("_date"))))
    zt = F.broadcast(zone_table(spark, names))
    d = d.withColumn("_key", F.when(F.col("_stated").isNull(), F.col("_tz")))
    d = d.join(zt, (F.col("_key") == F.col("tz_zone")) & (F.col("_year") == F.col("tz_year")), "left")
    seg = F.expr("try_element_at(filter(tz_segments, x -> x.since <= _civil), -1).offset")
    digits = F.expr("try_cast(_v AS DECIMAL(20,0))")
    per = F.when(kind == "epoch_s", F.lit(1)).when(kind == "epoch_ms", F.lit(1000)).when(kind == "epoch_us", F.lit(10**6)).when(kind == "epoch_ns", F.lit(10**9))
    epoch = F.when(kind.startswith("epoch") & (digits > 0), F.floor(digits / per).cast("long"))
    d = d.withColumn(out, F.coalesce(epoch, F.col("_civil") - F.coalesce(F.col("_stated"), seg)))
    made = [out]
    if local_date:
        made.append(local_date)
        said = kind.startswith("epoch") | F.col("_p.sign").isNotNull() | F.col("_p.zone").isNotNull()
        d = d.withColumn("_instant", F.when(said, F.col(out)))
        d = civil_from_epoch(d, "_instant", date_zone, "_zoned")
        d = d.withColumn(local_date, F.when(said, F.date_from_unix_date(F.floor(F.col("_zoned") / 86400).cast("int"))).when(F.col("_secs").isNotNull(), F.col("_date")))
    return d.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep if c not in made], *made)


def civil_from_epoch(df: DataFrame, column: str, zone: str, out: str) -> DataFrame:
    """Adds the civil second count of ``zone`` at an instant. Null stays null."""
    changes = [(-(10**15), _offset(_zone(zone), int(dt.datetime(YEARS[0], 1, 1, tzinfo=dt.timezone.utc).timestamp())))]
    seen = changes[0][1]
    for _, _, segs in transitions(zone):
        for since, off in segs:
            if off != seen:
                changes.append((since - max(off, seen), off))
                seen = off
    by_year: dict[int, list[tuple[int, int]]] = {}
    for year in range(YEARS[0], YEARS[1] + 1):
        a = int(dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc).timestamp())
        b = int(dt.datetime(year + 1, 1, 1, tzinfo=dt.timezone.utc).timestamp())
        by_year[year] = [c for c in changes if c[0] <= a][-1:] + [c for c in changes if a < c[0] < b]
    row = T.StructType([T.StructField("cz_year", T.IntegerType()), T.StructField("cz_segments", ZONE_ROW["tz_segments"].dataType)])
    t = _once(df.sparkSession, ("civil", zone), lambda: df.sparkSession.createDataFrame([(y, s) for y, s in by_year.items()], row))
    year = F.greatest(F.lit(YEARS[0]), F.least(F.lit(YEARS[1]), F.year(F.date_from_unix_date(F.floor(F.col(column) / 86400).cast("int")))))
    d = df.withColumn("_cz", year).join(F.broadcast(t), F.col("_cz") == F.col("cz_year"), "left")
    off = F.expr(f"try_element_at(filter(cz_segments, x -> x.since <= `{column}`), -1).offset")
    return d.withColumn(out, F.col(column) + off).drop("_cz", "cz_year", "cz_segments")


def utc_text(epoch: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of seconds since 1970; independent of the session's zone."""
    day, sec = F.floor(epoch / 86400).cast("int"), F.pmod(epoch, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec % 3600 / 60)), F.lit(":"), two(sec % 60), F.lit("Z"))
