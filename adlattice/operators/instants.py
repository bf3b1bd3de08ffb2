"""Mixed timestamp notations and zones to one instant in UTC (problem 3).

Every notation is a branch of ONE regular expression; components are extracted once per value in Arrow
batches, calendar ranges are checked, and the wall time becomes seconds by integer day arithmetic. Zone
rules are applied by the JVM afterwards: a repeated wall time means its first instant, a skipped one
moves forward by the gap.

Defined results: NULL, empty or unknown texts, impossible dates, unknown zone words and open or numberless
distances give NULL, and ``unread`` reports each of them with its reason; texts of any length are read whole, outer blanks do
not count. A value without zone on a board without clock gives NULL. Repeated rows give
repeated results; extra columns of the input are kept, columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Zone abbreviations with their distance from UTC in minutes, and month names.
ZONES = {"z": 0, "utc": 0, "gmt": 0, "hkt": 480, "sgt": 480, "jst": 540, "bst": 60, "wet": 0, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
         "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "mo": 30 * 86400}

_TIME = r"(?P<{0}h>\d{{1,2}}):(?P<{0}mi>\d{{2}})(?::(?P<{0}s>\d{{2}})(?:[.,]\d+)?)?"
_ZONE = r"(?P<{0}z>z|[+-]\d{{2}}:?\d{{2}}|[+-]\d{{2}}|(?:utc|gmt)(?:[+-]\d{{1,2}}(?::?\d{{2}})?)?|[a-z]{{2,4}})"
_MON = r"(?P<{0}mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"


def _b(p: str, body: str) -> str:
    return body.replace("TIME", _TIME.format(p)).replace("ZONE", _ZONE.format(p)).replace("MON", _MON.format(p)).replace("P_", p)


#: prefix of the group names of each branch -> pattern; the prefix tells which branch matched.
BRANCHES = {
    "i": _b("i", r"(?P<P_y>\d{4})-(?P<P_m>\d{1,2})-(?P<P_d>\d{1,2})(?:(?:t|\s+)TIME\s*(?:ZONE)?)?"),
    "c": _b("c", r"(?P<P_y>\d{4})(?P<P_m>\d{2})(?P<P_d>\d{2})(?:t(?P<P_h>\d{2})(?P<P_mi>\d{2})(?P<P_s>\d{2})?(?:[.,]\d+)?\s*(?:ZONE)?)?"),
    "e": r"(?P<ee>-?\d{9,10})(?P<ems>\d{3})?",
    "s": _b("s", r"(?P<P_a>\d{1,2})/(?P<P_b>\d{1,2})/(?P<P_y>\d{4})(?:,?\s+TIME\s*(?P<P_ap>[ap]\.?m\.?)?\s*(?:ZONE)?)?"),
    "p": _b("p", r"(?P<P_d>\d{1,2})\.(?P<P_m>\d{1,2})\.(?P<P_y>\d{4})(?:,?\s+TIME\s*(?:ZONE)?)?"),
    "n": _b("n", r"MON\s+(?P<P_d>\d{1,2}),?\s+(?P<P_y>\d{4})(?:,?\s+TIME\s*(?P<P_ap>[ap]\.?m\.?)?\s*(?:ZONE)?)?"),
    "r": _b("r", r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(?P<P_d>\d{1,2})\s+MON\s+(?P<P_y>\d{4})(?:,?\s+TIME\s*(?P<P_ap>[ap]\.?m\.?)?\s*(?:ZONE)?)?"),
    "k": _b("k", r"(?P<P_y>\d{4})年\s*(?P<P_m>\d{1,2})月\s*(?P<P_d>\d{1,2})日(?:\s*TIME\s*(?:ZONE)?)?"),
    "g": r"(?:posted\s+)?(?P<gn>\d{1,4})\s*(?P<gu>mo(?:nth)?s?|m(?:in(?:ute)?s?)?|h(?:(?:ou)?rs?)?|d(?:ays?)?|w(?:(?:ee)?ks?)?)\s+ago",
}
PATTERN = re.compile("(?:" + "|".join(f"(?P<{k}_>{v})" for k, v in BRANCHES.items()) + ")")
# Each group name resolves to its index once, so that a match is read by position.
_SLOTS = {k: {g[len(k):]: i for g, i in PATTERN.groupindex.items() if g.startswith(k) and g != f"{k}_"} for k in BRANCHES}
_BRANCH_AT = {PATTERN.groupindex[f"{k}_"]: k for k in BRANCHES}


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integer arithmetic only."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _month_days(y: int, m: int) -> int:
    return 29 if m == 2 and (y % 4 == 0 and y % 100 != 0 or y % 400 == 0) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def _offset(z: str) -> int | None:
    """Minutes east of UTC of a written zone; None if it is unknown."""
    if z in ZONES:
        return ZONES[z]
    m = re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", z)
    if not m or int(m[2]) > 18 or int(m[3] or 0) > 59:
        return None
    return (-1 if m[1] == "-" else 1) * (int(m[2]) * 60 + int(m[3] or 0))


Part = tuple[str | None, int | None, int | None]
NOTHING: Part = (None, None, None)


def read_instant(text: str | None, day_first: bool | None) -> Part:
    """``(kind, seconds, offset minutes)``: kind 'utc' (an instant), 'wall' (needs the board's clock) or 'back' (a distance)."""
    m = PATTERN.fullmatch(text.strip().lower()) if text else None
    if m is None:
        return NOTHING
    branch = next(k for i, k in _BRANCH_AT.items() if m.start(i) >= 0)
    slots = _SLOTS[branch]
    get = lambda n: m[slots[n]] if n in slots else None
    if branch == "e":
        return "utc", int(get("e")), 0
    if branch == "g":
        u = get("u")
        unit = "mo" if u.startswith("mo") else u[0]
        return "back", int(get("n")) * UNIT_SECONDS[unit], None
    y = int(get("y"))
    if branch == "s":
        if day_first is None:
            return NOTHING
        a, b = int(get("a")), int(get("b"))
        mo, d = (b, a) if day_first else (a, b)
    else:
        mo, d = MONTHS[get("mon")] if "mon" in slots else int(get("m")), int(get("d"))
    if not (1 <= y and 1 <= mo <= 12 and 1 <= d <= _month_days(y, mo)):
        return NOTHING
    h, mi, s = int(get("h") or 0), int(get("mi") or 0), int(get("s") or 0)
    half = get("ap")
    if half:
        if not 1 <= h <= 12:
            return NOTHING
        h = h % 12 + 12 * (half[0] == "p")
    if h > 23 or mi > 59 or s > 59:
        return NOTHING
    wall = days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + s
    if get("z"):
        off = _offset(get("z"))
        return ("utc", wall - off * 60, off) if off is not None else NOTHING
    return "wall", wall, None


_OPEN = re.compile(r"\b(?:ago|over|more than)\b|\+")


def why_not(text: str | None, day_first: bool | None) -> str | None:
    """Why a value fixes no instant by itself; None if it does, or if it needs only a clock or the instant it counts from."""
    told = (text or "").strip().lower()
    if not told:
        return "blank"
    if read_instant(text, day_first)[0] is not None:
        return None
    m = PATTERN.fullmatch(told)
    if m is None:
        return "open distance" if _OPEN.search(told) else "unknown notation"
    if m["s_"] and day_first is None:
        return "no order of day and month"
    zone = next((m[i] for name, i in PATTERN.groupindex.items() if name.endswith("z") and m[i]), None)
    return "unknown zone" if zone and _offset(zone) is None else "impossible date or time"


_PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("s", T.LongType())])


@F.pandas_udf(_PART)
def _read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, first in batches:
        found = [read_instant(t, None if f is None or f != f else bool(f))[:2] for t, f in zip(text, first, strict=True)]
        kinds, secs = zip(*found, strict=True) if found else ((), ())
        yield pd.DataFrame({"kind": pd.Series(kinds, dtype=object), "s": pd.array(secs, dtype="Int64")})


def board_key(c: Column) -> Column:
    """A board label without case, blanks and punctuation."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")


def board_clocks(platforms: DataFrame, clocks: DataFrame) -> DataFrame:
    """``(_board, _zone, _day_first)`` for the fixed list of boards."""
    return platforms.join(clocks, platforms["id"] == clocks["source_id"]).select(board_key(F.col("name")).alias("_board"), F.col("zone").alias("_zone"), F.col("day_first").alias("_day_first")).dropDuplicates(["_board"])


def _absolute(part: Column, zone: Column) -> Column:
    """Seconds of an instant; a wall time goes through the zone's rules in the JVM."""
    by_clock = F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(part["s"]), zone))
    return F.when(part["kind"] == "utc", part["s"]).when((part["kind"] == "wall") & zone.isNotNull(), by_clock)


def normalise(df: DataFrame, clocks: DataFrame, posted: str = "date_posted", scraped: str = "date_scraped", source: str = "source") -> DataFrame:
    """Adds ``posted_s`` and ``scraped_s``, seconds since 1970 UTC (fractions cut), NULL where no instant is fixed.

    ``clocks`` comes from :func:`board_clocks`, a fixed list of boards, hence the broadcast.
    """
    known = df.drop("posted_s", "scraped_s").withColumn("_board", board_key(F.col(source))).join(F.broadcast(clocks), "_board", "left")
    parts = known.withColumn("_p", _read(F.col(posted), F.col("_day_first"))).withColumn("_s", _read(F.col(scraped), F.col("_day_first")))
    at = parts.withColumn("scraped_s", _absolute(F.col("_s"), F.col("_zone")))
    distance = F.when(F.col("_p.kind") == "back", F.col("scraped_s") - F.col("_p.s"))
    return at.withColumn("posted_s", F.coalesce(_absolute(F.col("_p"), F.col("_zone")), distance)).drop("_board", "_zone", "_day_first", "_p", "_s")


def found(df: DataFrame, clocks: DataFrame) -> DataFrame:
    """One row ``(internal_id, field, epoch_s)`` for each value that fixes an instant."""
    base = normalise(df.select("internal_id", "source", "date_posted", "date_scraped"), clocks)
    both = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("epoch_s")) for n, c in (("date_posted", "posted_s"), ("date_scraped", "scraped_s"))])
    return base.select("internal_id", F.inline(both)).filter(F.col("epoch_s").isNotNull())


@F.pandas_udf(T.StringType())
def _why(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, first in batches:
        yield pd.Series([why_not(t, None if f is None or f != f else bool(f)) for t, f in zip(text, first, strict=True)], dtype=object)


def unread(df: DataFrame, clocks: DataFrame) -> DataFrame:
    """``(internal_id, field, value, reason)`` of each value that is not NULL and fixes no instant."""
    base = normalise(df.select("internal_id", "source", "date_posted", "date_scraped"), clocks)
    known = base.withColumn("_board", board_key(F.col("source"))).join(F.broadcast(clocks), "_board", "left")
    both = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.col(c).alias("at")) for n, c in (("date_posted", "posted_s"), ("date_scraped", "scraped_s"))])
    rows = known.select("internal_id", "_day_first", F.inline(both)).filter("value IS NOT NULL AND at IS NULL")
    return rows.select("internal_id", "field", "value", F.coalesce(_why(F.col("value"), F.col("_day_first")), F.lit("no clock, or nothing to count from")).alias("reason"))
