"""Mixed timestamp notations, precisions and zones → one UTC instant.

Every notation is one branch of a single regex alternation with named groups. One
``regexp_replace`` pulls all components out in a single JVM-side match; calendar ranges are
then checked and the instant is put together with integer day arithmetic. No UDF, no shuffle.

Defined results
  null, empty, placeholder, impossible or unknown text   → null; years are 1 to 9999
  stored numbers                                         → the unit under which they fall in 1990 to 2099, else null
  all-number dates                                       → read by ``date_order`` ('MDY' or 'DMY');
                                                           null where it is null and both readings differ
  text without zone                                      → local time in ``time_zone``; null where that is null
  local time inside a spring-forward gap                 → null, no such instant existed
  local time inside a fall-back overlap                  → the earlier of the two instants
  missing seconds                                        → 0; digits finer than milliseconds are dropped
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import free_name

# Month names and their numbers.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
# Zone abbreviations and their offset in minutes.
ZONES = {"Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "IST": 330, "JST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
# Days before each month in a common year.
DAYS_IN_MONTH = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

#: Years by which the size of a stored number tells its unit.
EARLIEST, LATEST = 1990, 2100
# Calendar dates written where no date is known, as yyyymmdd.
PLACEHOLDERS = [10101, 19000101, 19700101, 99991231]

_MON = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_DAY = r"(?:(?:Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun)(?:[a-z]*),? +)?"
_ABBR = "|".join(sorted(ZONES, key=len, reverse=True))
_OFF = r"(?:(?:UTC|GMT) ?)?[+-]\d{2}:?\d{2}|(?:UTC|GMT) ?[+-]\d{1,2}"

#: One notation per line: y mo d = date, a b = all-number day and month in the board's order,
#: h mi s f = time, ap = AM or PM, z = zone, n = epoch number.
NOTATIONS = [
    r"<y>\d{4}-<mo>\d{2}-<d>\d{2}(?:[T ] ?<h>\d{2}:<mi>\d{2}(?::<s>\d{2}(?:[.,]<f>\d{1,9})?)?)? ?<z>ZONE?",
    r"<y>\d{4}<mo>\d{2}<d>\d{2}T<h>\d{2}<mi>\d{2}<s>(?:\d{2})? ?<z>ZONE?",
    r"<y>\d{4}/<mo>\d{2}/<d>\d{2}(?: <h>\d{1,2}:<mi>\d{2}(?::<s>\d{2})?)? ?<z>ZONE?",
    r"<a>\d{1,2}[/.-]<b>\d{1,2}[/.-]<y>\d{4}(?:,? <h>\d{1,2}:<mi>\d{2}(?::<s>\d{2})?(?: ?<ap>[AP]M)?)?(?: <z>ZONE)?",
    r"DAY<d>\d{1,2}(?:st|nd|rd|th)?[ -]<mo>MON[ -]<y>\d{4}(?:,? <h>\d{1,2}:<mi>\d{2}(?::<s>\d{2})?(?: ?<ap>[AP]M)?)?(?: <z>ZONE)?",
    r"DAY<mo>MON\.? <d>\d{1,2}(?:st|nd|rd|th)?,? <y>\d{4}(?:,? <h>\d{1,2}:<mi>\d{2}(?::<s>\d{2})?(?: ?<ap>[AP]M)?)?(?: <z>ZONE)?",
    r"<n>-?\d{1,19}",
]
PARTS = ["y", "mo", "d", "a", "b", "h", "mi", "s", "f", "ap", "z", "n"]


def alternation() -> tuple[str, str]:
    """The regex of all notations, and the replacement that lists the parts behind a \\x01 each."""
    names: dict[str, list[str]] = {p: [] for p in PARTS}
    branches, made = [], 0
    for i, notation in enumerate(NOTATIONS):
        out, rest = [], notation.replace("MON", _MON).replace("DAY", _DAY)
        while m := re.search(r"<([a-z]+)>", rest):
            out.append(rest[: m.start()])
            rest = rest[m.end() :]
            name = f"{m[1]}{i}"
            atom = re.match(r"ZONE\??|\[AP\]M|\(\?:.*?\)\??(?=[ T:]|\\d|$)|-\?\\d\{[\d,]+\}|\\d\{[\d,]+\}|\(\?:Jan.*?Dec\(\?:ember\)\?\)", rest)
            if m[1] == "mo" and rest.startswith("(?:Jan"):
                body = _MON
            elif rest.startswith("(?:\\d{2})?"):
                body = "(?:\\d{2})?"
            else:
                body = atom[0]
            rest = rest[len(body) :]
            group = body.replace("ZONE?", f"(?:{_OFF}|{_ABBR})?").replace("ZONE", f"(?:{_OFF}|{_ABBR})")
            out.append(f"(?<{name}>{group})")
            made += 1
            names[m[1]].append(f"${made}")  # the number of the named group just made; found faster than its name
        branches.append("".join(out) + rest)
    return f"(?i)^\\s*(?:{'|'.join(branches)})\\s*$", "".join("\x01" + "".join(v) for v in names.values())


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integers only."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mp = F.pmod(m + 9, F.lit(12))
    doy = F.floor((mp * 153 + 2) / F.lit(5)) + d - 1
    era_days = yy * 365 + F.floor(yy / F.lit(4)) - F.floor(yy / F.lit(100)) + F.floor(yy / F.lit(400))
    return era_days.cast("bigint") + doy - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    base = F.element_at(F.array(*map(F.lit, DAYS_IN_MONTH)), F.when(m.between(1, 12), m).otherwise(1).cast("int"))
    return base + F.when((m == 2) & leap, 1).otherwise(0)


def epoch_number_ms(n: Column) -> Column:
    """A stored number: s, ms, µs or ns since 1970, told apart by size; null for placeholders such as 0 and -1."""
    n, v = n.cast("bigint"), F.lit(None).cast("bigint")
    low, high = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (EARLIEST, LATEST))
    for scale in (1, 10**3, 10**6, 10**9):
        ms = n * (1000 // scale) if scale <= 1000 else (n - F.pmod(n, F.lit(scale // 1000))).cast("decimal(20,0)") / F.lit(scale // 1000)
        v = F.when((n >= F.lit(low * scale)) & (n < F.lit(high * scale)), ms.cast("bigint")).otherwise(v)
    return v


def parts_of(text: Column) -> Column:
    """array<string>: at i + 1 is PARTS[i], empty where the notation lacks it. One element only where no notation matches."""
    pattern, replacement = alternation()
    one = lambda t: F.split(F.regexp_replace(F.replace(t, F.lit("\x01"), F.lit("?")), F.lit(pattern), F.lit(replacement)), "\x01", -1)
    return F.transform(F.array(text), one)[0]  # a lambda ends the whole-stage method, which else outgrows 64 KB


def number(digits: Column, kind: str) -> Column:
    """A cast that meets no empty text: failing casts are slow, as each throws."""
    return F.nullif(digits, F.lit("")).try_cast(kind)


def offset_minutes(z: Column) -> Column:
    """+05:30, -0400, UTC+2 or an abbreviation → minutes; null if there is none or it is out of range."""
    digits = F.regexp_replace(z, "[^0-9]", "")
    hhmm = number(digits, "int") * F.when(F.length(digits) > 2, 1).otherwise(100)
    numeric = F.when((hhmm <= 1400) & (hhmm % 100 < 60), F.when(z.contains("-"), -1).otherwise(1) * (F.floor(hhmm / 100) * 60 + hhmm % 100))
    named = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    return F.coalesce(numeric, F.transform(F.array(F.upper(z)), lambda k: F.element_at(named, k))[0])


def with_instant(df: DataFrame, text: str, out: str, time_zone: str | None = None, date_order: str | None = None) -> DataFrame:
    """df with the bigint column ``out``: milliseconds since 1970 UTC of the notation in column ``text``.

    Done in steps, so that each intermediate value is computed once; their names avoid df's own.
    """
    names = [*PARTS, "parts", "zone", "order", "month", "day", "hour", "ok", "seconds", "zoned"]
    tmp = {n: free_name(df, f"_i_{n}") for n in names}
    c = {n: F.col(f"`{v}`") for n, v in tmp.items()}
    at = lambda **kw: {tmp[k]: v for k, v in kw.items()}
    none = F.lit(None).cast("string")
    month_names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    df = df.withColumns(at(parts=parts_of(F.col(f"`{text}`")), zone=F.col(f"`{time_zone}`") if time_zone else none, order=F.col(f"`{date_order}`") if date_order else none))
    part = lambda n: F.get(c["parts"], PARTS.index(n) + 1)
    df = df.withColumns(at(**{n: part(n) if n in ("mo", "ap", "z", "f") else number(part(n), "int" if n != "n" else "bigint") for n in PARTS}))
    month = F.when(c["mo"] < ":", number(c["mo"], "int")).otherwise(F.element_at(month_names, F.lower(F.left(c["mo"], F.lit(3)))))
    by_order = lambda mdy, dmy: F.when((c["a"] == c["b"]) | (c["order"] == "MDY"), mdy).when(c["order"] == "DMY", dmy)
    pm = F.when(F.upper(c["ap"]) == "PM", 12).otherwise(0)
    df = df.withColumns(at(
        month=F.when(c["a"].isNull(), month).otherwise(by_order(c["a"], c["b"])), day=F.when(c["a"].isNull(), c["d"]).otherwise(by_order(c["b"], c["a"])),
        hour=F.when(c["h"].isNull(), 0).when(c["ap"] == "", F.when(c["h"] < 24, c["h"])).when(c["h"].between(1, 12), c["h"] % 12 + pm), mi=F.coalesce(c["mi"], F.lit(0)), s=F.coalesce(c["s"], F.lit(0)),
    ))
    stand_in = (c["y"] * 10000 + c["month"] * 100 + c["day"]).isin(PLACEHOLDERS)
    ok = (c["y"] >= 1) & ~stand_in & c["month"].between(1, 12) & (c["day"] >= 1) & (c["day"] <= days_in_month(c["y"], c["month"])) & c["hour"].isNotNull() & (c["mi"] < 60) & (c["s"] < 60)
    df = df.withColumns(at(seconds=F.when(ok, days_from_civil(c["y"], c["month"], c["day"]) * 86400 + c["hour"] * 3600 + c["mi"] * 60 + c["s"])))
    df = df.withColumns(at(zoned=F.when(c["z"] == "", F.to_utc_timestamp(F.timestamp_seconds(c["seconds"]), c["zone"]))))
    exists = F.from_utc_timestamp(c["zoned"], c["zone"]) == F.timestamp_seconds(c["seconds"])
    utc = F.when(c["z"] != "", c["seconds"] - offset_minutes(c["z"]) * 60).when(exists, F.unix_seconds(c["zoned"]))
    ms = F.rpad(F.left(c["f"], F.lit(3)), 3, "0").cast("bigint")
    df = df.withColumn(out, F.when(c["n"].isNotNull(), epoch_number_ms(c["n"])).otherwise(utc * 1000 + ms))
    return df.drop(*tmp.values())
