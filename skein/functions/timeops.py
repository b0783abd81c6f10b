"""Datetimes and intervals. An interval is a struct of whole fields; months come first, then weeks and days, then the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("year", "month", "week", "day", "hour", "min", "sec", "nsec")


def interval(**fields: int) -> Column:
    """An interval of literals; fields that aren't given are 0."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"no such interval field: {', '.join(sorted(unknown))}")
    return F.struct(*[F.lit(fields.get(f, 0)).cast("long").alias(f) for f in FIELDS])


def add_intervals(a: Column, b: Column, sign: int = 1) -> Column:
    return F.struct(*[(a[f] + sign * b[f]).alias(f) for f in FIELDS])


def add(ts: Column, i: Column, adjust: str = "none", sign: int = 1) -> Column:
    """ts plus (sign -1: minus) an interval. adjust: 'none' keeps the day or takes the month's last; 'last' goes from a month's last day to the last day;
    'excess' lets a day that the month lacks run on into the next."""
    months = (sign * (i["year"] * 12 + i["month"])).cast("int")
    day, clock = F.to_date(ts), F.unix_micros(ts) - F.unix_micros(F.to_date(ts).cast("timestamp"))
    moved = F.add_months(day, months)
    if adjust == "last":
        moved = F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)
    elif adjust == "excess":
        moved = F.date_add(F.trunc(moved, "month"), F.dayofmonth(day) - 1)
    elif adjust != "none":
        raise ValueError(f"no such adjustment: {adjust}")
    days = F.date_add(moved, (sign * (i["week"] * 7 + i["day"])).cast("int"))
    micros = sign * ((i["hour"] * 3600 + i["min"] * 60 + i["sec"]) * 1_000_000 + F.floor(i["nsec"] / 1000))
    return F.timestamp_micros(F.unix_micros(days.cast("timestamp")) + clock + micros)


def subtract(a: Column, b: Column) -> Column:
    """a - b as an interval of seconds and nanoseconds."""
    micros = F.unix_micros(a) - F.unix_micros(b)
    sec = F.when(micros >= 0, F.floor(micros / 1_000_000)).otherwise(F.ceil(micros / 1_000_000)).cast("long")
    zero = F.lit(0).cast("long")
    return F.struct(*[(sec if f == "sec" else (micros - sec * 1_000_000) * 1000 if f == "nsec" else zero).alias(f) for f in FIELDS])


def parts(ts: Column) -> list[Column]:
    """The parts of a datetime as columns."""
    return [
        F.year(ts).alias("year"), F.quarter(ts).alias("quarter"), F.month(ts).alias("month"), F.weekofyear(ts).alias("week"), F.dayofmonth(ts).alias("day"),
        (F.dayofweek(ts) - 1).alias("dow"), F.dayofyear(ts).alias("doy"), F.hour(ts).alias("hour"), F.minute(ts).alias("min"), F.second(ts).alias("sec"), F.unix_timestamp(ts).alias("epoch"),
    ]


#: strftime codes and Spark's patterns.
CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "p": "a", "I": "hh", "f": "SSSSSS", "z": "xx"}


def pattern(codes: str) -> str:
    """Spark's pattern for a strftime format."""
    out, plain, i = "", "", 0
    while i < len(codes) + 1:
        c = codes[i : i + 1]
        if c == "%" or not c:
            out += "'" + plain.replace("'", "''") + "'" if plain else ""
            plain = ""
            if c:
                if codes[i + 1] == "%":
                    plain = "%"
                else:
                    out += CODES[codes[i + 1]]
                i += 1
        else:
            plain += c
        i += 1
    return out


def strftime(ts: Column, codes: str) -> Column:
    return F.date_format(ts, pattern(codes))


def strptime(s: Column, codes: str) -> Column:
    return F.to_timestamp(s, pattern(codes))
