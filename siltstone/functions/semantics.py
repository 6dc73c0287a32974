
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime directives and the letters of Spark's date_format.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "f": "SSSSSS"}


def date_pattern(directives: str) -> str:
    """A strftime format as a date_format pattern; literal letters are quoted."""
    out = []
    for directive, plain in re.findall(r"%(.)|([^%]+)", directives):
        if plain:
            out.append(re.sub(r"([A-Za-z]+)", r"'\1'", plain.replace("'", "''")))
        elif directive == "%":
            out.append("%")
        elif directive in DIRECTIVES:
            out.append(DIRECTIVES[directive])
        else:
            raise ValueError(f"strftime directive %{directive}")
    return "".join(out)


def divide(a: Column, b: Column) -> Column:
    """True division; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_divide(a: Column, b: Column) -> Column:
    """Truncates toward zero; NULL where b is 0."""
    return F.when(b != 0, (a - a % b) / b).cast("bigint")


def exact_sum(x: Column) -> Column:
    """SUM of integers without overflow."""
    return F.sum(x.cast("decimal(38,0)"))


def day_of_week(d: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(d) - 1).cast("bigint")


def iso_day_of_week(d: Column) -> Column:
    """Monday is 1."""
    return (F.weekday(d) + 1).cast("bigint")


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """Boundaries of the unit between a and b."""
    unit = unit.lower().rstrip("s")
    years = F.year(b) - F.year(a)
    if unit == "year":
        out = years
    elif unit == "quarter":
        out = years * 4 + F.quarter(b) - F.quarter(a)
    elif unit == "month":
        out = years * 12 + F.month(b) - F.month(a)
    elif unit == "week":
        out = F.datediff(F.date_trunc("week", b), F.date_trunc("week", a)) / 7
    elif unit == "day":
        out = F.datediff(b, a)
    else:
        seconds = {"hour": 3600, "minute": 60, "second": 1}[unit]
        out = F.floor(F.unix_seconds(b.cast("timestamp")) / seconds) - F.floor(F.unix_seconds(a.cast("timestamp")) / seconds)
    return out.cast("bigint")


def date_trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def strftime(ts: Column, directives: str) -> Column:
    return F.date_format(ts, date_pattern(directives))


def replacement(text: str, shift: int = 0) -> str:
    r"""A replacement with \N groups as one with $N groups."""
    out = re.sub(r"\$", r"\\$", re.sub(r"\\(?!\d)", r"\\\\", text))
    return re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + shift}", out)


def regexp_replace(s: Column, pattern: str, text: str, everywhere: bool = False) -> Column:
    """The first match only, unless everywhere."""
    if everywhere:
        return F.regexp_replace(s, pattern, replacement(text))
    return F.regexp_replace(s, first_match(pattern), "$1" + replacement(text, 1))


def first_match(pattern: str) -> str:
    r"""A pattern that matches once, at the start of the text, with what stands before the first match as group 1."""
    return rf"\A((?s:.*?))(?:{pattern})"


def string_agg_distinct(x: Column, separator: str = ",") -> Column:
    """The distinct values in their own order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(x)), lambda v: v.cast("string")), separator)


def mode(x: Column) -> Column:
    """The most frequent value; of equals the smallest."""
    return F.mode(x, True)
