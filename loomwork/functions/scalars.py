"""Column → Column functions; all stay built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_to(ts: Column, unit: str, week: str = "monday") -> Column:
    """Start of the hour (timestamp), or of the day, week or month (date)."""
    unit = unit.lower()
    if unit == "hour":
        return F.date_trunc("hour", ts)
    if unit == "day":
        return F.to_date(ts)
    if unit == "week" and week == "sunday":
        d = F.to_date(ts)
        return F.date_sub(d, F.dayofweek(d) - 1)
    if unit in ("week", "month"):
        return F.to_date(F.date_trunc(unit, ts))
    raise ValueError(f"no such unit: {unit}")


def date_parts(d: Column) -> dict[str, Column]:
    return {"day": F.dayofmonth(d), "month": F.month(d), "year": F.year(d)}


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def days_between(a: Column, b: Column) -> Column:
    """Whole days from ``a`` to ``b``, negative if b is earlier."""
    return F.datediff(F.to_date(b), F.to_date(a))


def duration_min(a: Column, b: Column) -> Column:
    """Fractional minutes from ``a`` to ``b``."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (us(b) - us(a)) / 6e7


def week_bucket(d: Column) -> Column:
    """1 before the 8th, 2 before the 16th, 3 before the 22nd, else 4."""
    day = F.dayofmonth(d)
    return F.when(day < 8, 1).when(day < 16, 2).when(day < 22, 3).when(day.isNotNull(), 4)


def parse_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Null where the text is no such date."""
    return F.try_to_date(c, fmt)


def split_list(c: Column, sep: str) -> Column:
    """Text → array; ``sep`` is literal."""
    return F.split(c, "\\Q" + sep + "\\E")


def join_tokens(arr: Column) -> Column:
    return F.array_join(arr, " ")


def trim_suffix(c: Column, n: int = 7) -> Column:
    """Drop the last ``n`` characters, whatever they are."""
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def tokenize_alpha(c: Column) -> Column:
    """Lower-case runs of word characters that are letters only."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\w+|[^\w\s]+"), F.lit(0)), lambda w: w.rlike(r"^\p{L}+$"))


def remove_stopwords(arr: Column, words: list[str]) -> Column:
    """Drop listed words, keep order and repeats."""
    return F.filter(arr, lambda w: ~w.isin(words))


def round_half_up(c: Column, n: int = 2) -> Column:
    """Half away from zero; first to three more places, so that the noise of a sum doesn't decide a tie."""
    return F.round(F.round(c, n + 3), n)


def round_half_even(c: Column, n: int = 6) -> Column:
    return F.bround(c, n)


def l1_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, (F.abs(p - q) for p, q in zip(a, b, strict=True)))


def l1_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def is_light(r: Column, g: Column, b: Column) -> Column:
    return r + g + b >= 600


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.2989 * r + 0.5870 * g + 0.1140 * b


def percent(part: Column, whole: Column, n: int = 3) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), n)


def age(year: Column, now: int) -> Column:
    return F.lit(now) - year


def scale_const(c: Column, k: float) -> Column:
    return c / k


def argmax(arr: Column) -> Column:
    """Index of the first largest entry, from 0; null for null or empty."""
    return F.nullif(F.array_position(arr, F.array_max(arr)) - 1, F.lit(-1))


def slope_side(dx: Column, dy: Column, t: float = 0.4) -> Column:
    """'right' above ``t``, 'left' below -``t``, else null (a vertical line too)."""
    m = F.try_divide(dy, dx)
    return F.when(m > t, "right").when(m < -t, "left")
