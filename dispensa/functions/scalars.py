"""Scalar column functions (H1–H19 of the survey), all JVM-side built-ins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_out(c: str | Column) -> Column:
    """Exact decimal result → double rounded to cents (the compared form)."""
    return F.round(col_(c), 2).cast("double")


def clamp(value, default: int, lo: int, hi: int) -> int:
    """Integer parameter with default and bounds; non-numeric text → 1
    the way an int cast of text behaves (leading digits, else 0, then clamp)."""
    if value is None:
        return default
    if isinstance(value, str):
        s = value.strip()
        digits = ""
        for i, ch in enumerate(s):
            if ch.isdigit() or (i == 0 and ch in "+-"):
                digits += ch
            else:
                break
        try:
            value = int(digits)
        except ValueError:
            value = 0
    return max(lo, min(hi, int(value)))


def page_offset(limit: int, page) -> int:
    """offset of a 1-based page; pages below 1 read as 1."""
    p = clamp(page, 1, 1, 2**31 - 1)
    return (p - 1) * limit


def day_of(ts: str | Column) -> Column:
    """H1 ``DATE(ts)``."""
    return F.to_date(col_(ts))


def lit_date(d: str | dt.date) -> Column:
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def first_of_month(d: str | dt.date) -> dt.date:
    """H5 default period start."""
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return d.replace(day=1)


def plus_one_year(d: str | Column) -> Column:
    """H6: date + 1 year where 29 Feb becomes 1 Mar (calendar overflow),
    not 28 Feb as ``add_months`` would give."""
    c = col_(d)
    leap_day = (F.month(c) == 2) & (F.dayofmonth(c) == 29)
    return F.when(leap_day, F.make_date(F.year(c) + 1, F.lit(3), F.lit(1))).otherwise(F.add_months(c, 12))


def strict_date(s: str | Column) -> Column:
    """The text is a real date written exactly as yyyy-MM-dd."""
    c = col_(s)
    parsed = F.try_to_date(c, "yyyy-MM-dd")
    return parsed.isNotNull() & (F.date_format(parsed, "yyyy-MM-dd") == c)


def is_numeric(s: str | Column) -> Column:
    """H19 numeric test: optional sign, digits with optional fraction, optional exponent;
    leading whitespace allowed, trailing whitespace allowed."""
    return col_(s).rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")


def is_digits(s: str | Column) -> Column:
    """H19 integer test: non-empty string of ASCII digits only."""
    return col_(s).rlike(r"^[0-9]+$")


def contains_ci(hay: str | Column, needle: str | Column) -> Column:
    """ASCII case-insensitive substring test (``stripos`` ≠ false)."""
    return F.lower(col_(hay)).contains(F.lower(col_(needle)))


def display_number(c: str | Column) -> Column:
    """Integer display with '.' as thousands separator."""
    return F.translate(F.format_number(col_(c), 0), ",", ".")


def unit_price(total: str | Column, qty: str | Column) -> Column:
    """Total / qty rounded half-up to cents; null when qty <= 0 or total < 0."""
    t = col_(total).cast("decimal(20,4)")
    q = col_(qty)
    return F.when((q > 0) & (col_(total) >= 0), F.round(t / q, 2).cast("decimal(15,2)"))


def sorted_pair(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """a pair in byte order."""
    return F.least(col_(a), col_(b)), F.greatest(col_(a), col_(b))


def enum_position(c: str | Column, domain: list[str]) -> Column:
    """1-based declaration position of an enum value (0 when outside)."""
    return F.array_position(F.array(*[F.lit(v) for v in domain]), col_(c))
