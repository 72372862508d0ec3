"""Display forms of numbers, sizes and months, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names, in order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _one_decimal(n: Column, unit: int) -> Column:
    """``n / unit`` with one decimal, rounded as the double ``n / unit`` rounds.

    Integers decide all but ties; at a tie it matters on which side of it the
    double lies, which an exact product of its two halves tells.
    """
    tenth = unit // 10
    q, r = F.floor(n / tenth), n % tenth
    x = n.cast("double") / float(unit)
    high = F.floor(x * float(2**20)) / float(2**20)
    beyond = (high * float(unit) - n.cast("double")) + (x - high) * float(unit)
    up = F.when((2 * r > tenth) | ((2 * r == tenth) & (beyond >= 0)), 1).otherwise(0)
    t = (q + up).cast("long")
    return F.concat(F.floor(t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("string")


def compact_count(n: Column) -> Column:
    """1234 -> 1.2k, 12345 -> 12k, 1234567 -> 1.2M, ...; the last digit after the point goes when it is 0, but not for B."""
    x = n.cast("double")
    trim = lambda c: F.regexp_replace(c, "\\.0$", "")
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 10_000, F.concat(trim(_one_decimal(n, 10**3)), F.lit("k")))
        .when(n < 1_000_000, F.concat(_whole(x / 1e3), F.lit("k")))
        .when(n < 10_000_000, F.concat(trim(_one_decimal(n, 10**6)), F.lit("M")))
        .when(n < 1_000_000_000, F.concat(_whole(x / 1e6), F.lit("M")))
        .otherwise(F.concat(_one_decimal(n, 10**9), F.lit("B")))
    )


def month_label(month: Column) -> Column:
    """2012-12, 2012-1 or 2012-12-05 -> Dec 2012, Jan 2012, Dec 2012; anything else as it is.

    What stands before the first hyphen is the year, the number after it the month.
    """
    number = F.regexp_extract(month, "^[^-]*-\\s*0*([1-9]|1[0-2])\\s*(-.*)?$", 1)
    name = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.when(number != "", number.cast("int")))
    return F.when(name.isNotNull(), F.concat(name, F.lit(" "), F.regexp_extract(month, "^([^-]*)-", 1))).otherwise(month)


def _even_decimal(x: Column) -> Column:
    """One decimal, exact ties to the even digit."""
    return F.format_string("%.1f", F.bround(x, 1))


def human_size(n_bytes: Column) -> Column:
    """Steps of 1024: whole bytes, else one decimal and K, M, G or T."""
    x, out = n_bytes.cast("double"), None
    for unit, size in (("K", 2**20), ("M", 2**30), ("G", 2**40)):
        text = F.concat(_even_decimal(x / (size / 1024)), F.lit(unit))
        out = F.when(n_bytes < 1024, F.concat(n_bytes.cast("string"), F.lit("B"))).when(n_bytes < size, text) if out is None else out.when(n_bytes < size, text)
    return out.otherwise(F.concat(_even_decimal(x / 2**40), F.lit("T")))


def grouped_digits(x: Column) -> Column:
    """Not below zero, rounded down, with commas."""
    return F.format_number(F.greatest(F.lit(0), F.floor(x)).cast("long"), 0)
