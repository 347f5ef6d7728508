"""Scalar expressions: time, names, money, ratios and bands."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"
Moment = str | date | datetime


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- time ------------------------------------------------------------------------------


def moment(as_of: Moment) -> Column:
    """The reference time as a literal without zone; folds, so filters on it push down."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def before(as_of: Moment, interval: str) -> Column:
    """`interval` (such as '7 days') ahead of `as_of`; months clamp to the month end."""
    return moment(as_of) - F.expr(f"INTERVAL {interval}")


def within_last(column: str | Column, as_of: Moment, interval: str) -> Column:
    return col(column) >= before(as_of, interval)


def days_since(column: str | Column, as_of: Moment) -> Column:
    """Midnights crossed from the column's time to `as_of`."""
    return F.datediff(moment(as_of), col(column)).cast("bigint")


def age_years(birth: str | Column, as_of: Moment) -> Column:
    """Whole years of 365 days; NULL birth date gives NULL."""
    return F.floor(days_since(birth, as_of) / F.lit(365)).cast("bigint")


def weekday_name(day: str | Column) -> Column:
    return F.date_format(col(day), "EEEE")


def is_weekend(day: str | Column) -> Column:
    return F.dayofweek(col(day)).isin(1, 7)


def year_month(day: str | Column) -> Column:
    return F.date_format(col(day), "yyyy-MM")


def month_index(day: str | Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return (F.year(col(day)) * 12 + F.month(col(day)) - 1).cast("bigint")


def whole_months(first: str | Column, last: str | Column) -> Column:
    """Complete months between two times: a month counts once its day is reached."""
    short = F.dayofmonth(col(last)) < F.dayofmonth(col(first))
    return month_index(last) - month_index(first) - short.cast("bigint")


# ---- text ------------------------------------------------------------------------------


def full_name(first: str | Column, last: str | Column) -> Column:
    """NULL when either part is NULL."""
    return F.concat(col(first), F.lit(" "), col(last))


def normalised_email(email: str | Column) -> Column:
    return F.lower(col(email))


def preview(text: str | Column, length: int = 200) -> Column:
    return F.substring(col(text), 1, length)


def same_text(text: str | Column) -> Column:
    """Case- and accent-insensitive form, for comparing and grouping names."""
    return F.collate(col(text), "UNICODE_CI_AI")


# ---- numbers ---------------------------------------------------------------------------


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def total(c: str | Column) -> Column:
    """A sum of money, as wide as a decimal can be."""
    return col(c).cast(TOTAL)


def _half_up(numerator: Column, denominator: Column) -> Column:
    """Quotient of whole numbers in hundredths, halves away from zero; NULL for a zero denominator.

    Whole-number division keeps sums of any size exact, where a decimal quotient would be cut
    to its leading digits before it is rounded.
    """
    wide = "decimal(38,0)"
    n, d = numerator.cast(wide), F.nullif(denominator, F.lit(0)).cast(wide)
    n, d = F.when(d < 0, -n).otherwise(n), F.abs(d)
    magnitude = F.call_function("div", (F.abs(n) * 2 + d).cast(wide), (d * 2).cast(wide))
    signed = F.when(n < 0, -magnitude).otherwise(magnitude)
    return (signed.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def cents(c: str | Column) -> Column:
    return (total(c) * 100).cast("decimal(38,0)")


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def mean(total: str | Column, n: str | Column) -> Column:
    """Exact decimal total over count as a double; NULL for an empty group."""
    return F.try_divide(col(total).cast("double"), col(n).cast("double"))


def mean_money(total_amount: str | Column, n: str | Column) -> Column:
    """Average in cents, rounded half up; NULL for an empty group."""
    return _half_up(cents(total_amount), col(n))


def percent(part: str | Column, whole: str | Column) -> Column:
    """part of whole in percent with two decimals, rounded half up; NULL for a zero whole."""
    return _half_up(cents(part) * 10_000, cents(whole))


def rate_or_zero(part: str | Column, whole: str | Column) -> Column:
    """part of whole in percent as a double, and 0 when the whole is 0."""
    share = F.try_divide(col(part).cast("double"), col(whole).cast("double")) * 100
    return F.when(col(whole) > 0, share).otherwise(F.lit(0.0))


def as_unsigned(text: str | Column) -> Column:
    """Text as a whole number, NULL where it is none."""
    return col(text).try_cast("bigint")


def band(value: str | Column, steps: list[tuple[float, str]], lowest: str, strict: bool) -> Column:
    """Name of the first step that `value` exceeds (strict) or reaches, steps from high to low."""
    v = col(value)
    chain = None
    for limit, name in steps:
        hit = v > limit if strict else v >= limit
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(lowest) if chain is not None else F.lit(lowest)
