"""Column functions for dates, numbers and labels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F


def as_date(day: date) -> Column:
    return F.lit(day).cast("date")


def date_text(value: Column) -> Column:
    return F.date_format(F.to_date(value), "yyyy-MM-dd")


def shift_date(value: Column, days: int = 0, years: int = 0) -> Column:
    """Calendar shift; 29 February moves to the 28th in a common year."""
    return F.date_add(F.add_months(value, 12 * years), days)


def week_start(value: Column) -> Column:
    """The Monday on or before the date."""
    return F.date_trunc("week", value).cast("date")


def short_date(value: Column) -> Column:
    """ISO text as `Apr 6`; missing text as `n/a`; other text cut to ten characters."""
    head = F.substring(F.substring_index(value, ".", 1), 1, 19)
    parsed = F.coalesce(
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
    )
    missing = value.isNull() | value.isin("", "None")
    return F.when(missing, F.lit("n/a")).otherwise(
        F.coalesce(F.date_format(parsed, "MMM d"), F.substring(value, 1, 10))
    )


def number_label(value: Column, decimals: int = 0, missing: str = "n/a") -> Column:
    """`4,049` for integers, `4,049.50` with two decimals."""
    return F.coalesce(F.format_number(value, decimals), F.lit(missing))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def number_or_zero(value: Column, kind: str = "double") -> Column:
    """Untrusted text as a number; blanks and bad text become zero."""
    return F.coalesce(value.try_cast(kind), F.lit(0).cast(kind))


def whole_number(value: Column) -> Column:
    """Untrusted text as an integer, truncated toward zero; blank text is zero, bad text null."""
    trimmed = F.trim(value)
    return F.when(value.isNull() | (trimmed == ""), F.lit(0)).otherwise(
        trimmed.try_cast("double").try_cast("bigint")
    )


def amount(value: Column, kind: str = "decimal(18,2)") -> Column:
    """Untrusted text as money; blank text is zero, bad text null."""
    trimmed = F.trim(value)
    return F.when(value.isNull() | (trimmed == ""), F.lit(0).cast(kind)).otherwise(
        trimmed.try_cast(kind)
    )


def rounded(value: Column, digits: int) -> Column:
    """Decimal rounding, returned as a double."""
    return F.round(value.cast("decimal(38,6)"), digits).cast("double")


def percent_change(new: Column, base: Column, digits: int = 1) -> Column:
    """Change in percent of the base; null unless the base is positive."""
    change = (new - base).cast("decimal(20,0)") * F.lit(100) / base.cast("decimal(18,0)")
    return F.when(base > 0, F.round(change, digits).cast("double"))


def share_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    share = part.cast("decimal(20,0)") * F.lit(100) / whole.cast("decimal(18,0)")
    return F.when(whole > 0, F.round(share, digits).cast("double"))


def ship_to(city: Column, state: Column) -> Column:
    """`City, ST` without blank parts; `n/a` when both are blank."""
    joined = F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(state, F.lit("")))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("n/a"))


def case_fold(value: Column) -> Column:
    return F.lower(F.trim(value))


def cut(value: Column, size: int) -> Column:
    return F.substring(value, 1, size)


def ellipsis(value: Column, size: int) -> Column:
    """The first `size` characters, marked with dots when text was cut."""
    return F.when(F.length(value) > size, F.concat(cut(value, size), F.lit("..."))).otherwise(value)


def phrase_range(phrase: Column, today: Column) -> Column:
    """The half-open date range a time phrase means, as struct(start, end).

    `end` is null where the phrase leaves the range open; the first phrase found wins.
    """
    text = F.lower(phrase)
    monday = week_start(today)
    open_end = F.lit(None).cast("date")

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.cast("date").alias("start"), end.cast("date").alias("end"))

    return (
        F.when(text.contains("yesterday"), span(F.date_sub(today, 1), today))
        .when(text.contains("today"), span(today, F.date_add(today, 1)))
        .when(text.contains("this week"), span(monday, open_end))
        .when(text.contains("last week"), span(F.date_sub(monday, 7), monday))
        .when(
            text.contains("last 7 days") | text.contains("past week"),
            span(F.date_sub(today, 7), open_end),
        )
        .when(
            text.contains("last 30 days") | text.contains("past month"),
            span(F.date_sub(today, 30), open_end),
        )
        .otherwise(span(F.date_sub(today, 7), open_end))
    )


def in_range(value: Column, span: Column) -> Column:
    end = span.getField("end")
    return (value >= span.getField("start")) & (end.isNull() | (value < end))


def age_months(received: Column, snapshot: Column) -> Column:
    return F.months_between(snapshot, received)


def business_days(start: Column, end: Column) -> Column:
    """Weekdays after `start` up to and including `end`; negative spans count as zero."""

    def weekdays_through(day: Column) -> Column:
        # Days since Monday 1970-01-05, split into full weeks and the days of the open week.
        offset = F.datediff(day, F.lit("1970-01-05").cast("date"))
        week = F.floor(offset / F.lit(7))
        return week * 5 + F.least(F.pmod(offset, F.lit(7)) + 1, F.lit(5))

    days = weekdays_through(end) - weekdays_through(start)
    return F.when(days < 0, F.lit(0)).otherwise(days).cast("int")
