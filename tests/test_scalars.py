from datetime import date

import pytest
from pyspark.sql import functions as F

from quayline.functions import scalars as S


def value(spark, column, **fields):
    names = list(fields)
    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in fields.items()) or "x int"
    row = tuple(v for v, _ in fields.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, expected", [
    ("2026-04-06", "Apr 6"), ("2026-04-06T10:11:12", "Apr 6"), ("2026-04-06T10:11:12.345", "Apr 6"),
    (None, "n/a"), ("None", "n/a"), ("", "n/a"), ("next month maybe", "next month"),
])
def test_short_date(spark, text, expected):
    assert value(spark, S.short_date(F.col("t")), t=(text, "string")) == expected


@pytest.mark.parametrize("text, expected", [
    ("3.7", 3), ("-3.7", -3), ("", 0), (None, 0), ("  ", 0), ("12", 12), ("abc", None),
])
def test_whole_number(spark, text, expected):
    assert value(spark, S.whole_number(F.col("t")), t=(text, "string")) == expected


@pytest.mark.parametrize("start, end, days", [
    (date(2024, 1, 5), date(2024, 1, 8), 1), (date(2024, 1, 6), date(2024, 1, 7), 0),
    (date(2024, 1, 1), date(2024, 1, 15), 10), (date(2024, 1, 8), date(2024, 1, 5), 0),
    (None, date(2024, 1, 5), None), (date(1969, 12, 25), date(1970, 1, 2), 6),
])
def test_business_days(spark, start, end, days):
    found = value(spark, S.business_days(F.col("a"), F.col("b")), a=(start, "date"), b=(end, "date"))
    assert found == days


def test_leap_day_and_week_start(spark):
    assert value(spark, S.shift_date(F.col("d"), years=-1), d=(date(2024, 2, 29), "date")) == date(2023, 2, 28)
    assert value(spark, S.week_start(F.col("d")), d=(date(2024, 1, 7), "date")) == date(2024, 1, 1)


@pytest.mark.parametrize("city, state, expected", [
    ("Salem", "OR", "Salem, OR"), ("", "OR", "OR"), ("Salem", None, "Salem"), (None, "", "n/a"),
])
def test_ship_to(spark, city, state, expected):
    found = value(spark, S.ship_to(F.col("c"), F.col("s")), c=(city, "string"), s=(state, "string"))
    assert found == expected


@pytest.mark.parametrize("new, base, expected", [(15, 10, 50.0), (5, 0, None), (5, None, None), (5, -2, None)])
def test_percent_change(spark, new, base, expected):
    found = value(spark, S.percent_change(F.col("n"), F.col("b")), n=(new, "bigint"), b=(base, "bigint"))
    assert found == expected


@pytest.mark.parametrize("phrase, start, end", [
    ("what came in yesterday", date(2024, 1, 9), date(2024, 1, 10)), ("TODAY", date(2024, 1, 10), date(2024, 1, 11)),
    ("this week", date(2024, 1, 8), None), ("last week", date(2024, 1, 1), date(2024, 1, 8)),
    ("past month", date(2023, 12, 11), None), ("", date(2024, 1, 3), None),
])
def test_phrase_range(spark, phrase, start, end):
    span = value(spark, S.phrase_range(F.col("p"), F.lit("2024-01-10").cast("date")), p=(phrase, "string"))
    assert (span["start"], span["end"]) == (start, end)


def test_number_labels(spark):
    assert value(spark, S.number_label(F.col("n")), n=(4049, "bigint")) == "4,049"
    assert value(spark, S.number_label(F.col("n"), 2), n=(4049.5, "double")) == "4,049.50"
    assert value(spark, S.number_label(F.col("n")), n=(None, "bigint")) == "n/a"
