"""Parsing, dates, formatting and names on literal cells."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright.functions import dates, formatting, names, parsing


def test_numeric_text(values):
    texts = ["12", " 5\t", "-1.5e3", ".5", "5.", "1,000", "$5", "", "0x1A", "1_000", "1d", "5f", "nan", "abc", None, "1e400"]
    got = values(texts, parsing.numeric)
    assert got == [12.0, 5.0, -1500.0, 0.5, 5.0, None, None, None, None, None, None, None, None, None, None, math.inf]


def test_infinity_counts_as_number(values):
    assert values(["inf", "-Infinity", "INF"], parsing.numeric) == [math.inf, -math.inf, math.inf]


def test_currency_text(values):
    texts = ["$1,200.50", " $ 7 ", "1_000", "nan", "inf", "12a", "", "-$3", "$"]
    assert values(texts, parsing.currency) == [1200.5, 7.0, 1000.0, None, None, None, None, -3.0, None]


def test_prefix_text(values):
    texts = ["12abc", "  -3.5kg", "abc12", "1e3x", "1e", ".5.6", "Infinity!", "", None]
    assert values(texts, parsing.prefix) == [12.0, -3.5, None, 1000.0, 1.0, 0.5, math.inf, None, None]


def test_chart_value(values):
    assert values(["$1,5x", "n/a", None, ""], parsing.chart_value) == [15.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    "sample, name",
    [
        ("2024-01-01", "Y-m-d"),
        ("01/02/2024", "m/d/Y"),
        ("13/01/2024", "d/m/Y"),
        ("2024-01", "Y-m"),
        ("Jan 5, 2024", "b d, Y"),
        ("5 January 2024", "d B Y"),
        ("2024-01-01T10:00:00.000", "Y-m-dTH:M:S.f"),
        ("2024-01-01 10:00", "Y-m-d H:M"),
        ("20/40", None),
        ("hello", None),
        (None, None),
    ],
)
def test_format_choice(sample, name):
    found = dates.format_of(sample)
    assert (found.name if found else None) == name


def test_dates_are_strict_in_one_format(values):
    texts = ["2024-01-01", "01/02/2024", "2024-01-01 10:00:00", "2024-02-30", "2024-12-31"]
    got = values(texts, lambda c: formatting.date_label(dates.parse_date(c, "Y-m-d")))
    assert got == ["2024-01-01", None, None, None, "2024-12-31"]


def test_other_date_layouts(values):
    def label(name):
        return lambda c: F.date_format(dates.parse_date(c, name), "yyyy-MM-dd HH:mm:ss")

    assert values(["13/01/2024", "01/13/2024"], label("d/m/Y")) == ["2024-01-13 00:00:00", None]
    assert values(["Jan 5, 2024", "Feb 30, 2024"], label("b d, Y")) == ["2024-01-05 00:00:00", None]
    assert values(["2024-01"], label("Y-m")) == ["2024-01-01 00:00:00"]
    assert values(["01/02/2024 9:05"], label("m/d/Y H:M")) == ["2024-01-02 09:05:00"]
    assert values(["2024-01-01T10:00:00.250"], label("Y-m-dTH:M:S.f")) == ["2024-01-01 10:00:00"]


def test_dates_do_not_depend_on_the_session_zone(spark, values):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = values(
            ["2024-03-10 02:30:00"],
            lambda c: dates.parse_date(c, "Y-m-d H:M:S").cast("string"),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2024-03-10 02:30:00"]


def test_unknown_format_name():
    with pytest.raises(ValueError):
        dates.format_named("q")


def test_compact_numbers(values):
    texts = ["1234567890", "2500000", "1500", "-1500", "999.999", "12.5", "7", "0", None]
    got = values(texts, lambda c: formatting.compact_number(c.cast("decimal(20,4)")))
    assert got == ["1.23B", "2.50M", "1.50K", "-1.50K", "1,000", "12.5", "7", "0", "—"]


def test_indian_grouping(values):
    texts = ["123", "1234", "123456", "1234567.5", "123456789.126", "-100000"]
    got = values(texts, lambda c: formatting.indian_grouping(c.cast("double")))
    assert got == ["123", "1,234", "1,23,456", "12,34,567.5", "12,34,56,789.13", "-1,00,000"]


def test_safe_scalar(values):
    got = values(["1.23456", "inf", "nan", None], lambda c: formatting.safe_scalar(c.cast("double")))
    assert got == [1.2346, None, None, None]


def test_ranked_label(values):
    got = values(["x" * 30, None], lambda c: formatting.ranked_label(c, F.lit(2)))
    assert got == ["x" * 22, "Row 2"]


def test_clean_names():
    raw = [" Total Sales ($) ", "Unnamed: 0", "nan", "a", "a", "a_1", "_sheet", None, ("x", "Unnamed: 1_level", " y ")]
    got = names.clean_names(raw)
    assert got[:5] == ["total_sales", "col_1", "col_2", "a", "a_1"]
    assert got[6:] == ["sheet", "col_7", "x_y"]
    assert len(set(got)) == len(got)
    assert names.clean_names(["unnamed_total", "Unnamed"]) == ["col_0", "unnamed"]


def test_column_letters():
    assert [names.letters(i) for i in (0, 25, 26, 51, 701, 702)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]
    assert all(names.position(names.letters(i)) == i for i in range(2000))
    assert names.position("aa") == 26


def test_dates_with_zones_half_days_and_short_years(values):
    from tablewright.functions import dates

    cases = {
        "2024-01-05T10:00:00Z": "2024-01-05 10:00:00",
        "2024-01-05 10:00:00.5+0530": "2024-01-05 10:00:00.500000",
        "01/05/24": "2024-01-05 00:00:00",
        "13/05/69": "1969-05-13 00:00:00",
        "01/05/2024 12:05 AM": "2024-01-05 00:05:00",
        "01/05/2024 12:05pm": "2024-01-05 12:05:00",
        "1/5/2024 9:05:07 PM": "2024-01-05 21:05:07",
    }
    for text, want in cases.items():
        assert str(values([text], dates.format_of(text).parse)[0]) == want
    assert dates.format_of("01/05/2024 13:05 PM") is None
    assert values(["01/05/2024 00:05 AM", "01/32/24"], dates.format_named("m/d/Y I:M p").parse) == [None, None]
