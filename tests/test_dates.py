"""Dates in texts: forms, spans, languages, and what is no date."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import dates

MAY_12 = [
    "on the 12th of May, 2026 at noon", "May 12, 2026", "MAY 12", "12. května 2026", "12.5.2026", "12. 5. 2026", "12/5/26", "12-05-2026", "2026-05-12", "2026/5/12", "2026.05.12",
    "12 maja", "12 de mayo de 2026", "12 maggio 2026", "12. Mai", "12.–14. 5. 2026", "12-14 May 2026", "12.5.-14.5.2026", "12 May - 2 June 2026", "May 12-14, 2026", "12. 5.", "room 7, 12.5.2026",
]
NONE = ["31.2.2026", "31.2.10", "call 420 123 456", "room 12.", "in May", "5 apples", "12.13.2026", "1.2.3.4", "", "12 5 2026", "12.5-2026 x", None]


def found(spark, texts, **more):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", dates.first_date(F.col("s"), F.lit(2026), **more).alias("d")).collect()
    return [r.d for r in sorted(rows, key=lambda r: r.i)]


def test_forms(spark):
    assert found(spark, MAY_12) == [datetime.date(2026, 5, 12)] * len(MAY_12)
    assert found(spark, NONE) == [None] * len(NONE)


def test_first_in_the_text_and_years(spark):
    got = found(spark, ["99.99.2026 then 1.6.2026 and 2.6.2026", "30 April - 2 May 2027", "31.12.-1.1.2027", "1.1.75", "1.1.77", "2 juin 1999"])
    assert [str(d) for d in got] == ["2026-06-01", "2027-04-30", "2027-12-31", "2075-01-01", "1977-01-01", "1999-06-02"]


def test_languages_are_a_parameter(spark):
    assert found(spark, ["12 maja", "12 May"], languages=("en",)) == [None, datetime.date(2026, 5, 12)]
    assert "mayo" in dates.month_names(("es",)) and "mayo" not in dates.month_names(("en", "cs"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("entries close 5.5.2026", "2026-05-05"),
        ("Entries  CLOSE on the 5th May", "2026-05-05"),
        ("entries closed 5.5.2026", "None"),
        ("entries close when the last of all one hundred places has been taken, 5.5.2026", "None"),
        ("until 6.5. but entries close 5.5.", "2026-05-05"),
        ("entries close never; until 6.5.", "2026-05-06"),
        ("entries close 31.2. entries close 1.3.", "2026-03-01"),
    ],
)
def test_behind_a_phrase(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert str(df.select(dates.date_after(F.col("s"), ["entries close", "until"], F.lit(2026))).first()[0]) == want


def test_a_text_is_cut_into_tokens_once(spark):
    """Each token looked at the whole text again, and each form computed its dates anew: a hundred thousand texts took minutes."""
    plan = spark.range(1).select(dates.date_after(F.col("id").cast("string"), ["until"], F.lit(2026)).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("make_date(") <= 2


@pytest.mark.parametrize(("text", "want"), [("29.2-1 May 2027", "None"), ("29.2.-1.3.2028", "2028-02-29"), ("12-14.5", "2026-05-12"), ("12-14.5.28", "2028-05-12"), ("1.2.-3-4", "None"), ("12 May -2 June 27.", "2026-05-12"), ("12.5-May 2027", "2026-05-12"), ("0.5.2026", "None")])
def test_spans_and_what_follows_them(spark, text, want):
    assert str(found(spark, [text])[0]) == want
