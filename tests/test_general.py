"""Instants and quantities against independent restatements and edge cases."""

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adlattice.operators import instants, quantities

PER_YEAR = {"hour": 2080, "day": 260, "week": 52, "fortnight": 26, "month": 12, "year": 1}
JOBS = "internal_id bigint, source string, date_posted string, date_scraped string, extra string, posted_s string"


def clocks(spark):
    p = spark.createDataFrame([(1, "JobsDB"), (2, "Indeed"), (5, "Stellen Hafen")], "id int, name string")
    c = spark.createDataFrame([(1, "Asia/Hong_Kong", True), (2, "America/New_York", False), (5, "Europe/Berlin", True)], "source_id int, zone string, day_first boolean")
    return instants.board_clocks(p, c)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(min_value=datetime(1900, 1, 1), max_value=datetime(2199, 12, 31)))
def test_day_arithmetic_agrees_with_the_calendar(t):
    assert instants.days_from_civil(t.year, t.month, t.day) == (datetime(t.year, t.month, t.day) - datetime(1970, 1, 1)).days
    wall = int((t.replace(microsecond=0) - datetime(1970, 1, 1)).total_seconds())
    assert instants.read_instant(t.strftime("%Y-%m-%d %H:%M:%S") if t.year > 999 else None, True)[1] == wall


@pytest.mark.parametrize("text", ["", None, "0000-00-00", "2025-13-45", "2025-02-29", "30+ days ago", "30d+ ago", "over 30 days", "Today", "recently", "25:00", "2025-01-01 24:00:00", "x" * 5000, "2025-01-01 10:00:00 XYZ"])
def test_no_instant(text):
    assert instants.read_instant(text, True) == (None, None, None)


def test_outer_blanks_of_any_length_do_not_count():
    assert instants.read_instant(" " * 500 + "2025-01-01" + " " * 500, True)[1] == 1735689600


@pytest.mark.parametrize("text, reason", [("2025-01-01 10:00 AEST", "unknown zone"), ("2025-02-30", "impossible date or time"), ("30+ days ago", "open distance"), ("soon", "unknown notation"), (" ", "blank"), ("2025-01-01", None), ("3d ago", None)])
def test_values_without_an_instant_have_a_reason(text, reason):
    assert instants.why_not(text, True) == reason


def test_unread_values_are_reported(spark):
    rows = [(1, "JobsDB", "soon", "2025-05-02 08:00:00 IST", "a", "z"), (2, None, "2025-01-01", "3d ago", "a", "z"), (3, "JobsDB", None, "2025-01-01", "a", "z")]
    got = {(r.internal_id, r.field): r.reason for r in instants.unread(spark.createDataFrame(rows, JOBS), clocks(spark)).collect()}
    assert got == {(1, "date_posted"): "unknown notation", (1, "date_scraped"): "unknown zone", (2, "date_posted"): "no clock, or nothing to count from", (2, "date_scraped"): "no clock, or nothing to count from"}


def test_zones_and_distances(spark):
    rows = [
        (1, "JobsDB", "3d ago", "2025-05-02 08:00:00", "a", "z"),
        (2, "INDEED ", "03/04/2025", "2025-03-09 02:30:00", "a", "z"),  # month first; skipped hour
        (3, "indeed", "2025-11-02 01:30:00", "1730000000123", "a", None),  # repeated hour: first
        (4, "stellenhafen", "26.10.2025 02:30", "20250101T000000-0330", "a", "z"),
        (5, None, "2025-01-01", "2025-01-01T00:00:00Z", "a", "z"),
        (6, "JobsDB", "2 weeks ago", "now", None, None),
        (6, "JobsDB", "2 weeks ago", "now", None, None),
        (7, "JobsDB", None, None, None, None),
    ]
    got = {(r.internal_id, r.field): r.epoch_s for r in instants.found(spark.createDataFrame(rows, JOBS), clocks(spark)).collect()}

    def at(y, mo, d, h, mi, zone):
        return int(datetime(y, mo, d, h, mi, tzinfo=ZoneInfo(zone)).timestamp())

    scraped = at(2025, 5, 2, 8, 0, "Asia/Hong_Kong")
    assert got == {
        (1, "date_scraped"): scraped,
        (1, "date_posted"): scraped - 3 * 86400,
        (2, "date_posted"): at(2025, 3, 4, 0, 0, "America/New_York"),
        (2, "date_scraped"): at(2025, 3, 9, 3, 30, "America/New_York"),
        (3, "date_posted"): int(datetime(2025, 11, 2, 1, 30, fold=0, tzinfo=ZoneInfo("America/New_York")).timestamp()),
        (3, "date_scraped"): 1730000000,
        (4, "date_posted"): int(datetime(2025, 10, 26, 2, 30, fold=0, tzinfo=ZoneInfo("Europe/Berlin")).timestamp()),
        (4, "date_scraped"): int((datetime(2025, 1, 1) + timedelta(hours=3, minutes=30) - datetime(1970, 1, 1)).total_seconds()),
        (5, "date_scraped"): at(2025, 1, 1, 0, 0, "UTC"),
    }


def test_extra_columns_stay_and_empty_input_works(spark):
    empty = spark.createDataFrame([], JOBS)
    out = instants.normalise(empty, clocks(spark))
    assert out.count() == 0 and "extra" in out.columns and dict(out.dtypes)["posted_s"] == "bigint"
    assert instants.found(empty, clocks(spark)).count() == 0


NOTES = {
    "月薪 HKD 14,500": ("HKD", 174000, 174000),
    "HK$15,500+ p.m.": ("HKD", 186000, -1),
    "EUR 6 500 to 12 500 monatlich": ("EUR", 78000, 150000),
    "€9.5 - 15K / Monat, 5-day week": ("EUR", 114000, 180000),
    "€3.700,00 ~ €4.800 pcm (negotiable)": ("EUR", 44400, 57600),
    "HK$ 13,500 x 14 months": ("HKD", 189000, 189000),
    "USD 10,000 - 12,500 pcm + bonus": ("USD", 120000, 150000),
    "H.K.$8,000–H.K.$8,900/2 wks": ("HKD", 208000, 231400),
    "$1.58-1.62萬 per fortnight": ("HKD", 410800, 421200),
    "HK$ 0.489 million to 0.499 million/yr": ("HKD", 489000, 499000),
    "最高 USD 64000 annually": ("USD", -1, 64000),
    "89 HK dollars/h": ("HKD", 185120, 185120),
    "5-day work, 13th month pay": None,
    "Salary 14 days in arrears": None,
    "40 hours per week": None,
    "30% per year": None,
    "HK$20,000 per month, 44 hours per week": ("HKD", 240000, 240000),
    "月薪 ２０，０００": ("HKD", 240000, 240000),
    "Negotiable": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("note", NOTES)
def test_pay_notes(note):
    assert quantities.yearly(note, None, PER_YEAR) == NOTES[note]


def test_the_advert_supplies_what_the_note_lacks():
    advert = "x. Pay is quoted in pounds &amp; counted per week; y"
    assert quantities.yearly("850 - 900", advert, PER_YEAR) == ("GBP", 44200, 46800)
    assert quantities.yearly("$850", advert, PER_YEAR) == ("HKD", 44200, 44200)
    assert quantities.yearly("850", None, PER_YEAR) is None


def test_the_terms_of_pay_may_be_worded_in_any_way():
    assert quantities.yearly("850", "All our wages are in euros, every week. Lunch is free.", PER_YEAR) == ("EUR", 44200, 44200)
    assert quantities.yearly("850", "Lunch costs two pounds per day.", PER_YEAR) is None


def test_units_are_exponent_vectors():
    rate = quantities.MONEY * quantities.per(12)
    assert rate.dims == quantities.PAY and rate.canonical(quantities.Decimal(2)) == 24
    assert (quantities.scaled(1000) * rate).canonical(quantities.Decimal(2)) == 24000
    hours_a_week = quantities._OTHER["hours"] * quantities.per(52)
    assert hours_a_week.dims == ()
    with pytest.raises(ValueError):
        rate * quantities._OTHER["°c"]
    assert round(quantities.quantity("25 °C")[0], 2) == quantities.Decimal("298.15") and round(quantities.quantity("77 °F")[0], 2) == quantities.Decimal("298.15")
    assert quantities.quantity("12 lbs")[1].dims == (("mass", 1),) and quantities.quantity("12 apples") is None


@settings(max_examples=150, deadline=None)
@given(st.integers(1000, 9_999_999), st.sampled_from(["{:,}", "{}"]), st.sampled_from(["HK$", "USD ", "€", "S$"]))
def test_written_numbers_round_trip(n, style, sign):
    st_ = quantities.parse(f"{sign}{style.format(n)} per year")
    assert st_.low == st_.high == n


def test_quantities_on_a_frame(spark):
    rows = [(1, "HK$15K to 16.5K/month", "long " * 30000, "k"), (1, "HK$15K to 16.5K/month", None, "k"), (2, None, None, None), (3, "", "", "")]
    jobs = spark.createDataFrame(rows, "internal_id bigint, salary_description string, description string, currency string")
    periods = spark.createDataFrame(list(PER_YEAR.items()), "period string, per_year int")
    assert [tuple(r) for r in quantities.found(jobs, periods).collect()] == [(1, "HKD", 180000, 198000)] * 2
    assert quantities.found(jobs.filter(F.lit(False)), periods).count() == 0
