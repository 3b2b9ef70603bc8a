import pytest
from pyspark.sql import functions as F

from listwright.functions import cards as C, dates as D, salary as S, text as X
from listwright.operators import filters
from listwright.operators.scoring import parse_response, score_band, seniority_cap

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


@pytest.mark.parametrize("text,want", [
    ("  Acme, Inc. ", "acme"), ("Blue-Sky Labs LLC", "bluesky"), ("Café Ünal Co.", "café ünal"),
    ("Tech Group", ""), ("a_b  c", "a_b c"), (None, ""),
])
def test_company(value, text, want):
    assert value(X.normalize_company, c=text) == want


@pytest.mark.parametrize("text,want", [
    ("Strategy & Ops", "strategy  ops"), (" VP, Finance! ", "vp finance"), ("", ""),
])
def test_title(value, text, want):
    assert value(X.normalize_title, t=text) == want


@pytest.mark.parametrize("text,want", [
    ("Atlanta, GA", "los_angeles"), ("SF Bay Area", "san_francisco"), ("Brooklyn", "new_york"),
    (" Berlin ", "berlin"), (None, ""),
])
def test_location(value, text, want):
    assert value(X.normalize_location, t=text) == want


def test_location_whole_words(value):
    assert value(lambda t: X.normalize_location(t, word_boundary=True), t="Atlanta") == "atlanta"


@pytest.mark.parametrize("text,want", [
    ("92K-164K Annually", (92000.0, 164000.0)), ("150K Annually", (150000.0, 150000.0)),
    ("23-30 Hourly", (47840.0, 62400.0)), ("Hourly", (None, None)), ("", (None, None)),
])
def test_salary_card(value, text, want):
    assert tuple(value(S.salary_from_card, t=text)) == want


@pytest.mark.parametrize("text,flavour,want", [
    ("$80K-$120K a year", "linkedin", (80000.0, 120000.0)),
    ("95,000 a year", "indeed", (95000.0, None)),
    ("$50/hr", "linkedin", (None, None)), ("$50/hr", "indeed", (50000.0, None)),
    (", and 70,000", "indeed", (70000.0, None)), (None, "indeed", (None, None)),
])
def test_salary_api(value, text, flavour, want):
    assert tuple(value(lambda t: S.salary_from_api(t.cast("string"), flavour), t=text)) == want


@pytest.mark.parametrize("low,high,want", [
    (92500.0, None, "$92K+"), (92000.0, 164000.0, "$92K–$164K"), (0.0, 93500.0, "Up to $94K"),
    (0.0, None, "—"), (None, None, "—"),
])
def test_format_salary(value, low, high, want):
    assert value(lambda a, b: S.format_salary(a.cast("double"), b.cast("double")),
                 a=low, b=high) == want


@pytest.mark.parametrize("text,want", [
    ("2/7/2026", "2026-02-07 00:00:00"), ("13/02/2026", "2026-02-13 00:00:00"),
    ("2026-02-07", "2026-02-07 00:00:00"), ("2026-02-07T01:02:03Z", "2026-02-07 01:02:03"),
    ("2026-02-07T01:02:03.5", "2026-02-07 01:02:03.5"), ("February 7, 2026", "2026-02-07 00:00:00"),
    ("feb 7, 2026", "2026-02-07 00:00:00"), ("2026-02-30", None), ("30+ days ago", None),
    ("2026-02-07T00:00:00+00:00", None), ("3 days ago", "2024-01-29 00:00:00"),
    ("1 week ago", "2024-01-25 00:00:00"), ("5 hours ago", "2024-01-31 19:00:00"),
    ("Just posted", "2024-02-01 00:00:00"), ("2 months ago", "2023-12-03 00:00:00"),
    ("99999999999999999999 days ago", None), ("9999999 days ago", None), ("soon", None),
])
def test_posted_date(value, text, want):
    got = value(lambda t: D.parse_posted_date(t, F.expr(AS_OF)).cast("string"), t=text)
    assert got == want


@pytest.mark.parametrize("days,want", [
    (0, "green"), (7, "green"), (8, "yellow"), (14, "yellow"), (15, "red"), (21, "red"),
    (22, "black"), (-1, "unknown"), (None, "unknown"),
])
def test_freshness(value, days, want):
    def posted(d):
        return F.expr(AS_OF) - F.make_dt_interval(d.cast("int"))

    assert value(lambda d: D.freshness(posted(d), F.expr(AS_OF)), d=days) == want


@pytest.mark.parametrize("text,want", [
    ("3-5 years experience", 3), ("minimum 5 years", 5), ("30 years experience", None),
    ("at least 2 yrs, 10+ years of experience", 2), ("requires 0 years", 0), ("", None),
    ("99999999999999999999 years experience", None),
])
def test_min_years(value, text, want):
    assert value(filters.min_years, t=text) == want


@pytest.mark.parametrize("text,want", [
    ("Operations AssociateCocoon · Remote, Arizona · Posted on Feb 7, 2026",
     ("Operations Associate", "Cocoon", "Remote, Arizona")),
    ("Chief of Staff · Posted on Jan 3", ("Chief of Staff", "", "")),
    ("Plain title", ("Plain title", "", "")),
])
def test_split_link_text(value, text, want):
    assert tuple(value(C.split_link_text, t=text)) == want


@pytest.mark.parametrize("text,want", [
    ("SnapMagic (S15) • helps (about 1 month ago)", "SnapMagic (S15)"),
    ("Name (W21)", "Name (W21)"), ("Just a name", "Just a name"), ("  ", "Unknown"),
])
def test_company_batch(value, text, want):
    assert value(C.company_batch, t=text) == want


@pytest.mark.parametrize("text,want", [
    ("fulltimeSan Francisco, CA, US", "San Francisco, CA, US"), ("contract ,Rome, · x", "Rome"),
    ("we are REMOTE", "Remote"), ("nothing", ""),
])
def test_location_jobtype(value, text, want):
    assert value(C.location_jobtype, t=text) == want


@pytest.mark.parametrize("text,want", [
    ('{"score": 7}', 7.0), ('```json\n{"score": 8.5}\n```', 8.5), ('json {"score": 1}', 1.0),
    ('{"reasoning": "x"}', None), ("not json", None), ('{"score": null}', None), ("", None),
])
def test_parse_response(value, text, want):
    got = value(parse_response, t=text)
    assert (got and got["score"]) == want


def test_caps_and_bands(value):
    titles = {"VP Finance": 4, "Senior Director": 3, "Senior Analyst": 6, "Chief of Staff": None,
              "Staff Engineer": 4, "Manager": None}
    for title, cap in titles.items():
        assert value(seniority_cap, t=title) == cap
    for score, band in {9.0: "perfect", 8.5: "good", 3.0: "weak", 2.9: "none"}.items():
        assert value(score_band, s=score) == band


def test_completeness_boundaries(spark):
    rows = [("x" * 100, 0.0, None, "", None, None), ("x" * 101, None, 1.0, "a", "b", "c")]
    df = spark.createDataFrame(rows, "description string, salary_min double, salary_max double, "
                               "experience_required string, date_posted string, company_industry string")
    assert [r[0] for r in df.select(X.completeness()).collect()] == [2, 8]


def test_salary_filter(spark):
    rows = [(None, None), (60000.0, 80000.0), (60000.0, None), (None, 69999.0)]
    df = spark.createDataFrame(rows, "salary_min double, salary_max double")
    assert [r[0] for r in df.select(filters.salary_ok()).collect()] == [True, True, False, False]
