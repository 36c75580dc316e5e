"""Study and report operators on hand-made edge cases."""

import pytest

from pharmalith.operators import adverse, trials
from tests.conftest import rows


@pytest.fixture(scope="module")
def world(spark):
    studies = spark.createDataFrame(
        [("N1", "One", "RECRUITING", "2024-01-01"), ("N2", "", "RECRUITING", "2024-03-01"),
         ("N3", None, "COMPLETED", "2024-04-01"), ("N4", "Four", "RECRUITING", None),
         ("N5", "Five", "RECRUITING", "2024-02-01"), (None, "No id", "RECRUITING", "2024-05-01")],
        "nct_id string, brief_title string, overall_status string, last_update string",
    )
    sites = spark.createDataFrame(
        [("N1", "Roma", "Italy", "RECRUITING"), ("N1", "Roma", "Italy", "RECRUITING"), ("N1", "Bari", "Italy", "COMPLETED"),
         ("N1", "Alba", "Italy", "RECRUITING"), ("N2", None, "Italy", "RECRUITING"), ("N2", "", "Italy", None),
         ("N3", "Roma", "Italy", "RECRUITING"), ("N4", "Roma", "Italy", None), ("N5", "Wien", "Austria", "RECRUITING")],
        "nct_id string, city string, country string, status string",
    )
    conditions = spark.createDataFrame(
        [(n, c) for n in ("N1", "N2", "N3", "N4", "N5", None) for c in ("COVID-19", "Long COVID-19")],
        "nct_id string, condition string",
    )
    interventions = spark.createDataFrame(
        [("N1", "Nirmatrelvir"), ("N2", "nirmatrelvir/ritonavir"), ("N2", "Placebo"), ("N5", "Nirmatrelvir")],
        "nct_id string, intervention string",
    )
    return studies, conditions, interventions, sites


def find(spark, world, intervention, condition, **options):
    studies, conditions, interventions, sites = world
    asked = spark.createDataFrame([(1, intervention, condition)], "request_id int, intervention string, condition string")
    options.setdefault("sites", sites)
    hits = trials.matching_studies(asked, studies, conditions, interventions, **options)
    return hits, sorted(r.nct_id for r in hits.collect())


@pytest.mark.parametrize(
    "intervention, condition, match, expected",
    [
        ("NIRMATRELVIR", None, "contains", ["N1", "N2"]),
        ("nirmatrelvir", None, "exact", ["N1"]),
        (None, "covid", "contains", ["N1", "N2", "N4"]),
        (None, "covid", "exact", []),
        ("placebo", "covid-19", "contains", ["N2"]),
        ("placebo", "covid-19", "exact", ["N2"]),
        ("placebo", "flu", "contains", []),
        (None, None, "contains", []),
        ("", "", "contains", []),
    ],
)
def test_matching(spark, world, intervention, condition, match, expected):
    assert find(spark, world, intervention, condition, match=match)[1] == expected


def test_without_country(spark, world):
    assert find(spark, world, None, "covid", sites=None)[1] == ["N1", "N2", "N4", "N5"]


def test_latest_and_fallbacks(spark, world):
    hits, _ = find(spark, world, None, "covid")
    top = trials.latest(hits, world[0], 2)
    assert rows(top, "rank", "nct_id", "title", "status", "url") == [
        (1, "N2", "N/A", "RECRUITING", "https://clinicaltrials.gov/study/N2"),
        (2, "N1", "One", "RECRUITING", "https://clinicaltrials.gov/study/N1"),
    ]
    assert rows(trials.latest(hits, world[0], 9), "rank", "nct_id")[-1] == (3, "N4")
    assert rows(trials.recruiting_cities(top, world[3]), "nct_id", "city") == [("N1", "Alba"), ("N1", "Roma")]


def test_site_summary(spark, world):
    studies, _, _, sites = world
    assert rows(trials.site_status_text(studies, sites), "nct_id", "n_sites", "summary") == [
        ("N1", 4, "1 COMPLETED, 3 RECRUITING"),
        ("N2", 2, "1 RECRUITING, 1 UNKNOWN"),
        ("N3", 1, "1 RECRUITING"),
        ("N4", 1, "1 UNKNOWN"),
        ("N5", 0, ""),
    ]
    assert ("N2", "N/D") in rows(trials.status_cities(studies, sites))


def test_totals_include_zero(spark, world):
    asked = spark.createDataFrame(
        [(1, None, "covid"), (2, None, "flu")], "request_id int, intervention string, condition string"
    )
    studies, conditions, interventions, _ = world
    hits = trials.matching_studies(asked, studies, conditions, interventions)
    assert rows(trials.total_studies(asked, hits)) == [(1, 4), (2, 0)]


def test_reactions_count_reports_once(spark):
    reports = spark.createDataFrame(
        [("1", ["ASPIRIN", "aspirin"], ["Rash", "Rash", "Nausea"]), ("2", ["Aspirin"], ["Rash", None]),
         ("3", ["OTHER"], ["Rash"]), ("4", None, ["Rash"]), ("5", ["ASPIRIN"], None), ("6", ["ASPIRIN"], ["Ache"])],
        "report_id string, substances array<string>, reactions array<string>",
    )
    asked = spark.createDataFrame([(1, "aspirin"), (2, "none")], "request_id int, substance string")
    got = adverse.top_reactions(asked, reports, 2)
    assert rows(got, "request_id", "rank", "term", "count") == [(1, 1, "Rash", 2), (1, 2, "Ache", 1)]
