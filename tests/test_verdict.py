"""Worked verdicts."""

import pytest

from quillcheck.operators import verdict

ENTRY = "id bigint, key string, type string, title string, author string, year string, venue string, doi string, arxiv_id string"
RECORD = "source string, rec_id string, pos bigint, title string, authors array<string>, year string, venue string, doi string, arxiv_id string, citation_count bigint, is_retracted boolean"


def named(n):
    return f"deep{n} methods{n} checks{n} lists{n} number{n}"



def entry(n, title=None, author="Smith, A.", year="2015", doi="", kind="article", venue=""):
    return (n, f"k{n}", kind, title or named(n), author, year, venue, doi, "")


def rec(n, source="dblp", title=None, authors=("A. Smith",), year="2015", venue=None, doi=None, retracted=False):
    return (source, f"{source}{n}", n, title or named(n), list(authors), year, venue, doi, None, None, retracted)


CASES = [
    # phantom DOI, confirmed and clean elsewhere
    (entry(1, doi="10.1234/no"), [rec(1)], "WARN"),
    # phantom DOI, title hit with another first author
    (entry(2, doi="10.1234/no2"), [rec(2, authors=("B. Jones",))], "FAIL"),
    # no identifier, another first author, years apart
    (entry(3), [rec(3, authors=("B. Jones",), year="2010")], "FAIL"),
    # no identifier, another first author, years alike
    (entry(4), [rec(4, authors=("B. Jones",))], "FAIL"),
    # crossref confirmed and retracted
    (entry(5, doi="10.1234/r5"), [rec(5, "crossref", doi="10.1234/r5", retracted=True)], "FAIL"),
    # retraction of an unconfirmed source beside a confirmed clean one
    (entry(6, doi="10.1234/r6"), [rec(6, "crossref", authors=("B. Jones",), doi="10.1234/r6", retracted=True), rec(6, "s2")], "OK"),
    (entry(7, year="2016"), [rec(7)], "OK"),
    (entry(8, year="2017"), [rec(8)], "WARN"),
    (entry(9, year="2020"), [rec(9)], "WARN"),
    # confirmed, but the entry has no venue and the record has
    (entry(10), [rec(10, venue="Nature")], "WARN"),
    (entry(11, kind="misc"), [], "WARN"),
    (entry(12, kind="misc", doi="10.1234/no12"), [], "FAIL"),
    (entry(13), [], "FAIL"),
]


@pytest.fixture(scope="module")
def folded(spark):
    entries = spark.createDataFrame([e for e, _, _ in CASES], ENTRY)
    catalog = spark.createDataFrame([r for _, rs, _ in CASES for r in rs], RECORD)
    return {r["id"]: r for r in verdict.verify(entries, catalog).collect()}


@pytest.mark.parametrize("case", CASES, ids=lambda c: str(c[0][0]))
def test_overall(folded, case):
    assert folded[case[0][0]]["overall"] == case[2]


def test_checks(folded):
    assert [c["field"] for c in folded[1]["checks"]] == ["phantom_doi", "title", "authors", "year", "hallucination_risk"]
    assert folded[9]["checks"][2]["detail"].endswith("(downgraded: title+author confirmed)")
    assert folded[13]["sources_tried"] == ["dblp", "s2", "openalex"]
