"""Packages by stages: index, torn numbers, headings, what follows a chart; all cases in one run, each a document of its own."""

import pytest
from pyspark.sql import functions as F

from waylark.operators import packages

PAGE = "doc string, page_no int, text string, role string, category string, navigation string, runway string, title string, names array<string>, confirmed string, page_no_text string, number string, source_file string"
ITEM = f"doc string, ordinal int, {packages.ITEM[7:-1].replace(': ', ' ')}"


def page(doc, no, text, role="CHART", number=None, category="DEPARTURE", navigation="RNAV", runway=None, confirmed=None, file=None):
    return (doc, no, text, role, category, navigation, runway, None, None, confirmed, number, number, file)


def item(doc, ordinal, no, name, package="SID", category="DEPARTURE", navigation="RNAV", runway="RWY02C", names=(), tabular_no=None):
    return (doc, ordinal, no, name, package, category, navigation, runway, list(names), tabular_no is not None, tabular_no)


SID = "STANDARD DEPARTURE CHART"
PAGES = [
    # lettered numbers with decimal sub-pages; "MINIMA" and "TABULAR DESCRIPTION" on a chart make it no table only
    page("lettered", 2, "CHARTS", "CHART_INDEX", "AD 2-WSSS-SID-1", "UNKNOWN"),
    page("lettered", 3, f"{SID}\nMINIMA", number="AD 2-WSSS-SID-1"),
    page("lettered", 4, "DESCRIPTIONS", "TABULAR_DESCRIPTION", "AD 2-WSSS-SID-1.1"),
    page("lettered", 5, f"{SID}\nTABULAR DESCRIPTION", number="AD 2-WSSS-SID-2"),
    page("lettered", 6, "MINIMA", "OTHER", "AD 2-WSSS-SID-2.1"),
    page("lettered", 7, "x", number="AD 2-WSSS-SID-11"),
    # one number twice, and one that no page has
    page("twice", 1, SID, number="AD 2-AAAA-6-1"), page("twice", 2, SID, number="AD 2-AAAA-6-1"),
    # torn numbers: the longest item that the text holds; support pages are left alone
    page("torn", 1, "AD 2-VHHH-IAC-0\n6\nA"), page("torn", 2, "AD 2-VHHH-IAC-0 6", "SUPPORT"), page("torn", 3, "see AD 2-VHHH-IAC-06"),
    # headings: a great label of a fix is no name
    page("headed", 1, f"VAMOS\n{SID}\nAD 2-ZZZZ-6-1", confirmed="VAMOS FOUR DEPARTURE", runway="RWY16R"), page("headed", 2, f"VAMOS\nUTIBO\n{SID}\nAD 2-ZZZZ-6-3", confirmed="RUTAS FOUR DEPARTURE", runway="RWY16R"),
    page("headed", 3, f"{SID}\nAD 2-ZZZZ-6-2", confirmed="VAMOS 4", runway="RWY16R"), page("headed", 4, f"AERODROME CHART {SID}\nAD 2-ZZZZ-6-9", confirmed="OTHER 1A"), page("headed", 5, "A CHART\nAD 2-ZZZZ-6-8", confirmed="OTHER 1A"),
    page("headed", 6, f"{SID} without a number", confirmed="OTHER 1A"), page("headed", 7, f"{SID}\nAD 2-ZZZZ-6-7", "TABULAR_DESCRIPTION", confirmed="OTHER 1A"),
    # lettered charts without an index: the number is the key, or the file if all its charts are of one kind
    page("file", 1, f"AD 2-RJTT-SID-1\n{SID}", file="a.pdf"), page("file", 2, f"AD 2-RJTT-SID-2\n{SID}", file="a.pdf"), page("file", 3, f"AD 2-RJTT-SID-3\n{SID}", file="b.pdf"), page("file", 4, "AD 2-RJTT-STAR-4\nSTANDARD ARRIVAL CHART", category="ARRIVAL", file="b.pdf"), page("file", 5, f"AD 2-RJTT-SID-5\n{SID}"),
    # what follows a chart: three pages, agreeing, in sequence, each once
    page("next", 1, SID, number="AD 2-AAAA-6-1", runway="RWY16"), page("next", 2, "t", "TABULAR_DESCRIPTION", "AD 2-AAAA-6-2", runway="RWY16"), page("next", 3, "t", "WAYPOINT_COORDINATES", "AD 2-AAAA-6-3", runway="RWY34"), page("next", 4, "t", "MINIMA_TABLE", "AD 2-AAAA-6-4"), page("next", 5, "t", "MINIMA_TABLE", "AD 2-AAAA-6-5"),
    page("next", 11, SID, number="AD 2-AAAA-28", runway="RWY16"), page("next", 12, "t", "TABULAR_DESCRIPTION", "AD 2-AAAA-28-1", runway="RWY16"), page("next", 13, "t", "TABULAR_DESCRIPTION", "AD 2-AAAA-29", runway="RWY16"), page("next", 14, "t", "SUPPORT"),
    page("nulls", 1, None, None, None, None, None),
]
ITEMS = [
    item("lettered", 1, "AD 2-WSSS-SID-1", "RNAV SID ANITO 7A", names=["ANITO 7A"]), item("lettered", 2, "AD 2-WSSS-SID-2", "RNAV SID VMR 6A", names=["VMR 6A"]), item("lettered", 3, "AD 2-WSSS-ADC-1", "AERODROME CHART", "AERODROME", "AERODROME"),
    item("twice", 1, "AD 2-AAAA-6-1", "A", names=["A 1A"]), item("twice", 2, "AD 2-AAAA-6-5", "A", names=["A 1A"]), item("twice", 3, "AD 2-AAAA-6-6", "B", names=["B 1A"]),
    item("torn", 1, "AD 2-VHHH-IAC-06", "six", names=["SIX 1A"]), item("torn", 2, "AD 2-VHHH-IAC-06A", "six a", names=["SIX 1B"]),
    item("next", 1, "AD 2-AAAA-6-1", "N", runway="RWY16", names=["N 1A"]), item("next", 2, "AD 2-AAAA-28", "M", runway="RWY16", names=["M 1A"]),
]


@pytest.fixture(scope="module")
def found(spark):
    pages, items = spark.createDataFrame(PAGES, PAGE), spark.createDataFrame(ITEMS, ITEM)
    made, claims = packages.group_pages(pages, items, ["doc"])
    out = {}
    for r in made.orderBy("doc", "package_no").collect():
        out.setdefault(r.doc, []).append(r)
    return out, {(r.doc, r.page_no): r.stage for r in claims.collect()}


def test_sub_pages_belong_to_their_number(found):
    one, two = found[0]["lettered"]
    assert (one.chart_pages, one.tabular_pages, one.pages, one.runway, one.navigation) == ([3], [4], [3, 4], "RWY02C", "RNAV")
    assert "ANITO 7A" in one.names and not one.review and one.chart_no == "AD 2-WSSS-SID-1"
    assert (two.chart_pages, two.tabular_pages, two.minima_pages) == ([5], [5], [6]) and two.name == "RWY02C RNAV SID VMR 6A"
    assert ("lettered", 2) not in found[1] and ("lettered", 7) not in found[1]


def test_doubtful_numbers_ask_for_review(found):
    a, b = found[0]["twice"]
    assert a.review and a.chart_pages == [1, 2] and a.unmatched == ["AD 2-AAAA-6-5"]
    assert b.review and b.pages == [] and b.unmatched == ["AD 2-AAAA-6-6"] and b.confidence == 0.98


def test_torn_numbers_by_the_longest(found):
    six, six_a = found[0]["torn"]
    assert six_a.pages == [1] and six.pages == [3] and six.review and six_a.unmatched == []
    assert {k: v for k, v in found[1].items() if k[0] == "torn"} == {("torn", 1): "FRAGMENT", ("torn", 3): "FRAGMENT"}


def test_headings_make_packages(found):
    vamos, rutas = found[0]["headed"]
    assert (vamos.pages, rutas.pages) == ([1, 3], [2]) and vamos.source == "HEADER" and vamos.confidence == 0.72 and vamos.review
    assert "VAMOS4" in vamos.key and "RUTAS4" in rutas.key


def test_numbers_and_files_as_keys(found):
    assert [(p.key, p.pages) for p in found[0]["file"]] == [("SOURCE_FILE:A.PDF", [1, 2]), ("AD 2-RJTT-SID-3", [3]), ("AD 2-RJTT-STAR-4", [4]), ("AD 2-RJTT-SID-5", [5])]


def test_tables_that_follow(found):
    n, m = found[0]["next"]
    assert (n.pages, m.pages) == ([1, 2, 4], [11, 12]) and n.review
    assert found[1]["next", 2] == "SEQUENCE" and ("next", 5) not in found[1] and ("next", 13) not in found[1]


def test_pages_of_nothing(found, spark):
    assert "nulls" not in found[0]
    pages, items = spark.createDataFrame([], PAGE), spark.createDataFrame([], ITEM)
    made, claims = packages.group_pages(pages, items, ["doc"])
    assert made.count() == 0 and claims.count() == 0


def test_numbers_in_sequence(spark):
    rows = [("AD 2-AAAA-6-1", "AD 2-AAAA-6-4", True), ("AD 2-AAAA-6-1", "AD 2-AAAA-6-5", False), ("AD 2-AAAA-6-4", "AD 2-AAAA-6-1", False), ("AD 2-AAAA-28", "AD 2-AAAA-28-1", True), ("AD 2-AAAA-28", "AD 2-AAAA-29", False), ("AD 2-AAAA-SID-1", "AD 2-AAAA-SID-1.1", True), ("AD 2-AAAA-6-1", "AD 2-BBBB-6-2", False)]
    got = spark.createDataFrame(rows, "a string, b string, e boolean").select(packages.follows(F.col("a"), F.col("b")).alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)
