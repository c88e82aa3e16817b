from pyspark.sql import functions as F

from waylark.operators import support

PAGES = "page_no long, support string, text string"


def fields(spark, rows, **more):
    return {(r["page_no"], r["field"]): r["values"] for r in support.support_fields(spark.createDataFrame(rows, PAGES), **more).collect()}


def test_fields_of_each_kind(spark):
    got = fields(spark, [
        (1, "AIRPORT_METADATA", "WMKJ AD 2.1 NAME\n WMKJ - SENAI\tINTERNATIONAL WMKJ AD 2.2  013826N 1034011E Elevation/Reference temperature 127 FT / 32 C Magnetic variation 0 E; x"),
        (2, "RUNWAY_DATA", "RWY 16 160.45° 3800 x 45 M Asphalt RWY34 16 PCR 850 / F / B / X / T 013924.91N 1033948.87E THR 135.0 FT"),
        (3, "RUNWAY_OPERATIONAL_DATA", "16 THRESHOLD 3800 4100 3860 3800; PAPI LEFT 3 DEG; none"),
        (4, "AIRSPACE_COMMUNICATION", "JOHOR CTR circle; TRANSITION ALTITUDE: 11000 FT. TWR JOHOR TOWER 118.1 MHz"),
        (5, "NAVAID", "AIP VJB 112.7 MHZ CH 74X NIL VJB; NDB JB 234 KHZ"),
        (6, "FLIGHT_PROCEDURES", "DME Arrival Procedures via R-155/335° VJB VOR/DME. Note: cross 11 DME VJB at 2500 FT or above; 160°"),
    ])
    assert got[1, "icao"] == ["WMKJ"] and got[1, "name"] == ["WMKJ - SENAI INTERNATIONAL"] and got[1, "arp"] == ["013826N 1034011E"]
    assert got[1, "elevation"] == ["127 FT"] and (1, "traffic") not in got
    assert got[2, "bearings"][0] == "160.45°"
    assert got[2, "dimensions"] == ["3800 x 45 M"] and got[2, "surfaces"] == ["Asphalt"] and got[2, "runways"] == ["RWY16", "RWY34", "16"]
    assert got[2, "coordinates"] == ["013924.91N 1033948.87E"] and "135.0 FT" in got[2, "elevations"]
    assert got[3, "distances"] == ["16 THRESHOLD 3800 4100 3860 3800"] and got[3, "lighting"] == ["PAPI LEFT 3 DEG"]
    assert got[4, "transition_altitude"] == ["11000 FT"] and got[4, "frequencies"] == ["TWR JOHOR TOWER 118.1 MHz"]
    assert got[5, "idents"] == ["VJB", "MHZ", "CH", "NDB", "JB", "KHZ"] and got[5, "channels"] == ["CH 74X"] and got[5, "frequencies"] == ["112.7 MHZ", "234 KHZ"]
    assert got[6, "radials"][0] == "R-155/335°"
    assert got[6, "minimum_altitudes"] == ["2500 FT"] and got[6, "level_restrictions"] == ["cross 11 DME VJB at 2500 FT or above"]


def test_samples_and_pages_without_a_kind(spark):
    got = fields(spark, [(1, "OBSTACLE", " x  y " * 1000), (2, None, "text"), (3, "NAVAID", None), (4, "NAVAID", " a b")])
    assert set(got) == {(1, "sample"), (3, "sample"), (4, "sample")}
    assert len(got[1, "sample"][0]) == 900 and got[3, "sample"] == [""] and got[4, "sample"] == ["a b"]
    assert support.support_fields(spark.createDataFrame([], PAGES)).count() == 0


def test_pages_that_packages_refer_to(spark):
    packages = spark.createDataFrame([(1, 7, "APPROACH", "APPROACH", "ILS_LOC"), (2, 7, "SID", "DEPARTURE", "RNAV"), (3, 7, "STAR", "ARRIVAL", "DME_ARC"), (4, 8, "SID", None, None)], "package_id long, file long, package string, category string, navigation string")
    kinds = [(9, "NAVAID"), (3, "NAVAID"), (3, "NAVAID"), (1, "CHART_INDEX"), (4, "FLIGHT_PROCEDURES"), (5, "RUNWAY_OPERATIONAL_DATA"), (6, "OBSTACLE"), (2, None)]
    pages = spark.createDataFrame([(7, n, k) for n, k in kinds], "file long, page_no long, support string")
    got = {(r["package_id"], r["key"]): r["pages"] for r in support.package_references(packages, pages, ["file"]).collect()}
    assert got == {(1, "navaid"): [3, 9], (1, "chartIndex"): [1], (1, "runwayOperationalData"): [5], (2, "chartIndex"): [1], (3, "chartIndex"): [1], (3, "navaid"): [3, 9], (3, "flightProcedures"): [4]}


def test_wanted_kinds_without_a_category(spark):
    row = spark.range(1).select(support.wanted_kinds(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("VOR")).alias("w")).first()
    assert row["w"] == [*support.WANTED, "NAVAID", "FLIGHT_PROCEDURES"]
