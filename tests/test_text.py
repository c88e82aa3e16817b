from pyspark.sql import functions as F

from waylark.functions import geo
from waylark.functions import text as tx
from waylark.functions import tolerance as tol
from waylark.operators import records


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def each(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_chart_numbers_by_dialect_and_again(spark):
    raw = ["AD 2-WMKJ-8-3", "A D 2 - W M K J - 6 - 1", "AD-2-WSSS-SID-1.1", "AD 2-VHHH-IAC-04A", "RKSI AD CHART 2 - 28 - 1", "RKSI AD CHART 2 - 28", "RJTT AD2.24-SID-27", "See AD chart 2-74", None, ""]
    expected = ["AD 2-WMKJ-8-3", "AD 2-WMKJ-6-1", "AD 2-WSSS-SID-1.1", "AD 2-VHHH-IAC-04A", "AD 2-RKSI-28-1", "AD 2-RKSI-28", "AD 2-RJTT-SID-27", None, None, None]
    once = each(spark, tx.chart_no, raw)
    assert once == expected
    assert each(spark, tx.chart_no, once) == expected


def test_split_page_numbers(spark):
    raw = ["AD 2-WMKJ-6-1 2", "AD 2-WMKJ-6-12 3", "AD 2-WMKJ-6-1 23", "AD 2-WMKJ-6-12 34", "AD 2-WMKJ-6-1 2 of 3", "AD 2-WMKJ-0-1"]
    assert each(spark, tx.chart_no_numeric, raw) == ["AD 2-WMKJ-6-12", None, "AD 2-WMKJ-6-1", "AD 2-WMKJ-6-12", "AD 2-WMKJ-6-12", None]


def test_templates_of_packages(spark):
    rows = [("STAR", None, "RNAV", None), ("STAR", None, "UNKNOWN", None), ("SID", None, "radar", None), ("SID", None, "RNAV", None), (None, "DEPARTURE", "VOR", None), ("OTHER", "ARRIVAL", "DME_ARC", None), ("APPROACH", None, "ILS_LOC", None), ("APPROACH", None, "RNP_AR", None), ("APPROACH", None, "NDB", None), (None, None, None, None), ("STAR", None, "RNAV", "own_v2")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, c string, n string, o string")
    got = [r["x"] for r in df.select("i", tx.template_id(F.col("p"), F.col("c"), F.col("n"), F.col("o")).alias("x")).orderBy("i").collect()]
    assert got == ["rnav_star_v1", "generic_procedure_v1", "conventional_sid_v1", "rnav_sid_v1", "conventional_sid_v1", "dme_arc_star_v1", "ils_loc_approach_v1", "rnp_ar_approach_v1", "generic_procedure_v1", "generic_procedure_v1", "own_v2"]


def test_candidates_of_charts_and_support_pages(spark):
    text = "ADLOV 1E XADLOV 1E rwy 16l 16 NM 160° +3000 ft 210 KIAS RNAV 1 turn left\nMSA 25 NM\rTWR 118.1 ILS required aTWR\n013812.5N 0103401.5E TORA 3800 R-160/330"
    df = spark.createDataFrame([(1, text)], "i int, t string")
    got = lambda support: {(r["kind"], r["value"]) for r in df.select(F.explode(tx.typed_candidates(F.col("t"), F.lit(support))).alias("c")).select("c.*").collect()}
    assert got(False) == {("procedure_name", "ADLOV 1E"), ("runway", "RWY 16L"), ("distance", "16 NM"), ("distance", "25 NM"), ("course", "160°"), ("altitude", "+3000 FT"), ("speed", "210 KIAS"), ("navigation_spec", "RNAV 1"), ("holding", "TURN LEFT"), ("msa", "MSA 25 NM"), ("frequency", "TWR 118.1"), ("equipment_requirement", "ILS")}
    assert got(True) == {("frequency", "TWR 118.1"), ("equipment_requirement", "ILS"), ("equipment_requirement", "ILS REQUIRED ATWR"), ("note", "TORA 3800 R-160/330"), ("note", "160° +3000 FT 210 KIAS RNAV 1 TURN LEFT"), ("waypoint", "013812.5N 0103401.5E")}


def test_procedure_names(spark):
    names = ["VAMOS FOUR DEPARTURE", "TIARA TWO A DEPARTURE", "LARIT 1T RWY 07C", "vamos4", "BEKOL SID", "", None]
    assert each(spark, tx.procedure_id, names) == ["VAMOS4", "TIARA2A", "LARIT1T", "VAMOS4", None, None, None]
    assert each(spark, tx.route_code, names) == ["VAMOS4", "TIAR2A", "LARI1T", "VAMOS4", None, None, None]
    assert each(spark, tx.transition_id, ["TATEYAMA TRANSITION", "DRAKY TRANSITION", "TWO WORDS", None]) == ["TATEY", "DRAKY", None, None]


def test_truncated_names_match(spark):
    assert one(spark, tx.procedure_ids_match(F.col("a"), F.col("b")), a="TIAR2A", b="TIARA2A")
    assert not one(spark, tx.procedure_ids_match(F.col("a"), F.col("b")), a="TIAR2A", b="TIARA3A")


def test_word_boundaries_are_ascii(spark):
    assert each(spark, tx.navigation_words, ["AN ILS APPROACH", "DETAILS", "LOCATION", "ILS OR LOC", "éILS"]) == ["ILS", "UNKNOWN", "UNKNOWN", "ILS_LOC", "ILS"]


def test_decoding(spark):
    plain = "STANDARD DEPARTURE"
    coded = "".join(chr(ord(c) - 0x1D) if 0x20 <= ord(c) <= 0x5A else c for c in plain)
    assert each(spark, tx.decode_shifted, [coded, "plain\n" + coded, "plain"]) == [plain, "plain\n" + plain, "plain"]
    assert each(spark, tx.text_quality, ["", "ok text", coded, "����"]) == ["EMPTY", "USABLE", "DECODED", "SUSPECT"]


def test_rounding_goes_up_at_the_half(spark):
    assert [one(spark, tol.round_half_up(F.col("v"), 1), v=v) for v in (0.25, -0.25, 1.24)] == [0.3, -0.2, 1.2]


def test_tolerances_with_nulls(spark):
    null = F.lit(None).cast("double")
    assert one(spark, tol.distance_simple(null, null), v=1)
    assert not one(spark, tol.distance_simple(F.lit(1.0), null), v=1)
    assert one(spark, tol.course_circular(F.lit(359.5), F.lit(0.2)), v=1)
    assert not one(spark, tol.course_linear(F.lit(359.5), F.lit(0.2)), v=1)
    assert one(spark, tol.distance_graph(F.lit(100.0), F.lit(101.9)), v=1)


def test_great_circle_identities(spark):
    p = geo.destination(F.lit(103.7), F.lit(1.6), F.lit(77.0), F.lit(40.0))
    assert abs(one(spark, geo.distance_nm(F.lit(103.7), F.lit(1.6), p["lon"], p["lat"]), v=1) - 40) < 1e-6
    assert abs(one(spark, geo.bearing_deg(F.lit(103.7), F.lit(1.6), p["lon"], p["lat"]), v=1) - 77) < 1e-6
    assert abs(one(spark, geo.dms(F.col("v")), v="1034015.5E") - (103 + 40 / 60 + 15.5 / 3600)) < 1e-9


def test_altitudes(spark):
    kinds = each(spark, lambda c: records.altitude(c)["kind"], ["+03500", "-06000", "4000", "10000 06000", "FL130", "x", None])
    assert kinds == ["AT_OR_ABOVE", "AT_OR_BELOW", "AT", "BETWEEN", "AT", None, None]
    assert each(spark, lambda c: records.altitude(c)["lower_ft"], ["+03500", "-06000", "FL130"]) == [3500.0, None, 13000.0]


def test_json_within_text(spark):
    assert each(spark, records.json_object, ['{"a":1}', 'so: {"a": 2} .', "none", None]) == ['{"a":1}', '{"a": 2}', None, None]


def test_radials_and_courses_of_support_pages(spark):
    df = spark.createDataFrame([("Via R-155/335° VJB then 160° inbound", True), ("Course 160° and 12 NM", False), (None, True)], "t string, support boolean")
    got = [[(c.kind, c.value) for c in r.c] for r in df.select(tx.typed_candidates(F.coalesce("t", F.lit("")), F.col("support")).alias("c")).collect()]
    assert got == [[("note", "R-155/335° VJB THEN 160° INBOUND")], [("course", "160°"), ("distance", "12 NM")], []]


def test_boundaries_look_back_only_where_nothing_else_can_stand(spark):
    words = ["AB12", "xAB12", "AB12x", "_AB12", "éAB12", "AB12é", "-AB12-", "AB123"]
    plain = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    df = spark.createDataFrame([(w,) for w in words], "w string").select(F.col("w").rlike(tx.ascii_bounds(r"\b[A-Z]{2}\d{2}\b")).alias("a"), F.col("w").rlike(rf"{plain}[A-Z]{{2}}\d{{2}}{plain}").alias("b"))
    assert all(r.a == r.b for r in df.collect())
