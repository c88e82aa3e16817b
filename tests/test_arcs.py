from waylark.operators import geometry


def test_arc_from_radials(spark):
    charts = spark.createDataFrame([(1, 11.0, 13.0, "JB")], "chart int, radius_nm double, outer_nm double, common_fix string")
    radials = spark.createDataFrame([(1, 340.0, 160.0, ["ADLOV 1E", "PIMOK 1E", "X 1E"]), (1, 30.0, None, ["ADLOV 1E"]), (1, 10.0, None, ["ADLOV 1E"]), (1, 300.0, None, ["PIMOK 1E"])], "chart int, deg double, inbound_deg double, procedures array<string>")
    rows = geometry.arc_legs(charts, radials).orderBy("procedure", "sequence").collect()
    got = [(r["path_terminator"], r["from_fix"], r["fix"], r["course_deg"], r["distance_nm"], r["turn"]) for r in rows if r["procedure"] == "ADLOV 1E"]
    assert got == [
        ("IF", None, "ADLOV", None, None, None), ("TF", "ADLOV", "D030M", None, None, None), ("CI", "D030M", None, 210.0, 2.0, None),
        ("AF", None, "D010K", None, 3.8, "L"), ("AF", "D010K", "D340K", None, 5.8, "L"), ("TF", "D340K", "JB", 160.0, None, None),
    ]
    assert [r["turn"] for r in rows if r["procedure"] == "PIMOK 1E" and r["path_terminator"] == "AF"] == ["R"]
    assert {r["procedure"] for r in rows} == {"ADLOV 1E", "PIMOK 1E"}
