"""Plans of what is drawn from which source."""

from pyspark.sql import functions as F

from waylark.operators import render

RECORD = "airport string, ordinal int, procedure_name string, runway string, sequence string, path_terminator string, fix string, theta_deg double, recommended_navaid string"


def plans(spark, packages, procedures, records):
    p = spark.createDataFrame(packages, "airport string, package int, runway string, names array<string>, mode string")
    o = spark.createDataFrame(procedures, "airport string, package int, ordinal int, name string, runway string, confidence double, n_legs int")
    a, b = render.render_plan(p, o, spark.createDataFrame(records, RECORD), ["airport"], "package")
    return {r.package: r for r in a.collect()}, sorted(b.collect(), key=lambda r: (r.package, r.position))


RECORDS = [
    ("A", 3, "ADLO1E", "RW16", "020", "CF", "X", 155.0, "VJB"), ("A", 1, "ADLO1E", "RW16", "010", "CI", "", None, None), ("A", 2, "ADLO1E", "RW34", "010", "IF", "Q", None, None),
    ("A", 4, "PIMOK 1J", "RW16", "010", "IF", "P", None, None), ("B", 5, "ADLO1E", "RW16", "010", "IF", "B", None, None),
]


def test_records_where_they_cover(spark):
    packages = [("A", 1, "RWY 16", ["PIMOK 1J"], None), ("A", 2, "RWY16", [], "JEPPESEN_424"), ("A", 3, "RWY16", [], "ai"), ("A", 4, None, [], "AUTO"), ("A", 5, "RWY07", [], "AUTO"), ("C", 6, None, None, None)]
    procedures = [("A", 1, 1, "Adlov 1E", "RWY16", 0.99, 4), ("A", 1, 2, "OTHER NAME", None, 0.3, 2), ("A", 2, 1, "NONE 1A", None, None, 3), ("A", 3, 1, "ADLOV 1E", None, 0.5, 5), ("A", 5, 1, "ADLOV 1E", None, 0.5, 5)]
    made, parts = plans(spark, packages, procedures, RECORDS)
    assert [(made[i].source, made[i].record_procedures, made[i].record_legs) for i in range(1, 7)] == [("HYBRID", 2, 3), ("AI", 0, 0), ("AI", 0, 0), ("JEPPESEN_424", 3, 4), ("AI", 0, 0), ("AI", 0, 0)]
    assert made[1].warnings[0].startswith("1 procedures") and made[2].warnings == [render.NO_RECORDS] and made[5].warnings == [] and made[3].mode == "AI"
    one = [p for p in parts if p.package == 1]
    assert [(p.name, p.source, p.n_legs, p.confidence) for p in one] == [("Adlov 1E", "JEPPESEN_424", 2, 0.99), ("OTHER NAME", "AI", 2, 0.3), ("PIMOK 1J", "JEPPESEN_424", 1, 0.98)]
    assert [(x.sequence, x.from_fix, x.to_fix, x.remarks) for x in one[0].legs] == [(10.0, None, None, "RDL155 VJB"), (20.0, None, "X", "RDL155 VJB")]
    assert [(p.name, p.runway) for p in parts if p.package == 4] == [("ADLO1E", "RW16"), ("ADLO1E", "RW34"), ("PIMOK 1J", "RW16")]


def test_signatures(spark):
    names = ["ADLOV 1E", "ADLO1E", "adlov1e", "TIARA2A", "BEKOL SID", " a  b ", "", None, "AB1C"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(render.signature(F.col("n")).alias("s")).collect()]
    assert got == ["ADLO|1E", "ADLO|1E", "ADLO|1E", "TIAR|2A", "BEKOL SID", "A B", None, None, "AB1C"]
    runways = [r.s for r in spark.createDataFrame([("RWY 16/34",), ("16",), (None,), ("rw07c",)], "n string").select(render.runway_key(F.col("n")).alias("s")).collect()]
    assert runways == ["RW16", "16", "", "RW07C"]
