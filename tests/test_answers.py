"""Answers: renamed evidence, merged arrays, covered variants, texts of any depth, typed documents."""

from waylark.operators import answers, documents

SCHEMA = f"task int, {answers.ANSWER}"


def answer(task=1, **given):
    names = [c.strip().split(" ")[0] for c in answers._top(answers.ANSWER)]
    return (task, *[given.get(n) for n in names])


def merged(spark, existing, incoming):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    return {r.task: r for r in answers.merge_answers(make(existing), make(incoming), ["task"]).collect()}


def procedure(name, runway=None, transition=None, legs=(), confidence=0.9, ids=()):
    return (name, runway, transition, confidence, list(ids), [(i * 10, "TF", f, e) for i, (f, e) in enumerate(legs, 1)])


def test_answers(spark):
    existing = [
        answer(1, airport="RJTT", package="SID", names=["A 1A", " "], confidence=0.4, review=False, evidence=[("e1", 1, "one"), ("e2", 2, "two"), ("batch_1_e2", 3, "taken"), (None, 4, "none")], warnings=[("w", "e1")],
               procedures=[procedure("ALFA 1A RWY 16", "RWY16", legs=[("X", "e1")], ids=["e1"]), procedure("EMPTY 1A", confidence=0.5)], fixes=[("x", 1.0, 2.0, "raw", "e1"), ("Y", 3.0, 4.0, None, None)],
               table_legs=[("ALFA 1A RWY 16", 10, "X", "e1"), ("ALFA 1A RWY 16", 20, "Y", "e1")]),
        answer(2, airport="ONLY", names=["  spaced "], procedures=[procedure("P", "RWY16/34"), procedure("P", "RWY16")]),
        answer(4, procedures=[procedure("WEAK", confidence=0.1)]),
    ]
    incoming = [
        answer(1, airport=None, package="STAR", names=["B 1A", "A 1A"], confidence=0.8, review=True, evidence=[("e1", 5, "uno"), ("e2", 6, "due"), ("e3", 7, "tre")], warnings=[("w", "e1"), ("w", "e3")],
               procedures=[procedure("alfa 1a departure", "RW16", legs=[("Z", "e2"), ("W", "e3")], ids=["e2", "e3", "other"]), procedure("ALFA 1A", "RWY 16/34", "NORTH TRANSITION", legs=[("Q", "e1")])],
               fixes=[("X", None, 9.0, "", "e2"), ("N", 0.0, 0.0, "n", "e1")], table_legs=[("ALFA 1A RWY 16", 20, "Z", "e2"), ("ALFA 1A RWY 16/34", 10, "V", "e3")]),
        answer(3, airport="NEW", evidence=[("e1", 1, "kept")]),
        answer(4, procedures=[]),
    ]
    got = merged(spark, existing, incoming)
    r = got[1]
    assert (r.airport, r.package, r.names, round(r.confidence, 9), r.review) == ("RJTT", "STAR", ["A 1A", "B 1A"], 0.6, True)
    assert [e.id for e in r.evidence] == ["e1", "e2", "batch_1_e2", None, "batch_1_e1", "batch_2_e2", "e3"]
    [p] = r.procedures  # the one of both runways covers the single one, and the empty one goes
    assert (p.runway, p.transition, [(x.fix, x.source_evidence_id) for x in p.legs]) == ("RWY 16/34", "NORTH", [("Q", "batch_1_e1")])
    assert [tuple(f) for f in r.fixes] == [("X", 1.0, 9.0, "raw", "batch_2_e2"), ("Y", 3.0, 4.0, None, None), ("N", 0.0, 0.0, "n", "batch_1_e1")]
    assert [(t.name, t.sequence, t.evidence_id) for t in r.table_legs] == [("ALFA 1A RWY 16/34", 10, "e3")]
    assert [tuple(w) for w in r.warnings] == [("w", "e1"), ("w", "batch_1_e1"), ("w", "e3")]
    assert got[2].names == ["  spaced "] and len(got[2].procedures) == 2
    assert got[3].airport == "NEW" and got[3].evidence[0].id == "e1" and got[3].procedures is None
    assert [x.name for x in got[4].procedures] == ["WEAK"]


def test_ids_are_renamed_at_any_depth_and_nothing_else(spark):
    kind = "struct<id: string, text: string, deep: array<struct<evidence_id: string, deeper: array<array<struct<source_evidence_ids: array<string>, id: int>>>>>>"
    df = spark.createDataFrame([(("e1", "e1", [("e1", [[(["e1", "e2", None], 7)], []]), (None, None)]), [("e1", "new")])], f"v {kind}, pairs array<struct<id: string, new: string>>")
    v = df.select(answers.rewritten(df.v, df.schema["v"].dataType, df.pairs).alias("v")).first().v
    assert (v.id, v.text, v.deep[0].evidence_id, v.deep[0].deeper[0][0].source_evidence_ids, v.deep[0].deeper[0][0].id) == ("new", "e1", "new", ["new", "e2", None], 7)
    assert v.deep[1].evidence_id is None and v.deep[1].deeper is None


def test_texts_of_any_depth(spark):
    docs = [
        (1, '{"b":["x",{"c":"deep","rawResponseX":"no"},3,null,true,"--"],"a":"first","z":{"y":{"w":{"v":{"u":"five","t":{"s":"six"}}}}}}'),
        (2, "nope"), (3, None), (4, '"alone"'), (5, "[]"), (6, '{"GeoJSON":{"a":"no"},"parsedJson":"no","k":[[["é1"]],"é"]}'),
    ]
    got = documents.collected_texts(spark.createDataFrame(docs, "id int, doc string"), ["id"], "doc").orderBy("id", "path").collect()
    assert [(r.id, r.path, r.text) for r in got] == [(1, [0], "first"), (1, [1, 0], "x"), (1, [1, 1, 0], "deep"), (1, [2, 0, 0, 0, 1], "five"), (4, [], "alone"), (6, [1, 0, 0, 0], "é1")]


ANSWER = """{"airportIcao": 7, "packageType": null, "procedureClassification": {"packageType": "SID", "runway": "RWY16"}, "confidence": "0.75", "reviewRequired": "yes",
 "sourceEvidence": [{"id": "e1", "pageNo": 0}, "text", {"pageNo": 4, "confidence": null}],
 "tableLegs": [{"procedureName": "A 1A", "sequence": 20, "toFix": "Y", "altitudeConstraint": "+03500 11000", "turnDirection": "NONE", "confidence": 0.9}, {"procedureName": "A 1A", "sequence": 10, "fixIdentifier": "X", "altitudeConstraint": "-FL 06000", "turnDirection": "L", "remarks": "RNAV 1", "sourcePageNo": 3, "confidence": 0.7}, {"sequence": 1.5}],
 "procedures": [{"procedureName": "A 1A", "runway": "RWY16", "transitionName": "NORTH TRANSITION"}, {"procedureName": "B 1A", "runway": "RWY34", "navSpec": "RNP", "confidence": 0.2}, 5],
 "fixes": [{"ident": "X", "coordinates": {"lat": "01 38 12.5N", "lon": "103°40'15\\"W"}}, {"identifier": "Z", "latitude": 0, "longitude": 0}, {"identifier": "N", "latitude": "1.5", "longitude": null}],
 "holdings": [{"fix": "X", "inboundTrack": 90, "turnDirection": "Q"}], "warnings": [{"pageNos": [1, "2", 2.5, "x"]}], "navaids": 3}"""


def test_typed_answers(spark):
    docs = spark.createDataFrame([(1, ANSWER), (2, "[1]"), (3, None), (4, "{}")], "id int, doc string")
    got = {r.id: r for r in documents.normalized(docs, ["id"], "doc").collect()}
    r = got[1]
    assert (r.airport, r.package, r.runway, r.confidence, r.review) == (None, "SID", "RWY16", 0.75, False)
    assert [(e.id, e.page, e.confidence) for e in r.evidence] == [("e1", 1, 0.5), ("evidence_2", 1, 0.5), ("evidence_3", 4, 0.5)]
    a, b = r.procedures
    assert (a.name, a.runway, a.transition, a.navigation_spec, round(a.confidence, 9)) == ("A 1A", None, "NORTH", "RNAV 1", 0.8)
    assert [(x.sequence, x.fix, x.turn, x.derivation) for x in a.legs] == [(10, "X", "L", "tabular page 3"), (20, "Y", "STRAIGHT", "tableLegs")]
    assert [tuple(x.altitude)[:4] for x in a.legs] == [(None, 6000.0, None, None), ("AT_OR_ABOVE", 3500.0, 3500.0, 11000.0)]
    assert (b.runway, b.navigation_spec, b.confidence, b.legs) == ("RWY34", "RNP", 0.2, [])
    x, z, n = r.fixes
    assert abs(x.latitude - (1 + 38 / 60 + 12.5 / 3600)) < 1e-12 and x.longitude < -103.6 and x.raw.startswith("01 38") and (z.latitude, z.longitude) == (None, None) and (n.latitude, n.longitude) == (1.5, None)
    assert (r.holdings[0].fix, r.holdings[0].course_deg, r.holdings[0].turn) == ("X", 90.0, None)
    assert r.warnings[0].pages == [1, 2] and r.warnings[0].review and r.warnings[0].message == ""
    assert r.repairs == ["airport: unusable", "package: from another field", "runway: from another field", "review: unusable", "table_legs[1].to_fix: from another field", "table_legs[2].sequence: unusable", "procedures[1].navigation_spec: from another field", "fixes[0].identifier: from another field", "evidence[0].page: unusable", "holdings[0].fix: from another field", "holdings[0].course_deg: from another field", "holdings[0].turn: unusable"]
    for i in (2, 3):
        assert not got[i].readable and got[i].evidence == [] and got[i].procedures == [] and got[i].airport is None
    assert got[4].readable and got[4].confidence == 0.5 and got[4].repairs == []
