"""Features of procedures against plain Python, and worked cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from waylark.operators import features

LEG = "airport string, procedure string, sequence int, path_terminator string, from_fix string, to_fix string, course_deg double, distance_nm double, turn string, remarks string, recommended_navaid string, theta_deg double, rho_nm double, runway string, departure boolean"
R = 3440.065


def ahead(p, course, nm):
    a, t, d = math.radians(p[1]), math.radians(course), nm / R
    lat = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(t))
    return (p[0] + math.degrees(math.atan2(math.sin(t) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(lat))), math.degrees(lat))


def bearing(a, b):
    x, y, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[0] - a[0])
    return (math.degrees(math.atan2(math.sin(d) * math.cos(y), math.cos(x) * math.sin(y) - math.sin(x) * math.cos(y) * math.cos(d))) + 360) % 360


def apart(a, b):
    x, y = math.radians(a[1]), math.radians(b[1])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(h))


def arc(c, radius, start, end, turn):
    cw = (end - start + 360) % 360
    sweep = 0 if cw == 0 else cw if turn == "R" else cw - 360 if turn == "L" else cw if cw <= 180 else cw - 360
    n = max(8, math.ceil(abs(sweep) / 5))
    return [ahead(c, start + sweep * i / n, radius) for i in range(n + 1)]


def turn_at(p, c0, c1, radius, turn):
    s = 1 if turn == "R" else -1
    return arc(ahead(p, c0 + 90 * s, radius), radius, c0 - 90 * s, c1 - 90 * s, turn)


def meet(p, course, center, radial):
    k = math.cos(math.radians(center[1]))
    x, y = (p[0] - center[0]) * 60 * k, (p[1] - center[1]) * 60
    c, r = (math.sin(math.radians(course)), math.cos(math.radians(course))), (math.sin(math.radians(radial)), math.cos(math.radians(radial)))
    den = c[0] * r[1] - c[1] * r[0]
    if abs(den) < 1e-6:
        return None
    along, out = (-x * r[1] + y * r[0]) / den, (-x * c[1] + y * c[0]) / den
    return None if along < 0.05 or out < 0.05 else (ahead(center, radial, out), along)


def with_target(points, t):
    return points if apart(points[-1], t) < 0.2 else [*points, t]


def to_fix(p, t, course, turn):
    d = apart(p, t)
    if d < 2:
        return [p, t]
    radius, out = min(5.5, max(1.8, d * 0.18)), bearing(p, t)
    for _ in range(4):
        points = turn_at(p, course, out, radius, turn)
        if apart(points[-1], t) < 0.4:
            break
        out = bearing(points[-1], t)
    return with_target(points, t)


def to_radial(p, c0, c1, turn, center, radial, nm):
    best = None
    for i in range(21):
        r = round(1.2 + 0.2 * i, 1)
        points = turn_at(p, c0, c1, r, turn)
        x = meet(points[-1], c1, center, radial)
        if x is None or x[1] > 35:
            continue
        angle = (c1 - c0 + 360) % 360 if turn == "R" else (c0 - c1 + 360) % 360
        off = abs(r * math.radians(angle) + x[1] - nm) if nm and nm > 0 else abs(r - 2.4)
        if best is None or off < best[0]:
            best = (off, [*points, x[0]])
    return best and best[1]


def dme(text):
    m = re.search(r"(\d+(?:\.\d+)?)\s*(?:DME|D)\s*[_\s-]*[A-Z]{2,4}", (text or "").upper())
    return float(m[1]) if m else None


def brute(legs, refs, center):
    """Rows (sequence, status, schematic, quality, points) of one procedure."""
    place = lambda kind, ident: refs.get((kind, ident), (None, None))[0]
    end_of = lambda ident: refs.get(("RUNWAY", ident), (None, None))[1]
    at, exact, last, course, out = None, False, None, None, []
    legs = sorted(legs, key=lambda x: x["sequence"])
    for leg, after in zip(legs, [*legs[1:], None], strict=True):
        pt, ident, c, nm, turn = leg["path_terminator"], (leg["to_fix"] or "").upper(), leg["course_deg"], leg["distance_nm"], leg["turn"]
        begin = leg["from_fix"] or leg["runway"] or ""
        start = place("FIX", begin) or place("RUNWAY", begin)
        if at is None and start:
            at, exact = start, True
        target = None  # place, synthetic, dme, quality
        code = re.fullmatch(r"D(\d{3})([A-Z])", ident)
        if ident:
            if place("FIX", ident):
                target = (place("FIX", ident), False, None, None)
            elif place("RUNWAY", ident):
                target = (place("RUNWAY", ident), True, None, "derived_from_runway_threshold")
            elif ident == "DER" and end_of(leg["from_fix"]):
                target = (end_of(leg["from_fix"]), True, None, "derived_from_runway_end")
            elif dme(ident) is not None and at and c is not None:
                target = (ahead(at, c, max(0.2, dme(ident) - (last or 0))), True, dme(ident), "derived_from_radar_sid_dme")
            elif pt == "CF" and place("NAVAID", leg["recommended_navaid"]) and c is not None and nm and nm > 0:
                target = (ahead(place("NAVAID", leg["recommended_navaid"]), c, nm), True, nm, "derived_from_vor_dme_radial_distance")
            elif center and code and int(code[1]) <= 360:
                target = (ahead(center, int(code[1]), ord(code[2]) - 64), True, ord(code[2]) - 64, None)
            if target is None:
                out.append((leg["sequence"], "MISSING_FIX_COORDINATE", False, "missing_fix_coordinate", None))
                exact = False
                continue
        departs = leg["departure"] and turn in ("L", "R") and course is not None
        points = quality = None
        free = target is None and at and c is not None
        usual = nm if nm and nm > 0 else 2
        if free and pt in ("VA", "VI", "VM"):
            points = [at, ahead(at, c, usual)]
            out.append((leg["sequence"], "INDETERMINATE", True, "schematic_course_to_altitude", points))
            at, exact, course = points[-1], False, c
            continue
        if free and pt == "CA":
            length = apart(at, end_of(leg["runway"])) if end_of(leg["runway"]) else 0
            points, quality = [at, ahead(at, c, nm if nm and nm > 0 else max(2, length + 0.45))], "derived_from_sid_course_to_altitude"
        elif free and pt in ("CI", "CR"):
            m = re.search(r"RDL[-\s]?(\d{3})\s*([A-Z]{2,4})?", leg["remarks"] or "")
            radial = leg["theta_deg"] if leg["theta_deg"] is not None else float(m[1]) if m else None
            if radial is None and after and after["path_terminator"] == "CF":
                radial = after["theta_deg"] if after["theta_deg"] is not None else after["course_deg"]
            aid = (m and m[2]) or leg["recommended_navaid"] or (after and after["recommended_navaid"])
            vor = place("NAVAID", aid) if radial is not None else None
            x = vor and meet(at, c, vor, radial)
            straight = x[0] if x else ahead(at, c, usual)
            if vor and departs:
                points = to_radial(at, course, c, turn, vor, radial, nm)
                if points is None:
                    d = apart(at, straight)
                    points = [at, straight] if d < 1.2 else with_target(turn_at(at, course, c, min(5, max(1.4, d * 0.16)), turn), straight)
                quality = "derived_from_sid_turn_to_radial_intercept" if pt == "CR" else "derived_from_sid_turn_to_course_intercept"
            else:
                points, quality = [at, straight], "derived_from_course_to_radial" if pt == "CR" else "derived_from_course_intercept"
        elif at and target and pt == "AF" and center:
            radius = target[2] if target[2] is not None else apart(center, target[0])
            points, quality = [at, *arc(center, radius, bearing(center, at), bearing(center, target[0]), turn)[1:-1], target[0]], "derived_from_dme_arc_semantics"
        elif at and target and pt == "DF" and departs:
            points, quality = to_fix(at, target[0], course, turn), "derived_from_sid_chart_turn"
        elif at and target:
            points, quality = [at, target[0]], target[3] or ("derived_from_dme_fix_name" if target[1] else "derived_from_fix_coordinates")
        known = bool(target and not target[1])
        if points:
            if pt == "DF":
                status = ("CONDITIONAL_FROM_PREVIOUS_LEG", not exact)
            elif pt in ("VA", "VI", "VM", "CA", "CI", "CR", "FM"):
                status = ("INDETERMINATE", True)
            elif exact and known and quality == "derived_from_fix_coordinates":
                status = ("EXACT_FROM_FIXES", False)
            else:
                status = ("CONDITIONAL_FROM_PREVIOUS_LEG", not exact) if known else ("SCHEMATIC", True)
            out.append((leg["sequence"], *status, quality, points))
            exact = known
        elif target:
            exact = known
        if points or target:
            at = points[-1] if points else target[0]
        course = c if c and c > 0 else bearing(points[-2], points[-1]) if points else course
        found = [x for x in (dme(leg["to_fix"]), dme(leg["remarks"])) if x is not None]
        last = found[0] if found else last
    return out


PLACES = {("FIX", f"FIX{c}"): ((100 + i * 0.31, 2 + i * 0.17), None) for i, c in enumerate("ABCDEF")} | {("NAVAID", "VJB"): ((100.5, 2.3), None), ("NAVAID", "PU"): ((100.1, 2.9), None), ("RUNWAY", "RW16"): ((100.2, 2.1), (100.21, 2.07)), ("RUNWAY", "RW34"): ((100.21, 2.07), (100.2, 2.1))}


def random_legs(seed):
    rng = random.Random(seed)
    out = []
    for i in range(rng.randrange(2, 9)):
        fix = rng.choice([None, None, "FIXA", "FIXB", "FIXC", "fixd", "FIXE", "NOWHERE", "RW16", "DER", "7.5 DME VJB", "D120H", "D400A"])
        out.append(dict(airport="A", procedure=f"P{seed}", sequence=i * 10, path_terminator=rng.choice(["VA", "CA", "CI", "CR", "CF", "DF", "TF", "AF", "IF", "VM", "FM"]), from_fix=rng.choice([None, None, "RW16", "FIXA", "FIXB"]), to_fix=fix, course_deg=rng.choice([None, 40.0, 155.0, 290.0, 359.0]), distance_nm=rng.choice([None, 0.0, 4.5, 12.0]),
                        turn=rng.choice([None, "L", "R", "R"]), remarks=rng.choice([None, "RDL-200 VJB", "RDL 095", "at 9D VJB"]), recommended_navaid=rng.choice([None, "VJB", "PU", "XX"]), theta_deg=rng.choice([None, 77.0, 210.0]), rho_nm=rng.choice([None, 11.0]), runway="RW16", departure=seed % 3 > 0))
    return out


@pytest.fixture(scope="module")
def refs(spark):
    rows = [("A", kind, ident, *at, *(end or (None, None))) for (kind, ident), (at, end) in PLACES.items()]
    first = spark.createDataFrame([("A", "FIX", "FIXA", 1.0, 1.0, None, None), ("A", "FIX", "FIXB", 0.0, 0.0, None, None)], "airport string, kind string, ident string, lon double, lat double, end_lon double, end_lat double")
    last = spark.createDataFrame([("A", "FIX", "FIXC", 0.0, 0.0), ("A", "FIX", "FIXC", 200.0, 0.0)], "airport string, kind string, ident string, lon double, lat double")
    return features.references([first, spark.createDataFrame(rows, first.schema), last], ["airport"])


def test_features_against_plain_python(spark, refs):
    procedures = [random_legs(s) for s in range(140)]
    rows = [tuple(leg[c.split()[0]] for c in LEG.split(", ")) for p in procedures for leg in p]
    semantics = spark.createDataFrame([("A", 1, "VJB", None), ("A", 2, "VJB", 8.0)], "airport string, ordinal int, center_ident string, radius_nm double")
    got = {}
    for r in features.procedure_features(spark.createDataFrame(rows, LEG), refs, semantics, ["airport"]).collect():
        got.setdefault(r.procedure, []).append(r)
    seen = set()
    for s, legs in enumerate(procedures):
        expected = brute(legs, PLACES, PLACES["NAVAID", "VJB"][0])
        mine = sorted((r for r in got.get(f"P{s}", []) if r.object_type == "ProcedureLeg"), key=lambda r: r.sequence)
        assert [(r.sequence, r.status, r.schematic, r.quality) for r in mine] == [e[:4] for e in expected]
        for r, e in zip(mine, expected, strict=True):
            seen.add(r.quality)
            assert (r.points is None) == (e[4] is None)
            if r.points is not None:
                assert len(r.points) == len(e[4]) and all(abs(p.lon - x) < 1e-8 and abs(p.lat - y) < 1e-8 for p, (x, y) in zip(r.points, e[4], strict=True))
        lines = [e for e in expected if e[4]]
        tracks = [r for r in got.get(f"P{s}", []) if r.object_type == "ProcedureTrack"]
        assert len(tracks) == (1 if lines else 0)
        if lines:
            assert len(tracks[0].points) == 1 + sum(len(e[4]) - 1 for e in lines)
            assert tracks[0].schematic == any(e[3] != "derived_from_fix_coordinates" for e in lines)
    assert len(seen) == 15  # all ways of drawing a leg, and not drawing it


def test_arc_of_an_af_leg_where_none_is_described(spark, refs):
    legs = spark.createDataFrame([("A", "P", 10, "AF", "FIXA", "FIXB", None, None, "L", None, "vjb", None, 9.0, None, False)], LEG)
    none = spark.createDataFrame([("A", 1, "NOWHERE", 5.0)], "airport string, ordinal int, center_ident string, radius_nm double")
    [a] = features.arc_contexts(legs, none, refs, ["airport"]).collect()
    assert a.radius_nm == 9.0 and (a.center.lon, a.center.lat) == (100.5, 2.3)
    drawn = features.procedure_features(legs, refs, none, ["airport"]).where("object_type = 'ProcedureLeg'").collect()
    assert drawn[0].quality == features.ARC and len(drawn[0].points) >= 9


def test_the_last_valid_source_wins(refs):
    found = {(r.kind, r.ident): r.at for r in refs.collect()}
    assert found["FIX", "FIXA"].lon == 100.0 and found["FIX", "FIXB"].lat == 2.17 and found["FIX", "FIXC"].lon == pytest.approx(100.62)


def test_no_legs(spark, refs):
    nothing = spark.createDataFrame([], LEG)
    semantics = spark.createDataFrame([], "airport string, ordinal int, center_ident string, radius_nm double")
    assert features.procedure_features(nothing, refs, semantics, ["airport"]).count() == 0
    df = spark.createDataFrame([("RWY 16L",), ("16",), ("rw34",), ("BEKOL",), (None,)], "t string")
    assert [r.n for r in df.select(features.runway_name(F.col("t")).alias("n")).collect()] == ["RW16L", "RW16", "RW34", "BEKOL", ""]
