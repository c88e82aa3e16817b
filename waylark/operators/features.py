"""Features of procedures: where each leg runs, folded over the legs of a procedure.

What the legs refer to, fixes, runways and aids, is one table of references, in which
the last source wins; one equi join brings each leg the places that it may need. The
fold itself is an ``aggregate`` over the ordered legs of a row, whose state holds the
place, whether it is exact, the last DME distance and the last course. All of it runs in
the JVM; no leg is seen by Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylark.functions import geo
from waylark.functions import text as tx

from .geometry import MOST_ALONG_NM, RADII, USUAL_RADIUS_NM

POINT = "struct<lon: double, lat: double>"
FEATURE = f"struct<sequence: int, path_terminator: string, from_fix: string, to_fix: string, status: string, schematic: boolean, quality: string, points: array<{POINT}>>"
#: How a feature's place is known.
FROM_FIXES, MISSING, ARC = "derived_from_fix_coordinates", "missing_fix_coordinate", "derived_from_dme_arc_semantics"
OPEN, INDETERMINATE = ("VA", "VI", "VM"), ("VA", "VI", "VM", "CA", "CI", "CR", "FM")
#: Miles that a leg without a distance is drawn, what a climb goes beyond the runway, and the least step from DME to DME.
USUAL_NM, BEYOND_RUNWAY_NM, LEAST_STEP_NM = 2.0, 0.45, 0.2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; within lambdas Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------- references


def runway_name(text: Column) -> Column:
    """RW and two digits with their letter; the text itself, without spaces, where there are none."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", ""), "^RWY", "RW")
    digits = F.regexp_extract(t, r"(\d{2}[A-Z]?)", 1)
    return F.when(t.rlike(r"^RW\d{2}[A-Z]?$"), t).when(digits != "", F.concat(F.lit("RW"), digits)).otherwise(t)


def references(sources: Sequence[DataFrame], scope: Sequence[str]) -> DataFrame:
    """(scope, kind, ident, at, end): of each FIX, NAVAID and RUNWAY the place that the last source gives.

    Sources have the scope, kind, ident, lon, lat and, for runways, end_lon and end_lat.
    Idents are compared in upper case, runways by ``runway_name``; places that aren't
    valid count as not given. Of a source's rows of one ident the greatest place counts.
    """
    place = lambda lon, lat: F.when(geo.valid_coordinate(F.col(lon), F.col(lat)), F.struct(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")))
    ident = F.when(F.col("kind") == "RUNWAY", runway_name(F.col("ident"))).otherwise(F.upper(F.trim("ident")))
    rows = [s.select(*scope, "kind", ident.alias("ident"), place("lon", "lat").alias("at"), (place("end_lon", "end_lat") if "end_lon" in s.columns else F.lit(None).cast(POINT)).alias("end"), F.lit(i).alias("_source")) for i, s in enumerate(sources)]
    given = reduce(DataFrame.unionByName, rows).where("ident <> ''")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_source", c))).alias(c)
    return given.groupBy(*scope, "kind", "ident").agg(last("at"), last("end")).where("at is not null or end is not null")


def looked_up(rows: DataFrame, refs: DataFrame, scope: Sequence[str], key: Sequence[str], slots: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with ref: a map from a slot's name to struct(at, end) of what it names. One join for all slots; ``key`` tells rows of a scope apart."""
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(kind).alias("kind"), ident.alias("ident")) for s, (kind, ident) in slots.items()]))
    wants = rows.select(*scope, *key, wanted.alias("w")).where("w.ident <> ''").select(*scope, *key, "w.*")
    met = wants.join(refs, [*scope, "kind", "ident"]).groupBy(*scope, *key).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("at", "end")))).alias("ref"))
    return rows.join(met, [*scope, *key], "left")


def dme_distance(text: Column) -> Column:
    """The number before DME or D and an aid's letters."""
    return tx.extract(F.upper(F.coalesce(text, F.lit(""))), r"(\d+(?:\.\d+)?)\s*(?:DME|D)\s*[_\s-]*[A-Z]{2,4}").try_cast("double")


def arc_contexts(legs: DataFrame, semantics: DataFrame, refs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, center, radius_nm): the arc of each scope: the first described one with a centre and a radius, else the first AF leg with both, where the centre's place is known.

    ``semantics``: scope, ordinal, center_ident, radius_nm. ``legs``: scope, procedure,
    sequence, path_terminator, recommended_navaid, rho_nm.
    """
    described = semantics.where("coalesce(trim(center_ident), '') <> '' and radius_nm > 0").groupBy(*scope).agg(F.min_by(F.struct("center_ident", "radius_nm"), "ordinal").alias("a")).withColumn("_rank", F.lit(0))
    flown = legs.where("upper(path_terminator) = 'AF' and coalesce(trim(recommended_navaid), '') <> '' and rho_nm > 0")
    flown = flown.groupBy(*scope).agg(F.min_by(F.struct(F.col("recommended_navaid").alias("center_ident"), F.col("rho_nm").alias("radius_nm")), F.struct("procedure", "sequence")).alias("a")).withColumn("_rank", F.lit(1))
    both = described.unionByName(flown).select(*scope, "_rank", F.lit("NAVAID").alias("kind"), F.upper(F.trim("a.center_ident")).alias("ident"), F.col("a.radius_nm").cast("double").alias("radius_nm"))
    met = both.join(refs, [*scope, "kind", "ident"]).where("at is not null")
    return met.groupBy(*scope).agg(F.min_by(F.struct(F.col("at").alias("center"), "radius_nm"), "_rank").alias("a")).select(*scope, "a.*")


# ---------------------------------------------------------------- shapes


def _ahead(p: Column, course: Column, nm: Column) -> Column:
    """``geo.destination`` with its steps in degrees, as the SQL has them: arcs between radials of whole steps get a point more or less by the last bit."""
    a, t, d = F.radians(p["lat"]), F.radians(course), nm / geo.EARTH_NM
    lat = F.degrees(F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t)))
    lon = p["lon"] + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(F.radians(lat))))
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def _apart(a: Column, b: Column) -> Column:
    return geo.distance_nm(a["lon"], a["lat"], b["lon"], b["lat"])


def _bearing(a: Column, b: Column) -> Column:
    return geo.bearing_deg(a["lon"], a["lat"], b["lon"], b["lat"])


def turn_at(p: Column, course: Column, exit_course: Column, radius: Column, turn: Column) -> Column:
    """Points of a turn of constant radius from one course to another."""
    right = turn == "R"
    center = _ahead(p, F.when(right, course + 90).otherwise(course - 90), radius)
    return let(center, lambda c: geo.arc(c["lon"], c["lat"], radius, F.when(right, course - 90).otherwise(course + 90), F.when(right, exit_course - 90).otherwise(exit_course + 90), turn))


def _with_target(arc: Column, target: Column) -> Column:
    return let(arc, lambda a: F.when(_apart(F.element_at(a, -1), target) < 0.2, a).otherwise(F.concat(a, F.array(target))))


def turn_to_fix(p: Column, target: Column, course: Column, turn: Column) -> Column:
    """A turn and the way on to a fix, the exit course found in up to four steps; straight where the fix is near."""

    def step(s: Column, _: Column) -> Column:
        def tried(a: Column) -> Column:
            end = F.element_at(a, -1)
            near = _apart(end, target) < 0.4
            return F.struct(F.when(near, s["exit"]).otherwise(_bearing(end, target)).alias("exit"), a.alias("arc"), near.alias("done"))

        return F.when(s["done"], s).otherwise(let(turn_at(p, course, s["exit"], s["radius"], turn), tried).withField("radius", s["radius"]))

    def turned(apart: Column) -> Column:
        radius = F.least(F.lit(5.5), F.greatest(F.lit(1.8), apart * 0.18))
        first = F.struct(_bearing(p, target).alias("exit"), F.array().cast(f"array<{POINT}>").alias("arc"), F.lit(False).alias("done"), radius.alias("radius"))
        return F.when(apart < 2, F.array(p, target)).otherwise(_with_target(F.aggregate(F.sequence(F.lit(1), F.lit(4)), first, step)["arc"], target))

    return let(_apart(p, target), turned)


def turn_to_course(p: Column, target: Column, course: Column, exit_course: Column, turn: Column) -> Column:
    return let(_apart(p, target), lambda d: F.when(d < 1.2, F.array(p, target)).otherwise(_with_target(turn_at(p, course, exit_course, F.least(F.lit(5.0), F.greatest(F.lit(1.4), d * 0.16)), turn), target)))


def _intersection(p: Column, course: Column, center: Column, radial: Column) -> Column:
    """struct(at, along): where a course meets a radial, null where it doesn't."""
    hit = geo.course_radial(p["lon"], p["lat"], course, center["lon"], center["lat"], radial)
    return let(hit, lambda h: F.when(h.isNotNull(), F.struct(_ahead(center, radial, h["along_radial"]).alias("at"), h["along_course"].alias("along"))))


def turn_to_radial(p: Column, course: Column, exit_course: Column, turn: Column, center: Column, radial: Column, nm: Column) -> Column:
    """A turn whose way on meets a radial: of all radii the one whose length is nearest to ``nm``, or nearest to the usual radius where none is expected; null where none meets it."""
    angle = F.pmod(F.when(turn == "R", exit_course - course).otherwise(course - exit_course) + 360, F.lit(360.0))

    def tried(r: Column) -> Column:
        def met(a: Column) -> Column:
            return let(_intersection(F.element_at(a, -1), exit_course, center, radial), lambda x: F.when(x["along"] <= MOST_ALONG_NM, F.struct(F.when(nm > 0, F.abs(r * F.radians(angle) + x["along"] - nm)).otherwise(F.abs(r - USUAL_RADIUS_NM)).alias("off"), r.alias("radius"), F.concat(a, F.array(x["at"])).alias("points"))))

        return let(turn_at(p, course, exit_course, r, turn), met)

    return F.array_min(F.filter(F.transform(F.array(*map(F.lit, RADII)), tried), lambda t: t.isNotNull()))["points"]


# ---------------------------------------------------------------- the fold


def _status(terminator: Column, quality: Column, start_exact: Column, target_exact: Column) -> Column:
    """struct(status, schematic)."""
    of = lambda s, schematic: F.struct(F.lit(s).alias("status"), schematic.alias("schematic"))
    conditional = of("CONDITIONAL_FROM_PREVIOUS_LEG", ~start_exact)
    return (
        F.when(terminator == "DF", conditional).when(terminator.isin(*INDETERMINATE), of("INDETERMINATE", F.lit(True)))
        .when(start_exact & target_exact & (quality == FROM_FIXES), of("EXACT_FROM_FIXES", F.lit(False))).when(target_exact, conditional).otherwise(of("SCHEMATIC", F.lit(True)))
    )


def _target(a: Column, leg: Column, at: Column, arc: Column) -> Column:
    """struct(at, synthetic, dme, quality) of the fix that a leg goes to; null where its place can't be told."""
    ident = leg["ident"]
    of = lambda place, synthetic, dme, quality: F.struct(place.alias("at"), F.lit(synthetic).alias("synthetic"), dme.cast("double").alias("dme"), F.lit(quality).cast("string").alias("quality"))
    none = F.lit(None).cast("double")
    code = geo.dme_radial(ident)
    return (
        F.when(ident == "", None)
        .when(leg["fix"].isNotNull(), of(leg["fix"], False, none, None))
        .when(leg["threshold"].isNotNull(), of(leg["threshold"], True, none, "derived_from_runway_threshold"))
        .when((ident == "DER") & leg["der"].isNotNull(), of(leg["der"], True, none, "derived_from_runway_end"))
        .when(leg["named_dme"].isNotNull() & at.isNotNull() & leg["course"].isNotNull(), of(_ahead(at, leg["course"], F.greatest(F.lit(LEAST_STEP_NM), leg["named_dme"] - F.coalesce(a["dme"], F.lit(0.0)))), True, leg["named_dme"], "derived_from_radar_sid_dme"))
        .when((leg["pt"] == "CF") & leg["aid"].isNotNull() & leg["course"].isNotNull() & (leg["nm"] > 0), of(_ahead(leg["aid"], leg["course"], leg["nm"]), True, leg["nm"], "derived_from_vor_dme_radial_distance"))
        .when(arc.isNotNull() & code.isNotNull() & (code["radial"] <= 360), of(_ahead(arc, code["radial"].cast("double"), code["distance"].cast("double")), True, code["distance"], None))
    )


def _shape(a: Column, leg: Column, at: Column, target: Column, arc: Column) -> Column:
    """struct(points, quality) of a leg; null where it can't be drawn."""
    of = lambda points, quality: F.struct(points.alias("points"), quality.alias("quality"))
    pt, course, nm, turn = leg["pt"], leg["course"], leg["nm"], leg["turn"]
    turning = leg["departure"] & turn.isin("L", "R") & a["course"].isNotNull()
    usual = F.when(nm > 0, nm).otherwise(USUAL_NM)
    straight = lambda p: F.array(at, p)
    ahead = _ahead(at, course, usual)
    free = target.isNull() & at.isNotNull() & course.isNotNull()
    met = leg["center"].isNotNull() & leg["radial"].isNotNull()
    climb = F.when(nm > 0, nm).otherwise(F.greatest(F.lit(USUAL_NM), F.when(leg["runway_end"].isNotNull(), _apart(at, leg["runway_end"])).otherwise(0.0) + BEYOND_RUNWAY_NM))
    meeting = F.coalesce(_intersection(at, course, leg["center"], leg["radial"])["at"], ahead)
    turned = F.coalesce(turn_to_radial(at, a["course"], course, turn, leg["center"], leg["radial"], nm), turn_to_course(at, meeting, a["course"], course, turn))
    radius = F.coalesce(target["dme"], _apart(arc, target["at"]))
    around = let(geo.arc(arc["lon"], arc["lat"], radius, _bearing(arc, at), _bearing(arc, target["at"]), F.when(turn.isin("L", "R"), turn)), lambda points: F.concat(F.array(at), F.slice(points, F.lit(2), F.size(points) - 2), F.array(target["at"])))
    intercept = F.lit("derived_from_course_to_radial"), F.lit("derived_from_course_intercept")
    by_turn = F.lit("derived_from_sid_turn_to_radial_intercept"), F.lit("derived_from_sid_turn_to_course_intercept")
    named = F.coalesce(target["quality"], F.when(target["synthetic"], "derived_from_dme_fix_name").otherwise(FROM_FIXES))
    both = at.isNotNull() & target.isNotNull()
    return (
        F.when(pt.isin(*OPEN) & free, of(straight(ahead), F.lit("schematic_course_to_altitude")))
        .when((pt == "CA") & free, of(straight(_ahead(at, course, climb)), F.lit("derived_from_sid_course_to_altitude")))
        .when(pt.isin("CI", "CR") & free & met & turning, of(turned, F.when(pt == "CR", by_turn[0]).otherwise(by_turn[1])))
        .when(pt.isin("CI", "CR") & free, of(straight(F.when(met, meeting).otherwise(ahead)), F.when(pt == "CR", intercept[0]).otherwise(intercept[1])))
        .when((pt == "AF") & arc.isNotNull() & both, of(around, F.lit(ARC)))
        .when((pt == "DF") & both & turning, of(turn_to_fix(at, target["at"], a["course"], turn), F.lit("derived_from_sid_chart_turn")))
        .when(both, of(straight(target["at"]), named))
    )


def folded(legs: Column, arc: Column) -> Column:
    """The features of ordered legs (a column of an array), an array of FEATURE; ``arc`` is the centre of the arc that applies, or null."""
    state = F.struct(F.lit(None).cast(POINT).alias("at"), F.lit(False).alias("exact"), F.lit(None).cast("double").alias("dme"), F.lit(None).cast("double").alias("course"), F.array().cast(f"array<{FEATURE}>").alias("out"))

    def feature(leg: Column, status: Column, schematic: Column, quality: Column, points: Column) -> Column:
        return F.struct(leg["sequence"].alias("sequence"), leg["pt"].alias("path_terminator"), leg["from_fix"].alias("from_fix"), leg["to_fix"].alias("to_fix"), status.alias("status"), schematic.alias("schematic"), quality.alias("quality"), points.alias("points")).cast(FEATURE)

    def next_state(at: Column, exact: Column, dme: Column, course: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), exact.alias("exact"), dme.alias("dme"), course.alias("course"), out.alias("out"))

    def step(a: Column, leg: Column) -> Column:
        begun = F.struct(F.coalesce(a["at"], leg["start"]).alias("at"), F.when(a["at"].isNull() & leg["start"].isNotNull(), True).otherwise(a["exact"]).alias("exact"))

        def with_target(s: Column) -> Column:
            at, exact = s["b"]["at"], s["b"]["exact"]
            target = s["t"]
            lost = next_state(at, F.lit(False), a["dme"], a["course"], F.concat(a["out"], F.array(feature(leg, F.lit("MISSING_FIX_COORDINATE"), F.lit(False), F.lit(MISSING), F.lit(None).cast(f"array<{POINT}>")))))

            def with_shape(g: Column) -> Column:
                known = F.coalesce(target.isNotNull() & ~target["synthetic"], F.lit(False))
                end = F.element_at(g["points"], -1)
                status = _status(leg["pt"], g["quality"], exact, known)
                drawn = F.concat(a["out"], F.array(let(status, lambda x: feature(leg, x["status"], x["schematic"], g["quality"], g["points"]))))
                course = F.when(leg["course"] > 0, leg["course"]).when(g.isNotNull(), _bearing(F.element_at(g["points"], -2), end)).otherwise(a["course"])
                dme = F.coalesce(leg["dme"], a["dme"])
                open_ = leg["pt"].isin(*OPEN) & target.isNull()
                with_line = F.when(open_, next_state(end, F.lit(False), a["dme"], leg["course"], drawn)).otherwise(next_state(end, known, dme, course, drawn))
                return F.when(g.isNotNull(), with_line).otherwise(next_state(F.coalesce(target["at"], at), F.when(target.isNotNull(), known).otherwise(exact), dme, course, a["out"]))

            return F.when((leg["ident"] != "") & target.isNull(), lost).otherwise(let(_shape(a, leg, at, target, arc), with_shape))

        return let(let(begun, lambda b: F.struct(b.alias("b"), _target(a, leg, b["at"], arc).alias("t"))), with_target)

    return F.aggregate(legs, state, step)["out"]


def procedure_features(legs: DataFrame, refs: DataFrame, semantics: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, procedure, object_type, sequence, path_terminator, from_fix, to_fix, status, schematic, quality, points): a row for each leg that can be drawn or whose fix has no place, and a track for each procedure with a line.

    ``legs``: scope, procedure, sequence (unique in it), path_terminator, from_fix,
    to_fix, course_deg, distance_nm, turn, remarks, recommended_navaid, theta_deg,
    rho_nm, runway, departure. A leg starts where the one before ended, the first where
    its from_fix or runway lies. A leg to a fix without a place is told and moves
    nothing. Legs that end by altitude or intercept are drawn a little and make what
    follows inexact. Nulls stay unknown: a leg without a course isn't flown north.
    """
    scope = list(scope)
    up = lambda c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    w = Window.partitionBy(*scope, "procedure").orderBy("sequence")
    after = lambda c: F.lead(c).over(w)
    radial = tx.extract(F.upper(F.coalesce("remarks", F.lit(""))), r"RDL[-\s]?(\d{3})").try_cast("double")
    aid = F.nullif(F.regexp_extract(F.upper(F.coalesce("remarks", F.lit(""))), r"RDL[-\s]?\d{3}\s*([A-Z]{2,4})", 1), F.lit(""))
    df = legs.withColumn("_radial", F.coalesce("theta_deg", radial, F.when(F.upper(after("path_terminator")) == "CF", F.coalesce(after("theta_deg"), after("course_deg")))))
    df = df.withColumn("_center", F.coalesce(aid, F.nullif(up("recommended_navaid"), F.lit("")), F.upper(F.trim(after("recommended_navaid"))), F.lit("")))
    begin = F.upper(F.trim(F.coalesce("from_fix", "runway", F.lit(""))))
    slots = {
        "fix": ("FIX", up("to_fix")), "threshold": ("RUNWAY", runway_name(F.col("to_fix"))), "der": ("RUNWAY", F.when(up("to_fix") == "DER", runway_name(F.col("from_fix"))).otherwise("")), "aid": ("NAVAID", up("recommended_navaid")),
        "start": ("FIX", begin), "start_runway": ("RUNWAY", runway_name(begin)), "runway": ("RUNWAY", runway_name(F.col("runway"))), "center": ("NAVAID", F.col("_center")),
    }
    df = looked_up(df, refs, scope, ["procedure", "sequence"], slots)
    at = lambda slot, what="at": F.try_element_at("ref", F.lit(slot))[what]
    number = lambda c: F.col(c).cast("double")
    leg = F.struct(
        F.col("sequence").cast("int").alias("sequence"), up("path_terminator").alias("pt"), "from_fix", "to_fix", up("to_fix").alias("ident"), number("course_deg").alias("course"), number("distance_nm").alias("nm"), F.nullif(up("turn"), F.lit("")).alias("turn"),
        dme_distance(F.col("to_fix")).alias("named_dme"), F.coalesce(dme_distance(F.col("to_fix")), dme_distance(F.col("remarks"))).alias("dme"), F.coalesce("departure", F.lit(False)).alias("departure"), F.col("_radial").cast("double").alias("radial"),
        at("fix").alias("fix"), at("threshold").alias("threshold"), at("der", "end").alias("der"), at("aid").alias("aid"), F.coalesce(at("start"), at("start_runway")).alias("start"), at("runway", "end").alias("runway_end"), at("center").alias("center"),
    )
    whole = df.groupBy(*scope, "procedure").agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    arcs = arc_contexts(legs, semantics, refs, scope)
    drawn = whole.join(arcs, scope, "left").withColumn("f", folded(F.col("legs"), F.col("center")))
    lines = F.filter("f", lambda x: x["points"].isNotNull())
    df = drawn.select(*scope, "procedure", "f", lines.alias("l"))
    chain = F.concat(F.slice(F.get("l", F.lit(0))["points"], 1, 1), F.flatten(F.transform("l", lambda x: F.slice(x["points"], F.lit(2), F.greatest(F.size(x["points"]) - 1, F.lit(0))))))
    derived = F.exists("l", lambda x: x["quality"] != FROM_FIXES)
    text = F.lit(None).cast("string")
    track = F.struct(F.lit(0).alias("sequence"), text.alias("path_terminator"), text.alias("from_fix"), text.alias("to_fix"), text.alias("status"), derived.alias("schematic"), F.when(derived, "derived_from_leg_chain").otherwise(FROM_FIXES).alias("quality"), chain.alias("points")).cast(FEATURE)
    typed = lambda kind, x: F.struct(F.lit(kind).alias("object_type"), x.alias("x"))
    rows = F.concat(F.when(F.size("l") > 0, F.array(typed("ProcedureTrack", track))).otherwise(F.slice(F.array(typed("ProcedureTrack", track)), 1, 0)), F.transform("f", lambda x: typed("ProcedureLeg", x)))
    return df.select(*scope, "procedure", F.explode(rows).alias("r")).select(*scope, "procedure", "r.object_type", "r.x.*")
