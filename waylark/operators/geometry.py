"""Geometry of legs: turns, lines, labels, features and their validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylark.functions import geo

from .merge import top_one
from .records import errors

KINDS = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"]
#: Radii that a turn is tried with, how far a course may be flown, and the radius to prefer where no length is expected.
RADII, MOST_ALONG_NM, USUAL_RADIUS_NM = [round(1.2 + 0.2 * i, 1) for i in range(21)], 35.0, 2.4


def best_turns(rows: DataFrame, key: str) -> DataFrame:
    """(key, radius_nm, length_nm): the turn from course to exit_course whose length with the way to the radial is closest to ``nm``.

    ``rows`` has key, lon, lat, course, exit_course, turn (L or R), and lon2, lat2 and nm
    for the radial's centre and the length that is expected. The radial is the
    bearing from the centre to 20 NM beyond the turn. All radii are tried at once.
    """
    c = F.col
    right = F.coalesce(c("turn"), F.lit("R")) == "R"
    grid = rows.withColumn("radius_nm", F.explode(F.array(*[F.lit(r) for r in RADII])))
    grid = grid.withColumn("center", geo.destination(c("lon"), c("lat"), F.when(right, c("course") + 90).otherwise(c("course") - 90), c("radius_nm")))
    grid = grid.withColumn("end", geo.destination(c("center.lon"), c("center.lat"), F.when(right, c("exit_course") - 90).otherwise(c("exit_course") + 90), c("radius_nm")))
    ahead = geo.destination(c("lon"), c("lat"), c("exit_course"), F.lit(20.0))
    aid = geo.destination(c("lon"), c("lat"), c("course") + 45, F.lit(30.0))
    grid = grid.withColumn("ahead", ahead).withColumn("aid", aid)
    radial = geo.bearing_deg(c("aid.lon"), c("aid.lat"), c("ahead.lon"), c("ahead.lat"))
    grid = grid.withColumn("hit", geo.course_radial(c("end.lon"), c("end.lat"), c("exit_course"), c("aid.lon"), c("aid.lat"), radial))
    angle = F.pmod(F.when(right, c("exit_course") - c("course")).otherwise(c("course") - c("exit_course")) + 360, F.lit(360.0))
    length = c("radius_nm") * F.radians(angle) + c("hit.along_course")
    off = F.when(c("nm") > 0, F.abs(length - c("nm"))).otherwise(F.abs(c("radius_nm") - USUAL_RADIUS_NM))
    good = grid.where(c("hit").isNotNull() & (c("hit.along_course") <= MOST_ALONG_NM)).select(key, "radius_nm", length.alias("length_nm"), off.alias("off"))
    return good.groupBy(key).agg(F.min_by(F.struct("radius_nm", "length_nm"), F.struct("off", "radius_nm")).alias("b")).select(key, "b.*")


def at_fraction(rows: DataFrame, keys: Sequence[str], order: str, fraction: float) -> DataFrame:
    """(keys, lon, lat): the point of each line at a share of its length, in the plane of longitude and latitude."""
    w = Window.partitionBy(*keys).orderBy(order)
    c = F.col
    seg = rows.withColumn("_x", F.lead("lon").over(w)).withColumn("_y", F.lead("lat").over(w)).where("_x is not null")
    seg = seg.withColumn("_len", F.sqrt(F.pow(c("_x") - c("lon"), F.lit(2)) + F.pow(c("_y") - c("lat"), F.lit(2))))
    seg = seg.withColumn("_to", F.sum("_len").over(w)).withColumn("_all", F.sum("_len").over(Window.partitionBy(*keys)))
    hit = seg.where(c("_to") >= c("_all") * fraction).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    part = (c("_all") * fraction - (c("_to") - c("_len"))) / c("_len")
    return hit.select(*keys, (c("lon") + (c("_x") - c("lon")) * part).alias("lon"), (c("lat") + (c("_y") - c("lat")) * part).alias("lat"))


def feature_errors(kind: Column, object_type: Column, lon: Column, lat: Column, n: Column) -> Column:
    """What is wrong with a feature; one without geometry is only held to its properties."""
    least = F.when(kind == "LineString", 2).when(kind == "Polygon", 4).otherwise(1)
    return errors({"object type": object_type != "", "geometry type": kind.isNull() | kind.isin(KINDS), "coordinate range": kind.isNull() | ((F.abs(lon) <= 180) & (F.abs(lat) <= 90)), "too few points": kind.isNull() | (n >= least)})


def kind_counts(rows: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Features of each group by class of geometry, those without one, and those that can be drawn."""
    of = lambda *k: F.count_if(F.col(kind).isin(*k))
    return rows.groupBy(*keys).agg(of("Point", "MultiPoint").alias("points"), of("LineString", "MultiLineString").alias("lines"), of("Polygon", "MultiPolygon").alias("polygons"), F.count_if(F.col(kind).isNull()).alias("without"), F.count_if(F.col(kind).isin(KINDS)).alias("renderable"))


def fold_legs(legs: DataFrame, key: str) -> DataFrame:
    """(key, sequence, status, from_lon, from_lat, to_lon, to_lat): each leg from where the one before ended.

    ``legs`` has key, sequence, path_terminator, lon and lat of its fix or nulls, course
    and nm; NaN counts as null. A leg with a fix ends there (EXACT); one with course and
    distance ends where they lead, EXACT_START if its start is exact, else DERIVED; others,
    and those before any place is known, are OPEN and leave the state as it is. As a fix
    settles where the legs after it begin, legs are folded in runs from fix to fix, each
    in its row; between runs only the last place is handed on. A run takes time that
    grows with the square of its length.
    """
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    lon, lat = known("lon"), known("lat")
    leg = F.struct("sequence", F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat"))).alias("fix"), known("course").alias("course"), known("nm").alias("nm"))
    place, kind = "struct<lon: double, lat: double>", {f.name: f.dataType.simpleString() for f in legs.schema}["sequence"]
    line = f"array<struct<sequence: {kind}, status: string, start: {place}, end: {place}>>"
    state = F.struct(F.lit(None).cast(place).alias("at"), F.lit(False).alias("exact"), F.array().cast(line).alias("out"))

    def step(a: Column, x: Column) -> Column:
        led = F.when(a["at"].isNotNull() & x["course"].isNotNull() & x["nm"].isNotNull(), geo.destination(a["at"]["lon"], a["at"]["lat"], x["course"], x["nm"]))

        def ended(to: Column) -> Column:
            status = F.when(x["fix"].isNotNull(), "EXACT").when(to.isNotNull() & a["exact"], "EXACT_START").when(to.isNotNull(), "DERIVED").otherwise("OPEN")
            out = F.concat(a["out"], F.array(F.struct(x["sequence"].alias("sequence"), status.alias("status"), a["at"].alias("start"), to.alias("end"))))
            return F.struct(F.coalesce(to, a["at"]).alias("at"), F.when(to.isNotNull(), x["fix"].isNotNull()).otherwise(a["exact"]).alias("exact"), out.alias("out"))

        return F.get(F.transform(F.array(F.coalesce(x["fix"], led)), ended), F.lit(0))

    of = Window.partitionBy(key)
    runs = legs.select(key, leg.alias("l")).withColumn("_run", F.count("l.fix").over(of.orderBy("l").rowsBetween(Window.unboundedPreceding, 0)))
    folded = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list("l")).alias("l")).select(key, "_run", F.aggregate("l", state, step).alias("f"))
    rows = folded.withColumn("_before", F.lag("f.at").over(of.orderBy("_run"))).select(key, "_before", F.posexplode("f.out").alias("_i", "x"))
    start = F.when(F.col("_i") == 0, F.col("_before")).otherwise(F.col("x.start"))
    return rows.select(key, "x.sequence", "x.status", start["lon"].alias("from_lon"), start["lat"].alias("from_lat"), F.col("x.end.lon").alias("to_lon"), F.col("x.end.lat").alias("to_lat"))


def _radial_fix(deg: Column, nm: Column) -> Column:
    """D, three digits of the radial, and a letter that counts miles from A."""
    return F.concat(F.lit("D"), F.lpad(F.floor(deg + 0.5).cast("string"), 3, "0"), F.char(F.greatest(F.lit(1), F.least(F.lit(26), F.floor(nm + 0.5))) + 64))


def arc_legs(charts: DataFrame, radials: DataFrame) -> DataFrame:
    """(chart, procedure, sequence, path_terminator, from_fix, fix, course_deg, distance_nm, turn): legs of procedures that are drawn as arcs but have no table.

    ``charts`` has chart, radius_nm, outer_nm and common_fix; ``radials`` has chart, deg,
    inbound_deg and procedures, the names of those that use it. The final radial is
    the one of most procedures. A procedure enters on its radial farthest from it,
    flies in to the arc, along it over its other radials in the order they are met,
    and from the final radial to the common fix. Procedures without a radial of their
    own have no legs.
    """
    c = F.col
    order = [F.desc(F.size("procedures")), F.desc(c("inbound_deg").isNotNull()), c("deg")]
    final = top_one(radials, ["chart"], order).select("chart", c("deg").alias("final"), c("inbound_deg").alias("inbound"))
    own = radials.join(final, "chart").where("deg <> final").select("chart", "deg", "final", "inbound", F.explode("procedures").alias("procedure"))
    far = F.struct(geo.circular_apart(c("deg"), c("final")).alias("apart"), (-c("deg")).alias("first"))
    met = own.groupBy("chart", "procedure", "final", "inbound").agg(F.max_by("deg", far).alias("entry"), F.collect_set("deg").alias("degs")).join(charts, "chart")
    right = F.pmod(c("final") - c("entry") + 540, F.lit(360.0)) - 180 >= 0
    met = met.withColumn("turn", F.when(right, "R").otherwise("L"))
    ahead = lambda d: F.pmod(F.when(c("turn") == "R", d - c("entry")).otherwise(c("entry") - d) + 360, F.lit(360.0))
    over = F.filter("degs", lambda d: (d != c("entry")) & (ahead(d) < ahead(c("final"))))
    passed = F.transform(F.array_sort(F.transform(over, lambda d: F.struct(ahead(d).alias("o"), d.alias("d")))), lambda x: x["d"])
    met = met.withColumn("stops", F.concat(passed, F.array("final")))
    round1 = lambda x: F.floor(x * 10 + 0.5) / 10
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def leg(pt: str, start: Column, fix: Column, course: Column, nm: Column, turn: Column) -> Column:
        return F.struct(F.lit(pt).alias("path_terminator"), start.alias("from_fix"), fix.alias("fix"), course.cast("double").alias("course_deg"), nm.cast("double").alias("distance_nm"), turn.alias("turn"))

    entry_fix, outer = F.upper(F.substring_index(F.trim("procedure"), " ", 1)), _radial_fix(c("entry"), c("outer_nm"))
    begin = F.array(leg("IF", text, entry_fix, number, number, text), leg("TF", entry_fix, outer, number, number, text), leg("CI", outer, text, F.pmod(c("entry") + 180, F.lit(360.0)), round1(c("outer_nm") - c("radius_nm")), text))
    before = F.concat(F.array("entry"), c("stops"))
    arcs = F.transform(c("stops"), lambda d, i: leg("AF", F.when(i > 0, _radial_fix(F.get(before, i), c("radius_nm"))), _radial_fix(d, c("radius_nm")), number, round1(c("radius_nm") * F.radians(ahead(d) - ahead(F.get(before, i)))), c("turn")))
    end = F.when(c("common_fix").isNotNull(), F.array(leg("TF", _radial_fix(c("final"), c("radius_nm")), c("common_fix"), c("inbound"), number, text))).otherwise(F.slice(begin, 1, 0))
    return met.select("chart", "procedure", F.posexplode(F.concat(begin, arcs, end)).alias("i", "leg")).select("chart", "procedure", ((c("i") + 1) * 10).alias("sequence"), "leg.*")
