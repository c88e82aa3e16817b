"""Features of procedures: an order is a procedure, its line items are legs, and suppliers and customers of a nation are its fixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waylark.functions.tolerance import round_half_up
from waylark.operators import features

from .common import sql_round, table

Q: dict = {}
S: dict = {}
TERMINATORS = ["VA", "CA", "CI", "CF", "DF", "TF", "AF", "CR"]


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


def airport_references(spark, sf_dir):
    """Places of each nation by three sources: suppliers, then every third customer, then its aids and its runway."""
    place = lambda d, nation, k, kind, ident: d.select(nation.alias("airport"), F.lit(kind).alias("kind"), ident.alias("ident"), (nation * 10 - 120 + k * 37 % 100 / 50.0).cast("double").alias("lon"), (nation * 2 - 25 + k * 53 % 100 / 50.0).cast("double").alias("lat"))
    named = lambda k, n: F.concat(F.lit("f"), (k % n).cast("string"))
    s, c, n = F.col("s_suppkey"), F.col("c_custkey"), F.col("n_nationkey")
    one = place(table(spark, sf_dir, "supplier"), F.col("s_nationkey"), s, "FIX", named(s, 40))
    two = place(table(spark, sf_dir, "customer").where(c % 3 == 0), F.col("c_nationkey"), c, "FIX", named(c, 60))
    nation = table(spark, sf_dir, "nation")
    aids = place(nation.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))), n, F.col("k") * 3 + 1, "NAVAID", F.concat(F.lit("N"), F.col("k").cast("string")))
    runway = place(nation, n, F.lit(7), "RUNWAY", F.lit("RWY 16"))
    ends = runway.withColumn("end_lon", F.col("lon") + 0.03).withColumn("end_lat", F.col("lat") - 0.02)
    return features.references([one, two, aids, ends], ["airport"])


def airport_legs(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(w))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    j = l.join(o, "l_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("double")
    pt = F.element_at(F.array(*map(F.lit, TERMINATORS)), (s % 8 + 1).cast("int"))
    t = lambda c: c.cast("string")
    to_fix = F.when(pt.isin("VA", "CA", "CI", "CR"), None).when((pt == "CF") & (p % 5 == 0), F.concat(F.lit("C"), t(p % 9))).when((pt == "AF") & (F.col("seq") == 2), F.concat(F.lit("D"), F.lpad(t(p % 365), 3, "0"), F.char(p % 20 + 65))).when(p % 13 == 0, F.concat(t(p % 9 + 1), F.lit(" DME ABC"))).when(p % 11 == 0, "RW16").otherwise(F.concat(F.lit("F"), t(p % 70)))
    text = F.lit(None).cast("string")
    return j.select(
        F.col("c_nationkey").alias("airport"), F.col("l_orderkey").alias("procedure"), (F.col("seq") * 10).alias("sequence"), pt.alias("path_terminator"), text.alias("from_fix"), to_fix.alias("to_fix"), F.when(s % 7 > 0, (p % 360).cast("double") + 0.25).alias("course_deg"), F.when(q % 3 > 0, q / 5).alias("distance_nm"),
        F.when(pt == "AF", F.when(p % 3 == 0, "L").when(p % 3 == 1, "R")).alias("turn"), text.alias("remarks"), F.concat(F.lit("n"), t((p + s) % 4)).alias("recommended_navaid"), F.when(s % 6 == 0, (p * 7 % 360).cast("double")).alias("theta_deg"), F.when(p % 9 == 0, 10.0).alias("rho_nm"), F.lit("RWY16").alias("runway"), F.lit(False).alias("departure"),
    )


def _dx(lon, lat, course, nm):
    return f"({lon} + degrees(atan2(sin(radians({course})) * sin({nm} / 3440.065::DOUBLE) * cos(radians({lat})), cos({nm} / 3440.065::DOUBLE) - sin(radians({lat})) * sin(radians({_dy(lon, lat, course, nm)})))))"


def _dy(lon, lat, course, nm):
    return f"degrees(asin(sin(radians({lat})) * cos({nm} / 3440.065::DOUBLE) + cos(radians({lat})) * sin({nm} / 3440.065::DOUBLE) * cos(radians({course}))))"


def _brg(a, b, c, d):
    return f"((degrees(atan2(sin(radians({c}) - radians({a})) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians({c}) - radians({a})))) + 360) % 360)"


def _dst(a, b, c, d):
    return f"(2 * asin(sqrt(power(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * power(sin((radians({c}) - radians({a})) / 2), 2))) * 3440.065::DOUBLE)"


_KLON, _KLAT = "({n} * 10 - 120 + {k} * 37 % 100 / 50.0)::DOUBLE", "({n} * 2 - 25 + {k} * 53 % 100 / 50.0)::DOUBLE"
_place = lambda n, k: f"{_KLON.format(n=n, k=k)} AS lon, {_KLAT.format(n=n, k=k)} AS lat"
FEATURES = f"""
WITH RECURSIVE src AS (
  SELECT s_nationkey AS ap, 'F' || (s_suppkey % 40) AS ident, 1 AS src, {_place("s_nationkey", "s_suppkey")} FROM supplier
  UNION ALL SELECT c_nationkey, 'F' || (c_custkey % 60), 2, {_place("c_nationkey", "c_custkey")} FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT n_nationkey, 'N' || k, 3, {_place("n_nationkey", "(k * 3 + 1)")} FROM nation, (SELECT unnest([0, 1, 2]) AS k)),
ref AS MATERIALIZED (SELECT ap, ident, lon, lat FROM src QUALIFY row_number() OVER (PARTITION BY ap, ident ORDER BY src DESC, lon DESC, lat DESC) = 1),
rw AS MATERIALIZED (SELECT n_nationkey AS ap, {_place("n_nationkey", "7")} FROM nation),
l0 AS (SELECT c_nationkey AS ap, l_orderkey AS pr, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, (ARRAY{TERMINATORS!r})[CAST(l_suppkey % 8 + 1 AS INT)] AS pt, l_partkey AS p, l_suppkey AS s, l_quantity::DOUBLE AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
l1 AS (SELECT *, CASE WHEN pt IN ('VA', 'CA', 'CI', 'CR') THEN '' WHEN pt = 'CF' AND p % 5 = 0 THEN 'C' || (p % 9) WHEN pt = 'AF' AND i = 2 THEN 'D' || lpad((p % 365)::VARCHAR, 3, '0') || chr(CAST(p % 20 + 65 AS INT)) WHEN p % 13 = 0 THEN (p % 9 + 1) || ' DME ABC' WHEN p % 11 = 0 THEN 'RW16' ELSE 'F' || (p % 70) END AS ident,
    CASE WHEN s % 7 > 0 THEN (p % 360)::DOUBLE + 0.25 END AS course, CASE WHEN q % 3 > 0 THEN q / 5 END AS nm, CASE WHEN pt = 'AF' THEN CASE p % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' END END AS turn, 'N' || ((p + s) % 4) AS aid FROM l0),
l2 AS (SELECT *, CASE WHEN ident LIKE '% DME ABC' THEN (p % 9 + 1)::DOUBLE END AS named, coalesce(CASE WHEN s % 6 = 0 THEN (p * 7 % 360)::DOUBLE END, CASE WHEN lead(pt) OVER w = 'CF' THEN coalesce(CASE WHEN lead(s) OVER w % 6 = 0 THEN (lead(p) OVER w * 7 % 360)::DOUBLE END, lead(course) OVER w) END) AS radial FROM l1 WINDOW w AS (PARTITION BY pr ORDER BY i)),
ac AS (SELECT ap, 0 AS rank, 'N0' AS ident, 12.0::DOUBLE AS radius FROM (SELECT n_nationkey AS ap FROM nation WHERE n_nationkey % 2 = 0) UNION ALL (SELECT ap, 1, aid, 10.0 FROM l2 WHERE pt = 'AF' AND p % 9 = 0 QUALIFY row_number() OVER (PARTITION BY ap ORDER BY pr, i) = 1)),
arc AS MATERIALIZED (SELECT ac.ap, lon AS clon, lat AS clat FROM ac JOIN ref USING (ap, ident) QUALIFY row_number() OVER (PARTITION BY ac.ap ORDER BY rank) = 1),
lg AS MATERIALIZED (SELECT l2.*, f.lon AS flon, f.lat AS flat, CASE WHEN regexp_extract(l2.ident, '[0-9]{{2}}[A-Z]?') = '16' THEN rw.lon END AS rlon, CASE WHEN regexp_extract(l2.ident, '[0-9]{{2}}[A-Z]?') = '16' THEN rw.lat END AS rlat, a.lon AS alon, a.lat AS alat, rw.lon AS slon, rw.lat AS slat, rw.lon + 0.03 AS elon, rw.lat - 0.02 AS elat, clon, clat
  FROM l2 JOIN rw USING (ap) LEFT JOIN ref f ON f.ap = l2.ap AND f.ident = l2.ident LEFT JOIN ref a ON a.ap = l2.ap AND a.ident = l2.aid LEFT JOIN arc ON arc.ap = l2.ap),
fold AS (
  SELECT ap, pr, 0::BIGINT AS i, NULL::DOUBLE AS x, NULL::DOUBLE AS y, false AS exact, NULL::DOUBLE AS dme, '' AS pt, '' AS ident, NULL::DOUBLE AS gx, NULL::DOUBLE AS gy, NULL::DOUBLE AS hx, NULL::DOUBLE AS hy, NULL::VARCHAR AS quality, NULL::VARCHAR AS status, NULL::BOOLEAN AS schematic, 0::BIGINT AS n FROM (SELECT DISTINCT ap, pr FROM lg)
  UNION ALL
  SELECT ap, pr, i, CASE WHEN lost THEN bx WHEN hx IS NOT NULL THEN hx ELSE coalesce(tx, bx) END, CASE WHEN lost THEN by_ WHEN hx IS NOT NULL THEN hy ELSE coalesce(ty, by_) END, CASE WHEN lost OR open_ THEN false WHEN hx IS NOT NULL OR tx IS NOT NULL THEN known ELSE bexact END, CASE WHEN lost OR open_ THEN dme ELSE coalesce(named, dme) END, pt, ident,
    CASE WHEN hx IS NOT NULL THEN bx END, CASE WHEN hx IS NOT NULL THEN by_ END, hx, hy, CASE WHEN lost THEN 'missing_fix_coordinate' ELSE kind END,
    CASE WHEN lost THEN 'MISSING_FIX_COORDINATE' WHEN kind IS NULL THEN NULL WHEN pt = 'DF' THEN 'CONDITIONAL_FROM_PREVIOUS_LEG' WHEN pt IN ('VA', 'CA', 'CI', 'CR') THEN 'INDETERMINATE' WHEN bexact AND known AND kind = 'derived_from_fix_coordinates' THEN 'EXACT_FROM_FIXES' WHEN known THEN 'CONDITIONAL_FROM_PREVIOUS_LEG' ELSE 'SCHEMATIC' END,
    CASE WHEN lost THEN false WHEN kind IS NULL THEN NULL WHEN pt = 'DF' THEN NOT bexact WHEN pt IN ('VA', 'CA', 'CI', 'CR') THEN true WHEN bexact AND known AND kind = 'derived_from_fix_coordinates' THEN false WHEN known THEN NOT bexact ELSE true END, n
  FROM (
    SELECT *, CASE WHEN kind IS NULL THEN 0 WHEN kind <> 'derived_from_dme_arc_semantics' THEN 2 ELSE greatest(8, CAST(ceil(abs(sweep) / 5) AS BIGINT)) + 1 END AS n FROM (
    SELECT *, CASE WHEN cw = 0 THEN 0 WHEN turn = 'R' THEN cw WHEN turn = 'L' THEN cw - 360 WHEN cw <= 180 THEN cw ELSE cw - 360 END AS sweep FROM (
    SELECT *, ({_brg("clon", "clat", "tx", "ty")} - {_brg("clon", "clat", "bx", "by_")} + 360) % 360 AS cw,
      CASE WHEN how IN ('VA', 'CA', 'CI') THEN {_dx("bx", "by_", "course", "far")} WHEN how = 'X' THEN {_dx("alon", "alat", "radial", "along_r")} WHEN how IN ('AF', 'T') THEN tx END AS hx,
      CASE WHEN how IN ('VA', 'CA', 'CI') THEN {_dy("bx", "by_", "course", "far")} WHEN how = 'X' THEN {_dy("alon", "alat", "radial", "along_r")} WHEN how IN ('AF', 'T') THEN ty END AS hy,
      CASE how WHEN 'VA' THEN 'schematic_course_to_altitude' WHEN 'CA' THEN 'derived_from_sid_course_to_altitude' WHEN 'AF' THEN 'derived_from_dme_arc_semantics' WHEN 'T' THEN tq ELSE CASE WHEN how IS NULL THEN NULL WHEN pt = 'CR' THEN 'derived_from_course_to_radial' ELSE 'derived_from_course_intercept' END END AS kind FROM (
    SELECT *, ident <> '' AND tx IS NULL AS lost, pt = 'VA' AND tx IS NULL AND course IS NOT NULL AS open_, coalesce(tx IS NOT NULL AND tk = 1, false) AS known,
      CASE WHEN ident <> '' AND tx IS NULL THEN NULL WHEN tx IS NULL AND course IS NOT NULL THEN CASE WHEN pt IN ('VA', 'CA') THEN pt WHEN pt IN ('CI', 'CR') THEN CASE WHEN abs(den) >= 1e-6 AND along_c >= 0.05 AND along_r >= 0.05 THEN 'X' ELSE 'CI' END END WHEN tx IS NOT NULL THEN CASE WHEN pt = 'AF' AND clon IS NOT NULL THEN 'AF' ELSE 'T' END END AS how,
      CASE WHEN pt = 'CA' AND coalesce(nm, 0) <= 0 THEN greatest(2.0::DOUBLE, {_dst("bx", "by_", "elon", "elat")} + 0.45) WHEN nm > 0 THEN nm ELSE 2.0::DOUBLE END AS far,
      CASE tk WHEN 2 THEN 'derived_from_runway_threshold' WHEN 3 THEN 'derived_from_radar_sid_dme' WHEN 4 THEN 'derived_from_vor_dme_radial_distance' WHEN 5 THEN 'derived_from_dme_fix_name' ELSE 'derived_from_fix_coordinates' END AS tq FROM (
    SELECT *, CASE tk WHEN 1 THEN flon WHEN 2 THEN rlon WHEN 3 THEN {_dx("bx", "by_", "course", "td")} WHEN 4 THEN {_dx("alon", "alat", "course", "nm")} WHEN 5 THEN {_dx("clon", "clat", "tr", "td")} END AS tx, CASE tk WHEN 1 THEN flat WHEN 2 THEN rlat WHEN 3 THEN {_dy("bx", "by_", "course", "td")} WHEN 4 THEN {_dy("alon", "alat", "course", "nm")} WHEN 5 THEN {_dy("clon", "clat", "tr", "td")} END AS ty,
      (vy * sin(radians(radial)) - vx * cos(radians(radial))) / nullif(den, 0) AS along_c, (vy * sin(radians(course)) - vx * cos(radians(course))) / nullif(den, 0) AS along_r FROM (
    SELECT *, CASE WHEN ident = '' THEN NULL WHEN flon IS NOT NULL THEN 1 WHEN rlon IS NOT NULL THEN 2 WHEN named IS NOT NULL AND course IS NOT NULL THEN 3 WHEN pt = 'CF' AND alon IS NOT NULL AND course IS NOT NULL AND nm > 0 THEN 4 WHEN clon IS NOT NULL AND regexp_matches(ident, '^D[0-9]{{3}}[A-Z]$') AND substr(ident, 2, 3)::INT <= 360 THEN 5 END AS tk,
      CASE WHEN named IS NOT NULL THEN greatest(0.2::DOUBLE, named - coalesce(dme, 0)) ELSE (ascii(ident[5]) - 64)::DOUBLE END AS td, CASE WHEN regexp_matches(ident, '^D[0-9]{{3}}[A-Z]$') THEN substr(ident, 2, 3)::DOUBLE END AS tr,
      (bx - alon) * 60 * cos(radians(alat)) AS vx, (by_ - alat) * 60 AS vy, sin(radians(course)) * cos(radians(radial)) - cos(radians(course)) * sin(radians(radial)) AS den FROM (
    SELECT lg.*, coalesce(f.x, slon) AS bx, coalesce(f.y, slat) AS by_, CASE WHEN f.x IS NULL THEN true ELSE f.exact END AS bexact, f.dme FROM fold f JOIN lg ON lg.pr = f.pr AND lg.i = f.i + 1)))))))
  ),
legs AS (SELECT * FROM fold WHERE i > 0 AND status IS NOT NULL)
SELECT pr AS procedure, 'ProcedureLeg' AS object_type, CAST(i * 10 AS INT) AS sequence, pt AS path_terminator, nullif(ident, '') AS to_fix, status, schematic, quality, CAST(n AS INT) AS n_points, {sql_round("gx", 4)} AS from_lon, {sql_round("gy", 4)} AS from_lat, {sql_round("hx", 4)} AS to_lon, {sql_round("hy", 4)} AS to_lat FROM legs
UNION ALL
SELECT pr, 'ProcedureTrack', 0, NULL, NULL, NULL, bool_or(quality <> 'derived_from_fix_coordinates'), CASE WHEN bool_or(quality <> 'derived_from_fix_coordinates') THEN 'derived_from_leg_chain' ELSE 'derived_from_fix_coordinates' END, CAST(1 + sum(n - 1) AS INT),
  {sql_round("arg_min(gx, i)", 4)}, {sql_round("arg_min(gy, i)", 4)}, {sql_round("arg_max(hx, i)", 4)}, {sql_round("arg_max(hy, i)", 4)} FROM legs WHERE n > 0 GROUP BY pr
"""


@query("procedure_features", FEATURES)
def procedure_features(spark, sf_dir):
    """The legs and tracks of all procedures, with their ends and numbers of points."""
    refs = airport_references(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    semantics = nation.select(F.col("n_nationkey").alias("airport"), F.lit(1).alias("ordinal"), F.lit("n0").alias("center_ident"), F.lit(12.0).alias("radius_nm"))
    out = features.procedure_features(airport_legs(spark, sf_dir), refs, semantics, ["airport"])
    end = lambda at, c: round_half_up(F.try_element_at("points", F.lit(at))[c], 4)
    return out.select("procedure", "object_type", "sequence", "path_terminator", "to_fix", "status", "schematic", "quality", F.coalesce(F.size("points"), F.lit(0)).alias("n_points"), end(1, "lon").alias("from_lon"), end(1, "lat").alias("from_lat"), end(-1, "lon").alias("to_lon"), end(-1, "lat").alias("to_lat"))
