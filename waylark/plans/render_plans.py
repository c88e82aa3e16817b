"""What is drawn from which source: a customer is a package, its orders are the model's procedures, line items by supplier are records."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.operators import render

from .common import table

Q: dict = {}
S: dict = {}
MODES, RUNWAYS = ["AI", "JEPPESEN_424", "AUTO", "AUTO", "AUTO", "AUTO", "AUTO"], ["RWY 16", "RW34", "RWY 16"]


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


def sources(spark, sf_dir):
    t = lambda c: c.cast("string")
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    name = lambda k: F.concat(F.translate(F.lpad(t(k % 37), 2, "0"), "0123456789", "ABCDEFGHIJ"), F.lit("XYZ "), t(k % 3 + 1), F.lit("A"))
    cut = lambda k: F.concat(F.translate(F.lpad(t(k % 37), 2, "0"), "0123456789", "ABCDEFGHIJ"), F.lit("XY"), t(k % 3 + 1), F.lit("A"))
    c, k, p = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_partkey")
    customer = table(spark, sf_dir, "customer")
    names = F.when(c % 4 == 0, F.array(name(c))).when(c % 4 == 1, F.array(F.lit("  odd  name "), F.lit(""))).otherwise(F.array().cast("array<string>"))
    packages = customer.select(F.col("c_nationkey").alias("scope"), c.alias("package"), F.when(c % 3 == 0, "RWY16").otherwise("").alias("runway"), names.alias("names"), of(MODES, c).alias("mode"))
    o = table(spark, sf_dir, "orders").join(customer.select(c.alias("o_custkey"), "c_nationkey"), "o_custkey")
    procedures = o.select(F.col("c_nationkey").alias("scope"), F.col("o_custkey").alias("package"), k.alias("ordinal"), F.when(k % 5 == 0, F.lower(name(k))).otherwise(name(k)).alias("name"), F.lit("RWY16").alias("runway"), (k % 10 / 10.0).cast("double").alias("confidence"), (k % 4).cast("int").alias("n_legs"))
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").where("l_linenumber <= 2 and l_orderkey % 4 = 0")
    ordinal = F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + p % 1000 * 100 + F.col("l_suppkey") % 100
    records = l.select(F.col("s_nationkey").alias("scope"), ordinal.alias("ordinal"), F.when(p % 2 == 0, cut(p)).otherwise(name(p)).alias("procedure_name"), of(RUNWAYS, p).alias("runway"), t(p % 40).alias("sequence"), of(["CI", "TF", "CF"], F.col("l_suppkey")).alias("path_terminator"), F.when(p % 7 > 0, F.concat(F.lit("F"), t(p % 50))).otherwise("").alias("fix"), F.when(p % 4 == 0, (p % 360).cast("double")).alias("theta_deg"), F.when(p % 5 > 0, F.concat(F.lit("N"), t(p % 9))).alias("recommended_navaid"))
    return packages, procedures, records


_NAME = "translate(lpad(({k} % 37)::VARCHAR, 2, '0'), '0123456789', 'ABCDEFGHIJ') || 'XYZ ' || ({k} % 3 + 1) || 'A'"
_SIG = "translate(lpad(({k} % 37)::VARCHAR, 2, '0'), '0123456789', 'ABCDEFGHIJ') || 'XY|' || ({k} % 3 + 1) || 'A'"
PLAN = f"""
WITH pk AS MATERIALIZED (SELECT c_nationkey AS scope, c_custkey AS package, CASE WHEN c_custkey % 3 = 0 THEN 'RW16' ELSE '' END AS rw, (ARRAY{MODES!r})[CAST(c_custkey % 7 + 1 AS INT)] AS mode FROM customer),
pr AS MATERIALIZED (SELECT pk.*, o_orderkey AS k, {_SIG.format(k="o_orderkey")} AS sig, CASE WHEN o_orderkey % 5 = 0 THEN lower({_NAME.format(k="o_orderkey")}) ELSE {_NAME.format(k="o_orderkey")} END AS name, o_orderkey % 10 / 10.0::DOUBLE AS conf, o_orderkey % 4 AS n FROM orders JOIN pk ON o_custkey = package),
nm AS MATERIALIZED (SELECT DISTINCT scope, package, sig FROM pr UNION SELECT scope, package, {_SIG.format(k="package")} FROM pk WHERE package % 4 = 0 UNION SELECT scope, package, 'ODD NAME' FROM pk WHERE package % 4 = 1),
r0 AS (SELECT s_nationkey AS scope, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 1000 * 100 + l_suppkey % 100 AS ordinal, l_partkey AS p, l_suppkey AS s, {_SIG.format(k="l_partkey")} AS sig, CASE WHEN l_partkey % 2 = 0 THEN replace({_NAME.format(k="l_partkey")}, 'Z ', '') ELSE {_NAME.format(k="l_partkey")} END AS name,
  (ARRAY{RUNWAYS!r})[CAST(l_partkey % 3 + 1 AS INT)] AS runway FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 2 AND l_orderkey % 4 = 0),
r1 AS (SELECT *, CASE WHEN runway = 'RW34' THEN 'RW34' ELSE 'RW16' END AS rk, lag(CASE WHEN p % 7 > 0 THEN 'F' || (p % 50) ELSE '' END) OVER w AS before, CASE WHEN p % 7 > 0 THEN 'F' || (p % 50) ELSE '' END AS fix,
    coalesce(CASE WHEN p % 4 = 0 THEN p % 360 END, CASE WHEN s % 3 = 0 THEN CASE WHEN lead(p) OVER w % 4 = 0 THEN lead(p) OVER w % 360 END END) AS radial, coalesce(CASE WHEN p % 5 > 0 THEN 'N' || (p % 9) END, CASE WHEN lead(p) OVER w % 5 > 0 THEN 'N' || (lead(p) OVER w % 9) END) AS aid
  FROM r0 WINDOW w AS (PARTITION BY scope, name, CASE WHEN runway = 'RW34' THEN 'RW34' ELSE 'RW16' END ORDER BY p % 40, ordinal)),
g AS MATERIALIZED (SELECT scope, sig, name, rk, min(ordinal) AS ordinal, arg_min(runway, ordinal) AS runway, count(*) AS n, string_agg((p % 40) || ':' || coalesce(before, '') || '>' || fix || CASE WHEN radial IS NOT NULL AND aid IS NOT NULL THEN ':RDL' || lpad(radial::VARCHAR, 3, '0') || ' ' || aid ELSE '' END, ';' ORDER BY p % 40, r1.ordinal) AS legs FROM r1 GROUP BY scope, sig, name, rk),
f AS MATERIALIZED (SELECT pk.scope, pk.package, g.sig, g.name, g.runway, g.ordinal, g.n, g.legs FROM pk JOIN nm USING (scope, package) JOIN g ON g.scope = pk.scope AND g.sig = nm.sig WHERE mode <> 'AI' AND (rw = '' OR rw = rk)
  UNION ALL SELECT pk.scope, pk.package, g.sig, g.name, g.runway, g.ordinal, g.n, g.legs FROM pk JOIN g ON g.scope = pk.scope WHERE mode <> 'AI' AND (rw = '' OR rw = rk) AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.package = pk.package)),
ff AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY package, sig ORDER BY ordinal) = 1),
mi AS MATERIALIZED (SELECT pr.scope, pr.package, 0 AS o1, pr.k AS o2, pr.name, 'RWY16' AS runway, CASE WHEN ff.ordinal IS NOT NULL THEN 'JEPPESEN_424' ELSE 'AI' END AS source, CASE WHEN ff.ordinal IS NOT NULL THEN 0.98::DOUBLE ELSE conf END AS confidence, coalesce(ff.n, pr.n) AS n, ff.legs, ff.ordinal AS grp FROM pr LEFT JOIN ff ON ff.package = pr.package AND ff.sig = pr.sig),
ev AS MATERIALIZED (SELECT * FROM mi UNION ALL SELECT scope, package, 1, ordinal, name, runway, 'JEPPESEN_424', 0.98, n, legs, ordinal FROM f WHERE NOT EXISTS (SELECT 1 FROM mi WHERE mi.package = f.package AND mi.grp = f.ordinal)),
us AS (SELECT package, count(*) AS rp, sum(n) AS rl FROM (SELECT DISTINCT package, grp, n FROM ev WHERE grp IS NOT NULL) GROUP BY package),
te AS (SELECT package, count(*) FILTER (source = 'AI') AS ai, count(*) FILTER (o1 = 0) AS mp FROM ev GROUP BY package)
"""


@query("render_plan", PLAN + """
SELECT scope, package, mode, CASE WHEN rp IS NULL THEN 'AI' WHEN ai > 0 THEN 'HYBRID' ELSE 'JEPPESEN_424' END AS source, coalesce(rp, 0) AS record_procedures, CAST(coalesce(rl, 0) AS BIGINT) AS record_legs, coalesce(mp, 0) AS model_procedures,
  CASE WHEN rp IS NULL AND mode = 'JEPPESEN_424' THEN 'No records match this package.' WHEN rp IS NOT NULL AND ai > 0 THEN ai || ' procedures have no record and are drawn from the answer.' ELSE '' END AS warning
FROM pk LEFT JOIN us USING (package) LEFT JOIN te USING (package)""")
def render_plan(spark, sf_dir):
    plans, _ = render.render_plan(*sources(spark, sf_dir), ["scope"], "package")
    return plans.withColumn("warning", F.array_join("warnings", " ")).drop("warnings")


@query("render_parts", PLAN + "SELECT package, CAST(row_number() OVER (PARTITION BY package ORDER BY o1, o2) AS INT) AS position, name, runway, source, confidence, CAST(n AS INT) AS n_legs, coalesce(legs, '') AS legs FROM ev")
def render_parts(spark, sf_dir):
    """The procedures of all plans in order, with the legs that records give them."""
    shown = lambda x: F.concat(F.concat_ws(":", x["sequence"].cast("long").cast("string"), F.concat(F.coalesce(x["from_fix"], F.lit("")), F.lit(">"), F.coalesce(x["to_fix"], F.lit("")))), F.when(x["remarks"].isNotNull(), F.concat(F.lit(":"), x["remarks"])).otherwise(""))
    _, parts = render.render_plan(*sources(spark, sf_dir), ["scope"], "package", lambda legs: F.array_join(F.transform(legs, shown), ";"))
    return parts.select("package", "position", "name", "runway", "source", "confidence", "n_legs", F.coalesce("legs", F.lit("")).alias("legs"))
