"""Queries of sources, sinks and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions.tolerance import round_half_up
from waylark.operators import merge
from waylark.sources import external, files
from waylark.streaming import microbatch

from .common import table
from .geo_plans import POINTS, points

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


def collections(spark, sf_dir):
    p = points(spark, sf_dir)
    geometry = F.when(F.col("id") % 7 > 0, F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("id").cast("string").alias("ident"), F.when(F.col("id") % 2 == 0, "fix").otherwise("navaid").alias("object_type")).alias("properties"))
    return files.feature_collection(p.withColumn("grp", F.col("id") % 20), ["grp"], "id", feature)


@query("geojson_features", f"WITH {POINTS} SELECT id % 20 AS grp, CAST(row_number() OVER (PARTITION BY id % 20 ORDER BY id) - 1 AS INT) AS ordinal, CASE WHEN id % 7 > 0 THEN 'Point' END AS geometry_type, CAST(id AS VARCHAR) AS ident, CASE WHEN id % 2 = 0 THEN 'fix' ELSE 'navaid' END AS object_type FROM p")
def geojson_features(spark, sf_dir):
    """Collections written as GeoJSON text and read again as features."""
    f = files.features(collections(spark, sf_dir), "geojson")
    return f.select("grp", "ordinal", "geometry_type", F.col("properties")["ident"].alias("ident"), F.col("properties")["object_type"].alias("object_type"))


@query("prompt_runs", "SELECT o_orderkey AS id, sha256('{\"status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}') AS input_hash FROM orders")
def prompt_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return files.run_record(o, "id").select("id", "input_hash")


@query("external_replay", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '5%' THEN NULL WHEN o_orderpriority LIKE '4%' THEN '' ELSE 'seen ' || o_orderpriority END AS response, CASE WHEN o_orderpriority LIKE '5%' THEN 'MISSING' WHEN o_orderpriority LIKE '4%' THEN 'EMPTY' ELSE 'OK' END AS status FROM orders")
def external_replay(spark, sf_dir):
    """Requests answered from a table of recorded answers."""
    o = files.run_record(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"), "id")
    known = o.select("input_hash", F.get_json_object("input", "$.o_orderpriority").alias("p")).distinct().where("p not like '5%'")
    recorded = known.select("input_hash", F.when(F.col("p").startswith("4"), "").otherwise(F.concat(F.lit("seen "), "p")).alias("response"))
    return external.replay(o, recorded).select("id", "response", "status")


@query("settings_lines", "SELECT 'K' || n_regionkey AS key, arg_min(n_name, n_nationkey) AS setting FROM nation GROUP BY 1")
def settings_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    lines = n.select(F.explode(F.array(F.lit("# comment"), F.lit(""), F.concat(F.lit(" K"), F.col("n_regionkey").cast("string"), F.lit(" = \""), F.col("n_name"), F.lit("\"")))).alias("value"))
    return files.settings(lines)


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    return microbatch.tumbling_counts(table(spark, sf_dir, "events"), "ts", ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("latest_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return microbatch.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), "user_id", "event_id")


@query("recovered_runs", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'ERROR' ELSE o_orderstatus END AS status FROM orders")
def recovered_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise(F.col("o_orderstatus")).alias("status"))
    return microbatch.recovered(o)


@query("repair_loop", "SELECT event_id, CASE WHEN value < 30 AND event_id % 2 = 0 THEN value + 100 ELSE value END AS value, value < 30 AND event_id % 2 = 1 AS invalid FROM events")
def repair_loop(spark, sf_dir):
    """Invalid results get one second answer; where that is invalid too, the first stays."""
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") < 30).alias("invalid"))
    second = e.where("invalid").select("event_id", (F.col("value") + 100).alias("value"), (F.col("event_id") % 2 == 1).alias("invalid"))
    return external.repaired(e, "invalid", second, "event_id")


@query("extracted_bags", "SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 2 = 0) AS even_type, arg_max(event_type, event_id) FILTER (event_id % 2 = 1) AS odd_type, coalesce(floor(avg(value) FILTER (event_id % 3 = 0) * 1000 + 0.5) / 1000, 0.5) AS confidence FROM events GROUP BY user_id")
def extracted_bags(spark, sf_dir):
    """Maps of what pages gave, folded in order so that later ones win; and the mean confidence, one half where there is none."""
    e = table(spark, sf_dir, "events").withColumn("bag", F.struct(F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("k"), F.col("event_type").alias("v")))
    last = lambda k: F.max_by("event_type", F.when(F.col("bag.k") == k, F.col("event_id")))
    return e.groupBy("user_id").agg(last("even").alias("even_type"), last("odd").alias("odd_type"), F.coalesce(round_half_up(F.avg(F.when(F.col("event_id") % 3 == 0, F.col("value"))), 3), F.lit(0.5)).alias("confidence"))


@query("ai_pages", "WITH r AS (SELECT o_custkey AS package, o_orderkey % 10 AS page, CASE o_orderkey % 3 WHEN 0 THEN 'CHART' WHEN 1 THEN 'TABLE' ELSE 'SUPPORT' END AS role, o_orderkey AS n FROM orders) SELECT package, page, arg_max(role, n) AS role FROM r GROUP BY ALL")
def ai_pages(spark, sf_dir):
    """Pages sent along with a role each; of several for one page the last wins."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), (k % 10).alias("page"), F.when(k % 3 == 0, "CHART").when(k % 3 == 1, "TABLE").otherwise("SUPPORT").alias("role"), k.alias("n"))
    return r.groupBy("package", "page").agg(F.max_by("role", "n").alias("role"))


@query("support_order", "WITH o AS (SELECT o_custkey AS package, o_orderpriority AS kind, min(o_orderkey) AS first_page FROM orders GROUP BY ALL) SELECT package, kind, first_page, CAST(row_number() OVER (PARTITION BY package ORDER BY list_position(['3-MEDIUM', '1-URGENT', '2-HIGH', '5-LOW', '4-NOT SPECIFIED'], kind), first_page) AS INT) AS place FROM o")
def support_order(spark, sf_dir):
    """Support of each package in a fixed order of kinds, then by first page."""
    from pyspark.sql import Window

    kinds = F.array(*[F.lit(k) for k in ("3-MEDIUM", "1-URGENT", "2-HIGH", "5-LOW", "4-NOT SPECIFIED")])
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("package"), F.col("o_orderpriority").alias("kind")).agg(F.min("o_orderkey").alias("first_page"))
    at = F.nullif(F.array_position(kinds, F.col("kind")), F.lit(0))
    return o.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy(F.asc_nulls_last(at), "first_page")))


@query("full_outer_plan", "WITH a AS (SELECT DISTINCT o_custkey % 40 AS code, 'A' || (o_custkey % 40) AS ai FROM orders WHERE o_orderstatus = 'F'), v AS (SELECT DISTINCT s_suppkey AS code, 'V' || s_suppkey AS vendor FROM supplier) SELECT coalesce(a.code, v.code) AS code, ai, vendor, CASE WHEN ai IS NULL THEN 'VENDOR' WHEN vendor IS NULL THEN 'AI' ELSE 'HYBRID' END AS mode FROM a FULL JOIN v ON a.code = v.code")
def full_outer_plan(spark, sf_dir):
    """Procedures of two sources matched by code; what only one has is kept."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 40).alias("code")).distinct().withColumn("ai", F.concat(F.lit("A"), F.col("code").cast("string")))
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code")).distinct().withColumn("vendor", F.concat(F.lit("V"), F.col("code").cast("string")))
    return a.join(v, "code", "full_outer").select("code", "ai", "vendor", F.when(F.col("ai").isNull(), "VENDOR").when(F.col("vendor").isNull(), "AI").otherwise("HYBRID").alias("mode"))


@query("patched_pages", "SELECT d.doc_id, coalesce(l.toxic::VARCHAR, d.lang) AS category, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.source) AS title FROM documents d LEFT JOIN labels l USING (doc_id)")
def patched_pages(spark, sf_dir):
    """A user's patch over the page, field by field."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.col("source").alias("title"))
    patch = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("category"), F.when(F.col("quality") == 1, "good").alias("title"))
    return merge.upsert(d, patch.join(d.select("doc_id"), "doc_id", "left_semi"), "doc_id")
