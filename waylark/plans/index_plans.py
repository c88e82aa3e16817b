"""Queries of index pages, labels and graphs made of legs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions import text as tx
from waylark.operators import graph, index, merge

from .common import pick, sql_pick, sql_round, table
from .leg_plans import COMPARED, LEFT, compared, left_legs

Q: dict = {}
S: dict = {}
TITLES = [
    "SEOUL/Incheon Intl(RKSI) ILS Z OR LOC Z RWY 15L INSTRUMENT APPROACH CHART - ICAO", "Instrument Approach Chart - ICAO - ILS - RWY 07R", "INSTRUMENT APPROACH CHART - ICAO RNP RWY 16", "VOR RWY 34 approach", "INSTRUMENT APPROACH CHART RWY 09",
    "STANDARD DEPARTURE CHART ADLOV 1E PIMOK 1J", "TIARA TWO A DEPARTURE", "RNAV (GNSS) SID - RWY 02C - VMR 6A", "RNAV(GNSS) BEKOL SID RWY 07R", "RNAV SID",
]
APPROACHES = ["ILS Z OR LOC Z RWY15L", "ILS RWY07R", "RNP RWY16", "VOR RWY34", "UNKNOWN RWY09", "UNKNOWN", "UNKNOWN", "RNAV RWY02C", "RNAV RWY07R", "RNAV"]
FOUND = ["", "", "", "", "", "ADLOV 1E|PIMOK 1J", "TIARA TWO A DEPARTURE", "VMR 6A", "BEKOL", ""]


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


@query("chart_titles", f"SELECT doc_id, {sql_pick(APPROACHES, 'doc_id')} AS approach, {sql_pick(FOUND, 'doc_id')} AS names FROM documents")
def chart_titles(spark, sf_dir):
    """Approach and procedure names of titles in their several word orders."""
    d = table(spark, sf_dir, "documents").select("doc_id", pick(TITLES, F.col("doc_id")).alias("t"))
    return d.select("doc_id", index.approach_name(F.col("t")).alias("approach"), F.array_join(index.procedure_names(F.col("t")), "|").alias("names"))


@query("index_items", """SELECT doc_id, 'Chart ' || source || ' part ' || lang AS name, 'AD 2-VHHH-SID-A' || doc_id AS number FROM documents
UNION ALL SELECT doc_id, 'Last ' || doc_id, 'AD 2-VHHH-IAC-' || doc_id || 'B' FROM documents WHERE doc_id % 2 = 0""")
def index_items(spark, sf_dir):
    """Items of index pages whose names stand on one line or several."""
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("AIP HONG KONG\nCHART NAME\nChart "), F.col("source"), F.lit("\n  part "), F.col("lang"), F.lit("\nAD 2-VHHH-SID-A"), n, F.lit("\nlost line\n12 JAN 2025\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Last "), n, F.lit(" AD 2-VHHH-IAC-"), n, F.lit("B\nrest"))).otherwise("no number"))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return index.index_items(d, "doc_id", "text").select("doc_id", "name", "number")


@query("ident_coordinates", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '013812.5N 1034015E' WHEN 1 THEN lpad(CAST(doc_id % 90 AS VARCHAR), 2, '0') || '0000N 1000000E' END AS coordinate FROM documents""")
def ident_coordinates(spark, sf_dir):
    """The coordinate after an identifier, or else before it."""
    n = F.col("doc_id")
    own = F.concat(F.lpad((n % 90).cast("string"), 2, "0"), F.lit("0000N 1000000E"))
    text = F.when(n % 3 == 0, F.concat(own, F.lit(" of ADLOV is at 013812.5N 1034015E"))).when(n % 3 == 1, F.concat(F.lit("010101N 0010101E then "), own, F.lit(" is ADLOV"))).otherwise(F.concat(own, F.lit(" alone")))
    return table(spark, sf_dir, "documents").select("doc_id", index.coordinate_for(text, F.lit("ADLOV")).alias("coordinate"))


@query("header_completion", """WITH p AS (SELECT doc_id, nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS key, lang FROM documents), k AS (SELECT CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_regionkey = 1)
SELECT doc_id, CASE WHEN p.key IS NULL THEN 'NO_KEY' WHEN lang NOT IN ('en', 'fr') THEN 'NO_TITLE' WHEN k.key IS NOT NULL THEN 'JOINED' ELSE 'NEW' END AS verdict FROM p LEFT JOIN k ON p.key = k.key""")
def header_completion(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", tx.extract(F.col("source"), r"(\d+)$").alias("key"), "lang")
    known = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("key"))
    return index.with_reason(p, known, "key", F.col("lang"), "^(en|fr)$").select("doc_id", "verdict")


@query("fix_metadata", f"WITH {LEFT}, t AS (SELECT fix, arg_min(altitude, branch * 100 + seq) FILTER (altitude IS NOT NULL) AS altitude, arg_min(path_terminator, branch * 100 + seq) FILTER (path_terminator <> 'TF') AS role FROM l GROUP BY fix) SELECT fix, altitude, CASE WHEN fix LIKE 'P1%' THEN 'TEXT' ELSE role END AS role FROM t")
def fix_metadata(spark, sf_dir):
    """Of each fix the first altitude and role that are there; what the text of the chart says of a role goes first."""
    l = left_legs(spark, sf_dir)
    at = F.struct("branch", "seq")
    t = l.groupBy("fix").agg(F.min_by("altitude", F.when(F.col("altitude").isNotNull(), at)).alias("altitude"), F.min_by("path_terminator", F.when(F.col("path_terminator") != "TF", at)).alias("role"))
    return t.select("fix", "altitude", F.coalesce(F.when(F.col("fix").startswith("P1"), "TEXT"), F.col("role")).alias("role"))


@query("label_anchors", """WITH f AS (SELECT s_suppkey AS n, s_nationkey AS ident, CASE WHEN s_suppkey % 3 = 0 THEN 'fix' ELSE 'leg' END AS kind FROM supplier), l AS (SELECT c_custkey AS label, c_nationkey AS ident, CASE WHEN c_custkey % 2 = 0 THEN 'fix' ELSE 'leg' END AS kind FROM customer)
SELECT label, min(CASE WHEN f.kind = l.kind THEN n END) AS exact, coalesce(min(CASE WHEN f.kind = l.kind THEN n END), min(n)) AS anchor FROM l LEFT JOIN f USING (ident) GROUP BY label""")
def label_anchors(spark, sf_dir):
    """Labels with the first feature of their identifier and type, else the first of their identifier. Features are first reduced to one for each, so that labels meet few."""
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_nationkey").alias("ident"), F.when(F.col("s_suppkey") % 3 == 0, "fix").otherwise("leg").alias("kind"))
    first = f.groupBy("ident").agg(F.min("n").alias("any"), F.min(F.when(F.col("kind") == "fix", F.col("n"))).alias("fix"), F.min(F.when(F.col("kind") == "leg", F.col("n"))).alias("leg"))
    l = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label"), F.col("c_nationkey").alias("ident"), (F.col("c_custkey") % 2 == 0).alias("is_fix"))
    j = l.join(first, "ident", "left").withColumn("exact", F.when(F.col("is_fix"), F.col("fix")).otherwise(F.col("leg")))
    return j.select("label", "exact", F.coalesce("exact", "any").alias("anchor"))


@query("graph_branches", f"WITH {LEFT}, g AS (SELECT branch % 50 AS graph, CASE WHEN path_terminator IN ('IF', 'CA') THEN 'RUNWAY' WHEN path_terminator = 'AF' THEN 'ENROUTE' ELSE 'COMMON' END AS own, branch, seq, fix FROM l), d AS (SELECT *, CASE WHEN graph = 7 THEN 'COMMON' ELSE own END AS role FROM g) SELECT graph, role, arg_min(fix, branch * 100 + seq) AS entry_fix, arg_max(fix, branch * 100 + seq) AS exit_fix, count(*) AS legs FROM d GROUP BY ALL")
def graph_branches(spark, sf_dir):
    """Branches of graphs by role; a declared role goes before the one that legs suggest."""
    l = left_legs(spark, sf_dir).withColumn("graph", F.col("branch") % 50).withColumn("at", F.col("branch") * 100 + F.col("seq"))
    own = F.when(F.col("path_terminator").isin("IF", "CA"), "RUNWAY").when(F.col("path_terminator") == "AF", "ENROUTE").otherwise("COMMON")
    declared = spark.createDataFrame([(7, "COMMON")], "graph long, declared string")
    rows = l.join(declared, "graph", "left").withColumn("role", F.coalesce("declared", own))
    return graph.branches(rows, ["graph", "role"], "at").select("graph", "role", "entry_fix", "exit_fix", "legs")


@query("sequence_scores", f"WITH {COMPARED} SELECT branch % 100 AS graph, {sql_round('count(*) FILTER (in_l AND in_r) * 100.0::DOUBLE / count(*)', 1)} AS sequence_score, {sql_round('(count(*) FILTER (in_l AND in_r AND m_fix) + count(*) FILTER (in_l AND in_r AND m_d)) * 100.0::DOUBLE / nullif(2 * count(*) FILTER (in_l AND in_r), 0)', 1)} AS field_score FROM t GROUP BY 1")
def sequence_scores(spark, sf_dir):
    """How many legs of a graph are aligned, and how many of their comparable fields match, in percent."""
    from waylark.functions.tolerance import round_half_up

    legs, m = compared(spark, sf_dir)
    both = F.col("in_left") & F.col("in_right")
    hits = F.count_if(both & m["fix"]) + F.count_if(both & m["distance_nm"])
    return legs.groupBy((F.col("branch") % 100).alias("graph")).agg(round_half_up(F.count_if(both) * 100.0 / F.count(F.lit(1)), 1).alias("sequence_score"), round_half_up(hits * 100.0 / F.nullif(2 * F.count_if(both), F.lit(0)), 1).alias("field_score"))


@query("flat_and_nested", f"WITH {LEFT} SELECT branch, seq, fix, distance_nm FROM l WHERE seq <= 3")
def flat_and_nested(spark, sf_dir):
    """Legs nested by branch, the first three kept, and flat again."""
    n = merge.grouped_in_order(left_legs(spark, sf_dir).withColumn("leg", F.struct("fix", "distance_nm")), ["branch"], "seq", "leg", 3)
    return n.select("branch", F.posexplode("values").alias("i", "leg")).select("branch", (F.col("i") + 1).alias("seq"), "leg.fix", "leg.distance_nm")


@query("recognition_summary", f"WITH {COMPARED} SELECT branch % 10 AS grp, count(DISTINCT branch) AS procedures, count(*) AS legs, count(*) FILTER (status <> 'MATCH') AS warnings, bool_or(status = 'MISSING_RIGHT') AS review FROM t GROUP BY 1")
def recognition_summary(spark, sf_dir):
    legs, _ = compared(spark, sf_dir)
    return legs.groupBy((F.col("branch") % 10).alias("grp")).agg(F.count_distinct("branch").alias("procedures"), F.count(F.lit(1)).alias("legs"), F.count_if(F.col("status") != "MATCH").alias("warnings"), F.bool_or(F.col("status") == "MISSING_RIGHT").alias("review"))


@query("numeric_index", """SELECT doc_id, CAST(i - 1 AS INT) AS ordinal, CASE WHEN i = 1 THEN 'STANDARD DEPARTURE CHART - ICAO ' || upper(lang) ELSE 'INSTRUMENT APPROACH CHART ' || upper(source) END AS name, 'AD 2-WMKJ-6-' || (doc_id % 40 + i) AS number, CASE WHEN i = 1 THEN 2 END AS tabular_no FROM documents, range(1, 3) t(i)""")
def numeric_index(spark, sf_dir):
    n = F.col("doc_id") % 40
    text = F.concat(F.lit("Standard Departure\nChart - ICAO "), "lang", F.lit(" (TABULAR 2)AD 2-WMKJ-6-"), (n + 1).cast("string"), F.lit("\nInstrument Approach Chart "), F.col("source"), F.lit(" A D 2 - W M K J - 6 - "), (n + 2).cast("string"), F.lit("\nend"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(index.numeric_items(text)).alias("ordinal", "x"))
    return d.select("doc_id", "ordinal", "x.name", "x.number", "x.tabular_no")


@query("index_continuations", """SELECT doc_id, doc_id % 7 >= 4 AND doc_id % 3 <> 2 OR doc_id % 11 >= 8 AS continues, CASE doc_id % 3 WHEN 0 THEN 'AD 2.24' END AS section FROM documents""")
def index_continuations(spark, sf_dir):
    n = F.col("doc_id")
    titles = F.repeat(F.lit("STANDARD ARRIVAL CHART\n"), (n % 7).cast("int"))
    kind = F.when(n % 3 == 0, "AD 2.24\n").when(n % 3 == 1, F.repeat(F.lit("x ...... y\n"), F.lit(4))).otherwise("plain\n")
    numbers = F.repeat(F.lit("see AD 2-VHHH-SID-B\n"), (n % 11).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(kind, titles, numbers).alias("t"))
    return d.select("doc_id", index.continues_index(F.col("t")).alias("continues"), F.when(n % 3 == 0, index.section(F.col("t"))).alias("section"))


@query("arc_fallback")
def arc_fallback(spark, sf_dir):
    """Legs along an arc for procedures without any: a nation's suppliers are its radials."""
    from waylark.operators import geometry

    s = table(spark, sf_dir, "supplier")
    radials = s.select(F.col("s_nationkey").alias("chart"), (F.col("s_suppkey") * 37 % 360).cast("double").alias("deg"), F.when(F.col("s_suppkey") % 4 == 0, 340.0).alias("inbound_deg"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("s_suppkey") % 3), lambda i: F.concat(F.lit("ADLOV 1"), F.char(65 + i))).alias("procedures"))
    charts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chart"), F.lit(11.0).alias("radius_nm"), F.lit(13.0).alias("outer_nm"), F.lit("JB").alias("common_fix"))
    return geometry.arc_legs(charts, radials)
