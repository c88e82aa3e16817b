"""Queries of branch graphs, page grouping, joins that need care, sets and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waylark.functions import text as tx
from waylark.operators import compare, graph, grouping, merge

from .common import AIP_PAGES, aip_pages, pick, quoted, sql_pick, sql_round, table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- graphs


def nation_branches(spark, sf_dir):
    """Branches of a region's graph: its nations, from the fix of one key to that of another."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_regionkey").alias("graph"), F.col("n_name").alias("branch"), F.concat(F.lit("F"), (k % 4).cast("string")).alias("entry_fix"), F.concat(F.lit("F"), (k % 3).cast("string")).alias("exit_fix"), F.when(k % 3 == 0, "RUNWAY").when(k % 3 == 1, "ENROUTE").otherwise("COMMON").alias("role"), k.cast("long").alias("k"))


NATION = "nb AS (SELECT n_regionkey AS graph, n_name AS branch, 'F' || (n_nationkey % 4) AS entry_fix, 'F' || (n_nationkey % 3) AS exit_fix, CASE n_nationkey % 3 WHEN 0 THEN 'RUNWAY' WHEN 1 THEN 'ENROUTE' ELSE 'COMMON' END AS role, CAST(n_nationkey AS BIGINT) AS k FROM nation)"


@query("merge_points", f"""WITH {NATION}, e AS (SELECT graph, exit_fix AS fix, branch, 'in' AS way FROM nb UNION ALL SELECT graph, entry_fix, branch, 'out' FROM nb),
g AS (SELECT graph, fix, list_sort(list(DISTINCT branch) FILTER (way = 'in')) AS i, list_sort(list(DISTINCT branch) FILTER (way = 'out')) AS o FROM e GROUP BY ALL)
SELECT graph, fix, array_to_string(i, ',') AS inbound, coalesce(array_to_string(o, ','), '') AS outbound FROM g WHERE len(i) >= 2 OR (len(i) >= 1 AND len(o) >= 1)""")
def merge_points(spark, sf_dir):
    m = graph.merge_points(nation_branches(spark, sf_dir), ["graph"], "branch")
    return m.select("graph", "fix", F.array_join("inbound", ",").alias("inbound"), F.array_join("outbound", ",").alias("outbound"))


@query("route_enumeration", f"""WITH {NATION}, g AS (SELECT DISTINCT graph FROM nb), r AS (SELECT g.graph, nb.branch AS runway_id FROM g LEFT JOIN nb ON nb.graph = g.graph AND role = 'RUNWAY'), t AS (SELECT g.graph, nb.branch AS transition_id FROM g LEFT JOIN nb ON nb.graph = g.graph AND role = 'ENROUTE') SELECT graph, runway_id, transition_id FROM r JOIN t USING (graph)""")
def route_enumeration(spark, sf_dir):
    return graph.routes(nation_branches(spark, sf_dir), "graph", "branch")


@query("route_legs")
def route_legs(spark, sf_dir):
    """The legs of each route, with those left out that repeat a fix already reached."""
    b = nation_branches(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    legs = b.join(c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("seq")), "k").select("graph", "branch", "role", "seq", F.concat(F.lit("F"), (F.col("seq") % 5).cast("string")).alias("fix"), F.when(F.col("seq") % 2 == 0, "IF").otherwise("TF").alias("path_terminator"))
    parts = graph.route_legs(graph.routes(b, "graph", "branch"), legs, "graph", "branch", "seq")
    kept = graph.flown(parts, ["graph", "runway_id", "transition_id"], ["part", "seq", "fix", "path_terminator"])
    return kept.select("graph", "runway_id", "transition_id", (F.col("place") * 10).alias("display_sequence"), "fix", "path_terminator")


_TOPO = """a AS (SELECT DISTINCT s_nationkey % 5 AS graph, 'B' || (s_suppkey % 17) AS name FROM supplier), b AS (SELECT DISTINCT c_nationkey % 5 AS graph, 'B' || (c_custkey % 12 * 2) AS name FROM customer WHERE c_mktsegment = 'BUILDING')"""
_TOPOLOGY = f"""t AS (SELECT coalesce(a.graph, b.graph) AS graph, count(*) FILTER (a.name IS NOT NULL AND b.name IS NOT NULL) AS matched, count(*) FILTER (a.name IS NULL) AS missing, count(*) FILTER (b.name IS NULL) AS extra,
  coalesce(string_agg(b.name, ',' ORDER BY b.name) FILTER (a.name IS NULL), '') AS missing_names, coalesce(string_agg(a.name, ',' ORDER BY a.name) FILTER (b.name IS NULL), '') AS extra_names FROM a FULL JOIN b ON a.graph = b.graph AND a.name = b.name GROUP BY 1)"""


def topology_sides(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("graph"), F.concat(F.lit("B"), (F.col("s_suppkey") % 17).cast("string")).alias("name")).distinct()
    b = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_nationkey") % 5).alias("graph"), F.concat(F.lit("B"), (F.col("c_custkey") % 12 * 2).cast("string")).alias("name")).distinct()
    return a, b


@query("topology_diff", f"WITH {_TOPO}, {_TOPOLOGY} SELECT *, {sql_round('matched * 100.0::DOUBLE / (matched + missing + extra)', 1)} AS score FROM t")
def topology_diff(spark, sf_dir):
    return graph.topology(*topology_sides(spark, sf_dir), "graph", "name").withColumn("missing_names", F.array_join("missing_names", ",")).withColumn("extra_names", F.array_join("extra_names", ","))


@query("coverage", f"WITH {_TOPO}, x AS (SELECT graph, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.graph = b.graph AND a.name = b.name)) AS compared FROM b GROUP BY graph) SELECT graph, total, compared, {sql_round('compared * 100.0::DOUBLE / total', 1)} AS coverage_percent FROM x")
def coverage(spark, sf_dir):
    a, b = topology_sides(spark, sf_dir)
    return graph.coverage(b.join(a, ["graph", "name"], "left_semi"), b, "graph")


@query("weighted_overall", f"""WITH {_TOPO}, {_TOPOLOGY}, p AS (SELECT graph, CASE WHEN graph % 2 = 0 THEN {sql_round('matched * 100.0::DOUBLE / (matched + missing + extra)', 1)} END AS topology, CASE WHEN graph <> 3 THEN 80.0::DOUBLE + graph END AS sequence, CASE WHEN graph <> 1 THEN 60.5::DOUBLE + graph END AS fields, missing FROM t)
SELECT graph, CASE WHEN missing > 0 THEN least(o, 80.0) ELSE o END AS overall FROM (SELECT graph, missing, {sql_round("(coalesce(topology * 0.3::DOUBLE, 0) + coalesce(sequence * 0.3::DOUBLE, 0) + coalesce(fields * 0.4::DOUBLE, 0)) / (CASE WHEN topology IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN sequence IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN fields IS NULL THEN 0 ELSE 0.4::DOUBLE END)", 1)} AS o FROM p)""")
def weighted_overall(spark, sf_dir):
    t = graph.topology(*topology_sides(spark, sf_dir), "graph", "name")
    g = F.col("graph")
    score = compare.renormalised({"topology": F.when(g % 2 == 0, F.col("score")), "sequence": F.when(g != 3, 80.0 + g), "fields": F.when(g != 1, 60.5 + g)})
    return t.select("graph", F.when(F.col("missing") > 0, F.least(score, F.lit(80.0))).otherwise(score).alias("overall"))


@query("identity_gate", """
WITH g AS (SELECT s_suppkey AS id, 'NAME' || (s_suppkey % 9) AS lname, 'NAME' || (s_suppkey % 8) AS rname, CASE WHEN s_suppkey % 2 = 0 THEN 'SID' ELSE 'STAR' END AS lt, CASE WHEN s_suppkey % 4 < 3 THEN 'SID' ELSE 'STAR' END AS rt, s_nationkey AS la, s_nationkey - s_nationkey % 2 AS ra, [s_suppkey % 3, s_suppkey % 5] AS lr, [s_suppkey % 4, 7] AS rr FROM supplier)
SELECT id, CASE WHEN lname <> rname THEN 'SOURCE_MISMATCH' WHEN lt <> rt OR la <> ra OR NOT list_has_any(lr, rr) THEN 'NOT_COMPARABLE' ELSE 'COMPARABLE' END AS status, CASE WHEN lname <> rname THEN 'name' WHEN lt <> rt THEN 'type' WHEN la <> ra THEN 'airport' WHEN NOT list_has_any(lr, rr) THEN 'runway' ELSE '' END AS reason FROM g""")
def identity_gate(spark, sf_dir):
    """Gates in order: name, type, airport, runways in common."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    gates = [("name", "SOURCE_MISMATCH", k % 9 != k % 8), ("type", "NOT_COMPARABLE", (k % 2 == 0) != (k % 4 < 3)), ("airport", "NOT_COMPARABLE", n % 2 != 0), ("runway", "NOT_COMPARABLE", ~F.arrays_overlap(F.array(k % 3, k % 5), F.array(k % 4, F.lit(7).cast("long"))))]
    status, reason = F.lit("COMPARABLE"), F.lit("")
    for why, what, closed in reversed(gates):
        status, reason = F.when(closed, what).otherwise(status), F.when(closed, why).otherwise(reason)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), status.alias("status"), reason.alias("reason"))


# ---------------------------------------------------------------- page grouping

ITEM_NOS = ["AD 2-WMKJ-6-1", "AD 2-WMKJ-8", "AD 2-RKSI", "AD 2-NONE-1-1"]
PAGE_NOS = ["AD 2-WMKJ-6-1", "AD 2-WMKJ-6-12", "AD 2-WMKJ-8-3", "AD 2-RKSI-28", "AD 2-VHHH-SID-BEKOL-A", ""]


def numbered_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("page_no"), F.nullif(pick(PAGE_NOS, F.col("doc_id")), F.lit("")).alias("chart_no"))


def index_items(spark):
    return spark.createDataFrame([(i, n) for i, n in enumerate(ITEM_NOS)], "item long, item_no string")


_ITEMS = "items AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {quoted(n)})" for i, n in enumerate(ITEM_NOS)) + ") t(item, item_no))"
_NPAGES = f"np AS (SELECT doc_id AS page_no, nullif({sql_pick(PAGE_NOS, 'doc_id')}, '') AS chart_no FROM documents)"


@query("prefix_join", f"WITH {_ITEMS}, {_NPAGES} SELECT item, page_no, chart_no FROM items JOIN np ON chart_no = item_no OR (starts_with(chart_no, item_no) AND regexp_matches(substr(chart_no, length(item_no) + 1), '^[-.][0-9]{{1,2}}$'))")
def prefix_join(spark, sf_dir):
    return grouping.prefix_join(index_items(spark), "item_no", numbered_pages(spark, sf_dir), "chart_no").select("item", "page_no", "chart_no")


@query("unmatched_items", f"WITH {_ITEMS}, {_NPAGES} SELECT item, item_no FROM items WHERE NOT EXISTS (SELECT 1 FROM np WHERE chart_no = item_no)")
def unmatched_items(spark, sf_dir):
    return index_items(spark).join(numbered_pages(spark, sf_dir).select(F.col("chart_no").alias("item_no")), "item_no", "left_anti").select("item", "item_no")


@query("duplicate_numbers", f"WITH {_NPAGES} SELECT chart_no, count(*) AS pages, min(page_no) AS first_page FROM np WHERE chart_no IS NOT NULL GROUP BY chart_no HAVING count(*) > 1")
def duplicate_numbers(spark, sf_dir):
    return numbered_pages(spark, sf_dir).where("chart_no is not null").groupBy("chart_no").agg(F.count(F.lit(1)).alias("pages"), F.min("page_no").alias("first_page")).where("pages > 1")


@query("contains_top1", f"""WITH p AS ({AIP_PAGES}), n AS (SELECT page_no, upper(regexp_replace(text, '\\s+', '', 'g')) AS flat FROM p), needles AS (SELECT p_partkey AS item, upper(replace(p_brand, '#', '')) AS needle FROM part WHERE p_partkey < 0 UNION ALL SELECT * FROM (VALUES (1::BIGINT, 'ADLOV1E'), (2::BIGINT, 'ADLOV'), (3::BIGINT, 'SID'), (4::BIGINT, 'BEKOLSID'), (5::BIGINT, 'RWY16')) t(item, needle)),
j AS (SELECT page_no, item, needle, row_number() OVER (PARTITION BY page_no ORDER BY length(needle) DESC, item) AS rn FROM n JOIN needles ON contains(flat, needle)) SELECT page_no, item, needle FROM j WHERE rn = 1""")
def contains_top1(spark, sf_dir):
    needles = [(1, "ADLOV1E"), (2, "ADLOV"), (3, "SID"), (4, "BEKOLSID"), (5, "RWY16")]
    flat = aip_pages(spark, sf_dir).select("page_no", F.upper(F.regexp_replace("text", r"\s+", "")).alias("flat"))
    return grouping.longest_contained(flat, "page_no", "flat", needles).select("page_no", "item", "needle")


@query("band_completion", f"""WITH p AS ({AIP_PAGES}), s AS (SELECT page_no, regexp_matches(text, 'STANDARD (DEPARTURE|ARRIVAL) CHART|INSTRUMENT APPROACH') AS seed, regexp_matches(text, 'TABULAR DESCRIPTION|WAYPOINT COORDINATES|RUNWAY PHYSICAL') AS table_page FROM p),
j AS (SELECT t.page_no, c.page_no AS seed_page, row_number() OVER (PARTITION BY t.page_no ORDER BY c.page_no) AS rn FROM s t JOIN s c ON c.seed AND t.table_page AND t.page_no BETWEEN c.page_no + 1 AND c.page_no + 3) SELECT page_no, seed_page FROM j WHERE rn = 1""")
def band_completion(spark, sf_dir):
    p = aip_pages(spark, sf_dir)
    seeds = p.where(F.col("text").rlike("STANDARD (DEPARTURE|ARRIVAL) CHART|INSTRUMENT APPROACH")).select(F.col("page_no").alias("seed_page"))
    tables = p.where(F.col("text").rlike("TABULAR DESCRIPTION|WAYPOINT COORDINATES|RUNWAY PHYSICAL")).select("page_no")
    return grouping.within_band(seeds, "seed_page", tables, "page_no", 3)


@query("homogeneous_gate", "SELECT o_custkey, min(o_orderstatus) AS status, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def homogeneous_gate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("status"), F.count(F.lit(1)).alias("orders"), F.max("o_orderstatus").alias("_most")).where("status = _most").drop("_most")


@query("file_of_page", f"WITH p AS ({AIP_PAGES}), f AS (SELECT file_no, min(page_no) AS start, count(*) AS pages FROM p GROUP BY file_no) SELECT p.page_no, f.file_no, p.page_no - f.start + 1 AS local_page FROM p JOIN f ON p.page_no >= f.start AND p.page_no < f.start + f.pages")
def file_of_page(spark, sf_dir):
    p = aip_pages(spark, sf_dir)
    f = p.groupBy("file_no").agg(F.min("page_no").alias("start"), F.count(F.lit(1)).alias("pages"))
    return grouping.pages_in_ranges(p.select("page_no"), "page_no", f, "start", "pages").select("page_no", "file_no", (F.col("page_no") - F.col("start") + 1).alias("local_page"))


@query("merged_files", """SELECT n_nationkey AS id, sum(n_regionkey + 1) OVER (PARTITION BY n_regionkey ORDER BY lpad(CAST(n_nationkey * 7 % 25 AS VARCHAR), 12, '0'), n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before_pages FROM nation""")
def merged_files(spark, sf_dir):
    """Files of each task in natural order of their names, and how many pages come before each."""
    n = table(spark, sf_dir, "nation").withColumn("name", F.concat(F.lit("file "), (F.col("n_nationkey") * 7 % 25).cast("string")))
    w = Window.partitionBy("n_regionkey").orderBy(tx.natural_key(F.col("name")), "n_nationkey").rowsBetween(Window.unboundedPreceding, -1)
    return n.select(F.col("n_nationkey").alias("id"), F.sum(F.col("n_regionkey") + 1).over(w).cast("long").alias("before_pages"))


@query("package_grouping", f"""WITH p AS ({AIP_PAGES}), r AS (SELECT page_no, file_no, CASE WHEN regexp_matches(text, 'STANDARD DEPARTURE') THEN 'SID' WHEN regexp_matches(text, 'STANDARD ARRIVAL') THEN 'STAR' WHEN regexp_matches(text, 'INSTRUMENT APPROACH') THEN 'APPROACH' END AS package, regexp_matches(text, 'RWY') AS rw FROM p)
SELECT file_no, package, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS pages, min(page_no) AS default_chart, bool_or(NOT rw) AS review, count(*) AS n, 'pkg_' || file_no || '_' || row_number() OVER (PARTITION BY file_no ORDER BY package) AS package_id FROM r WHERE package IS NOT NULL GROUP BY file_no, package""")
def package_grouping(spark, sf_dir):
    p = aip_pages(spark, sf_dir)
    t = F.col("text")
    kind = F.when(t.contains("STANDARD DEPARTURE"), "SID").when(t.contains("STANDARD ARRIVAL"), "STAR").when(t.contains("INSTRUMENT APPROACH"), "APPROACH")
    rows = p.select("page_no", "file_no", kind.alias("package"), t.contains("RWY").alias("rw")).where("package is not null")
    packages = grouping.finalized(rows, ["file_no", "package"], "page_no", ~F.col("rw"))
    w = Window.partitionBy("file_no").orderBy("package")
    return packages.select("file_no", "package", F.array_join("pages", ",").alias("pages"), "default_chart", "review", "n", F.concat_ws("_", F.lit("pkg"), F.col("file_no").cast("string"), F.row_number().over(w).cast("string")).alias("package_id"))


@query("support_refs", f"""WITH p AS ({AIP_PAGES}), r AS (SELECT page_no, file_no, CASE WHEN regexp_matches(text, 'AD 2.24') THEN 'CHART_INDEX' WHEN regexp_matches(text, 'AD 2.12') THEN 'RUNWAY_DATA' WHEN regexp_matches(text, 'AD 2.19') THEN 'NAVAID' END AS support FROM p),
w AS (SELECT * FROM (VALUES ('SID', 'CHART_INDEX'), ('SID', 'RUNWAY_DATA'), ('APPROACH', 'CHART_INDEX'), ('APPROACH', 'RUNWAY_DATA'), ('APPROACH', 'NAVAID')) t(package, support))
SELECT w.package, r.file_no, r.support, string_agg(CAST(r.page_no AS VARCHAR), ',' ORDER BY r.page_no) AS pages FROM w JOIN r USING (support) GROUP BY ALL""")
def support_refs(spark, sf_dir):
    t = F.col("text")
    r = aip_pages(spark, sf_dir).select("page_no", "file_no", F.when(t.contains("AD 2.24"), "CHART_INDEX").when(t.contains("AD 2.12"), "RUNWAY_DATA").when(t.contains("AD 2.19"), "NAVAID").alias("support"))
    w = spark.createDataFrame([("SID", "CHART_INDEX"), ("SID", "RUNWAY_DATA"), ("APPROACH", "CHART_INDEX"), ("APPROACH", "RUNWAY_DATA"), ("APPROACH", "NAVAID")], "package string, support string")
    return w.join(r, "support").groupBy("package", "file_no", "support").agg(F.array_join(F.array_sort(F.collect_set("page_no")), ",").alias("pages"))


# ---------------------------------------------------------------- sets, merges, windows


@query("gaps_islands", """WITH d AS (SELECT DISTINCT l_suppkey, l_partkey // 10 AS page FROM lineitem), i AS (SELECT l_suppkey, page, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS g FROM d), r AS (SELECT l_suppkey, min(page) AS a, max(page) AS b FROM i GROUP BY l_suppkey, g)
SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY l_suppkey""")
def gaps_islands(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor(F.col("l_partkey") / 10).alias("page"))
    return merge.page_ranges(l, ["l_suppkey"], "page")


@query("merge_upsert", """WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'N' END AS status, NULL::VARCHAR AS priority, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice + 1 END AS price FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(b.id, n.id) AS id, coalesce(nullif(n.status, ''), b.status) AS status, coalesce(n.priority, b.priority) AS priority, coalesce(n.price, b.price) AS price FROM b FULL JOIN n ON b.id = n.id""")
def merge_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.where(k % 3 != 0).select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    new = o.where(k % 2 == 0).select(k.alias("id"), F.when(k % 4 == 0, "").otherwise("N").alias("status"), F.lit(None).cast("string").alias("priority"), F.when(k % 5 > 0, F.col("o_totalprice") + 1).alias("price"))
    return merge.upsert(base, new, "id")


@query("replace_by_key", "WITH n AS (SELECT o_orderkey AS id, 'new' AS v FROM orders WHERE o_orderkey % 4 = 0) SELECT * FROM n UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT id FROM n)")
def replace_by_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return merge.replace_by_key(o.where(k % 2 == 0).select(k.alias("id"), F.col("o_orderstatus").alias("v")), o.where(k % 4 == 0).select(k.alias("id"), F.lit("new").alias("v")), "id")


@query("merge_distinct", "SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_orderstatus, upper(o_orderpriority) FROM orders WHERE o_orderkey % 2 = 1")
def merge_distinct(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderkey % 2 = 0").select("o_orderstatus", "o_orderpriority").union(o.where("o_orderkey % 2 = 1").select("o_orderstatus", F.upper("o_orderpriority"))).distinct()


@query("set_except", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9980)")
def set_except(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return s.subtract(table(spark, sf_dir, "customer").where("c_acctbal > 9980").select("c_nationkey"))


@query("support_leak", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def support_leak(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o.where("o_orderstatus = 'F'"), c.c_custkey == o.o_custkey, "left_semi").join(o.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("covered_variants", """WITH v AS (SELECT s_suppkey AS id, s_nationkey AS family, CASE WHEN s_suppkey % 3 = 0 THEN '16/34' WHEN s_suppkey % 3 = 1 THEN '16' ELSE '07' END AS rw FROM supplier)
SELECT id, family, rw FROM v WHERE contains(rw, '/') OR NOT EXISTS (SELECT 1 FROM v w WHERE w.family = v.family AND contains(w.rw, '/') AND list_contains(string_split(w.rw, '/'), v.rw))""")
def covered_variants(spark, sf_dir):
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("family"), F.when(k % 3 == 0, "16/34").when(k % 3 == 1, "16").otherwise("07").alias("rw"))
    covered = v.where(F.col("rw").contains("/")).select("family", F.explode(F.split("rw", "/")).alias("rw")).distinct()
    return v.where(F.col("rw").contains("/")).union(v.where(~F.col("rw").contains("/")).join(covered, ["family", "rw"], "left_anti").select("id", "family", "rw"))


@query("remove_placeholders", "WITH x AS (SELECT o_custkey AS g, o_orderkey AS id, o_orderstatus = 'F' AS has, o_orderkey % 10 / 10.0 AS conf FROM orders), s AS (SELECT g, bool_or(has) AS filled FROM x GROUP BY g) SELECT x.g, x.id FROM x JOIN s USING (g) WHERE NOT (filled AND NOT has AND conf <= 0.5)")
def remove_placeholders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("has"), (F.col("o_orderkey") % 10 / 10.0).alias("conf"))
    return merge.without_placeholders(o, "g", F.col("has"), "conf").select("g", "id")


@query("microbatches", "SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS INT) AS batch FROM conversations")
def microbatches(spark, sf_dir):
    return merge.batches(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 2).select("conv_id", "turn", "batch")


@query("microbatch_merge", """WITH t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch, role, turn, text FROM conversations), b AS (SELECT conv_id, batch, arg_max(text, turn) FILTER (role = 'user') AS u, arg_max(text, turn) FILTER (role = 'assistant') AS a FROM t GROUP BY ALL)
SELECT conv_id, length(arg_max(u, batch) FILTER (u IS NOT NULL)) AS user_chars, length(arg_max(a, batch) FILTER (a IS NOT NULL)) AS assistant_chars, count(*) AS batches FROM b GROUP BY conv_id""")
def microbatch_merge(spark, sf_dir):
    t = merge.batches(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 2)
    last = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("turn")))
    b = t.groupBy("conv_id", "batch").agg(last("user").alias("u"), last("assistant").alias("a"))
    keep = lambda c: F.length(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch")))).cast("long")
    return b.groupBy("conv_id").agg(keep("u").alias("user_chars"), keep("a").alias("assistant_chars"), F.count(F.lit(1)).alias("batches"))


@query("grouped_in_order", "SELECT user_id, event_type, min(event_id) AS first_ordinal, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 3), ',') AS first_three, count(*) AS n FROM events GROUP BY ALL")
def grouped_in_order(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = merge.grouped_in_order(e.withColumn("v", F.col("event_id").cast("string")), ["user_id", "event_type"], "event_id", "v")
    return g.select("user_id", "event_type", "first_ordinal", F.array_join(F.slice("values", 1, 3), ",").alias("first_three"), F.size("values").cast("long").alias("n"))


@query("type_counts_other", "SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS event_type, count(*) AS n FROM events GROUP BY 1")
def type_counts_other(spark, sf_dir):
    return merge.counts_with_other(table(spark, sf_dir, "events"), "event_type", ["click", "view"])


@query("max_confidence", "WITH e AS (SELECT user_id, event_type AS kind, max(value) AS confidence FROM events GROUP BY user_id, event_type), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, kind) AS place FROM e) SELECT user_id, kind AS value, confidence FROM c WHERE place = 1")
def max_confidence(spark, sf_dir):
    c = table(spark, sf_dir, "events").withColumnRenamed("value", "v").groupBy("user_id", F.col("event_type").alias("value")).agg(F.max("v").alias("confidence"))
    return merge.top_one(c, ["user_id"], [F.desc("confidence"), F.col("value")])


@query("ratio_metrics", f"""WITH p AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars % 2 AS guess, d.lang FROM labels l JOIN documents d USING (doc_id))
SELECT lang, CASE WHEN count(*) FILTER (quality IS NOT NULL) = 0 THEN 1.0 ELSE {sql_round('count(*) FILTER (guess = quality) / count(*) FILTER (quality IS NOT NULL)', 3)} END AS quality_accuracy, CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN 1.0 ELSE {sql_round('count(*) FILTER (guess = toxic AND toxic = 1) / count(*) FILTER (toxic = 1)', 3)} END AS toxic_recall FROM p GROUP BY lang""")
def ratio_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 2).alias("guess")), "doc_id")
    return p.groupBy("lang").agg(compare.ratio_metric(F.col("guess") == F.col("quality"), F.col("quality").isNotNull()).alias("quality_accuracy"), compare.ratio_metric(F.col("guess") == F.col("toxic"), F.col("toxic") == 1).alias("toxic_recall"))
