"""Queries that compare, grade, chain and encode legs. Line items stand for legs: an order is a branch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waylark.functions import text as tx
from waylark.functions import tolerance as tol
from waylark.operators import align, compare, graph, merge
from waylark.sources import arinc424

from .common import sql_round, table

Q: dict = {}
S: dict = {}
PTS = ["IF", "TF", "CF", "DF", "AF", "CA"]


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


def left_legs(spark, sf_dir):
    """(branch, seq, fix, path_terminator, distance_nm, course_deg, altitude): line items in a fixed order; the keys of line items are not unique, so they are numbered."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("branch"), F.row_number().over(w).alias("seq"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").select(
        "branch", "seq", F.concat(F.lit("P"), (F.col("l_partkey") % 1000).cast("string")).alias("fix"), F.element_at(F.array(*[F.lit(p) for p in PTS]), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("path_terminator"),
        F.col("l_quantity").alias("distance_nm"), (F.col("l_partkey") % 360).cast("double").alias("course_deg"), F.when(F.col("l_suppkey") % 5 > 0, (F.col("l_suppkey") * 100).cast("long")).alias("altitude"))


LEFT = f"""l AS (SELECT branch, CAST(seq AS INT) AS seq, 'P' || (l_partkey % 1000) AS fix, (ARRAY{PTS!r})[CAST(l_suppkey % 6 + 1 AS INT)] AS path_terminator, l_quantity AS distance_nm, (l_partkey % 360)::DOUBLE AS course_deg,
  CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey * 100 END AS altitude
  FROM (SELECT *, l_orderkey AS branch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem))"""


def right_legs(spark, sf_dir):
    """The same legs as another source has them: some are missing, some distances, courses and fixes are off."""
    l = left_legs(spark, sf_dir)
    k = F.col("branch") * 7 + F.col("seq")
    return l.where(~((F.col("branch") % 7 == 0) & (F.col("seq") == 2))).select(
        "branch", "seq", F.when(k % 11 == 0, F.concat(F.col("fix"), F.lit("X"))).otherwise(F.lower("fix")).alias("fix"), "path_terminator",
        F.when(k % 13 == 0, None).when(k % 5 == 0, F.col("distance_nm") + 0.5).when(k % 3 == 0, F.col("distance_nm") + 0.05).otherwise(F.col("distance_nm")).alias("distance_nm"),
        F.when(k % 4 == 0, F.pmod(F.col("course_deg") + 359.5, F.lit(360.0))).when(k % 9 == 0, F.col("course_deg") + 2).otherwise(F.col("course_deg")).alias("course_deg"), "altitude")


RIGHT = """r AS (SELECT branch, seq, CASE WHEN k % 11 = 0 THEN fix || 'X' ELSE lower(fix) END AS fix, path_terminator,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN distance_nm + 0.5 WHEN k % 3 = 0 THEN distance_nm + 0.05 ELSE distance_nm END AS distance_nm,
  CASE WHEN k % 4 = 0 THEN (course_deg + 359.5) % 360 WHEN k % 9 = 0 THEN course_deg + 2 ELSE course_deg END AS course_deg, altitude
  FROM (SELECT *, branch * 7 + seq AS k FROM l) WHERE NOT (branch % 7 = 0 AND seq = 2))"""


def compared(spark, sf_dir):
    p = compare.paired(left_legs(spark, sf_dir), right_legs(spark, sf_dir), ["branch", "seq"])
    c = F.col
    matched = {"fix": tol.same_text(c("fix_l"), c("fix_r")), "path_terminator": tol.same_text(c("path_terminator_l"), c("path_terminator_r")), "distance_nm": tol.distance_simple(c("distance_nm_l"), c("distance_nm_r")), "course_deg": tol.course_circular(c("course_deg_l"), c("course_deg_r")), "altitude_value": tol.same_number(c("altitude_l"), c("altitude_r"))}
    both = c("in_left") & c("in_right")
    weights = {"fix": 40, "path_terminator": 20, "distance_nm": 20, "course_deg": 10, "altitude_value": 10}
    score = F.when(both, compare.weighted_score(matched, weights)).otherwise(0.0)
    p = p.withColumn("score", score)
    return p.withColumn("status", compare.leg_status(c("in_left"), c("in_right"), c("score"))), matched


COMPARED = f"""{LEFT}, {RIGHT},
j AS (SELECT coalesce(l.branch, r.branch) AS branch, coalesce(l.seq, r.seq) AS seq, l.fix AS fix_l, r.fix AS fix_r, l.distance_nm AS d_l, r.distance_nm AS d_r, l.course_deg AS c_l, r.course_deg AS c_r, l.branch IS NOT NULL AS in_l, r.branch IS NOT NULL AS in_r,
    upper(trim(l.fix)) = upper(trim(r.fix)) AS m_fix, upper(l.path_terminator) = upper(r.path_terminator) AS m_pt, coalesce(abs(l.distance_nm - r.distance_nm) <= 0.1, l.distance_nm IS NULL AND r.distance_nm IS NULL) AS m_d,
    coalesce(least(abs(l.course_deg - r.course_deg) % 360, 360 - abs(l.course_deg - r.course_deg) % 360) <= 1, l.course_deg IS NULL AND r.course_deg IS NULL) AS m_c, l.altitude IS NOT DISTINCT FROM r.altitude AS m_a
  FROM l FULL JOIN r ON l.branch = r.branch AND l.seq = r.seq),
s AS (SELECT *, CASE WHEN in_l AND in_r THEN m_fix::INT * 40.0::DOUBLE + m_pt::INT * 20 + m_d::INT * 20 + m_c::INT * 10 + m_a::INT * 10 ELSE 0.0::DOUBLE END AS score FROM j),
t AS (SELECT *, CASE WHEN NOT in_l THEN 'MISSING_LEFT' WHEN NOT in_r THEN 'MISSING_RIGHT' WHEN score >= 99.999 THEN 'MATCH' WHEN score > 0 THEN 'PARTIAL' ELSE 'MISMATCH' END AS status FROM s)"""
_BRANCHES = f"""b AS (SELECT branch, count(*) AS total_legs, count(*) FILTER (status = 'MATCH') AS matched_legs, count(*) FILTER (status = 'PARTIAL') AS partial_legs, count(*) FILTER (status = 'MISMATCH') AS mismatched_legs, count(*) FILTER (status LIKE 'MISSING%') AS missing_legs, {sql_round('avg(score)', 1)} AS score FROM t GROUP BY branch)"""


@query("reconcile_scores", f"WITH {COMPARED}, {_BRANCHES} SELECT * FROM b")
def reconcile_scores(spark, sf_dir):
    return compare.branch_scores(compared(spark, sf_dir)[0], ["branch"])


@query("reconcile_summary", f"WITH {COMPARED}, {_BRANCHES} SELECT count(*) AS branches, CAST(sum(total_legs) AS BIGINT) AS total_legs, CAST(sum(matched_legs) AS BIGINT) AS matched_legs, CAST(sum(partial_legs) AS BIGINT) AS partial_legs, CAST(sum(mismatched_legs) AS BIGINT) AS mismatched_legs, CAST(sum(missing_legs) AS BIGINT) AS missing_legs, {sql_round('sum(score * total_legs) / sum(total_legs)', 1)} AS overall_score FROM b")
def reconcile_summary(spark, sf_dir):
    return compare.overall_summary(reconcile_scores(spark, sf_dir))


@query("field_mismatch_report", f"""WITH {COMPARED}, f AS (
  SELECT 'fix' AS field, m_fix AS matched, 'ERROR' AS sev FROM t WHERE in_l AND in_r UNION ALL SELECT 'path_terminator', m_pt, 'ERROR' FROM t WHERE in_l AND in_r UNION ALL SELECT 'distance_nm', m_d, 'WARNING' FROM t WHERE in_l AND in_r
  UNION ALL SELECT 'course_deg', m_c, 'WARNING' FROM t WHERE in_l AND in_r UNION ALL SELECT 'altitude_value', m_a, 'ERROR' FROM t WHERE in_l AND in_r)
SELECT field, CASE WHEN matched THEN 'INFO' ELSE sev END AS severity, count(*) AS n FROM f GROUP BY ALL""")
def field_mismatch_report(spark, sf_dir):
    legs, m = compared(spark, sf_dir)
    both = legs.where("in_left and in_right")
    c = lambda n: (F.col(f"{n}_l"), F.col(f"{n}_r"))
    fields = {"fix": (*c("fix"), m["fix"], "ERROR"), "path_terminator": (*c("path_terminator"), m["path_terminator"], "ERROR"), "distance_nm": (*c("distance_nm"), m["distance_nm"], "WARNING"), "course_deg": (*c("course_deg"), m["course_deg"], "WARNING"), "altitude_value": (*c("altitude"), m["altitude_value"], "ERROR")}
    return compare.field_rows(both, ["branch", "seq"], fields).groupBy("field", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("text_report", f"""WITH {COMPARED} SELECT branch, string_agg('leg ' || seq || ': ' || status, '; ' ORDER BY seq) AS report FROM t WHERE status <> 'MATCH' GROUP BY branch""")
def text_report(spark, sf_dir):
    bad = compared(spark, sf_dir)[0].where("status <> 'MATCH'")
    line = F.concat(F.lit("leg "), F.col("seq").cast("string"), F.lit(": "), F.col("status"))
    return bad.groupBy("branch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "; ").alias("report"))


@query("tolerance_profiles", f"""WITH {LEFT}, {RIGHT}, j AS (SELECT l.branch, l.seq, l.distance_nm AS a, r.distance_nm AS b, l.course_deg AS ca, r.course_deg AS cb FROM l JOIN r USING (branch, seq))
SELECT branch, seq, coalesce(abs(a - b) <= 0.1, a IS NULL AND b IS NULL) AS simple, coalesce(abs(a - b) <= 0.2 OR abs(a - b) <= 0.02 * greatest(abs(a), abs(b)), false) AS graph, coalesce(abs(a - b) <= 0.1, false) AS eval,
  coalesce(least(abs(ca - cb) % 360, 360 - abs(ca - cb) % 360) <= 1, ca IS NULL AND cb IS NULL) AS circular, coalesce(abs(ca - cb) <= 1, false) AS linear FROM j""")
def tolerance_profiles(spark, sf_dir):
    j = compare.paired(left_legs(spark, sf_dir), right_legs(spark, sf_dir), ["branch", "seq"]).where("in_left and in_right")
    a, b, ca, cb = F.col("distance_nm_l"), F.col("distance_nm_r"), F.col("course_deg_l"), F.col("course_deg_r")
    return j.select("branch", "seq", tol.distance_simple(a, b).alias("simple"), tol.distance_graph(a, b).alias("graph"), tol.distance_eval(a, b).alias("eval"), tol.course_circular(ca, cb).alias("circular"), tol.course_linear(ca, cb).alias("linear"))


@query("distance_rules", f"""WITH {LEFT}, {RIGHT}, j AS (SELECT l.branch, l.seq, l.path_terminator AS pt, CASE WHEN l.seq % 4 = 0 THEN NULL ELSE l.distance_nm END AS a, r.distance_nm AS b FROM l JOIN r USING (branch, seq))
SELECT branch, seq, CASE WHEN pt = 'CA' THEN 'NO_FIXED_ENDPOINT' WHEN a IS NULL AND b IS NOT NULL THEN 'VENDOR_ONLY' WHEN a IS NULL THEN 'MATCHED' WHEN b IS NULL THEN 'UNSUPPORTED' WHEN abs(a - b) <= 0.2 OR abs(a - b) <= 0.02 * greatest(abs(a), abs(b)) THEN 'MATCHED' ELSE 'DIFFERENT' END AS verdict FROM j""")
def distance_rules(spark, sf_dir):
    j = compare.paired(left_legs(spark, sf_dir), right_legs(spark, sf_dir), ["branch", "seq"]).where("in_left and in_right")
    a, b = F.when(F.col("seq") % 4 > 0, F.col("distance_nm_l")), F.col("distance_nm_r")
    open_ended = F.col("path_terminator_l").isin("CA", "VA", "VI", "VM", "FM", "VD", "VR")
    verdict = F.when(open_ended, "NO_FIXED_ENDPOINT").when(a.isNull() & b.isNotNull(), "VENDOR_ONLY").when(a.isNull(), "MATCHED").when(b.isNull(), "UNSUPPORTED").when(tol.distance_graph(a, b), "MATCHED").otherwise("DIFFERENT")
    return j.select("branch", "seq", verdict.alias("verdict"))


#: Alignment by a table for each branch, row by row, and the way back through it.
_ALIGNED = f"""
WITH RECURSIVE {LEFT}, {RIGHT},
al AS (SELECT branch, list(struct_pack(f := upper(trim(fix)), pt := path_terminator, s := lpad(seq::VARCHAR, 3, '0')) ORDER BY seq) AS a FROM l GROUP BY branch),
bl AS (SELECT branch, list(struct_pack(f := upper(trim(fix)), pt := path_terminator, s := lpad((seq * 2)::VARCHAR, 3, '0')) ORDER BY seq) AS b FROM r GROUP BY branch),
br AS MATERIALIZED (SELECT coalesce(al.branch, bl.branch) AS branch, coalesce(a, []) AS a, coalesce(b, []) AS b FROM al FULL JOIN bl ON al.branch = bl.branch),
cell AS (SELECT branch, x, y, CASE WHEN a[x].f = b[y].f THEN 4 ELSE -3 END + CASE WHEN a[x].pt = b[y].pt THEN 2 ELSE -1 END + CASE WHEN a[x].s = b[y].s THEN 1 ELSE 0 END AS w
  FROM (SELECT branch, a, b, unnest(range(1, len(a) + 1)) AS x FROM br), LATERAL (SELECT unnest(range(1, len(b) + 1)) AS y)),
weights AS MATERIALIZED (SELECT branch, x, list(w ORDER BY y) AS w FROM cell GROUP BY branch, x),
nw AS (
  SELECT branch, 0::BIGINT AS x, [list_transform(range(0, len(b) + 1), lambda j: CAST(-2 * j AS BIGINT))] AS rows FROM br
  UNION ALL SELECT nw.branch, nw.x + 1, list_append(nw.rows, list_reduce(list_transform(range(1, len(br.b) + 1), lambda j: [j]), lambda acc, j: list_append(acc, greatest(nw.rows[-1][j[1]] + weights.w[j[1]], nw.rows[-1][j[1] + 1] - 2, acc[-1] - 2)), [CAST(-2 * (nw.x + 1) AS BIGINT)]))
  FROM nw JOIN br ON br.branch = nw.branch AND nw.x < len(br.a) LEFT JOIN weights ON weights.branch = nw.branch AND weights.x = nw.x + 1),
tables AS MATERIALIZED (SELECT nw.branch, rows FROM nw JOIN br ON br.branch = nw.branch AND nw.x = len(br.a)),
way AS (
  SELECT branch, len(a) AS i, len(b) AS j, 0 AS back, NULL::BIGINT AS x, NULL::BIGINT AS y FROM br
  UNION ALL SELECT w.branch, CASE WHEN move < 2 THEN i - 1 ELSE i END, CASE WHEN move <> 1 THEN j - 1 ELSE j END, back + 1, CASE WHEN move < 2 THEN i END, CASE WHEN move <> 1 THEN j END
  FROM (SELECT way.branch, i, j, back, CASE WHEN i > 0 AND j > 0 AND t.rows[i + 1][j + 1] = t.rows[i][j] + q.w[j] THEN 0 WHEN i > 0 AND t.rows[i + 1][j + 1] = t.rows[i][j + 1] - 2 THEN 1 ELSE 2 END AS move
    FROM way JOIN tables t ON t.branch = way.branch LEFT JOIN weights q ON q.branch = way.branch AND q.x = way.i WHERE i > 0 OR j > 0) w)
SELECT way.branch, CAST(row_number() OVER (PARTITION BY way.branch ORDER BY back DESC) AS INT) AS position, a[way.x].s AS left_sequence, b[way.y].s AS right_sequence FROM way JOIN br ON br.branch = way.branch WHERE back > 0
"""


@query("align_sequences", _ALIGNED)
def align_sequences(spark, sf_dir):
    """Legs of both sources aligned by order and meaning, where sequence numbers differ."""
    l = left_legs(spark, sf_dir).withColumn("sequence", F.lpad(F.col("seq").cast("string"), 3, "0"))
    r = right_legs(spark, sf_dir).withColumn("sequence", F.lpad((F.col("seq") * 2).cast("string"), 3, "0"))
    return align.align_sequences(l, r, ["branch"])


@query("greedy_pairing", """
WITH RECURSIVE l AS (SELECT c_nationkey AS nation, substr(c_name, 14, 5) AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS x FROM customer),
r AS (SELECT s_nationkey AS nation, substr(s_name, 14, 4) AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS y FROM supplier),
w AS MATERIALIZED (SELECT r.nation, y, list(x ORDER BY x) AS xs FROM r JOIN l ON l.nation = r.nation AND (starts_with(l.name, r.name) OR starts_with(r.name, l.name)) GROUP BY r.nation, y),
n AS MATERIALIZED (SELECT nation, count(*) AS n FROM r GROUP BY nation),
t AS (SELECT nation, 0::BIGINT AS y, CAST([] AS BIGINT[]) AS used FROM n
  UNION ALL SELECT t.nation, t.y + 1, list_append(t.used, coalesce(list_filter(w.xs, lambda x: NOT list_contains(t.used, x))[1], 0)) FROM t JOIN n ON n.nation = t.nation AND t.y < n.n LEFT JOIN w ON w.nation = t.nation AND w.y = t.y + 1),
d AS MATERIALIZED (SELECT t.* FROM t JOIN n ON n.nation = t.nation AND t.y = n.n),
p AS MATERIALIZED (SELECT r.nation, r.name, d.used[r.y] AS x FROM r JOIN d ON d.nation = r.nation)
SELECT p.nation, CASE WHEN p.x > 0 THEN 'MATCHED' ELSE 'MISSING' END AS status, l.name AS left_name, p.name AS right_name FROM p LEFT JOIN l ON l.nation = p.nation AND l.x = p.x
UNION ALL SELECT l.nation, 'EXTRA', l.name, NULL FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.nation = l.nation AND p.x = l.x)""")
def greedy_pairing(spark, sf_dir):
    """Names of one nation's customers and suppliers paired in order, where one begins with the other."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.substring("c_name", 14, 5).alias("name"), F.col("c_custkey").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.substring("s_name", 14, 4).alias("name"), F.col("s_suppkey").alias("n"))
    return align.greedy_pairs(c, s, "nation", "name", "n")


@query("chain_legs", f"WITH {LEFT} SELECT branch, seq, fix, lag(fix) OVER w AS from_fix, lead(fix) OVER w AS next_fix, CAST(10 * row_number() OVER w AS INT) AS display_sequence, seq = min(seq) OVER (PARTITION BY branch) AS first, seq = max(seq) OVER (PARTITION BY branch) AS last FROM l WINDOW w AS (PARTITION BY branch ORDER BY seq)")
def chain_legs(spark, sf_dir):
    l = graph.chained(left_legs(spark, sf_dir), ["branch"], ["seq"])
    w = Window.partitionBy("branch")
    return l.select("branch", "seq", "fix", "from_fix", "next_fix", (10 * F.row_number().over(w.orderBy("seq"))).alias("display_sequence"), (F.col("seq") == F.min("seq").over(w)).alias("first"), (F.col("seq") == F.max("seq").over(w)).alias("last"))


@query("branch_ends", f"WITH {LEFT}, m AS (SELECT branch, seq, CASE WHEN seq % 3 = 1 THEN '' ELSE fix END AS fix FROM l) SELECT branch, arg_min(fix, seq) FILTER (fix <> '') AS entry_fix, arg_max(fix, seq) FILTER (fix <> '') AS exit_fix, count(*) AS legs, min(seq) AS first_sequence, max(seq) AS last_sequence FROM m GROUP BY branch")
def branch_ends(spark, sf_dir):
    l = left_legs(spark, sf_dir).withColumn("fix", F.when(F.col("seq") % 3 == 1, "").otherwise(F.col("fix")))
    return graph.branches(l, ["branch"], "seq")


@query("inherited_altitude", f"WITH {LEFT} SELECT branch, seq, CASE WHEN path_terminator = 'CF' AND lag(path_terminator) OVER w IN ('DF', 'TF') AND altitude IS NULL THEN lag(altitude) OVER w ELSE altitude END AS altitude FROM l WINDOW w AS (PARTITION BY branch ORDER BY seq)")
def inherited_altitude(spark, sf_dir):
    w = Window.partitionBy("branch").orderBy("seq")
    take = (F.col("path_terminator") == "CF") & F.lag("path_terminator").over(w).isin("DF", "TF") & F.col("altitude").isNull()
    return left_legs(spark, sf_dir).select("branch", "seq", F.when(take, F.lag("altitude").over(w)).otherwise(F.col("altitude")).alias("altitude"))


@query("discontinuities", """
WITH e AS (SELECT user_id, event_id, event_type, 'F' || (event_id % 4) AS fix, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT *, lag(fix) OVER w AS before_fix, lag(event_type) OVER w AS before_type FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, event_id, before_fix, fix FROM g WHERE before_type <> event_type AND before_fix <> fix""")
def discontinuities(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.concat(F.lit("F"), (F.col("event_id") % 4).cast("string")).alias("fix"), "ts")
    g = e.withColumn("before_fix", F.lag("fix").over(w)).withColumn("before_type", F.lag("event_type").over(w))
    return g.where("before_type <> event_type and before_fix <> fix").select("user_id", "event_id", "before_fix", "fix")


@query("route_code_align", """
WITH s AS (SELECT s_suppkey AS id, 'RW' || lpad(CAST(s_suppkey % 36 + 1 AS VARCHAR), 2, '0') || CASE s_suppkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'L' WHEN 2 THEN 'R' ELSE '' END AS rw, s_suppkey % 5 AS code FROM supplier),
v AS (SELECT c_custkey AS vid, 'RW' || lpad(CAST(c_custkey % 36 + 1 AS VARCHAR), 2, '0') || CASE c_custkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE 'C' END AS rw, c_custkey % 5 AS code FROM customer),
j AS (SELECT s.id, v.vid, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN s.rw = v.rw THEN 1 ELSE 2 END, v.vid) AS rn, s.rw AS srw, v.rw AS vrw FROM s JOIN v ON s.code = v.code AND substr(s.rw, 3, 2) = substr(v.rw, 3, 2) AND (s.rw = v.rw OR right(s.rw, 1) = 'B' OR right(v.rw, 1) = 'B'))
SELECT s.id, j.vid AS variant, coalesce(j.vrw, s.rw) AS runway FROM s LEFT JOIN j ON s.id = j.id AND j.rn = 1""")
def route_code_align(spark, sf_dir):
    """Each record takes the variant of its code with the same runway, else one of a compatible group, the first by number."""
    side = lambda k, m: F.concat(F.lit("RW"), F.lpad((F.col(k) % 36 + 1).cast("string"), 2, "0"), m)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), side("s_suppkey", F.element_at(F.array(F.lit("B"), F.lit("L"), F.lit("R"), F.lit("")), (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("rw"), (F.col("s_suppkey") % 5).alias("code"))
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("variant"), side("c_custkey", F.element_at(F.array(F.lit("L"), F.lit("R"), F.lit("C")), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("vrw"), (F.col("c_custkey") % 5).alias("vcode"))
    on = (F.col("code") == F.col("vcode")) & (tx.runway_number(F.col("rw")) == tx.runway_number(F.col("vrw"))) & tx.runways_compatible(F.col("rw"), F.col("vrw"))
    best = merge.top_one(s.join(v, on), ["id"], [F.when(F.col("rw") == F.col("vrw"), 1).otherwise(2), F.col("variant")])
    return s.select("id", "rw").join(best.select("id", "variant", "vrw"), "id", "left").select("id", "variant", F.coalesce("vrw", "rw").alias("runway"))


@query("filter_legs", f"WITH {LEFT} SELECT branch, seq, fix FROM l WHERE (fix LIKE 'P1%' OR fix LIKE 'P25%') AND (path_terminator <> 'IF' OR branch % 2 = 0)")
def filter_legs(spark, sf_dir):
    """Legs whose name goes with one of a list of prefixes; the last rule holds for one kind of legs only."""
    names = F.array(F.lit("P1"), F.lit("P25"))
    hit = F.exists(names, lambda n: F.col("fix").startswith(n))
    return left_legs(spark, sf_dir).where(hit & ((F.col("path_terminator") != "IF") | (F.col("branch") % 2 == 0))).select("branch", "seq", "fix")


# ---------------------------------------------------------------- 424 records


def order_legs(spark, sf_dir):
    """Legs that can be written as records, made of orders: a branch for each customer."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("ADLOV", "PIMOK", "SABKA", "OMKOM")]), (k % 4 + 1).cast("int")), F.lit(" "), (F.floor(k / 40) % 9 + 1).cast("string"), F.element_at(F.array(*[F.lit(x) for x in "ABCDEFGHJK"]), (F.floor(k / 4) % 10 + 1).cast("int")))
    n = F.row_number().over(w)
    return o.select(
        k.alias("branch"), name.alias("procedure_name"), F.concat(F.lit("RW"), F.lpad((F.floor(k / 360) % 99 + 1).cast("string"), 2, "0"), F.element_at(F.array(F.lit("L"), F.lit("R"), F.lit("C")), (F.floor(k / 35640) % 3 + 1).cast("int"))).alias("runway"), F.lit(None).cast("string").alias("transition_name"), n.alias("seq"), F.lpad(n.cast("string"), 3, "0").alias("sequence"),
        F.concat(F.lit("F"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("fix"), F.lit(None).cast("string").alias("fix_section"), F.element_at(F.array(*[F.lit(p) for p in PTS]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("path_terminator"),
        F.when(F.col("o_orderkey") % 3 == 0, "L").when(F.col("o_orderkey") % 3 == 1, "R").alias("turn_direction"), tol.round_half_up(F.col("o_totalprice") % 360, 1).alias("course_deg"), F.lit(None).cast("string").alias("recommended_navaid"),
        (F.col("o_orderkey") % 300 * 100 + 1000).cast("double").alias("altitude_value"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("altitude_sign"), F.lit(None).cast("double").alias("altitude_upper_ft"), F.lit(None).cast("double").alias("speed_limit"),
        F.lit(None).cast("boolean").alias("holding_at_fix"), F.lit(None).cast("boolean").alias("end_of_procedure"), tol.round_half_up(F.col("o_totalprice") % 90 + 1, 1).alias("distance_nm"))


def written_legs(spark, sf_dir):
    """Records of these legs; names come again after some hundred thousand customers, each of whom is a source of its own."""
    return arinc424.write_records(order_legs(spark, sf_dir), F.lit("WMKJ"), ["seq"], source=["branch"])


_ORDER_LEGS = f"""o AS (SELECT *, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
g AS (SELECT (ARRAY['ADLOV','PIMOK','SABKA','OMKOM'])[CAST(k % 4 + 1 AS INT)] AS base, CAST(k // 40 % 9 + 1 AS VARCHAR) || substr('ABCDEFGHJK', CAST(k // 4 % 10 + 1 AS INT), 1) AS suffix, lpad(CAST(n AS VARCHAR), 3, '0') AS sequence, 'RW' || lpad(CAST(k // 360 % 99 + 1 AS VARCHAR), 2, '0') || substr('LRC', CAST(k // 35640 % 3 + 1 AS INT), 1) AS rw, 'F' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS fix,
  (ARRAY{PTS!r})[CAST(o_orderkey % 6 + 1 AS INT)] AS pt, CASE o_orderkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE ' ' END AS turn, {sql_round('o_totalprice % 360', 1)} AS course, o_orderkey % 300 * 100 + 1000 AS alt, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS sign, {sql_round('o_totalprice % 90 + 1', 1)} AS dist, n, total FROM o)"""


@query("fixed_width_encode", f"""WITH {_ORDER_LEGS}, h AS (SELECT *, 'SSPAP WMKJWME' || substr(base, 1, 4) || suffix || '2' || rw || ' ' || sequence || fix || 'WM' || CASE WHEN n = 1 THEN 'EA' ELSE 'PC' END AS head FROM g)
SELECT base || ' ' || suffix AS procedure_name, rw AS runway, sequence, rpad(head || '1' || CASE WHEN n = total THEN 'EE' ELSE 'E ' END || '  ' || turn || '   ' || pt || repeat(' ', 21) || CASE WHEN pt IN ('AF', 'CA', 'CF') THEN lpad(CAST(CAST(floor(course * 10 + 0.5) AS BIGINT) AS VARCHAR), 4, '0') ELSE '    ' END || repeat(' ', 8) || sign || ' ' || lpad(CAST(alt AS VARCHAR), 5, '0') || repeat(' ', 29) || CASE WHEN suffix LIKE '%G' THEN 'DG' ELSE ' D' END, 132, ' ') AS "primary",
  rpad(head || '2P' || repeat(' ', 34) || lpad(CAST(CAST(floor(dist * 10 + 0.5) AS BIGINT) AS VARCHAR), 4, '0'), 132, ' ') AS continuation FROM h""")
def fixed_width_encode(spark, sf_dir):
    return written_legs(spark, sf_dir).select("procedure_name", "runway", "sequence", "primary", "continuation")


@query("fixed_width_roundtrip", f"""WITH {_ORDER_LEGS} SELECT CASE WHEN true THEN substr(base, 1, 4) || ' ' || suffix END AS procedure_name, rw AS runway, sequence, fix, pt AS path_terminator, nullif(turn, ' ') AS turn_direction, CASE WHEN pt IN ('AF', 'CA', 'CF') THEN course END AS course_deg, alt::DOUBLE AS altitude_value, sign AS altitude_sign, dist AS distance_nm, n = total AS end_of_procedure, CASE WHEN n = 1 THEN 'EA' ELSE 'PC' END AS fix_section FROM g""")
def fixed_width_roundtrip(spark, sf_dir):
    """Legs written as records and read again; the readable name has four letters of the fix."""
    lines = written_legs(spark, sf_dir).select(F.col("branch").alias("source"), F.posexplode(F.array("primary", "continuation")).alias("ordinal", "line"))
    legs = arinc424.merge_continuations(arinc424.parse_records(lines)).withColumn("procedure_name", arinc424.procedure_name(F.col("route_key")))
    return legs.select("procedure_name", "runway", "sequence", "fix", "path_terminator", "turn_direction", "course_deg", "altitude_value", "altitude_sign", "distance_nm", "end_of_procedure", "fix_section")


@query("encode_errors", """
WITH b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'RW' || lpad(CAST(s_suppkey % 36 AS VARCHAR), 2, '0') END AS rw, CAST(s_suppkey * 7 AS VARCHAR) AS sq, CASE WHEN s_suppkey % 5 = 0 THEN 'TOOLONG' ELSE 'OK' END AS fix, CASE WHEN s_suppkey % 2 = 0 THEN 'ADLOV 1E' ELSE 'ODD' END AS nm, s_acctbal AS d FROM supplier)
SELECT id, array_to_string(list_filter([CASE WHEN rw = '' THEN 'runway' END, CASE WHEN length(sq) > 3 THEN 'sequence' END, CASE WHEN fix = 'TOOLONG' THEN 'fix' END, CASE WHEN nm = 'ODD' THEN 'route code' END, CASE WHEN floor(d * 10 + 0.5) > 9999 THEN 'distance' END], lambda x: x IS NOT NULL), ', ') AS errors FROM b""")
def encode_errors(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("id"), F.lit(None).cast("string").alias("transition_name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("RW"), F.lpad((k % 36).cast("string"), 2, "0"))).alias("runway"), (k * 7).cast("string").alias("sequence"), F.when(k % 5 == 0, "TOOLONG").otherwise("OK").alias("fix"), tx.route_code(F.when(k % 2 == 0, "ADLOV 1E").otherwise("ODD")).alias("route_code"), F.col("s_acctbal").alias("distance_nm"))
    return s.select("id", F.array_join(arinc424.leg_errors(F.lit("WMKJ")), ", ").alias("errors"))


@query("continuation_merge", """
SELECT user_id, event_type, min_by(value, event_id) FILTER (value IS NOT NULL AND event_id % 3 <> 0) AS first_value, max_by(value, event_id) FILTER (event_id % 3 <> 0) AS last_value, bool_or(event_id % 50 = 0) AS flagged, count(*) FILTER (event_id % 3 = 0) AS extensions FROM events GROUP BY ALL""")
def continuation_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("main", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    known = F.when(F.col("main").isNotNull(), F.col("event_id"))
    return e.groupBy("user_id", "event_type").agg(F.min_by("main", known).alias("first_value"), F.max_by("main", known).alias("last_value"), F.bool_or(F.col("event_id") % 50 == 0).alias("flagged"), F.count_if(F.col("event_id") % 3 == 0).alias("extensions"))


@query("short_records", """
WITH k AS (SELECT s_suppkey AS k, translate(lpad((s_suppkey % 10000)::VARCHAR, 4, '0'), '0123456789', 'ABCDEFGHIJ') || (s_suppkey % 9 + 1) || 'A' AS code, 'RW' || lpad((s_suppkey % 36 + 1)::VARCHAR, 2, '0') AS rw, lpad((s_suppkey % 90 * 10)::VARCHAR, 3, '0') AS sq, 'FX' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS fix,
  s_suppkey % 3 AS shape, s_suppkey % 2 = 0 AS even, lpad((s_suppkey % 90 * 100 + 1000)::VARCHAR, 5, '0') AS alt, s_suppkey % 400 / 10.0::DOUBLE AS nm, (ARRAY['CF', 'TF', 'DF', 'CA'])[CAST(s_suppkey % 4 + 1 AS INT)] AS pt FROM supplier)
SELECT k AS source, substr(code, 1, 4) || ' ' || substr(code, 5) AS procedure_name, CASE WHEN shape = 2 THEN '' ELSE rw END AS runway, CASE WHEN shape = 2 THEN 'NORTH' END AS transition_name, sq AS sequence, CASE WHEN shape = 1 THEN '' ELSE fix END AS fix, CASE shape WHEN 0 THEN 'EA' WHEN 2 THEN 'PC' END AS fix_section,
  pt AS path_terminator, CASE WHEN shape < 2 AND even THEN 'L' END AS turn_direction, CASE shape WHEN 0 THEN '+' || alt WHEN 1 THEN '-' || alt END AS altitude_raw, CASE WHEN shape < 2 THEN alt::DOUBLE END AS altitude_value, CASE WHEN shape < 2 THEN nm END AS distance_nm, shape = 0 AS end_of_procedure FROM k""")
def short_records(spark, sf_dir):
    """Records without columns, three shapes of them, read by what is left of each line."""
    k = F.col("s_suppkey")
    t = lambda c, n: F.lpad(c.cast("string"), n, "0")
    code = F.concat(F.translate(t(k % 10000, 4), "0123456789", "ABCDEFGHIJ"), (k % 9 + 1).cast("string"), F.lit("A"))
    runway, sequence, fix = F.concat(F.lit("RW"), t(k % 36 + 1, 2)), t(k % 90 * 10, 3), F.concat(F.lit("FX"), t(k % 1000, 3))
    turn, altitude, miles = F.when(k % 2 == 0, "L ").otherwise(""), t(k % 90 * 100 + 1000, 5), t(k % 400, 4)
    pt = F.element_at(F.array(*[F.lit(x) for x in ("CF", "TF", "DF", "CA")]), (k % 4 + 1).cast("int"))
    head = F.concat(F.lit("SSPAP WMKJWMD"), code)
    named = F.array(F.concat(head, F.lit("2"), runway, sequence, fix, F.lit("WMEA1EE "), turn, pt, F.lit(" + "), altitude), F.concat(head, F.lit("2"), runway, sequence, fix, F.lit("WMEA2P  7  "), miles))
    bare = F.array(F.concat(head, runway, F.lit(" "), sequence, F.lit(" 1 "), turn, pt, F.lit(" -"), altitude), F.concat(head, runway, F.lit(" "), sequence, F.lit(" 2P "), miles), F.lit("SSPAP WMKJWMD nothing"))
    glued = F.array(F.lit("no record"), F.concat(head, F.lit("3NORTH"), sequence, fix, F.lit("WMPC1E"), pt))
    texts = table(spark, sf_dir, "supplier").select(k.alias("id"), F.array_join(F.when(k % 3 == 0, named).when(k % 3 == 1, bare).otherwise(glued), "\n").alias("text"))
    legs = arinc424.read_legs(texts, id_col="id")
    return legs.select("source", "procedure_name", "runway", "transition_name", "sequence", "fix", "fix_section", "path_terminator", "turn_direction", "altitude_raw", "altitude_value", "distance_nm", "end_of_procedure")
