"""Answers that are merged, walked and typed. A customer is a task, its orders of even number the answer that is there, the others the one that comes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waylark.functions.tolerance import round_half_up
from waylark.operators import answers, documents

from .common import table

Q: dict = {}
S: dict = {}
RUNWAYS = ["RWY16", "RW34", "RWY 16/34", ""]


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


def both_answers(spark, sf_dir):
    """The two answers of each task. Both count their evidence from e1 on; every third task has batch_2_e2 already."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = lambda x: x.cast("string")
    w = Window.partitionBy("o_custkey", "side").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, c, (k % 2).alias("side")).withColumn("nth", F.row_number().over(w))
    lw = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.row_number().over(lw).alias("seq"))
    own = F.concat(F.lit("e"), t(F.col("nth")))
    p = F.col("l_partkey")
    fix = F.concat(F.lit("F"), t(p % 23))
    legs = l.join(o, "o_orderkey").groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("seq", fix.alias("fix"), own.alias("ev"), (p % 4).alias("p4"), p.alias("p")))).alias("items"))
    o = o.join(legs, "o_orderkey", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<seq: int, fix: string, ev: string, p4: bigint, p: bigint>>")))
    name = F.concat(F.lit("p"), t(k % 5), F.lit(" 1A"), F.when(k % 3 == 0, " departure").otherwise(""))
    runway = F.nullif(F.element_at(F.array(*map(F.lit, RUNWAYS)), (k % 4 + 1).cast("int")), F.lit(""))
    legs_of = F.when(k % 3 > 0, F.transform("items", lambda x: F.struct((x["seq"] * 10).cast("int").alias("sequence"), F.lit("TF").alias("path_terminator"), x["fix"].alias("fix"), x["ev"].alias("source_evidence_id")))).otherwise(F.array())
    procedure = F.struct(name.alias("name"), runway.alias("runway"), F.when(k % 7 == 0, "NORTH TRANSITION").alias("transition"), (k % 10 / 10.0).cast("double").alias("confidence"), F.array(own, F.lit("e1"), F.lit("x")).alias("source_evidence_ids"), legs_of.cast(f"array<{answers.LEG}>").alias("legs"))
    fixes = F.transform("items", lambda x: F.struct(F.when(x["p"] % 2 == 0, F.lower(x["fix"])).otherwise(x["fix"]).alias("identifier"), F.when(x["p4"] > 0, x["p"].cast("double")).alias("lon"), F.when(x["p4"] > 1, x["p"] / 2).cast("double").alias("lat"), F.when(x["p4"] == 3, "raw").when(x["p4"] == 2, "").alias("raw"), x["ev"].alias("source_evidence_id")))
    rows = F.transform("items", lambda x: F.struct(F.concat(F.lit("P"), t(k % 5), F.lit(" 1A RWY 16"), F.when(x["p"] % 5 == 0, "/34").otherwise("")).alias("name"), x["seq"].cast("int").alias("sequence"), x["fix"].alias("fix"), x["ev"].alias("evidence_id")))
    evidence = F.struct(own.alias("id"), F.col("nth").cast("int").alias("page"), t(k).alias("text"))
    warning = F.struct(F.concat(F.lit("w"), t(k % 3)).alias("message"), F.when(k % 2 == 0, "e1").otherwise("e9999").alias("evidence_id"))
    item = o.select(c.alias("task"), "side", "nth", F.struct(procedure.alias("procedure"), fixes.alias("fixes"), rows.alias("rows"), evidence.alias("evidence"), warning.alias("warning"), F.concat(F.lit(" n"), t(k % 4)).alias("name"), k.alias("k")).alias("v"))
    whole = item.groupBy("task", "side").agg(F.array_sort(F.collect_list(F.struct("nth", "v"))).alias("a"))
    of = lambda f: F.transform("a", lambda x: x["v"][f])
    planted = F.when((F.col("task") % 3 == 0) & (F.col("side") == 0), F.array(F.struct(F.lit("batch_2_e2").alias("id"), F.lit(0).alias("page"), F.lit("planted").alias("text")))).otherwise(F.slice(F.array(F.struct(F.lit("").alias("id"), F.lit(0).alias("page"), F.lit("").alias("text"))), 1, 0))
    first = F.get("a", F.lit(0))["v"]["k"]
    answer = whole.select(
        "task", "side", F.when(first % 2 == 0, "AAAA").alias("airport"), F.when(first % 3 == 0, "SID").alias("package"), F.lit(None).cast("string").alias("category"), F.lit("RNAV").alias("navigation"), t(first % 4).alias("runway"), of("name").alias("names"), of("procedure").alias("procedures"), F.flatten(of("rows")).alias("table_legs"),
        F.flatten(of("fixes")).alias("fixes"), F.concat(planted, of("evidence")).alias("evidence"), of("warning").alias("warnings"), F.when(first % 5 > 0, (first % 8 / 8.0).cast("double")).alias("confidence"), (first % 6 == 0).alias("review"),
    )
    return answer.where("side = 0").drop("side"), answer.where("side = 1").drop("side")


MERGED = f"""
WITH o AS MATERIALIZED (SELECT o_orderkey AS k, o_custkey AS task, o_orderkey % 2 AS side, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS nth FROM orders),
s AS MATERIALIZED (SELECT task, bool_or(side = 0) AS e, bool_or(side = 1) AS i, count(*) FILTER (side = 0) AS ne FROM o GROUP BY task),
m AS MATERIALIZED (SELECT o.*, s.e AND s.i AS both_, CASE WHEN side = 1 AND nth <= ne THEN 'batch_' || CASE WHEN task % 3 = 0 AND nth >= 2 THEN nth + 1 ELSE nth END || '_e' || nth ELSE 'e' || nth END AS ev,
    CASE WHEN side = 1 AND ne >= 1 THEN 'batch_1_e1' ELSE 'e1' END AS ev1 FROM o JOIN s USING (task)),
l AS MATERIALIZED (SELECT m.*, l_partkey AS p, 'F' || (l_partkey % 23) AS fix, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem JOIN m ON l_orderkey = k),
pr AS (SELECT m.*, 'P' || (k % 5) || ' 1A' AS family, CASE k % 4 WHEN 0 THEN '16' WHEN 1 THEN '34' WHEN 2 THEN '16/34' ELSE '' END AS variant, CASE WHEN k % 7 = 0 THEN 'NORTH' ELSE '' END AS tr, k % 10 / 10.0::DOUBLE AS conf,
    coalesce((SELECT string_agg(seq * 10 || ':' || fix || ':' || l.ev, ',' ORDER BY seq) FROM l WHERE l.k = m.k AND m.k % 3 > 0), '') AS legs FROM m),
pk AS (SELECT *, min((side, nth)) OVER w AS pos, row_number() OVER (PARTITION BY task, family, variant, tr ORDER BY side DESC, nth DESC) AS rn FROM pr WHERE both_ WINDOW w AS (PARTITION BY task, family, variant, tr)),
p1 AS (SELECT * FROM pk WHERE rn = 1),
p2 AS (SELECT *, bool_or(legs <> '') OVER (PARTITION BY task) AS has_legs FROM p1),
p3 AS (SELECT * FROM p2 WHERE NOT has_legs OR legs <> '' OR conf > 0.5),
p4 AS (SELECT * FROM p3 WHERE variant IN ('', '16/34') OR NOT EXISTS (SELECT 1 FROM p3 x WHERE x.task = p3.task AND x.family = p3.family AND x.variant = '16/34')
  UNION ALL SELECT *, (side, nth), 1, true FROM pr WHERE NOT both_),
tl AS (SELECT *, 'P' || (k % 5) || ' 1A RWY 16' || CASE WHEN p % 5 = 0 THEN '/34' ELSE '' END AS name, k % 5 AS fam, p % 5 = 0 AS wide FROM l),
t1 AS (SELECT *, min((side, nth, seq)) OVER (PARTITION BY task, name, seq) AS pos, row_number() OVER (PARTITION BY task, name, seq ORDER BY side DESC, nth DESC) AS rn FROM tl WHERE both_),
t2 AS (SELECT * FROM t1 WHERE rn = 1),
t3 AS (SELECT task, name, seq, fix, ev, pos FROM t2 WHERE wide OR NOT EXISTS (SELECT 1 FROM t2 x WHERE x.task = t2.task AND x.fam = t2.fam AND x.wide) UNION ALL SELECT task, name, seq, fix, ev, (side, nth, seq) FROM tl WHERE NOT both_),
fx AS (SELECT *, CASE WHEN p % 2 = 0 THEN lower(fix) ELSE fix END AS ident, CASE WHEN p % 4 > 0 THEN p::DOUBLE END AS lon, CASE WHEN p % 4 > 1 THEN p / 2.0::DOUBLE END AS lat, CASE p % 4 WHEN 3 THEN 'raw' WHEN 2 THEN '' END AS raw, row_number() OVER (PARTITION BY task ORDER BY side, nth, seq) AS pos FROM l),
f1 AS (SELECT *, max(pos) FILTER (side = 0) OVER (PARTITION BY task, fix) AS last_e, min(pos) FILTER (side = 1) OVER (PARTITION BY task, fix) AS first_i FROM fx WHERE both_),
f2 AS (SELECT *, coalesce(last_e, first_i) AS base FROM f1),
f3 AS (SELECT task, min(pos) AS pos, arg_max(ident, pos) FILTER (pos = base OR side = 1) AS ident, coalesce(arg_max(lon, pos) FILTER (lon IS NOT NULL AND (pos = base OR side = 1)), NULL) AS lon, arg_max(lat, pos) FILTER (lat IS NOT NULL AND (pos = base OR side = 1)) AS lat,
    coalesce(arg_max(raw, pos) FILTER (raw <> '' AND (pos = base OR side = 1)), any_value(raw) FILTER (pos = base)) AS raw, arg_max(ev, pos) FILTER (pos = base OR side = 1) AS ev FROM f2 GROUP BY task, fix
  UNION ALL SELECT task, pos, ident, lon, lat, raw, ev FROM fx WHERE NOT both_),
ws AS (SELECT task, 'w' || (k % 3) AS message, CASE WHEN k % 2 = 0 THEN 'e1' ELSE 'e9999' END AS ev, both_, side, nth FROM m),
rows AS (
  SELECT task, 'procedure' AS part, dense_rank() OVER (PARTITION BY task ORDER BY pos) AS ordinal, family || '|' || variant || '|' || (CASE WHEN k % 7 = 0 THEN CASE WHEN both_ THEN 'NORTH' ELSE 'NORTH TRANSITION' END ELSE '' END) || '|' || legs || '|' || ev || ',' || ev1 || ',x' AS text FROM p4
  UNION ALL SELECT task, 'table', row_number() OVER (PARTITION BY task ORDER BY pos), name || '|' || seq || '|' || fix || '|' || ev FROM t3
  UNION ALL SELECT task, 'fix', row_number() OVER (PARTITION BY task ORDER BY pos), ident || '|' || coalesce(CAST(CAST(lon AS BIGINT) AS VARCHAR), '') || '|' || coalesce(CAST(CAST(lat * 2 AS BIGINT) AS VARCHAR), '') || '|' || coalesce(raw, '') || '|' || ev FROM f3
  UNION ALL SELECT task, 'evidence', row_number() OVER (PARTITION BY task ORDER BY side, nth), id || '|' || page || '|' || text FROM (SELECT task, side, nth, ev AS id, nth AS page, k::VARCHAR AS text FROM m UNION ALL SELECT task, 0, 0, 'batch_2_e2', 0, 'planted' FROM s WHERE task % 3 = 0 AND e)
  UNION ALL SELECT task, 'warning', row_number() OVER (PARTITION BY task ORDER BY pos), message || '|' || ev FROM (SELECT task, message, ev, min((side, nth)) AS pos FROM ws WHERE both_ GROUP BY ALL UNION ALL SELECT task, message, ev, (side, nth) FROM ws WHERE NOT both_))
SELECT task, part, CAST(ordinal AS INT) AS ordinal, text FROM rows
"""


@query("merged_answers", MERGED)
def merged_answers(spark, sf_dir):
    """All arrays of the merged answers, a row for each entry."""
    m = answers.merge_answers(*both_answers(spark, sf_dir), ["task"])
    t = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    bar = lambda *c: F.concat_ws("|", *[t(x) for x in c])
    legs = lambda x: F.array_join(F.transform(x["legs"], lambda g: F.concat_ws(":", t(g["sequence"]), g["fix"], g["source_evidence_id"])), ",")
    parts = {
        "procedure": F.transform("procedures", lambda x: bar(answers.family(x["name"]), answers.runway_variant(x["runway"]), x["transition"], legs(x), F.array_join(x["source_evidence_ids"], ","))),
        "table": F.transform("table_legs", lambda x: bar(x["name"], x["sequence"], x["fix"], x["evidence_id"])),
        "fix": F.transform("fixes", lambda x: bar(x["identifier"], x["lon"].cast("long"), (x["lat"] * 2).cast("long"), x["raw"], x["source_evidence_id"])),
        "evidence": F.transform("evidence", lambda x: bar(x["id"], x["page"], x["text"])),
        "warning": F.transform("warnings", lambda x: bar(x["message"], x["evidence_id"])),
    }
    rows = None
    for name, texts in parts.items():
        one = m.select("task", F.lit(name).alias("part"), F.posexplode(texts).alias("ordinal", "text"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("task", "part", (F.col("ordinal") + 1).alias("ordinal"), "text")


# ---------------------------------------------------------------- documents

#: A conversation's turns as a nested JSON document, deeper with each kind; keys stand in alphabetical order, as VARIANT keeps them.


def turn_documents(spark, sf_dir):
    """(conv_id, doc): the texts of a conversation, by the remainder of their turn at four depths and under a key that is passed over."""
    t = table(spark, sf_dir, "conversations")
    text, n = F.coalesce("text", F.lit("")), F.col("turn")
    kind = n % 5
    deep = lambda inner, levels: deep(F.concat(F.lit('{"k":['), inner, F.lit("]}")), levels - 1) if levels else inner
    quoted = F.to_json(F.struct(text.alias("t")))
    entry = F.when(kind == 0, quoted).when(kind == 1, F.concat(F.lit('{"a":'), quoted, F.lit(',"rawResponse":'), quoted, F.lit("}"))).when(kind == 2, deep(quoted, 1)).when(kind == 3, deep(quoted, 2)).otherwise(F.concat(F.lit("[12,null,true,"), quoted, F.lit("]")))
    lines = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", entry.alias("e")))).alias("a"))
    return lines.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["e"]), ","), F.lit("]")).alias("doc"))


@query("collected_texts", """
WITH t AS (SELECT conv_id, turn % 5 AS kind, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS nth FROM conversations)
SELECT conv_id, nth || CASE kind WHEN 0 THEN ',0' WHEN 1 THEN ',0,0' WHEN 2 THEN ',0,0,0' ELSE ',3,0' END AS path, text FROM t WHERE kind <> 3 AND regexp_matches(text, '[A-Za-z0-9]')""")
def collected_texts(spark, sf_dir):
    """The texts of all conversations with their places; those of the fourth kind lie too deep."""
    found = documents.collected_texts(turn_documents(spark, sf_dir), ["conv_id"], "doc")
    return found.select("conv_id", F.array_join(F.transform("path", lambda p: p.cast("string")), ",").alias("path"), "text")


def model_answers(spark, sf_dir):
    """(task, doc): an answer for each customer, made of its orders and line items, with fields that are missing, misplaced or of the wrong kind."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = lambda x: x.cast("string")
    o = table(spark, sf_dir, "orders").select(k, c)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", F.row_number().over(w).alias("seq"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    name = F.concat(F.lit("P"), t(k % 7), F.lit(" 1A"))
    sequence = F.when(p % 4 == 0, F.concat(F.lit('"'), t(F.col("seq") * 10), F.lit('"'))).when(p % 4 == 1, "1.5").otherwise(t(F.col("seq") * 10))
    fix = F.concat(F.when(p % 3 == 0, '"fixIdentifier":"F').otherwise('"toFix":"F'), t(p % 50), F.lit('"'))
    altitude = F.element_at(F.array(*map(F.lit, ["+03500", "-06000", "4000 9000", "", "FL"])), (s % 5 + 1).cast("int"))
    turn = F.element_at(F.array(*map(F.lit, ["L", "R", "NONE", "X"])), (s % 4 + 1).cast("int"))
    leg = F.concat(F.lit('{"procedureName":"'), name, F.lit('","sequence":'), sequence, F.lit(","), fix, F.lit(',"altitudeConstraint":"'), altitude, F.lit('","turnDirection":"'), turn, F.lit('","confidence":'), F.when(p % 5 == 0, "null").otherwise(F.concat(F.lit("0."), t(p % 8 + 1))), F.when(p % 6 == 0, ',"sourcePageNo":3').otherwise(""), F.lit("}"))
    legs = l.join(o, "o_orderkey").select("o_custkey", "o_orderkey", "seq", leg.alias("leg")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "seq", "leg"))), lambda x: x["leg"]), ",").alias("legs"))
    made = F.concat(F.lit('{"procedureName":"'), name, F.lit('","runway":"RWY'), t(k % 36), F.lit('"'), F.when(k % 5 == 0, ',"transitionName":"NORTH TRANSITION"').otherwise(""), F.when(k % 3 == 0, ',"confidence":0.25').otherwise(""), F.when(k % 4 == 0, ',"reviewRequired":true').when(k % 4 == 1, ',"reviewRequired":"yes"').otherwise(""), F.lit("}"))
    procedures = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", made.alias("m")))), lambda x: x["m"]), ",").alias("procedures"))
    whole = procedures.join(legs, "o_custkey", "left")
    doc = F.concat(
        F.lit('{"airportIcao":'), F.when(c % 3 == 0, "7").otherwise('"AAAA"'), F.lit(',"procedureClassification":{"packageType":"SID"}'), F.when(c % 2 == 0, ',"packageType":"STAR"').otherwise(""), F.lit(',"confidence":'), F.when(c % 4 == 0, '"0.75"').when(c % 4 == 1, "true").otherwise("0.5"),
        F.lit(',"procedures":['), F.col("procedures"), F.lit('],"tableLegs":['), F.coalesce("legs", F.lit("")), F.lit("]}"),
    )
    return whole.select(c.alias("task"), doc.alias("doc"))


@query("normalized_answers", """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS task, 'P' || (o_orderkey % 7) || ' 1A' AS name FROM orders),
l AS (SELECT o.*, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem JOIN o ON l_orderkey = k),
m AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY k, seq) AS nth, CASE WHEN p % 4 = 1 THEN NULL ELSE seq * 10 END AS sq, 'F' || (p % 50) AS fix, CASE s % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'STRAIGHT' ELSE '' END AS turn,
    CASE s % 5 WHEN 0 THEN 'AT_OR_ABOVE:3500:3500:' WHEN 1 THEN 'AT_OR_BELOW:6000::6000' WHEN 2 THEN ':4000::9000' WHEN 3 THEN '' ELSE ':::' END AS altitude, CASE WHEN p % 5 = 0 THEN 0.5::DOUBLE ELSE (p % 8 + 1) / 10.0::DOUBLE END AS conf, CASE WHEN p % 6 = 0 THEN 'tabular page 3' ELSE 'tableLegs' END AS derivation FROM l),
g AS (SELECT task, name, string_agg(coalesce(sq, 1) || ':' || fix || ':' || turn || ':' || altitude || ':' || derivation, ';' ORDER BY coalesce(sq, 0), nth) AS legs, avg(conf) AS conf, min(nth) AS at_leg,
    CAST(sum(CASE WHEN p % 4 = 1 THEN 1 ELSE 0 END + CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p % 5 = 0 THEN 0 ELSE 0 END) AS BIGINT) AS repairs FROM m GROUP BY task, name),
q AS (SELECT *, row_number() OVER (PARTITION BY task, name ORDER BY k DESC) AS rn FROM o),
x AS (SELECT q.task, q.name, k, coalesce(legs, '') AS legs, g.conf FROM q LEFT JOIN g ON g.task = q.task AND g.name = q.name WHERE rn = 1),
r AS (SELECT o.task, coalesce((SELECT sum(repairs) FROM g WHERE g.task = o.task), 0) + count(*) FILTER (k % 4 = 1) + CASE WHEN o.task % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o.task % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN o.task % 4 = 1 THEN 1 ELSE 0 END AS n FROM o GROUP BY o.task)
SELECT x.task, CASE WHEN x.task % 3 > 0 THEN 'AAAA' END AS airport, CASE WHEN x.task % 2 = 0 THEN 'STAR' ELSE 'SID' END AS package, CASE WHEN x.task % 4 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS answer_confidence, x.name, CASE WHEN k % 5 > 0 THEN 'RWY' || (k % 36) END AS runway, CASE WHEN k % 5 = 0 THEN 'NORTH' END AS transition, legs,
  floor(CASE WHEN k % 3 = 0 THEN 0.25::DOUBLE ELSE coalesce(x.conf, 0.5::DOUBLE) END * 1000000.0 + 0.5) / 1000000.0 AS confidence, k % 4 = 0 AS review, CAST(r.n AS BIGINT) AS repairs
FROM x JOIN r USING (task)""")
def normalized_answers(spark, sf_dir):
    """The procedures of all typed answers with their legs, and how many repairs each answer took."""
    n = documents.normalized(model_answers(spark, sf_dir), ["task"], "doc")
    number = lambda x: F.coalesce(x.cast("long").cast("string"), F.lit(""))
    altitude = lambda a: F.when(a.isNotNull(), F.concat_ws(":", F.coalesce(a["kind"], F.lit("")), number(a["altitude_ft"]), number(a["lower_ft"]), number(a["upper_ft"]))).otherwise("")
    leg = lambda x: F.concat_ws(":", x["sequence"].cast("string"), x["fix"], F.coalesce(x["turn"], F.lit("")), altitude(x["altitude"]), x["derivation"])
    rows = n.select("task", "airport", "package", F.col("confidence").alias("answer_confidence"), F.size("repairs").cast("long").alias("repairs"), F.explode_outer("procedures").alias("p")).where("p is not null")  # an inner one would be filtered for rows first, which types all legs again for each name
    return rows.select("task", "airport", "package", "answer_confidence", "p.name", "p.runway", "p.transition", F.array_join(F.transform("p.legs", leg), ";").alias("legs"), round_half_up(F.col("p.confidence"), 6).alias("confidence"), "p.review", "repairs")
