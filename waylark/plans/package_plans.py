"""Packages of pages. Forty documents are a publication; each block of four pages after its index has a chart, its tables and something else."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.operators import packages

from .common import table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


#: Fixed values of the blocks, by the remainder of their number.
CATEGORY, PACKAGE, LETTERS = ["DEPARTURE", "ARRIVAL", "APPROACH"], ["SID", "STAR", "APPROACH"], ["SID", "STAR", "IAC"]
TITLE = ["STANDARD DEPARTURE CHART", "STANDARD ARRIVAL CHART", "INSTRUMENT APPROACH CHART"]


def _at(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number + 1).cast("int"))


def publications(spark, sf_dir):
    """Pages and index items. Every second publication has lettered numbers, every third no index; each page ends with its document's whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    n = F.col("doc_id")
    d = d.select(F.floor(n / 40).cast("long").alias("scope"), n.alias("page_no"), (n % 40).alias("pos"), F.coalesce("text", F.lit("")).alias("body"))
    d = d.withColumn("b", F.floor((F.col("pos") - 1) / 4).cast("long")).withColumn("q", F.pmod(F.col("pos") - 1, F.lit(4)))
    b, q, f = F.col("b"), F.col("q"), F.col("scope")
    s = lambda c: c.cast("string")
    kind, nav, runway = F.pmod(b, F.lit(3)), F.when(b % 2 == 0, "RNAV").otherwise("VOR"), F.when(b % 2 == 0, "RWY16").otherwise("RWY34")
    stem = F.concat(F.lit("AD 2-"), F.translate(F.lpad(s(f % 10000), 4, "0"), "0123456789", "ABCDEFGHIJ"), F.lit("-"))
    lettered = f % 2 == 1
    chart = F.when(lettered, F.concat(stem, _at(LETTERS, kind), F.lit("-"), s(b + 1))).otherwise(F.concat(stem, F.lit("6-"), s(b * 4 + 1)))
    own = F.when(q == 0, chart).when(lettered, F.concat(chart, F.lit("."), s(q))).otherwise(F.concat(stem, F.lit("6-"), s(b * 4 + 1 + q)))
    name = F.when(kind == 2, F.concat(nav, F.lit(" "), runway)).otherwise(F.concat(F.translate(s(b % 6), "012345", "ABCDEF"), F.lit("WXYZ "), s(f % 9 + 1), F.lit("A")))
    role = F.when(F.col("pos") == 0, "CHART_INDEX").when(q == 0, "CHART").when(q == 1, "TABULAR_DESCRIPTION").when(q == 2, "WAYPOINT_COORDINATES").when(b % 2 == 0, "MINIMA_TABLE").when(b % 4 == 1, "SUPPORT").otherwise("CHART")
    number = F.when(F.col("pos") == 0, None).when((q == 3) & (b % 6 == 5), chart).otherwise(own)
    torn = lettered & (q == 0) & (b % 4 == 1) & (F.col("pos") > 0)
    words = F.when(q == 0, F.concat(_at(TITLE, kind), F.lit(" - "), F.regexp_replace(runway, "RWY", "RWY "), F.lit(" "), nav)).when(q == 1, "TABULAR DESCRIPTION").when(q == 2, "WAYPOINT COORDINATES").when(b % 2 == 0, "OPERATING VALUES").when(b % 4 == 1, "GENERAL").otherwise("AERODROME CHART")
    split = F.concat(F.substring(chart, 1, 11), F.lit("\n "), F.substring(chart, F.lit(12), F.lit(99)))
    pages = d.select(
        "scope", "page_no", F.concat_ws("\n", F.when(torn, "").when(F.col("pos") == 0, "INDEX").otherwise(own), words, F.col("body"), F.when(torn, split)).alias("text"), role.alias("role"), F.when(F.col("pos") == 0, "UNKNOWN").otherwise(_at(CATEGORY, kind)).alias("category"),
        nav.alias("navigation"), runway.alias("runway"), words.alias("title"), F.array().cast("array<string>").alias("names"), F.when(kind != 2, name).alias("confirmed"), F.when(~torn, number).alias("page_no_text"), F.when(~torn, number).alias("number"),
        F.when(f % 6 == 5, F.concat(F.lit("File"), s(F.floor(b / 2)))).alias("source_file"),
    )
    listed = d.where((f % 3 != 2) & (F.col("pos") > 0) & (b % 4 != 3))
    item = lambda rows, ordinal, no, title, tabular_no: rows.select("scope", ordinal.cast("long").alias("ordinal"), no.alias("chart_no"), title.alias("name"), _at(PACKAGE, kind).alias("package"), _at(CATEGORY, kind).alias("category"), nav.alias("navigation"), runway.alias("runway"), F.array(name).alias("names"), (F.lit(tabular_no) > 0).alias("tabular"), F.when(F.lit(tabular_no) > 0, F.lit(tabular_no)).alias("tabular_no"))
    items = item(listed.where(q == 0), b * 10, chart, F.concat(_at(TITLE, kind), F.lit(" "), name), 0)
    items = items.unionByName(item(listed.where((q == 1) & (b % 2 == 0)), b * 10 + 1, own, F.lit("TABULAR 1"), 1)).unionByName(item(listed.where((q == 2) & (b % 4 == 0)), b * 10 + 2, own, F.lit("TABULAR 2"), 2))
    items = items.unionByName(item(listed.where((q == 0) & (b % 5 == 0)), b * 10 + 3, F.concat(stem, F.lit("99-"), s(b + 1)), F.lit("GONE"), 0))
    return pages, items


_PICK = lambda values, number: f"(ARRAY{values!r})[CAST({number} + 1 AS INT)]"
PUBLICATIONS = f"""
d AS (SELECT doc_id // 40 AS scope, doc_id AS page_no, doc_id % 40 AS pos, CASE WHEN doc_id % 40 = 0 THEN -1 ELSE (doc_id % 40 - 1) // 4 END AS b, (doc_id % 40 + 3) % 4 AS q FROM documents),
v AS (SELECT *, (b + 3) % 3 AS kind, CASE WHEN b % 2 = 0 THEN 'RNAV' ELSE 'VOR' END AS nav, CASE WHEN b % 2 = 0 THEN 'RWY16' ELSE 'RWY34' END AS rw, 'AD 2-' || translate(lpad((scope % 10000)::VARCHAR, 4, '0'), '0123456789', 'ABCDEFGHIJ') || '-' AS stem, scope % 2 = 1 AS lettered FROM d),
w AS (SELECT *, CASE WHEN lettered THEN stem || {_PICK(LETTERS, "kind")} || '-' || (b + 1) ELSE stem || '6-' || (b * 4 + 1) END AS chart, CASE WHEN kind = 2 THEN nav || ' ' || rw ELSE translate((b % 6)::VARCHAR, '012345', 'ABCDEF') || 'WXYZ' || (scope % 9 + 1) || 'A' END AS label FROM v),
pg AS MATERIALIZED (SELECT *, CASE WHEN q = 0 THEN chart WHEN lettered THEN chart || '.' || q ELSE stem || '6-' || (b * 4 + 1 + q) END AS own,
    CASE WHEN pos = 0 THEN 'CHART_INDEX' WHEN q = 0 THEN 'CHART' WHEN q = 1 THEN 'TABULAR_DESCRIPTION' WHEN q = 2 THEN 'WAYPOINT_COORDINATES' WHEN b % 2 = 0 THEN 'MINIMA_TABLE' WHEN b % 4 = 1 THEN 'SUPPORT' ELSE 'CHART' END AS role, lettered AND q = 0 AND b % 4 = 1 AND pos > 0 AS torn,
    {_PICK(PACKAGE, "kind")} AS package, {_PICK(CATEGORY, "kind")} AS category FROM w),
p AS MATERIALIZED (SELECT *, CASE WHEN pos = 0 OR torn THEN NULL WHEN q = 3 AND b % 6 = 5 THEN chart ELSE own END AS number, CASE WHEN kind = 2 THEN label ELSE left(label, 5) || ' ' || label[6:] END AS name,
    CASE WHEN kind = 2 THEN 'APPROACH::' || nav || '::' || rw || '::' || label ELSE category || '::' || package || '::' || nav || '::' || rw || '::' || label END AS key, CASE WHEN scope % 6 = 5 THEN 'FILE' || CAST(floor(b / 2) AS INT) END AS file FROM pg),
li AS (SELECT * FROM p WHERE scope % 3 <> 2 AND pos > 0 AND b % 4 <> 3),
i AS MATERIALIZED (
  SELECT scope, b * 10 AS ordinal, chart AS no, 0 AS t, package, key, name, rw, nav, category FROM li WHERE q = 0
  UNION ALL SELECT scope, b * 10 + 1, own, 1, package, key, name, rw, nav, category FROM li WHERE q = 1 AND b % 2 = 0
  UNION ALL SELECT scope, b * 10 + 2, own, 2, package, key, name, rw, nav, category FROM li WHERE q = 2 AND b % 4 = 0
  UNION ALL SELECT scope, b * 10 + 3, stem || '99-' || (b + 1), 0, package, key, name, rw, nav, category FROM li WHERE q = 0 AND b % 5 = 0)"""
GROUPED = f"""WITH {PUBLICATIONS},
c1 AS MATERIALIZED (SELECT i.scope, i.key, 1 AS stage, ordinal, page_no, i.no, i.t, i.name, p.role FROM i JOIN p ON p.scope = i.scope AND p.role <> 'CHART_INDEX' AND (p.number = i.no OR starts_with(p.number, i.no) AND regexp_matches(p.number[length(i.no) + 1:], '^[-.][0-9]{{1,2}}$'))),
c2 AS MATERIALIZED (SELECT p.scope, i.key, 2 AS stage, ordinal, page_no, i.no, i.t, i.name, p.role FROM p JOIN i ON p.role NOT IN ('CHART_INDEX', 'SUPPORT') AND i.scope = p.scope AND starts_with(p.own, i.no) AND p.page_no NOT IN (SELECT page_no FROM c1) QUALIFY row_number() OVER (PARTITION BY p.page_no ORDER BY length(i.no) DESC, ordinal) = 1),
f3 AS (SELECT scope, file, min(package) AS one, max(package) AS most FROM p WHERE role = 'CHART' AND pos > 0 AND file IS NOT NULL GROUP BY scope, file),
c3 AS MATERIALIZED (SELECT p.scope, CASE WHEN p.scope % 3 = 2 AND f3.one = f3.most AND lettered AND NOT torn THEN 'SOURCE_FILE:' || file WHEN p.scope % 3 = 2 AND lettered AND NOT torn THEN chart ELSE key END AS key, 3 AS stage, page_no AS ordinal, page_no, CASE WHEN torn THEN chart[1:11] ELSE chart END AS no, 0 AS t, name, role
  FROM p LEFT JOIN f3 USING (scope, file) WHERE role = 'CHART' AND q = 0 AND pos > 0 AND page_no NOT IN (SELECT page_no FROM c1 UNION ALL SELECT page_no FROM c2)),
mk AS (SELECT scope, key, 1 AS stage, min(ordinal) AS first_at FROM i GROUP BY ALL UNION ALL SELECT scope, key, 2, min(page_no) FROM c3 WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.scope = c3.scope AND i.key = c3.key) GROUP BY ALL),
ma AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY stage, first_at, key) AS package_no FROM mk),
fi AS (SELECT scope, key, package, category, nav, rw, name, CASE WHEN t = 0 THEN no END AS chart_no FROM i QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY t > 0, ordinal) = 1
  UNION ALL SELECT c3.scope, c3.key, package, category, nav, rw, p.name, c3.no FROM c3 JOIN p USING (page_no) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.scope = c3.scope AND i.key = c3.key) QUALIFY row_number() OVER (PARTITION BY c3.scope, c3.key ORDER BY page_no) = 1),
m AS MATERIALIZED (SELECT ma.*, package, category, nav, rw, name, chart_no FROM ma JOIN fi USING (scope, key)),
c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
sd AS (SELECT c.scope, c.key, arg_min(c.page_no, (c.stage, CASE WHEN c.stage = 1 THEN c.ordinal ELSE 0 END, c.page_no)) AS seed FROM c WHERE role = 'CHART' AND t = 0 GROUP BY ALL),
c4 AS (SELECT p.scope, m.key, 4 AS stage, p.page_no AS ordinal, p.page_no, p.number AS no, 1 AS t, p.name, p.role, m.package_no
  FROM sd JOIN m USING (scope, key) JOIN p s ON s.page_no = seed JOIN p ON p.scope = sd.scope AND p.page_no BETWEEN seed + 1 AND seed + 3 AND p.role IN ('TABULAR_DESCRIPTION', 'WAYPOINT_COORDINATES', 'MINIMA_TABLE') AND p.category = m.category AND p.rw = m.rw AND p.nav = m.nav
    AND (s.number IS NULL OR starts_with(p.number, s.number) AND regexp_matches(p.number[length(s.number) + 1:], '^[-.][0-9]{{1,2}}$') OR NOT p.lettered AND p.page_no - s.page_no BETWEEN 1 AND 3)
  WHERE p.page_no NOT IN (SELECT page_no FROM c) QUALIFY row_number() OVER (PARTITION BY p.page_no ORDER BY m.package_no) = 1),
al AS MATERIALIZED (SELECT * FROM c UNION ALL SELECT * EXCLUDE package_no FROM c4),
pa AS (SELECT *, role = 'WAYPOINT_COORDINATES' OR (t >= 2 AND key NOT LIKE 'APPROACH%') AS co, row_number() OVER (PARTITION BY scope, key ORDER BY stage, CASE WHEN stage = 1 THEN ordinal ELSE 0 END, page_no) AS nth FROM al),
pt AS (SELECT *, t > 0 OR role = 'TABULAR_DESCRIPTION' OR co AS tab, NOT co AND ((role = 'CHART' AND t = 0) OR (role <> 'MINIMA_TABLE' AND NOT (t > 0 OR role = 'TABULAR_DESCRIPTION'))) AS ch, NOT co AND role = 'MINIMA_TABLE' AS mi FROM pa),
g AS (SELECT scope, key, string_agg(DISTINCT page_no::VARCHAR, ',' ORDER BY page_no::VARCHAR) FILTER (ch) AS charts, string_agg(DISTINCT page_no::VARCHAR, ',' ORDER BY page_no::VARCHAR) FILTER (tab) AS tables, string_agg(DISTINCT page_no::VARCHAR, ',' ORDER BY page_no::VARCHAR) FILTER (co) AS coordinates,
    string_agg(DISTINCT page_no::VARCHAR, ',' ORDER BY page_no::VARCHAR) FILTER (mi) AS minima, arg_min(page_no, nth) FILTER (ch) AS chart_page, bool_or(stage IN (2, 4)) AS odd, list(no ORDER BY nth) AS nos FROM pt GROUP BY ALL),
pc AS (SELECT scope, number, count(*) AS n FROM p WHERE number IS NOT NULL GROUP BY ALL),
it AS (SELECT i.scope, i.key, list(no ORDER BY i.ordinal) AS nos, bool_or(n > 1 OR NOT EXISTS (SELECT 1 FROM c1 WHERE c1.scope = i.scope AND c1.ordinal = i.ordinal)) AS doubt,
    string_agg(no, ',' ORDER BY i.ordinal) FILTER (NOT EXISTS (SELECT 1 FROM c1 WHERE c1.scope = i.scope AND c1.ordinal = i.ordinal) AND NOT EXISTS (SELECT 1 FROM c2 WHERE c2.scope = i.scope AND c2.no = i.no)) AS unmatched FROM i LEFT JOIN pc ON pc.scope = i.scope AND pc.number = i.no GROUP BY ALL)
"""


@query("grouped_packages", GROUPED + """
SELECT m.scope, package_no, m.key, CASE WHEN package = 'APPROACH' THEN name ELSE rw || ' ' || nav || ' ' || package || ' ' || name END AS first_name, coalesce(m.chart_no, it.nos[1], g.nos[1]) AS chart_no, chart_page, coalesce(charts, '') AS charts, coalesce(tables, '') AS tables, coalesce(coordinates, '') AS coordinates, coalesce(minima, '') AS minima,
  coalesce(unmatched, '') AS unmatched, CASE WHEN m.stage = 1 THEN 'INDEX' ELSE 'HEADER' END AS source, m.stage = 2 OR coalesce(doubt, false) OR coalesce(odd, false) OR charts IS NULL AS review
FROM m LEFT JOIN g USING (scope, key) LEFT JOIN it USING (scope, key)""")
def grouped_packages(spark, sf_dir):
    """Packages of all publications; pages of a package in the order of their digits."""
    found, _ = packages.group_pages(*publications(spark, sf_dir), ["scope"])
    listed = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",")
    first = packages.package_name(F.col("package"), F.col("navigation"), F.col("runway"), F.slice("names", 1, 1))
    return found.select("scope", F.col("package_no").cast("long").alias("package_no"), "key", first.alias("first_name"), "chart_no", "chart_page", listed("chart_pages").alias("charts"), listed("tabular_pages").alias("tables"), listed("coordinate_pages").alias("coordinates"), listed("minima_pages").alias("minima"), F.array_join("unmatched", ",").alias("unmatched"), "source", "review")


@query("page_claims", GROUPED + """SELECT scope, page_no, package_no, CASE stage WHEN 1 THEN 'INDEX' WHEN 2 THEN 'FRAGMENT' WHEN 3 THEN 'HEADER' ELSE 'SEQUENCE' END AS stage, ch AS chart, tab AS tabular, co AS coordinate, mi AS minima FROM (SELECT pt.*, m.package_no FROM pt JOIN m USING (scope, key))""")
def page_claims(spark, sf_dir):
    """Which package claims a page, by what stage, and for which of its lists."""
    pages, items = publications(spark, sf_dir)
    claims = packages.group_pages(pages, items, ["scope"])[1]
    return claims.select("scope", "page_no", F.col("package_no").cast("long").alias("package_no"), "stage", "chart", "tabular", "coordinate", "minima")

