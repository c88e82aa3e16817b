"""Queries of support pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions import text as tx
from waylark.operators import support

from .common import pick, quoted, sql_pick, sql_rules, table

Q: dict = {}
S: dict = {}

#: Lines of support pages; a page has one of them, then a document's whole text.
LINES = [
    "WMKJ AD 2.1 AERODROME LOCATION INDICATOR AND NAME WMKJ - SENAI INTERNATIONAL WMKJ AD 2.2 GEOGRAPHICAL DATA 013826N 1034011E Elevation/Reference temperature 127 FT / 32 C Magnetic variation 0 E (2020); Types of traffic permitted: IFR/VFR",
    "AD 2.12 RUNWAY PHYSICAL CHARACTERISTICS RWY 16 160.45° 3800 x 45 M ASPHALT PCR 850 / F / B / X / T 013924.91N 1033948.87E THR 135.0 FT 34 340.45° CONCRETE 013727.9N 1034033.2E",
    "AD 2.13 DECLARED DISTANCES 16 THRESHOLD 3800 4100 3860 3800 34L TWY B 3500 3500 3500 - AD 2.14 APPROACH LIGHTING CAT I 900 M; PAPI LEFT 3 DEG; RUNWAY END LIGHTS RED",
    "AD 2.17 ATS AIRSPACE JOHOR CTR circle 10 NM; TRANSITION ALTITUDE: 11000 FT. AD 2.18 APP JOHOR APPROACH 124.7 MHZ; TWR JOHOR TOWER 118.1 MHz",
    "AD 2.19 RADIO NAVIGATION AND LANDING AIDS VOR/DME VJB 112.7 MHZ CH 74X 013959.0N 1033939.6E DME elevation 44.3 M; NDB JB 234 KHZ; ILS LOC IJB 110.9 MHZ",
    "AD 2.22 FLIGHT PROCEDURES DME Arrival Procedures via R-155/335° VJB VOR/DME. Note: cross 11 DME VJB at 2500 FT or above; 160° inbound",
    "AD 2.24 CHARTS RELATED TO AN AERODROME STANDARD DEPARTURE CHART",
    "SINGAPORE TMA HOLDING AREAS",
    "AERODROME OBSTACLE CHART",
    "LOWER AIRSPACE OF THE REGION",
    "THIS PAGE INTENTIONALLY LEFT BLANK",
]
PACKAGES = [("APPROACH", "APPROACH", "ILS_LOC"), ("STAR", "ARRIVAL", "DME_ARC"), ("SID", "DEPARTURE", "RNAV")]


def pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    text = F.concat(pick(LINES, n), F.lit("\n"), F.coalesce("text", F.lit("")))
    return d.select(n.alias("page_no"), F.floor(n / 40).cast("long").alias("file_no"), text.alias("text"), tx.support_type(F.upper(pick(LINES, n))).alias("support"))


_PAGES = f"""p AS (SELECT page_no, file_no, trim(regexp_replace(line || chr(10) || body, '[\\s\\x0B\\x{{85}}\\pZ]+', ' ', 'g')) AS t, {sql_rules('upper(line)', tx.SUPPORT_TYPES, 'NULL')} AS support
  FROM (SELECT doc_id AS page_no, CAST(doc_id // 40 AS BIGINT) AS file_no, {sql_pick(LINES, 'doc_id')} AS line, coalesce(text, '') AS body FROM documents))"""


def _field_sql(kind: str, field: str, pattern: str, group: int, most: int | None) -> str:
    if most == 1:
        return f"SELECT page_no, support, '{field}' AS field, v AS vals FROM (SELECT *, [trim(regexp_extract(t, {quoted(pattern)}, {group}))] AS v FROM p WHERE support = '{kind}') WHERE v[1] <> ''"
    # in order of first occurrence: positions of values that none before equals
    found = f"list_transform(regexp_extract_all(t, {quoted(pattern)}, {group}), lambda v: trim(v))"
    once = "list_filter(a, lambda v, i: list_position(a, v) = i" + (f" AND v NOT IN ({', '.join(map(quoted, support.NO_IDENTS))})" if field == "idents" else "") + ")"
    return f"SELECT page_no, support, '{field}' AS field, v AS vals FROM (SELECT *, {once}{f'[1:{most}]' if most else ''} AS v FROM (SELECT *, {found} AS a FROM p WHERE support = '{kind}')) WHERE len(v) > 0"


_RUNWAYS = f"SELECT page_no, support, 'runways' AS field, v AS vals FROM (SELECT *, list_filter(a, lambda v, i: list_position(a, v) = i) AS v FROM (SELECT *, list_transform(regexp_extract_all(t, '\\b(?:RWY\\s*)?(?:16|34)\\b'), lambda v: regexp_replace(v, '^RWY\\s*', 'RWY')) AS a FROM p WHERE support = 'RUNWAY_DATA')) WHERE len(v) > 0"
_SAMPLES = " ".join(f"WHEN '{k}' THEN {n}" for k, n in support.SAMPLE.items())
_ALL = " UNION ALL ".join([*(_field_sql(kind, *rule) for kind, rules in support.FIELDS.items() for rule in rules), _RUNWAYS, f"SELECT page_no, support, 'sample' AS field, [substr(t, 1, CASE support {_SAMPLES} ELSE {support.SAMPLE_OTHER} END)] AS vals FROM p WHERE support IS NOT NULL"])

S["support_fields"] = f"WITH {_PAGES} SELECT page_no, support, field, len(vals) AS n, array_to_string(vals, ' | ') AS vals FROM ({_ALL})"


def support_fields(spark, sf_dir):
    found = support.support_fields(pages(spark, sf_dir).drop("file_no"))
    return found.select("page_no", "support", "field", F.size("values").cast("long").alias("n"), F.array_join("values", " | ").alias("vals"))


S["package_references"] = f"""WITH {_PAGES},
w AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{v}')" for k, kinds in enumerate([['AIRPORT_METADATA', 'RUNWAY_DATA', 'AIRSPACE_COMMUNICATION', 'CHART_INDEX', 'RUNWAY_OPERATIONAL_DATA', 'NAVAID'], ['AIRPORT_METADATA', 'RUNWAY_DATA', 'AIRSPACE_COMMUNICATION', 'CHART_INDEX', 'NAVAID', 'FLIGHT_PROCEDURES'], ['AIRPORT_METADATA', 'RUNWAY_DATA', 'AIRSPACE_COMMUNICATION', 'CHART_INDEX']]) for v in kinds)}) t(k, support)),
n AS (SELECT * FROM (VALUES ('AIRPORT_METADATA', 'airportMetadata'), ('RUNWAY_DATA', 'runwayData'), ('RUNWAY_OPERATIONAL_DATA', 'runwayOperationalData'), ('AIRSPACE_COMMUNICATION', 'communication'), ('NAVAID', 'navaid'), ('FLIGHT_PROCEDURES', 'flightProcedures'), ('CHART_INDEX', 'chartIndex')) t(support, key))
SELECT file_no * 3 + k AS package_id, key, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS pages FROM p JOIN w USING (support) JOIN n USING (support) GROUP BY ALL"""


def package_references(spark, sf_dir):
    """Three packages for each file, an approach, an arrival and a departure, with the support pages of the file."""
    p = pages(spark, sf_dir).drop("text")
    kinds = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).alias("package"), F.lit(b).alias("category"), F.lit(c).alias("navigation")) for k, (a, b, c) in enumerate(PACKAGES)])
    packages = p.select("file_no").distinct().select("file_no", F.explode(kinds).alias("s")).select((F.col("file_no") * 3 + F.col("s.k")).alias("package_id"), "file_no", "s.package", "s.category", "s.navigation")
    return support.package_references(packages, p, ["file_no"]).select("package_id", "key", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


Q |= {"support_fields": support_fields, "package_references": package_references}
