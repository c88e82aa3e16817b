"""What the queries share: tables, page text that has something to classify, and SQL made from rule lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines as aeronautical publications have them; a page's number picks one.
PHRASES = [
    "WMKJ AD 2.24 CHARTS RELATED TO AN AERODROME",
    "STANDARD DEPARTURE CHART - ICAO RWY 16 RNAV ADLOV 1E AD 2-WMKJ-6-1",
    "STANDARD ARRIVAL CHART - ICAO RWY 34L/34R 11 DME ARC PIMOK 1J AD 2-WMKJ-6-12",
    "INSTRUMENT APPROACH CHART - ICAO ILS LOC RWY 16 OCA 500 FT AD 2-WMKJ-8-3",
    "TABULAR DESCRIPTION SEQ PATH TERM TF 160 12.5 NM +3000 FT 210 KIAS",
    "WAYPOINT COORDINATES ADLOV 013812.5N 1034015E",
    "AD 2.12 RUNWAY PHYSICAL CHARACTERISTICS RWY 16 TORA 3800",
    "THIS PAGE INTENTIONALLY LEFT BLANK",
    "AD 2.19 RADIO NAVIGATION AND LANDING AIDS VOR/DME VJB 112.7",
    "VAMOS FOUR DEPARTURE RWY 16R TATEYAMA TRANSITION",
    "RKSI AD CHART 2 - 28 - 1 STANDARD DEPARTURE CHART RNP",
    "RJTT AD2.24-SID-27",
    "AD 2-VHHH-SID-BEKOL-A RNAV (GNSS) BEKOL SID RWY 07R",
    "AD-2-WSSS-SID-1.1 TABULAR DESCRIPTION VMR 6A",
    "TMA CTR HOLDING AREAS ATIS 127.85 TWR 118.1",
    "AERODROME OBSTACLE CHART DETAILS OF LOCATION MINIMA",
    "STANDARD ARRIVAL CHART - ICAO RWY 34L RNAV PIMOK 1J AD 2-WMKJ-6-1 2",
    "STANDARD ARRIVAL CHART - ICAO RWY 34R RADAR PIMOK 1K AD 2-WMKJ-6-12 3",
]
NAMES = ["VAMOS FOUR DEPARTURE", "Tiara Two A Departure", "LARIT 1T RWY 07C", "rutas four arrival", "ADLOV 1E", "BEKOL SID", "", "PIMOK 1J RWY 16/34", "TIARA 2A", "OMKO1K", "VAMOS4", "EMTUV NINE"]
RUNWAYS = ["RWY16", "RW16B", "16L", "rwy 34 r", "RW34", "", "07C", "RW02B"]


def pick(values: Sequence[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_pick(values: Sequence[str], number: str) -> str:
    return f"(ARRAY[{', '.join(map(quoted, values))}])[CAST({number} % {len(values)} + 1 AS INT)]"


def aip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_no, file_no, text): a page for each document, some lines of a publication and then its whole text."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select(n.alias("page_no"), F.floor(n / 40).cast("long").alias("file_no"), F.concat(F.lit("AIP PAGE "), n.cast("string"), F.lit("\n  "), pick(PHRASES, n), F.lit("\n"), F.upper("lang"), F.lit(" 2 JAN 2025\n"), F.col("source"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


AIP_PAGES = f"SELECT doc_id AS page_no, CAST(doc_id // 40 AS BIGINT) AS file_no, 'AIP PAGE ' || doc_id || chr(10) || '  ' || {sql_pick(PHRASES, 'doc_id')} || chr(10) || upper(lang) || ' 2 JAN 2025' || chr(10) || source || chr(10) || coalesce(text, '') AS text FROM documents"


def sql_rules(text: str, rules, otherwise: str) -> str:
    """The CASE that ``first_rule`` makes, for SQL."""
    whens = " ".join(f"WHEN regexp_matches({text}, {quoted('|'.join(f'({p})' for p in ([ps] if isinstance(ps, str) else ps)))}) THEN {quoted(name)}" for name, ps in rules)
    return f"CASE {whens} ELSE {otherwise} END"


def sql_round(x: str, digits: int) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)}"
