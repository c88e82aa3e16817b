"""Support pages: what a page of each kind says, and which of them a package needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions import text as tx

_COORDINATES = r"(?i)\b\d{6}(?:\.\d+)?[NS]\s+\d{7}(?:\.\d+)?[EW]\b"
#: The fields of a page by its kind, as (field, pattern, group, how many at most; 1 for the first match only).
FIELDS: dict[str, list[tuple[str, str, int, int | None]]] = {
    "AIRPORT_METADATA": [
        ("icao", r"\b[A-Z]{4}\b", 0, 1),
        ("name", r"(?i)AD\s*2\.?1[^A-Z0-9]+.*?\b([A-Z]{4}\s*-\s*[^0-9]+?)(?:\s+[A-Z]{4}\s+AD\s*2\.?2|\s+WM[A-Z]{2}\s+AD\s*2\.?2)", 1, 1),
        ("arp", r"(?i)\b\d{6}[NS]\s+\d{7}[EW]\b", 0, 1),
        ("elevation", r"(?i)Elevation/Reference temperature\s+([^/]+(?:FT|M))", 1, 1),
        ("magnetic_variation", r"(?i)Magnetic variation[^0-9NSWE]*(\d+[^,;.]+)", 1, 1),
        ("traffic", r"(?i)Types of traffic permitted[^A-Z0-9]*(.{0,120})", 1, 1),
    ],
    "RUNWAY_DATA": [
        ("bearings", r"\b\d{3}\.?\d*°", 0, None),
        ("dimensions", r"\b\d{3,4}\s*[xX]\s*\d{2,3}\s*M\b", 0, None),
        ("surfaces", r"(?i)\b(?:ASPHALT|CONCRETE|BITUMEN|GRASS)\b", 0, None),
        ("strengths", r"(?i)\b(?:PCR|PCN)\s*[^ ]+(?:\s*/\s*[^ ]+){3,4}", 0, None),
        ("coordinates", _COORDINATES, 0, None),
        ("elevations", r"(?i)\b\d+(?:\.\d+)?\s*(?:FT|M)\b", 0, 20),
    ],
    "RUNWAY_OPERATIONAL_DATA": [
        ("distances", r"(?i)\b\d{2}[LRC]?\s+(?:THRESHOLD|TWY\s+[A-Z])\s+\d+\s+\d+\s+\d+\s+(?:\d+|-)", 0, None),
        ("lighting", r"(?i)\b(?:APPROACH LIGHTING|PAPI|RUNWAY LIGHTS?|RUNWAY END LIGHTS?|THR lights?|edge lights?)[^.;]{0,100}", 0, None),
    ],
    "AIRSPACE_COMMUNICATION": [
        ("airspace", r"(?i)\b(?:CTR|TMA)\b[^.;]{0,180}", 0, None),
        ("transition_altitude", r"(?i)TRANSITION ALTITUDE[^0-9]*(\d+\s*FT|\d+)", 1, 1),
        ("frequencies", r"(?i)\b(?:APP|TWR|SMC|ATIS|RADAR|GROUND)\b[^.;\n]{0,100}?\d{3}\.\d{1,3}\s*MHz?", 0, None),
        ("callsigns", r"(?i)\b[A-Z][A-Z ]{1,40}?\s(?:APPROACH|TOWER|GROUND|ATIS)\b", 0, None),
    ],
    "NAVAID": [
        ("navaids", r"(?i)\b(?:ILS|LOC|GP/DME|DME|NDB|VOR/DME|VOR)\b[^.;]{0,160}", 0, None),
        ("idents", r"\b[A-Z]{2,4}\b", 0, 40),
        ("frequencies", r"(?i)\b\d{3}\.\d{1,3}\s*MHZ|\b\d{3,4}\s*KHZ", 0, None),
        ("channels", r"(?i)\bCH\s*\d+[XY]\b", 0, None),
        ("coordinates", _COORDINATES, 0, None),
        ("elevations", r"(?i)\bDME[^.;]{0,80}\b\d+(?:\.\d+)?\s*(?:FT|M)\b", 0, None),
    ],
    "FLIGHT_PROCEDURES": [
        ("dme_arrivals", r"(?i)DME Arrival Procedures[^.]*\.", 0, None),
        ("radials", r"\bR-\d{3}/\d{3}°|\b\d{3}°", 0, 30),
        ("navaids", r"\b[A-Z]{2,3}\s+(?:VOR/DME|VOR|DME|NDB)\b|\b(?:VOR/DME|VOR|DME|NDB)\b(?:\s+[A-Z]{2,3}\b)?", 0, None),
        ("minimum_altitudes", r"(?i)\b\d{4,5}\s*FT\b", 0, None),
        ("remarks", r"(?i)(?:REMARKS|Note:)[^.;]{0,220}", 0, None),
        ("level_restrictions", r"(?i)\bcross[^.;]{0,120}\b\d{4,5}\s*FT[^.;]*", 0, None),
    ],
}
#: Capitals that are no identifiers, and the letters of a page that its sample has.
NO_IDENTS = ["AIP", "AD", "NIL", "RWY"]
SAMPLE = {"RUNWAY_DATA": 1200, "RUNWAY_OPERATIONAL_DATA": 1200, "AIRSPACE_COMMUNICATION": 1200, "NAVAID": 1400, "FLIGHT_PROCEDURES": 1200}
SAMPLE_OTHER = 900
#: The name under which a package refers to pages of a kind; kinds without one are not referred to.
REFERENCE_KEYS = {
    "AIRPORT_METADATA": "airportMetadata",
    "RUNWAY_DATA": "runwayData",
    "RUNWAY_OPERATIONAL_DATA": "runwayOperationalData",
    "AIRSPACE_COMMUNICATION": "communication",
    "NAVAID": "navaid",
    "FLIGHT_PROCEDURES": "flightProcedures",
    "CHART_INDEX": "chartIndex",
}
#: Kinds that every package wants, and those that some want besides.
WANTED = ["AIRPORT_METADATA", "RUNWAY_DATA", "AIRSPACE_COMMUNICATION", "CHART_INDEX"]
WANTED_BY_APPROACH = ["RUNWAY_OPERATIONAL_DATA", "NAVAID"]
WANTED_BY_NAVIGATION = [("DME_ARC|CONVENTIONAL|VOR|NDB", ["NAVAID", "FLIGHT_PROCEDURES"]), ("ILS|LOC", ["NAVAID", "RUNWAY_OPERATIONAL_DATA"])]


def _found(text: Column, field: str, pattern: str, group: int, most: int | None) -> Column:
    pattern = tx.ascii_bounds(pattern)
    if most == 1:
        return F.array_compact(F.array(F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))))
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.trim(v)))
    if field == "idents":
        found = F.filter(found, lambda v: ~v.isin(NO_IDENTS))
    return found if most is None else F.slice(found, 1, most)


def runways(text: Column, numbers: Sequence[str]) -> Column:
    """Designators of some runways, each once; with RWY where the text has it."""
    found = F.regexp_extract_all(text, F.lit(tx.ascii_bounds(rf"\b(?:RWY\s*)?(?:{'|'.join(numbers)})\b")), F.lit(0))
    return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, r"^RWY\s*", "RWY")))


def support_fields(pages: DataFrame, kind: str = "support", text: str = "text", runway_numbers: Sequence[str] = ("16", "34")) -> DataFrame:
    """A row (other columns, kind, field, values) for each field that a support page has, its sample too.

    Whole texts are searched, with white space squeezed; a page without a kind gives no
    rows, a null text counts as empty. Values are in order of first occurrence, each once.
    """
    squeezed = pages.where(F.col(kind).isNotNull()).withColumn(text, F.coalesce(tx.squeezed(F.col(text)), F.lit("")))
    t = F.col(text)

    def row(field: str, values: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), values.alias("values"))

    length = F.lit(SAMPLE_OTHER)
    for name, n in SAMPLE.items():
        length = F.when(F.col(kind) == name, n).otherwise(length)
    sample = F.array(row("sample", F.array(F.substring(t, F.lit(1), length))))
    fields = None
    for name, rules in FIELDS.items():
        rows = [row(field, _found(t, field, pattern, group, most)) for field, pattern, group, most in rules]
        if name == "RUNWAY_DATA":
            rows.append(row("runways", runways(t, runway_numbers)))
        hit = F.col(kind) == name
        fields = F.when(hit, F.array(*rows)) if fields is None else fields.when(hit, F.array(*rows))
    keep = [c for c in pages.columns if c != text]
    found = squeezed.select(*keep, F.explode(F.concat(F.coalesce(fields, F.array().cast("array<struct<field:string,values:array<string>>>")), sample)).alias("f"))
    return found.select(*keep, "f.field", "f.values").where(F.size("values") > 0)


def wanted_kinds(package: Column, category: Column, navigation: Column) -> Column:
    """The kinds of support pages that a package wants, each once."""
    names = lambda test, kinds: F.when(test, F.array(*map(F.lit, kinds))).otherwise(F.array().cast("array<string>"))
    more = [names(F.coalesce((package == "APPROACH") | (category == "APPROACH"), F.lit(False)), WANTED_BY_APPROACH)]
    more += [names(F.coalesce(navigation.rlike(p), F.lit(False)), kinds) for p, kinds in WANTED_BY_NAVIGATION]
    return F.array_distinct(F.concat(F.array(*map(F.lit, WANTED)), *more))


def package_references(packages: DataFrame, pages: DataFrame, by: Sequence[str], package_id: str = "package_id", kind: str = "support", page_no: str = "page_no") -> DataFrame:
    """(package_id, key, pages): of each package (package, category, navigation and the columns of ``by``) the pages of its file that it refers to, in order, each once.

    Pages without a kind, and kinds without a key, give nothing; a package without
    pages gives no row.
    """
    keys = F.create_map(*[F.lit(x) for kv in REFERENCE_KEYS.items() for x in kv])
    wants = packages.select(package_id, *by, F.explode(wanted_kinds(F.col("package"), F.col("category"), F.col("navigation"))).alias(kind))
    named = pages.select(*by, kind, page_no).where(F.col(kind).isin(list(REFERENCE_KEYS))).distinct()
    return wants.join(named, [*by, kind]).groupBy(package_id, F.element_at(keys, F.col(kind)).alias("key")).agg(F.array_sort(F.collect_list(page_no)).alias("pages"))
