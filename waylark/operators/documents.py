"""JSON documents of any shape as VARIANT: a walk of their texts, and their typing by a table of rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: How deep texts are looked for, and the keys whose values are passed over.
DEEPEST, PASSED_OVER = 5, r"(?i)rawResponse|parsedJson|geojson"


def collected_texts(docs: DataFrame, keys: Sequence[str], doc: str, deepest: int = DEEPEST, passed_over: str = PASSED_OVER) -> DataFrame:
    """(keys, path, text): the texts with a letter or digit in each JSON document, level by level, to a depth of ``deepest``.

    ``path`` is the place of each level, from 0, in arrays by position and in objects by
    key in alphabetical order, which is how VARIANT keeps them; it sorts as the document
    is read. Values under keys that match ``passed_over`` aren't looked into. Numbers,
    booleans and nulls are no texts; a document that can't be read, or is null, has none.
    Each level is a generator over the one before, which passes scalars on, so that a
    document is read once.
    """
    found = docs.select(*keys, F.try_parse_json(F.col(doc)).alias("v"), F.array().cast("array<int>").alias("path")).where("v is not null")
    for _ in range(deepest):
        inner = found.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("_pos", "_key", "_value")).where(F.col("_key").isNull() | ~F.col("_key").rlike(passed_over))
        below = F.col("_pos").isNotNull()
        found = inner.select(*keys, F.when(below, F.col("_value")).otherwise(F.col("v")).alias("v"), F.when(below, F.concat("path", F.array("_pos"))).otherwise(F.col("path")).alias("path"))
    texts = found.where(F.schema_of_variant("v") == "STRING").select(*keys, "path", F.try_variant_get("v", "$", "string").alias("text"))
    return texts.where(F.col("text").rlike("[A-Za-z0-9]"))


# ---------------------------------------------------------------- typing


@dataclass(frozen=True)
class Rule:
    """How a field is typed: ``kind`` is text, number, integer (from 1), boolean, texts or numbers (arrays), or a pattern of allowed values; the first of ``paths`` that gives one counts, else ``otherwise``."""

    name: str
    kind: str
    paths: tuple[str, ...]
    otherwise: object = None


TYPES = {"text": "string", "number": "double", "integer": "int", "boolean": "boolean", "texts": "array<string>", "numbers": "array<int>"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; within lambdas Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _read(at: Column, rule: Rule) -> Column:
    """What a rule needs of the value at a path, null where nothing stands there: its kind and its text, and a number's value."""
    text = F.try_variant_get(at, "$", "string")
    parts = [F.schema_of_variant(at).alias("kind"), text.alias("text")]
    if rule.kind in ("number", "integer"):
        parts.append(text.try_cast("double").alias("number"))
    if rule.kind in ("boolean", "texts", "numbers"):
        parts[1] = at.alias("at")
    return F.when(at.isNotNull(), F.struct(*parts))


def _typed(x: Column, rule: Rule) -> Column:
    """The value of what ``_read`` gives if it is of the kind; texts of digits are numbers too, as a model may quote them."""
    kind = x["kind"]
    if rule.kind == "text":
        return F.when(kind == "STRING", x["text"])
    if rule.kind in ("number", "integer"):
        plain = ~kind.rlike("^(BOOLEAN|VOID|ARRAY|OBJECT)")
        if rule.kind == "number":
            return F.when(plain, x["number"])
        return F.when(plain & (x["number"] == F.floor(x["number"])) & (x["number"] >= 1), x["number"].cast("int"))
    if rule.kind == "boolean":
        return F.when(kind == "BOOLEAN", F.try_variant_get(x["at"], "$", "boolean"))
    if rule.kind in ("texts", "numbers"):
        each = F.try_variant_get(x["at"], "$", "array<variant>")
        texts = F.filter(F.transform(each, lambda y: F.when(F.schema_of_variant(y) == "STRING", F.try_variant_get(y, "$", "string"))), lambda y: y.isNotNull())
        whole = F.filter(F.transform(each, lambda y: F.try_variant_get(y, "$", "string").try_cast("double")), lambda y: y.isNotNull() & (y == F.floor(y)))
        return texts if rule.kind == "texts" else F.transform(whole, lambda y: y.cast("int"))
    return F.when((kind == "STRING") & x["text"].rlike(f"^(?:{rule.kind})$"), x["text"])


def typed(v: Column, rules: Sequence[Rule]) -> Column:
    """struct(x: the fields, r: array of repairs) of a VARIANT: a repair names a field that stands under its first path but couldn't be used as it is, or was taken from another path. Each path is looked up once, and what stands there is read once."""
    paths = lambda r: [f"v{i}" for i in range(len(r.paths))]
    looked = F.struct(*[F.struct(*[F.try_variant_get(v, p, "variant").alias(n) for n, p in zip(paths(r), r.paths)]).alias(r.name) for r in rules])
    read = lambda s: F.struct(*[F.struct(*[_read(s[r.name][n], r).alias(n) for n in paths(r)]).alias(r.name) for r in rules])
    values = lambda s: F.struct(*[F.struct(*[_typed(s[r.name][n], r).alias(n) for n in paths(r)], F.coalesce(s[r.name]["v0"]["kind"] != "VOID", F.lit(False)).alias("there")).alias(r.name) for r in rules])

    def settled(s: Column) -> Column:
        fields, repairs = [], []
        for r in rules:
            values = [s[r.name][n] for n in paths(r)]
            kind = TYPES.get(r.kind, "string")
            default = F.array(*map(F.lit, r.otherwise)).cast(kind) if isinstance(r.otherwise, tuple) else F.lit(r.otherwise).cast(kind)
            fields.append(F.coalesce(*values, default).alias(r.name))
            other = reduce(lambda a, b: a | b, (x.isNotNull() for x in values[1:]), F.lit(False))
            repairs.append(F.when(values[0].isNull(), F.when(s[r.name]["there"], F.lit(f"{r.name}: unusable")).when(other, F.lit(f"{r.name}: from another field"))))
        return F.struct(F.struct(*fields).alias("x"), F.array_compact(F.array(*repairs)).alias("r"))

    return let(looked, lambda s: let(read(s), lambda t: let(values(t), settled)))


def _of(*paths: str) -> tuple[str, ...]:
    return tuple(f"$.{p}" for p in paths)


#: The fields of an answer, where each may stand, and what stands for it otherwise.
CONFIDENCE = Rule("confidence", "number", _of("confidence"), 0.5)
REVIEW = Rule("review", "boolean", _of("reviewRequired"), False)
HEAD = [
    Rule("airport", "text", _of("airportIcao")), Rule("airport_name", "text", _of("airportName")), Rule("package", "text", _of("packageType", "procedureClassification.packageType")), Rule("category", "text", _of("procedureCategory", "procedureClassification.procedureCategory")),
    Rule("navigation", "text", _of("navigationType", "procedureClassification.navigationType")), Rule("runway", "text", _of("runway", "procedureClassification.runway")), CONFIDENCE, REVIEW,
]
TABLE_LEG = [
    Rule("procedure", "text", _of("procedureName")), Rule("sequence", "integer", _of("sequence")), Rule("path_terminator", "text", _of("pathTerminator")), Rule("from_fix", "text", _of("fromFix")), Rule("to_fix", "text", _of("toFix", "fixIdentifier")), Rule("course_deg", "number", _of("courseDeg")),
    Rule("distance_nm", "number", _of("distanceNm")), Rule("altitude", "text", _of("altitudeConstraint")), Rule("turn", "text", _of("turnDirection")), Rule("navaid", "text", _of("recommendedNavaid")), Rule("remarks", "text", _of("remarks")), Rule("page", "integer", _of("sourcePageNo")), CONFIDENCE,
]
PROCEDURE = [Rule("name", "text", _of("procedureName")), Rule("runway", "text", _of("runway")), Rule("transition", "text", _of("transitionName")), Rule("navigation_spec", "text", _of("navigationSpec", "navSpec")), Rule("confidence", "number", _of("confidence")), REVIEW]
FIX = [
    Rule("identifier", "text", _of("identifier", "ident")), Rule("latitude", "number", _of("latitude")), Rule("longitude", "number", _of("longitude")), Rule("lat_text", "text", _of("coordinates.lat", "latitudeText", "latText")), Rule("lon_text", "text", _of("coordinates.lon", "longitudeText", "lonText")),
    Rule("raw", "text", _of("rawCoordinate")), CONFIDENCE, REVIEW,
]
EVIDENCE = [Rule("id", "text", _of("id")), Rule("page", "integer", _of("pageNo"), 1), Rule("aip_page", "text", _of("aipPageNo")), Rule("type", "text", _of("evidenceType"), "MODEL_OUTPUT"), Rule("field", "text", _of("fieldName"), "unknown"), Rule("raw", "text", _of("rawText")), CONFIDENCE]
HOLDING = [Rule("fix", "text", _of("fixIdentifier", "fix")), Rule("course_deg", "number", _of("inboundCourseDegMag", "inboundTrack")), Rule("turn", "L|R", _of("turnDirection")), CONFIDENCE, REVIEW]
WARNING = [Rule("message", "text", _of("message"), ""), Rule("pages", "numbers", _of("pageNos"), ()), Rule("field", "text", _of("fieldName")), Rule("review", "boolean", _of("reviewRequired"), True)]
ARRAYS = {"tableLegs": ("table_legs", TABLE_LEG), "procedures": ("procedures", PROCEDURE), "fixes": ("fixes", FIX), "sourceEvidence": ("evidence", EVIDENCE), "holdings": ("holdings", HOLDING), "warnings": ("warnings", WARNING)}


def _entry(rules: Sequence[Rule]) -> Callable[[Column], Column]:
    return lambda x: typed(x, rules)


def _placed(name: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.transform(x["r"], lambda t: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]."), t))


def dms_words(text: Column) -> Column:
    """Decimal degrees of a latitude or longitude with any marks between degrees, minutes and seconds."""
    p = r"(?i)(\d+(?:\.\d+)?)\D+(\d+(?:\.\d+)?)\D+(\d+(?:\.\d+)?)\D*([NSEW])"
    g = lambda i: F.regexp_extract(text, p, i)
    value = g(1).try_cast("double") + g(2).try_cast("double") / 60 + g(3).try_cast("double") / 3600
    return F.when(F.upper(g(4)).isin("S", "W"), -value).otherwise(value)


def altitude_of_text(raw: Column) -> Column:
    """struct(kind, altitude_ft, lower_ft, upper_ft, raw) of a leg's altitude; null for an empty or missing text."""
    t = F.trim(raw)
    first = r"([+-]?)\s*(\d{3,5})"
    sign, n = F.regexp_extract(t, first, 1), F.regexp_extract(t, first, 2).try_cast("double")
    rest = F.when(n.isNotNull(), F.substring(t, F.regexp_instr(t, F.lit(first)) + F.length(F.regexp_extract(t, first, 0)), F.lit(1 << 20))).otherwise("")
    second = F.regexp_extract(rest, r"(?<![A-Za-z0-9_])(\d{3,5})(?![A-Za-z0-9_])", 1).try_cast("double")
    kind = F.when(sign == "+", "AT_OR_ABOVE").when(sign == "-", "AT_OR_BELOW")
    return F.when(F.coalesce(raw, F.lit("")) != "", F.struct(kind.alias("kind"), n.alias("altitude_ft"), F.when(sign == "+", n).alias("lower_ft"), F.coalesce(second, F.when(sign == "-", n)).alias("upper_ft"), raw.alias("raw")))


def normalized(docs: DataFrame, keys: Sequence[str], doc: str) -> DataFrame:
    """(keys, readable, HEAD's fields, evidence, table_legs, fixes, holdings, warnings, procedures with their legs, repairs) of answers in JSON text of any shape.

    A document that isn't an object has no fields and empty arrays. Entries of arrays that
    aren't objects have defaults only. Evidence without an id gets evidence_n by place. A fix
    takes its place from numbers, else from texts in degrees, minutes and seconds; (0, 0)
    is unknown. A procedure is one name among procedures and table legs, of procedures
    of one name the last; its legs are the table's of that name by sequence, and its
    confidence, where it has none, their mean. Runways of transitions are null. Nulls stay
    null in numbers. ``repairs`` tells where a field was unusable or stood elsewhere, with
    the place of its entry.
    """
    v = F.col("_v")
    df = docs.select(*keys, F.try_parse_json(F.col(doc)).alias("_v"))
    df = df.withColumn("readable", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    df = df.withColumn("_h", typed(v, HEAD)).withColumn("_head", F.col("_h.x")).withColumn("_repairs", F.col("_h.r"))
    told = ["_repairs"]
    for source, (name, rules) in ARRAYS.items():
        df = df.withColumn(f"_{name}", F.coalesce(F.try_variant_get(v, f"$.{source}", "array<variant>"), F.array().cast("array<variant>")))
        df = df.withColumn(f"_{name}", F.transform(f"_{name}", _entry(rules)))
        df = df.withColumn(f"_r_{name}", F.flatten(F.transform(f"_{name}", _placed(name)))).withColumn(name, F.transform(f"_{name}", lambda x: x["x"])).drop(f"_{name}")
        told.append(f"_r_{name}")
    df = df.withColumn("evidence", F.transform("evidence", lambda x, i: x.withField("id", F.coalesce(x["id"], F.concat(F.lit("evidence_"), (i + 1).cast("string"))))))

    def placed(x: Column) -> Column:
        lat, lon = F.coalesce(x["latitude"], dms_words(x["lat_text"])), F.coalesce(x["longitude"], dms_words(x["lon_text"]))
        zero = F.coalesce((lat == 0) & (lon == 0), F.lit(False))
        raw = F.coalesce(x["raw"], F.nullif(F.concat_ws(" ", F.nullif(x["lat_text"], F.lit("")), F.nullif(x["lon_text"], F.lit(""))), F.lit("")))
        return F.struct(x["identifier"].alias("identifier"), F.when(~zero, lat).alias("latitude"), F.when(~zero, lon).alias("longitude"), raw.alias("raw"), x["confidence"].alias("confidence"), x["review"].alias("review"))

    df = df.withColumn("fixes", F.transform("fixes", placed))
    spec = lambda rows: F.get(F.filter(F.transform(rows, lambda x: x["remarks"]), lambda t: F.coalesce(t.rlike(r"(?i)RNAV\s*\d"), F.lit(False))), F.lit(0))
    turn = lambda t: F.when(t.isin("L", "R"), t).when(t == "NONE", "STRAIGHT")
    leg = lambda x: F.struct(F.coalesce(x["sequence"], F.lit(1)).alias("sequence"), x["path_terminator"].alias("path_terminator"), x["from_fix"].alias("from_fix"), x["to_fix"].alias("fix"), x["course_deg"].alias("course_deg"), x["distance_nm"].alias("distance_nm"), turn(x["turn"]).alias("turn"), altitude_of_text(x["altitude"]).alias("altitude"), x["navaid"].alias("navaid"), F.when(x["page"].isNotNull(), F.concat(F.lit("tabular page "), x["page"].cast("string"))).otherwise("tableLegs").alias("derivation"), x["confidence"].alias("confidence"))
    names = F.array_distinct(F.filter(F.concat(F.transform("table_legs", lambda x: x["procedure"]), F.transform("procedures", lambda x: x["name"])), lambda n: F.coalesce(n, F.lit("")) != ""))
    df = df.withColumn("_all", F.struct(F.col("procedures").alias("p"), F.col("table_legs").alias("t"), spec(F.col("table_legs")).alias("spec")))
    df = df.withColumn("_named", F.transform(names, lambda n: F.struct(n.alias("n"), F.try_element_at(F.filter("procedures", lambda p: p["name"] == n), F.lit(-1)).alias("p"), F.transform(F.array_sort(F.transform(F.filter("table_legs", lambda x: x["procedure"] == n), lambda x, i: F.struct(F.coalesce(x["sequence"], F.lit(0)).alias("o"), i.alias("i"), leg(x).alias("leg")))), lambda s: s["leg"]).alias("legs"))))
    mean = lambda legs: F.when(F.size(legs) > 0, F.aggregate(legs, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(legs)).otherwise(0.5)

    def procedure(x: Column) -> Column:
        p = x["p"]
        transition = F.trim(F.regexp_replace(p["transition"], r"(?i)\s+TRANSITION$", ""))
        return F.struct(x["n"].alias("name"), F.when(F.coalesce(transition, F.lit("")) == "", p["runway"]).alias("runway"), transition.alias("transition"), p["navigation_spec"].alias("navigation_spec"), x["legs"].alias("legs"), F.coalesce(p["confidence"], mean(x["legs"])).alias("confidence"), F.coalesce(p["review"], F.lit(False)).alias("review"))

    df = df.withColumn("procedures", F.transform("_named", procedure))
    df = df.withColumn("procedures", F.transform("procedures", lambda p: p.withField("navigation_spec", F.coalesce(p["navigation_spec"], F.col("_all.spec")))))
    return df.select(*keys, "readable", "_head.*", "evidence", "table_legs", "fixes", "holdings", "warnings", "procedures", F.concat(*told).alias("repairs"))
