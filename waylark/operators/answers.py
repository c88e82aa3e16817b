"""Answers about one thing that come in batches: colliding evidence renamed at every depth, arrays merged by key, variants that others cover left out.

An answer is a nested row. Ids are rewritten by an expression that follows the row's own
schema, through structs and arrays of any depth, from a map that a fold over the
evidence of both answers makes. Nothing is exploded or shuffled but to bring the two
answers together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

#: Fields that hold an id of their own, one of evidence, or several; and the confidence at or under which a procedure without legs is a placeholder.
OWN_ID, EVIDENCE_ID, EVIDENCE_IDS, WEAK = ("id",), ("evidence_id", "source_evidence_id"), ("source_evidence_ids",), 0.5

LEG = "struct<sequence: int, path_terminator: string, fix: string, source_evidence_id: string>"
ANSWER = f"""airport string, package string, category string, navigation string, runway string, names array<string>,
procedures array<struct<name: string, runway: string, transition: string, confidence: double, source_evidence_ids: array<string>, legs: array<{LEG}>>>,
table_legs array<struct<name: string, sequence: int, fix: string, evidence_id: string>>,
fixes array<struct<identifier: string, lon: double, lat: double, raw: string, source_evidence_id: string>>,
evidence array<struct<id: string, page: int, text: string>>,
warnings array<struct<message: string, evidence_id: string>>, confidence double, review boolean"""


def key(text: Column) -> Column:
    return F.upper(F.trim(F.coalesce(text.cast("string"), F.lit(""))))


def replacements(existing: Column, incoming: Column) -> Column:
    """Pairs (id, new) for each id of ``incoming`` (arrays of ids) that ``existing`` has too: batch_n_id, n counting up and passing over names that are taken. Ids of incoming that repeat are counted each time, and the last name holds."""
    taken = F.filter(incoming, lambda i: (F.coalesce(i, F.lit("")) != ""))

    def step(a: Column, i: Column) -> Column:
        name = lambda n: F.concat(F.lit("batch_"), n.cast("string"), F.lit("_"), i)
        free = F.filter(F.sequence(a["n"], a["n"] + F.size(a["used"])), lambda n: ~F.array_contains(a["used"], name(n)))
        n = F.get(free, F.lit(0))
        renamed = F.transform(F.array(n), lambda x: F.struct((x + 1).alias("n"), F.concat(a["used"], F.array(name(x))).alias("used"), F.concat(a["pairs"], F.array(F.struct(i.alias("id"), name(x).alias("new")))).alias("pairs")))
        return F.when(F.array_contains(a["used"], i), F.get(renamed, F.lit(0))).otherwise(a)

    start = F.struct(F.lit(1).alias("n"), F.transform(existing, lambda i: F.coalesce(i, F.lit(""))).alias("used"), F.array().cast("array<struct<id: string, new: string>>").alias("pairs"))
    return F.aggregate(taken, start, step)["pairs"]


def _renamed(value: Column, pairs: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["id"] == value), F.lit(-1))["new"], value)


def rewritten(value: Column, kind: DataType, pairs: Column, name: str = "") -> Column:
    """``value`` with ids renamed wherever its type has a field that holds some; a field of another type under such a name is left as it is."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[rewritten(value[f.name], f.dataType, pairs, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        inner = EVIDENCE_ID[0] if name in EVIDENCE_IDS else ""
        return F.transform(value, lambda x: rewritten(x, kind.elementType, pairs, inner)) if _holds_ids(kind.elementType, inner) else value
    return _renamed(value, pairs) if isinstance(kind, StringType) and name in OWN_ID + EVIDENCE_ID else value


def _holds_ids(kind: DataType, name: str) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_ids(f.dataType, f.name) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _holds_ids(kind.elementType, EVIDENCE_ID[0] if name in EVIDENCE_IDS else "")
    return isinstance(kind, StringType) and name in OWN_ID + EVIDENCE_ID


# ---------------------------------------------------------------- keys of variants


def family(name: Column) -> Column:
    """The name without a transition, a runway and its kind at the end."""
    out = F.regexp_replace(key(name), r"\s*/\s*[A-Z0-9 -]+\s+TRANSITION$", "")
    out = F.regexp_replace(out, r"\s+RWY?\s*\d{2}[LRCB]?(?:\s*/\s*(?:RWY?\s*)?\d{2}[LRCB]?)*$", "")
    return F.trim(F.regexp_replace(out, r"\s+(?:DEPARTURE|ARRIVAL)$", ""))


def runway_variant(runway: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key(runway), r"\s+", ""), "RWY?", "")


def runway_of_name(name: Column) -> Column:
    return runway_variant(F.regexp_extract(key(name), r"RWY?\s*\d{2}[LRCB]?(?:\s*/\s*(?:RWY?\s*)?\d{2}[LRCB]?)*$", 0))


def transition_of_name(name: Column) -> Column:
    return F.substring(F.trim(F.regexp_extract(key(name), r"/\s*([A-Z0-9 -]+)\s+TRANSITION$", 1)), 1, 5)


# ---------------------------------------------------------------- merging arrays


def merged_by_key(existing: Column, incoming: Column, key_of: Callable[[Column], Column], combine: Callable[[Column, Column], Column] | None = None) -> Column:
    """Items in the order in which their keys are first seen; of one key the last, or with ``combine`` the last of existing with each of incoming laid over it."""
    tagged = lambda items, side: F.transform(F.coalesce(items, F.slice(items, 1, 0)), lambda x: F.struct(key_of(x).alias("k"), F.lit(side).alias("s"), x.alias("x")))
    both = F.concat(F.coalesce(tagged(existing, 0), F.filter(tagged(incoming, 0), lambda x: F.lit(False))), F.coalesce(tagged(incoming, 1), F.filter(tagged(existing, 1), lambda x: F.lit(False))))

    def settled(k: Column, every: Column) -> Column:
        own = F.filter(every, lambda t: t["k"] == k)
        if combine is None:
            return F.element_at(own, -1)["x"]
        base = F.try_element_at(F.filter(own, lambda t: t["s"] == 0), F.lit(-1))
        over = F.filter(own, lambda t: t["s"] == 1)
        first = F.coalesce(base, F.get(over, F.lit(0)))["x"]
        return F.aggregate(F.when(base.isNotNull(), over).otherwise(F.slice(over, F.lit(2), F.size(over))), first, lambda a, t: combine(a, t["x"]))

    # the items go along with each key, as what a lambda captures is evaluated for each element
    each = F.get(F.transform(F.array(both), lambda every: F.transform(F.array_distinct(F.transform(every, lambda t: t["k"])), lambda k: settled(k, every))), F.lit(0))
    return F.coalesce(each, existing, incoming)


def laid_over(kind: StructType) -> Callable[[Column, Column], Column]:
    """Field by field the new value, or the old one where the new is null or an empty text."""
    fresh = lambda x, f: F.nullif(x[f.name], F.lit("")) if isinstance(f.dataType, StringType) else x[f.name]
    return lambda old, new: F.struct(*[F.coalesce(fresh(new, f), old[f.name]).alias(f.name) for f in kind.fields])


def distinct(existing: Column, incoming: Column) -> Column:
    return F.coalesce(F.array_distinct(F.concat(existing, incoming)), existing, incoming)


def uncovered(items: Column, family_of: Callable[[Column], Column], runway_of: Callable[[Column], Column]) -> Column:
    """Items without those of a single runway of which another item of their family has several that include it."""
    wide = F.flatten(F.transform(F.filter(items, lambda x: runway_of(x).contains("/")), lambda x: F.transform(F.filter(F.split(runway_of(x), "/"), lambda m: m != ""), lambda m: F.concat_ws("|", family_of(x), m))))
    kept = lambda covered: F.filter(items, lambda x: (runway_of(x) == "") | runway_of(x).contains("/") | ~F.array_contains(covered, F.concat_ws("|", family_of(x), runway_of(x))))
    return F.when(F.exists(items, lambda x: runway_of(x).contains("/")), F.get(F.transform(F.array(wide), kept), F.lit(0))).otherwise(items)


def merge_answers(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ANSWER) of both answers of each key; one alone comes out unchanged.

    Evidence ids of the incoming answer that the existing one has are renamed batch_n_id
    wherever they stand. Scalars are the incoming's, or the existing's where that is
    null; procedures, table legs and evidence merge by key, the later in place of the
    earlier; fixes field by field; names and warnings are joined without repeats. A
    procedure without legs and of weak confidence goes if any has legs; one of a single
    runway goes if the same of several runways is there. Confidence is the mean of both.
    Keys are unique on each side, and null keys meet nothing.
    """
    schema = existing.select(*[F.col(c.strip().split(" ")[0]) for c in _top(ANSWER)]).schema
    nested = lambda d, name: d.select(*keys, F.struct(*schema.names).alias(name))
    df = nested(existing, "e").join(nested(incoming, "i"), list(keys), "full_outer")
    ids = lambda side: F.coalesce(F.transform(f"{side}.evidence", lambda x: x["id"]), F.array().cast("array<string>"))
    df = df.withColumn("_pairs", replacements(ids("e"), ids("i")))
    # an array of pairs, not a map, as ids may repeat; most answers have none and stay as they are
    df = df.withColumn("i", F.when(F.size("_pairs") > 0, rewritten(F.col("i"), schema, F.col("_pairs"))).otherwise(F.col("i")))
    e, i = lambda f: F.col(f"e.{f}"), lambda f: F.col(f"i.{f}")
    scalar = lambda f: F.coalesce(i(f), e(f)).alias(f)
    procedure = lambda x: F.concat_ws("|", family(x["name"]), runway_variant(x["runway"]), F.substring(key(x["transition"]), 1, 5))
    row = lambda x: F.concat_ws("|", family(x["name"]), runway_of_name(x["name"]), transition_of_name(x["name"]), F.coalesce(x["sequence"].cast("string"), F.lit("")))
    df = df.withColumn("_p", merged_by_key(e("procedures"), i("procedures"), procedure)).withColumn("_t", merged_by_key(e("table_legs"), i("table_legs"), row))
    legs = lambda x: F.coalesce(F.size(x["legs"]), F.lit(0)) > 0
    df = df.withColumn("_p", F.when(F.exists("_p", legs), F.filter("_p", lambda x: legs(x) | (F.coalesce(x["confidence"], F.lit(0.0)) > WEAK))).otherwise(F.col("_p")))
    df = df.withColumn("_p", F.transform("_p", lambda x: x.withField("transition", F.trim(F.regexp_replace(x["transition"], r"(?i)\s+TRANSITION$", "")))))
    df = df.withColumn("_p", uncovered(F.col("_p"), lambda x: family(x["name"]), lambda x: runway_variant(x["runway"])))
    df = df.withColumn("_t", uncovered(F.col("_t"), lambda x: family(x["name"]), lambda x: runway_of_name(x["name"])))
    fix = schema["fixes"].dataType.elementType
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    both = df.select(
        *keys, *[scalar(f) for f in ("airport", "package", "category", "navigation", "runway")], clean(distinct(e("names"), i("names"))).alias("names"), F.col("_p").alias("procedures"), F.col("_t").alias("table_legs"),
        merged_by_key(e("fixes"), i("fixes"), lambda x: key(x["identifier"]), laid_over(fix)).alias("fixes"), merged_by_key(e("evidence"), i("evidence"), lambda x: key(x["id"])).alias("evidence"), distinct(e("warnings"), i("warnings")).alias("warnings"),
        F.coalesce((e("confidence") + i("confidence")) / 2, i("confidence"), e("confidence")).alias("confidence"), (F.coalesce(e("review"), F.lit(False)) | F.coalesce(i("review"), F.lit(False))).alias("review"), F.col("e").isNotNull().alias("_e"), F.col("i").isNotNull().alias("_i"), "e", "i",
    )
    one = lambda f: F.when(F.col("_e") & F.col("_i"), F.col(f)).when(F.col("_e"), F.col(f"e.{f}")).otherwise(F.col(f"i.{f}")).alias(f)
    return both.select(*keys, *[one(f) for f in schema.names])


def _top(ddl: str) -> list[str]:
    """The fields of a DDL string, nested ones whole."""
    out, depth = [""], 0
    for c in ddl.replace("\n", " "):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out

