"""Normalising, validating and evaluating nested records: JSON text into typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions.tolerance import blank, course_linear, distance_eval

#: Fixed value: the shape of one recognised leg; what is missing or of another type becomes null.
LEG = "sequence int, path_terminator string, fix string, course_deg double, distance_nm double, altitude string, turn string, confidence double"


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else the part from its first brace to its last if that is one, else null."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), c)
    return F.coalesce(ok(text), ok(inner))


def enum_or(value: Column, allowed: Sequence[str], otherwise: str | None = None) -> Column:
    """The value in upper case if it is allowed."""
    up = F.upper(F.trim(value))
    return F.when(up.isin(list(allowed)), up).otherwise(F.lit(otherwise))


def altitude(text: Column) -> Column:
    """struct(kind, lower_ft, upper_ft) of +03500, -06000, 4000 or a pair; null for anything else. A null number stays null."""
    p = r"^([+-]?)\s*(FL)?(\d{2,5})(\s+(\d{3,5}))?$"
    t = F.upper(F.trim(text))
    first = F.regexp_extract(t, p, 3).try_cast("double") * F.when(F.regexp_extract(t, p, 2) == "FL", 100).otherwise(1)
    second = F.regexp_extract(t, p, 5).try_cast("double")
    kind = F.when(second.isNotNull(), "BETWEEN").when(F.regexp_extract(t, p, 1) == "+", "AT_OR_ABOVE").when(F.regexp_extract(t, p, 1) == "-", "AT_OR_BELOW").otherwise("AT")
    lower = F.when(second.isNotNull(), F.least(first, second)).when(kind == "AT_OR_BELOW", None).otherwise(first)
    upper = F.when(second.isNotNull(), F.greatest(first, second)).when(kind == "AT_OR_ABOVE", None).otherwise(first)
    return F.when(t.rlike(p), F.struct(kind.alias("kind"), lower.alias("lower_ft"), upper.alias("upper_ft")))


def turn_code(text: Column) -> Column:
    """L or R of a turn in words or letters; none is straight."""
    t = blank(text)
    return F.when(t.isin("L", "LEFT"), "L").when(t.isin("R", "RIGHT"), "R").when(t.isin("", "NONE", "STRAIGHT"), "STRAIGHT")


def legs_of(df: DataFrame, id_col: str, json_col: str, array: str = "legs") -> DataFrame:
    """A typed row for each leg in a JSON object's array; rows whose JSON can't be read have none."""
    fields = ",".join(x.strip().replace(" ", ": ") for x in LEG.split(","))
    parsed = F.from_json(json_object(F.col(json_col)), f"struct<{array}: array<struct<{fields}>>>")
    return df.select(id_col, F.posexplode(parsed[array]).alias("ordinal", "leg")).select(id_col, "ordinal", "leg.*")


def errors(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, in order; a null counts as failing."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def shown_errors(found: Column, most: int = 8) -> Column:
    """The first ``most`` errors and how many more there are, as one text."""
    more = F.when(F.size(found) > most, F.concat(F.lit("; and "), (F.size(found) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(found, 1, most), "; "), more)


def evaluated(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected legs with what was found: by sequence, else by a tenth of it. A field that isn't expected isn't counted.

    Both have the key, sequence, fix, path_terminator, distance_nm and course_deg.
    """
    a = actual.select(F.col(key).alias("_k"), F.col("sequence").alias("_s"), *[F.col(c).alias(f"a_{c}") for c in ("fix", "path_terminator", "distance_nm", "course_deg")])
    exact = expected.join(a, (F.col(key) == F.col("_k")) & (F.col("sequence") == F.col("_s")), "left").withColumn("_hit", F.col("_k").isNotNull())
    rest = exact.where("not _hit and sequence % 10 = 0").select(expected.columns).join(a, (F.col(key) == F.col("_k")) & (F.col("sequence") / 10 == F.col("_s")), "left")
    both = exact.where("_hit or sequence % 10 <> 0").drop("_hit").unionByName(rest)
    known = lambda c: F.col(c).isNotNull()
    return both.select(
        key, "sequence", F.col("_k").isNotNull().alias("found"),
        F.when(known("fix"), blank(F.col("fix")) == blank(F.col("a_fix"))).alias("fix_ok"),
        F.when(known("path_terminator"), blank(F.col("path_terminator")) == blank(F.col("a_path_terminator"))).alias("terminator_ok"),
        F.when(known("distance_nm"), distance_eval(F.col("distance_nm"), F.col("a_distance_nm"))).alias("distance_ok"),
        F.when(known("course_deg"), course_linear(F.col("course_deg"), F.col("a_course_deg"))).alias("course_ok"),
    )
