"""Which source each procedure is drawn from: records where they cover it, else the model's answer.

Names that nearly agree meet by a signature, so that coverage is an equi join; records
are grouped once for all packages, and no package sees records of other scopes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylark.functions import text as tx

#: What drawn legs of records are worth, and what is said of plans.
SURE = 0.98
NO_RECORDS = "No records match this package."


def name_key(name: Column) -> Column:
    return F.upper(tx.squeezed(F.coalesce(name, F.lit(""))))


def signature(name: Column) -> Column:
    """Four letters of a fix and the designator; another name in upper case is its own signature. Null for an empty one."""
    n = name_key(name)
    parts = r"^([A-Z][A-Z0-9]{2,5})\s*(\d[A-Z])$"
    return F.when(n.rlike(parts), F.concat_ws("|", F.substring(F.regexp_extract(n, parts, 1), 1, 4), F.regexp_extract(n, parts, 2))).otherwise(F.nullif(n, F.lit("")))


def runway_key(runway: Column) -> Column:
    """RW and its number where one is read, else the text without spaces."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(runway, F.lit(""))), r"\s+", ""), "^RWY", "RW")
    return F.coalesce(F.nullif(F.regexp_extract(t, r"RW\d{2}[A-Z]?", 0), F.lit("")), t)


def record_groups(records: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, signature, name_key, runway_key, name, runway, ordinal, n_legs, legs): the records of each name and runway in order, each leg with the fix before it, and with a radial by its own angle, or, for a CI, that of the leg after.

    ``records``: scope, ordinal (unique), procedure_name, runway, sequence,
    path_terminator, fix, theta_deg, recommended_navaid and what else a leg has.
    """
    used = [c for c in records.columns if c not in (*scope, "ordinal", "procedure_name", "runway", "sequence")]
    leg = F.struct(F.col("sequence").try_cast("double").alias("sequence"), "ordinal", *used)
    named = records.withColumn("_n", name_key(F.col("procedure_name"))).withColumn("_r", runway_key(F.col("runway")))
    first = lambda c: F.min_by(c, "ordinal")
    g = named.groupBy(*scope, "_n", "_r").agg(first("procedure_name").alias("name"), first("runway").alias("runway"), F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).cast("int").alias("n_legs"), F.array_sort(F.collect_list(leg)).alias("l"))

    def drawn(x: Column, i: Column) -> Column:
        before, after = F.get("l", i - 1), F.get("l", i + 1)
        radial = F.coalesce(x["theta_deg"], F.when(F.upper(x["path_terminator"]) == "CI", after["theta_deg"]))
        navaid = F.coalesce(x["recommended_navaid"], after["recommended_navaid"])
        remark = F.when(radial.isNotNull() & (F.coalesce(navaid, F.lit("")) != ""), F.concat(F.lit("RDL"), F.lpad(F.floor(radial + 0.5).cast("string"), 3, "0"), F.lit(" "), navaid))
        return F.struct(x["sequence"].alias("sequence"), F.when(i > 0, F.nullif(before["fix"], F.lit(""))).alias("from_fix"), F.nullif(x["fix"], F.lit("")).alias("to_fix"), remark.alias("remarks"), *[x[c].alias(c) for c in used if c not in ("fix", "remarks")])

    return g.select(*scope, signature(F.col("name")).alias("signature"), F.col("_n").alias("name_key"), F.col("_r").alias("runway_key"), "name", "runway", "ordinal", "n_legs", F.transform("l", drawn).alias("legs"))


def render_plan(packages: DataFrame, procedures: DataFrame, records: DataFrame, scope: Sequence[str], package: str, shown: Callable[[Column], Column] = lambda legs: legs) -> tuple[DataFrame, DataFrame]:
    """(plans, parts) of each package.

    ``packages``: scope, package, runway, names, mode (AUTO, JEPPESEN_424, AI; null is
    AUTO). ``procedures``: scope, package, ordinal, name, runway, confidence, n_legs.
    ``parts``: scope, package, position, name, runway, source, confidence, n_legs, legs
    (null for the model's own). A package's runway, where it has one, must be the
    record's. A procedure takes the first group of its signature; groups that none takes
    follow. Packages without any name take all records of their scope. ``plans``: source
    (AI, HYBRID, JEPPESEN_424), counts and warnings. A group's legs, of which many packages
    may have the same, join its parts last; ``shown`` says what parts
    get of them, once for each group.
    """
    key = [*scope, package]
    mode = F.coalesce(F.upper("mode"), F.lit("AUTO"))
    p = packages.select(*key, runway_key(F.col("runway")).alias("_rw"), "names", mode.alias("mode"))
    own = procedures.withColumn("signature", signature(F.col("name")))
    named = own.select(*key, "signature").unionByName(p.select(*key, F.explode("names").alias("n")).select(*key, signature(F.col("n")).alias("signature"))).where("signature is not null").distinct()
    whole = record_groups(records, scope)
    groups = whole.drop("legs").withColumn("_id", F.struct("name_key", "runway_key")).drop("name_key")
    fits = (F.col("_rw") == "") | (F.col("_rw") == F.col("runway_key"))
    drawn = p.where("mode <> 'AI'")
    by_name = drawn.join(named, key).join(groups, [*scope, "signature"]).where(fits)
    nameless = drawn.join(named.select(*key).distinct(), key, "left_anti").join(groups, list(scope)).where(fits).select(by_name.columns)
    found = by_name.unionByName(nameless)
    first = found.groupBy(*key, "signature").agg(F.min_by(F.struct(F.col("ordinal").alias("group"), "n_legs", F.col("_id").alias("id")), "ordinal").alias("f"))
    cover = own.join(first, [*key, "signature"], "left").join(drawn.select(*key, F.lit(True).alias("_in")), key, "left_semi")
    model = own.join(p.where("mode = 'AI'").select(key), key, "left_semi").withColumn("f", F.lit(None).cast(first.schema["f"].dataType))
    both = cover.unionByName(model.select(cover.columns))
    by_record = F.col("f").isNotNull()
    mine = both.select(*key, F.struct(F.lit(0), F.col("ordinal").cast("long")).alias("_o"), "name", "runway", F.when(by_record, "JEPPESEN_424").otherwise("AI").alias("source"), F.when(by_record, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(SURE))).otherwise(F.col("confidence")).alias("confidence"), F.when(by_record, F.col("f.n_legs")).otherwise(F.col("n_legs").cast("int")).alias("n_legs"), F.col("f.group").alias("_group"), F.col("f.id").alias("_id"))
    taken = mine.where("_group is not null").select(*key, F.col("_group").alias("ordinal")).distinct()
    rest = found.join(taken, [*key, "ordinal"], "left_anti").select(*key, F.struct(F.lit(1), F.col("ordinal").cast("long")).alias("_o"), "name", "runway", F.lit("JEPPESEN_424").alias("source"), F.lit(SURE).alias("confidence"), "n_legs", F.col("ordinal").alias("_group"), "_id")
    every = mine.unionByName(rest)
    parts = every.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy("_o")))
    used = parts.where("_group is not null").select(*key, "_group", "n_legs").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("record_procedures"), F.sum("n_legs").alias("record_legs"))
    told = parts.groupBy(*key).agg(F.count_if(F.col("source") == "AI").alias("_ai"), F.count_if(F.col("_o.col1") == 0).alias("model_procedures"))
    plans = p.join(used, key, "left").join(told, key, "left")
    none, ai = F.col("record_procedures").isNull(), F.coalesce("_ai", F.lit(0))
    source = F.when(none, "AI").when(ai > 0, "HYBRID").otherwise("JEPPESEN_424")
    partly = F.concat(ai.cast("string"), F.lit(" procedures have no record and are drawn from the answer."))
    warning = F.when(none & (F.col("mode") == "JEPPESEN_424"), NO_RECORDS).when(~none & (ai > 0), partly)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    of = whole.select(*scope, F.struct("name_key", "runway_key").alias("_id"), F.lit(0).cast("long").alias("_own"), shown(F.col("legs")).alias("legs"))
    own_place = F.when(F.col("_id").isNull(), F.col("_o.col2")).otherwise(0).alias("_own")  # parts without a group are many, and would meet in one task
    drawn_parts = parts.select(*key, "position", "name", "runway", "source", "confidence", "n_legs", "_id", own_place).join(of, [*scope, "_id", "_own"], "left")
    return plans.select(*key, "mode", source.alias("source"), zero("record_procedures"), zero("record_legs"), zero("model_procedures"), F.array_compact(F.array(warning)).alias("warnings")), drawn_parts.select(*key, "position", "name", "runway", "source", "confidence", "n_legs", "legs")
