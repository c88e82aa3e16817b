"""Branch graphs of procedures: branches from ordered legs, merge points, routes, topology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylark.functions.tolerance import round_half_up


def chained(legs: DataFrame, keys: Sequence[str], order: Sequence[str], fix: str = "fix") -> DataFrame:
    """Each leg with from_fix, the fix before it, and the fix after it, within its branch."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return legs.withColumn("from_fix", F.lag(fix).over(w)).withColumn("next_fix", F.lead(fix).over(w))


def branches(legs: DataFrame, keys: Sequence[str], order: str, fix: str = "fix") -> DataFrame:
    """One row for each branch: entry and exit fix (the first and last that are named), number of legs, and the legs in order."""
    named = F.when(F.coalesce(F.col(fix), F.lit("")) != "", F.col(order))
    return legs.groupBy(*keys).agg(F.min_by(fix, named).alias("entry_fix"), F.max_by(fix, named).alias("exit_fix"), F.count(F.lit(1)).alias("legs"), F.min(order).alias("first_sequence"), F.max(order).alias("last_sequence"))


def merge_points(branch: DataFrame, keys: Sequence[str], branch_id: str) -> DataFrame:
    """Fixes where branches meet: two or more end there, or one ends and one begins. With the sorted ids of both."""
    ends = branch.select(*keys, F.explode(F.array(F.struct(F.col("exit_fix").alias("fix"), F.lit("in").alias("way")), F.struct(F.col("entry_fix").alias("fix"), F.lit("out").alias("way")))).alias("e"), F.col(branch_id).alias("_b")).select(*keys, "e.fix", "e.way", "_b").where("fix is not null")
    side = lambda way: F.array_sort(F.collect_set(F.when(F.col("way") == way, F.col("_b"))))
    return ends.groupBy(*keys, "fix").agg(side("in").alias("inbound"), side("out").alias("outbound")).where((F.size("inbound") >= 2) | ((F.size("inbound") >= 1) & (F.size("outbound") >= 1)))


def routes(branch: DataFrame, key: str, branch_id: str, role: str = "role") -> DataFrame:
    """(key, runway_id, transition_id): each runway branch of a graph with each of its transitions; a missing side gives one null. Within a graph only, which has few branches."""
    ids = branch.select(key).distinct()
    side = lambda r, name: ids.join(branch.where(F.col(role) == r).select(key, F.col(branch_id).alias(name)), key, "left")
    return side("RUNWAY", "runway_id").join(side("ENROUTE", "transition_id"), key)


def route_legs(found: DataFrame, legs: DataFrame, key: str, branch_id: str, order: str) -> DataFrame:
    """The legs of each route in order: runway branch, common parts, transition; numbered by tens as they stand."""
    runway = found.join(legs.where("role = 'RUNWAY'").withColumnRenamed(branch_id, "runway_id"), [key, "runway_id"]).withColumn("part", F.lit(1))
    common = found.join(legs.where("role = 'COMMON'").drop(branch_id), key).withColumn("part", F.lit(2))
    enroute = found.join(legs.where("role = 'ENROUTE'").withColumnRenamed(branch_id, "transition_id"), [key, "transition_id"]).withColumn("part", F.lit(3))
    cols = [key, "runway_id", "transition_id", "part", order, "fix", "path_terminator"]
    return runway.select(cols).unionByName(common.select(cols)).unionByName(enroute.select(cols))


def visited_once(legs: Column) -> Column:
    """Of an ordered array of struct(fix, path_terminator, ...) those that are flown: an IF at a fix already reached and a leg to the fix just reached are left out. What counts as reached are the legs kept, so this is a fold."""
    empty = F.filter(legs, lambda x: F.lit(False))

    def step(kept: Column, leg: Column) -> Column:
        fix = F.coalesce(leg["fix"], F.lit(""))
        been = F.exists(kept, lambda k: k["fix"] == fix) & (fix != "")
        again = (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1)["fix"], F.lit("")) == fix)
        return F.when(been & (again | (leg["path_terminator"] == "IF")), kept).otherwise(F.concat(kept, F.array(leg)))

    return F.aggregate(legs, empty, lambda kept, leg: F.when(F.size(kept) == 0, F.array(leg)).otherwise(step(kept, leg)))


def flown(legs: DataFrame, keys: Sequence[str], order: Sequence[str], fix: str = "fix") -> DataFrame:
    """``legs`` that ``visited_once`` keeps of each route, with place, from 1, for routes of any length.

    A fix has been reached if any leg before goes there, kept or not, so an IF there goes
    whatever else is kept; of what is left a leg goes if the one before has the same fix,
    as that one is kept or gone for the fix of the last that is. Both are windows.
    """
    name = F.coalesce(F.col(fix), F.lit(""))
    by = Window.partitionBy(*keys).orderBy(*order)
    been = (F.row_number().over(Window.partitionBy(*keys, "_fix").orderBy(*order)) > 1) & (F.col("_fix") != "")
    first = legs.withColumn("_fix", name).withColumn("_been", been).where(~F.coalesce(F.col("_been") & (F.col("path_terminator") == "IF"), F.lit(False)))
    kept = first.withColumn("_last", F.lag("_fix").over(by)).where(F.col("_last").isNull() | (F.col("_fix") == "") | (F.col("_fix") != F.col("_last")))
    return kept.withColumn("place", F.row_number().over(by)).drop("_fix", "_been", "_last")


def topology(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Of each graph: matched, missing (right only) and extra (left only) branches, their score, and the names, for names that pair by equality."""
    both = left.select(key, name, F.lit(1).alias("l")).join(right.select(key, name, F.lit(1).alias("r")), [key, name], "full_outer")
    names = lambda test: F.array_sort(F.collect_list(F.when(test, F.col(name))))
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    out = both.groupBy(key).agg(F.count_if(l & r).alias("matched"), F.count_if(~l & r).alias("missing"), F.count_if(l & ~r).alias("extra"), names(~l & r).alias("missing_names"), names(l & ~r).alias("extra_names"))
    total = F.col("matched") + F.col("missing") + F.col("extra")
    return out.withColumn("score", F.when(total > 0, round_half_up(F.col("matched") * 100.0 / total, 1)))


def coverage(compared: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """Compared branches of all, in percent to one digit, null where there are none."""
    a, b = compared.groupBy(key).agg(F.count(F.lit(1)).alias("compared")), total.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    out = b.join(a, key, "left").withColumn("compared", F.coalesce("compared", F.lit(0)))
    return out.withColumn("coverage_percent", F.when(F.col("total") > 0, round_half_up(F.col("compared") * 100.0 / F.col("total"), 1)))
