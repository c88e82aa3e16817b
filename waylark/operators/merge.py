"""Keyed merges, set operations and grouping with a stable order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group. ``order`` should end in a tie-break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, new: DataFrame, key: str, keep_blank: bool = False) -> DataFrame:
    """Field by field the new value, or the old one where the new is null (or empty text, unless ``keep_blank``)."""
    cols = [c for c in base.columns if c != key]
    texts = {f.name for f in base.schema if f.dataType.simpleString() == "string"}
    fresh = lambda c: F.col(f"n.{c}") if keep_blank or c not in texts else F.nullif(F.col(f"n.{c}"), F.lit(""))
    joined = base.alias("b").join(new.alias("n"), F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"b.{key}", f"n.{key}").alias(key), *[F.coalesce(fresh(c), F.col(f"b.{c}")).alias(c) for c in cols])


def replace_by_key(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Whole rows of ``new`` in place of those of ``base`` with their key."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def without_placeholders(rows: DataFrame, group: str, has_content: Column, confidence: str, weak: float = 0.5) -> DataFrame:
    """Rows without content and of weak confidence go from groups in which some row has content."""
    some = rows.groupBy(group).agg(F.bool_or(has_content).alias("_some"))
    return rows.join(some, group).where(~(F.col("_some") & ~has_content & (F.col(confidence) <= weak))).drop("_some")


def islands(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, first, last) of each run of consecutive numbers; repeated numbers count once."""
    w = Window.partitionBy(*keys).orderBy(number)
    marked = rows.select(*keys, number).distinct().withColumn("_i", F.col(number) - F.row_number().over(w))
    return marked.groupBy(*keys, "_i").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_i")


def page_ranges(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of each group as text: 1-3, 5."""
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    runs = islands(rows, keys, number).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", part.alias("t")))).alias("r"))
    return runs.select(*keys, F.array_join(F.transform("r", lambda x: x["t"]), ", ").alias("ranges"))


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with batch: ``size`` rows each, from 0, in order within their group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def grouped_in_order(rows: DataFrame, keys: Sequence[str], ordinal: str, value: str, limit: int | None = None) -> DataFrame:
    """(keys, first_ordinal, values): values of each group in the order they were seen, the first ``limit`` of them."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(ordinal, value))), lambda x: x[value])
    return rows.groupBy(*keys).agg(F.min(ordinal).alias("first_ordinal"), (values if limit is None else F.slice(values, 1, limit)).alias("values"))


def counts_with_other(rows: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Rows by value, all values beyond the known ones as other."""
    return rows.groupBy(F.when(F.col(column).isin(list(known)), F.col(column)).otherwise("other").alias(column)).agg(F.count(F.lit(1)).alias("n"))
