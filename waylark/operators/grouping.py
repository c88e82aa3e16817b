"""Joins that assign pages to packages: by number prefix, contained text, page ranges and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import top_one

SUB_PAGE = r"[-.]\d{1,2}$"


def prefix_join(items: DataFrame, item_no: str, pages: DataFrame, page_no: str) -> DataFrame:
    """Items with the pages of their number or of a sub-page of it. An equi join: a page goes by its number and its parent's."""
    parent = F.regexp_replace(page_no, SUB_PAGE, "")
    keyed = pages.withColumn("_key", F.explode(F.array_distinct(F.array(F.col(page_no), parent))))
    return items.join(keyed, F.col(item_no) == F.col("_key")).drop("_key")


def longest_contained(pages: DataFrame, key: str, text: str, needles: Sequence[tuple[int, str]]) -> DataFrame:
    """(key, item, needle): of a given list of needles the longest that a page contains, the earlier item among equals. The list is part of the plan, so pages aren't shuffled."""
    ordered = sorted(needles, key=lambda n: (-len(n[1]), n[0]))
    out = F.lit(None).cast("struct<item: bigint, needle: string>")
    for item, needle in reversed(ordered):
        out = F.when(F.col(text).contains(needle), F.struct(F.lit(item).cast("long").alias("item"), F.lit(needle).alias("needle"))).otherwise(out)
    return pages.select(key, out.alias("_n")).where("_n is not null").select(key, "_n.item", "_n.needle")


def within_band(seeds: DataFrame, seed: str, rows: DataFrame, number: str, width: int) -> DataFrame:
    """(number, seed): rows up to ``width`` after a seed go to the first such seed. An equi join on the numbers that a seed reaches."""
    reach = seeds.withColumn(number, F.explode(F.sequence(F.col(seed) + 1, F.col(seed) + width)))
    return rows.join(reach, number).groupBy(number).agg(F.min(seed).alias(seed))


def pages_in_ranges(pages: DataFrame, page: str, files: DataFrame, start: str, count: str, span: int = 1000) -> DataFrame:
    """Pages with the file whose range [start, start + count) they lie in; an equi join on blocks of ``span`` pages, then the exact test."""
    blocks = files.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / span), F.floor((F.col(start) + F.col(count) - 1) / span))))
    met = pages.withColumn("_b", F.floor(F.col(page) / span)).join(blocks, "_b")
    return met.where((F.col(page) >= F.col(start)) & (F.col(page) < F.col(start) + F.col(count))).drop("_b")


def finalized(rows: DataFrame, keys: Sequence[str], page: str, review: Column) -> DataFrame:
    """Packages: their pages in order, the first as default chart, and whether any row asks for review."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(page)).alias("pages"), F.min(page).alias("default_chart"), F.bool_or(review).alias("review"), F.count(F.lit(1)).alias("n"))


def prioritised(left: DataFrame, right: DataFrame, key: str, conditions: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Each left row with the right row of the first condition that holds, the first in ``order`` among several; ``key`` names the left row."""
    rank = None
    for i, c in enumerate(conditions):
        rank = F.when(c, i) if rank is None else rank.when(c, i)
    met = left.join(right, key).withColumn("_rank", rank).where("_rank is not null")
    return top_one(met, [key], [F.col("_rank"), *order]).drop("_rank")
