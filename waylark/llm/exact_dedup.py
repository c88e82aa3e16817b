"""Exact dedup by two passes with a Bloom filter.

Pass 1 counts how often each of a row's two hashed positions occurs and packs
the positions that occur twice or more into a bitmap of bounded size. Pass 2
reads the rows again: a row with a position that occurs once is unique and goes
straight through, without a shuffle; only the rest meet in groups, keyed by the
SHA-256 of the normalised text, which settles equality.

The filter has at most ``MOST_BITS`` positions. In a corpus beyond that, more
unique rows take the shuffled way; no result depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group of at least so many rows (as the filter counts, never fewer than there are) is dealt over SALTS partitions when its rows meet the group's totals.
HOT_ROWS = 256
SALTS = 64


def normalised(text: Column) -> Column:
    """Null as empty; A-Z in lower case, nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _met(docs: DataFrame, id_col: str, text_col: str, carried: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are certainly alone and rows that met their group's totals, both with doc_id, keep_id, group_size, kept, text_sha256 and row: ``carried`` of the row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("_t"), carried.alias("row"))
    bits = common.filter_bits(docs.count())
    at = lambda seed: F.pmod(F.xxhash64(F.col("_t"), F.lit(seed)), F.lit(bits))
    counted = rows.select(F.explode(F.array(at(1), at(2))).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    both = counted.groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("twice"),
        F.bitmap_construct_agg(F.bitmap_bit_position(F.when(F.col("n") >= HOT_ROWS, F.col("pos")))).alias("hot"),
    )
    both = common.written(both, "bloom")
    seen = rows.select("doc_id", "row", F.sha2(F.col("_t"), 256).alias("text_sha256"), at(1).alias("p1"), at(2).alias("p2"))
    for p in ("p1", "p2"):
        side = F.broadcast(both.select(F.col("bucket").alias(f"b_{p}"), F.col("twice").alias(f"t_{p}"), F.col("hot").alias(f"h_{p}")))
        seen = seen.join(side, F.bitmap_bucket_number(F.col(p)) == F.col(f"b_{p}"), "left")
    test = lambda k: common.bit_is_set(F.col(f"{k}_p1"), F.col("p1")) & common.bit_is_set(F.col(f"{k}_p2"), F.col("p2"))
    seen = seen.select("doc_id", "row", "text_sha256", test("t").alias("twice"), test("h").alias("hot"))
    alone = seen.where(~F.col("twice")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row")
    # whether a row is hot follows from its text alone, so rows and totals of a group agree on it
    many = seen.where("twice").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    totals = many.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("hot").alias("hot"))
    totals = totals.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    met = many.join(totals, ["text_sha256", "salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "row")
    return alone, met


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the one with the largest id stays. Null
    texts count as empty texts, so all of them form one group. A null id comes
    below any other; rows that repeat an id and text are each counted, and of
    several rows with the largest id every one has ``kept`` true, as nothing
    tells them apart. An empty table gives no rows. Other columns are ignored.
    """
    alone, met = _met(docs, id_col, text_col, F.lit(None).cast("int"))
    return alone.unionByName(met).drop("row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever they are named.

    Of each group of ``exact_groups`` exactly one row stays, of several rows with the
    largest id an arbitrary one. Rows travel with their group, not by id, so that ids may
    repeat and be null: rows of one id and different texts are judged each for itself.
    """
    alone, met = _met(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    one = met.where("kept").groupBy("text_sha256").agg(F.first("row").alias("row"))
    return alone.select("row").unionByName(one.select("row")).select("row.*")
