"""Line dedup by content-defined chunks of lines, in built-in functions only.

Each line has a hash, and each place a rolling hash over its last ``SPAN`` line
hashes. A chunk ends where the rolling hash is less than that before it and not more
than that after it. Boundaries so depend on the lines around them and not on their
number, and shift with a passage that is inserted elsewhere. Two of them never adjoin,
and none is made after a text's first line or before its last, so that only a text of
one line has a chunk of one. Where more than ``MOST_LINES`` lines have no boundary, as
in runs of equal lines, further ones follow each MOST_LINES lines after the last. A
chunk of two lines or more that also occurs earlier in the corpus (smaller id, or the
same id and an earlier line) goes.

Only hashes travel until chunks are known to share one: a first aggregation by
hash keeps hashes that occur twice or more, in a filter of bounded size. Chunks
that pass it travel with their bytes and are grouped by these, so that equal
hashes of different chunks remove nothing. Rows of a chunk that occurs often are
dealt over several partitions to meet its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = 2
LEAST_LINES = 2
MOST_LINES = 8
#: A chunk whose hash occurs so often, as the filter counts, is dealt over SALTS partitions.
HOT_ROWS = 256
SALTS = 64
FACTOR = 1_000_003
#: Rolling hashes are remainders of this prime.
PRIME = (1 << 31) - 1


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def rolling(padded: Column, n: Column) -> Column:
    """The rolling hash of each of ``n`` lines. ``padded`` holds SPAN - 1 zeros and then a hash for each line."""

    def rolled(i: Column) -> Column:
        total = F.element_at(padded, i + (SPAN - 1))
        for back in range(1, SPAN):
            total = total + F.element_at(padded, i + (SPAN - 1 - back)) % PRIME * FACTOR**back
        return total % PRIME

    return F.transform(F.sequence(F.lit(1), n), rolled)


def chunk_ends(rolled: Column, n: Column) -> Column:
    """1-based numbers of the last line of each chunk, in order, without those that MOST_LINES adds."""
    least = F.filter(F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2))), lambda i: (i <= n - 2) & (F.element_at(rolled, i) < F.element_at(rolled, i - 1)) & (F.element_at(rolled, i) <= F.element_at(rolled, i + 1)))
    return F.concat(least, F.array(n))


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, first, n_lines, chunk) for each chunk of each text that has LEAST_LINES lines or more."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines")).where(F.size("lines") >= LEAST_LINES)
    # columns of their own, for within a lambda an expression is evaluated for each element
    hashed = lines.withColumn("padded", F.concat(F.array_repeat(F.lit(0).cast("long"), SPAN - 1), F.transform("lines", line_hash)))
    rolled = hashed.withColumn("rolled", rolling(F.col("padded"), F.size("lines"))).drop("padded")
    ends = rolled.withColumn("ends", chunk_ends(F.col("rolled"), F.size("lines"))).drop("rolled")
    parts = ends.withColumn("parts", F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)).alias("a"), F.col("ends").alias("b")))

    def pieces(z: Column) -> Column:
        # each of MOST_LINES, but for the last, of two at least and MOST_LINES + 1 at most
        last = F.floor((z["b"] - z["a"] - LEAST_LINES) / MOST_LINES).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((z["a"] + k * MOST_LINES).alias("a"), F.when(k == last, z["b"]).otherwise(z["a"] + (k + 1) * MOST_LINES).alias("b")))

    bounds = parts.withColumn("bounds", F.flatten(F.transform("parts", pieces)))
    cut = lambda z: F.struct((z["a"] + 1).alias("first"), (z["b"] - z["a"]).alias("n_lines"), F.array_join(F.slice(F.col("lines"), z["a"] + 1, z["b"] - z["a"]), "\n").alias("chunk"))
    return bounds.select("doc_id", "th", F.explode(F.transform("bounds", cut)).alias("c")).select("doc_id", "th", "c.first", "c.n_lines", "c.chunk")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) for each row of ``docs``.

    Lines end at \\n; other white space belongs to them. A null text counts as one
    empty line, as an empty one does. A text of a single line never goes. Rows that
    repeat an id with equal texts are one document: their chunks start equally
    early, so both rows keep or lose the same. A null id comes before others. An
    empty table gives no rows. Other columns are ignored.
    """
    many = chunks(docs, id_col, text_col).withColumn("key", F.xxhash64("chunk"))
    bits = common.filter_bits(docs.count() * 4)
    pos = F.pmod(F.col("key"), F.lit(bits)) + 1
    counted = many.select(pos.alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    maps = counted.groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("twice"), F.bitmap_construct_agg(F.bitmap_bit_position(F.when(F.col("n") >= HOT_ROWS, F.col("pos")))).alias("hot"))
    maps = common.written(maps, "chunks")
    met = many.withColumn("pos", pos).join(F.broadcast(maps), F.bitmap_bucket_number("pos") == F.col("bucket"))
    met = met.where(common.bit_is_set(F.col("twice"), F.col("pos"))).select("doc_id", "th", "first", "n_lines", "chunk", common.bit_is_set(F.col("hot"), F.col("pos")).alias("hot"))
    met = common.written(met, "repeats")

    earliest = met.groupBy("chunk").agg(F.min(F.struct("doc_id", "first")).alias("least"), F.count(F.lit(1)).alias("n"), F.max("hot").alias("hot")).where("n >= 2")
    spread = earliest.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).select("chunk", "salt", "least")
    own = met.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    gone = own.join(spread, ["chunk", "salt"]).where(~F.struct("doc_id", "first").eqNullSafe(F.col("least"))).select("doc_id", "th", "first", "n_lines").distinct()
    removed = gone.groupBy(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("_id"), F.col("th").alias("_th")).agg(F.sort_array(F.collect_list(F.struct("first", "n_lines"))).alias("ranges"))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = rows.join(removed, ["_id", "_th"], "left").withColumn("lines", F.split("text", "\n"))
    # what stays lies between the ranges: (start, length) of each gap
    total = F.size("lines")
    edges = F.concat(F.array(F.struct(F.lit(1).alias("first"), F.lit(0).alias("n_lines"))), F.col("ranges"))
    nexts = F.concat(F.transform("ranges", lambda r: r["first"]), F.array(total + 1))
    gaps = F.transform(F.arrays_zip(edges.alias("e"), nexts.alias("x")), lambda z: F.slice("lines", z["e"]["first"] + z["e"]["n_lines"], F.greatest(z["x"] - z["e"]["first"] - z["e"]["n_lines"], F.lit(0))))
    taken = F.aggregate("ranges", F.lit(0), lambda s, r: s + r["n_lines"])
    return both.select(
        "doc_id",
        total.cast("long").alias("n_lines"),
        F.coalesce(taken, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n")).alias("kept_text"),
    )
