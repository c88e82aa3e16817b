"""Audit of how the sources of a language diverge from it and from each other.

Terms are counted in Python workers, where a text is translated and split at C speed,
into bounded counters; from then on everything is joins and sums of counts. A group is
one (lang, source). A term's share there, p, and in the whole language, q, are integers
(``share``), so that all figures are exact.

``pair``: sources by the sum of absolute differences of their shares over all kept
terms. Postings, one row for each group and term that meets there, are joined with
themselves only for terms that both sources have; whatever one of them lacks follows
from a histogram of the other's counts.

``term``: the terms a group has most beyond its language, by an upper-bound search.
Terms of a group lie in buckets by the bit length of their count. A bucket's greatest
p and least q bound what its terms can score. The buckets of a group are taken best
first, in waves that grow, and the search of a group ends once the bounds of all
buckets that weren't taken are strictly below its kth score: equal bounds may hide a
tie and are taken.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a language that a kept term is in, what is added to counts, the scale of shares, ranks of terms.
LEAST_DOCUMENTS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Entries that a worker counts before it sends them on.
MOST_ENTRIES = 300_000
#: Bytes of a text that are split at once; a longer one is cut between terms.
PIECE = 4 << 20
#: How many times as many terms a wave of the search may take as the one before.
GROWTH = 8

#: Letters A-Z in lower case, a-z and everything beyond ASCII stay; the rest is white space.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    flat = text.translate(_TABLE)
    at = 0
    while len(flat) - at > PIECE:
        cut = flat.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield flat[at:cut].split()
        at = cut
    yield (flat[at:] if at else flat).split()


def _sent(held: dict) -> pa.RecordBatch:
    rows = [(lang, source, term, n, documents[term]) for (lang, source), (counts, documents) in held.items() for term, n in counts.items()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:2]), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["lang", "source", "term", "n", "documents"])


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    known = 0
    for batch in it:
        for lang, source, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
            counts, documents = held[lang, source]
            before = len(counts)
            met: set[bytes] = set()
            for terms in pieces(text):
                counts.update(terms)
                met.update(terms)
            documents.update(met)
            known += len(counts) - before
            if known >= MOST_ENTRIES:
                yield _sent(held)
                held.clear()
                known = 0
    if held:
        yield _sent(held)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), by decimals of 38 digits; null where there are no kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    down = wide(total + F.lit(ADDED) * terms)
    return F.when(terms > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + ADDED), F.nullif(down, wide(F.lit(0)))) + 1)


def postings(docs: DataFrame, text_col: str, lang_col: str, source_col: str, least_documents: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, total, own_terms, lang_total, terms, zero: the share of what doesn't occur) and postings (lang, source, term, n, p, q, zero), both written."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counted = named.mapInArrow(_counts, "lang string, source string, term string, n long, documents long")
    with common.arrow_rows(spark, common.TEXT_ROWS):
        met = common.written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "terms")
    kept = met.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("d")).where(F.col("d") >= least_documents).drop("d")
    kept = common.written(met.drop("documents").join(kept, ["lang", "term"]), "kept")

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    # of a language's terms each has postings that tell its count in the language
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = named.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[zero(c) for c in ("total", "own_terms", "lang_total", "terms")]).withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms")))
    groups = common.written(groups, "groups")
    scored = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"), "zero")
    return groups, common.written(scored, "postings")


def pairs(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """(lang, source, item, value): each other source of the language, with the summed difference of shares.

    For a and b, what both have counts by the postings; a's terms count against b's share
    of nothing by a histogram, as do b's; what neither has, by number. Terms of both are
    then in all four sums, which the postings' part mends.
    """
    a = posted.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    b = posted.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(gap("pa", "pb") - gap("pa", "zb") - gap("pb", "za") + gap("za", "zb")).alias("value"))
    others = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"), F.col("own_terms").alias("nb"))
    histogram = posted.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("pa")).agg(F.count(F.lit(1)).alias("n"))
    lone = histogram.join(others, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("n") * gap("pa", "zb")).alias("value"))
    ends = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), F.col("own_terms").alias("na"), "terms")
    neither = ends.join(others, "lang").where("a < b").select("lang", "a", "b", F.coalesce((F.col("terms") - F.col("na") - F.col("nb")) * gap("za", "zb"), F.lit(0)).alias("value"))
    one_way = both.unionByName(lone).unionByName(neither)
    each = one_way.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    return each.groupBy("lang", F.col("s.source").alias("source"), F.col("s.item").alias("item")).agg(F.sum("value").alias("value"))


def _best(rows: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def leading_terms(posted: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the ``top`` terms of each group that have most beyond the language."""
    rows = posted.withColumn("bucket", F.length(F.bin("n")))
    bounds = rows.groupBy("lang", "source", "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count(F.lit(1)).alias("n")).where("bound > 0")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    unseen = common.written(bounds.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n"), "bounds")
    best, most = None, top
    while not unseen.isEmpty():
        wave = unseen.where(F.col("before") < most)
        found = rows.where("p > q").join(wave.select("lang", "source", "bucket"), ["lang", "source", "bucket"]).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        best = common.written(_best(found if best is None else best.drop("rank").unionByName(found), top), "best")
        kth = best.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
        rest = unseen.where(F.col("before") >= most).join(kth, ["lang", "source"], "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
        unseen, most = common.written(rest, "bounds"), most * GROWTH
    if best is None:
        return posted.select("lang", "source", F.col("term").alias("item"), F.col("p").alias("value"), F.lit(1).alias("rank")).where(F.lit(False))
    return best


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language and from the language itself.

    A null text, lang or source counts as ''. A row is a document, also if it repeats
    another. A group whose documents have no kept term is there with counts of 0; in a
    language without kept terms all pairs have the value 0. Ties go by the UTF-8 of the
    item. A lone source of a language has no pairs. An empty table gives no rows. Other
    columns are ignored.
    """
    groups, posted = postings(docs, text_col, lang_col, source_col, least_documents)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    cols = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return cols(pairs(groups, posted).withColumn("rank", F.row_number().over(w)), "pair").unionByName(cols(leading_terms(posted, top), "term"))
