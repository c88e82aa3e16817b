"""Index pages: items from lines, names from titles, coordinates by identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylark.functions import text as tx

#: Lines that belong to no item, and aids that an approach is named by.
BOILERPLATE = r"^(AIP|AMENDMENT|AIRAC|CHART NAME)(?![A-Z0-9_])|^©|^CIVIL AVIATION|^\d{1,2} [A-Z]{3} \d{2,4}$|^AD 2-[A-Z]{4}-\d+$|CHARTS RELATED TO AN AERODROME"
AIDS = "ILS|LOC|VOR|NDB|GLS|LDA|IGS|RNP|RNAV"
NO_FIXES = ["RNAV", "RNP", "GNSS", "ICAO"]
COORDINATE = r"\d{6}(?:\.\d+)?[NS] +\d{7}(?:\.\d+)?[EW]"


def index_items(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, name, number): items of an index in which names stand on lines before, or on, that of their number.

    A boilerplate line drops what was gathered. Lines between two of these belong
    together, so a running count of them marks the items.
    """
    lines = pages.select(key, F.posexplode(F.split(text, "\r?\n")).alias("ordinal", "raw")).select(key, "ordinal", tx.squeezed(F.col("raw")).alias("line")).where("line <> ''")
    up = F.upper("line")
    marked = lines.withColumn("boiler", up.rlike(BOILERPLATE)).withColumn("number", tx.chart_no_lettered(F.col("line")))
    stops = F.when(F.col("boiler") | F.col("number").isNotNull(), 1).otherwise(0)
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    grouped = marked.withColumn("item", F.coalesce(F.sum(stops).over(w), F.lit(0)))
    before = F.trim(F.regexp_replace(up, f"{tx.LETTERED_NO}.*$", ""))
    kept = F.when(F.col("boiler"), None).when(F.col("number").isNotNull(), F.substring("line", F.lit(1), F.length(before))).otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.when(F.coalesce(kept, F.lit("")) != "", F.struct("ordinal", kept.alias("t")))))
    out = grouped.groupBy(key, "item").agg(F.max("ordinal").alias("ordinal"), F.trim(F.array_join(F.transform(parts, lambda p: p["t"]), " ")).alias("name"), F.max("number").alias("number"), F.bool_or("boiler").alias("boiler"))
    return out.where("number is not null and not boiler and name <> ''").select(key, "ordinal", "name", "number")


def approach_name(title: Column) -> Column:
    """The aid and the runway. Where the aid stands before both the runway and the words for the chart, it is taken from there; else what stands between these words and the runway; else the kind of navigation."""
    t = tx.squeezed(title)
    up = F.upper(t)
    ahead = rf"(?<![A-Z0-9])(({AIDS})( [A-Z](?![A-Z]))?( OR ({AIDS})( [A-Z](?![A-Z]))?)?) RWY ?\d"
    phrase = r"INSTRUMENT APPROACH CHART( - ICAO)?"
    first = F.when((F.regexp_instr(up, F.lit(ahead)) > 0) & (F.regexp_instr(up, F.lit(ahead)) < F.regexp_instr(up, F.lit(phrase))), F.regexp_extract(up, ahead, 1))
    middle = F.nullif(F.regexp_replace(F.regexp_extract(up, rf"{phrase}(.*?)RWY", 2), r"^[ -]+|[ -]+$", ""), F.lit(""))
    return F.concat_ws(" ", F.coalesce(first, middle, tx.navigation_words(up)), tx.runway(up))


def procedure_names(title: Column) -> Column:
    """Compact designators, else worded ones, else one at the end, else a fix before SID or STAR; the first kind that is there."""
    up = F.upper(title)
    compact = tx.matches(title, r"(?<![A-Z0-9])[A-Z]{5} ?\d[A-Z](?![A-Z0-9])")
    worded = tx.matches(up, rf"(?<![A-Z])[A-Z]{{3,6}} ({'|'.join(tx.DIGIT_WORDS[1:])})( [A-Z])? (DEPARTURE|ARRIVAL)")
    last = F.trim(F.element_at(F.split(up, " - "), -1))
    trailing = F.when(~last.startswith("RWY") & last.rlike(r"^[A-Z]{2,5} ?\d{1,2}[A-Z]$"), F.array(last))
    fix = F.regexp_extract(up, r"(?<![A-Z])([A-Z]{3,6}) (SID|STAR)(?![A-Z])", 1)
    some = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(some(compact), some(worded), trailing, F.when((fix != "") & ~fix.isin(NO_FIXES), F.array(fix)), F.array().cast("array<string>"))


def coordinate_for(text: Column, ident: Column, after: int = 120, before: int = 160) -> Column:
    """The first coordinate within ``after`` characters of an identifier, else the last within ``before`` characters ahead of it; null without either."""
    at = F.position(ident, text)
    ahead = F.nullif(F.regexp_extract(F.substring(text, at + F.length(ident), F.lit(after)), COORDINATE, 0), F.lit(""))
    start = F.greatest(at - before, F.lit(1))
    found = F.regexp_extract_all(F.substring(text, start, at - start), F.lit(COORDINATE), F.lit(0))
    return F.when(at > 0, F.coalesce(ahead, F.when(F.size(found) > 0, F.element_at(found, -1))))


def with_reason(pages: DataFrame, known: DataFrame, key: str, title: Column, explicit: str) -> DataFrame:
    """Pages left over by an index, with what becomes of them: JOINED to a known key, NEW package, or rejected and why."""
    out = pages.join(known.select(key, F.lit(True).alias("_known")), key, "left")
    verdict = F.when(F.col(key).isNull(), "NO_KEY").when(~title.rlike(explicit), "NO_TITLE").when(F.col("_known"), "JOINED").otherwise("NEW")
    return out.withColumn("verdict", verdict).drop("_known")


#: Fixed value: titles of charts that are programs.
PROGRAM = r"STANDARD\s+DEPARTURE\s+CHART|STANDARD\s+ARRIVAL\s+CHART|INSTRUMENT\s+APPROACH\s+CHART"


def numeric_items(text: Column) -> Column:
    """Items of an index in which a title is followed by its number: an array of struct(name, number, tabular_no)."""
    found = F.regexp_extract_all(F.upper(text), F.lit(rf"(?s)((?:{PROGRAM}).*?{tx.NUMERIC_NO})"), F.lit(1))
    name = lambda s: tx.squeezed(F.regexp_replace(F.regexp_replace(s, tx.NUMERIC_NO, ""), r"\(TABULAR\s*\d+\)", ""))
    return F.transform(found, lambda s: F.struct(name(s).alias("name"), tx.chart_no_numeric(F.regexp_extract(s, tx.NUMERIC_NO, 0)).alias("number"), tx.extract(s, r"\(TABULAR\s*(\d+)\)").try_cast("int").alias("tabular_no")))


def continues_index(text: Column) -> Column:
    """Whether a page goes on with an index: many program titles under its heading or with leaders, or many lettered numbers."""
    up = F.upper(text)
    titles = F.regexp_count(up, F.lit(PROGRAM))
    leaders = F.regexp_count(text, F.lit(r"·{4,}|\.{6,}"))
    heading = up.rlike(r"CHART\s+NAME\s+PAGE|AD\s*2\.?24|CHARTS RELATED TO (AN|THE) AERODROME")
    return ((titles >= 4) & (heading | (leaders >= 4))) | (F.regexp_count(up, F.lit(tx.LETTERED_NO)) >= 8)


def section(text: Column) -> Column:
    """The section that a page names first, such as AD 2.12."""
    return tx.squeezed(tx.extract(F.upper(text), r"(AD\s*2\.?\s*\d{1,2})"))
