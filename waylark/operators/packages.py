"""Pages grouped into packages of one procedure each, by stages over a table of claims.

A page goes to the package of the index item that has its number; pages whose numbers
were torn apart, to the longest number of an item that their text holds without spaces;
other charts, to a package of their own heading; tables that follow a chart, to its
package. Each stage sees the pages that no claim of an earlier one names. Numbers,
fragments and neighbours are found by equi joins; texts are read once, for a narrow
table of what the stages ask of a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylark.functions import text as tx
from waylark.tables import written

from . import index

#: Packages that count, roles of pages, titles and words.
PROGRAMS = ("SID", "STAR", "APPROACH")
NEVER, TABLES = ("BLANK", "CHART_INDEX", "TABULAR_DESCRIPTION", "WAYPOINT_COORDINATES", "MINIMA_TABLE"), ("TABULAR_DESCRIPTION", "WAYPOINT_COORDINATES", "MINIMA_TABLE")
TITLE_LINE = r"(?i)STANDARD ARRIVAL CHART|STANDARD DEPARTURE CHART|INSTRUMENT APPROACH CHART|TABULAR DESCRIPTION"
OTHER_TITLE = r"(?i)RWY|RNAV|RNP|ILS|LOC|VOR|DME ARC"
EXPLICIT = r"(?i)STANDARD\s+ARRIVAL\s+CHART|STANDARD\s+DEPARTURE\s+CHART|INSTRUMENT\s+APPROACH\s+CHART"
NO_PROGRAM = "AERODROME HELIPORT CHART|AERODROME CHART|AIRCRAFT PARKING|GROUND MOVEMENT|PARKING/DOCKING|OBSTACLE CHART|ATC SURVEILLANCE|HOLDING AREAS|TMA|CTR"
TITLE_LENGTH, HEAD, REACH = 220, 900, 3
INDEX_CONFIDENCE, HEADER_CONFIDENCE, SURE = 0.98, 0.72, 0.8
#: The longest number, without spaces, that is looked for among fragments.
LONGEST = 40
ITEM = "struct<chart_no: string, name: string, package: string, category: string, navigation: string, runway: string, names: array<string>, tabular: boolean, tabular_no: int>"


def page_headers(pages: DataFrame) -> DataFrame:
    """``pages`` with header: what a page says of itself, an ITEM and key, its group's key (null where its category isn't known).

    ``pages`` has text, role, category, navigation, runway, title, names, confirmed (a
    name from the title block) and page_no_text (a number known otherwise), of which all
    may be null; null counts as empty or UNKNOWN.
    """
    raw = F.coalesce("text", F.lit(""))
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("UNKNOWN")) != "UNKNOWN", F.col(c))
    lines = F.filter(F.transform(F.split(raw, "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    df = pages.withColumn("_flat", tx.squeezed(raw)).withColumn("_lines", lines)
    at = F.array_position(F.transform("_lines", lambda s: s.rlike(TITLE_LINE)), F.lit(True)).cast("int")
    df = df.withColumn("_at", at)
    start = F.greatest(F.col("_at") - 1, F.lit(1))
    window = F.array_join(F.slice("_lines", start, F.col("_at") + 3 - start), " ")
    title = F.coalesce(F.nullif("title", F.lit("")), F.when(F.col("_at") > 0, window).otherwise(F.get(F.filter("_lines", lambda s: s.rlike(OTHER_TITLE)), F.lit(0))))
    df = df.withColumn("_title", F.substring(title, 1, TITLE_LENGTH))
    df = df.withColumn("_source", F.concat_ws(" ", F.nullif("_title", F.lit("")), F.nullif(F.substring("_flat", 1, HEAD), F.lit(""))))
    df = df.withColumn("_category", F.coalesce(known("category"), tx.page_category(F.col("_source"))))
    df = df.withColumn("_package", tx.package_type(F.col("_category")))
    df = df.withColumn("_navigation", F.coalesce(known("navigation"), tx.navigation_words(F.col("_source"), F.col("_package")))).withColumn("_runway", F.coalesce(F.nullif("runway", F.lit("")), tx.runway(F.col("_source"))))
    nothing = F.array().cast("array<string>")
    own = F.array_distinct(F.concat(F.coalesce("names", nothing), index.procedure_names(F.col("_source"))))
    names = F.when(F.col("_package") == "APPROACH", F.array(index.approach_name(F.col("_source")))).when(F.coalesce("confirmed", F.lit("")) != "", F.array("confirmed")).otherwise(own)
    df = df.withColumn("_names", names)
    tabular = F.coalesce(F.col("role").isin(*TABLES), F.lit(False)) | F.col("_source").rlike(r"(?i)\(TABULAR\s*\d+\)|TABULAR DESCRIPTION")
    number = F.coalesce(tx.likely_page_no(raw), tx.chart_no(F.col("page_no_text")), tx.chart_no_numeric(F.col("_flat")))
    key = F.when(F.col("_category") != "UNKNOWN", tx.group_key(F.col("_category"), F.col("_package"), F.col("_navigation"), F.col("_runway"), F.col("_names"), F.coalesce("_title", F.lit(""))))
    header = F.struct(
        number.alias("chart_no"), F.coalesce(F.nullif("_title", F.lit("")), number).alias("name"), F.col("_package").alias("package"), F.col("_category").alias("category"), F.col("_navigation").alias("navigation"), F.col("_runway").alias("runway"),
        F.col("_names").alias("names"), tabular.alias("tabular"), tx.extract(F.col("_source"), r"(?i)\(TABULAR\s*(\d+)\)").try_cast("int").alias("tabular_no"),
    ).cast(ITEM)
    return df.withColumn("header", header).withColumn("key", key).drop("_flat", "_lines", "_at", "_title", "_source", "_category", "_package", "_navigation", "_runway", "_names")


def _flags(pages: DataFrame) -> DataFrame:
    """What the stages ask of a page, without its text, but for the compact one of pages that hold the beginning of a number."""
    up = F.upper(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    df = pages.withColumn("_up", up)
    compact = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), r"\s+", "")
    return df.select(
        *[c for c in pages.columns if c != "text"],
        F.col("_up").rlike("WAYPOINT COORDINATES|AERONAUTICAL DATA TABULATION").alias("coordinates"), F.col("_up").contains("TABULAR DESCRIPTION").alias("tabular"), F.col("_up").rlike(tx.ascii_bounds(r"\bMINIMA\b|\bOCA\b|\bOCH\b")).alias("minima"),
        F.col("_up").rlike(NO_PROGRAM).alias("other_chart"), F.col("_up").rlike(EXPLICIT).alias("explicit"), F.coalesce(tx.support_type(F.col("_up"), F.col("role")).isNotNull(), F.lit(False)).alias("support"),
        F.when(compact.contains("AD2-"), F.transform(F.slice(F.split(compact, "AD2-"), 2, 1 << 20), lambda s: F.concat(F.lit("AD2-"), F.substring(s, 1, LONGEST)))).alias("fragments"),
    )


def group_pages(pages: DataFrame, items: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(packages, claims) of the pages of each scope (a document).

    ``pages``: scope, page_no (unique in it), text, role, support kinds by text, number
    (canonical, may be null), source_file and what ``page_headers`` reads. ``items``: the
    index of each scope, with ordinal (unique) and the fields of ITEM. Items of other
    kinds than PROGRAMS make no packages, but tell that there is an index.

    ``claims`` has a row for each page and package: scope, page_no, package_no, stage
    (INDEX, FRAGMENT, HEADER, SEQUENCE), part flags. Numbers of an index may name one
    page for several packages; all other claims are of pages without any. A page that
    several packages would take as what follows their chart goes to the first of them;
    runway and navigation that tables must agree with are those of the package before
    that stage. A scope without pages gives nothing; items without a page give a package
    to be reviewed, without pages.
    """
    scope = list(scope)
    p = written(_flags(page_headers(pages)), "pages")
    own = [c.strip().split(":")[0] for c in ITEM[7:-1].split(", ")]
    item = F.struct(*own).cast(ITEM)
    every = items.select(*scope, "ordinal", item.alias("item"))
    key = tx.group_key(F.col("item.category"), F.col("item.package"), F.col("item.navigation"), F.col("item.runway"), F.coalesce("item.names", F.array().cast("array<string>")), F.coalesce("item.name", F.lit("")))
    programs = written(every.where(F.col("item.package").isin(*PROGRAMS)).withColumn("key", key), "items")
    page = F.struct("role", "number", "names", "runway", "coordinates", "tabular", "minima").alias("page")
    numbered = p.where(~F.coalesce(F.col("role").isin("CHART_INDEX", "BLANK"), F.lit(False)) & F.col("number").isNotNull())

    # 1: by number, its own or that of which it is a sub-page
    both = numbered.select(*scope, "page_no", F.explode(F.array_distinct(F.array("number", F.regexp_replace("number", r"[-.]\d{1,2}$", "")))).alias("_no"), page)
    met = programs.withColumn("_no", F.col("item.chart_no")).join(both, [*scope, "_no"]).select(*scope, "key", F.col("ordinal").cast("long").alias("ordinal"), "page_no", "item", "page", F.lit("INDEX").alias("stage"))
    claims = written(met, "claims")
    free = p.join(claims.select(*scope, "page_no").distinct(), [*scope, "page_no"], "left_anti")

    # 2: by what is left of a number, the longest first
    torn = free.where(F.col("fragments").isNotNull() & ~F.coalesce(F.col("role").isin("CHART_INDEX", "BLANK", "SUPPORT"), F.lit(False)))
    torn = torn.select(*scope, "page_no", page, F.explode("fragments").alias("f")).select("*", F.explode(F.sequence(F.lit(4), F.length("f"))).alias("n")).select(*scope, "page_no", "page", F.substring(F.col("f"), F.lit(1), F.col("n")).alias("_needle")).distinct()
    needles = programs.withColumn("_needle", F.regexp_replace(F.upper("item.chart_no"), r"\s+", ""))
    best = needles.join(torn, [*scope, "_needle"]).groupBy(*scope, "page_no").agg(F.min_by(F.struct("key", "ordinal", "item", "page"), F.struct(-F.length("_needle"), F.col("ordinal"))).alias("b"))
    claims = written(claims.unionByName(best.select(*scope, "b.key", F.col("b.ordinal").cast("long").alias("ordinal"), "page_no", "b.item", "b.page", F.lit("FRAGMENT").alias("stage"))), "claims")
    free = p.join(claims.select(*scope, "page_no").distinct(), [*scope, "page_no"], "left_anti")

    # 3: by their own heading
    indexed = every.select(*scope).distinct().withColumn("_index", F.lit(True))
    chart = free.where((F.col("role") == "CHART") & ~F.col("other_chart") & F.col("explicit") & F.col("header.chart_no").isNotNull() & F.col("key").isNotNull() & F.col("header.package").isin(*PROGRAMS))
    files = p.where((F.col("role") == "CHART") & F.col("source_file").isNotNull() & F.col("key").isNotNull() & F.col("header.chart_no").isNotNull() & F.col("header.package").isin(*PROGRAMS))
    files = files.groupBy(*scope, "source_file").agg(F.min("header.package").alias("_one"), F.max("header.package").alias("_most"))
    chart = chart.join(indexed, scope, "left").join(files, [*scope, "source_file"], "left")
    alone = F.col("_index").isNull()
    by_file = alone & F.col("header.chart_no").rlike(r"(?i)^AD 2-[A-Z]{4}-(SID|STAR|IAC)-\d+$") & (F.col("_one") == F.col("_most")) & (F.col("_one") == F.col("header.package"))
    heading = F.when(F.coalesce(by_file, F.lit(False)), F.concat(F.lit("SOURCE_FILE:"), F.upper("source_file"))).when(alone & tx.chart_kind(F.col("header.chart_no")).isin(*PROGRAMS), F.col("header.chart_no")).otherwise(F.col("key"))
    headed = chart.select(*scope, heading.alias("key"), F.col("page_no").cast("long").alias("ordinal"), "page_no", F.col("header").alias("item"), page, F.lit("HEADER").alias("stage"))
    claims = written(claims.unionByName(headed), "claims")

    made = written(_made(programs, claims, scope), "made")
    free = p.join(claims.select(*scope, "page_no").distinct(), [*scope, "page_no"], "left_anti")

    # 4: tables that follow a chart
    first = claims.where(_parts()["chart"]).groupBy(*scope, "key").agg(F.min_by("page_no", _order()).alias("seed"))
    after = made.join(first, [*scope, "key"]).join(numbered.select(*scope, F.col("page_no").alias("seed"), F.col("number").alias("seed_no")), [*scope, "seed"], "left")
    after = after.withColumn("page_no", F.explode(F.sequence(F.col("seed") + 1, F.col("seed") + REACH)))
    h = lambda c: F.col(f"header.{c}")
    agrees = (h("category").isin("UNKNOWN") | (h("category") == F.col("category"))) & (h("runway").isNull() | F.col("_runway").isNull() | (h("runway") == F.col("_runway"))) & ((h("navigation") == "UNKNOWN") | (F.col("_navigation") == "UNKNOWN") | (h("navigation") == F.col("_navigation")))
    candidates = free.where(F.col("role").isin(*TABLES)).select(*scope, "page_no", "header", "number", page, F.col("names").alias("_own"), F.col("key").alias("_heading"), F.col("category").alias("_category"))
    near = candidates.join(after.select(*scope, "page_no", "key", "package_no", "package", "category", F.col("navigation").alias("_navigation"), F.col("runway").alias("_runway"), "seed_no"), [*scope, "page_no"]).where(agrees & (F.col("number").isNull() | F.col("seed_no").isNull() | follows(F.col("seed_no"), F.col("number"))))
    usable = h("chart_no").isNotNull() & F.col("_heading").isNotNull() & (h("package") != "OTHER")
    plain = F.struct(F.coalesce("number", F.concat(F.lit("P"), F.col("page_no").cast("string"))), F.lit(None), F.col("package"), F.coalesce("_category", F.lit("UNKNOWN")), h("navigation"), F.lit(None), F.coalesce("_own", F.array().cast("array<string>")), F.lit(True), F.lit(None)).cast(ITEM)
    taken = near.withColumn("item", F.when(usable, F.col("header")).otherwise(plain)).groupBy(*scope, "page_no").agg(F.min_by(F.struct("key", "item", "page"), "package_no").alias("b"))
    claims = written(claims.unionByName(taken.select(*scope, "b.key", F.col("page_no").cast("long").alias("ordinal"), "page_no", "b.item", "b.page", F.lit("SEQUENCE").alias("stage"))), "claims")
    return _packages(programs, numbered, claims, made, scope), claims.join(made.select(*scope, "key", "package_no"), [*scope, "key"]).select(*scope, "page_no", "package_no", "stage", *[c.alias(n) for n, c in _parts().items()])


def _order() -> Column:
    """The order in which a package's claims are made."""
    stage = F.when(F.col("stage") == "INDEX", 1).when(F.col("stage") == "FRAGMENT", 2).when(F.col("stage") == "HEADER", 3).otherwise(4)
    # fragments and headings are taken page by page, an index item by item
    return F.struct(stage, F.when(stage == 1, F.col("ordinal")).otherwise(F.lit(0)), F.col("page_no").cast("long"))


def _parts() -> dict[str, Column]:
    """Which lists of its package a claimed page is in."""
    i, p = lambda c: F.col(f"item.{c}"), lambda c: F.col(f"page.{c}")
    listed = F.coalesce(i("tabular"), F.lit(False))
    second = listed & (F.coalesce(i("tabular_no"), F.lit(0)) >= 2) & i("package").isin("SID", "STAR")
    role = F.coalesce(p("role"), F.lit(""))
    coordinate = (role == "WAYPOINT_COORDINATES") | F.coalesce(second, F.lit(False)) | p("coordinates")
    tabular = listed | (role == "TABULAR_DESCRIPTION") | coordinate | p("tabular")
    chart = ~coordinate & (((role == "CHART") & ~listed) | ((role != "MINIMA_TABLE") & ~tabular & ~p("minima")))
    minima = ~coordinate & ~((role == "CHART") & ~listed) & ((role == "MINIMA_TABLE") | (~tabular & p("minima")))
    return {"tabular": tabular, "coordinate": coordinate, "chart": chart, "minima": minima, "supplement": ~coordinate & ~chart & ~minima & tabular}


def follows(seed: Column, number: Column) -> Column:
    """Whether a number is a sub-page of another, or at most REACH pages later in its section."""
    sub = number.startswith(seed) & F.substring(number, F.length(seed) + 1, F.lit(9)).rlike(r"^[-.]\d{1,2}$")
    parts = r"^(AD 2-[A-Z]{4}-\d+)-(\d+)$"
    last = lambda c: tx.extract(c, parts, 2).try_cast("int")
    return F.coalesce(sub | ((tx.extract(seed, parts) == tx.extract(number, parts)) & (last(number) - last(seed)).between(1, REACH)), F.lit(False))


def _made(programs: DataFrame, claims: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, key, package_no, source and what its first item says): packages in the order in which they are made. Of an index, the first item that isn't tabular."""
    tabular = F.coalesce(F.col("item.tabular"), F.lit(False))
    of_index = programs.groupBy(*scope, "key").agg(F.min_by("item", F.struct(tabular, F.col("ordinal"))).alias("first"), F.min("ordinal").cast("long").alias("_at")).withColumn("_stage", F.lit(1))
    headed = claims.where("stage = 'HEADER'").groupBy(*scope, "key").agg(F.min_by("item", "page_no").alias("first"), F.min("page_no").cast("long").alias("_at")).withColumn("_stage", F.lit(2))
    headed = headed.join(of_index.select(*scope, "key"), [*scope, "key"], "left_anti")
    said = claims.groupBy(*scope, "key").agg(
        F.min_by(F.coalesce("item.runway", "page.runway"), F.when(F.coalesce("item.runway", "page.runway").isNotNull(), _order())).alias("_runway"),
        F.min_by("item.navigation", F.when(F.col("item.navigation") != "UNKNOWN", _order())).alias("_navigation"),
    )
    w = Window.partitionBy(*scope).orderBy("_stage", "_at", "key")
    out = of_index.unionByName(headed).withColumn("package_no", F.row_number().over(w)).join(said, [*scope, "key"], "left")
    navigation = F.when(F.col("first.navigation") == "UNKNOWN", F.coalesce("_navigation", F.lit("UNKNOWN"))).otherwise(F.col("first.navigation"))
    return out.select(*scope, "key", "package_no", F.when(F.col("_stage") == 1, "INDEX").otherwise("HEADER").alias("source"), "first", F.col("first.package").alias("package"), F.when(F.col("first.category").isin("ARRIVAL", "DEPARTURE", "APPROACH"), F.col("first.category")).otherwise("UNKNOWN").alias("category"), navigation.alias("navigation"), F.coalesce("first.runway", "_runway").alias("runway"))


def package_name(package: Column, navigation: Column, runway: Column, names: Column) -> Column:
    """The first name of an approach, else what it flies by and to; of others the runway, the navigation, the kind and all names."""
    some = lambda *c: F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in c])
    spoken = F.when(navigation == "DME_ARC", "11 DME ARC").otherwise(navigation)
    return F.when(package == "APPROACH", F.coalesce(F.nullif(F.get(names, F.lit(0)), F.lit("")), some(navigation, runway))).otherwise(some(runway, spoken, package, F.array_join(names, " ")))


def _packages(programs: DataFrame, numbered: DataFrame, claims: DataFrame, made: DataFrame, scope: list[str]) -> DataFrame:
    parts = _parts()
    pages = {n: F.array_sort(F.collect_set(F.when(c, F.col("page_no")))).alias(f"{n}_pages") for n, c in parts.items()}
    ordered = lambda value, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(_order().alias("o"), value.alias("v"))))), lambda x: x["v"])
    number = F.coalesce("item.chart_no", "page.number", F.concat(F.lit("P"), F.col("page_no").cast("string")))
    nothing = F.array().cast("array<string>")
    names = F.concat(F.coalesce("item.names", nothing), F.coalesce("page.names", nothing))
    got = claims.groupBy(*scope, "key").agg(
        *pages.values(), F.array_sort(F.collect_set("page_no")).alias("pages"), ordered(number, F.lit(True)).alias("_numbers"), ordered(names, F.lit(True)).alias("_names"),
        F.min_by(F.coalesce("item.chart_no", "page.number"), F.when(parts["chart"], _order())).alias("_chart_no"), F.min_by("page_no", F.when(parts["chart"], _order())).alias("chart_page"),
        F.bool_or(F.col("stage").isin("FRAGMENT", "SEQUENCE")).alias("_odd"),
        F.min_by(F.coalesce("item.runway", "page.runway"), F.when(F.coalesce("item.runway", "page.runway").isNotNull(), _order())).alias("_runway"), F.min_by("item.navigation", F.when(F.col("item.navigation") != "UNKNOWN", _order())).alias("_navigation"),
    )
    # of an index: its numbers, those without a page, and those that several pages have
    counted = numbered.groupBy(*scope, F.col("number").alias("_no")).agg(F.count(F.lit(1)).alias("_pages"))
    seen = claims.where("stage = 'INDEX'").select(*scope, "ordinal", F.lit(True).alias("_seen")).distinct()
    repaired = claims.where("stage = 'FRAGMENT'").select(*scope, F.col("item.chart_no").alias("_no"), F.lit(True).alias("_repaired")).distinct()
    listed = programs.withColumn("_no", F.col("item.chart_no")).join(counted, [*scope, "_no"], "left").join(seen, [*scope, "ordinal"], "left").join(repaired, [*scope, "_no"], "left")
    of_items = listed.groupBy(*scope, "key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("_no").alias("v")))), lambda x: x["v"]).alias("_listed"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_seen").isNull() & F.col("_repaired").isNull(), F.struct("ordinal", F.col("_no").alias("v"))))), lambda x: x["v"]).alias("unmatched"),
        F.bool_or(F.col("_seen").isNull() | (F.coalesce("_pages", F.lit(0)) > 1)).alias("_doubt"),
    )
    df = made.join(got, [*scope, "key"], "left").join(of_items, [*scope, "key"], "left")
    empty = F.array().cast(claims.select(F.array("page_no").alias("a")).schema["a"].dataType)
    numbers = F.array_compact(F.array_distinct(F.concat(F.coalesce("_listed", nothing), F.coalesce("_numbers", nothing))))
    df = df.withColumn("chart_nos", numbers).withColumn("names", F.array_distinct(F.concat(F.coalesce("first.names", nothing), F.flatten(F.coalesce("_names", F.array().cast("array<array<string>>"))))))
    runway = F.coalesce("runway", "_runway")
    navigation = F.when(F.col("navigation") == "UNKNOWN", F.coalesce("_navigation", F.lit("UNKNOWN"))).otherwise(F.col("navigation"))
    df = df.withColumn("runway", runway).withColumn("navigation", navigation)
    chart_no = F.coalesce(F.when(~F.coalesce("first.tabular", F.lit(False)), F.col("first.chart_no")), "_chart_no", F.get("chart_nos", F.lit(0)))
    confidence = F.when(F.col("source") == "INDEX", INDEX_CONFIDENCE).otherwise(HEADER_CONFIDENCE)
    review = (confidence < SURE) | F.coalesce("_doubt", F.lit(False)) | F.coalesce("_odd", F.lit(False)) | (F.coalesce(F.size("chart_pages"), F.lit(0)) <= 0)
    return df.select(
        *scope, "package_no", F.concat_ws("_", F.lit("pkg"), F.col("package_no").cast("string"), tx.hash31(F.col("key"))).alias("package_id"), "key", package_name(F.col("package"), F.col("navigation"), F.col("runway"), F.col("names")).alias("name"),
        "package", "category", "navigation", "runway", chart_no.alias("chart_no"), "chart_page", "chart_nos", "names", F.coalesce("pages", empty).alias("pages"), *[F.coalesce(f"{n}_pages", empty).alias(f"{n}_pages") for n in parts],
        F.coalesce("unmatched", nothing).alias("unmatched"), "source", confidence.alias("confidence"), review.alias("review"),
    )
