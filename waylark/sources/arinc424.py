"""Fixed-width navigation records (132 columns): reading text into legs, and writing legs as text.

Lines are padded to 132 columns and not trimmed on the left, so that records
whose tail is blank are read by position too. Records of one leg (a primary and
its continuations) are merged by airport, procedure, runway, transition and
sequence, in the order of the file. Columns below count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions import text as tx
from waylark.functions.tolerance import round_half_up

WIDTH = 132
#: Fixed values: (first column, length) of each field.
LAYOUT = {
    "head": (0, 5), "airport": (6, 4), "region": (10, 2), "subsection": (12, 1), "route_code": (13, 6), "route_type": (19, 1), "qualifier": (20, 5),
    "sequence": (26, 3), "fix": (29, 5), "fix_region": (34, 2), "fix_section": (36, 2), "continuation": (38, 1), "application": (39, 1), "end_flag": (40, 1), "holding": (42, 1), "turn": (43, 1),
    "terminator": (47, 2), "navaid": (50, 4), "theta": (62, 4), "rho": (66, 4), "course": (70, 4), "distance": (74, 4), "altitude_sign": (82, 1), "altitude_1": (84, 5), "altitude_2": (89, 5), "speed": (99, 3), "center_fix": (106, 5),
}
TERMINATORS = "IF TF CA CI CR AF CF DF RF FM FA FC FD VM VA VI VD VR PI HM HF HA".split()
#: Terminators of legs without a fix of their own, and those that carry a course or a recommended aid.
NO_FIX, WITH_COURSE, WITH_NAVAID = ["CA", "CI", "CR", "VA", "VI"], ["AF", "CA", "CF", "CI", "CR"], ["AF", "CI", "CR", "CF"]


def field(line: Column, name: str) -> Column:
    """A field as it stands, blanks and all."""
    first, n = LAYOUT[name]
    return F.substring(line, first + 1, n)


def digits(line: Column, name: str) -> Column:
    """The number in a field that is all digits, else null."""
    value = field(line, name)
    return F.when(value.rlike(r"^\d+$"), value.cast("double"))


def altitude(token: Column) -> Column:
    """Feet of five digits or of a flight level."""
    level = F.regexp_extract(token, r"^FL(\d{2,3})$", 1)
    return F.when(level != "", level.try_cast("double") * 100).when(token.rlike(r"^\d{4,5}$"), token.try_cast("double"))


def within(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def read_lines(text: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """(source, ordinal, line): whole texts cut into padded lines that keep their order."""
    source = F.col(id_col) if id_col else F.lit(0)
    return text.select(source.alias("source"), F.posexplode(F.split(text_col, "\r?\n")).alias("ordinal", "line")).withColumn("line", F.rpad("line", WIDTH, " "))


def parse_records(lines: DataFrame) -> DataFrame:
    """A row for each record that is one: its route, its leg's fields, and what kind of record it is (PRIMARY, DISTANCE, EXTENSION)."""
    l = F.col("line")
    code, q = F.trim(field(l, "route_code")), F.trim(field(l, "qualifier"))
    runway = F.regexp_extract(F.substring(l, 21, 6), r"^(RW\d{2}[A-Z]?)", 1)
    enroute = (runway == "") & field(l, "route_type").isin("3", "6") & q.rlike("^[A-Z0-9]{2,5}$")
    common = (runway == "") & ~field(l, "route_type").isin("3", "6") & q.isin("", "ALL")
    cont = field(l, "continuation")
    kind = F.when(cont == "1", "PRIMARY").when((cont == "2") & (field(l, "application") == "P"), "DISTANCE").when(cont.rlike("^[2-9]$"), "EXTENSION")
    good = l.rlike(r"^S[A-Z]{3}P\s") & field(l, "airport").rlike("^[A-Z]{4}$") & field(l, "region").rlike("^[A-Z]{2}$") & field(l, "subsection").rlike("^[DEF]$") & code.rlike("^[A-Z0-9]{4,6}$") & field(l, "sequence").rlike(r"^\d{3}$")
    desc = field(l, "altitude_sign")
    token = F.trim(field(l, "altitude_1"))
    primary = F.trim(field(l, "navaid"))
    center = F.trim(field(l, "center_fix"))
    is_main = F.col("kind") == "PRIMARY"
    main = lambda c: F.when(is_main, c)
    rows = lines.where(good & ((runway != "") | enroute | common)).withColumn("kind", kind).where("kind is not null")
    return rows.select(
        "source", "ordinal", "line", "kind",
        field(l, "airport").alias("airport"), field(l, "subsection").alias("subsection"), code.alias("route_key"),
        F.when(field(l, "route_type").rlike("^[0-9A-Z]$"), field(l, "route_type")).alias("route_type"),
        runway.alias("runway"), F.when(enroute, q).alias("transition_name"), F.when(runway != "", "RUNWAY").when(enroute, "ENROUTE").otherwise("COMMON").alias("branch_role"),
        field(l, "sequence").alias("sequence"), F.trim(field(l, "fix")).alias("fix"), main(F.nullif(F.trim(field(l, "fix_section")), F.lit(""))).alias("fix_section"),
        main(F.when(field(l, "terminator").rlike("^[A-Z]{2}$"), field(l, "terminator"))).alias("path_terminator"),
        main(F.when(field(l, "turn").isin("L", "R"), field(l, "turn"))).alias("turn_direction"),
        main(F.when(altitude(token).isNotNull(), F.concat(F.when(desc.isin("+", "-", "B"), desc).otherwise(""), token))).alias("altitude_raw"),
        main(altitude(token)).alias("altitude_value"),
        main(F.when(altitude(token).isNotNull(), F.when(desc.isin("+", "-"), desc).otherwise(""))).alias("altitude_sign"),
        main(within(altitude(F.trim(field(l, "altitude_2"))), 500, 60000)).alias("altitude_upper_ft"),
        main(within(digits(l, "course") / 10, 0, 360)).alias("course_deg"), main(within(digits(l, "theta") / 10, 0, 360)).alias("theta_deg"), main(digits(l, "rho") / 10).alias("rho_nm"),
        main(within(digits(l, "speed"), 100, 400)).alias("speed_limit"),
        main(F.when(primary.rlike("^[A-Z]{2,4}$"), primary).when(center.rlike("^[A-Z][A-Z0-9]{1,4}$"), center)).alias("recommended_navaid"),
        (is_main & (field(l, "holding") == "H")).alias("holding_at_fix"), (is_main & (field(l, "end_flag") == "E")).alias("end_of_procedure"),
        F.when(F.col("kind") == "DISTANCE", digits(l, "distance") / 10).alias("distance_nm"),
        F.when(~is_main, F.struct(F.concat(cont, F.trim(field(l, "application"))).alias("continuation_type"), F.when(F.col("kind") == "DISTANCE", field(l, "distance")).otherwise(l).alias("raw_value"), F.when(F.col("kind") == "DISTANCE", "DISTANCE").otherwise("VENDOR_EXTENSION").alias("interpreted_as"))).alias("extension"),
    )


#: Terminators as they are looked for in records without columns, and how the rest of such a record begins: with a fix, a distance alone, or no fix.
TERMINATORS = ["IF", "TF", "CA", "CI", "CR", "AF", "CF", "DF", "RF", "FM", "FA", "FC", "FD", "VM", "VA", "VI", "VD", "VR", "PI", "HM", "HF", "HA"]
SHORT_FIX = r"(\d{3})([A-Z0-9]{5})([A-Z0-9]{4})(1[A-Z]{1,4}|2P)(?:\b|$)"
SHORT_DISTANCE = r"(\d{3})\s+2P(?:\s|$)"
SHORT_NO_FIX = rf"(\d{{3}})\s+([123][A-Z]?)\s+(?:([LR])\s+)?({'|'.join(TERMINATORS)})(?=[A-Z0-9\s]|$)"


def parse_short(lines: DataFrame) -> DataFrame:
    """Rows like those of ``parse_records`` for records whose columns have shifted, such as pasted ones.

    The route stands in its columns. What follows it is read by the first of three
    beginnings that is there, after the route or else anywhere; then terminator, turn,
    altitude and distance by the first or last text of their shape in what is left of
    the line behind that. Fields that only columns tell stay null. Lines that no beginning
    fits give no rows.
    """
    l = F.rtrim("line")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    at = F.when(F.substring(l, 20, 2) == "RW", 20).otherwise(21)
    runway = F.regexp_extract(F.substring(l, at, F.lit(6)), r"^(RW\d{2}[A-Z]?)", 1)
    q = F.trim(field(l, "qualifier"))
    enroute = (runway == "") & field(l, "route_type").isin("3", "6") & q.rlike("^[A-Z0-9]{2,5}$")
    code = F.trim(field(l, "route_code"))
    good = l.rlike(r"^S[A-Z]{3}P\s") & field(l, "airport").rlike("^[A-Z]{4}$") & field(l, "region").rlike("^[A-Z]{2}$") & field(l, "subsection").rlike("^[DEF]$") & code.rlike("^[A-Z0-9]{4,6}$") & ((runway != "") | enroute)
    df = lines.where(good).withColumn("_l", l).withColumn("_runway", runway).withColumn("_enroute", enroute).withColumn("_q", q)
    after = F.substring(F.col("_l"), F.when(F.col("_runway") != "", at + F.length("_runway")).otherwise(21 + F.length("_q")), F.lit(1 << 20))
    places = [(where, p) for where in (after, F.col("_l")) for p in (SHORT_FIX, SHORT_DISTANCE, SHORT_NO_FIX)]
    of = lambda where, p: F.struct(F.lit(p).alias("kind"), F.regexp_extract(where, p, 0).alias("all"), *[F.regexp_extract(where, p, i).alias(f"g{i}") if i <= {SHORT_FIX: 4, SHORT_DISTANCE: 1, SHORT_NO_FIX: 4}[p] else F.lit("").alias(f"g{i}") for i in (1, 2, 3, 4)])
    begun = None
    for where, p in places:
        begun = F.when(where.rlike(p), of(where, p)) if begun is None else begun.when(where.rlike(p), of(where, p))
    df = df.withColumn("_b", begun).where("_b is not null")
    b = lambda c: F.col(f"_b.{c}")
    named, bare = b("kind") == SHORT_FIX, b("kind") == SHORT_NO_FIX
    distance = (named & b("g4").startswith("2P")) | (b("kind") == SHORT_DISTANCE) | (bare & b("g2").startswith("2P"))
    df = df.withColumn("kind", F.when(distance, "DISTANCE").otherwise("PRIMARY")).withColumn("_rest", F.substring(F.col("_l"), F.instr(F.col("_l"), b("all")) + F.length(b("all")), F.lit(1 << 20)))
    rest, main = F.col("_rest"), F.col("kind") == "PRIMARY"
    last = lambda p, g=1: F.try_element_at(F.regexp_extract_all(rest, F.lit(p), F.lit(g)), F.lit(-1))
    spaced = F.nullif(F.regexp_extract("_l", rf"(?:^|[^A-Z])({'|'.join(TERMINATORS)})(?:[^A-Z]|$)", 1), F.lit(""))
    behind = F.regexp_replace("_l", r"^.*\d{3}[A-Z0-9]{5}[A-Z0-9]{4}1E+", "")
    glued = F.coalesce(*[F.when(behind.contains(t), F.lit(t)) for t in TERMINATORS])
    terminator = F.when(bare, b("g4")).otherwise(F.coalesce(spaced, glued))
    turn = F.coalesce(F.when(bare, F.nullif(b("g3"), F.lit(""))), F.nullif(F.regexp_extract(rest, r"(?:^|\s)([LR])(?:\s|$)", 1), F.lit("")))
    signed = last(r"([+-]\s*\d{4,5})\b")
    plain = F.try_element_at(F.filter(F.regexp_extract_all(rest, F.lit(r"\b(\d{4,5})\b"), F.lit(1)), lambda x: x.cast("int").between(1000, 60000)), F.lit(-1))
    raw = F.coalesce(F.regexp_replace(signed, r"\s+", ""), plain)
    miles = last(r"\b(\d{4})\b").cast("double") / 10
    only = lambda c: F.when(main, c)
    extension = F.when(~main, F.struct(F.lit("2P").alias("continuation_type"), text.alias("raw_value"), F.when(miles.isNotNull(), "DISTANCE").otherwise("UNKNOWN").alias("interpreted_as")))
    fields = {
        "airport": field(F.col("_l"), "airport"), "subsection": field(F.col("_l"), "subsection"), "route_key": F.trim(field(F.col("_l"), "route_code")), "route_type": F.when(field(F.col("_l"), "route_type").rlike("^[0-9A-Z]$"), field(F.col("_l"), "route_type")),
        "runway": F.col("_runway"), "transition_name": F.when(F.col("_enroute"), F.col("_q")), "branch_role": F.when(F.col("_runway") != "", "RUNWAY").otherwise("ENROUTE"), "sequence": b("g1"), "fix": F.when(named, b("g2")).otherwise(""),
        "fix_section": only(F.when(named, F.substring(b("g3"), 3, 2))), "path_terminator": only(terminator), "turn_direction": only(turn), "altitude_raw": only(raw), "altitude_value": only(F.regexp_replace(raw, "^[+-]", "").cast("double")),
        "altitude_sign": only(F.when(raw.isNotNull(), F.regexp_extract(raw, "^([+-]?)", 1))), "altitude_upper_ft": number, "course_deg": number, "theta_deg": number, "rho_nm": number, "speed_limit": number, "recommended_navaid": text,
        "holding_at_fix": F.lit(False), "end_of_procedure": main & named & (F.substring(b("g4"), 3, 1) == "E"), "distance_nm": F.when(~main, miles), "extension": extension,
    }
    return df.select("source", "ordinal", "line", "kind", *[c.alias(n) for n, c in fields.items()])


def parse_lines(lines: DataFrame) -> DataFrame:
    """Records of both grammars: by columns where a line has them, by shape where it hasn't."""
    fixed = parse_records(lines)
    rest = lines.join(fixed.select("source", "ordinal"), ["source", "ordinal"], "left_anti")
    short = parse_short(rest)
    return fixed.unionByName(short.select(fixed.columns))


#: The merge key has the airport too, so that files of several airports don't mix.
LEG_KEY = ["source", "airport", "route_key", "runway", "transition_name", "sequence"]
LAST_KNOWN = ["subsection", "route_type", "branch_role", "fix_section", "path_terminator", "turn_direction", "altitude_raw", "altitude_value", "altitude_sign", "altitude_upper_ft", "course_deg", "theta_deg", "rho_nm", "speed_limit", "recommended_navaid", "distance_nm"]


def merge_continuations(records: DataFrame, key: list[str] = LEG_KEY, last_known: list[str] = LAST_KNOWN) -> DataFrame:
    """One row for each leg: of each field the last value that is there, by the order of records; flags if any record has them; extensions and lines collected."""
    known = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in last_known]
    return records.groupBy(*key).agg(
        *known,
        F.min_by("fix", F.when(F.col("fix") != "", F.col("ordinal"))).alias("fix"),
        F.bool_or("holding_at_fix").alias("holding_at_fix"), F.bool_or("end_of_procedure").alias("end_of_procedure"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("extension").isNotNull(), F.struct("ordinal", "extension")))), lambda x: x["extension"]).alias("extensions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: F.rtrim(x["line"])), "\n").alias("raw_record"),
        F.min("ordinal").alias("first_ordinal"),
    ).withColumn("fix", F.coalesce("fix", F.lit("")))


def procedure_name(route_key: Column, names: dict[str, str] | None = None) -> Column:
    """The name that a table gives a code, else AAAA9X as "AAAA 9X", else the code."""
    spaced = F.regexp_replace(route_key, r"^([A-Z]{4})(\d[A-Z])$", "$1 $2")
    if not names:
        return spaced
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), route_key), spaced)


def read_legs(text: DataFrame, text_col: str = "text", id_col: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Legs of whole texts, with the procedure's name and type."""
    legs = merge_continuations(parse_lines(read_lines(text, text_col, id_col)))
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("D", "SID", "E", "STAR", "F", "APPROACH")]), F.col("subsection"))
    return legs.withColumn("procedure_name", procedure_name(F.col("route_key"), names)).withColumn("procedure_type", kind)


# ---------------------------------------------------------------- writing


def _put(line: Column, first: int, value: Column, n: int) -> Column:
    return F.overlay(line, F.rpad(value, n, " "), F.lit(first + 1), F.lit(n))


def _number(value: Column, n: int, times: float = 1) -> Column:
    return F.coalesce(F.lpad(round_half_up(value * times).cast("long").cast("string"), n, "0"), F.lit(" " * n))


def leg_errors(airport: Column) -> Column:
    """Why a leg can't be written: an array of texts, empty where it can."""
    c = F.col
    no = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), F.lit(text))
    has_transition = F.coalesce(c("transition_name") != "", F.lit(False))
    return F.array_compact(F.array(
        no(airport.rlike("^[A-Z]{4}$"), "airport"),
        F.when(has_transition, no(c("transition_name").rlike("^[A-Z0-9]{2,5}$"), "transition")).otherwise(no(c("runway").rlike(r"^RW\d{2}[A-Z]?$"), "runway")),
        no(F.lpad(c("sequence"), 3, "0").rlike(r"^\d{3}$") & (F.length("sequence") <= 3), "sequence"),
        no(F.length(F.coalesce("fix", F.lit(""))) <= 5, "fix"),
        no(F.length("route_code") == 6, "route code"),
        no(c("distance_nm").isNull() | (round_half_up(c("distance_nm") * 10) <= 9999), "distance"),
    ))


def write_records(legs: DataFrame, airport: Column, order: list[str], area: str = "SPA", subsection: str = "E", holding_fixes: list[str] = (), source: list[str] = ()) -> DataFrame:
    """``legs`` with route_code, errors, primary and continuation: two lines for each leg without errors, nulls for the rest.

    ``order`` are the columns that a branch's legs follow each other by; the first
    leg's section is EA unless it has one, the others' PC, and the last leg ends the
    procedure unless flags say which does. ``source`` are columns that tell branches of
    the same names apart, such as a file's.
    """
    from pyspark.sql import Window

    branch = Window.partitionBy(*source, "procedure_name", "runway", "transition_name")
    by = branch.orderBy(*order)
    c = F.col
    rows = legs.withColumn("route_code", tx.route_code(c("procedure_name"))).withColumn("_n", F.row_number().over(by)).withColumn("_of", F.count(F.lit(1)).over(branch))
    rows = rows.withColumn("errors", leg_errors(airport))
    fix, pt, region = F.coalesce("fix", F.lit("")), F.upper(F.coalesce("path_terminator", F.lit(""))), F.substring(airport, 1, 2)
    section = F.coalesce("fix_section", F.when((fix == "") & pt.isin(NO_FIX), "").when(c("_n") == 1, "EA").otherwise("PC"))
    named = F.coalesce(c("transition_name") != "", F.lit(False))
    base = F.rpad(F.lit(f"S{area}P"), WIDTH, " ")
    for first, value, n in ((6, airport, 4), (10, region, 2), (12, F.lit(subsection), 1), (13, c("route_code"), 6), (19, F.when(named, "3").otherwise("2"), 1), (20, F.when(named, c("transition_name")).otherwise(c("runway")), 5), (26, F.lpad("sequence", 3, "0"), 3), (29, fix, 5), (34, F.when((fix != "") | (section != ""), region).otherwise(""), 2), (36, section, 2)):
        base = _put(base, first, value, n)
    last = F.coalesce("end_of_procedure", c("_n") == c("_of"))
    hold = F.coalesce("holding_at_fix", F.lit(False)) | (fix.isin(list(holding_fixes)) if holding_fixes else F.lit(False))
    aid = F.coalesce("recommended_navaid", F.lit(""))
    line = base
    for first, value, n in (
        (38, F.lit("1"), 1), (39, F.when(last, "EE").otherwise("E"), 2), (42, F.when(hold, "H").otherwise(""), 1), (43, F.when(c("turn_direction").isin("L", "R"), c("turn_direction")).otherwise(""), 1), (47, pt, 2),
        (50, F.when((aid != "") & pt.isin(WITH_NAVAID), aid).otherwise(""), 4), (54, F.when((aid != "") & pt.isin(WITH_NAVAID), region).otherwise(""), 2),
        (70, F.when(pt.isin(WITH_COURSE), _number(c("course_deg"), 4, 10)).otherwise(""), 4),
        (82, F.when(c("altitude_value").isNotNull(), F.coalesce("altitude_sign", F.lit(""))).otherwise(""), 1), (84, _number(c("altitude_value"), 5), 5), (89, _number(c("altitude_upper_ft"), 5), 5), (99, _number(c("speed_limit"), 3), 3),
        (106, F.when((aid != "") & pt.isin("IF", "CA"), aid).otherwise(""), 4), (112, F.when((aid != "") & pt.isin("IF", "CA"), F.concat(region, F.lit("D"))).otherwise(""), 3), (118, F.when(c("route_code").endswith("G"), "DG").otherwise(" D"), 2),
    ):
        line = _put(line, first, value, n)
    more = _put(_put(base, 38, F.lit("2P"), 2), 74, F.when(c("distance_nm") > 0, _number(c("distance_nm"), 4, 10)).otherwise(""), 4)
    ok = F.size("errors") == 0
    return rows.withColumn("primary", F.when(ok, line)).withColumn("continuation", F.when(ok, more)).drop("_n", "_of")
