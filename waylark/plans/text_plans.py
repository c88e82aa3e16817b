"""Queries of page text, names and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions import text as tx

from .common import AIP_PAGES, NAMES, PHRASES, RUNWAYS, aip_pages, pick, quoted, sql_pick, sql_round, sql_rules, table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            S[name] = sql
        return f

    return keep


_UP = "upper(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_NAV = [("RNP_AR", r"RNP\s+Z\s*\(AR\)|\(\s*AR\s*\)"), ("DME_ARC", r"DME\s*ARC")]
_WORDS = " ".join(f"WHEN {' AND '.join(f'regexp_matches(up, {quoted(chr(92) + "b" + w + chr(92) + "b")})' for w in n.split('_'))} THEN '{n}'" for n in tx.NAVIGATION_WORDS)
_CLASSIFIED = f"""
c AS (SELECT page_no, text, up,
  {sql_rules('up', tx.PAGE_ROLES, "CASE WHEN length(up) < 30 THEN 'UNKNOWN' ELSE 'OTHER' END")} AS role,
  {sql_rules('up', tx.CATEGORIES, "'UNKNOWN'")} AS category,
  {sql_rules('up', tx.NAVIGATION_LOOSE, "'UNKNOWN'")} AS navigation,
  {sql_rules('up', tx.SUPPORT_TYPES, 'NULL')} AS support,
  nullif(regexp_replace('RWY' || regexp_extract(up, {quoted(tx.RUNWAY)}, 1), '\\s+', '', 'g'), 'RWY') AS runway
  FROM (SELECT page_no, text, {_UP} AS up FROM p))"""


def classified(spark, sf_dir):
    p = aip_pages(spark, sf_dir).withColumn("up", F.upper(tx.squeezed(F.col("text"))))
    up = F.col("up")
    return p.select("page_no", "text", "up", tx.page_role(up).alias("role"), tx.page_category(up).alias("category"), tx.navigation_loose(up).alias("navigation"), tx.support_type(up).alias("support"), tx.runway(up).alias("runway"))


@query("rule_classify_pages", f"""
WITH p AS ({AIP_PAGES}), {_CLASSIFIED},
s AS (SELECT *, CASE category WHEN 'ARRIVAL' THEN 'STAR' WHEN 'DEPARTURE' THEN 'SID' WHEN 'APPROACH' THEN 'APPROACH' WHEN 'AERODROME' THEN 'AERODROME' ELSE 'OTHER' END AS package FROM c)
SELECT page_no, role, category, navigation, coalesce(support, '-') AS support, coalesce(runway, '-') AS runway, package,
  CASE {' '.join(f"WHEN regexp_matches(up, {quoted(p)}) THEN '{n}'" for n, p in _NAV)} {_WORDS} WHEN package IN ('SID', 'STAR') THEN 'CONVENTIONAL' ELSE 'UNKNOWN' END AS navigation_strict
FROM s""")
def rule_classify_pages(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("package", tx.package_type(F.col("category")))
    return c.select("page_no", "role", "category", "navigation", F.coalesce("support", F.lit("-")).alias("support"), F.coalesce("runway", F.lit("-")).alias("runway"), "package", tx.navigation_words(F.col("up"), F.col("package")).alias("navigation_strict"))


#: As SQL's engine has no lookahead, a further digit of the page takes what follows it along; other than digits are dropped then.
_NUMERIC = r"A\s*D\s*-?\s*2\s*-\s*([A-Z]\s*[A-Z]\s*[A-Z]\s*[A-Z])\s*-\s*([0-9]{1,2})\s*-\s*([0-9]{1,2}(?:\s+[0-9](?:[^0-9]|$))?)"


def _numeric_sql(text: str) -> str:
    part = lambda n, drop: f"regexp_replace(regexp_extract({text}, {quoted(_NUMERIC)}, {n}), '{drop}', '', 'g')"
    return f"CASE WHEN TRY_CAST({part(2, '[^0-9]')} AS INT) > 0 AND TRY_CAST({part(3, '[^0-9]')} AS INT) BETWEEN 1 AND 99 THEN 'AD 2-' || {part(1, '[^A-Z]')} || '-' || CAST({part(2, '[^0-9]')} AS INT) || '-' || CAST({part(3, '[^0-9]')} AS INT) END"


_CHART_NO = f"""
  coalesce(
    {_numeric_sql('u')},
    CASE WHEN regexp_matches(u, {quoted(tx.LETTERED_NO)}) THEN 'AD 2-' || regexp_extract(u, {quoted(tx.LETTERED_NO)}, 1) || '-' || regexp_extract(u, {quoted(tx.LETTERED_NO)}, 2) END,
    CASE WHEN regexp_matches(raw, {quoted(tx.KOREAN_NO)}) THEN 'AD 2-' || regexp_extract(raw, {quoted(tx.KOREAN_NO)}, 1) || '-' || CAST(regexp_extract(raw, {quoted(tx.KOREAN_NO)}, 2) AS INT) || CASE WHEN regexp_extract(raw, {quoted(tx.KOREAN_NO)}, 4) <> '' THEN '-' || CAST(regexp_extract(raw, {quoted(tx.KOREAN_NO)}, 4) AS INT) ELSE '' END END,
    CASE WHEN regexp_matches(raw, {quoted(tx.JAPANESE_NO)}) THEN 'AD 2-' || regexp_extract(raw, {quoted(tx.JAPANESE_NO)}, 1) || '-' || regexp_extract(raw, {quoted(tx.JAPANESE_NO)}, 2) END)"""


@query("chart_no_dialects", f"""
WITH p AS (SELECT doc_id AS page_no, {sql_pick(PHRASES, 'doc_id')} AS raw FROM documents),
n AS (SELECT page_no, raw, {_CHART_NO} AS no FROM (SELECT page_no, raw, upper(raw) AS u FROM p)),
k AS (SELECT *, nullif(regexp_extract(upper(no), '^AD 2-[A-Z]{{4}}-([A-Z][A-Z0-9]*)', 1), '') AS seg FROM n)
SELECT page_no, no AS chart_no, CASE WHEN seg IN ('SID', 'STAR') THEN seg WHEN seg = 'IAC' THEN 'APPROACH' WHEN seg IS NOT NULL THEN 'OTHER' END AS kind,
  regexp_replace(no, '[-.][0-9]{{1,2}}$', '') AS parent_no,
  len(regexp_extract_all(upper(raw), {quoted(tx.LETTERED_NO)})) AS n_lettered
FROM k""")
def chart_no_dialects(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_no"), pick(PHRASES, F.col("doc_id")).alias("raw")).withColumn("chart_no", tx.chart_no(F.col("raw")))
    return p.select("page_no", "chart_no", tx.chart_kind(F.col("chart_no")).alias("kind"), F.regexp_replace("chart_no", r"[-.]\d{1,2}$", "").alias("parent_no"), F.regexp_count(F.upper("raw"), F.lit(tx.LETTERED_NO)).cast("long").alias("n_lettered"))


@query("page_confidence", f"""
WITH p AS ({AIP_PAGES}), {_CLASSIFIED},
n AS (SELECT c.*, {_CHART_NO} AS no FROM (SELECT c.*, upper(text) AS u, text AS raw FROM c) c)
SELECT page_no, no AS chart_no, confidence, confidence < 0.72 OR role = 'UNKNOWN' OR category = 'UNKNOWN' AS review FROM (
  SELECT page_no, role, category, no, floor(least(0.35 + CASE WHEN role NOT IN ('UNKNOWN', 'OTHER') THEN 0.2 ELSE 0 END + CASE WHEN category <> 'UNKNOWN' THEN 0.16 ELSE 0 END
    + CASE WHEN navigation <> 'UNKNOWN' THEN 0.12 ELSE 0 END + CASE WHEN no IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN runway IS NOT NULL THEN 0.07 ELSE 0 END, 0.98)::DOUBLE * 100 + 0.5) / 100 AS confidence FROM n)""")
def page_confidence(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("chart_no", tx.chart_no(F.col("text")))
    c = c.withColumn("confidence", tx.page_confidence(F.col("role"), F.col("category"), F.col("navigation"), F.col("chart_no"), F.col("runway")))
    return c.select("page_no", "chart_no", "confidence", ((F.col("confidence") < tx.REVIEW_BELOW) | (F.col("role") == "UNKNOWN") | (F.col("category") == "UNKNOWN")).alias("review"))


@query("likely_page_no")
def likely_page_no(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("page_id", tx.likely_page_no(F.col("text")))
    return c.select("page_no", "page_id", tx.role_override(F.col("role"), F.col("page_id")).alias("role"))


_SHIFT = [c for c in range(0x03, 0x3E) if c not in (0x0A, 0x0D)]
_ENC, _DEC = "".join(map(chr, _SHIFT)), "".join(chr(c + 0x1D) for c in _SHIFT)


@query("decode_text", f"""
WITH e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN translate({sql_pick(PHRASES, 'doc_id')}, {quoted(_DEC)}, {quoted(_ENC)}) WHEN 1 THEN '' WHEN 2 THEN repeat('�', 5) || lang ELSE {sql_pick(PHRASES, 'doc_id')} END AS raw FROM documents),
d AS (SELECT doc_id, raw, regexp_matches(raw, '[\\x03\\x0e\\x10\\x11\\x13-\\x1c]') AS enc FROM e)
SELECT doc_id, CASE WHEN enc THEN translate(raw, {quoted(_ENC)}, {quoted(_DEC)}) ELSE raw END AS plain,
  CASE WHEN trim(raw) = '' THEN 'EMPTY' WHEN doc_id % 4 = 2 THEN 'SUSPECT' WHEN enc THEN 'DECODED' ELSE 'USABLE' END AS quality FROM d""")
def decode_text(spark, sf_dir):
    n = F.col("doc_id")
    raw = F.when(n % 4 == 0, F.translate(pick(PHRASES, n), _DEC, _ENC)).when(n % 4 == 1, "").when(n % 4 == 2, F.concat(F.repeat(F.lit("�"), 5), F.col("lang"))).otherwise(pick(PHRASES, n))
    d = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return d.select("doc_id", tx.decode_shifted(F.col("raw")).alias("plain"), tx.text_quality(F.col("raw")).alias("quality"))


_CLEAN = f"regexp_replace(upper(trim(regexp_replace(name, '\\s+', ' ', 'g'))), {quoted(tx.RUNWAY_SUFFIX)}, '')"
_DW = "|".join(tx.DIGIT_WORDS)
_DIGIT = f"CAST(list_position(ARRAY[{', '.join(map(quoted, tx.DIGIT_WORDS))}], %s) - 1 AS VARCHAR)"


def _ids(base: str, n: str) -> tuple[str, str]:
    wordy, compact = rf"^([A-Z]{{2,{n}}})\s+({_DW})(\s+([A-Z]))?$", rf"^([A-Z]{{2,{n}}})\s*(\d[A-Z]?)$"
    w = lambda g: f"regexp_extract({base}, {quoted(wordy)}, {g})"
    c = lambda g: f"regexp_extract({base}, {quoted(compact)}, {g})"
    fix = f"coalesce(nullif({w(1)}, ''), nullif({c(1)}, ''))"
    suffix = f"CASE WHEN {w(1)} <> '' THEN {_DIGIT % w(2)} || {w(4)} ELSE nullif({c(2)}, '') END"
    return fix, suffix


_F8, _S8 = _ids("b8", "8")
_F5, _S5 = _ids("b5", "5")


@query("procedure_names", f"""
WITH n AS (SELECT doc_id, {sql_pick(NAMES, 'doc_id')} AS name, {sql_pick(RUNWAYS, 'doc_id')} AS rw FROM documents),
c AS (SELECT *, {_CLEAN} AS clean FROM n),
b AS (SELECT *, regexp_replace(clean, '\\s+(DEPARTURE|ARRIVAL|DEP|ARR)\\.?$', '') AS b8, regexp_replace(clean, '\\s+(DEPARTURE|ARRIVAL)$', '') AS b5 FROM c),
i AS (SELECT *, {_F8} || {_S8} AS procedure_id, {_F5} AS f5, {_S5} AS s5 FROM b)
SELECT doc_id, clean, procedure_id, CASE WHEN length(left(f5, CAST(6 - length(s5) AS BIGINT)) || s5) >= 4 THEN left(f5, CAST(6 - length(s5) AS BIGINT)) || s5 END AS route_code, replace(clean, ' ', '') AS family,
  CASE WHEN trim(rw) = '' THEN NULL ELSE 'RW' || regexp_replace(regexp_replace(upper(replace(rw, ' ', '')), '^RWY', 'RW'), '^RW', '') END AS runway_id
FROM i""")
def procedure_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", pick(NAMES, F.col("doc_id")).alias("name"), pick(RUNWAYS, F.col("doc_id")).alias("rw"))
    return d.select("doc_id", tx.clean_name(F.col("name")).alias("clean"), tx.procedure_id(F.col("name")).alias("procedure_id"), tx.route_code(F.col("name")).alias("route_code"), tx.family_key(F.col("name")).alias("family"), tx.runway_id(F.col("rw")).alias("runway_id"))


@query("transition_ids", f"""
WITH t AS (SELECT n_nationkey AS k, upper(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN ' TRANSITION' ELSE '' END AS name FROM nation),
i AS (SELECT k, substr(nullif(regexp_extract(regexp_replace(name, '\\s+TRANSITION\\.?$', ''), '^([A-Z]{{2,}})$', 1), ''), 1, 5) AS id FROM t)
SELECT k, id AS transition_id FROM i""")
def transition_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.upper("n_name"), F.when(F.col("n_nationkey") % 2 == 0, " TRANSITION").otherwise(""))
    return n.select(F.col("n_nationkey").alias("k"), tx.transition_id(name).alias("transition_id"))


@query("text_keys", """
SELECT p_partkey, h31 AS hash31, regexp_replace(p_name, '[^A-Za-z0-9_]+', '_', 'g') AS slug, trim(regexp_replace(p_name, '[\\\\/:*?"<>|]+', ' ', 'g')) AS file_name,
  'A' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 12, '0') AS natural_key
FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h31 FROM part)""")
def text_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    h = F.conv(tx.hash31(F.col("p_name")), 36, 10).cast("long")
    return p.select("p_partkey", h.alias("hash31"), tx.slug(F.col("p_name")).alias("slug"), tx.safe_file(F.col("p_name")).alias("file_name"), F.upper(tx.natural_key(F.concat(F.lit("a"), (F.col("p_partkey") % 1000).cast("string")))).alias("natural_key"))


def _found_sql(kind: str, pattern: str, confidence: float, where: str) -> str:
    test = {"all": "", "support": " WHERE support", "charts": " WHERE NOT support"}[where]
    return f"SELECT page_no, '{kind}' AS kind, unnest(regexp_extract_all(text, {quoted(pattern)})) AS value, {confidence}::DOUBLE AS confidence FROM p{test}"


@query("typed_candidates", f"""
WITH p AS (SELECT a.page_no, a.text, {sql_rules('up', tx.SUPPORT_TYPES, 'NULL')} IS NOT NULL AS support FROM (SELECT *, {_UP} AS up FROM ({AIP_PAGES})) a),
x AS ({' UNION ALL '.join(_found_sql(*c) for c in tx.CANDIDATES)}),
v AS (SELECT page_no, kind, translate(trim(regexp_replace(value, '\\s+', ' ', 'g')), '{tx.ASCII_LOWER}', '{tx.ASCII_UPPER}') AS value, confidence FROM x)
SELECT page_no, kind, value, min(confidence) AS confidence FROM v WHERE value <> '' GROUP BY page_no, kind, value""")
def typed_candidates(spark, sf_dir):
    p = aip_pages(spark, sf_dir).withColumn("support", tx.support_type(F.upper(tx.squeezed(F.col("text")))).isNotNull())
    found = p.select("page_no", F.explode(tx.typed_candidates(F.col("text"), F.col("support"))).alias("c")).select("page_no", "c.*").where("value <> ''")
    return found.groupBy("page_no", "kind", "value").agg(F.min("confidence").alias("confidence"))


@query("title_window", """
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM documents),
h AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda s: regexp_matches(s, '[0-9]')), true) AS pos FROM l)
SELECT doc_id, pos AS hit, CASE WHEN pos > 0 THEN array_to_string(ls[greatest(pos - 1, 1):pos + 2], ' / ') ELSE coalesce(ls[1], '') END AS title FROM h""")
def title_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    hit = F.nullif(F.array_position(F.transform(lines, lambda s: s.rlike("[0-9]")), F.lit(True)), F.lit(0)).cast("int")
    return d.select("doc_id", hit.alias("hit"), F.array_join(tx.title_window(F.col("text"), "[0-9]", 1, 2), " / ").alias("title"))


@query("table_candidates", f"""
WITH p AS ({AIP_PAGES}), l AS (SELECT page_no, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT page_no, list_filter(list_transform(string_split(text, chr(10)), lambda s: upper(trim(s))), lambda s: regexp_matches(s, '\\b(TF|IF|CF|DF|RF|RWY|KIAS|NM)\\b')) AS ls, text FROM p) WHERE regexp_matches(upper(text), 'SEQ|PATH TERM|WAYPOINT|COURSE|DISTANCE|ALTITUDE|SPEED'))
SELECT page_no, 'tbl_' || page_no || '_' || i AS id, line, array_to_string(list_filter([CASE WHEN regexp_matches(line, '\\b(TF|IF|CF|DF|RF)\\b') THEN 'PATH TERM' END, CASE WHEN regexp_matches(line, '[0-9]+(\\.[0-9]+)?\\s?NM') THEN 'DISTANCE' END, CASE WHEN regexp_matches(line, '[0-9]{{3,5}}\\s?FT') THEN 'ALTITUDE' END, CASE WHEN regexp_matches(line, '[0-9]{{2,3}}\\s?KIAS') THEN 'SPEED LIMIT' END], lambda x: x IS NOT NULL), ', ') AS columns FROM l WHERE i <= 80""")
def table_candidates(spark, sf_dir):
    p = aip_pages(spark, sf_dir).where(F.upper("text").rlike("SEQ|PATH TERM|WAYPOINT|COURSE|DISTANCE|ALTITUDE|SPEED"))
    lines = F.slice(F.filter(F.transform(F.split("text", "\n"), lambda s: F.upper(F.trim(s))), lambda s: s.rlike(tx.word("(TF|IF|CF|DF|RF|RWY|KIAS|NM)"))), 1, 80)
    l = p.select("page_no", F.posexplode(lines).alias("i", "line"))
    has = lambda pat, name: F.when(F.col("line").rlike(pat), F.lit(name))
    columns = F.array_join(F.array_compact(F.array(has(tx.word("(TF|IF|CF|DF|RF)"), "PATH TERM"), has(r"\d+(\.\d+)?\s?NM", "DISTANCE"), has(r"\d{3,5}\s?FT", "ALTITUDE"), has(r"\d{2,3}\s?KIAS", "SPEED LIMIT"))), ", ")
    return l.select("page_no", F.concat_ws("_", F.lit("tbl"), F.col("page_no").cast("string"), (F.col("i") + 1).cast("string")).alias("id"), "line", columns.alias("columns"))


@query("html_support_fields", """
SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS lang,
  len(regexp_extract_all(html, '<p>')) AS paragraphs, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS links, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def html_support_fields(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", tx.extract(h, "<title>([^<]*)</title>").alias("title"), tx.extract(h, 'lang="([a-z]+)"').alias("lang"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"), F.size(tx.matches(h, 'href="([^"]*)"', 1)).cast("long").alias("links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("group_keys", f"""
WITH p AS ({AIP_PAGES}), {_CLASSIFIED},
n AS (SELECT page_no, category, navigation, coalesce(runway, 'RWY_UNKNOWN') AS rw, CASE category WHEN 'ARRIVAL' THEN 'STAR' WHEN 'DEPARTURE' THEN 'SID' WHEN 'APPROACH' THEN 'APPROACH' WHEN 'AERODROME' THEN 'AERODROME' ELSE 'OTHER' END AS package,
  list_distinct(regexp_extract_all(up, '[A-Z]{{5}} ?[0-9][A-Z]')) AS names, trim(left(split_part(up, ' - ', 1), 40)) AS chart FROM c)
SELECT page_no, CASE WHEN package = 'APPROACH' THEN 'APPROACH::' || navigation || '::' || rw || '::' || coalesce(replace(names[1], ' ', ''), chart)
  ELSE category || '::' || package || '::' || navigation || '::' || rw || '::' || CASE WHEN len(names) > 0 THEN array_to_string(list_sort(list_transform(names, lambda n: replace(n, ' ', ''))), '|') ELSE chart END END AS group_key FROM n""")
def group_keys(spark, sf_dir):
    c = classified(spark, sf_dir)
    names = tx.matches(F.col("up"), "[A-Z]{5} ?[0-9][A-Z]")
    key = tx.group_key(F.col("category"), tx.package_type(F.col("category")), F.col("navigation"), F.col("runway"), names, F.substring(F.substring_index("up", " - ", 1), 1, 40))  # the page's beginning stands for a chart's name
    return c.select("page_no", key.alias("group_key"))


@query("prompt_route", f"""
WITH p AS ({AIP_PAGES}), {_CLASSIFIED},
s AS (SELECT *, CASE category WHEN 'ARRIVAL' THEN 'STAR' WHEN 'DEPARTURE' THEN 'SID' WHEN 'APPROACH' THEN 'APPROACH' WHEN 'AERODROME' THEN 'AERODROME' ELSE 'OTHER' END AS package FROM c)
SELECT page_no, CASE package || ' ' || navigation WHEN 'STAR RNAV' THEN 'rnav_star_v1' WHEN 'STAR DME_ARC' THEN 'dme_arc_star_v1' WHEN 'SID RNAV' THEN 'rnav_sid_v1'
  WHEN 'SID CONVENTIONAL' THEN 'conventional_sid_v1' WHEN 'SID RADAR' THEN 'conventional_sid_v1' WHEN 'SID VOR' THEN 'conventional_sid_v1' WHEN 'SID NDB' THEN 'conventional_sid_v1' WHEN 'SID DME_ARC' THEN 'conventional_sid_v1'
  WHEN 'APPROACH ILS' THEN 'ils_loc_approach_v1' WHEN 'APPROACH LOC' THEN 'ils_loc_approach_v1' WHEN 'APPROACH ILS_LOC' THEN 'ils_loc_approach_v1' WHEN 'APPROACH VOR' THEN 'vor_approach_v1'
  WHEN 'APPROACH RNP' THEN 'rnp_approach_v1' WHEN 'APPROACH RNP_AR' THEN 'rnp_ar_approach_v1' ELSE 'generic_procedure_v1' END AS template,
  'Package ' || package || ' by ' || navigation || ' for ' || coalesce(runway, '') || '.' AS prompt, CASE WHEN package IN ('SID', 'STAR', 'APPROACH') AND navigation IN ('ILS', 'ILS_LOC', 'LOC', 'VOR', 'NDB', 'DME_ARC') THEN 'REQUIRED' WHEN package IN ('SID', 'STAR', 'APPROACH') THEN 'OPTIONAL' ELSE 'NEVER' END AS send_policy
FROM s""")
def prompt_route(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("package", tx.package_type(F.col("category")))
    program = F.col("package").isin("SID", "STAR", "APPROACH")
    policy = F.when(program & F.col("navigation").isin("ILS", "ILS_LOC", "LOC", "VOR", "NDB", "DME_ARC"), "REQUIRED").when(program, "OPTIONAL").otherwise("NEVER")
    prompt = tx.rendered("Package {{ package }} by {{navigation}} for {{runway}}.{{ unknown }}", {"package": F.col("package"), "navigation": F.col("navigation"), "runway": F.col("runway")})
    return c.select("page_no", tx.template_id(F.col("package"), F.col("category"), F.col("navigation")).alias("template"), prompt.alias("prompt"), policy.alias("send_policy"))


@query("image_quality", f"""
SELECT p_partkey, w, h, scale, {sql_round('w * scale * crop', 0)} AS px_w, {sql_round('h * scale * crop', 0)} AS px_h, {sql_round('w * scale * crop', 0)} >= 1600 AS wide_enough
FROM (SELECT p_partkey, (400 + p_size * 10)::DOUBLE AS w, p_retailprice AS h, 3.0::DOUBLE AS scale, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.35 END::DOUBLE AS crop FROM part)""")
def image_quality(spark, sf_dir):
    from waylark.functions.tolerance import round_half_up

    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select("p_partkey", (400 + F.col("p_size") * 10).cast("double").alias("w"), F.col("p_retailprice").alias("h"), F.lit(3.0).alias("scale"), F.when(k == 0, 1.0).when(k == 1, 0.5).otherwise(0.35).alias("crop"))
    w = round_half_up(F.col("w") * F.col("scale") * F.col("crop"))
    return p.select("p_partkey", "w", "h", "scale", w.alias("px_w"), round_half_up(F.col("h") * F.col("scale") * F.col("crop")).alias("px_h"), (w >= 1600).alias("wide_enough"))
