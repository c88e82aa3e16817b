"""The queries of the training-data operators: ``QUERIES`` and, where SQL can say the same, ``ORACLE``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, divergence, exact_dedup, html_text, line_dedup, media_copies, near_dedup, packing, secret_scan, substring_dedup, tool_calls, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h
"""

def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies, the same place on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, i, lines[i] AS line, len(lines) AS n, ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT AS v
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
r AS (SELECT *, (v + coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0) % 2147483647 * 1000003) % 2147483647 AS r FROM h),
e AS (SELECT *, i BETWEEN 2 AND n - 2 AND r < lag(r) OVER (PARTITION BY doc_id ORDER BY i) AND r <= lead(r) OVER (PARTITION BY doc_id ORDER BY i) AS cut FROM r),
p AS (SELECT doc_id, i, line, n, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY i) - 1 AS nth, count(*) OVER (PARTITION BY doc_id, part) AS size FROM p),
c AS (SELECT doc_id, i, line, part, least(nth // 8, greatest(size - 2, 0) // 8) AS piece FROM q),
k AS (SELECT doc_id, part, piece, min(i) AS first, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, part, piece),
g AS (SELECT doc_id, part, piece, n_lines >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) > 1 AS gone FROM k),
m AS (SELECT c.doc_id, c.i, c.line, g.gone FROM c JOIN g USING (doc_id, part, piece))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the pictures of all embeddings, of which three in four are cropped or edited."""
    return media_copies.media_groups(media_copies.pictures(table(spark, sf_dir, "embeddings")))


#: The tools that the conversations are read as calls of.
TOOLS = {
    "search": {"required": ["query"], "properties": {"query": {"type": "string", "maxLength": 300}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}}, "additionalProperties": False},
    "summarise": {"required": ["text", "words"], "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 5}}},
    "lookup": {"required": ["term"], "properties": {"term": {"type": "string"}, "language": {"type": "string", "enum": ["de", "en", "es", "fr"]}}},
}


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is read as a call, after that of two turns before; the turn after it, if the assistant's, as its result."""
    t = table(spark, sf_dir, "conversations")
    named = lambda turn: F.concat_ws(":", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    user = t.where("role = 'user'")
    n = F.length("text")
    name = F.when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "summarise").otherwise("lookup")
    search = F.to_json(F.struct(F.col("text").alias("query"), (n % 45).alias("limit")))
    summarise = F.when(n % 7 == 0, F.to_json(F.struct(F.col("text").alias("text")))).otherwise(F.to_json(F.struct((n % 20).alias("words"), F.col("text").alias("text"))))
    lookup = F.to_json(F.struct(F.col("text").alias("term"), F.when(n % 5 == 0, "it").otherwise("en").alias("language")))
    arguments = F.when(F.col("turn") % 3 == 0, search).when(F.col("turn") % 3 == 1, summarise).otherwise(lookup)
    calls = user.select("conv_id", "turn", named(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), named(F.col("turn") - 2).alias("after"))
    results = t.where("role = 'assistant'").select("conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return tool_calls.link_calls(calls, results, TOOLS)


OP10_SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
lv AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, lv.level + 1 FROM lv JOIN u ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2),
c AS (
  SELECT u.conv_id, u.turn, 'call:' || u.conv_id || ':' || u.turn AS call_id, lv.level, a.text AS result, a.conv_id IS NOT NULL AS answered,
    CASE u.turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' ELSE 'lookup' END AS name,
    CASE u.turn % 3
      WHEN 0 THEN '{"limit":' || (n % 45) || ',"query":' || to_json(u.text) || '}'
      WHEN 1 THEN CASE WHEN n % 7 = 0 THEN '{"text":' || to_json(u.text) || '}' ELSE '{"text":' || to_json(u.text) || ',"words":' || (n % 20) || '}' END
      ELSE '{"language":"' || CASE WHEN n % 5 = 0 THEN 'it' ELSE 'en' END || '","term":' || to_json(u.text) || '}' END AS arguments,
    list_filter(CASE u.turn % 3
      WHEN 0 THEN [CASE WHEN n > 300 THEN 'query is too long' END, CASE WHEN n % 45 < 1 THEN 'limit is beyond its minimum' END, CASE WHEN n % 45 > 40 THEN 'limit is beyond its maximum' END]
      WHEN 1 THEN [CASE WHEN n % 7 = 0 THEN 'words is missing' END, CASE WHEN n % 7 <> 0 AND n % 20 < 5 THEN 'words is beyond its minimum' END]
      ELSE [CASE WHEN n % 5 = 0 THEN 'language is none of the values' END] END, lambda x: x IS NOT NULL) AS errors
  FROM u JOIN lv ON lv.conv_id = u.conv_id AND lv.turn = u.turn LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
s AS (SELECT *, CASE WHEN NOT answered THEN 'pending' WHEN len(errors) > 0 THEN 'invalid' ELSE 'ok' END AS status FROM c)
SELECT conv_id, turn, call_id, 'call' AS kind, level, status,
  '{"arguments":' || arguments || ',"errors":' || to_json(errors) || ',"id":"' || call_id || '","level":' || level || ',"n_results":' || CASE WHEN answered THEN 1 ELSE 0 END
    || ',"name":"' || name || '",' || CASE WHEN answered THEN '"result":' || to_json(result) || ',' ELSE '"result":null,' END || '"status":"' || status || '"}' AS record FROM s
UNION ALL
SELECT a.conv_id, a.turn, 'call:' || a.conv_id || ':' || (a.turn - 1), 'orphan', NULL, 'orphan',
  '{"content":' || to_json(a.text) || ',"id":"call:' || a.conv_id || ':' || (a.turn - 1) || '","status":"orphan"}'
FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1)
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
l AS (SELECT lang, count(*)::BIGINT AS v, sum(ln)::BIGINT AS lt FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::BIGINT AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (gt.total + 5 * l.v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.ln + 5)) // (l.lt + 5 * l.v) AS BIGINT) AS q
  FROM gt JOIN k ON k.lang = gt.lang JOIN l ON l.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _op12_sql() -> str:
    """The patterns' spans by the lengths of what lies between matches; runs by their characters, one row each."""
    m = secret_scan
    text = lambda s: "'" + s.replace("'", "''") + "'"
    case = lambda values: "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"
    spans = lambda name, p: f"""
{name} AS (SELECT row, hits[i] AS hit, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
  SELECT row, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT row, regexp_extract_all(text, {text(p)}) AS hits, string_split_regex(text, {text(p)}) AS parts FROM d WHERE regexp_matches(text, {text(p)}))))"""  # noqa: E731
    o = lambda i: case({k: v[i] for k, v in m.ORDINARY.items()})
    change = case(m.CHANGES)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
{spans("s0", m.ASSIGN)},{spans("s1", m.ACCESS)},{spans("s2", m.HEX)},{spans("s3", m.RUN)},
base AS MATERIALIZED (
  SELECT row, start, 0 AS kind, start + length(hit) AS stop FROM s0 WHERE length(regexp_extract(hit, {text(m.ASSIGN)}, 1)) >= {m.LEAST_VALUE}
  UNION ALL SELECT row, start, 1, start + length(hit) FROM s1 UNION ALL SELECT row, start, 2, start + length(hit) FROM s2),
r0 AS (SELECT row, start, start + length(hit) AS stop, rtrim(hit, '=') AS hit FROM s3),
r1 AS (SELECT *, regexp_matches(hit, '[0-9]') AS digit FROM r0 WHERE length(hit) >= {m.LEAST}),
r2 AS (SELECT *, CASE
    WHEN digit AND (regexp_matches(hit, '^[0-9a-f]+$') AND regexp_matches(hit, '[a-f]') OR regexp_matches(hit, '^[0-9A-F]+$') AND regexp_matches(hit, '[A-F]')) THEN 16
    WHEN digit AND regexp_matches(hit, '^[A-Z2-7]+$') THEN 32
    WHEN digit AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND (regexp_matches(hit, '^[A-Za-z0-9+/]+$') OR regexp_matches(hit, '^[A-Za-z0-9_-]+$')) THEN 64 END AS k FROM r1),
r3 AS MATERIALIZED (SELECT row, start, stop, k, CASE k WHEN 16 THEN lower(hit) ELSE translate(hit, '-_', '+/') END AS hit FROM r2 WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = r2.row AND b.start < r2.stop AND r2.start < b.stop)),
c0 AS (SELECT row, start, k, length(hit) AS n, i, hit[i] AS c, instr({case({k: text(a) for k, a in m.ALPHABETS.items()})}, hit[i]) - 1 AS v,
    CASE WHEN regexp_matches(hit[i], '[a-z]') THEN 0 WHEN regexp_matches(hit[i], '[A-Z]') THEN 1 ELSE 2 END AS cl FROM (SELECT *, unnest(range(1, length(hit) + 1)) AS i FROM r3)),
c1 AS (SELECT *, lag(v) OVER w AS pv, lag(cl) OVER w AS pc FROM c0 WINDOW w AS (PARTITION BY row, start ORDER BY i)),
q0 AS (SELECT row, start, any_value(k)::DOUBLE AS k, any_value(n)::DOUBLE AS n, sum(v)::DOUBLE AS s, sum(v * v)::DOUBLE AS ss, count(*) FILTER (WHERE cl <> pc) AS ch,
    (sum(v * pv) FILTER (WHERE (i - 1) % {m.PIECE} <> 0))::DOUBLE AS ps, count(*) FILTER (WHERE (i - 1) % {m.PIECE} <> 0) AS pn FROM c1 GROUP BY row, start),
q1 AS (SELECT row, start, sum(n * n)::DOUBLE AS nn FROM (SELECT row, start, count(*) AS n FROM c0 GROUP BY row, start, v) GROUP BY row, start),
q2 AS (SELECT *, s / n AS mean, ss / n - (s / n) * (s / n) AS spread, k / n * nn - n AS chi, n * (k * {o(0)} - 1) AS excess FROM q0 JOIN q1 USING (row, start)),
q3 AS (SELECT *, CASE WHEN spread > 0 THEN (ps / greatest(pn, 1) - mean * mean) / spread ELSE 1 END AS serial FROM q2),
q4 AS (SELECT row, start, n, greatest(abs((chi - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)), abs((ch - (n - 1) * {change}) / sqrt((n - 1) * {change} * (1 - {change}))), abs((serial + 1 / n) * sqrt(n))) AS worst,
    (-(chi - (k - 1 + excess * (n - 1) / n)) / sqrt(2 * (k - 1) + 4 * excess) + (ch - (n - 1) * {o(1)}) / sqrt((n - 1) * {o(1)} * (1 - {o(1)})) - (serial - {o(2)}) * sqrt(n)) / sqrt(3) AS z FROM q3),
q5 AS (SELECT row, start, CASE WHEN n >= 128 THEN 3 WHEN n >= 64 THEN 2 WHEN n >= 32 THEN 1 ELSE 0 END AS class,
    CASE WHEN worst <= {m.LIMIT} AND z > 0 THEN least(floor((z * z / 2 + 0.6931471805599453) * {m.BINS}), {m.LAST_BIN}) ELSE 0 END AS bin FROM q4),
q6 AS (SELECT class, bin, count(*) AS n FROM q5 GROUP BY class, bin),
q7 AS (SELECT class, bin, exp(-bin / {m.BINS}) <= {m.ALPHA} * sum(n) OVER (PARTITION BY class ORDER BY bin DESC) / sum(n) OVER (PARTITION BY class) AS ok FROM q6),
q8 AS (SELECT class, min(bin) AS least FROM q7 WHERE ok GROUP BY class),
random AS (SELECT r3.row, r3.start, 3 AS kind, r3.stop FROM r3 JOIN q5 USING (row, start) JOIN q8 USING (class) WHERE q5.bin >= q8.least),
spans AS (SELECT *, (['assign', 'access', 'hex', 'random'])[kind + 1] || ':' || start || ':' || stop AS name FROM (SELECT * FROM base UNION ALL SELECT * FROM random)),
g AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c, count(*) FILTER (WHERE kind = 3) AS e,
    string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, coalesce(e, 0) AS n_random, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """Eleven assignments and ten moves, one after the other."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, row, q, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT v.vec_id, v.row, v.q, c.j, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{r} c) GROUP BY vec_id, row, q)"""
    move = """m{r} AS (SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY j, i),
c{n} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM m{r} GROUP BY j) m ON m.j = c.j)"""
    steps = [near.format(r=0)]
    for r in range(10):
        steps += [move.format(r=r, n=r + 1), near.format(r=r + 1)]
    return (
        """WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS j, q FROM v QUALIFY j < 8),
"""
        + ",\n".join(steps)
        + """,
t AS (SELECT j, sum(d)::BIGINT AS ci FROM a10 GROUP BY j)
SELECT a.vec_id, CAST(a.j AS INT) AS cluster, a.d AS distance, t.ci AS cluster_inertia, CAST((SELECT sum(ci) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a10 a JOIN c10 c ON c.j = a.j JOIN t ON t.j = a.j
"""
    )


QUERIES = {"op1_near_dedup": op1_near_dedup, "op2_substring_dedup": op2_substring_dedup, "op3_html_text": op3_html_text, "op4_bpe": op4_bpe, "op5_media_copies": op5_media_copies, "op6_exact_dedup": op6_exact_dedup, "op7_packing": op7_packing, "op8_line_dedup": op8_line_dedup, "op9_toxicity": op9_toxicity, "op10_tool_calls": op10_tool_calls, "op11_source_divergence": op11_source_divergence, "op12_secret_scan": op12_secret_scan, "op13_centroids": op13_centroids}
ORACLE = {"op6_exact_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_tool_calls": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_secret_scan": _op12_sql(), "op13_centroids": _op13_sql()}
