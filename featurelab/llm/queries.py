"""Registered queries of the training-data operators, one per operator, and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, langid, lexical_search, line_dedup, near_dedup, packing, prefix_trie, quality, substring_dedup, token_counts, toxicity
from .common import table


def _held_out():
    """The contract's fold: rows with crc32 of the id text mod 4 equal to 2 are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~_held_out())
    out = langid.detect(docs, model)
    return out.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~_held_out())
    out = toxicity.score(docs, model)
    return out.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                     F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), ("source", "lang", "text"), "majority")


#: the tool that op8 reads the conversations' exchanges as calls of
REPLY_TOOL = {"reply": {"properties": {"n_chars": "integer", "request": "string"}, "required": ["n_chars", "request"]}}


def _exchanges(c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Other messages, calls and results: every user turn is a call of the tool ``reply``, the assistant turn after it its result."""
    ident = F.concat(F.col("conv_id").cast("string"), F.lit(":"))
    user, assistant = (F.coalesce(F.col("role") == r, F.lit(False)) for r in ("user", "assistant"))
    calls = c.where(user).select(
        "conv_id", "turn", F.concat(ident, F.col("turn").cast("string")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("request"), F.length("text").alias("n_chars"))).alias("arguments"))
    results = c.where(assistant).select(
        "conv_id", "turn", F.concat(ident, (F.col("turn") - 1).cast("string")).alias("call_id"), "text")
    return c.where(~user & ~assistant), calls, results


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a call, the assistant turn after it its result; calls depend on those of the two turns before.

    Which tool a call names, and the form of its arguments, follow from its conversation and turn, so that every rule
    of the schema fails for some; in some conversations a call also depends on that of two turns later, a cycle.
    """
    messages, calls, results = _exchanges(table(spark, sf_dir, "conversations"))
    raw = table(spark, sf_dir, "conversations").where("role = 'user'")
    call_id = lambda step: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + step).cast("string"))
    text, n_chars = F.col("text").alias("request"), F.length("text").alias("n_chars")
    arguments = F.when(F.col("turn") % 19 == 13, F.concat(F.lit("call: "), "text")) \
        .when(F.col("turn") % 17 == 11, F.to_json(F.struct(n_chars))) \
        .when(F.col("turn") % 13 == 5, F.to_json(F.struct(F.lit("x").alias("zz"), text, n_chars))) \
        .when(F.col("turn") % 7 == 3, F.to_json(F.struct(text, n_chars.cast("string").alias("n_chars")))) \
        .otherwise(F.to_json(F.struct(text, n_chars)))
    name = F.when((F.col("conv_id") % 11 == 7) & (F.col("turn") % 3 == 0), F.lit("search")).otherwise(F.lit("reply"))
    later = F.when((F.col("conv_id") % 29 == 3) & (F.col("turn") % 10 == 4), call_id(2))
    calls = raw.select("conv_id", "turn", call_id(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"),
                       F.array(call_id(-1), call_id(-2), later).alias("depends"))
    return chat.link_tool_calls(messages, calls, results, REPLY_TOOL)


def op8_chat_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a fitting call of the tool ``reply`` that depends on the calls of the two turns before it."""
    messages, calls, results = _exchanges(table(spark, sf_dir, "conversations"))
    before = [F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - k).cast("string")) for k in (1, 2)]
    return chat.link_tool_calls(messages, calls.withColumn("depends", F.array(*before)), results, REPLY_TOOL)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    text, runs = F.col("text"), F.col("keep_runs")
    return out.select("doc_id", line_dedup.n_lines(text).alias("n_lines"), line_dedup.n_dropped(runs).alias("n_dropped"),
                      F.sha2(line_dedup.kept_text(text, runs), 256).alias("kept_sha256"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_chat_formatting": op8_chat_formatting,
    "op8_chat_dependencies": op8_chat_dependencies,
    "op9_html_extraction": op9_html_extraction,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_line_dedup": op13_line_dedup,
}

_OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
base AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_alpha,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
pos AS (
  SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM base WHERE n_words >= 3),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS k FROM pos),
hot AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
mark AS (
  SELECT DISTINCT g.doc_id, g.i + o.o AS p
  FROM g JOIN hot USING (doc_id, k), (VALUES (0), (1), (2)) o(o)),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM mark GROUP BY doc_id),
s AS (
  SELECT base.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 10 * n_symbols > n_words OR 2 * n_dup_lines > len(lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_alpha < n_words) AS kept
FROM s
"""

_OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
        FROM documents)),
b AS (
  SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
        FROM benchmark)),
bw AS (
  SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, k)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: a call's level is its place in its run of calls that are at most two turns apart, up to the first that waits for a later one
_OP8_SQL = r"""
WITH calls AS (
  SELECT conv_id, turn, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id,
         CASE WHEN conv_id % 11 = 7 AND turn % 3 = 0 THEN 'search' ELSE 'reply' END AS name,
         CASE WHEN turn % 19 = 13 THEN 'plain' WHEN turn % 17 = 11 THEN 'short' WHEN turn % 13 = 5 THEN 'extra' WHEN turn % 7 = 3 THEN 'string' ELSE 'fit' END AS form
  FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, turn, text, conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id FROM conversations WHERE role = 'assistant'),
hc AS (SELECT conv_id, call_id, count(*) AS n_calls, min(turn) AS call_turn FROM calls GROUP BY ALL),
hr AS (SELECT conv_id, call_id, count(*) AS n_results FROM results GROUP BY ALL),
gap AS (SELECT h.*, CASE WHEN h.call_turn <= lag(h.call_turn) OVER (PARTITION BY h.conv_id ORDER BY h.call_turn) + 2 THEN 0 ELSE 1 END AS new,
               h.conv_id % 29 = 3 AND h.call_turn % 10 = 4 AND l.call_id IS NOT NULL AS waits
        FROM hc h LEFT JOIN hc l ON l.conv_id = h.conv_id AND l.call_turn = h.call_turn + 2 WHERE h.call_id IS NOT NULL),
run AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY call_turn) AS run FROM gap),
lv AS (SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, run ORDER BY call_turn) - 1 AS place,
              bool_or(waits) OVER (PARTITION BY conv_id, run ORDER BY call_turn) AS stuck FROM run),
lev AS (SELECT conv_id, call_id, CASE WHEN stuck THEN 0 ELSE place END AS level, stuck FROM lv),
j AS (SELECT *, CASE WHEN form = 'plain' THEN to_json('call: ' || text)::VARCHAR
                     WHEN text IS NULL THEN CASE WHEN form = 'extra' THEN '{"zz":"x"}' ELSE '{}' END
                     WHEN form = 'short' THEN json_object('n_chars', length(text))::VARCHAR
                     WHEN form = 'extra' THEN json_object('n_chars', length(text), 'request', text, 'zz', 'x')::VARCHAR
                     WHEN form = 'string' THEN json_object('n_chars', length(text)::VARCHAR, 'request', text)::VARCHAR
                     ELSE json_object('n_chars', length(text), 'request', text)::VARCHAR END AS arguments,
             CASE WHEN name = 'search' THEN 'unknown tool' WHEN form = 'plain' THEN 'not an object' WHEN text IS NULL THEN 'missing n_chars'
                  WHEN form = 'short' THEN 'missing request' WHEN form = 'extra' THEN 'unexpected key' WHEN form = 'string' THEN 'n_chars is no integer' END AS why
      FROM calls)
SELECT conv_id, turn AS ord, coalesce(level, 0)::INTEGER AS level, 0::INTEGER AS step, turn, 'assistant' AS role, call_id,
       CASE WHEN n_calls > 1 THEN 'ambiguous' WHEN why IS NOT NULL THEN 'invalid: ' || why WHEN stuck THEN 'cycle'
            WHEN n_results > 0 THEN 'linked' ELSE 'unanswered' END AS status,
       '{"role":"assistant","tool_calls":[{' || coalesce('"arguments":' || arguments || ',', '') || substr(json_object('id', call_id, 'name', name)::VARCHAR, 2) || ']}' AS message
FROM j LEFT JOIN hc USING (conv_id, call_id) LEFT JOIN hr USING (conv_id, call_id) LEFT JOIN lev USING (conv_id, call_id)
UNION ALL
SELECT conv_id, CASE WHEN n_calls = 1 THEN call_turn ELSE turn END, (CASE WHEN n_calls = 1 THEN coalesce(level, 0) ELSE 0 END)::INTEGER, 1, turn, 'tool', call_id,
       CASE WHEN n_calls = 1 THEN 'linked' WHEN n_calls > 1 THEN 'ambiguous' ELSE 'orphan' END,
       CASE WHEN text IS NULL THEN json_object('role', 'tool', 'tool_call_id', call_id)
            ELSE json_object('content', text, 'role', 'tool', 'tool_call_id', call_id) END::VARCHAR
FROM results LEFT JOIN hc USING (conv_id, call_id) LEFT JOIN lev USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, 0, 0, turn, role, NULL, 'plain',
       CASE WHEN text IS NULL THEN json_object('role', role) ELSE json_object('content', text, 'role', role) END::VARCHAR
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

#: a call's level is its place in its run of calls that are at most two turns apart
_OP8_LEVELS_SQL = r"""
WITH calls AS (
  SELECT conv_id, turn, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, turn, text, conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id FROM conversations WHERE role = 'assistant'),
hc AS (SELECT conv_id, call_id, count(*) AS n_calls, min(turn) AS call_turn FROM calls GROUP BY ALL),
hr AS (SELECT conv_id, call_id, count(*) AS n_results FROM results GROUP BY ALL),
gap AS (SELECT conv_id, call_id, call_turn, CASE WHEN call_turn <= lag(call_turn) OVER (PARTITION BY conv_id ORDER BY call_turn) + 2 THEN 0 ELSE 1 END AS new
        FROM hc WHERE call_id IS NOT NULL),
run AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY call_turn) AS run FROM gap),
lv AS (SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, run ORDER BY call_turn) - 1 AS level FROM run)
SELECT conv_id, turn AS ord, coalesce(level, 0)::INTEGER AS level, 0::INTEGER AS step, turn, 'assistant' AS role, call_id,
       CASE WHEN n_calls > 1 THEN 'ambiguous' WHEN text IS NULL THEN 'invalid: missing n_chars'
            WHEN n_results > 0 THEN 'linked' ELSE 'unanswered' END AS status,
       '{"role":"assistant","tool_calls":[{"arguments":'
         || CASE WHEN text IS NULL THEN '{}' ELSE json_object('n_chars', length(text), 'request', text)::VARCHAR END
         || ',' || substr(json_object('id', call_id, 'name', 'reply')::VARCHAR, 2) || ']}' AS message
FROM calls LEFT JOIN hc USING (conv_id, call_id) LEFT JOIN hr USING (conv_id, call_id) LEFT JOIN lv USING (conv_id, call_id)
UNION ALL
SELECT conv_id, CASE WHEN n_calls = 1 THEN call_turn ELSE turn END, (CASE WHEN n_calls = 1 THEN coalesce(level, 0) ELSE 0 END)::INTEGER, 1, turn, 'tool', call_id,
       CASE WHEN n_calls = 1 THEN 'linked' WHEN n_calls > 1 THEN 'ambiguous' ELSE 'orphan' END,
       CASE WHEN text IS NULL THEN json_object('role', 'tool', 'tool_call_id', call_id)
            ELSE json_object('content', text, 'role', 'tool', 'tool_call_id', call_id) END::VARCHAR
FROM results LEFT JOIN hc USING (conv_id, call_id) LEFT JOIN lv USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, 0, 0, turn, role, NULL, 'plain',
       CASE WHEN text IS NULL THEN json_object('role', role) ELSE json_object('content', text, 'role', role) END::VARCHAR
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

_OP1_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM t WHERE n >= 200)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 200 THEN 0 ELSE 1 END AS new
      FROM w JOIN r USING (k) WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
c AS (SELECT t.doc_id, count(a) AS n_spans, coalesce(sum(b - a), 0) AS n_removed,
             coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(b), 0) + 1) AS kept
      FROM t LEFT JOIN g USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM t JOIN c USING (doc_id)
"""

_OP4_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 5) - 1) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, g.b FROM reach JOIN g ON g.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)
"""

_OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS MATERIALIZED (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM d WHERE len(w) > 0),
f AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
wt AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, c GROUP BY t, nd),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * nd) // nt AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT item_id, m.r, m.doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN f USING (t) JOIN wt USING (t) JOIN m ON m.r = f.r GROUP BY item_id, m.r, m.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

#: crc32 bit by bit: a byte is mixed in, then eight shifts
_OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT c, k, octet_length(encode(text)) AS bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM t),
h AS MATERIALIZED (
  SELECT c, max(p) AS n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 9 AS h
  FROM o GROUP BY c),
r AS MATERIALIZED (
  SELECT h.c, o.p AS d, k, bytes FROM h JOIN o ON o.c = h.c - h.c % 5 AND o.p <= h.h
  UNION ALL
  SELECT h.c, coalesce(least(b.n, h.h), 0) + o.p - h.h, k, bytes FROM h JOIN o ON o.c = h.c AND o.p > h.h LEFT JOIN h b ON b.c = h.c - h.c % 5),
l AS MATERIALIZED (SELECT h.c, coalesce(list(k ORDER BY d) FILTER (k IS NOT NULL), []) AS ks FROM h LEFT JOIN r USING (c) GROUP BY h.c),
m AS MATERIALIZED (SELECT c, d, md5(array_to_string(ks[1:d], ',')) AS node, len(ks) = d AS last FROM (SELECT c, ks, unnest(range(0, len(ks) + 1)) AS d FROM l)),
e AS MATERIALIZED (
  SELECT node, d, min(m.c) AS c, count(*) AS n_convs, coalesce(max(bytes), 0) AS bytes,
         sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (last), '')) AS ends
  FROM m LEFT JOIN r USING (c, d) GROUP BY node, d),
u AS MATERIALIZED (
  SELECT e.c, e.d, e.node, e.n_convs, e.bytes, e.ends, p.node AS up FROM e LEFT JOIN m p ON p.c = e.c AND p.d = e.d - 1),
q AS (SELECT up, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY up),
v AS MATERIALIZED (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN q ON q.up = u.node),
s AS (SELECT m.node, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
      FROM v JOIN m ON m.c = v.c AND m.d <= v.d GROUP BY m.node, m.d)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, w.c AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN s USING (node, d) LEFT JOIN e w ON w.node = v.up AND w.d = v.d - 1
"""

_OP13_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, i, lines[i] AS line,
             translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
k AS (SELECT key, max(doc_id) AS holder FROM x WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT doc_id, count(*) AS n_lines, count(k.key) FILTER (doc_id <> holder) AS n_dropped,
             string_agg(line, chr(10) ORDER BY i) FILTER (holder IS NULL OR doc_id = holder) AS kept
      FROM x LEFT JOIN k USING (key) GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM g
"""

ORACLES = {
    "op1_suffix_array_dedup": _OP1_SQL,
    "op4_minhash_near_dedup": _OP4_SQL,
    "op8_chat_formatting": _OP8_SQL,
    "op8_chat_dependencies": _OP8_LEVELS_SQL,
    "op6_decontamination": _OP6_SQL,
    "op3_quality_rules": _OP3_SQL,
    "op11_lexical_search": _OP11_SQL,
    "op12_conversation_trie": _OP12_SQL,
    "op13_line_dedup": _OP13_SQL,
}
