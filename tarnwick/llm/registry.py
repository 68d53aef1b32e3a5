"""Registered queries of the subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import chats, decontaminate, lines, lmscore, packing, passages, simhash, topk, toxicity, urls
from .common import table


def op1_exact_topk(spark, sf_dir):
    """Ten highest integer inner products for every hundredth vector."""
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).drop("query_row")


def op2_best_fit_packing(spark, sf_dir):
    """All documents as pieces of sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.public_paths(), keep_ids=False)


def op3_chat_formatting(spark, sf_dir):
    """All conversations as canonical JSON lines, answers linked to the turns that call for them."""
    return chats.format_turns(table(spark, sf_dir, "conversations"))


def op4_decontamination(spark, sf_dir):
    """Every document and benchmark item that it holds a copy of."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op5_lm_scoring(spark, sf_dir):
    """Bigram and unigram scores of every document."""
    return lmscore.lm_scores(table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every url."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark, sf_dir):
    """Every stretch of 50 words or more that another document holds too."""
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("row")


def op8_line_dedup(spark, sf_dir):
    """Every document without its recurring lines."""
    return lines.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_toxicity(spark, sf_dir):
    """Expected severity of every document, and whether it is rejected."""
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "severity", "rejected")


def op10_simhash_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP3_SQL = """
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id,
         CAST(to_json({'prompt': text, 'turn': turn}) AS VARCHAR) AS arguments,
         CASE WHEN text IS NULL THEN 'prompt: missing' WHEN length(text) < 1 THEN 'prompt: too short'
              WHEN turn < 0 THEN 'turn: too small' ELSE 'ok' END AS status
  FROM m WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY to_json({'prompt': text, 'turn': turn})) = 1),
r AS (
  SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS content
  FROM m WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, turn AS order_turn, 0 AS level, CAST(NULL AS VARCHAR) AS call_id, 'message' AS status,
       CAST(to_json({'content': text, 'conv_id': conv_id, 'role': role, 'turn': turn}) AS VARCHAR) AS json
FROM m WHERE NOT coalesce(role IN ('user', 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL, FALSE)
UNION ALL
SELECT conv_id, turn, 1, call_id, CASE WHEN call_id IN (SELECT call_id FROM r) THEN '' ELSE 'open, ' END || status,
       CAST(to_json({'arguments': arguments, 'conv_id': conv_id, 'id': call_id, 'name': 'reply', 'role': 'call', 'turn': turn}) AS VARCHAR)
FROM c
UNION ALL
SELECT r.conv_id, greatest(r.turn, c.turn), 2, r.call_id, CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'linked' END,
       CAST(to_json({'content': r.content, 'conv_id': r.conv_id, 'id': r.call_id,
                     'name': CASE WHEN c.call_id IS NULL THEN NULL ELSE 'reply' END, 'role': 'result', 'turn': r.turn}) AS VARCHAR)
FROM r LEFT JOIN c USING (call_id)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (
  SELECT row_id, coalesce(doc_id, -1) AS doc, lines, unnest(range(len(lines))) AS i FROM d WHERE text IS NOT NULL),
f AS (
  SELECT row_id, doc, i, trim(regexp_replace(lines[i + 1], '[ \t\r\f\x0B]+', ' ', 'g'), ' ') AS line FROM e),
g AS MATERIALIZED (
  SELECT row_id, doc, i, array_to_string(list_transform(string_split(line, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END), ' ') AS template
  FROM f WHERE line <> ''),
-- near copies: each line points to its first document
a AS (SELECT template, min(doc) AS first FROM g GROUP BY template),
v AS (
  SELECT h.doc, a.first, sum(length(h.template)) AS chars
  FROM (SELECT DISTINCT template, doc FROM g) h JOIN a USING (template) GROUP BY h.doc, a.first),
w AS (SELECT doc, first, chars, sum(chars) OVER (PARTITION BY doc) AS total FROM v),
l AS (
  SELECT doc, first AS lead FROM w WHERE first <> doc AND 3 * chars >= total
  QUALIFY row_number() OVER (PARTITION BY doc ORDER BY chars DESC, first) = 1),
c AS MATERIALIZED (
  SELECT DISTINCT template, coalesce(l.lead, g.doc) AS lead, string_split(template, ' ') AS t FROM g LEFT JOIN l USING (doc)),
-- the tree: token count, then the tokens of a third of the line; leaves that twenty leads reach are grown
r AS (
  SELECT template, lead, t, len(t) AS n, p, t[(len(t) * p) // 3 + 1 : (len(t) * (p + 1)) // 3] AS part
  FROM c, (SELECT unnest([0, 1, 2]) AS p) WHERE len(t) >= 3),
ripe AS (SELECT n, p, part, count(*) AS lines FROM r GROUP BY n, p, part HAVING count(DISTINCT lead) >= 20),
m AS MATERIALIZED (SELECT r.*, lines FROM r JOIN ripe USING (n, p, part)),
k AS (SELECT n, p, part, lines, unnest(t) AS token, unnest(range(n)) AS place FROM m),
s AS (
  SELECT n, p, part, place, token, count(*) AS own, any_value(lines) AS lines FROM k GROUP BY n, p, part, place, token),
o AS (
  SELECT template, n, p, part, unnest(t) AS token, unnest(range(n)) AS place FROM (SELECT DISTINCT template, n, p, part, t FROM m)),
x AS (
  SELECT template, any_value(n) AS n, list(CASE WHEN own >= 20 THEN token ELSE '<*>' END ORDER BY place) AS often, count(*) FILTER (own >= 20) AS n_often,
         list(CASE WHEN 5 * own >= 4 * lines THEN token ELSE '<*>' END ORDER BY place) AS nearly, count(*) FILTER (5 * own >= 4 * lines) AS n_nearly
  FROM o JOIN s USING (n, p, part, place, token) GROUP BY template, n, p, part),
y AS (
  SELECT template, often AS pattern FROM x WHERE 5 * n_often >= 3 * n
  UNION SELECT template, nearly FROM x WHERE 5 * n_nearly >= 3 * n),
z AS (SELECT pattern FROM y JOIN c USING (template) GROUP BY pattern HAVING count(DISTINCT lead) >= 20),
q AS (
  SELECT template FROM c GROUP BY template HAVING count(DISTINCT lead) >= 20
  UNION SELECT template FROM y WHERE pattern IN (SELECT pattern FROM z)),
u AS (SELECT row_id, list(i) AS gone FROM g WHERE template IN (SELECT template FROM q) GROUP BY row_id)
SELECT d.doc_id,
       CASE WHEN gone IS NULL THEN d.text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda j: NOT list_contains(gone, j)), lambda j: lines[j + 1]), chr(10)), '') END AS text,
       CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_dropped
FROM d LEFT JOIN u USING (row_id)
"""


def queries():
    found = (
        op1_exact_topk, op2_best_fit_packing, op3_chat_formatting, op4_decontamination, op5_lm_scoring,
        op6_url_filter, op7_suffix_dedup, op8_line_dedup, op9_toxicity, op10_simhash_dedup,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op1_exact_topk": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op8_line_dedup": OP8_SQL}
