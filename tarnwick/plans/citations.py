"""Queries for the citation graph and intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import graph, search

from . import views as V


def graph_build_stats(spark, sf_dir):
    return graph.graph_counts(V.nodes(spark, sf_dir), V.edges(spark, sf_dir))


def graph_degrees(spark, sf_dir):
    return graph.degrees(V.nodes(spark, sf_dir), V.edges(spark, sf_dir))


def _similarity(spark, sf_dir):
    """Field match of anchors with nodes they have a field in common with, for the pairs that are asked for."""
    return search.FieldSimilarity(V.field_queries(spark, sf_dir), V.fields(spark, sf_dir))


def _ancestors(spark, sf_dir):
    return graph.ancestors(V.anchors(spark, sf_dir), V.edges(spark, sf_dir), _similarity(spark, sf_dir), max_hops=2)


def graph_ancestors(spark, sf_dir):
    return _ancestors(spark, sf_dir).where("path_rank = 1").select("anchor", "node", "rank", F.round("score", 6).alias("score"))


def graph_ancestor_paths(spark, sf_dir):
    found = _ancestors(spark, sf_dir)
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return found.select("anchor", "node", "path_rank", path.alias("path"), F.array_join("intents", ">").alias("intents"), graph.explanation(F.col("path"), F.col("intents"), F.lit(1.0)).alias("explanation"))


def _opposing(spark, sf_dir, comparison):
    found = graph.opposing(V.anchors(spark, sf_dir), V.edges(spark, sf_dir), _similarity(spark, sf_dir), comparison=comparison)
    return found.select("anchor", "node", "intent", "fallback", "rank", F.round("score", 6).alias("score"))


def graph_opposing_intent(spark, sf_dir):
    return _opposing(spark, sf_dir, True)


def graph_opposing_fallback(spark, sf_dir):
    return _opposing(spark, sf_dir, False)


def graph_cross_domain(spark, sf_dir):
    hits = search.field_match(V.field_queries(spark, sf_dir), V.fields(spark, sf_dir), graph.POOL)
    found = graph.cross_domain(hits, V.areas(spark, sf_dir), V.edges(spark, sf_dir))
    return found.select("query_id", "paper_id", "area", "linked", "rank", F.round("score", 6).alias("score"))


def graph_subgraph(spark, sf_dir):
    return graph.subgraph(V.anchors(spark, sf_dir).withColumnRenamed("anchor", "node"), V.edges(spark, sf_dir)).select("src", "dst")


def graph_view(spark, sf_dir):
    titled = V.nodes(spark, sf_dir).join(V.papers(spark, sf_dir).select(F.col("paper_id").alias("node"), "title"), "node")
    return graph.view_nodes(titled, V.edges(spark, sf_dir))


def _contexts(spark, sf_dir):
    """Events as citation contexts: the user cites the event's number modulo 97, the event's type is the intent."""
    e = V.table(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("background"), F.lit("methodology"), F.lit("result")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("user_id").cast("long").alias("src"), (F.col("event_id") % 97).cast("long").alias("dst"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 5 > 0, F.array(F.lit("background"), kind)).alias("intents"))


def _blank_edges(spark, sf_dir):
    c = _contexts(spark, sf_dir).select("src", "dst").distinct()
    return c.withColumn("intent", F.when((F.col("src") + F.col("dst")) % 7 == 0, "background"))


def edge_intents(spark, sf_dir):
    return graph.annotate(_blank_edges(spark, sf_dir), _contexts(spark, sf_dir)).select("src", "dst", "intent")


def edge_intents_relabel(spark, sf_dir):
    return graph.annotate(_blank_edges(spark, sf_dir), _contexts(spark, sf_dir), relabel=True).select("src", "dst", "intent")


def intent_label_map(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    raw = F.element_at(F.array(*map(F.lit, ("Methodology", " result ", "LABEL-2", "label_1", "odd", "background"))), (F.col("event_id") % 6 + 1).cast("int"))
    e = e.select("event_id", raw.alias("raw"))
    return e.select("event_id", T.label_map(F.col("raw"), T.SERVICE_INTENTS).alias("service"), T.label_map(F.col("raw"), T.CLASSIFIER_INTENTS).alias("classifier"), T.reply_intent(F.concat(F.lit("It is a "), "raw")).alias("reply"))


_COS = V.COSINES
SIMILARITY = f"""{V.FIELD_TABLE}, {_COS},
similarity AS (SELECT query_id AS anchor, paper_id AS node, plain AS similarity FROM matches WHERE n_fields > 0)"""

ARRIVALS = f"""{V.EDGES}, {SIMILARITY},
e AS (SELECT src, dst, edge_pos, coalesce(intent, 'background') AS intent FROM edges),
l1 AS (
  SELECT src AS anchor, dst AS node, [src, dst] AS path, [intent] AS intents, 1 AS hop,
         row_number() OVER (PARTITION BY src ORDER BY edge_pos) AS seq FROM e WHERE src % 50 = 0),
f1 AS (SELECT *, row_number() OVER (PARTITION BY anchor, node ORDER BY seq) AS nth FROM l1 QUALIFY nth <= 15),
l2 AS (
  SELECT anchor, e.dst AS node, list_append(path, e.dst) AS path, list_append(intents, e.intent) AS intents, 2 AS hop,
         row_number() OVER (PARTITION BY anchor ORDER BY seq, edge_pos) AS seq
  FROM f1 JOIN e ON e.src = f1.node WHERE NOT list_contains(path, e.dst)),
arrived AS (SELECT anchor, node, path, intents, hop FROM l1 UNION ALL SELECT anchor, node, path, intents, hop FROM l2),
scored AS (
  SELECT a.*, list_sum(list_transform(intents, lambda i: CASE i WHEN 'method' THEN 1.0 WHEN 'comparison' THEN 0.2 ELSE 0.5 END)) / hop / hop
              * greatest(coalesce(similarity, 0.0), 1e-6) AS score
  FROM arrived a LEFT JOIN similarity USING (anchor, node)),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY anchor, node ORDER BY round(score, 9) DESC, hop, path) AS path_rank FROM scored QUALIFY path_rank <= 3),
heads AS (
  SELECT anchor, node, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, node) AS rank FROM kept WHERE path_rank = 1 QUALIFY rank <= 10)"""


def _opposing_sql(fallback: str) -> str:
    return f"""
WITH {V.EDGES}, {SIMILARITY},
near AS (
  SELECT src AS anchor, dst AS node, coalesce(intent, 'background') AS intent, 0 AS direction, edge_pos FROM edges
  UNION ALL SELECT dst, src, coalesce(intent, 'background'), 1, edge_pos FROM edges),
n AS (SELECT *, {fallback} AS fallback FROM near WHERE anchor % 50 = 0),
s AS (SELECT n.*, 1 - similarity AS score FROM n JOIN similarity USING (anchor, node) WHERE fallback OR intent = 'comparison'),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, direction, edge_pos, node) AS rank FROM s)
SELECT anchor, node, intent, fallback, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10
"""


CONTEXTS = """contexts AS (
  SELECT user_id AS src, event_id % 97 AS dst, event_id AS pos,
         CASE WHEN event_id % 5 > 0 THEN CASE event_id % 3 WHEN 0 THEN 'background' WHEN 1 THEN 'method' ELSE 'comparison' END END AS new
  FROM events),
blank AS (SELECT DISTINCT src, dst, CASE WHEN (src + dst) % 7 = 0 THEN 'background' END AS intent FROM contexts)"""


def _annotate_sql(pick: str, order: str) -> str:
    return f"""
WITH {CONTEXTS}, chosen AS (SELECT src, dst, {pick}(new, pos) AS new FROM contexts WHERE new IS NOT NULL AND src <> dst GROUP BY ALL)
SELECT src, dst, coalesce({order}) AS intent FROM blank LEFT JOIN chosen USING (src, dst)
"""


ORACLE = {
    "graph_build_stats": f"WITH {V.EDGES} SELECT (SELECT count(*) FROM embeddings) AS n_nodes, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)) AS n_isolated, (SELECT count(*) FROM edges) AS n_edges",
    "graph_degrees": f"WITH {V.EDGES} SELECT vec_id AS node, (SELECT count(*) FROM edges WHERE src = vec_id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = vec_id) AS in_degree FROM embeddings",
    "graph_ancestors": f"WITH {ARRIVALS} SELECT anchor, node, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM kept JOIN heads USING (anchor, node) WHERE path_rank = 1",
    "graph_ancestor_paths": f"""WITH {ARRIVALS} SELECT anchor, node, CAST(path_rank AS INTEGER) AS path_rank, array_to_string(path, '>') AS path, array_to_string(intents, '>') AS intents,
  path[1] || array_to_string(list_transform(list_zip(path[2:], intents), lambda x: ' -[' || x[2] || ']-> ' || x[1]), '') || ' (score 1.0000)' AS explanation FROM kept JOIN heads USING (anchor, node)""",
    "graph_opposing_intent": _opposing_sql("max((intent = 'comparison')::INT) OVER (PARTITION BY anchor) = 0"),
    "graph_opposing_fallback": _opposing_sql("true"),
    "graph_cross_domain": f"""
WITH {V.EDGES}, {V.FIELD_TABLE}, {_COS},
top AS (SELECT query_id, paper_id, plain AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(plain, 9) DESC, paper_id) AS rank FROM matches QUALIFY rank <= 30),
area AS (SELECT vec_id AS paper_id, 'area' || (label % 3) AS area FROM embeddings),
other AS (
  SELECT t.*, a.area, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth
  FROM top t JOIN area a USING (paper_id) JOIN area o ON o.paper_id = t.query_id WHERE a.area <> o.area QUALIFY nth <= 10),
near AS (SELECT src AS query_id, dst AS paper_id FROM edges UNION SELECT dst, src FROM edges),
s AS (SELECT o.* EXCLUDE (score), n.query_id IS NOT NULL AS linked, score * CASE WHEN n.query_id IS NOT NULL THEN 0.85 ELSE 1.0 END AS score
      FROM other o LEFT JOIN near n ON n.query_id = o.query_id AND n.paper_id = o.paper_id)
SELECT query_id, paper_id, area, linked, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, nth) AS INTEGER) AS rank, round(score, 6) AS score FROM s""",
    "graph_subgraph": f"""
WITH {V.EDGES}, seed AS (SELECT vec_id AS node FROM embeddings WHERE vec_id % 50 = 0),
inside AS (SELECT node FROM seed UNION SELECT dst FROM edges WHERE src IN (SELECT node FROM seed) UNION SELECT src FROM edges WHERE dst IN (SELECT node FROM seed))
SELECT src, dst FROM edges WHERE src IN (SELECT node FROM inside) AND dst IN (SELECT node FROM inside)""",
    "graph_view": f"""
WITH {V.EDGES}, {V.PAPERS},
d AS (SELECT vec_id AS node, (SELECT count(*) FROM edges WHERE src = vec_id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = vec_id) AS in_degree FROM embeddings)
SELECT node, CASE WHEN length(title) > 40 THEN left(title, 39) || '…' ELSE title END AS label, CAST(10 + least(in_degree, 30) AS INTEGER) AS size, in_degree, out_degree
FROM d JOIN papers ON paper_id = node""",
    "edge_intents": _annotate_sql("min_by", "intent, new"),
    "edge_intents_relabel": _annotate_sql("max_by", "new, intent"),
    "intent_label_map": """
WITH e AS (SELECT event_id, ['Methodology', ' result ', 'LABEL-2', 'label_1', 'odd', 'background'][event_id % 6 + 1] AS raw FROM events),
k AS (SELECT event_id, raw, replace(lower(trim(raw, ' ')), '-', '_') AS key FROM e)
SELECT event_id,
       CASE WHEN key IN ('methodology', 'method') THEN 'method' WHEN key IN ('result', 'comparison') THEN 'comparison' ELSE 'background' END AS service,
       CASE WHEN key IN ('label_1', 'method') THEN 'method' WHEN key IN ('label_2', 'result') THEN 'comparison' ELSE 'background' END AS classifier,
       CASE WHEN lower(raw) LIKE '%comparison%' THEN 'comparison' WHEN lower(raw) LIKE '%method%' THEN 'method' ELSE 'background' END AS reply FROM k""",
}

QUERIES = (
    graph_build_stats, graph_degrees, graph_ancestors, graph_ancestor_paths, graph_opposing_intent, graph_opposing_fallback,
    graph_cross_domain, graph_subgraph, graph_view, edge_intents, edge_intents_relabel, intent_label_map,
)
