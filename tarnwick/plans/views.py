"""Stand-ins for papers, cards, vectors, edges, queries and gold titles, made from the test tables; in Spark and in SQL.

Edges, fields and intents are synthetic: they exercise operators, not retrieval quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import search

FIELDS = ("task", "backbone", "loss", "key_idea")
AREAS = {"spanish": ("ción", "ñ"), "german": ("ung", "ß"), "french": ("eau", "oi"), "english": ("the", "tion")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark, sf_dir) -> DataFrame:
    """documents: the first line is the title, what follows it the abstract."""
    end = F.instr("text", "\n")
    title = F.substring_index("text", "\n", 1)
    abstract = F.when(end > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("")
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("paper_id"), F.col("doc_id").alias("pos"), title.alias("title"), abstract.alias("abstract"), F.col("source").alias("origin"), "lang")


def texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")


def text_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding")


def vector_queries(spark, sf_dir) -> DataFrame:
    """Every row whose id is divisible by 50 is a query."""
    return vectors(spark, sf_dir).where("paper_id % 50 = 0").withColumnRenamed("paper_id", "query_id")


def fields(spark, sf_dir) -> DataFrame:
    """A card for each vector: quarters of it at length one; some fields are missing."""
    e, gone = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 61 == 0
    absent = {"task": gone, "backbone": gone | (F.col("vec_id") % 23 == 0), "loss": gone | (F.col("vec_id") % 4 == 0), "key_idea": gone}
    return e.select(F.col("vec_id").alias("paper_id"), *[F.when(~absent[f], search.unit(F.slice("embedding", 16 * i + 1, 16))).alias(f) for i, f in enumerate(FIELDS)])


def field_queries(spark, sf_dir) -> DataFrame:
    return fields(spark, sf_dir).where("paper_id % 50 = 0").withColumnRenamed("paper_id", "query_id")


def nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"))


def edges(spark, sf_dir) -> DataFrame:
    """src cites each smaller dst with (31 src + 17 dst) mod 101 below 2, solved for dst: no pairs are tried."""
    inverse = pow(17, -1, 101)
    n = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src")).where("src > 0")
    residues = F.explode(F.array(*[F.pmod((F.lit(r) - 31 * F.col("src")) * inverse, F.lit(101)) for r in (0, 1)])).alias("r")
    found = n.select("src", residues).where("r < src").select("src", F.explode(F.sequence(F.col("r"), F.col("src") - 1, F.lit(101).cast("long"))).alias("dst"))
    kind = (F.col("src") + F.col("dst")) % 4
    intent = F.when(kind == 1, "method").when(kind == 2, "background").when(kind == 3, "comparison")
    return found.join(nodes(spark, sf_dir).withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", F.col("dst").alias("edge_pos"), intent.alias("intent"))


def anchors(spark, sf_dir) -> DataFrame:
    return nodes(spark, sf_dir).where("node % 50 = 0").withColumnRenamed("node", "anchor")


def areas(spark, sf_dir) -> DataFrame:
    """An area for each node: its label in three groups."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), F.concat(F.lit("area"), (F.col("label") % 3).cast("string")).alias("area"))


def gold(spark, sf_dir) -> DataFrame:
    """The documents whose text holds a test item."""
    from tarnwick.operators import corpus

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), "text")
    return corpus.holding(items, texts(spark, sf_dir)).select(F.col("pattern_id").alias("query_id"), "paper_id")


def title_key_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def marked_up_key_sql(x: str) -> str:
    return title_key_sql(f"replace(replace(regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g'), '++', ' plusplus '), '+', ' plus ')")


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\\s+'), lambda x: x <> '')"


GENERIC_SQL = "[" + ", ".join(f"'{w}'" for w in T.GENERIC_TITLE_WORDS) + "]"

PAPERS = """papers AS (
  SELECT doc_id AS paper_id, doc_id AS pos, split_part(text, chr(10), 1) AS title,
         CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS abstract,
         source AS origin, lang FROM documents)"""

EDGES = """edges AS (
  SELECT a.vec_id AS src, b.vec_id AS dst, b.vec_id AS edge_pos,
         CASE (a.vec_id + b.vec_id) % 4 WHEN 1 THEN 'method' WHEN 2 THEN 'background' WHEN 3 THEN 'comparison' END AS intent
  FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND (a.vec_id * 31 + b.vec_id * 17) % 101 < 2)"""


def _unit_sql(first: int) -> str:
    part = f"list_transform(embedding[{first}:{first + 15}], lambda x: CAST(x AS DOUBLE))"
    return f"list_transform({part}, lambda x: x / sqrt(list_sum(list_transform({part}, lambda y: y * y))))"


FIELD_TABLE = f"""fields AS (
  SELECT vec_id AS paper_id,
         CASE WHEN vec_id % 61 <> 0 THEN {_unit_sql(1)} END AS task,
         CASE WHEN vec_id % 61 <> 0 AND vec_id % 23 <> 0 THEN {_unit_sql(17)} END AS backbone,
         CASE WHEN vec_id % 61 <> 0 AND vec_id % 4 <> 0 THEN {_unit_sql(33)} END AS loss,
         CASE WHEN vec_id % 61 <> 0 THEN {_unit_sql(49)} END AS key_idea FROM embeddings)"""


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


COSINES = f"""cosines AS (
  SELECT a.paper_id AS query_id, b.paper_id, {", ".join(f"{dot_sql(f'a.{f}', f'b.{f}')} AS {f}" for f in FIELDS)}
  FROM fields a JOIN fields b ON a.paper_id <> b.paper_id
  WHERE a.paper_id % 50 = 0 AND coalesce(a.task, a.backbone, a.loss, a.key_idea) IS NOT NULL),
matches AS (
  SELECT *, {" + ".join(f"({f} IS NOT NULL)::INT" for f in FIELDS)} AS n_fields,
         {" + ".join(f"coalesce({w} * {f}, 0.0)" for f, w in search.FIELD_WEIGHTS.items())} AS plain,
         {" + ".join(f"CASE WHEN {f} IS NOT NULL THEN {w} ELSE 0.0 END" for f, w in search.FIELD_WEIGHTS.items())} AS used
  FROM cosines)"""

GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS paper_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
