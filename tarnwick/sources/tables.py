"""Readers and writers: corpora and cards as JSON or Parquet, caches, histories, landed service pages.

Readers take explicit schemas: unknown keys are dropped and missing ones become defaults, as the data model asks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAPER = (
    "paper_id STRING, title STRING, abstract STRING, year INT, authors ARRAY<STRING>, citation_count INT, "
    "external_ids MAP<STRING, STRING>, references ARRAY<STRING>, citations ARRAY<STRING>, source_ids MAP<STRING, STRING>"
)
CARD = (
    "paper_id STRING, task STRING, input STRING, output STRING, backbone STRING, loss STRING, key_idea STRING, "
    "datasets ARRAY<STRING>, metrics ARRAY<STRING>, name STRING, problem STRING, method STRING, baselines ARRAY<STRING>"
)
GOLD = "id STRING, mode STRING, text STRING, gold_titles ARRAY<STRING>, notes STRING, anchor_title STRING, arxiv STRING"
HISTORY = "ts STRING, method STRING, metrics MAP<STRING, DOUBLE>, notes STRING"


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of papers with ``pos``, their order in the file, and defaults for what is missing.

    The order is that of one file; for corpora beyond one file, write Parquet with a pos of their own.
    """
    df = spark.read.schema(PAPER).option("multiLine", True).json(path)
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("authors", "references", "citations")]
    maps = [F.coalesce(c, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")).alias(c) for c in ("external_ids", "source_ids")]
    return df.select("paper_id", "title", "abstract", "year", F.coalesce("citation_count", F.lit(0)).alias("citation_count"), *lists, *maps, F.monotonically_increasing_id().alias("pos"))


def by_id(papers: DataFrame) -> DataFrame:
    """One row for each id, the last by pos."""
    rest = [c for c in papers.columns if c != "paper_id"]
    last = papers.groupBy("paper_id").agg(F.max_by(F.struct(*rest), "pos").alias("r"))
    return last.select("paper_id", "r.*")


def read_cards(spark: SparkSession, folder: str) -> DataFrame:
    """All cards of a folder, one JSON object a file; the id is that within the file."""
    return spark.read.schema(CARD).option("multiLine", True).json(folder).where("paper_id IS NOT NULL")


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, titles): the queries, and one row for each of their gold titles."""
    queries = spark.read.schema(f"version STRING, queries ARRAY<STRUCT<{', '.join(f'{c.split()[0]}: {c.split(maxsplit=1)[1]}' for c in GOLD.split(', '))}>>").option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")
    return queries, queries.select(F.col("id").alias("query_id"), F.posexplode("gold_titles").alias("n", "title"))


def safe_name(paper_id):
    """An id as a file name."""
    return F.replace(paper_id, F.lit("/"), F.lit("_"))


def append_missing(wanted: DataFrame, path: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Makes and appends rows for the ids that the Parquet cache at ``path`` lacks; how many there were."""
    spark = wanted.sparkSession
    todo = wanted
    if _exists(spark, path):
        todo = wanted.join(spark.read.parquet(path).select("paper_id"), "paper_id", "left_anti")
    n = todo.count()
    if n:
        make(todo).write.mode("append").parquet(path)
    return n


def write_versioned(df: DataFrame, folder: str, *, partial: bool = False) -> str:
    """Writes a new version; only a whole one is named as current, and no earlier one is touched."""
    path = f"{folder}/{'partial' if partial else 'version'}-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return path


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The path of the newest whole version, if there is one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    return next((f"{folder}/{x}" for x in reversed(names) if x.startswith("version-")), None)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_history(metrics: DataFrame, path: str, stamp: str, notes: str = "") -> None:
    """Appends (method, ndcg, mrr, recall) as history rows, numbers to four decimals."""
    values = F.map_from_arrays(F.array(*map(F.lit, ("ndcg", "mrr", "recall"))), F.array(*[F.round(c, 4) for c in ("ndcg", "mrr", "recall")]))
    metrics.select(F.lit(stamp).alias("ts"), "method", values.alias("metrics"), F.lit(notes).alias("notes")).write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def landed_contexts(items: DataFrame) -> DataFrame:
    """Context records from landed reference items: citing_id, pos, context, contexts, intents and the cited ids.

    items: citing_id, pos, isInfluential, intents, contexts, citedPaper (paperId, title, externalIds).
    """
    from tarnwick.functions import text as T

    ids = F.col("citedPaper.externalIds")

    def kept(c):
        return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))

    held = kept(F.col("contexts"))
    return items.select(
        "citing_id", "pos", F.coalesce(F.get(held, F.lit(0)), F.lit("")).alias("context"), held.alias("contexts"), kept(F.col("intents")).alias("intents"),
        F.coalesce("isInfluential", F.lit(False)).alias("is_influential"), T.doi(F.try_element_at(ids, F.lit("DOI"))).alias("cited_doi"), F.try_element_at(ids, F.lit("MAG")).alias("cited_mag"),
        F.try_element_at(ids, F.lit("ArXiv")).alias("cited_arxiv"), F.col("citedPaper.paperId").alias("cited_s2_id"), F.col("citedPaper.title").alias("cited_title"),
    )


def resolved_contexts(contexts: DataFrame, papers: DataFrame) -> DataFrame:
    """(src, dst, pos, intents): contexts whose cited paper is in the corpus, by DOI, else by MAG id; the last of equal ids wins."""
    from tarnwick.functions import text as T

    ids = papers.select("paper_id", "pos", T.doi(F.try_element_at("external_ids", F.lit("doi"))).alias("doi"), F.try_element_at("external_ids", F.lit("mag")).alias("mag"))
    doi = ids.where("doi IS NOT NULL").groupBy(F.col("doi").alias("cited_doi")).agg(F.max_by("paper_id", "pos").alias("by_doi"))
    mag = ids.where("mag IS NOT NULL").groupBy(F.col("mag").alias("cited_mag")).agg(F.max_by("paper_id", "pos").alias("by_mag"))
    found = contexts.join(doi, "cited_doi", "left").join(mag, "cited_mag", "left").withColumn("dst", F.coalesce("by_doi", "by_mag"))
    return found.where("dst IS NOT NULL").select(F.col("citing_id").alias("src"), "dst", "pos", "intents")


def with_backoff(call: Callable, *, tries: int = 5, first: float = 2.0, retry: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """call()'s value; after an error that ``retry`` accepts it waits, twice as long each time, and tries again."""
    wait = first
    for i in range(tries):
        try:
            return call()
        except Exception as e:
            if i == tries - 1 or not retry(e):
                raise
            sleep(wait)
            wait *= 2
    raise ValueError("tries must be positive")


def all_pages(fetch: Callable, n: int, size: int = 200) -> list:
    """Up to n items from ``fetch(cursor, size) -> (items, next cursor)``; ends at an empty page or without a cursor."""
    have: list = []
    cursor = "*"
    while len(have) < n and cursor:
        items, cursor = fetch(cursor, min(n - len(have), size))
        if not items:
            break
        have += items
    return have[:n]


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("n_ = 1").drop("n_")
