"""Ranking and classifier metrics, method tables, verdicts and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: nDCG below which a query is reported.
LOW = 0.30
#: Share of titles that must resolve.
RESOLVED = 0.60


def per_query(runs: DataFrame, gold: DataFrame, *, methods: list[str], anchored: DataFrame | None = None, k: int = 5, depth: int = 10) -> DataFrame:
    """nDCG at k, MRR and recall at ``depth`` of every method for every query with gold; relevance is being gold.

    runs: (method, query_id, paper_id, rank), gold: (query_id, paper_id). A method that finds nothing for a query scores
    0 there. Only field matching cannot run without an anchor: where ``anchored`` (query_id) is given, methods whose
    names start with ``method_match`` have no row for other queries. Queries without gold are left out.
    """
    gold = gold.select("query_id", "paper_id").distinct()
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    asked = sizes.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    if anchored is not None:
        runnable = anchored.select("query_id", F.lit(True).alias("runs")).distinct()
        asked = asked.join(runnable, "query_id", "left").where(~F.col("method").startswith("method_match") | F.col("runs")).drop("runs")
    found = runs.where(F.col("rank") <= depth).join(gold, ["query_id", "paper_id"], "left_semi")
    gain = F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    sums = found.groupBy("method", "query_id").agg(F.sum(gain).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("n_hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    every = asked.join(sums, ["method", "query_id"], "left")
    nothing = F.lit(0.0)
    return every.select("method", "query_id", F.coalesce(F.try_divide(F.col("dcg"), ideal), nothing).alias("ndcg"), F.coalesce(1.0 / F.col("first"), nothing).alias("mrr"), F.coalesce(F.col("n_hits") / F.col("n_gold"), nothing).alias("recall"))


def by_method(metrics: DataFrame) -> DataFrame:
    """Means of the metrics and the number of queries of each method."""
    return metrics.groupBy("method").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("ndcg", "mrr", "recall")])


def same_subset(metrics: DataFrame, anchored: DataFrame, without: tuple[str, ...] = ("bm25",)) -> DataFrame:
    """The metrics of queries (query_id) that are papers with a resolved anchor, where all methods can run; some are not compared."""
    return metrics.where(~F.col("method").isin(*without)).join(anchored.select("query_id"), "query_id", "left_semi")


def verdict(table: DataFrame, baseline: str = "dense", digits: int = 6) -> DataFrame:
    """Each other method's nDCG against the baseline's: BEATS, matches or BELOW, and the gate's exit code.

    The table is that of the same subset. A baseline of 0 gives no verdicts.
    """
    base = table.where((F.col("method") == baseline) & (F.col("ndcg") > 0)).select(F.col("ndcg").alias("base"))
    delta = F.round(F.col("ndcg") - F.col("base"), digits)
    word: Column = F.when(delta > 0, "BEATS").when(delta == 0, "matches").otherwise("BELOW")
    others = table.where(F.col("method") != baseline)
    return others.join(F.broadcast(base)).select("method", delta.alias("delta"), word.alias("verdict"), F.when(delta < 0, 2).otherwise(0).alias("code"))


def low_scores(metrics: DataFrame, threshold: float = LOW) -> DataFrame:
    """Rows whose nDCG is below the threshold; a missing one is 0."""
    return metrics.where(F.coalesce("ndcg", F.lit(0.0)) < threshold)


def latest(history: DataFrame) -> DataFrame:
    """The last row of each (method, notes) by pos."""
    last = Window.partitionBy("method", "notes").orderBy(F.desc("pos"))
    return history.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def classification(pairs: DataFrame, classes: list) -> DataFrame:
    """One row from (label, predicted): accuracy, and macro F1 over the classes given, those that never occur with 0."""
    every = pairs.sparkSession.createDataFrame([(c,) for c in classes], ["c"])
    ends = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("is_label")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("is_label")))).alias("e"), (F.col("label") == F.col("predicted")).cast("int").alias("ok"))
    sums = ends.groupBy("e.c").agg(F.sum(F.when(F.col("e.is_label") == 1, F.col("ok"))).alias("tp"), F.sum("e.is_label").alias("n_label"), F.sum(1 - F.col("e.is_label")).alias("n_predicted"))
    f1 = F.coalesce(F.try_divide(2.0 * F.coalesce("tp", F.lit(0)), F.col("n_label") + F.col("n_predicted")), F.lit(0.0))
    macro = F.broadcast(every).join(sums, "c", "left").agg(F.avg(f1).alias("macro_f1"))
    right = pairs.agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    return macro.join(F.broadcast(right)).select("macro_f1", "accuracy", "n")


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, rate): the percentage of rows where each text field is not blank, to one decimal, half to even."""
    rates = df.agg(*[F.avg(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1.0).otherwise(0.0)).alias(c) for c in columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.bround(100 * F.col(c), 1).alias("rate")) for c in columns])).alias("r")).select("r.field", "r.rate")
