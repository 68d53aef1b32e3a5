"""The order-dependent dedupe over a whole corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import corpus


def fold(key, part):
    """The greedy pass over one component's records, in order."""
    rows = zip(part["paper_id"], part["key"], part["work_id"], part["fuller"], part["pos"], strict=True)
    records = [{"paper_id": i, "ids": [w] if w else [], "key": k, "fuller": tuple(f)} for i, k, w, f, _ in sorted(rows, key=lambda r: r[4])]
    kept = corpus.greedy_dedupe(iter(records), corpus.word_counts(part["key"]))
    return pd.DataFrame({"component": [key[0]] * len(kept), "paper_id": [r["paper_id"] for r in kept]}).astype("int64")


def greedy(papers: DataFrame) -> DataFrame:
    """(component, paper_id): the papers that the greedy pass keeps, one or more for each group of titles that can meet.

    Papers may have a work_id (text), by which they meet first. Records of one title key meet in one slot, and one that
    is no fuller than an earlier one of its key and work never changes it; so of these the first counts, and copies are
    combined before they meet. A blank title matches nothing. A title that meets no other needs no pass: its fullest
    record stays, the first of equal ones.
    """
    work = F.coalesce(F.col("work_id").cast("string"), F.lit("")) if "work_id" in papers.columns else F.lit("")
    full = corpus.completeness(papers)
    keyed = papers.select("paper_id", "pos", corpus.own_key().alias("own"), T.title_key(F.col("title")).alias("key"), full.alias("c"), work.alias("work_id"))
    first = keyed.groupBy("own", "key", "c", "work_id").agg(F.min_by("paper_id", "pos").alias("paper_id"), F.min("pos").alias("pos"))
    reps = keyed.groupBy("own").agg(F.min("paper_id").alias("rep"))
    named = first.join(reps, "own")
    works = named.where("work_id <> ''").select("work_id", "rep").distinct()
    shared = works.join(works.groupBy("work_id").agg(F.min("rep").alias("a")), "work_id").where("a < rep").select("a", F.col("rep").alias("b"))
    linked = named.join(corpus.linked_titles(corpus.duplicate_titles(papers).unionByName(shared)), "rep", "left")
    alone = linked.where("component IS NULL").groupBy(F.col("rep").cast("long").alias("component")).agg(F.max_by("paper_id", F.struct("c", (-F.col("pos")).alias("p"))).cast("long").alias("paper_id"))
    parts = [F.col(f"c.{f.name}").cast("int") for f in keyed.schema["c"].dataType.fields]
    records = linked.where("component IS NOT NULL").select(F.col("component").cast("long"), F.col("paper_id").cast("long"), F.col("pos").cast("long"), "key", "work_id", F.array(*parts).alias("fuller"))
    return alone.unionByName(records.groupBy("component").applyInPandas(fold, "component long, paper_id long"))
