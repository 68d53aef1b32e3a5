"""Prompts, model replies, citation checks, entities: what goes to language models and comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.vocabulary import ENTITY_KINDS


def messages(system: str, examples: list[tuple[str, str]], title: Column, abstract: Column) -> Column:
    """array(struct(role, content)): the system's words, examples in turns, and the paper at hand."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    own = F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\nAbstract: "), F.coalesce(abstract, F.lit("")))
    turns = [turn("system", F.lit(system))]
    for question, answer in examples:
        turns += [turn("user", F.lit(question)), turn("assistant", F.lit(answer))]
    return F.array(*turns, turn("user", own))


def estimated_tokens(prompt: Column) -> Column:
    """A quarter of the characters of all messages, rounded down."""
    return F.floor(F.aggregate(prompt, F.lit(0).cast("long"), lambda s, m: s + F.length(m["content"])) / 4)


def candidate_list(hits: DataFrame) -> DataFrame:
    """(query_id, candidates): numbered lines ``[n] title`` of each query's hits, by rank."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("<unknown>")))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l")).select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("candidates"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(id, paragraph, failed) of (id, raw): the reply's JSON field ``paragraph``, or the raw text where it is no JSON."""
    parsed = replies.withColumn("j", T.json_object(F.col("raw")))
    value = F.get_json_object("j", "$.paragraph")
    return parsed.select("id", F.coalesce(value, F.when(F.col("j").isNull(), T.unfenced(F.col("raw"))).otherwise("")).alias("paragraph"), F.col("j").isNull().alias("failed"))


def check_citations(cited: DataFrame, references: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Issues of generated paragraphs, one row each: id, issue, n.

    cited: (id, paragraph), references: (id, n, paper_id), retrieved: (id, n, paper_id) as shown to the model. Markers
    without a reference, references never marked, numbers that were not shown, and references whose paper is another.
    """
    marks = cited.select("id", F.explode(T.markers(F.col("paragraph"))).alias("n"))
    refs, shown = references.select("id", "n").distinct(), retrieved.select("id", "n").distinct()
    named = [
        (marks.join(refs, ["id", "n"], "left_anti"), "marker without reference"),
        (refs.join(marks, ["id", "n"], "left_anti"), "reference never cited"),
        (marks.unionByName(refs).distinct().join(shown, ["id", "n"], "left_anti"), "number not shown"),
        (references.join(retrieved.select("id", "n", F.col("paper_id").alias("p")), ["id", "n"]).where("paper_id <> p").select("id", "n"), "paper differs"),
    ]
    out = None
    for rows, issue in named:
        part = rows.select("id", F.lit(issue).alias("issue"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def entity_kind(label: Column) -> Column:
    """The kind that a recogniser's label stands for, marks of place and kind taken off; null if none."""
    bare = F.regexp_replace(F.lower(F.trim(label)), "[bi]-|entity_|label_", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(ENTITY_KINDS.items()) for x in pair]), bare)


def joined_pieces(word: Column) -> Column:
    """A word's pieces as one: `` ##`` and ``##`` taken out."""
    return F.replace(F.replace(word, F.lit(" ##"), F.lit("")), F.lit("##"), F.lit(""))


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """The first of each (paper_id, lower-cased text, kind) by pos, from (paper_id, pos, word, label, score)."""
    clean = entities.select("paper_id", "pos", F.trim(joined_pieces(F.col("word"))).alias("text"), entity_kind(F.col("label")).alias("kind"), "score").where("kind IS NOT NULL AND text <> ''")
    first = Window.partitionBy("paper_id", F.lower("text"), "kind").orderBy("pos")
    return clean.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(paper_id, term, start, end): where each paper's own terms stand first in its text, case aside; misses left out."""
    joined = terms.where("trim(term) <> ''").join(texts, "paper_id").select("paper_id", "term", (F.instr(F.lower("text"), F.lower("term")) - 1).alias("start"))
    return joined.where("start >= 0").select("paper_id", "term", "start", (F.col("start") + F.length("term")).alias("end"))


def missing(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows that the cache (paper_id) does not have yet."""
    return wanted.join(cached.select("paper_id"), "paper_id", "left_anti")


def sampled(df: DataFrame, n: int, seed: int = 0, by: str = "paper_id") -> DataFrame:
    """n rows at random, the same ones for the same seed: those whose ids hash lowest with it."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(by), F.lit(seed))), by).limit(n)


def apply_model(df: DataFrame, column: str, model: Callable[[list], list], output: str = "output") -> DataFrame:
    """df (paper_id, column) with an injected model's answer for each value; batches of Arrow rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            yield pa.RecordBatch.from_arrays([data.column(0), pa.array(model(data.column(1).to_pylist()), pa.string())], names=["paper_id", output])

    return df.select(F.col("paper_id").cast("long"), column).mapInArrow(run, f"paper_id long, {output} string")
