"""Corpus building: gates, duplicates, merges, balanced selection, title resolution."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from math import ceil, log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.sources.shared import written

#: Overlap of the shorter title's words, and ratio of the titles' lengths, from which titles are duplicates.
OVERLAP, LENGTH_RATIO, LEAST_WORDS = 0.9, 0.75, 3
#: Likeness from which a title resolves to the closest one.
CLOSE = 0.85
#: Bounds by which gold keys are grouped: the nearer to one, the fewer lengths fit.
BOUNDS = (0.9, 0.95, 0.98, 0.99)


def with_abstract(papers: DataFrame) -> DataFrame:
    return papers.where("abstract IS NOT NULL AND abstract <> ''")


def topical(text: Column, *keyword_groups) -> Column:
    """Whether a text holds a word of every group, case aside."""
    low, found = F.lower(text), F.lit(True)
    for group in keyword_groups:
        found = found & T.contains_any(low, group)
    return found


def first_area(text: Column, areas: dict[str, tuple[str, ...]], default: str = "other") -> Column:
    """The first area, in the order given, one of whose keywords the text holds."""
    low, found = F.lower(text), None
    for name, words in areas.items():
        here = T.contains_any(low, words)
        found = F.when(here, name) if found is None else found.when(here, name)
    return found.otherwise(default)


def completeness(papers: DataFrame) -> Column:
    """What makes one record fuller than another, compared from left to right; lists that papers lack count for nothing."""
    lists = [F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ("references", "authors", "source_ids") if c in papers.columns]
    return F.struct((F.coalesce("abstract", F.lit("")) != "").cast("int").alias("has"), F.length(F.coalesce("abstract", F.lit(""))).alias("n"), *lists)


def own_key() -> Column:
    """The title's key; a blank title equals no other and has its paper's id, which no key can be."""
    key = T.title_key(F.col("title"))
    return F.when(key == "", F.concat(F.lit("#"), F.col("paper_id").cast("string"))).otherwise(key)


def dedupe_exact(papers: DataFrame) -> DataFrame:
    """One paper for each title key: the most complete, ties to the first; slot is the first's position.

    Papers have paper_id, pos, title and abstract, and may have lists of references, authors and source_ids. A paper
    with a blank title is its own. Columns: key, paper_id, slot, n.
    """
    keyed = papers.select("paper_id", "pos", own_key().alias("key"), completeness(papers).alias("c"))
    best = F.max_by("paper_id", F.struct("c", (-F.col("pos")).alias("p")))
    return keyed.groupBy("key").agg(best.alias("paper_id"), F.min("pos").alias("slot"), F.count("*").alias("n"))


def title_classes(papers: DataFrame) -> DataFrame:
    """(rep, key, words, chars): distinct title keys with the smallest paper that has each, and significant words."""
    keyed = papers.select("paper_id", T.title_key(F.col("title")).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.min("paper_id").alias("rep")).select("rep", "key", T.significant_tokens(F.col("key")).alias("words"), F.length("key").alias("chars"))


def duplicate_titles(papers: DataFrame) -> DataFrame:
    """(a, b) for different titles of one work, each by the smallest paper that has it; a < b.

    Of two titles the one of fewer characters is the shorter; of equal ones that of b. They match if the shorter has
    one significant word, of four letters at least, that the longer holds; or if it has three such words at least, 90 %
    of which the longer holds, and their lengths are within three quarters. Equal titles are one class and make no
    pairs; titles with the same one word are paired with the first of them.

    A shorter title of s words misses at most s - ceil(0.9 s) of them in a match, so one more of its rarest words
    suffices to find every match: those meet all words of longer titles of a fitting length.
    """
    titles = title_classes(papers)
    words = titles.select("rep", "chars", F.size("words").alias("s"), F.explode("words").alias("w"))
    rarity = words.groupBy("w").agg(F.count("*").alias("df"))
    least = F.ceil(F.col("s") * OVERLAP).cast("int")
    ordered = words.where(F.col("s") >= LEAST_WORDS).join(rarity, "w").withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("df", "w")))
    rare = ordered.where(F.col("nth") <= F.col("s") - least + 1).select("w", F.col("rep").alias("short"), F.col("chars").alias("cs"))
    long = words.select("w", F.col("rep").alias("long"), F.col("chars").alias("cl"), F.col("s").alias("sl"))
    is_short = (F.col("cs") < F.col("cl")) | ((F.col("cs") == F.col("cl")) & (F.col("short") > F.col("long")))
    candidates = rare.join(long, "w").where(is_short & (F.col("cs") >= LENGTH_RATIO * F.col("cl"))).select("short", "long").distinct()
    own = titles.select(F.col("rep").alias("short"), F.col("words").alias("ws"))
    other = titles.select(F.col("rep").alias("long"), F.col("words").alias("wl"))
    checked = candidates.join(own, "short").join(other, "long").where(F.size(F.array_intersect("ws", "wl")) >= OVERLAP * F.size("ws") - 1e-9)
    one = words.where((F.col("s") == 1) & (F.length("w") >= 4)).select("w", F.col("rep").alias("short"), F.col("chars").alias("cs"))
    held = one.join(long.where("sl > 1"), "w").where(is_short)
    same = one.join(one.groupBy("w").agg(F.min("short").alias("long")), "w").where("short <> long")
    both = checked.select("short", "long").unionByName(held.select("short", "long")).unionByName(same.select("short", "long"))
    return both.select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()


class KnownTitles:
    """Title keys in the order in which they came, found again by the rarest of the significant words that they share.

    A match holds at least 0.9 of the shorter title's s words, so any s - ceil(0.9 s) + 1 of these meet it: those of
    a known shorter title are one index, those of a new shorter title are looked up in an index of all words. Titles
    stand in both by classes of their lengths, a factor of 4/3 each. ``rarity`` tells how frequent words are; it has a
    say in the time only.
    """

    def __init__(self, rarity: dict[str, int] | None = None) -> None:
        self.rarity = rarity or {}
        self.number: dict[str, int] = {}
        self.chars = array("q")
        self.words: list[array] = []
        self.word_number: dict[str, int] = {}
        self.holders: dict[int, dict[int, array]] = {}  # word, class of length
        self.shorter: dict[int, dict[int, array]] = {}  # the same, by each title's rare words only
        self.single: dict[int, array] = {}  # titles of one significant word, of four letters at least

    def learn(self, key: str) -> int:
        """The number of the key, a new one if it is not known."""
        if key not in self.number:
            own = self.number[key] = len(self.words)
            words = sorted(significant(key))
            numbers = array("q", [self.word_number.setdefault(w, len(self.word_number)) for w in words])
            self.chars.append(len(key))
            self.words.append(numbers)
            for w in numbers:
                self.holders.setdefault(w, {}).setdefault(length_class(len(key)), array("q")).append(own)
            if len(words) >= LEAST_WORDS:
                for w in self.rare(words):
                    self.shorter.setdefault(self.word_number[w], {}).setdefault(length_class(len(key)), array("q")).append(own)
            elif len(words) == 1 and len(words[0]) >= 4:
                self.single.setdefault(numbers[0], array("q")).append(own)
        return self.number[key]

    def rare(self, words) -> list[str]:
        return sorted(words, key=lambda w: (self.rarity.get(w, 0), -len(w), w))[: len(words) - ceil(OVERLAP * len(words) - 1e-9) + 1]

    def match(self, key: str) -> int | None:
        """The number of the same key, else of the first that duplicate_titles' rule matches; of equal lengths this is the shorter."""
        if key in self.number:
            return self.number[key]
        words, chars, best = significant(key), len(key), len(self.words)
        known = {self.word_number[w] for w in words if w in self.word_number}
        # longer ones
        if len(words) == 1 and len(next(iter(words))) >= 4:
            for w in known:
                best = min((other for part in self.holders[w].values() for other in part if self.chars[other] >= chars), default=best)
        elif len(words) >= LEAST_WORDS:
            for other in self.near(self.holders, (self.word_number[w] for w in self.rare(words) if w in self.word_number), chars, range(3)):
                if other < best and self.chars[other] >= chars >= LENGTH_RATIO * self.chars[other] and self.both(known, other) >= OVERLAP * len(words) - 1e-9:
                    best = other
        # shorter ones
        for w in known:
            best = min([best, *(other for other in self.single.get(w, ()) if self.chars[other] < chars)])
        for other in self.near(self.shorter, known, chars, range(-2, 1)):
            if other < best and chars > self.chars[other] >= LENGTH_RATIO * chars and self.both(known, other) >= OVERLAP * len(self.words[other]) - 1e-9:
                best = other
        return best if best < len(self.words) else None

    def near(self, index: dict[int, dict[int, array]], words: Iterable[int], chars: int, classes: range) -> set[int]:
        own, found = length_class(chars), set()
        for w in words:
            by_class = index.get(w)
            if by_class:
                for c in classes:
                    found.update(by_class.get(own + c, ()))
        return found

    def both(self, words: set[int], other: int) -> int:
        return sum(w in words for w in self.words[other])


def length_class(chars: int) -> int:
    """Lengths whose ratio is 3/4 at least are two classes apart at most."""
    return int(log(max(1, chars)) / log(1 / LENGTH_RATIO))


def word_counts(keys: Iterable[str]) -> Counter:
    return Counter(w for key in keys for w in significant(key))


def significant(key: str) -> frozenset[str]:
    return frozenset(key.split()) - frozenset(T.GENERIC_TITLE_WORDS)


def greedy_dedupe(records: Iterator[dict], rarity: dict[str, int] | None = None) -> list[dict]:
    """One pass in order over records with ``ids``, ``key`` and ``fuller`` (comparable): each match keeps the fuller in its slot.

    A record goes to the slot last known for an id of its own, else for its title (see KnownTitles). One that is not
    fuller than the slot's leaves no trace; any other is what the slot's id and title stand for from then on. A blank
    title matches nothing. ``rarity``: see KnownTitles.
    """
    slots: list[dict] = []
    titles, slot_of_title, slot_of_id = KnownTitles(rarity), {}, {}
    for record in records:
        places = [slot_of_id[i] for i in record["ids"] if i in slot_of_id]
        if not places and record["key"]:
            known = titles.match(record["key"])
            places = [] if known is None else [slot_of_title[known]]
        place = places[0] if places else len(slots)
        if not places:
            slots.append(record)
        elif record["fuller"] <= slots[place]["fuller"]:
            continue
        slots[place] = record
        slot_of_id.update(dict.fromkeys(record["ids"], place))
        if record["key"]:
            slot_of_title[titles.learn(record["key"])] = place
    return slots


def linked_titles(pairs: DataFrame) -> DataFrame:
    """(rep, component): the smallest class that each class of (a, b) reaches; each round hooks and contracts."""
    edges = written(pairs.select("a", "b").where("a < b").distinct(), "pairs")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("m")).select("rep", F.least("rep", "m").alias("to")), "hook")
        if found is None:
            found = hook.select("rep", F.col("to").alias("component"))
        else:
            onward = hook.select(F.col("rep").alias("component"), F.col("to").alias("next"))
            found = written(found.join(onward, "component", "left").select("rep", F.coalesce("next", "component").alias("component")), "found")
        x, y = hook.select(F.col("rep").alias("a"), F.col("to").alias("x")), hook.select(F.col("rep").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "pairs")
    return found if found is not None else pairs.select(F.col("a").alias("rep"), F.col("a").alias("component"))


def _new_seeds(key, part):
    """Of one component's titles the seeds that match neither the corpus nor a seed taken before."""
    titles, taken = KnownTitles(word_counts(part["key"])), []
    for r in part.sort_values(["seed", "pos"]).itertuples():
        if not r.seed:
            titles.learn(r.key)
        elif titles.match(r.key) is None:
            titles.learn(r.key)
            taken.append(r.paper_id)
    return pd.DataFrame({"paper_id": taken}).astype("int64")


def merge_seeds(corpus: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds, in order of pos, that no paper of the corpus and no seed taken before has by id or by a matching title.

    Ids are longs. Titles match as in duplicate_titles, so blank ones match nothing.
    """
    first = seeds.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("pos"))).where("n = 1").drop("n")
    new = first.join(corpus.select("paper_id"), "paper_id", "left_anti")
    columns = ["paper_id", "pos", "title"]
    both = corpus.select(*columns, F.lit(False).alias("seed")).unionByName(new.select(*columns, F.lit(True).alias("seed")))
    titles = both.groupBy(own_key().alias("key"), "seed").agg(F.min("paper_id").alias("least"), F.min_by("paper_id", "pos").alias("paper_id"), F.min("pos").alias("pos"))
    reps = titles.groupBy("key").agg(F.min("least").alias("rep"), F.max(~F.col("seed")).alias("there"))
    groups = linked_titles(duplicate_titles(both))
    known = titles.join(reps, "key").join(groups, "rep", "left")
    alone = known.where("component IS NULL AND seed AND NOT there").select("paper_id")
    met = known.where("component IS NOT NULL").select("component", F.col("paper_id").cast("long"), F.col("pos").cast("long"), "key", "seed")
    taken = alone.unionByName(met.groupBy("component").applyInPandas(_new_seeds, "paper_id long"))
    return new.join(taken, "paper_id", "left_semi")


def merge_ids(corpus: DataFrame, wanted: DataFrame, works: DataFrame) -> DataFrame:
    """(paper_id, outcome) for each wanted id: present, added, or failed where no work has it."""
    have = corpus.select("paper_id").distinct().withColumn("have", F.lit(True))
    found = works.select("paper_id").distinct().withColumn("found", F.lit(True))
    joined = wanted.select("paper_id").distinct().join(have, "paper_id", "left").join(found, "paper_id", "left")
    return joined.select("paper_id", F.when(F.col("have"), "present").when(F.col("found"), "added").otherwise("failed").alias("outcome"))


def balanced_select(papers: DataFrame, areas: list[str], target: int) -> DataFrame:
    """The first ``target`` papers taken in turns from the areas, in the areas' order; other areas come not at all.

    Papers have paper_id, pos and area; the result has paper_id, area and turn.
    """
    order = F.create_map(*[F.lit(x) for i, a in enumerate(areas) for x in (a, i)])
    turns = papers.where(F.col("area").isin(*areas)).withColumn("turn", F.row_number().over(Window.partitionBy("area").orderBy("pos")))
    return turns.withColumn("place", order[F.col("area")]).orderBy("turn", "place").limit(target).select("paper_id", "area", "turn")


def first_seen(records: DataFrame) -> DataFrame:
    """(key, area): the area that each key came from first, from (key, area, pos)."""
    return records.groupBy("key").agg(F.min_by("area", "pos").alias("area"))


def holding(patterns: DataFrame, docs: DataFrame, block: int = 20_000) -> DataFrame:
    """(pattern_id, paper_id) where a document's text holds a pattern's text as it is; empty patterns match nothing.

    All patterns of a block are searched in one pass over each text; blocks keep what is broadcast bounded.
    """
    spark, found = docs.sparkSession, None
    rows: list = []

    def scan_for(pairs: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(pairs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            owners: dict[str, list] = {}
            for i, text in shared.value:
                owners.setdefault(text, []).append(i)
            for text, ids in owners.items():
                automaton.add_word(text, ids)
            automaton.make_automaton()
            for data in batches:
                a: list = []
                b: list = []
                for doc, text in zip(data.column(0).to_pylist(), data.column(1).to_pylist(), strict=True):
                    hits = sorted({i for _, ids in automaton.iter(text or "") for i in ids})
                    a += hits
                    b += [doc] * len(hits)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["pattern_id", "paper_id"])

        return docs.select(F.col("paper_id").cast("long"), "text").mapInArrow(run, "pattern_id long, paper_id long")

    for r in patterns.where("text <> ''").select(F.col("pattern_id").cast("long"), "text").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == block:
            part = scan_for(rows)
            found, rows = part if found is None else found.unionByName(part), []
    if rows:
        part = scan_for(rows)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "pattern_id long, paper_id long") if found is None else found


def resolve_titles(gold: DataFrame, papers: DataFrame, aliases: dict[str, str] | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """(title_id, paper_id, strategy) of each gold title by the first way that works.

    Ways: an anchor (key, paper_id) whose paper is there; the whole key; what stands before a colon; an alias's part of
    a key; the key as part of a longer one (four characters at least). Of several papers the first by pos counts. Where
    a title is an alias whose part no paper has, nothing else is tried; what nothing resolves has nulls.
    """
    keyed = papers.select("paper_id", "pos", T.marked_up_title_key(F.col("title")).alias("key"), T.marked_up_title_key(F.substring_index("title", ":", 1)).alias("head"), F.col("title").contains(":").alias("colon"))
    exact = keyed.where("key <> ''").groupBy("key").agg(F.min_by("paper_id", "pos").alias("exact"))
    heads = keyed.where("colon AND head <> ''").groupBy(F.col("head").alias("key")).agg(F.min_by("paper_id", "pos").alias("head"))
    joined = gold.select("title_id", T.marked_up_title_key(F.col("title")).alias("key")).join(exact, "key", "left").join(heads, "key", "left")
    entries = F.create_map(*[F.lit(x) for pair in sorted((aliases or {}).items()) for x in pair]) if aliases else None
    joined = joined.withColumn("target", F.try_element_at(entries, F.col("key")) if aliases else F.lit(None).cast("string"))
    if anchors is not None:
        there = anchors.select("key", F.col("paper_id").alias("anchor")).join(papers.select(F.col("paper_id").alias("anchor")).distinct(), "anchor", "left_semi")
        joined = joined.join(there, "key", "left")
    else:
        joined = joined.withColumn("anchor", F.lit(None).cast(papers.schema["paper_id"].dataType))
    pattern = F.coalesce("target", F.when(F.length("key") >= 4, F.col("key")))
    still = joined.where("exact IS NULL AND head IS NULL AND anchor IS NULL").select(F.col("title_id").alias("pattern_id"), pattern.alias("text"))
    parts = holding(still, keyed.select(F.col("pos").alias("paper_id"), F.col("key").alias("text")))
    first = parts.groupBy(F.col("pattern_id").alias("title_id")).agg(F.min("paper_id").alias("pos")).join(keyed.select("pos", F.col("paper_id").alias("part")), "pos").drop("pos")
    out = joined.join(first, "title_id", "left")
    strategy = F.when(F.col("anchor").isNotNull(), "anchor").when(F.col("exact").isNotNull(), "exact").when(F.col("head").isNotNull(), "colon").when(F.col("part").isNotNull(), F.when(F.col("target").isNotNull(), "alias").otherwise("substring"))
    return out.select("title_id", F.coalesce("anchor", "exact", "head", "part").alias("paper_id"), strategy.alias("strategy"))


def _sketched(titles: DataFrame) -> DataFrame:
    """(title_id, key, h): hashes of a key's word pairs, or triples if it has six words: the four least, or that of the whole of a shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            hashes = []
            for key in data.column(1).to_pylist():
                words = key.split(" ")
                n = 3 if len(words) >= 6 else 2
                hashes.append(sorted({crc32(" ".join(words[i : i + n]).encode()) for i in range(max(1, len(words) - n + 1))})[:4])
            at = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([data.column(0).take(at), data.column(1).take(at), pa.array([x for h in hashes for x in h], pa.int64())], names=["title_id", "key", "h"])

    return titles.mapInArrow(run, "title_id long, key string, h long")


def _first_ratios(gold: DataFrame, keys: DataFrame) -> DataFrame:
    """(title_id, key, least): the ratio of one title key that shares the sketch, 0 if none does; a bound for the best."""
    mine = _sketched(gold.select("title_id", "key")).withColumnRenamed("key", "wanted")
    # of the titles of one hash one is enough, as this is but a bound: that next in length
    other = _sketched(keys.select(F.lit(0).cast("long").alias("title_id"), "key")).groupBy("h", F.length("key").alias("chars")).agg(F.min("key").alias("key"))
    pairs = mine.join(other, "h").where(F.abs(F.length("wanted") - F.col("chars")) <= 0.3 * F.length("wanted"))
    shared = pairs.groupBy("title_id", "wanted", "key").agg(F.count("*").alias("n"), F.first(-F.abs(F.length("wanted") - F.col("chars"))).alias("near"))
    best = shared.groupBy("title_id", "wanted").agg(F.max_by("key", F.struct("n", "near", "key")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            ratios = [SequenceMatcher(None, other, wanted).ratio() if other else 0.0 for wanted, other in zip(data.column(1).to_pylist(), data.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([data.column(0), data.column(1), pa.array(ratios, pa.float64())], names=["title_id", "key", "least"])

    found = gold.select("title_id", F.col("key").alias("wanted")).join(best, ["title_id", "wanted"], "left")
    return written(found.mapInArrow(run, "title_id long, key string, least double"), "first-ratios")


def close_titles(gold: DataFrame, papers: DataFrame, cutoff: float = CLOSE, block: int = 2_000_000) -> DataFrame:
    """(title_id, paper_id, ratio): the paper whose title key is most like each gold key, if any reaches the cutoff.

    gold has title_id and key, papers have paper_id, pos and key; of equal ratios the greater key counts, of equal keys
    the first paper. Likeness is Ratcliff-Obershelp's 2M/T. One title that shares word runs gives a gold key's bound
    first; then gold keys go to the papers in blocks of about ``block`` characters and each task keeps its own best, so
    neither what is broadcast nor what is shuffled grows with the papers. Pairs whose lengths, whose characters as a
    bag, or whose longest common subsequence rule out the bound are not compared further.
    """
    spark = papers.sparkSession
    keys = papers.where("key <> ''").groupBy("key").agg(F.min_by("paper_id", "pos").alias("paper_id"))
    # Comparing costs far more than the keys weigh, so partitions must not be merged by their size.
    spread = keys.select("key").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def scan_for(wanted: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(sorted(wanted, key=lambda g: len(g[1])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            targets = CloseTitles([CloseTitle(i, key, least) for i, key, least in shared.value], cutoff)
            for data in batches:
                for key in data.column(0).to_pylist():
                    targets.meet(key)
            hits = [t for t in targets.all if t.best]
            yield pa.RecordBatch.from_arrays([pa.array([t.title_id for t in hits], pa.int64()), pa.array([t.best[0] for t in hits], pa.float64()), pa.array([t.best[1] for t in hits], pa.string())], names=["title_id", "ratio", "key"])

        return spread.mapInArrow(run, "title_id long, ratio double, key string")

    parts, held, size = [], [], 0
    for r in _first_ratios(gold.where("key <> ''").select(F.col("title_id").cast("long"), "key"), keys).toLocalIterator():
        held.append((r[0], r[1], r[2]))
        size += len(r[1])
        if size >= block:
            parts.append(scan_for(held))
            held, size = [], 0
    if held or not parts:
        parts.append(scan_for(held))
    best = reduce(DataFrame.unionByName, parts).groupBy("title_id").agg(F.max(F.struct("ratio", "key")).alias("best"))
    return best.select("title_id", "best.ratio", "best.key").join(keys, "key").select("title_id", "paper_id", "ratio")


class CloseTitle:
    """A gold key, the ratio that its best is known to reach, and the likest title key it has met."""

    def __init__(self, title_id: int, key: str, least: float):
        self.title_id, self.key, self.least = title_id, key, least
        self.best: tuple[float, str] | None = None
        self.places: dict[str, int] = {}

    def common(self, other: str) -> int:
        """Length of the longest common subsequence, a column of the table at a time as the bits of one number."""
        if not self.places:
            for i, c in enumerate(self.key):
                self.places[c] = self.places.get(c, 0) | 1 << i
        full = (1 << len(self.key)) - 1
        open_ = full
        for c in other:
            hit = open_ & self.places.get(c, 0)
            open_ = (open_ + hit | open_ - hit) & full
        return len(self.key) - open_.bit_count()

    def meet(self, other: str) -> None:
        if 2.0 * self.common(other) / (len(self.key) + len(other)) < self.least:
            return
        ratio = SequenceMatcher(None, other, self.key).ratio()
        if ratio >= self.least and (self.best is None or (ratio, other) > self.best):
            self.best, self.least = (ratio, other), ratio


class CloseTitles:
    """Gold keys by their bounds and lengths, with their characters as bags."""

    def __init__(self, targets: list[CloseTitle], cutoff: float):
        self.all, self.groups = targets, []
        for t in targets:
            t.least = max(t.least, cutoff)
        for low, high in zip((cutoff, *BOUNDS), (*BOUNDS, 2.0), strict=True):
            own = sorted((t for t in targets if low <= t.least < high or (low == cutoff and t.least < high)), key=lambda t: len(t.key)) if low < high else []
            if own:
                bags = np.stack([bag(t.key) for t in own])
                self.groups.append((low, own, [len(t.key) for t in own], bags, bags.sum(axis=1), np.array([t.least for t in own])))
                targets = [t for t in targets if t.least >= high]

    def meet(self, other: str) -> None:
        n, held = len(other), None
        for low, own, lengths, bags, sizes, least in self.groups:
            first = bisect_left(lengths, n * low / (2 - low) - 1)
            last = bisect_right(lengths, n * (2 - low) / low + 1)
            if first == last:
                continue
            held = bag(other) if held is None else held
            both = np.minimum(bags[first:last], held).sum(axis=1)
            for i in np.flatnonzero(2.0 * both / (sizes[first:last] + n) >= least[first:last]) + first:
                own[i].meet(other)
                least[i] = own[i].least


def bag(key: str) -> np.ndarray:
    """How many characters fall on each of 64 places: what two keys share is at least their longest common subsequence."""
    return np.bincount(np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64).astype(np.int32)


def resolve_close(gold: DataFrame, papers: DataFrame, aliases: dict[str, str] | None = None, anchors: DataFrame | None = None, cutoff: float = CLOSE) -> DataFrame:
    """resolve_titles, and for titles that it leaves open and that are no alias the closest title ("fuzzy")."""
    found = written(resolve_titles(gold, papers, aliases, anchors), "resolved")
    key = T.marked_up_title_key(F.col("title"))
    left = gold.select("title_id", key.alias("key")).join(found.where("paper_id IS NULL").select("title_id"), "title_id", "left_semi")
    if aliases:
        left = left.where(~F.col("key").isin(*aliases))
    close = close_titles(left, papers.select("paper_id", "pos", key.alias("key")), cutoff).select("title_id", F.col("paper_id").alias("close"))
    joined = found.join(close, "title_id", "left")
    return joined.select("title_id", F.coalesce("paper_id", "close").alias("paper_id"), F.when(F.col("close").isNotNull(), "fuzzy").otherwise(F.col("strategy")).alias("strategy"))
