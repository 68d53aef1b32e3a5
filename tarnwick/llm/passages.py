"""Passages that repeat across documents, by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, written
from .wordscan import Scanner, split_white

#: Words of a passage; of the grams whose least hash selects a position; of the suffix part that is compared first.
PASSAGE, GRAM, BLOCK = 50, 5, 15
#: Repeated suffix keys that one pass over the texts broadcasts at most (8 bytes each).
PASS_KEYS = 4_000_000
#: Passage windows for each shard of the comparison, about.
SHARD_WINDOWS = 1_000_000
#: A key in more places than this has its windows spread over the shards by their own hashes.
SPREAD = 10_000
#: Windows known to repeat that a task remembers, so as not to send them again.
REMEMBERED = 1_000_000
#: Suffix keys that a task holds before it passes them on.
HELD = 1_000_000

MULTIPLIER = 0xD1342543DE82EF95


def scanner() -> Scanner:
    """Words between ASCII white space, as they are."""
    return Scanner(split_white(), lower=False, seed=11)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, as far as there are n: windows double, then the binary parts join."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total, done = None, 0
    block, width = h, 1
    while True:
        if n & width:
            if total is None:
                total = block
            else:
                m = len(h) - done - width + 1
                total = total[:m] * np.uint64(pow(MULTIPLIER, width, 2**64)) + block[done : done + m]
            done += width
        if done == n:
            return mixed(total)
        block = block[:-width] * np.uint64(pow(MULTIPLIER, width, 2**64)) + block[width:]
        width *= 2


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """For each place the place of the least of the w values from there on, the leftmost of equal ones."""
    n = len(x) - w + 1
    value, place, width = x, np.arange(len(x)), 1
    while width * 2 <= w:
        right = value[width:] < value[:-width]
        value, place = np.where(right, value[width:], value[:-width]), np.where(right, place[width:], place[:-width])
        width *= 2
    rest = w - width
    right = value[rest : rest + n] < value[:n]
    return np.where(right, place[rest : rest + n], place[:n])


def selected(h: np.ndarray, starts: np.ndarray, passage: int, gram: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, minimiser, suffix key, text) of every window of ``passage`` words in texts laid end to end.

    A window's minimiser is the place of its least gram hash among those places where a suffix part of ``block``
    words still lies in the window. Equal windows have it at the same distance, with an equal key.
    """
    if len(h) < passage:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), empty
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(h) - passage + 1)
    inside = owner[place] == owner[passage - 1 :]
    minimiser = window_minima(window_hashes(h, gram), passage - block + 1)[: len(place)][inside]
    place = place[inside]
    return place, minimiser, window_hashes(h, block)[minimiser], owner[place]


def ids_of(rows: pa.RecordBatch) -> np.ndarray:
    return np.asarray(rows.column(0).fill_null(np.iinfo(np.int64).min), dtype=np.int64)


def key_counter(passage: int, gram: int, block: int):
    """The suffix keys of a partition, each with the least and greatest document that holds it and its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def out() -> pa.RecordBatch:
            k, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(k, kind="stable")
            k, low, high = k[order], low[order], high[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(k[first].view(np.int64)), pa.array(np.minimum.reduceat(low, first)), pa.array(np.maximum.reduceat(high, first)), pa.array(np.diff(np.append(first, len(k))))], names=["key", "low", "high", "n"])

        for rows, _, h, starts in scanner().scan(batches):
            _, minimiser, key, owner = selected(h, starts, passage, gram, block)
            if len(key):
                fresh = np.concatenate([[True], minimiser[1:] != minimiser[:-1]])
                doc = ids_of(rows)[owner[fresh]]
                held.append((key[fresh], doc, doc))
                size += len(doc)
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


#: A packed row holds windows that lie in runs: of each run its document, row, first place and number of windows.
#: Where it holds no hashes, its windows are known to repeat.
RUNS = "shard int, hashes binary, ids binary, rows binary, firsts binary, sizes binary"


def runs(place: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of consecutive places over which the other arrays are constant."""
    new = place[1:] != place[:-1] + 1
    for x in same:
        new |= x[1:] != x[:-1]
    start = np.flatnonzero(np.concatenate([[True], new]))
    return start, np.diff(np.append(start, len(place)))


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def locally(full: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows repeat in another document here, and which of these stand for all equal ones: one of the least and one of the greatest document."""
    order = np.lexsort((doc, full))
    f, d = full[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    size = np.diff(np.append(first, len(f)))
    several = d[first] < d[first + size - 1]
    known, stands = np.zeros(len(full), bool), np.zeros(len(full), bool)
    known[order] = np.repeat(several, size)
    stands[order[first[several]]] = True
    stands[order[(first + size - 1)[several]]] = True
    return known, stands


def window_sender(shared, shards: int, passage: int, gram: int, block: int):
    """Hashes of the windows whose suffix key repeats, packed in runs by the shard of the key.

    Equal windows of several documents of a task are known to repeat: two are sent for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, spread = shared.value
        certain = np.zeros(0, np.uint64)
        for rows, _, h, starts in scanner().scan(batches):
            keys = np.asarray(rows.column(2))
            place, minimiser, key, owner = selected(h, starts, passage, gram, block)
            found = np.flatnonzero(within(key, repeated))
            if not len(found):
                continue
            place, minimiser, key, owner = place[found], minimiser[found], key[found], owner[found]
            full = window_hashes(h, passage)[place]
            ids = ids_of(rows)
            old = within(full, certain)
            known, stands = locally(full, ids[owner])
            stands &= ~old
            where = (np.where(within(key, spread), full, key) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            packed = []
            for direct, mine in ((False, stands | ~(known | old)), (True, (known | old) & ~stands)):
                at = np.flatnonzero(mine)
                at = at[np.argsort(where[at], kind="stable")]
                if not len(at):
                    continue
                start, size = runs(place[at], minimiser[at], owner[at], where[at])
                own = owner[at[start]]
                first = (place[at[start]] - starts[own]).astype("<i4")
                cut = np.searchsorted(where[at], np.arange(shards + 1, dtype=np.uint64))
                cut_run = np.searchsorted(start, cut)
                for s in range(shards):
                    a, b, i, j = cut[s], cut[s + 1], cut_run[s], cut_run[s + 1]
                    if b > a:
                        packed.append((s, b"" if direct else full[at[a:b]].tobytes(), ids[own[i:j]].tobytes(), keys[own[i:j]].tobytes(), first[i:j].tobytes(), size[i:j].astype("<i4").tobytes()))
            if len(certain) < REMEMBERED:
                certain = np.union1d(certain, full[known])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in packed], pa.int32()), *(pa.array([r[k] for r in packed], pa.binary()) for k in range(1, 6))], names=["shard", "hashes", "ids", "rows", "firsts", "sizes"])

    return run


def compare_shard(part):
    """Sorts the windows of a shard, compares neighbours, and extends equal ones to stretches: (row, doc_id, first, end).

    A window repeats if windows equal to it stand in two documents.
    """
    columns = {c: [np.frombuffer(x, kind).astype(np.int64) for x in part[c]] for c, kind in (("ids", "<i8"), ("rows", "<i8"), ("firsts", "<i4"), ("sizes", "<i4"))}
    packed = [len(x) > 0 for x in part["hashes"]]
    spans = []
    for direct in (True, False):
        of_kind = [i for i, x in enumerate(packed) if x != direct]
        if not of_kind:
            continue
        ids, rows, firsts, sizes = (np.concatenate([columns[c][i] for i in of_kind]) for c in ("ids", "rows", "firsts", "sizes"))
        if direct:
            spans.append((rows, ids, firsts, firsts + sizes - 1))
            continue
        hashes = np.concatenate([np.frombuffer(part["hashes"].iloc[i], np.uint64) for i in of_kind])
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = firsts[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(hashes, kind="stable")
        ordered, doc = hashes[order], ids[of[order]]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        repeats = np.empty(len(hashes), bool)
        repeats[order] = np.repeat(several, np.diff(np.append(first, len(hashes))))
        at = np.flatnonzero(repeats)
        if len(at):
            start, size = runs(place[at], of[at])
            begin, run = place[at[start]], of[at[start]]
            spans.append((rows[run], ids[run], begin, begin + size - 1))
    merged = [np.concatenate(x) for x in zip(*spans, strict=True)] if spans else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("row", "doc_id", "first", "last"), merged, strict=True)))


def repeated_passages(docs: DataFrame, *, passage: int = PASSAGE, gram: int = GRAM, block: int = BLOCK, pass_keys: int = PASS_KEYS, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """Stretches of at least ``passage`` words of which every window of so many words stands in another document too.

    One row for each stretch, as long as it can be: row (of a document id and text), doc_id, first_word, n_words.
    Words are what stands between ASCII white space, compared as they are. Rows with the same doc_id are one
    document, so are all with a null one (given back as null), and rows repeated as they are come out once; null, empty and shorter texts have no passages; other
    columns are ignored; an empty table gives no rows.

    Suffixes are kept at the minimisers of all windows. A first scan finds which of their leading parts stand in two
    documents. A second takes the windows around those alone; they meet, sorted, in shards by their minimiser's key,
    where neighbours are compared and equal ones extended to the left and right. The keys are broadcast in
    blocks of at most ``pass_keys``, one scan for each. A key in very many places has its windows spread over the
    shards by their own hashes, and of windows that repeat within a task two are sent for all.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"))
    keys = source.mapInArrow(key_counter(passage, gram, block), "key long, low long, high long, n long").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    repeated = written(keys.where("low < high").select("key", "n"), "keys")
    count = repeated.count()
    passes = -(-count // pass_keys)
    spans = None
    for i in range(passes):
        mine = repeated if passes == 1 else repeated.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == i)
        rows = mine.toArrow()
        found, often = np.asarray(rows["key"]).view(np.uint64), np.asarray(rows["n"]) > SPREAD
        spread, found = np.sort(found[often]), np.sort(found)
        shards = max(32, -(-len(found) * 2 * (passage - block) // shard_windows))
        sent = source.mapInArrow(window_sender(spark.sparkContext.broadcast((found, spread)), shards, passage, gram, block), RUNS)
        part = sent.repartitionById(shards, "shard").groupBy("shard").applyInPandas(compare_shard, "row long, doc_id long, first long, last long")
        spans = part if spans is None else spans.unionByName(part)
    if spans is None:
        return spark.createDataFrame([], "row long, doc_id long, first_word long, n_words long")
    # windows of neighbouring minimisers follow each other; stretches of windows without a gap are one passage
    by = Window.partitionBy("row").orderBy("first")
    fresh = (F.col("first") > F.coalesce(F.lag("last").over(by), F.lit(-2)) + 1).cast("int")
    stretch = spans.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(by))
    doc = F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id"))
    merged = stretch.groupBy("row", "n").agg(F.first(doc).alias("doc_id"), F.min("first").alias("first_word"), F.max("last").alias("last"))
    return merged.select("row", "doc_id", "first_word", (F.col("last") - F.col("first_word") + passage).alias("n_words"))
