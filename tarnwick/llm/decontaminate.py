"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_blocks, columns_of, fresh, table
from .wordscan import Scanner, split_letters

#: Least similarity of a leak: matched words over alignment columns, words of the item left out counted as columns.
SIMILARITY = 0.8
#: Test items that one broadcast holds at most; more items take more passes.
ITEM_BLOCK = 5_000
#: Words of a seed; shorter for items of fewer than LONG words.
SEED_WORDS, LONG = 3, 10
MATCH, MISMATCH, GAP = 2, -1, -1

WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")


def scanner() -> Scanner:
    """Words as words_of has them."""
    return Scanner(split_letters(), lower=True, seed=4)


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits, underscores and non-ASCII characters, A-Z lower-cased; no ASCII punctuation."""
    return WORD.findall(text.lower())


def align(item: list[int], window: list[int]) -> tuple[int, int, int, int, float]:
    """Smith-Waterman: (score, first, end, matches, similarity) of the best local alignment of item in window.

    first and end bound the aligned words of the window. Ties go to the earlier end in the window.
    """
    m = len(item)
    # a cell: score, matches, columns, first word of the item, first word of the window
    above = [(0, 0, 0, 0, 0)] * (m + 1)
    best = (0, 0, 0, 0.0, 0)
    for j, w in enumerate(window):
        left = (0, 0, 0, 0, 0)
        diagonal = above[0]
        row = [left]
        for i, x in enumerate(item):
            up = above[i + 1]
            if x == w:
                d = (diagonal[0] + MATCH, diagonal[1] + 1, diagonal[2] + 1, diagonal[3], diagonal[4]) if diagonal[0] else (MATCH, 1, 1, i, j)
            elif diagonal[0] > -MISMATCH:
                d = (diagonal[0] + MISMATCH, diagonal[1], diagonal[2] + 1, diagonal[3], diagonal[4])
            else:
                d = (0, 0, 0, 0, 0)
            if up[0] + GAP > d[0]:
                d = (up[0] + GAP, up[1], up[2] + 1, up[3], up[4])
            if left[0] + GAP > d[0]:
                d = (left[0] + GAP, left[1], left[2] + 1, left[3], left[4])
            if d[0] > best[0]:
                best = (d[0], d[4], j + 1, d[1], d[1] / (d[2] + d[3] + m - 1 - i))
            row.append(d)
            diagonal, left = up, d
        above = row
    return best[0], best[1], best[2], best[3], best[4]


def seed_length(m: int) -> int:
    return min(m, SEED_WORDS if m >= LONG else 2 if m >= 4 else m)


def errors_allowed(m: int, similarity: float) -> int:
    """Columns of an alignment of the least similarity that are no match: at most this many."""
    return math.floor(m * (1 - similarity) / similarity + 1e-9)


class Items:
    """Test items as word numbers, with all their n-grams as candidates for seeds."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        self.similarity = similarity
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [r[0] for r in rows]
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(r[1].encode())] for r in rows]
        line = np.frombuffer(b" ".join(self.vocabulary), np.uint8)
        self.hashes, _ = scanner().words(line, np.array([0, len(line)]))
        self.numbers = np.argsort(self.hashes)
        self.hashes = self.hashes[self.numbers]
        self.maybe = np.zeros(65536, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.grams: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for i, words in enumerate(self.words):
            if n := seed_length(len(words)):
                for p in range(len(words) - n + 1):
                    self.grams.setdefault(n, {}).setdefault(tuple(words[p : p + n]), []).append((i, p))

    def code(self, gram: tuple) -> int:
        value = 0
        for w in gram:
            value = (value * (len(self.vocabulary) + 1) + w + 1) % 2**61
        return value

    def seeds(self, counts: dict[tuple[int, int], int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """n -> code -> places: of each item its rarest grams, so many that every leak holds one.

        An alignment with e errors leaves at least g - n * e of an item's g grams whole, so at least one of any
        g - max(1, g - n * e) + 1 grams is whole.
        """
        own: dict[int, list[tuple[int, int, int]]] = {}
        for n, grams in self.grams.items():
            for gram, places in grams.items():
                code = self.code(gram)
                for i, p in places:
                    own.setdefault(i, []).append((counts.get((n, code), 0), p, code))
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, grams in own.items():
            m = len(self.words[i])
            n, g = seed_length(m), len(grams)
            whole = max(1, g - n * errors_allowed(m, self.similarity))
            for _, p, code in sorted(grams)[: g - whole + 1]:
                found.setdefault(n, {}).setdefault(code, []).append((i, p))
        return found


def codes(ids: np.ndarray, n: int, size: int) -> np.ndarray:
    """Code of the n-gram at each position, -1 where a word is unknown."""
    if len(ids) < n:
        return np.full(len(ids), -1, np.int64)
    value, good = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        good &= part >= 0
        if (size + 1) ** n < 2**61:
            value = value * (size + 1) + part + 1
        else:
            value = np.array([(int(v) * (size + 1) + int(x) + 1) % 2**61 for v, x in zip(value, part, strict=True)], dtype=np.int64)
    out = np.full(len(ids), -1, np.int64)
    out[: len(value)] = np.where(good, value, -1)
    return out


def numbered(items: Items, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts laid end to end with a -1 after each (unknown words are -1 too), and their starts."""
    n = np.diff(starts)
    found = np.full(len(h), -1, np.int64)
    at = np.flatnonzero(items.maybe[(h >> np.uint64(48)).astype(np.int64)])
    if len(at):
        spot = np.minimum(np.searchsorted(items.hashes, h[at]), len(items.hashes) - 1)
        same = items.hashes[spot] == h[at]
        found[at[same]] = items.numbers[spot[same]]
    ids = np.full(len(h) + len(n), -1, np.int64)
    ids[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = found
    return ids, starts[:-1] + np.arange(len(n))


def gram_counter(shared):
    """How often each n-gram of the items stands in the rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        size = len(items.vocabulary)
        known = {n: np.array(sorted(items.code(g) for g in grams), dtype=np.int64) for n, grams in items.grams.items()}
        counts = {n: np.zeros(len(k), np.int64) for n, k in known.items()}
        for _, _, h, starts in scanner().scan(batches, 0):
            ids, _ = numbered(items, h, starts)
            for n, k in known.items():
                c = codes(ids, n, size)
                c = c[c >= 0]
                at = np.minimum(np.searchsorted(k, c), len(k) - 1)
                counts[n] += np.bincount(at[k[at] == c], minlength=len(k))
        for n, k in known.items():
            seen = counts[n] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(seen.sum(), n), pa.int32()), pa.array(k[seen]), pa.array(counts[n][seen])], names=["n", "code", "c"])

    return run


def windows(hits: list[tuple[int, int]], m: int, slack: int, end: int) -> list[tuple[int, int]]:
    """Stretches of the text that hold every alignment through a seed hit (text place, item place)."""
    found: list[list[int]] = []
    for at, p in sorted(hits, key=lambda h: h[0] - h[1]):
        a, b = max(0, at - p - slack), min(end, at - p + m + slack)
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def aligner(shared):
    """Leaks in the rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, least, counts = shared.value
        items = Items(rows, least)
        seeds = items.seeds(counts)
        size = len(items.vocabulary)
        known = {n: np.array(sorted(found), dtype=np.int64) for n, found in seeds.items()}
        grams = [{tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if (n := seed_length(len(w))) else set() for w in items.words]
        for rows, keys, h, starts in scanner().scan(batches):
            ids, begin = numbered(items, h, starts)
            ends = begin + np.diff(starts)
            hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for n, k in known.items():
                c = codes(ids, n, size)
                where = np.flatnonzero(c >= 0)
                at = np.minimum(np.searchsorted(k, c[where]), len(k) - 1)
                where = where[k[at] == c[where]]
                owner = np.searchsorted(begin, where, side="right") - 1
                for place, doc, code in zip(where.tolist(), owner.tolist(), c[where].tolist(), strict=True):
                    for item, p in seeds[n][code]:
                        hits.setdefault((doc, item), []).append((place - int(begin[doc]), p))
            out: list[tuple] = []
            for (doc, item), found in hits.items():
                words = items.words[item]
                m, n = len(words), seed_length(len(words))
                errors = errors_allowed(m, least)
                whole = max(1, m - n + 1 - n * errors)
                text = ids[begin[doc] : ends[doc]]
                best = None
                for a, b in windows(found, m, errors, len(text)):
                    part = text[a:b].tolist()
                    if len({tuple(part[i : i + n]) for i in range(len(part) - n + 1)} & grams[item]) < max(1, whole - (m - n + 1 - len(grams[item]))):
                        continue
                    got = align(words, part)
                    if got[4] >= least - 1e-12 and (best is None or got[0] > best[0]):
                        best = (got[0], a + got[1], a + got[2], got[3], got[4])
                if best:
                    out.append((doc, item, *best))
            docs = rows.column(0).to_pylist()
            out.sort()
            columns = [list(x) for x in zip(*out, strict=True)] if out else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[np.array(columns[0], dtype=np.int64)]), pa.array([docs[i] for i in columns[0]], pa.int64()), pa.array([items.ids[i] for i in columns[1]], pa.int64()), pa.array(columns[6], pa.float64()),
                pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array([e - s for s, e in zip(columns[3], columns[4], strict=True)], pa.int64()), pa.array(columns[5], pa.int64()),
            ], names=["row", "doc_id", "item_id", "similarity", "score", "first_word", "n_words", "n_matched"])

    return run


def folded(text: Column) -> Column:
    """The text with the case of all letters folded; sharp s and final sigma, which have no upper case of their own, too."""
    lower = F.lower(text.cast("string"))
    return F.replace(F.replace(lower, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


LEAKS = "row long, doc_id long, item_id long, similarity double, score long, first_word long, n_words long, n_matched long"


def leaks(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, item_block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each text and test item that it holds a copy of, edited copies included.

    An item is leaked if its best local alignment has a similarity of at least ``similarity``: matched words over
    the columns of the alignment and the item's words outside it. The case of letters and ASCII punctuation do not count. Items without
    words match nothing; null texts hold nothing; repeated rows (told apart by ``row``) and repeated items each give
    their own rows; null ids stay null; other columns are ignored; empty tables give no rows.

    The items travel to the texts in blocks of at most ``item_block``. One scan counts their n-grams over all texts;
    each item's rarest n-grams, so many that no leak can miss all, are the seeds that join texts to items in a
    second scan; around them, stretches with too few of the item's n-grams are passed over and the others aligned.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(F.col("text")).alias("text"))
    tests = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), folded(F.col("text")).alias("text"))
    found = None
    for block in by_blocks(tests.toLocalIterator(), item_block):
        items = [tuple(r) for r in block]
        counter = gram_counter(spark.sparkContext.broadcast((items, similarity)))
        counts = {(r[0], r[1]): r[2] for r in source.select("text").mapInArrow(counter, "n int, code long, c long").groupBy("n", "code").agg(F.sum("c")).collect()}
        part = source.mapInArrow(aligner(spark.sparkContext.broadcast((items, similarity, counts))), LEAKS)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], LEAKS) if found is None else found


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no test item, with the columns they came with.

    Documents are told apart by id and text; a document with a null id goes if its text holds a leak.
    """
    key = fresh(docs, "key")
    tagged = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    bad = leaks(tagged, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(bad, key, "left_anti").select(*columns_of(docs))
