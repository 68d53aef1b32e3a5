"""SimHash fingerprints and near-duplicate groups by sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, columns_of, fresh, written
from .components import connected_components

WORDS, RADIUS, SEED = 3, 3, 42
#: A shard with more fingerprints than this is divided by further bits.
SHARD = 1_000
#: Bit ranges at each level: a pair within the radius agrees on one of RADIUS + 1 ranges of the bits left.
LEVELS = 3


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half the hashes of the text's shingles of words (A-Z lower-cased; ASCII white space)."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(gaps) + 1 - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], seed) for i, j in zip(starts, ends, strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):  # so many that a byte can count them
        part = np.unpackbits(hashes[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(part, axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprinter(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            found = np.array([fingerprint(x, words, seed) for x in as_bytes(data.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([data.column(0), data.column(2), pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])

    return run


class BKTree:
    """Fingerprints in a tree; a child hangs at the Hamming distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within the radius; the value is then inserted. Only edges within the radius are followed."""
        found: list[int] = []
        if self.values:
            stack = [0]
            values, children = self.values, self.children
            while stack:
                node = stack.pop()
                d = (values[node] ^ value).bit_count()
                if d <= radius:
                    found.append(node)
                below = children[node]
                if below:
                    if len(below) <= 2 * radius:
                        stack += [c for e, c in below.items() if -radius <= e - d <= radius]
                    else:
                        stack += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
            node = 0
            while True:
                d = (values[node] ^ value).bit_count()
                after = children[node].setdefault(d, len(values))
                if after == len(values):
                    break
                node = after
        self.values.append(value)
        self.children.append({})
        return found


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links within the radius that join each group of the shard: a spanning forest, to each group's smallest value."""
    if len(values) == 2:
        if (values[0] ^ values[1]).bit_count() <= radius:
            yield values[0], values[1]
        return
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.add_and_find(value, radius):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    for i, value in enumerate(values):
        if (r := root(i)) != i:
            yield values[r], value


def linker(radius: int):
    """Builds the BK-tree of each shard of a partition (rows sorted by shard) and emits its links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for data in batches:
            yield from zip(*(data.column(i).to_pylist() for i in range(3)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, shard in groupby(rows(batches), key=itemgetter(0, 1)):
            values = sorted({x[2] & (2**64 - 1) for x in shard})
            if len(values) > 1:
                for x, y in shard_links(values, radius):
                    a.append(x)
                    b.append(y)
            if len(a) >= 50_000:
                yield _links(a, b)
                a, b = [], []
        yield _links(a, b)

    return run


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], names=["fa", "fb"])


def ranges(bits: list[int], parts: int) -> list[list[int]]:
    """The bits in contiguous parts of nearly equal size."""
    return [list(x) for x in np.array_split(bits, parts)]


def _masked(bits: list[int]):
    mask = sum(1 << int(i) for i in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask))


def sharded(fingerprints: DataFrame, radius: int, limit: int, levels: int) -> DataFrame:
    """(combo, key, fp): shards such that any two fingerprints within the radius meet in one.

    Of radius + 1 ranges of bits, two such fingerprints agree on one. Shards with over ``limit`` fingerprints are
    divided again by ranges of the bits left, where the same holds.
    """
    def keyed(df: DataFrame, combos: list[tuple[int, list[int]]]) -> DataFrame:
        return df.select("fp", F.explode(F.array(*[F.struct(F.lit(c).alias("combo"), _masked(bits).alias("key")) for c, bits in combos])).alias("s")).select("s.combo", "s.key", "fp")

    every = list(range(64))
    level = [(i, part) for i, part in enumerate(ranges(every, radius + 1))]
    rows, done, code = keyed(fingerprints, level), None, len(level)
    for depth in range(levels):
        if depth == levels - 1:
            return rows if done is None else done.unionByName(rows)
        sizes = written(rows.groupBy("combo", "key").count().where(F.col("count") > limit).select("combo", "key"), "shards")
        if sizes.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(sizes, ["combo", "key"], "left_anti")
        done = small if done is None else done.unionByName(small)
        large = written(rows.join(sizes, ["combo", "key"], "left_semi"), "large")
        nexts, finer = [], []
        for combo, bits in level:
            parts = [(code + i, bits + part) for i, part in enumerate(ranges([x for x in every if x not in set(bits)], radius + 1))]
            code += len(parts)
            finer += parts
            nexts.append(keyed(large.where(F.col("combo") == combo).select("fp"), parts))
        rows = nexts[0]
        for other in nexts[1:]:
            rows = rows.unionByName(other)
        level = finer


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = RADIUS, seed: int = SEED, shard: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """doc_id, fp (a long), component_id (the smallest doc_id reachable over links of at most ``radius`` bits), key.

    A null or empty text has fingerprint zero, linked like any other; with fewer words than a shingle has, the whole
    sequence is the shingle. Rows with a null doc_id keep their fingerprint, and get the component of their
    fingerprint if a document with an id has it, else null. Repeated rows come out as often as they come; other
    columns are ignored; an empty table gives no rows. key is document_key's.

    Equal fingerprints are one vertex, so copies never make pairs. Shards of distinct fingerprints each build a
    BK-tree and emit a spanning forest of their links, fewer links than members.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), document_key().alias("key"))
    prints = written(source.mapInArrow(fingerprinter(words, seed), "doc_id long, key long, fp long"), "fingerprints")
    vertices = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "vertices")
    shards = sharded(vertices.select("fp"), radius, shard, levels)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    links = shards.repartition(parts, "combo", "key").sortWithinPartitions("combo", "key").mapInArrow(linker(radius), "fa long, fb long").distinct()
    links = written(links, "links")
    components = connected_components(links.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    named = vertices.join(components, vertices["fp"] == components["v"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    members = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id", "key")


def document_key():
    """Tells documents apart, those without an id included; rows repeated as they are share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group the document with the smallest id, with the columns it came with.

    Of documents with one id, the one whose key is smallest stays; a group whose ids are all null keeps one too. A
    group without any id is known by its fingerprint.
    """
    key = fresh(docs, "key")
    found = near_duplicates(docs).withColumn("group", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = found.groupBy("group").agg(first.alias("first")).select(F.col("first.key").alias(key))
    own = docs.withColumn(key, document_key()).join(kept.distinct(), key, "left_semi")
    # rows repeated as they are: one stays
    repeated = found.groupBy("key").count().where("count > 1").select(F.col("key").alias(key))
    once = own.join(repeated, key, "left_anti")
    again = own.join(repeated, key, "left_semi").dropDuplicates([key])
    return once.unionByName(again).select(*columns_of(docs))
