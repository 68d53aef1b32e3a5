"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash fingerprints in BK-trees find the closest ones, prefix filtering those that differ in more bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, discard, fresh, mixed, release, written
from .components import connected_components
from .simhash import document_key, near_duplicates
from .wordscan import Scanner, split_white

WORDS, SIMILARITY = 5, 0.8
#: Shingles of their prefixes that a pair must share to be checked, or as many as it has.
SHARED = 4
#: Bits of a shingle that choose the counter which tells about how frequent it is; 4 bytes a counter are broadcast.
COUNTER_BITS = 20
#: Texts whose shingles a task remembers to have sent already.
HELD = 1_000_000
#: A counter is hot with so many shingles more than four times the mean: its shingles may be too many for one task.
HOT = 100_000
#: Keys (8 bytes each) that are broadcast at most to pick texts; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Bits of a sketch for each shingle at least, and the least and most bits of one; all are powers of two.
SKETCH_DENSITY, SKETCH_LEAST, SKETCH_MOST = 2, 128, 1 << 14
#: Members of a cluster that meet in one block by their sketches, or by their sets; larger clusters are divided.
SKETCH_BLOCK, SET_BLOCK = 4096, 256
#: Columns of the matrix that counts what the sets of a block share.
COLUMNS = 4096


def shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows, number, sorted distinct shingle hashes) for each text; the whole text is the shingle of one with fewer words."""
    odd = [pow(0x9FB21C651E98DF25, k + 1, 2**64) for k in range(words)]
    for rows, _, h, starts in Scanner(split_white(), lower=True, seed=11).scan(batches):
        value = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            value += h[k : k + len(value)] * np.uint64(odd[k])
        value = mixed(value)
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            if b - a >= words:
                yield rows, i, np.unique(value[a : b - words + 1])
            elif b > a:
                yield rows, i, np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), b - a)], np.uint64)
            else:
                yield rows, i, np.zeros(0, np.uint64)


def vertex_of(own: np.ndarray) -> int:
    """Equal sets of shingles are one vertex."""
    return xxhash.xxh64_intdigest(own.tobytes()) - 2**63


def sketch(own: np.ndarray) -> bytes:
    """For each value of some bits of a shingle whether an odd number of shingles has it: two sets differ in at least as many shingles as their sketches in bits."""
    bits = min(max(SKETCH_LEAST, 1 << (SKETCH_DENSITY * len(own) - 1).bit_length()), SKETCH_MOST) if len(own) else SKETCH_LEAST
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def counter(words: int):
    """How many shingles fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for _, _, own in shingles(batches, words):
            counts[(own >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "c"])

    return run


def printer(words: int):
    """The vertex of each text and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in groupby(((r, vertex_of(own), sketch(own)) for r, _, own in shingles(batches, words)), key=itemgetter(0)):
            _, v, sketches = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(v, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "key", "v", "sketch"])

    return run


def prefixer(shared, words: int, similarity: float, hottest: int, hot: bool):
    """The least frequent shingles of each text, so many that two texts of the similarity share SHARED of them (or all): those of hot counters, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        parts: list = []
        seen: set[int] = set()
        size = 0

        def out() -> pa.RecordBatch:
            lengths = [len(p[0]) for p in parts]
            columns = [np.concatenate([p[0] for p in parts]).view(np.int64), np.repeat(np.array([p[1] for p in parts], np.int64), lengths), np.repeat(np.array([p[2] for p in parts], np.int32), lengths)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "v", "n"])

        for _, _, own in shingles(batches, words):
            n, v = len(own), vertex_of(own)
            if not n or v in seen:
                continue
            if len(seen) < HELD:
                seen.add(v)
            frequency = counts[(own >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
            first = np.lexsort((own, frequency))[: n - (least := math.ceil(similarity * n - 1e-9)) + min(SHARED, least)]
            first = first[(frequency[first] > hottest) == hot]
            if not len(first):
                continue
            parts.append((own[first], v, n))
            size += len(first)
            if size >= 100_000:
                yield out()
                parts, size = [], 0
        if parts:
            yield out()

    return run


def sharer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and vertex those whose shingle has several vertices, each once, with the first of these and its size."""
    last = None  # shingle, its first vertex and size, the vertex before, whether the first went out
    for data in batches:
        s, v, n = (np.asarray(data.column(i)) for i in range(3))
        if not len(s):
            continue
        begins = np.concatenate([[last is None or s[0] != last[0]], s[1:] != s[:-1]])
        again = np.concatenate([[last is not None and not begins[0] and v[0] == last[3]], (s[1:] == s[:-1]) & (v[1:] == v[:-1])])
        start = np.flatnonzero(begins)
        lead, size, gone = v.copy(), n.copy(), np.zeros(len(s), bool)
        at = np.cumsum(begins) - 1
        known = at >= 0
        lead[known], size[known] = v[start[at[known]]], n[start[at[known]]]
        if not known.all():
            lead[~known], size[~known], gone[~known] = last[1], last[2], last[4]
        others = np.flatnonzero((v != lead) & ~again)
        first = others[np.concatenate([[True], s[others[1:]] != s[others[:-1]]])] if len(others) else others
        first = first[~gone[first]]  # of each shingle the row that tells that its first vertex is not alone
        out = [np.concatenate([s[others], s[first]]), np.concatenate([n[others], size[first]]), np.concatenate([v[others], lead[first]]), np.concatenate([lead[others], lead[first]]), np.concatenate([size[others], size[first]])]
        if len(others):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["s", "n", "v", "lead", "lead_n"])
        went = bool(gone[-1] or (len(others) and s[others[-1]] == s[-1]))
        last = (s[-1], lead[-1], size[-1], v[-1], went)


def set_of(words: int):
    """The shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groupby(((r, own) for r, _, own in shingles(batches, words)), key=itemgetter(0)):
            sets = [own for _, own in found]
            yield pa.RecordBatch.from_arrays([pa.array([vertex_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["v", "own"])

    return run


def suspects(part: np.ndarray, n: np.ndarray, component: np.ndarray, sketches: list[bytes], similarity: float) -> np.ndarray:
    """Whether each member has, by sizes and sketches, another of the similarity in another component (and part, if there are two)."""
    found, two = np.zeros(len(n), bool), part.min() < part.max()
    by_size, widths = np.argsort(n, kind="stable"), np.array([len(x) for x in sketches])
    tables = {}
    for width in np.unique(widths).tolist():
        at = by_size[widths[by_size] == width]
        tables[width] = at, n[at], np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1)
    for width, (at, _, table) in tables.items():
        for r, i in enumerate(at.tolist()):
            for narrow, (others, sizes, rows) in tables.items():
                low, high = int(np.searchsorted(sizes, similarity * n[i] - 1e-9)), r if narrow == width else len(others)
                if narrow > width or low >= high:
                    continue
                to = others[low:high]
                maybe = component[to] != component[i]
                if two:
                    maybe &= part[to] != part[i]
                if not maybe.any():
                    continue
                folded = np.bitwise_xor.reduce(table[r].reshape(-1, rows.shape[1]), axis=0)
                apart = np.bitwise_count(rows[low:high] ^ folded).sum(axis=1, dtype=np.int64)
                maybe &= apart <= (1 - similarity) / (1 + similarity) * (n[i] + sizes[low:high]) + 1e-6
                if maybe.any():
                    found[i] = True
                    found[to[maybe]] = True
    return found


def forest(part: np.ndarray, v: np.ndarray, component: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Of the pairs of the similarity in two components (and parts, if there are two) so many that they join all that these join, fewer than members."""
    n = np.array([len(x) for x in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    held, at = (times > 1)[number], column[number]
    row, at = np.repeat(np.arange(len(sets)), n)[held], at[held]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(sets), len(sets)))
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, (first, first + COLUMNS))
        has = np.zeros((len(sets), int(at[b - 1]) + 1 - first), np.float32)
        has[row[a:b], at[a:b] - first] = 1
        both += has @ has.T
    good = (both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9) & (component[:, None] != component[None, :])
    if part.min() < part.max():
        good &= part[:, None] != part[None, :]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    found = []
    for i, j in np.argwhere(np.triu(good)).tolist():
        x, y = top(int(component[i])), top(int(component[j]))
        if x != y:
            root[x] = y
            found.append((min(int(v[i]), int(v[j])), max(int(v[i]), int(v[j]))))
    return found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """(lead, columns part, v, n, component, value) of each block with several components; rows are sorted by lead, i and j."""
    rows = (row for data in batches for row in zip(*(data.column(k).to_pylist() for k in range(8)), strict=True))
    for (lead, i, j), block in groupby(rows, key=itemgetter(0, 1, 2)):
        _, _, _, part, v, n, component, value = zip(*block, strict=True)
        part, component = np.array(part), np.array(component)
        if component.min() < component.max() and (i == j or part.min() < part.max()):
            yield lead, (part, np.array(v), np.array(n), component, value)
    release()


def suspecter(similarity: float):
    """The members of blocks that may have a near copy in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lead, (part, v, n, component, sketches) in blocks(batches):
            found = suspects(part, n, component, sketches, similarity)
            if found.any():
                columns = [np.full(found.sum(), lead), v[found], n[found], component[found]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["lead", "v", "n", "component"])

    return run


def joiner(similarity: float):
    """Links that join the members of blocks as all their pairs of the similarity do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (part, v, _, component, sets) in blocks(batches):
            found = forest(part, v, component, [np.frombuffer(x, np.uint64) for x in sets], similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def meeting(members: DataFrame, values: DataFrame, block: int, parts: int) -> DataFrame:
    """The members (lead, v, n, component) with their values (v, value), so dealt out that any two of a lead meet in a block (lead, i, j).

    A lead with more members than ``block`` has them in several parts, and a block for any one or two of them.
    """
    large = members.groupBy("lead").agg(F.ceil(F.count("*") / block).cast("int").alias("of")).where("of > 1")
    rows = members.join(large, "lead", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("v"), "of").cast("int"))
    rows = rows.join(values, "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    rows = rows.select("lead", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "v", "n", "component", "value")
    return rows.repartition(parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j")


def checker(similarity: float):
    """The pairs whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            good = []
            for x, y in zip(data.column(2).to_pylist(), data.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield data.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def near_copies(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key and ``group`` of each row of docs: the near copies that it reaches over links of at least the similarity.

    Texts are sets of shingles of words (A-Z lower-cased; ASCII white space); a link is an exact Jaccard similarity, and
    no link is missed: with shingles in one order, two such sets share k of their first n - ceil(similarity * n) + k.
    The order is by counters, rare shingles first. Texts without words are one group. key is document_key's.

    Equal sets are one vertex. Each vertex is first checked against one vertex of its SimHash group (fingerprints of
    the same shingles, 3 bits), and against one of each shingle that it shares. What shares a shingle and is still in
    several components meets in the cluster of the shingle's lead: first as sketches, which bound the similarity from
    above, then, where these leave a partner, as sets. A member is a row of its cluster and never a row for each partner;
    of the links found a forest comes out.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), document_key().alias("key"))
    counts = np.zeros(1 << COUNTER_BITS, np.uint32)
    found = source.mapInArrow(counter(words), "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    counts[np.asarray(found["at"])] = np.minimum(np.asarray(found["c"]), 2**32 - 1)
    prints = written(source.mapInArrow(printer(words), "doc_id long, key long, v long, sketch binary"), "prints")
    broadcast, hottest = spark.sparkContext.broadcast(counts), int(4 * counts.mean()) + HOT
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    few, rows = (source.mapInArrow(prefixer(broadcast, words, similarity, hottest, hot), "s long, v long, n int") for hot in (False, True))
    shared = few.repartition(parts, "s").sortWithinPartitions("s", "v").mapInArrow(sharer, "s long, n int, v long, lead long, lead_n int")
    if int(counts.max()) > hottest:  # the first vertex of each is found before the shuffle, and large groups stay divided
        rows = written(rows, "hot-shingles")
        leads = rows.groupBy("s").agg(F.min(F.struct("v", "n")).alias("lead"), F.max("v").alias("last")).where("lead.v < last").select("s", F.col("lead.v").alias("lead"), F.col("lead.n").alias("lead_n"))
        shared = shared.unionByName(rows.join(leads, "s").select("s", "n", "v", "lead", "lead_n").distinct())
    shared = written(shared, "shared-shingles")
    repeated = prints.groupBy("key").count().where("count > 1").select("key")

    def sets_of(vertices: DataFrame, name: str) -> DataFrame:
        wanted = written(prints.join(vertices, "v", "left_semi").groupBy("v").agg(F.min("key").alias("key")).select("key").distinct(), name + "-keys")
        kept = wanted
        if wanted.count() <= BROADCAST_KEYS:
            wanted = F.broadcast(wanted)
        texts = source.join(wanted, "key", "left_semi")
        once, again = texts.join(repeated, "key", "left_anti"), texts.join(repeated, "key", "left_semi").dropDuplicates(["key"])
        sets = written(once.unionByName(again).select("doc_id", "text").mapInArrow(set_of(words), "v long, own binary"), name + "-sets")
        discard(kept)
        return sets

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs, name)
        sets = sets_of(pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct(), name)
        x, y = (sets.select(F.col("v").alias(end), F.col("own").alias("own_" + end)) for end in "ab")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "own_a", "own_b")
        found = written(both.mapInArrow(checker(similarity), "a long, b long"), name + "-links")
        discard(pairs, sets)
        return found

    def enough(shares: DataFrame) -> DataFrame:
        """The pairs (a, b) that stand in enough rows (a, b, n), one for each shingle that they share; n is the lesser size."""
        return shares.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("n").alias("n")).where(F.col("c") >= F.least(F.lit(SHARED), F.ceil(F.lit(similarity) * F.col("n") - 1e-9))).select("a", "b")

    close = near_duplicates(docs, words=words).select("key", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).alias("group"))
    members = prints.select("key", "v").join(close, "key").select("v", "group").distinct()
    stars = members.join(members.groupBy("group").agg(F.min("v").alias("lead")), "group").where("v <> lead")
    leading = shared.where((F.col("v") > F.col("lead")) & (F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n") - 1e-9))
    leading = enough(leading.select(F.col("lead").alias("a"), F.col("v").alias("b"), F.least("n", "lead_n").alias("n")))
    links = checked(leading.unionByName(stars.select(F.col("lead").alias("a"), F.col("v").alias("b"))).distinct(), "leads")
    # then one of each shingle that shares most: of edited copies of a text the text itself, or the least edited
    central = shared.join(shared.groupBy("v").agg(F.count("*").alias("degree")), "v")
    before = written(central.join(connected_components(links), "v", "left").select("s", "n", "v", "degree", F.coalesce("component", "v").alias("component")), "shared-again")
    discard(shared)
    leads = before.groupBy("s").agg(F.max(F.struct("degree", "v", "n", "component")).alias("m")).select("s", "m.*").toDF("s", "lead_degree", "lead", "lead_n", "lead_component")
    leading = before.join(leads, "s").where((F.col("component") != F.col("lead_component")) & (F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n") - 1e-9))
    leading = leading.select(F.least("lead", "v").alias("a"), F.greatest("lead", "v").alias("b"), F.least("n", "lead_n").alias("n"))
    links = links.unionByName(checked(enough(leading), "central"))
    rest = before.drop("component").join(connected_components(links), "v", "left").withColumn("component", F.coalesce("component", "v"))
    several = rest.groupBy("s").agg(F.max(F.struct("degree", "v")).alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    held = rest.join(several.where("low < high").select("s", F.col("m.v").alias("lead")), "s").groupBy("lead", "v", "n", "component").agg(F.count("*").alias("c"))
    held = written(held, "held")
    # a pair shares SHARED shingles, or as many as the lesser set must: a vertex with fewer of all leads has no partner
    least = F.least(F.lit(SHARED), F.ceil(F.lit(similarity) * F.ceil(F.lit(similarity) * F.col("n") - 1e-9) - 1e-9))
    enough_held = held.groupBy("v", "n").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("v")
    members = written(held.join(enough_held, "v", "left_semi").select("lead", "v", "n", "component"), "members")
    discard(before, held)
    sketches = prints.join(members.select("v"), "v", "left_semi").groupBy("v").agg(F.max("sketch").alias("value"))
    near = meeting(members, sketches, SKETCH_BLOCK, parts).mapInArrow(suspecter(similarity), "lead long, v long, n long, component long")
    near = written(near.distinct(), "suspects")
    sets = sets_of(near.select("v").distinct(), "suspects")
    last = written(meeting(near, sets.withColumnRenamed("own", "value"), SET_BLOCK, parts).mapInArrow(joiner(similarity), "a long, b long"), "suspects-links")
    discard(members, near, sets)
    groups = connected_components(links.unionByName(last))
    return prints.join(groups, "v", "left").select("doc_id", "key", F.coalesce("component", "v").alias("group"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest id, with the columns it came with.

    Of documents with one id, the one whose key is smallest stays; a group whose ids are all null keeps one too. Of
    rows repeated as they are one stays.
    """
    key = fresh(docs, "key")
    found = written(near_copies(docs), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = found.groupBy("group").agg(first.alias("first")).select(F.col("first.key").alias(key))
    own = docs.withColumn(key, document_key()).join(kept.distinct(), key, "left_semi")
    repeated = found.groupBy("key").count().where("count > 1").select(F.col("key").alias(key))
    once = own.join(repeated, key, "left_anti")
    again = own.join(repeated, key, "left_semi").dropDuplicates([key])
    return once.unionByName(again).select(*columns_of(docs))
