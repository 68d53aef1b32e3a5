"""Language-model scores from a log-frequency Bloom filter over n-gram counts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, written
from .wordscan import Scanner, split_white

#: Distinct tokens whose exact counts travel to all workers (16 bytes each); the counts of the others are joined.
FREQUENT = 1_000_000
#: Bits for each stored entry and probes for each membership test.
BITS, PROBES = 8, 4
#: Counts are kept as 1 + floor(STEPS * log2(count)).
STEPS = 2
#: n-grams for each shard of the filter (at most, on average), and bytes of it that one pass broadcasts.
SHARD_GRAMS, PASS_BYTES = 4_000_000, 256_000_000
#: A context with at least this share of all tokens has its bigrams spread over all shards.
HOT_SHARE = 1 / 20_000
#: Weight of the bigram estimate against the smoothed unigram.
BIGRAM_WEIGHT = 0.2
#: Distinct tokens or bigrams that a task holds before it passes them on.
HELD = 1_000_000

#: The hash of the token after each text, and the context of a text's first token.
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)


def scanner() -> Scanner:
    """Words between ASCII white space, A-Z lower-cased."""
    return Scanner(split_white(), lower=True, seed=7)


def is_held_out(doc) -> bool:
    """crc32 of the id as text leaves 2 when divided by 7; a null id does not."""
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def with_ends(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with the end after each text, and where each text starts among them."""
    n = np.diff(starts)
    out = np.full(len(h) + len(n), END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, starts[:-1] + np.arange(len(n))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their total counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def training_rows(rows: pa.RecordBatch) -> np.ndarray:
    return np.array([not is_held_out(d) for d in rows.column(0).to_pylist()], dtype=bool)


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the tokens of the training rows."""
    keys: list = []
    counts: list = []

    def out() -> pa.RecordBatch:
        k, c = summed(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["token", "c"])

    size = 0
    for rows, _, h, starts in scanner().scan(batches):
        h, begin = with_ends(h, starts)
        mine = np.repeat(training_rows(rows), np.diff(np.append(begin, len(h))))
        k, c = np.unique(h[mine], return_counts=True)
        keys.append(k)
        counts.append(c)
        size += len(k)
        if size >= HELD:
            k, c = summed(keys, counts)
            keys, counts, size = [k], [c], len(k)
            if size >= HELD // 2:
                yield out()
                keys, counts, size = [], [], 0
    if size:
        yield out()


def contexts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of the token before each token; START before the first of a text."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = START
    return before


class Hot:
    """Tokens that are at least a HOT_SHARE of all, so at most 1 / HOT_SHARE of them, with their exact counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.maybe = np.zeros(65536, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each token among the hot ones, or -1."""
        found = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[spot] == h[at]
        found[at[same]] = spot[same]
        return found


def grams(h: np.ndarray, before: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A hash for each bigram. Its high bits are its context's, so that they share a shard, but after hot contexts."""
    own = mixed(before * np.uint64(0x9FB21C651E98DF25) + h)
    return np.where(hot, own, (mixed(before) & np.uint64(0xFFFFFF0000000000)) | (own >> np.uint64(24)))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a context or bigram, by the high bits of its hash."""
    return ((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)


def count_grams(shared, shards: int):
    """Partial counts of bigrams and contexts, as one packed row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Hot(*shared.value)
        keys: list = []
        counts: list = []

        def out() -> pa.RecordBatch:
            k, c = summed(keys, counts)
            cuts = np.searchsorted(shard_of(k, shards), np.arange(shards + 1, dtype=np.uint64))
            rows = [(s, k[a:b].tobytes(), c[a:b].astype("<u4").tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])

        size = 0
        for rows, _, h, starts in scanner().scan(batches):
            h, begin = with_ends(h, starts)
            before = contexts(h, begin)
            mine = np.repeat(training_rows(rows), np.diff(np.append(begin, len(h))))
            after_hot = hot.find(before) >= 0
            for values in (grams(h, before, after_hot)[mine], mixed(before[mine & ~after_hot])):
                k, c = np.unique(values, return_counts=True)
                keys.append(k)
                counts.append(c)
                size += len(k)
            if size >= HELD:
                yield out()
                keys, counts, size = [], [], 0
        if size:
            yield out()

    return run


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts; exact for powers of two."""
    return 1 + np.floor(STEPS * np.log2(counts.astype(np.float64)) + 1e-9).astype(np.int64)


def probes(keys: np.ndarray, level: int, size: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """Where the probes for (key, level) fall among ``size`` bits: double hashing."""
    a = mixed(keys + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
    b = mixed(a) | np.uint64(1)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % size


def filled(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(bits, filter): each key is stored at every level up to that of its count."""
    top = levels_of(counts)
    size = max(64, -(-int(top.sum()) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    level = 1
    while len(keys):
        for at in probes(keys, level, np.uint64(size)):
            bits[at.astype(np.int64)] = True
        level += 1
        more = top >= level
        keys, top = keys[more], top[more]
    return size, np.packbits(bits, bitorder="little").tobytes()


def build_shard(key, part):
    """The filter of one shard from its partial counts."""
    keys, counts = summed([np.frombuffer(k, np.uint64) for k in part["keys"]], [np.frombuffer(c, "<u4").astype(np.int64) for c in part["counts"]])
    size, bits = filled(keys, counts)
    return pd.DataFrame({"shard": [key[0]], "bits": [size], "filter": [bits]})


class Filter:
    """Some shards of the Bloom filter in one array."""

    def __init__(self, mine: np.ndarray, size: np.ndarray, base: np.ndarray, raw: bytes):
        self.mine, self.size, self.base, self.bits = mine, size, base, np.frombuffer(raw or b"\0", np.uint8)

    def has(self, shard: np.ndarray) -> np.ndarray:
        return self.mine[shard.astype(np.int64)]

    def level(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The highest level up to which every probe is set, found by probing level after level; 0 if none."""
        found = np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        shard = shard.astype(np.int64)
        size, base = np.maximum(self.size[shard], np.uint64(1)), self.base[shard]
        alive = self.size[shard] > 0
        level = 1
        while True:
            at, keys, size, base = at[alive], keys[alive], size[alive], base[alive]
            if not len(at):
                return found
            alive = np.ones(len(at), bool)
            for spot in probes(keys, level, size):
                byte = self.bits[base + (spot >> np.uint64(3)).astype(np.int64)]
                alive &= (byte >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            found[at[alive]] = level
            level += 1


def scorer(shared, first_pass: bool, bigram_weight: float):
    """Sums for each row: what is known here of both scores. Each token outside the table is sent out by the pass that has its bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_hash, known_count, hot_hash, hot_count, total, distinct, mine, size, base, raw = shared.value
        hot = Hot(hot_hash, hot_count)
        model, shards = Filter(mine, size, base, raw), len(size)
        scale = math.log10(total + distinct + 1)
        for part, _, h, starts in scanner().scan(batches):
            keys = np.asarray(part.column(2))
            h, begin = with_ends(h, starts)
            lengths = np.diff(np.append(begin, len(h)))
            unique, back = np.unique(h, return_inverse=True)
            spot = np.minimum(np.searchsorted(known_hash, unique), max(0, len(known_hash) - 1))
            is_known = known_hash[spot] == unique if len(known_hash) else np.zeros(len(unique), bool)
            log_count = np.log10(np.where(is_known, known_count[spot] if len(known_hash) else 0, 0) + 1.0)
            uni = log_count - scale
            p_uni = (10.0**uni)[back]
            context = np.append(unique, START)
            context_at = np.full(len(h), len(unique))
            context_at[1:] = back[:-1]
            context_at[begin] = len(unique)
            is_hot = hot.find(context)
            key = mixed(context)
            high = model.level(key, shard_of(key, shards))
            most = np.where(is_hot >= 0, hot.counts[is_hot], 2.0 ** (high / STEPS))
            pair = grams(h, context[context_at], (is_hot >= 0)[context_at])
            where = shard_of(pair, shards)
            here = model.has(where)
            distinct_pairs, pair_at = np.unique(pair, return_inverse=True)  # sorted: probes stay near each other
            low = model.level(distinct_pairs, shard_of(distinct_pairs, shards))[pair_at]
            # a pair counts for the least its level allows, its context for the most
            ratio = np.where(low > 0, 2.0 ** ((low - 1) / STEPS), 0.0) / most[context_at]
            after_known, gain = ((high > 0) | (is_hot >= 0))[context_at], bigram_weight * np.minimum(ratio, 1.0)
            p = np.where(after_known, gain + (1 - bigram_weight) * p_uni, p_uni)
            common = is_known[back]
            logs = np.add.reduceat(np.where(here & common, np.log10(p), 0.0), begin)
            # the others' counts are joined: what the bigram adds goes along, -1 after an unknown context
            at = np.flatnonzero(here & ~common)
            row, gain = np.repeat(np.arange(len(keys)), lengths)[at], np.where(after_known, gain, -1.0)[at]
            for i in range(0, len(at), 100_000):
                r = row[i : i + 100_000]
                nothing = np.zeros(len(r), np.int64)
                yield _sums(h[at[i : i + 100_000]].view(np.int64), keys[r], part.column(0).take(pa.array(r)), nothing, nothing, nothing, gain[i : i + 100_000])
            docs = part.column(0)
            zero = np.zeros(len(keys), np.int64)
            if first_pass:
                known = np.add.reduceat(is_known[back].astype(np.int64), begin)
                base = np.add.reduceat(log_count[back], begin)
                yield _sums(~keys, keys, docs, lengths, known, base, logs)
            else:
                yield _sums(~keys, keys, docs, zero, zero, zero, logs)

    return run


#: In a row of sums, the token is the complement of the row's key: few tokens can have such a hash, and it is no hot key.
SUMS = "token long, row long, doc_id long, n_tokens long, n_known long, base double, model double"


def _sums(token, row, docs, n_tokens, n_known, base, model) -> pa.RecordBatch:
    columns = [pa.array(token), pa.array(row), docs, pa.array(n_tokens), pa.array(n_known), pa.array(np.asarray(base, np.float64)), pa.array(np.asarray(model, np.float64))]
    return pa.RecordBatch.from_arrays(columns, names=["token", "row", "doc_id", "n_tokens", "n_known", "base", "model"])


def lm_scores(docs: DataFrame, *, frequent: int = FREQUENT, shard_grams: int = SHARD_GRAMS, pass_bytes: int = PASS_BYTES, bigram_weight: float = BIGRAM_WEIGHT) -> DataFrame:
    """Scores of all texts under a bigram model of the training texts, beside an exact add-one unigram.

    Rows whose crc32(doc_id) leaves 2 modulo 7 are held out of training; a null doc_id trains. A null text is empty,
    which is one token, the end. Repeated rows train and come out as often as they come; other columns are ignored; an
    empty table gives no rows.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. The base sums
    log10((c + 1) / (N + V + 1)) with exact counts: those of the ``frequent`` most frequent tokens are broadcast, the
    rest joined; tokens are told apart by 64-bit hashes. The score interpolates a bigram estimate with a unigram: the quantised counts of bigrams and of
    their contexts are in a Bloom filter, stored at every level up to their own and read by probing upwards. The
    score's unigram is the base's: every count is exact, broadcast or joined, and only unseen tokens have count 0.

    The filter is built in shards, each by one task, as many as the training tokens need; bigrams are with their
    contexts, but those of hot contexts, whose counts are broadcast exactly, are spread. It is broadcast in passes of at most ``pass_bytes`` (and at least one shard); the sums of the passes add up.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    counts = written(source.mapInArrow(count_tokens, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "tokens")
    level = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(counts.groupBy(level.alias("level")).agg(F.count("*"), F.sum("c")).collect(), reverse=True)
    total, distinct = sum(r[2] for r in histogram), sum(r[1] for r in histogram)
    kept, at = 0, None
    for lv, n, _ in histogram:
        if kept + n > frequent:
            break
        kept, at = kept + n, lv
    top = counts.where(level >= at if at is not None else F.lit(False)).toArrow()
    known_hash, known_count = np.asarray(top["token"]).view(np.uint64), np.asarray(top["c"])
    order = np.argsort(known_hash)
    known_hash, known_count = known_hash[order], known_count[order]
    popular = known_count >= max(1, total * HOT_SHARE)
    ends = known_count[known_hash == END]
    hot_hash, hot_count = np.append(known_hash[popular], START), np.append(known_count[popular], ends[0] if len(ends) else 1)
    order = np.argsort(hot_hash)
    hot = (hot_hash[order], hot_count[order])
    shards = max(16, -(-2 * total // shard_grams))
    built = written(source.mapInArrow(count_grams(spark.sparkContext.broadcast(hot), shards), "shard int, keys binary, counts binary").repartitionById(shards, "shard").groupBy("shard").applyInPandas(build_shard, "shard int, bits long, filter binary"), "filter")
    sizes = dict(built.select("shard", "bits").collect())
    groups, held = [[]], 0
    for shard in range(shards):  # those that hold nothing too
        bits = sizes.get(shard, 0)
        if groups[-1] and held + bits // 8 > pass_bytes:
            groups.append([])
            held = 0
        groups[-1].append(shard)
        held += bits // 8
    parts = None
    for i, group in enumerate(groups):
        mine, size, base, raw = np.zeros(shards, bool), np.zeros(shards, np.uint64), np.zeros(shards, np.int64), bytearray()
        mine[group] = True
        for shard, bits, part in built.where(F.col("shard").isin(group)).select("shard", "bits", "filter").toLocalIterator():
            size[shard], base[shard] = bits, len(raw)
            raw += part
        shared = spark.sparkContext.broadcast((known_hash, known_count, *hot, total, distinct, mine, size, base, raw))
        found = source.mapInArrow(scorer(shared, i == 0, bigram_weight), SUMS)
        parts = found if parts is None else parts.unionByName(found)
    rest = counts if at is None else counts.where(level < at)
    joined = parts.join(rest.withColumnRenamed("c", "rare"), "token", "left")
    # rows repeated as they are share a key; their equal sums are dealt out again
    is_token = F.col("token") != F.bitwise_not("row")
    real = F.when(is_token, F.col("rare"))
    uni = (F.coalesce(F.col("rare"), F.lit(0)) + 1.0) / F.lit(float(total + distinct + 1))
    mixture = F.when(F.col("model") < 0, uni).otherwise(F.col("model") + F.lit(1 - bigram_weight) * uni)
    sums = joined.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.count_if(F.col("n_tokens") > 0).alias("copies"),
        (F.sum("n_known") + F.count(real)).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(F.log10(real + 1.0)), F.lit(0.0))).alias("base"),
        F.sum(F.when(is_token, F.log10(mixture)).otherwise(F.col("model"))).alias("score"),
    )
    each = [(F.col(c) / F.col("copies")).cast(kind).alias(c) for c, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("score", "double"))]
    sums = sums.select("doc_id", *each, F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scale = math.log10(total + distinct + 1)
    out = sums.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score")
    return out.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])
