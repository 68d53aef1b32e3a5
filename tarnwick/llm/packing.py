"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, written

#: Tokens of a sequence; a bin with no more than SLACK free is nearly full and is closed at once.
CAPACITY, SLACK = 1024, 2
#: Groups that meet in one at each level of the merge tree, and bins that one group holds at most.
FAN_IN, GROUP_BINS = 8, 50_000
#: The id that ends each document.
END_ID = 2
#: Tokens whose pieces a task packs at once; the underfull bins of its next ones meet them in the merge tree.
BLOCK_TOKENS = 16_000_000
#: Bits that number the bins of one block.
BLOCK_BITS = 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, offset long, load long"
#: Texts beyond these characters go to the reference tokenizer; within them both libraries split alike.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]")


class Encoder:
    """Token ids of texts as given by ``tokenizers``, by a faster library where both agree."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(json_path)
        added = sorted(re.escape(t.content) for t in self.reference.get_added_tokens_decoder().values())
        self.unusual = re.compile("|".join([UNUSUAL.pattern, *added]))  # added tokens are ids of their own in texts
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and not self.unusual.search(text):
            return self.fast.encode_ordinary(text)
        return self.reference.encode(text, add_special_tokens=False).ids


class BestFit:
    """Open bins by what is free in them; a big integer marks which amounts of free space occur."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.mask, self.loads = capacity, {}, 0, []

    def place(self, length: int) -> tuple[int, int]:
        """The bin for an item of this length, and its place there."""
        found = self.mask >> length
        if found:
            room = length + ((found & -found).bit_length() - 1)
            stack = self.free[room]
            own = stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
        else:
            own, room = len(self.loads), self.capacity
            self.loads.append(0)
        at = self.loads[own]
        self.loads[own] = at + length
        room -= length
        if room:
            self.free.setdefault(room, []).append(own)
            self.mask |= 1 << room
        return own, at


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place and load of that bin for each item, taken in the order given."""
    packer = BestFit(capacity)
    placed = [packer.place(int(x)) for x in lengths]
    bins = np.array([x[0] for x in placed], dtype=np.int64)
    return bins, np.array([x[1] for x in placed], dtype=np.int64), np.array(packer.loads, dtype=np.int64)[bins] if len(bins) else bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for a shorter first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * bool(head) + [(i, capacity) for i in range(head, n, capacity)]


def local_packer(paths: tuple, capacity: int, end_id: int, keep_ids: bool, block_tokens: int):
    """Tokenises and packs one partition of documents, in blocks of about ``block_tokens``: no more stays in memory."""

    def packed(docs, pieces, starts, lengths, sums, tokens, base: int) -> Iterator[pa.RecordBatch]:
        size = np.array(lengths, dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        bins, places, loads = (np.empty(len(size), np.int64) for _ in range(3))
        bins[order], places[order], loads[order] = best_fit(size[order], capacity)
        bins += base
        for i in range(0, len(size), 20_000):
            part = slice(i, i + 20_000)
            arrays = [pa.array(docs[part], pa.int64()), pa.array(pieces[part], pa.int32()), pa.array(starts[part], pa.int64()), pa.array(lengths[part], pa.int64()), pa.array(sums[part], pa.int64()), pa.array(tokens[part], pa.binary()), pa.array(bins[part]), pa.array(places[part]), pa.array(loads[part])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "bin", "offset", "load"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*paths)
        base, held = np.int64(TaskContext.get().partitionId()) << 40, 0
        block: tuple[list, ...] = ([], [], [], [], [], [])
        for data in batches:
            for doc, text in zip(data.column(0).to_pylist(), as_bytes(data.column(1)), strict=True):
                ids = np.array([*encoder.ids(text.decode()), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + length].tobytes()
                    for column, value in zip(block, (doc, k, start, length, zlib.crc32(raw), raw if keep_ids else None), strict=True):
                        column.append(value)
                held += len(ids)
                if held >= block_tokens or len(block[0]) >= 1 << BLOCK_BITS:
                    yield from packed(*block, base)
                    base, held, block = base + (1 << BLOCK_BITS), 0, ([], [], [], [], [], [])
        yield from packed(*block, base)

    return pack


def merger(capacity: int):
    """Best fit over the underfull bins of one group, each as one item, fullest first."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if not parts:
            return
        old, load = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((old, -load))
        old, load = old[order], load[order]
        own, place, total = best_fit(load, capacity)
        first = np.full(own.max() + 1, -1, dtype=np.int64)
        first[own[::-1]] = old[::-1]  # the first item names the merged bin
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (old, first[own], place, total)], names=["bin", "into", "shift", "load"])

    return merge


def pack_documents(docs: DataFrame, tokenizer_paths: tuple, *, capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID, keep_ids: bool = True, fan_in: int = FAN_IN, group_bins: int = GROUP_BINS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The pieces of all documents with their sequence and place in it, in as few sequences as best fit finds.

    Only documents longer than ``capacity`` are cut; the first piece may be shorter. A null or empty text is the end
    id alone; a null doc_id stays null; repeated rows are packed as often as they come; other columns are ignored; an
    empty table gives no rows. With ``keep_ids`` the pieces carry their ids (unsigned, 32 bits, little-endian).

    Ids are those of ``tokenizers`` with its own settings: a text that spells an added token out has that token's id.

    Each partition packs its own pieces by best fit, longest first, in blocks of ``block_tokens``. Nearly full bins are done; the underfull ones
    meet as items in ever fewer groups (at first one for each block), ``fan_in`` groups in one at each level, and are packed by best fit again. A
    group never holds more than about ``group_bins`` bins: where that many are left, the tree ends at that level.
    """
    tokenised = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = written(tokenised.mapInArrow(local_packer(tokenizer_paths, capacity, end_id, keep_ids, block_tokens), PIECES), "pieces")
    bins = local.where(F.col("offset") == 0).select("bin", "load")
    count, parts = local.where((F.col("offset") == 0) & (F.col("load") < capacity - slack)).agg(F.count("*"), F.countDistinct(F.shiftright("bin", BLOCK_BITS))).first()
    moved, groups = None, max(1, parts)
    while groups > 1 and count > 1:
        fewer = max(-(-groups // fan_in), -(-count // group_bins))
        if fewer >= groups:
            break
        groups = fewer
        open_bins = bins.where(F.col("load") < capacity - slack)
        merged = open_bins.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups))).repartition(groups, "g").select("bin", "load").mapInArrow(merger(capacity), "bin long, into long, shift long, load long")
        merged = written(merged, "merged")
        bins = merged.where(F.col("bin") == F.col("into")).select("bin", "load")
        count = bins.where(F.col("load") < capacity - slack).count()
        step = merged.where(F.col("bin") != F.col("into")).select("bin", "into", "shift")
        if moved is None:
            moved = step
        else:  # what went into a bin goes on with it
            onward = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(onward, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")).unionByName(step)
    if moved is None:
        placed = local.withColumn("sequence_id", F.col("bin"))
    else:
        placed = local.join(moved, "bin", "left").withColumn("sequence_id", F.coalesce("into", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*columns, *["ids"] * keep_ids)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents as pieces of sequences, with the ids of each piece.

    Null and empty texts, null ids, repeated rows and empty tables are as pack_documents has them.
    """
    return pack_documents(docs, public_paths())


def public_paths() -> tuple:
    """Where the public vocabulary is: (json, ranks, pattern); found beside the library that carries it."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN
