"""Operator 2: packing token sequences by first-fit decreasing.

Documents are dealt by a hash into random groups of some thousands; each group is packed on its
own, by first-fit decreasing over a tournament tree of bin capacities.  A document longer than a
sequence is cut into full pieces and a rest, so that only rests compete for room.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from notewright.llm import common, tokens

SEQUENCE, END_ID = 2048, 1
GROUP_DOCS = 4096
#: Pieces that one run of first-fit decreasing holds; a group that got more is packed in several runs.
GROUP_PIECES = 1 << 17


class Tournament:
    """A complete binary tree over bins; a node holds the largest room below it.

    ``place`` finds the first bin with room enough in a walk from the root to a leaf.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        room[i] -= size
        leaf = i - self.leaves
        i //= 2
        while i:
            left, right = room[2 * i], room[2 * i + 1]
            best = left if left >= right else right
            if room[i] == best:
                break
            room[i] = best
            i //= 2
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item.  Items must fit a bin; ties keep the order given."""
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), []
    total = sum(sizes)
    # First-fit needs at most twice the lower bound and one more.
    tree = Tournament(min(len(sizes), 2 * math.ceil(total / capacity) + 1), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.place(sizes[i])
        while b >= len(used):
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += sizes[i]
    return bins, offsets


def padding(length: int, sequence: int = SEQUENCE) -> int:
    """Padding ids of a sequence: up to the full length, none where the length is a power of two."""
    return 0 if length & (length - 1) == 0 else sequence - length


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False, n_docs: int | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``sequence`` ids; one row for each piece.

    Returns ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``with_ids``, the ids themselves.  Only these narrow rows are shuffled, not the texts.  A group is
    chosen by a hash of key and ids, so the result does not depend on the partitioning, and a key
    that repeats is spread by its texts; groups of exact repeats beyond ``GROUP_PIECES`` pieces are
    packed in several bounded runs.

    Null and empty texts are documents of one id, the end id.  Null keys are kept.  Repeated rows
    are packed as often as they come.  An empty table gives an empty result.  Extra columns are not
    read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    whole = spark.sparkContext.broadcast(tokens.whole_tokens(tokens.vocabulary_path(vocabulary)))  # bounded by the vocabulary
    groups = max(1, math.ceil((docs.count() if n_docs is None else n_docs) / group_docs))
    kind = docs.schema[key].dataType
    key_type, last = to_arrow_type(kind), end_id.to_bytes(4, "little")
    cut_schema = pa.schema([("key", key_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("doc_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
    cut_ddl = f"key {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = tokens.worker_chunks(tokens.vocabulary_path(vocabulary), whole.value, ids=True)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in cut_schema}
            for k, ids in zip(batch.column(0).to_pylist(), chunks.texts(common.texts_of(batch.column(1))), strict=True):
                ids += last
                n, crc = len(ids) // 4, zlib.crc32(ids)
                for start in range(0, n, sequence):
                    piece = ids[4 * start : 4 * (start + sequence)]
                    row = [k, start, len(piece) // 4, zlib.crc32(piece), n, crc, piece]
                    for name, value in zip(out, row, strict=False):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in cut_schema], schema=cut_schema)

    pieces = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, cut_ddl)
    pieces = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(2), "key", "doc_crc32", "doc_tokens"), F.lit(groups)))
    order = ["pack_group", "key", "start", "doc_crc32", "length", "ids_crc32"]
    dealt = pieces.repartition("pack_group").sortWithinPartitions(*order)

    names = [f.name for f in cut_schema if f.name != "doc_crc32"]
    packed_schema = pa.schema([cut_schema.field(n) for n in names] + [("sequence_id", pa.int64()), ("offset", pa.int64())])
    packed_ddl = cut_ddl.replace(" doc_crc32 long,", "").replace(", doc_crc32 long", "") + ", sequence_id long, offset long"

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, runs, count = None, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            bins, offsets = first_fit_decreasing(rows["length"].to_pylist(), sequence)
            base = (now << 32) + (runs << 18)
            for b in rows.select(names).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).to_batches(max_chunksize=20_000):
                yield b.cast(packed_schema) if b.schema != packed_schema else b

        for batch in batches:
            groups_here = batch.column("pack_group").to_numpy()
            at = 0
            while at < len(groups_here):
                end = at
                g = int(groups_here[at])
                if g != now:
                    yield from flush()
                    held, now, runs, count = [], g, 0, 0
                elif count >= GROUP_PIECES:
                    yield from flush()
                    held, runs, count = [], runs + 1, 0
                end = at + int((groups_here[at:] == g).sum())
                end = min(end, at + GROUP_PIECES - count)
                held.append(batch.slice(at, end - at))
                count += end - at
                at = end
        yield from flush()

    out = dealt.mapInArrow(pack, packed_ddl)
    cols = [F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*cols, *(["ids"] if with_ids else []))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
