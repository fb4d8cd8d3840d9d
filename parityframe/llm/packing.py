"""Token-id packing (operator 8): best-fit decreasing with a segment tree.

Documents are tokenised (operator 5's codec) and laid into rows of ``length``
ids. Each task packs its own rows in blocks of at most ``block_tokens`` ids,
so nothing is shuffled and memory does not grow with the input; a block's
last row may stay part-empty, which costs at most one row per block.

Within a block, documents longer than a row are split losslessly into full
rows and a rest; all pieces are then placed longest first into the fullest
row that still takes them. A segment tree over the free capacities finds that
row in log2(length) steps. Ties go to the row opened last; equal lengths keep
the order of the input, so a rerun of the task gives the same rows.

A result row has ``ids`` (length * 4 bytes, little-endian unsigned 32-bit, the
free places holding ``pad``), ``n_tokens`` used, ``cu_seqlens`` (0 and the end of
each piece), ``position_resets`` (where position ids start again from 0),
``doc_ids`` and ``doc_offsets`` (which document a piece is of, and at which of
its ids the piece starts). (shard, row) numbers the matrix rows.

``write_packed`` writes the rows to files: each task those of its own shard,
into the shared folder or a given one, which all executors must reach. A shard
has three files of little-endian 32-bit numbers, named by the manifest: ``ids``
(the matrix, row after row), ``cu_seqlens`` and ``position_resets`` (the rows'
lists one after the other; 0 occurs only as the first of a row).

Defined results: a null or empty text has no ids and so no piece; a null id
packs like any other; repeated rows are packed each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from parityframe.llm.bpe import codec, read_ranks
from parityframe.llm.common import read_table, shared_path, ship, stored

ROW = "shard int, row long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, " \
      "doc_ids array<long>, doc_offsets array<long>"
_ROW_ARROW = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()),
                        ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
                        ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])
#: Files of a shard, and their manifest.
FILES = ("ids", "cu_seqlens", "position_resets")
MANIFEST = "shard int, n_rows long, length int, n_tokens long, n_pieces long, " + ", ".join(f"{f} string" for f in FILES)


class FreeRows:
    """Open rows by free capacity 1..length, with a segment tree of how many
    rows each range of capacities holds."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def put(self, row: int, free: int) -> None:
        if free:
            self.rows.setdefault(free, []).append(row)
            self._change(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free capacity >= need, removed; or None."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._change(free, -1)
        return self.rows[free].pop(), free

    def _change(self, free: int, by: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += by
            node //= 2


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is at most ``length`` long."""
    rows: list[list[int]] = []
    free_rows = FreeRows(length)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free_rows.take(lengths[piece])
        row, free = found if found else (len(rows), length)
        if not found:
            rows.append([])
        rows[row].append(piece)
        free_rows.put(row, free - lengths[piece])
    return rows


def _pack_block(docs: list[tuple[int | None, bytes]], length: int, pad: int):
    """(ids, n_tokens, cu_seqlens, doc_ids, doc_offsets) of each row of a block."""
    pieces = [(doc, at, packed[4 * at:4 * (at + length)]) for doc, packed in docs for at in range(0, len(packed) // 4, length)]
    filler = np.array([pad], dtype="<u4").tobytes()
    for row in best_fit_decreasing([len(p[2]) // 4 for p in pieces], length):
        ends = np.cumsum([0] + [len(pieces[i][2]) // 4 for i in row]).tolist()
        ids = b"".join(pieces[i][2] for i in row) + filler * (length - ends[-1])
        yield ids, ends[-1], ends, [pieces[i][0] for i in row], [pieces[i][1] for i in row]


def pack_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 2048, pad: int = 50256, block_tokens: int = 1 << 21) -> DataFrame:
    """Matrix rows of all documents of ``docs``."""
    ranks = read_ranks(docs.sparkSession, rank_path)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks.value, pattern).encode
        shard, row = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush():
            nonlocal row, held, tokens
            made = list(_pack_block(held, length, pad))
            held, tokens = [], 0
            for at in range(0, len(made), 256):
                part = made[at:at + 256]
                yield pa.record_batch([
                    pa.array([shard] * len(part), pa.int32()), pa.array(range(row, row + len(part)), pa.int64()),
                    pa.array([p[0] for p in part], pa.binary()), pa.array([p[1] for p in part], pa.int32()),
                    pa.array([p[2] for p in part], pa.list_(pa.int32())),
                    pa.array([p[2][:-1] for p in part], pa.list_(pa.int32())),
                    pa.array([p[3] for p in part], pa.list_(pa.int64())),
                    pa.array([p[4] for p in part], pa.list_(pa.int64()))], schema=_ROW_ARROW)
                row += len(part)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                packed = encode(text.as_py() or "")
                if packed:
                    if held and tokens + len(packed) // 4 > block_tokens:
                        yield from flush()
                    held.append((doc.as_py(), packed))
                    tokens += len(packed) // 4
        if held:
            yield from flush()
    return docs.select(docs[id_col].cast("long"), text_col).mapInArrow(run, ROW)


class _ShardFiles:
    """The open files of one shard, and what they hold so far."""

    def __init__(self, store, base: str, shard: int):
        self.shard, name = shard, uuid.uuid4().hex
        self.paths = [f"{base.rstrip('/')}/shard-{shard:06d}-{name}.{f}" for f in FILES]
        self.files = [store.open_output_stream(p) for p in self.paths]
        self.rows = self.length = self.tokens = self.pieces = 0

    def add(self, batch: pa.RecordBatch) -> None:
        ids, ends, resets = (batch.column(f) for f in FILES)
        for row in ids:
            self.files[0].write(row.as_buffer())
        self.files[1].write(ends.flatten().to_numpy().astype("<i4").tobytes())
        self.files[2].write(resets.flatten().to_numpy().astype("<i4").tobytes())
        self.rows, self.length = self.rows + batch.num_rows, len(ids[0].as_buffer()) // 4
        self.tokens += sum(batch.column("n_tokens").to_pylist())
        self.pieces += len(resets.flatten())

    def closed(self) -> pa.RecordBatch:
        for f in self.files:
            f.close()
        return pa.record_batch([pa.array([self.shard], pa.int32()), pa.array([self.rows]), pa.array([self.length], pa.int32()),
                                pa.array([self.tokens]), pa.array([self.pieces]), *[pa.array([p]) for p in self.paths]],
                               names=["shard", "n_rows", "length", "n_tokens", "n_pieces", *FILES])


def write_packed(packed: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows of ``pack_documents``, also of a stored copy of them; the
    manifest: for each shard with rows its numbers of rows, ids a row, ids used and
    pieces, and its files' paths. Rows are dealt by their own shard, in order. A
    repeated task writes new files, and the manifest names those of the attempt
    that counts."""
    target = folder or shared_path(packed.sparkSession, "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target)
        current = None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.r_[True, np.diff(shards) != 0, True]) if len(shards) else []
            for at, to in zip(edges[:-1], edges[1:]):
                if current is None or current.shard != shards[at]:
                    if current:
                        yield current.closed()
                    store.create_dir(base, recursive=True)
                    current = _ShardFiles(store, base, int(shards[at]))
                current.add(batch.slice(at, to - at))
        if current:
            yield current.closed()
    dealt = packed.select("shard", "row", "n_tokens", *FILES).repartition("shard").sortWithinPartitions("shard", "row")
    return stored(dealt.mapInArrow(run, MANIFEST), "packed-manifest")


def op8_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(read_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
