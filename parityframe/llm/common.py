"""Pieces that several operators share: the shared folder, text blocks and
the routing of packed keys between blocks and buckets."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityframe.session import ensure_checkpoint_dir

#: Text bytes per block and the least number of blocks (for parallelism on
#: small inputs). A block is what one Python call holds.
BLOCK_BYTES = 4 << 20
LEAST_BLOCKS = 64
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would: Python tasks
    import it, and on a cluster it is not on their path. Once per context."""
    import parityframe
    sc = spark.sparkContext
    # Texts are long: batches of the default 10,000 rows hold tens of MB, twice
    # in each of the JVM and the Python worker.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_parityframe_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(parityframe.__file__))
    target = os.path.join(tempfile.mkdtemp(), "parityframe_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("parityframe", os.path.relpath(full, top)))
    sc.addPyFile(target)
    sc._parityframe_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts
    the lineage, survives lost executors, and is computed once."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner
    does so when the driver's JVM finds that nothing refers to them any more,
    which else may be long after."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of text in the whole table (one column scan)."""
    row = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()
    return int(row["n"] or 0)


def block_count(n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(LEAST_BLOCKS, math.ceil(n_bytes / block_bytes))


def text_blocks(docs: DataFrame, id_col: str, text_col: str, n_blocks: int) -> DataFrame:
    """(block, id, text): rows dealt to blocks by a hash of id and text, so
    that neither one id nor one source makes a large block."""
    ship(docs.sparkSession)
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)).cast("int")
    return docs.select(block.alias("block"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).alias("text"))


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each uint64 hash by its upper half; grows with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)


def planes(values: np.ndarray) -> bytes:
    """Bytes of the numbers, all lowest bytes first, then the next: bytes
    that are mostly equal lie together and compress in the shuffle."""
    size = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, size).T.tobytes()


def from_planes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(blob, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(dtype).ravel()


def bucket_cuts(sorted_hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, places where they begin and end) in sorted hashes."""
    b = bucket_of(sorted_hashes, n_buckets)
    if not len(b):
        return b, np.zeros(1, np.int64)
    begin = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    return b[begin], np.r_[begin, len(b)]


PACKED = "block int, bucket int, packed binary"
PACKED_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])
BITS = "block int, kind int, bucket int, bits binary"
BITS_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def shared_hashes(table: pa.Table) -> pa.Table:
    """One bucket: for every block a bit per packed 48-bit hash, set if another
    block has it."""
    parts = []
    for blob in table.column("packed").to_pylist():
        six = np.frombuffer(blob, np.uint8).reshape(6, -1).T
        full = np.zeros((len(six), 8), np.uint8)
        full[:, :6] = six
        parts.append(full.view(np.uint64).ravel())
    everything = np.concatenate(parts)
    order = np.argsort(everything, kind="stable")
    s = everything[order]
    same = np.zeros(len(s), dtype=bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    shared = np.empty(len(s), dtype=bool)
    shared[order] = same
    return bit_rows(table, 0, shared, [len(p) for p in parts])


def bit_rows(table, kind, flags, lengths):
    ends = np.cumsum(lengths)
    rows = [np.packbits(flags[e - n:e]).tobytes() for e, n in zip(ends, lengths)]
    return pa.table([table.column("block").combine_chunks(), pa.array([kind] * len(rows), pa.int32()),
                     table.column("bucket").combine_chunks(), pa.array(rows, pa.binary())], schema=BITS_ARROW)


def read_bits(bits: pa.Table, kind: int, sorted_hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The flags of a block's sorted hashes, from what the buckets answered."""
    flags = np.zeros(len(sorted_hashes), dtype=bool)
    buckets, cuts = bucket_cuts(sorted_hashes, n_buckets)
    where = {int(b): (cuts[i], cuts[i + 1]) for i, b in enumerate(buckets)}
    for got, bucket, blob in zip(bits.column("kind").to_pylist(), bits.column("bucket").to_pylist(),
                                 bits.column("bits").to_pylist()):
        if got == kind:
            a, b = where[bucket]
            flags[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a).view(bool)
    return flags


def packed_hashes(block: int, sorted_hashes: np.ndarray, n_buckets: int) -> pa.Table:
    """Rows of PACKED: a block's distinct hashes by bucket. The bucket gives the
    upper bits; 48 lower ones tell hashes apart well enough, since a chance
    match only adds something to compare."""
    buckets, cuts = bucket_cuts(sorted_hashes, n_buckets)
    low = sorted_hashes.view(np.uint8).reshape(-1, 8)[:, :6]
    rows = [low[a:b].T.tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table([pa.array([block] * len(rows), pa.int32()), pa.array(buckets), pa.array(rows, pa.binary())],
                    schema=PACKED_ARROW)
