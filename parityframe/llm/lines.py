"""Line dedup (operator 3): levelled sorted runs of line hashes.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points that ``min_docs`` or more documents
hold are frequent; their lines are dropped from every document.

Method
------
``LineRuns`` keeps, in the shared folder, runs of (128-bit key hash, number of
documents). A run is bucketed by the hash and sorted by it within a bucket, all
runs into the same ``buckets`` hash ranges, so runs meet bucket by bucket in
merge joins that neither shuffle nor sort what is stored. ``add`` takes a batch
of documents: its keys, counted in the tasks and dealt to the buckets,
merge-anti-join the runs of frequent keys, and what is left becomes a run of
level 0. When a level holds ``fan`` runs they are merged, two at a time, into one
run of the next level; keys that reach ``min_docs`` there are frequent from then
on. ``frequent`` merges what is left. So a key is written about once per level,
and a batch only shuffles its own keys.

``drop_lines`` then cuts the lines. The frequent keys go to the tasks as a
sorted array if their counted number is at most ``broadcast_keys`` (16 bytes
each); beyond it they are joined with the documents' own keys instead, which
Spark can split when one key is hot. Both ways give the same rows.

Defined results: a null or empty text is one empty line, which is never
frequent (with min_chars of 1 or more); every row counts as a document of its
own, also rows with equal or null ids; a column of the input named like an
added one is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityframe.llm.common import free_shuffles, read_table, shared_path, ship

_KEY = np.dtype([("a", "<i8"), ("b", "<i8")])
#: Distinct keys that a task counts before it passes them on.
HELD_KEYS = 1 << 17


def line_key(line: bytes) -> bytes:
    """bytes.strip and bytes.lower touch exactly [\\x20\\x09-\\x0D] and A-Z."""
    return line.strip().lower()


def _digests(text: str, min_chars: int) -> list[bytes]:
    """128-bit digest of each line's key; empty where it is too short."""
    out = []
    for line in text.encode().split(b"\n"):
        key = line_key(line)
        long_enough = bool(key) if min_chars == 1 else len(key.decode()) >= min_chars
        out.append(xxhash.xxh3_128_digest(key) if long_enough else b"")
    return out


def _as_keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=_KEY)


def _counts(seen: dict[bytes, int]) -> pa.RecordBatch:
    keys = _as_keys(list(seen))
    return pa.record_batch([pa.array(keys["a"]), pa.array(keys["b"]), pa.array(seen.values(), pa.int64())],
                           names=["a", "b", "docs"])


def _count_keys(min_chars: int):
    """Keys and documents of a task's rows; a key comes once for every
    HELD_KEYS distinct ones, so a hot line is a few rows a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for digest in set(_digests(text.as_py() or "", min_chars)):
                    seen[digest] = seen.get(digest, 0) + 1
                if len(seen) > HELD_KEYS:
                    seen.pop(b"", None)
                    yield _counts(seen)
                    seen = {}
        seen.pop(b"", None)
        yield _counts(seen)
    return run


class LineRuns:
    """The levelled store. Runs are bucketed, sorted Parquet tables in the
    shared folder; ``buckets`` is the session's number of shuffle partitions
    unless given."""

    def __init__(self, spark: SparkSession, min_docs: int, min_chars: int = 1, fan: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.min_chars, self.fan = spark, min_docs, min_chars, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.done: list[DataFrame] = []  # runs of frequent keys

    def _write(self, make: Callable[[], DataFrame]) -> DataFrame:
        """Write what ``make`` gives, in bucket order, as a new run."""
        with _stored_order(self.spark):
            name = f"line_run_{uuid.uuid4().hex}"
            # Hashes don't compress.
            make().write.format("parquet").option("compression", "none").bucketBy(self.buckets, "a", "b") \
                .sortBy("a", "b").option("path", shared_path(self.spark, "line-run")).saveAsTable(name)
            run = self.spark.table(name)
            # The frame knows files and buckets by now; the catalog need not.
            self.spark.sql(f"DROP TABLE {name}")
        free_shuffles(self.spark)
        return run

    def new_keys(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(a, b, docs) of a batch's keys that are not known to be frequent."""
        keys = docs.select(text_col).mapInArrow(_count_keys(self.min_chars), "a long, b long, docs long")
        keys = keys.repartition(self.buckets, "a", "b").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
        for run in self.done:
            keys = keys.join(run.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return keys

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count a new batch and put it on level 0, compacting full levels."""
        ship(self.spark)
        self.levels[0].append(self._write(lambda: self.new_keys(docs, text_col)))
        level = 0
        while len(self.levels[level]) >= self.fan:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            level += 1
            self.levels[level].append(merged)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        merged = runs[0]
        for run in runs[1:]:
            merged = self._write(lambda left=merged, right=run: merged_pair(left, right))
        self.done.append(merged.filter(F.col("docs") >= self.min_docs))
        return merged.filter(F.col("docs") < self.min_docs)

    def frequent(self) -> DataFrame:
        """(a, b) of every key that min_docs documents hold. Compacts all levels
        into one."""
        runs = [run for level in self.levels for run in level]
        if runs:
            self.levels = [[], [self._merge(runs)]]
        if not self.done:
            return self.spark.createDataFrame([], "a long, b long")
        out = self.done[0]
        for run in self.done[1:]:
            out = out.unionByName(run)
        return out.select("a", "b")


def merged_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs as one: a full merge join, documents added."""
    left, right = left.alias("l"), right.alias("r").hint("merge")
    same = (F.col("l.a") == F.col("r.a")) & (F.col("l.b") == F.col("r.b"))
    docs = F.coalesce("l.docs", F.lit(0)) + F.coalesce("r.docs", F.lit(0))
    return left.join(right, same, "full").select(F.coalesce("l.a", "r.a").alias("a"), F.coalesce("l.b", "r.b").alias("b"),
                                                 docs.alias("docs"))


@contextmanager
def _stored_order(spark: SparkSession) -> Iterator[None]:
    """Scans of sorted buckets keep their order, and sorted rows are summed as
    they come, without a hash map; the session's settings return afterwards."""
    names = ("spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.execution.replaceHashWithSortAgg")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def _cut(text: str, drop: set[bytes], min_chars: int) -> tuple[str, int, int]:
    lines = text.split("\n")
    kept = [line for line, d in zip(lines, _digests(text, min_chars)) if d not in drop]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _cut_batches(column: str, drop_of, min_chars: int, names: list[str]):
    """Replace the text column and add the counts. ``drop_of(batch)`` gives the
    digests to drop for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = batch.column(column).to_pylist()
            cut = [_cut(t or "", drop, min_chars) for t, drop in zip(texts, drop_of(batch, len(texts)))]
            new = {column: pa.array([c[0] for c in cut], pa.string()), "n_lines": pa.array([c[1] for c in cut], pa.int64()),
                   "n_dropped": pa.array([c[2] for c in cut], pa.int64())}
            yield pa.record_batch([new[n] if n in new else batch.column(n) for n in names], names=names)
    return run


def drop_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text", min_chars: int = 1,
               broadcast_keys: int = 1 << 20) -> DataFrame:
    """``docs`` with frequent lines cut from the text, plus n_lines (before)
    and n_dropped. See the module for the two ways and ``broadcast_keys``."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_lines", "n_dropped")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]
                          + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if frequent.count() <= broadcast_keys:
        rows = frequent.toPandas()
        keys = np.zeros(len(rows), dtype=_KEY)
        keys["a"], keys["b"] = rows["a"].to_numpy(), rows["b"].to_numpy()
        shared = spark.sparkContext.broadcast(keys.tobytes())

        drop: set[bytes] = set()

        def drop_of(_, n):
            if not drop:
                drop.update(shared.value[i:i + 16] for i in range(0, len(shared.value), 16))
            return [drop] * n
        return docs.mapInArrow(_cut_batches(text_col, drop_of, min_chars, schema.names), schema)

    # Keyed by a hash of the text: what a text loses depends on the text alone.
    keyed = docs.withColumn("__text_hash", F.xxhash64(text_col))
    own = keyed.select(text_col, "__text_hash").mapInArrow(_own_keys(min_chars), "a long, b long, __text_hash long")
    hits = own.join(frequent, ["a", "b"], "left_semi").distinct() \
        .groupBy("__text_hash").agg(F.collect_list("a").alias("__a"), F.collect_list("b").alias("__b"))
    joined = keyed.join(hits, "__text_hash", "left")

    def drop_of(batch, n):
        for a, b in zip(batch.column("__a").to_pylist(), batch.column("__b").to_pylist()):
            keys = np.zeros(len(a or ()), dtype=_KEY)
            if a:
                keys["a"], keys["b"] = a, b
            yield {k.tobytes() for k in keys}
    return joined.mapInArrow(_cut_batches(text_col, drop_of, min_chars, schema.names), schema)


def _own_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows = [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                own = set(_digests(text or "", min_chars)) - {b""}
                digests.extend(own)
                rows.extend([i] * len(own))
            keys = _as_keys(digests)
            yield pa.record_batch([pa.array(keys["a"]), pa.array(keys["b"]),
                                   batch.column(1).take(pa.array(rows, pa.int64()))], names=["a", "b", "__text_hash"])
    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                min_chars: int = 1, batches: int = 4, fan: int = 2) -> DataFrame:
    """Whole-table dedup: the documents enter a new store in ``batches``
    batches (by a hash of the id), then frequent lines are dropped everywhere."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fan)
    for i in range(batches):
        runs.add(docs.filter(F.pmod(F.xxhash64(id_col), F.lit(batches)) == i), text_col)
    return drop_lines(docs, runs.frequent(), text_col, min_chars)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Trimming and lower-casing are spelled out by character class; DuckDB's
#: lower() would also change letters beyond A-Z.
OP3_SQL = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM parts),
keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM numbered),
frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
flagged AS (
  SELECT doc_id, i, line, k IN (SELECT k FROM frequent) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
