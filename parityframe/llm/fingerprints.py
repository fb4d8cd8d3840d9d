"""Document fingerprints (operator 10): homomorphic multiset hash.

A fingerprint is a sum of wide vectors, one per paragraph (a line of the
text), so the order of paragraphs doesn't matter and paragraphs can be added
or taken away without the rest of the text. It has two parts:

* ``EXACT`` lanes modulo 2**32, hashed from whole paragraphs: two texts agree in
  all of them only if they hold the same paragraphs, as often (up to hash
  collisions over 2048 bits);
* ``SKETCH`` lanes modulo 2**16 of +1 or -1, hashed from the paragraphs' units
  (UNIT_WORDS words at a time from the start of each sentence, which . ! or ?
  ends), and a count of units modulo 2**32. The squared lanes of a difference
  estimate how many units two texts don't share, which gives their likeness:
  1 - unshared / (units of both), within 0 and 1.
  Texts of equal exact lanes have likeness 1. The standard error of the
  unshared part is sqrt(2 / SKETCH) of it.

``neighbours`` streams over the documents in descending id, so that a task
sees each document with the next one: rows are range-dealt by cut points of
the ids, and the one document that follows a range is sent to it as well.
Texts are shuffled once, nothing is joined, and no task depends on the order
in which others run.

Defined results: a null text is empty; the empty text is one empty paragraph
and no unit; two texts without units are alike only if equal; rows of equal id
are ordered by a hash of the text, descending; null ids come last; an only row is its own next.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityframe.llm.common import read_table, ship, text_bytes

EXACT = 64
SKETCH = 256
UNIT_WORDS = 3
#: Text bytes that one range of ids should hold, and how many ranges there may
#: be (the most bounds what is broadcast: one short row for each).
RANGE_BYTES = 8 << 20
LEAST_RANGES, MOST_RANGES = 32, 100_000
_NO_ID = -(1 << 63)
_SENTENCE = re.compile(r"[^.!?]*[.!?]*")


class Fingerprint(NamedTuple):
    exact: np.ndarray
    sketch: np.ndarray
    units: int

    def hex(self) -> str:
        return (self.exact.astype("<u4").tobytes() + self.sketch.astype("<u2").tobytes()
                + self.units.to_bytes(4, "little")).hex()


def from_hex(text: str) -> Fingerprint:
    blob = bytes.fromhex(text)
    cut = 4 * EXACT
    return Fingerprint(np.frombuffer(blob[:cut], "<u4").astype(np.uint32),
                       np.frombuffer(blob[cut:-4], "<u2").astype(np.uint16), int.from_bytes(blob[-4:], "little"))


def _units(paragraph: str) -> Iterator[bytes]:
    """Consecutive words of a paragraph's sentences, UNIT_WORDS at a time."""
    for sentence in _SENTENCE.findall(paragraph):
        words = sentence.split()
        for i in range(0, len(words), UNIT_WORDS):
            yield " ".join(words[i:i + UNIT_WORDS]).encode()


def fingerprint(paragraphs: list[str]) -> Fingerprint:
    """Of a multiset of paragraphs."""
    if not paragraphs:
        return Fingerprint(np.zeros(EXACT, np.uint32), np.zeros(SKETCH, np.uint16), 0)
    exact = b"".join([hashlib.shake_128(p.encode()).digest(4 * EXACT) for p in paragraphs])
    units = [u for p in paragraphs for u in _units(p)]
    ones = np.zeros(SKETCH, np.int64)
    for at in range(0, len(units), 4096):
        bits = b"".join([hashlib.blake2b(u, digest_size=SKETCH // 8).digest() for u in units[at:at + 4096]])
        ones += np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, SKETCH // 8), axis=1).sum(axis=0, dtype=np.int64)
    signs = (2 * ones - len(units)).astype(np.uint16)
    lanes = np.frombuffer(exact, "<u4").reshape(len(paragraphs), EXACT).sum(axis=0, dtype=np.uint32)
    return Fingerprint(lanes, signs, len(units) & 0xFFFFFFFF)


def add(a: Fingerprint, b: Fingerprint) -> Fingerprint:
    """Of both multisets together."""
    return Fingerprint(a.exact + b.exact, a.sketch + b.sketch, (a.units + b.units) & 0xFFFFFFFF)


def remove(a: Fingerprint, b: Fingerprint) -> Fingerprint:
    """Of a without b."""
    return Fingerprint(a.exact - b.exact, a.sketch - b.sketch, (a.units - b.units) & 0xFFFFFFFF)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a.units == b.units and np.array_equal(a.exact, b.exact):
        return 1.0
    total = a.units + b.units
    if not total:
        return 0.0
    unshared = float(np.mean((a.sketch - b.sketch).astype(np.int16).astype(np.float64) ** 2))
    return min(1.0, max(0.0, 1.0 - unshared / total))


def edited(text: str, after: str) -> tuple[str, int]:
    """The text with its last third replaced by as many code points from the
    start of ``after`` (or all), and how many stay."""
    third = len(text) // 3
    keep = len(text) - third
    return text[:keep] + after[:third], keep


def edited_fingerprint(whole: Fingerprint, text: str, after: str) -> tuple[str, Fingerprint]:
    """Without reading the kept paragraphs again: the paragraphs from the cut
    on are taken away, the new ones added."""
    new, keep = edited(text, after)
    start = text.rfind("\n", 0, keep) + 1
    return new, add(remove(whole, fingerprint(text[start:].split("\n"))), fingerprint(new[start:].split("\n")))


_ROW = "id long, text string, n_chars long, edited string, fingerprint string, edited_fingerprint string, " \
       "near_edited double, near_next double"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, id, text) in descending order, a guest after its range."""
    held = None  # the row waiting for its next
    out: list[tuple] = []
    size = 0

    def made(rows):
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("id", "text", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))

    for batch in batches:
        for part, guest, doc, text in zip(*(batch.column(i) for i in range(4))):
            part, guest, doc, text = part.as_py(), guest.as_py(), doc.as_py(), text.as_py() or ""
            own = fingerprint(text.split("\n"))
            if held and held[0] == part:
                _, id_, before, whole = held
                new, changed = edited_fingerprint(whole, before, text)
                out.append((id_, before, len(before), new, whole.hex(), changed.hex(), likeness(whole, changed),
                            likeness(whole, own)))
                size += len(before) + len(new)
            held = None if guest else (part, doc, text, own)
            if len(out) >= 500 or size > 4 << 20:
                yield made(out)
                out, size = [], 0
    if out:
        yield made(out)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next) of every row; next is the row before it by id, the smallest
    id's next is the largest."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = min(MOST_RANGES, max(LEAST_RANGES, text_bytes(docs, text_col) // RANGE_BYTES))
    cuts = sorted(set(rows.stat.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n))) or [0.0]
    # Ranges are numbered from the largest ids on; rows without an id are the last.
    splitter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__id", outputCol="__range", handleInvalid="keep")
    nulls = len(cuts) + 1
    part = F.when(F.col("id").isNull(), F.lit(nulls)).otherwise(F.lit(nulls - 1) - F.col("__range"))
    ranged = splitter.transform(rows.withColumn("__id", F.col("id").cast("double"))).select(
        part.cast("int").alias("part"), "id", "text",
        F.coalesce("id", F.lit(_NO_ID)).alias("known"), F.xxhash64("text").alias("h"))
    # The first row of a range (one for each, MOST_RANGES at most) follows the range before.
    firsts = sorted((r["part"], r["top"]["known"], r["top"]["h"]) for r in
                    ranged.groupBy("part").agg(F.max(F.struct("known", "h")).alias("top")).collect())
    serves = spark.createDataFrame([(known, h, firsts[i - 1][0]) for i, (_, known, h) in enumerate(firsts)],
                                   "known long, h long, before int")
    copies = F.array_compact(F.array(
        F.struct("part", F.lit(0).alias("guest")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest")))))
    dealt = ranged.join(F.broadcast(serves), ["known", "h"], "left").select("id", "text", "h", F.explode(copies).alias("at"))
    ordered = dealt.select("at.part", "at.guest", "id", "text", "h").repartitionById(nulls + 1, F.col("part")) \
        .sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), F.desc("h"))
    return ordered.mapInArrow(_stream, _ROW)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_chars",
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next")
