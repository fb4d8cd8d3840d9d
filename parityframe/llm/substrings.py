"""Substring dedup (operator 7): seed and extend on winnowed anchors.

A repeat is a run of ``length`` or more consecutive words that also occurs in
a document with a smaller id. The later copy loses the words.

Method
------
1. *Seeds.* Each text is winnowed: of every ``length - k + 1`` consecutive
   k-word grams the smallest hash is an anchor. Every run of ``length`` words
   holds the same anchor wherever it occurs.
2. *Join.* The distinct anchors of a block of texts go, packed as bytes, to
   buckets of anchor hashes; a bucket tells each block which of its anchors
   other blocks have too (one bit per anchor). A passage that a third of all
   documents share is one entry per block, not one per document.
3. *Extend.* From each shared anchor the match is extended to every run of
   ``length`` words around it that belongs to that anchor; these runs, by
   128-bit hash with the smallest id of the block, are resolved by the same
   routing: one bit says whether a smaller id elsewhere has the run.
4. Overlapping runs merge into maximal repeats, whose words are cut.

All three steps read the same exchange of the texts, so texts are shuffled
once; there are no pairs of documents, no hot keys and nothing on the driver
but one byte count. All steps are functions of the block's rows in any order,
so lost tasks can be run again.

Defined results: a null text has no words; a null id counts as larger than
every id; rows that share an id are one document (its runs don't remove each
other); other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityframe.llm import wordhash as wh
from parityframe.llm.common import (BITS, PACKED, PACKED_ARROW, bit_rows, block_count, bucket_cuts, from_planes,
                                    packed_hashes, planes, read_bits, read_table, shared_hashes, text_blocks, text_bytes)

NO_ID = np.iinfo(np.int64).max
_IS_WORD = wh.word_table(wh.SPACES)
_LANE_A = wh.lane(11, wh.SPACES, lower=False)
_LANE_B = wh.lane(12, wh.SPACES, lower=False)


class _Slice:
    """Words, anchors and runs of one slice of a block's texts."""

    def __init__(self, ids, data, offsets, length, k, runs):
        self.data, self.offsets = data, offsets
        self.words = wh.find_words(data, offsets, _IS_WORD)
        h = wh.word_hashes(self.words, _LANE_A)
        self.n = len(h)
        left = wh.room(self.words.first, self.n)
        self.grams = wh.gram_hashes(h, k)
        self.run_start, self.run_anchor = _runs(self.grams, left, length, k)
        if runs:
            self.run_a = wh.gram_hashes(h, length)[self.run_start]
            self.run_b = wh.gram_hashes(wh.word_hashes(self.words, _LANE_B), length)[self.run_start]
            self.run_id = np.repeat(ids, np.diff(self.words.first))[self.run_start]


def _runs(grams, left, length, k):
    """Start of every run of ``length`` words and the place of its anchor
    (smallest gram hash, the last of equals)."""
    window = length - k + 1
    n = len(grams) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = grams[:n].copy()
    place = np.zeros(n, dtype=np.int64)
    for d in range(1, window):
        other = grams[d:d + n]
        smaller = other <= best
        np.copyto(best, other, where=smaller)
        place[smaller] = d
    start = np.flatnonzero(left[:n] >= length)
    return start, start + place[start]


def _slices(table: pa.Table, length: int, k: int, runs: bool) -> list[_Slice]:
    ids = table.column("id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return [_Slice(ids[a:b], data, offsets, length, k, runs)
            for a, b, data, offsets in wh.text_slices(table.column("text"))]


def _block_anchors(slices):
    """Distinct anchor hashes of the block, sorted."""
    if not slices:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate([s.grams[np.unique(s.run_anchor)] for s in slices]))


def _anchor_rows(length, k, n_buckets):
    def run(table: pa.Table) -> pa.Table:
        anchors = _block_anchors(_slices(table, length, k, runs=False))
        return packed_hashes(table.column("block")[0].as_py(), anchors, n_buckets)
    return run


class _Candidates:
    """The runs of a block whose anchor is shared, and their distinct hashes
    with the smallest id in the block. ``group`` maps runs to the latter."""

    def __init__(self, slices, bits, n_buckets):
        anchors = _block_anchors(slices)
        shared = read_bits(bits, 0, anchors, n_buckets)
        # Within a block an anchor of two texts is shared as well; keeping all
        # anchors that occur twice covers that.
        places = [np.unique(s.run_anchor) for s in slices]
        if slices:
            index, counts = np.unique(np.concatenate(
                [np.searchsorted(anchors, s.grams[p]) for s, p in zip(slices, places)]), return_counts=True)
            shared[index[counts > 1]] = True
        self.picked = [shared[np.searchsorted(anchors, s.grams[s.run_anchor])] for s in slices]
        a = np.concatenate([s.run_a[p] for s, p in zip(slices, self.picked)] or [np.zeros(0, np.uint64)])
        b = np.concatenate([s.run_b[p] for s, p in zip(slices, self.picked)] or [np.zeros(0, np.uint64)])
        ids = np.concatenate([s.run_id[p] for s, p in zip(slices, self.picked)] or [np.zeros(0, np.int64)])
        order = np.lexsort((ids, b, a))
        a, b, sorted_ids = a[order], b[order], ids[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        self.group = np.empty(len(a), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.ids = ids
        self.a, self.b, self.least = a[first], b[first], sorted_ids[first]


def _run_rows(length, k, n_buckets):
    def run(texts: pa.Table, bits: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return PACKED_ARROW.empty_table()
        c = _Candidates(_slices(texts, length, k, runs=True), bits, n_buckets)
        buckets, cuts = bucket_cuts(c.a, n_buckets)
        rows = [planes(c.a[i:j]) + planes(c.b[i:j]) + planes(c.least[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
        return pa.table([pa.array([texts.column("block")[0].as_py()] * len(rows), pa.int32()), pa.array(buckets),
                         pa.array(rows, pa.binary())], schema=PACKED_ARROW)
    return run


def _smaller_elsewhere(table: pa.Table) -> pa.Table:
    """One bucket: for every block a bit per run, set if another block has the
    run under a smaller id."""
    a, b, ids = [], [], []
    for blob in table.column("packed").to_pylist():
        third = len(blob) // 3
        a.append(from_planes(blob[:third], np.uint64))
        b.append(from_planes(blob[third:2 * third], np.uint64))
        ids.append(from_planes(blob[2 * third:], np.int64))
    lengths = [len(x) for x in a]
    a, b, ids = np.concatenate(a), np.concatenate(b), np.concatenate(ids)
    order = np.lexsort((ids, b, a))
    a, b, s = a[order], b[order], ids[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    smaller = np.empty(len(a), dtype=bool)
    smaller[order] = s[first][np.cumsum(new) - 1] < s
    return bit_rows(table, 1, smaller, lengths)


_KEPT = "id long, n_words long, n_removed long, kept_text string"


def _cut_rows(length, k, n_buckets):
    def run(texts: pa.Table, bits: pa.Table) -> pa.Table:
        slices = _slices(texts, length, k, runs=True) if texts.num_rows else []
        c = _Candidates(slices, bits, n_buckets)
        elsewhere = read_bits(bits, 1, c.a, n_buckets)
        remove = (c.least[c.group] < c.ids) | elsewhere[c.group]
        at, words, removed, kept = 0, [], [], []
        for s, picked in zip(slices, c.picked):
            starts = s.run_start[picked][remove[at:at + int(picked.sum())]]
            at += int(picked.sum())
            cover = np.zeros(s.n + 1, dtype=np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
            gone = np.cumsum(cover)[:-1] > 0
            words.append(np.diff(s.words.first))
            total = np.r_[0, np.cumsum(gone)]
            removed.append(np.diff(total[s.words.first]))
            kept.append(_join_kept(s, ~gone))
        return pa.table([texts.column("id").combine_chunks() if texts.num_rows else pa.array([], pa.int64()),
                         pa.array(np.concatenate(words or [np.zeros(0, np.int64)]), pa.int64()),
                         pa.array(np.concatenate(removed or [np.zeros(0, np.int64)]), pa.int64()),
                         pa.chunked_array(kept or [pa.array([], pa.string())], type=pa.string())],
                        names=["id", "n_words", "n_removed", "kept_text"])
    return run


def _join_kept(s: _Slice, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, one space between them."""
    w = s.words
    edge = np.zeros(len(s.data) + 1, dtype=np.int32)
    edge[w.starts[keep]] += 1
    edge[w.ends[keep]] -= 1
    out = np.cumsum(edge)[:-1] > 0
    kept_before = np.r_[0, np.cumsum(keep)]
    kept_in_text = np.repeat(kept_before[w.first[1:]], np.diff(w.first))
    blank = w.ends[keep & (kept_before[1:] < kept_in_text)]
    data = s.data.copy()
    data[blank] = 0x20
    out[blank] = True
    offsets = np.r_[0, np.cumsum(out)][s.offsets]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[out])])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 13, k: int = 5) -> DataFrame:
    """(id, n_words, n_removed, kept_text) per row of ``docs``: words in runs
    of at least ``length`` words that a smaller id has too are removed."""
    n = block_count(text_bytes(docs, text_col))
    texts = text_blocks(docs, id_col, text_col, n).groupBy("block")
    anchors = texts.applyInArrow(_anchor_rows(length, k, n), PACKED)
    shared = anchors.groupBy("bucket").applyInArrow(shared_hashes, BITS)
    runs = texts.cogroup(shared.groupBy("block")).applyInArrow(_run_rows(length, k, n), PACKED)
    smaller = runs.groupBy("bucket").applyInArrow(_smaller_elsewhere, BITS)
    return texts.cogroup(shared.unionByName(smaller).groupBy("block")).applyInArrow(_cut_rows(length, k, n), _KEPT)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM w WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS first FROM runs GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS spot
  FROM runs JOIN firsts USING (k) WHERE first < doc_id),
words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS spot FROM w WHERE len(w) > 0),
kept AS (
  SELECT doc_id, count(gone.spot) AS n_removed,
         string_agg(word, ' ' ORDER BY words.spot) FILTER (gone.spot IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, spot) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
