"""Toxicity (operator 6): non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are learned from; examples
marked harmless are treated as unlabelled. With the class prior p of toxic
text, the risk of a scorer z is estimated as

    p * mean_P loss(z) + max(0, mean_U loss(-z) - p * mean_P loss(-z))

(P the toxic, U the unlabelled examples, logistic loss): the last two terms
are what U would cost without its toxic share, which can't be below zero.
Where a step takes it below, the step unlearns that part instead.

Features are words (lower-cased A-Z) and their first four and five code
points, hashed to 2**20 places; present or not, so that length counts for
little. Beginnings that two and that three words of the text share are features of
their own: one word of a stem proves less than several. Kept are the ``n_features`` places that tell P from U best and occur
in ``least_positives`` toxic examples, by counts over all documents and the
toxic examples. A place must be so frequent in P that chance would bring none of
all the places tried there but with probability ``most_chance`` (the Chernoff bound of
the binomial tail, times the places): a word of a few documents that happen to be in
P is no evidence. Featurising and scoring run in Arrow tasks without an object
per word; fitting is full-batch Adam in numpy on the driver, on samples of
about ``max_positives`` and ``max_unlabelled`` rows and on the kept places
alone. Rows are drawn by a hash of id and text; of repeated rows as many as
their share gives, as one row with a weight, so that no id can make a sample
larger. Only the toxic ids themselves are drawn by a hash of the id, where
there are more than ``max_positives``.

Defined results: null and empty texts have no features and get the bias's
score; rows with a null id are scored and never learned from; with fewer
toxic examples than ``least_positives`` (5), or without a place that tells
them apart, nothing is fitted: every score is 0 and nothing is predicted
toxic; repeated rows count each. Columns of the input named like the added
ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityframe.llm import wordhash as wh
from parityframe.llm.common import read_table, ship, stored

PLACES = 1 << 20
_SEPARATORS = tuple(b for b in range(0x80) if not chr(b).isalnum())
_IS_WORD = wh.word_table(_SEPARATORS)
_LANE = wh.lane(61, _SEPARATORS, lower=True)
#: Code points of the word beginnings that are features, and how often they must
#: occur for a further one.
BEGINNINGS = (4, 5)
REPEATS = (2, 3)


class PuClassifier(NamedTuple):
    """Weights of the kept places, and the bias."""
    places: np.ndarray
    weights: np.ndarray
    bias: float


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed place) of every word, word beginning and repeated one."""
    w = wh.find_words(data, offsets, _IS_WORD)
    n = len(data)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LANE.table[data] * wh.powers(_LANE.base, n), out=sums[1:])
    unshift = wh.powers(_LANE.inverse, n)[w.starts]
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    lead = np.searchsorted(leads, w.starts)
    leads = np.append(leads, np.full(max(BEGINNINGS), n))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    found = []
    for kind, size in enumerate((0, *BEGINNINGS)):
        ends = np.minimum(leads[lead + size], w.ends) if size else w.ends
        h = wh.mix((sums[ends] - sums[w.starts]) * unshift + np.uint64(kind))
        found.append((h >> np.uint64(44)).astype(np.int64))
    begun = np.concatenate([text * PLACES + f for f in found[1:]])
    key, times = np.unique(begun, return_counts=True)
    texts, places = [np.tile(text, len(found))], found
    for least in REPEATS:
        often = key[times >= least]
        texts.append(often // PLACES)
        h = wh.mix((often % PLACES).astype(np.uint64) + np.uint64(least << 20))
        places.append((h >> np.uint64(44)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(places)


def _pairs(texts: np.ndarray, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, column)."""
    key = np.unique(texts * width + columns)
    return key // width, key % width


def _count_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per place: unlabelled ones and toxic ones; all texts as place -1."""
    counts = np.zeros((2, PLACES), dtype=np.int64)
    texts = np.zeros(2, dtype=np.int64)
    for batch in batches:
        toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
        texts += np.bincount(toxic, minlength=2)
        for a, b, data, offsets in wh.text_slices(batch.column(0)):
            text, place = _pairs(*_features(data, offsets), PLACES)
            for side in (0, 1):
                counts[side] += np.bincount(place[toxic[a:b][text] == side], minlength=PLACES)
    yield pa.record_batch([pa.array([-1]), pa.array(texts[:1]), pa.array(texts[1:])], names=["place", "u", "p"])
    place = np.flatnonzero(counts.sum(axis=0))
    for at in range(0, len(place), 1 << 16):
        p = place[at:at + (1 << 16)]
        yield pa.record_batch([pa.array(p), pa.array(counts[0][p]), pa.array(counts[1][p])], names=["place", "u", "p"])


def _kept_columns(places: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in wh.text_slices(batch.column(0)):
                text, column = _kept(_features(data, offsets), places)
                lists = np.split(column, np.searchsorted(text, np.arange(1, b - a)))
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(lists, pa.list_(pa.int32()))],
                                      names=["toxic", "drawn", "row", "columns"])
    return run


def _kept(features, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, column) for the kept places; column numbers them."""
    text, place = features
    column_of = np.full(PLACES, -1, dtype=np.int16 if len(places) < 1 << 15 else np.int32)
    column_of[places] = np.arange(len(places))
    column = column_of[place]
    hit = column >= 0
    return _pairs(text[hit], column[hit].astype(np.int64), max(1, len(places)))


def nnpu_fit(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, n_columns: int, prior: float,
             steps: int = 400, rate: float = 0.05, l2: float = 1e-4, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk. (rows, columns) are the ones of a 0/1
    matrix, ``toxic`` marks the rows of P; the other rows are U. A row counts
    ``times`` (once by default)."""
    times = np.ones(len(toxic)) if times is None else times
    share_p, share_u = times[toxic] / times[toxic].sum(), times[~toxic] / times[~toxic].sum()
    w = np.zeros(n_columns + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, weights=w[columns], minlength=len(toxic))
        up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # slope of loss(-z); of loss(z) it is up - 1
        loss_minus = np.logaddexp(0, z)
        rest = share_u @ loss_minus[~toxic] - prior * (share_p @ loss_minus[toxic])
        slope = np.empty_like(z)
        if rest >= 0:
            slope[toxic] = prior * (up[toxic] - 1 - up[toxic]) * share_p
            slope[~toxic] = up[~toxic] * share_u
        else:
            slope[toxic] = prior * up[toxic] * share_p
            slope[~toxic] = -up[~toxic] * share_u
        grad = np.append(np.bincount(columns, weights=slope[rows], minlength=n_columns), slope.sum())
        grad[:-1] += l2 * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad ** 2
        w -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def _sampled(docs: DataFrame, id_col: str, n: int, bound: int) -> DataFrame:
    if n <= bound:
        return docs
    return docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def _drawn(texts: DataFrame, id_col: str, bound: int) -> DataFrame:
    """(text, drawn, row) of about ``bound`` rows, all if there are no more:
    ``drawn`` of the equal rows whose hash of id and text is ``row``. Each group
    of n equal rows gets n * bound / all, rounded up or down by its hash. Only
    hashes are shuffled, and the drawn texts."""
    row = F.xxhash64(id_col, "text").alias("row")
    counts = stored(texts.groupBy(row).agg(F.count("*").alias("n")), "row-counts")
    share = min(1.0, bound / max(1, counts.agg(F.sum("n")).first()[0] or 0))
    chance = F.pmod(F.xxhash64(F.col("row"), F.lit("drawn")), F.lit(1 << 30)) / (1 << 30)
    drawn = counts.select("row", F.floor(F.col("n") * share + chance).alias("drawn")).filter("drawn > 0")
    # At most about ``bound`` hashes.
    return texts.select(row, "text").join(F.broadcast(drawn), "row").dropDuplicates(["row"]).select("text", "drawn", "row")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", max_positives: int = 20_000, max_unlabelled: int = 30_000,
                 n_features: int = 2048, least_positives: int = 5, least_sigmas: float = 4.5,
                 most_chance: float = 0.01) -> PuClassifier:
    """Fit on the toxic rows of ``labels`` (id, 0/1) and on the other rows of
    ``docs``; the prior is the toxic share of ``labels``."""
    ship(docs.sparkSession)
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__toxic"))
    share = marks.agg(F.avg((F.col("__toxic") == 1).cast("double")), F.sum((F.col("__toxic") == 1).cast("long"))).first()
    nothing = PuClassifier(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    if not share[1]:
        return nothing
    prior = float(np.clip(share[0], 1e-4, 1 - 1e-4))
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text"))
    # At most about max_positives ids, so that the texts need not be shuffled.
    confirmed = _sampled(marks.filter("__toxic = 1"), id_col, share[1], max_positives).select(id_col)
    positives = texts.join(F.broadcast(confirmed), id_col, "left_semi")
    # All texts are the unlabelled ones: their toxic share is what the prior is for.
    everything = positives.select("text", F.lit(1).alias("toxic")).unionByName(texts.select("text", F.lit(0).alias("toxic")))
    counted = stored(everything.mapInArrow(_count_places, "place long, u long, p long").groupBy("place").agg(
        F.sum("u").alias("u"), F.sum("p").alias("p")), "feature-counts")
    sizes = counted.filter("place = -1").first()
    if not sizes or not sizes["p"] or not sizes["u"]:
        return nothing
    share_p = (F.col("p") + 0.5) / (sizes["p"] + 1.0)
    share_u = (F.col("u") + 0.5) / (sizes["u"] + 1.0)
    sigmas = (share_p - share_u) / F.sqrt(share_u * (1 - share_u) / sizes["p"])
    tried = counted.filter((F.col("place") >= 0) & (F.col("p") >= least_positives) & (F.col("u") < sizes["u"]))
    # -log of the bound on the chance of p of P's texts where all have the share u.
    p, q = F.col("p") / sizes["p"], F.col("u") / sizes["u"]
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    unlikely = F.when(p > q, sizes["p"] * (p * F.log(p / q) + rest)).otherwise(0.0)
    best = tried.filter((sigmas >= least_sigmas) & (unlikely >= float(np.log(max(1, tried.count()) / most_chance)))) \
        .orderBy((share_p * F.log(share_p / share_u)).desc(), "place").limit(n_features).select("place").collect()
    places = np.sort(np.array([r[0] for r in best], dtype=np.int64))
    if not len(places):
        return nothing
    sample = _drawn(positives, id_col, max_positives).select("text", F.lit(1).alias("toxic"), "drawn", "row").unionByName(
        _drawn(texts, id_col, max_unlabelled).select("text", F.lit(0).alias("toxic"), "drawn", "row"))
    lists = sample.mapInArrow(_kept_columns(places), "toxic int, drawn long, row long, columns array<int>").toArrow() \
        .sort_by([("toxic", "descending"), ("row", "ascending")])  # sums in one order, whatever the tasks'
    toxic = lists.column("toxic").to_numpy().astype(bool)
    columns = lists.column("columns").combine_chunks()
    lengths = np.diff(columns.offsets.to_numpy())
    weights, bias = nnpu_fit(np.repeat(np.arange(len(toxic)), lengths), columns.flatten().to_numpy().astype(np.int64),
                             toxic, len(places), prior, times=lists.column("drawn").to_numpy().astype(float))
    return PuClassifier(places, weights, bias)


def score_toxicity(docs: DataFrame, classifier: PuClassifier, text_col: str = "text") -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 from 0.5 on)."""
    ship(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]
                          + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a, b, data, offsets in wh.text_slices(batch.column(text_col)):
                z = np.full(b - a, classifier.bias)
                if len(classifier.places):
                    text, column = _kept(_features(data, offsets), classifier.places)
                    z += np.bincount(text, weights=classifier.weights[column], minlength=b - a)
                scores.append(1 / (1 + np.exp(-np.clip(z, -700, 700))) * np.isfinite(z))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                  names=schema.names)
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with score and predicted, learned from the labels in ``sf_dir``."""
    labels = read_table(docs.sparkSession, sf_dir, "labels").filter(~held_out())
    return score_toxicity(docs, fit_toxicity(docs, labels))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, sf_dir).select("doc_id", held_out().alias("held_out"), "score", "predicted")
