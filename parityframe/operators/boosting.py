"""Boosted trees, many fits at a time (N2, N3 and what searches over them).

Second-order gradient boosting of the log loss over binned features: leaves are
``-G / (H + l2)``, splits maximise the usual gain, rows are drawn anew each round.
A *set* of fits (folds x depths x rates, feature subsets, growing samples) advances
together: one job for each level of each round serves all of them, so that a search
reads the table as often as a single fit does, and the jobs do not multiply.

* Rows are blocks of bin codes, stored once in the shared folder. What a task must keep
  between jobs (:class:`Kept`: codes, the fits' running margins, whose rows are in which
  node) are files in its executor's own scratch folder; tasks go to where they are. A task that does
  not find them says so, and they are made again from the block and the trees so far,
  ``CHECKPOINT_ROUNDS`` trees at a time, so a lost executor costs no other's work.
* A level's job sums gradient histograms (open nodes x features x bins) in the tasks and
  then over the tasks by ``treeReduce``; the driver, which holds nothing that grows
  with the rows, picks the splits.
* A table whose binned rows take ``SMALL_BYTES`` at most (counted first) is broadcast
  instead, and the fits of the set are dealt to tasks: there the same sums need no
  job. Both ways give the same trees, bit for bit.
* Of two sibling nodes only the one of less hessian is summed; the other is what the
  parent has beyond it, exactly, as the sums are whole numbers.
* The result does not depend on how rows are dealt: bin cuts are exact order
  statistics, a row is drawn by a hash of its key, and gradients are summed as
  whole multiples of 2**-24, in any order the same.
* Each round's log loss and error of training and held-out rows are summed on the way,
  so a history, an early stop and the scores of every shorter fit cost no job more.

Missing values order below every number.
"""

from __future__ import annotations

import fcntl
import functools
import itertools
import math
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parityframe.functions.hashing import hash32
from parityframe.operators.quantile import array_order_statistics
from parityframe.session import ensure_checkpoint_dir, ship

BINS = 32
SCALE = float(1 << 24)
CHECKPOINT_ROUNDS = 25
#: Times that a job is asked again because some task didn't find what it had kept.
MOST_TRIES = 20
#: Rows times fits that a task has at least, rows at most if there are more than cores'
#: worth of such, and rows of a block at most. A task reads one block at a time.
TASK_ROWS, MOST_ROWS, BLOCK_ROWS = 50_000, 1 << 22, 1 << 16
#: Bytes of binned rows up to which a table is broadcast, and of one row beside its codes.
SMALL_BYTES, ROW_BYTES = 64 << 20, 33
EVAL = -1
#: Rows from which on a tree's leaves are read from tables (and are read at a time), the
#: most leaves for it, and the most bins of two features that are read together.
LOOKUP_ROWS, MOST_LEAVES, PAIR_BINS = 1 << 14, 256, 64
#: Rows of a node, for each number that some features' codes make together, from which on
#: these are summed together, and the most such numbers beside two features' codes.
PAIR_ROWS, GROUP_BINS = 4, 1 << 13
#: Rows taken at a time by what a round does: the arrays made on the way stay in a core's
#: cache, and their memory is used again instead of being asked of the system each time.
STEP_ROWS = 1 << 15


# ------------------------------------------------------------------ bins
@dataclass(frozen=True)
class Binning:
    """Ascending cuts of each feature: x is in bin 1 + (cuts below x), missing in 0."""
    cuts: list

    def bins(self) -> int:
        """Codes are below this."""
        return 2 + max((len(c) for c in self.cuts), default=0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape[::-1], np.uint8)
        for f, cuts in enumerate(self.cuts):
            known = ~np.isnan(x[:, f])
            out[f, known] = 1 + np.searchsorted(cuts, x[known, f], "left")
        return out


def fit_binning(df: DataFrame, features: Column, n_features: int, bins: int = BINS) -> Binning:
    """Cuts at the ranks i / bins of every feature, in two counting levels (20 bits of
    a number's mantissa); the highest value needs none."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be between 2 and 255")
    found = array_order_statistics(df, features, n_features, lambda n: [n * i // bins for i in range(1, bins)] + [n - 1], levels=2)
    return Binning([np.array(sorted({*v.values()} - {max(v.values())}) if v else []) for _, v in found])


# ----------------------------------------------------------------- models
@dataclass
class Tree:
    """Nodes in the order they were made: the children of node i are left[i] and
    left[i] + 1; feature -1 is a leaf."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    left: np.ndarray

    @classmethod
    def stump(cls) -> Tree:
        return cls(np.full(1, -1, np.int16), np.zeros(1, np.uint8), np.zeros(1), np.zeros(1), np.zeros(1, np.int32))

    def split(self, at: np.ndarray, feature, cut, gain, left, right) -> np.ndarray:
        """Split the nodes ``at``; returns their children."""
        n = len(self.feature)
        children = n + np.arange(2 * len(at))
        self.feature[at], self.cut[at], self.gain[at], self.left[at] = feature, cut, gain, children[::2]
        new = Tree.stump()
        for name in ("feature", "cut", "gain", "left"):
            setattr(self, name, np.r_[getattr(self, name), np.repeat(getattr(new, name), len(children))])
        self.value = np.r_[self.value, np.column_stack([left, right]).ravel()]
        return children

    def descend(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Where each row (a column of ``codes``) comes from its node: a leaf. A row that
        is in one stays, as no code exceeds 255."""
        inner = self.feature >= 0
        flat, rows = codes.ravel(), np.arange(codes.shape[1])
        base = np.where(inner, self.feature, 0).astype(np.int64) * codes.shape[1]
        cut = np.where(inner, self.cut, 255).astype(np.uint8)
        left = np.where(inner, self.left, np.arange(len(inner)))
        for _ in range(self.height()):
            at = base.take(node)
            at += rows
            node = left.take(node) + (flat.take(at) > cut.take(node))
        return node

    def height(self) -> int:
        """Splits on the longest way to a leaf."""
        levels, at = 0, np.flatnonzero(self.feature[:1] >= 0)
        while len(at):
            levels, at = levels + 1, np.r_[self.left[at], self.left[at] + 1]
            at = at[self.feature[at] >= 0]
        return levels

    def deal(self, codes: np.ndarray, order: np.ndarray, held: dict) -> None:
        """Hand the rows that ``held`` ({node: where its rows are in ``order``}) has in inner
        nodes on to the leaves below them: a node's rows are parted where they are."""
        todo = [n for n in held if self.feature[n] >= 0]
        while todo:
            node = todo.pop()
            (start, end), left = held.pop(node), int(self.left[node])
            column, cut, at, right = codes[self.feature[node]], self.cut[node], start, []
            for rows in _steps(order, start, end):
                beyond = column.take(rows) > cut
                right.append(rows.compress(beyond))
                low = rows.compress(~beyond)
                order[at:at + len(low)] = low
                at += len(low)
            held[left], held[left + 1] = (start, at), (at, end)
            for high in right:
                order[at:at + len(high)] = high
                at += len(high)
            todo += [n for n in (left, left + 1) if self.feature[n] >= 0]

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        return self.descend(codes, np.zeros(codes.shape[1], np.int64))

    def passable(self, n_features: int, bins: int) -> tuple:
        """The leaves from left to right and, by 64 leaves, feature and code, a bit for each
        leaf that the code does not rule out: of those that no feature rules out the
        first is the row's."""
        first, todo, leaves, inner = {}, [0], [], []
        while todo:
            node = todo.pop()
            first[node] = len(leaves)
            if self.feature[node] < 0:
                leaves.append(node)
            else:
                inner.append(node)
                todo += [int(self.left[node]) + 1, int(self.left[node])]
        words = -(-len(leaves) // 64)
        open_ = np.full((words, n_features, bins), np.uint64((1 << 64) - 1))
        for node in inner:
            left = int(self.left[node])
            out = (1 << first[left + 1]) - (1 << first[left])
            for word in range(first[left] // 64, (first[left + 1] - 1) // 64 + 1):
                open_[word, self.feature[node], int(self.cut[node]) + 1:] &= np.uint64(~(out >> 64 * word) & (1 << 64) - 1)
        return np.array(leaves), open_


class Lookup:
    """Leaves of many trees for the same codes: each pair of features is one number, by
    which a tree's :meth:`Tree.passable` is read."""

    def __init__(self, codes: np.ndarray, bins: int):
        self.codes, self.bins, n = codes, bins, len(codes)
        size = 2 if bins <= PAIR_BINS else 1
        self.groups = [range(a, min(a + size, n)) for a in range(0, n, size)]

    @functools.cached_property
    def keys(self) -> list:
        return [self.codes[g[0]].astype(np.uint16) * np.uint16(self.bins) + self.codes[g[1]] if len(g) == 2 else self.codes[g[0]]
                for g in self.groups]

    def tables(self, tree: Tree) -> tuple | None:
        """What :meth:`leaf_of` reads of a tree; None for one of very many leaves."""
        if (tree.feature < 0).sum() > MOST_LEAVES:
            return None
        leaves, open_ = tree.passable(len(self.codes), self.bins)
        return leaves, [[word[g[0]] if len(g) == 1 else (word[g[0]][:, None] & word[g[1]]).ravel() for g in self.groups] for word in open_]

    def leaf_of(self, tree: Tree, tables: tuple | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, or of ``rows`` alone."""
        n = self.codes.shape[1] if rows is None else len(rows)

        def some(a, at, size):
            return a[..., at:at + size] if rows is None else a.take(rows[at:at + size], axis=-1)
        if tables is None and (n < LOOKUP_ROWS or (tables := self.tables(tree)) is None):
            return np.concatenate([tree.leaf_of(some(self.codes, at, STEP_ROWS)) for at in range(0, max(n, 1), STEP_ROWS)])
        leaves, words = tables
        leaf = np.empty(n, np.int64)
        for at in range(0, n, LOOKUP_ROWS):
            keys = [some(k, at, LOOKUP_ROWS).astype(np.intp) for k in self.keys]
            place = None
            for number, word in reversed([*enumerate(words)]):
                left = word[0].take(keys[0])
                for table, key in zip(word[1:], keys[1:]):
                    left &= table.take(key)
                here = np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)).astype(np.intp) + 64 * number
                place = here if place is None else np.where(left != 0, here, place)
            leaf[at:at + LOOKUP_ROWS] = leaves.take(place)
        return leaf


class StagedTree:
    """One tree as a transformer: ``prediction`` is half its log-odds step, so that
    sigmoid(2 * weighted sum) is the model's probability."""

    def __init__(self, model: BoostedModel, tree: Tree):
        self.model, self.tree = model, tree

    def transform(self, df: DataFrame) -> DataFrame:
        step = _scorer(replace(self.model, list_of_trees=[self.tree], rate=1.0))
        return df.withColumn("prediction", step(vector_to_array(self.model.features_col)) / 2)


@dataclass
class BoostedModel:
    binning: Binning
    list_of_trees: list
    rate: float
    features_col: str = "features"
    n_features: int = 0
    history: list = field(default_factory=list)     # (round, split, logloss, error, n)
    best_round: int | None = None
    stopped: bool = False
    rounds: int = 0
    total_gain: np.ndarray | None = None            # of fits whose trees were not kept

    def margins(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """Log-odds after each tree."""
        total, rows = np.zeros(codes.shape[1]), Lookup(codes, self.binning.bins())
        for tree in self.list_of_trees:
            total = total + self.rate * tree.value[rows.leaf_of(tree)]
            yield total

    def first(self, rounds: int) -> BoostedModel:
        """The fit of that many rounds: a prefix of this one."""
        if rounds >= self.rounds:
            return self
        return replace(self, list_of_trees=self.list_of_trees[:rounds], history=[h for h in self.history if h[0] <= rounds],
                       rounds=rounds, total_gain=None)

    @property
    def trees(self) -> list:
        return [StagedTree(self, t) for t in self.list_of_trees]

    @property
    def treeWeights(self) -> list:
        return [self.rate] * len(self.list_of_trees)

    @property
    def featureImportances(self) -> DenseVector:
        """Total gain of each feature, as shares."""
        total = gains(self.list_of_trees, self.n_features) if self.total_gain is None else self.total_gain
        return DenseVector(total / total.sum() if total.sum() else total)

    def split_counts(self) -> list[int]:
        counts = np.zeros(self.n_features, int)
        for t in self.list_of_trees:
            np.add.at(counts, t.feature[t.feature >= 0], 1)
        return counts.tolist()

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (vector) and ``prediction``."""
        margin = _scorer(self)(vector_to_array(self.features_col))
        p = 1 / (1 + F.exp(-F.col("__margin")))
        out = df.withColumn("__margin", margin)
        return out.withColumns({"probability": array_to_vector(F.array(1 - p, p)),
                                "prediction": (F.col("__margin") > 0).cast("double")}).drop("__margin")


def gains(trees: Sequence[Tree], n_features: int) -> np.ndarray:
    total = np.zeros(n_features)
    for t in trees:
        inner = t.feature >= 0
        np.add.at(total, t.feature[inner], t.gain[inner])
    return total


def feature_matrix(values, n_features: int) -> np.ndarray:
    """Rows x features of an Arrow list column or a series of arrays."""
    if isinstance(values, pa.Array):
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(values), n_features)
    return np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, n_features))


def _scorer(model: BoostedModel):
    """Pandas UDF from the feature array to the log-odds."""
    @F.pandas_udf("double")
    def margin(features: pd.Series) -> pd.Series:
        codes = model.binning.codes(feature_matrix(features, model.n_features))
        total = np.zeros(codes.shape[1])
        for total in model.margins(codes):
            pass
        return pd.Series(total)
    return margin


# ------------------------------------------------------------------ fits
@dataclass(frozen=True)
class Fit:
    """One fit of a set: trained on the rows of other folds than ``fold`` (None: all
    training rows) whose curve draw is at most ``share``; ``features``: places in
    the vector (None: all)."""
    rounds: int
    depth: int
    rate: float
    subsample: float = 1.0
    fold: int | None = None
    share: float | None = None
    features: tuple | None = None
    patience: int | None = None
    watch: str = "error"
    seed: int = 42
    l2: float = 1.0
    min_hessian: float = 1.0
    #: Rounds whose scores are asked for (None: every one); an early stop needs all.
    at: tuple | None = None

    def cost(self) -> float:
        """What it takes beside other fits of its set, roughly. The dearest are dealt out first, so
        that no long one is left over at the end."""
        return self.rounds * self.depth * (1.0 if self.share is None else self.share)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of draw and seed: a row's own random number for a round."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class Block:
    codes: np.ndarray      # features x rows
    y: np.ndarray
    fold: np.ndarray       # EVAL: never trained on
    draw: np.ndarray       # uint64 hash of the key
    share: np.ndarray
    margins: np.ndarray    # fits x rows

    def trains(self, fit: Fit) -> np.ndarray:
        """Rows that a fit may learn from."""
        rows = self.fold != EVAL
        if fit.fold is not None:
            rows &= self.fold != fit.fold
        if fit.share is not None:
            rows &= self.share <= fit.share
        return rows

    def drawn(self, fit: Fit, number: int, rows: np.ndarray) -> np.ndarray:
        """Those of them that round ``number`` uses."""
        if fit.subsample < 1:
            rows = rows & (_mixed(self.draw, fit.seed * 100_003 + number) < np.uint64(int(fit.subsample * float(1 << 64))))
        return np.flatnonzero(rows)

    def held(self, fit: Fit) -> np.ndarray:
        return self.fold == (EVAL if fit.fold is None else fit.fold)

    def part(self, start: int, end: int) -> Block:
        """A stretch of its rows, not copied."""
        return Block(*(a[..., start:end] for a in (self.codes, self.y, self.fold, self.draw, self.share, self.margins)))

    def at(self, rows: np.ndarray) -> Block:
        """Those rows, in their order; a column that no fit asks for stays empty."""
        return Block(*(a.take(rows, axis=-1) if a.shape[-1] else a for a in (self.codes, self.y, self.fold, self.draw, self.share, self.margins)))


def _near(codes: np.ndarray) -> np.ndarray:
    """The rows by their codes' interleaved bits, highest first: rows of one node then lie
    near each other in memory, whatever its features. Sums are the same in any order."""
    key, free = np.zeros(codes.shape[1], np.uint64), 64
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        for row in codes[:free]:
            key = key << np.uint64(1) | (row >> np.uint8(bit) & np.uint8(1))
        free -= min(free, len(codes))
    return np.argsort(key, kind="stable")


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole multiples of 2**-24; sums below 2**53 of them are exact."""
    out = x * SCALE
    return np.rint(out, out=out)


def _probability(margin: np.ndarray) -> np.ndarray:
    out = np.exp(-margin)
    out += 1.0
    return np.divide(1.0, out, out=out)


def _steps(rows: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
    """The stretch in pieces of ``STEP_ROWS``."""
    return (rows[at:min(at + STEP_ROWS, end)] for at in range(start, end, STEP_ROWS))


class Columns:
    """The codes that a fit may split on, and those of some features in one number: a row
    is then added once for all of them."""

    def __init__(self, codes: np.ndarray, features: tuple | None):
        self.codes = codes
        self.used = codes if features is None else codes[list(features)]
        self.sizes = (self.used.max(axis=1, initial=0).astype(int) + 1).tolist()
        self.made: dict = {}

    def groups(self, most: int) -> list:
        """(places of the features, their codes in one number) of groups that have ``most``
        numbers each, or are one feature; the features of many codes are dealt first."""
        if most not in self.made:
            places: list = []
            for f in sorted(range(len(self.sizes)), key=lambda f: -self.sizes[f]):
                group = next((g for g in places if math.prod(self.sizes[i] for i in [*g, f]) <= most), None)
                if group is None:
                    places.append([f])
                else:
                    group.append(f)
            self.made[most] = [(g, functools.reduce(lambda key, f: key * np.uint16(self.sizes[f]) + self.used[f], g[1:],
                                                    self.used[g[0]].astype(np.uint16))) for g in places]
        return self.made[most]


class RoundRows:
    """What one fit's round reads of a block at every level: the codes and weights of the
    rows drawn, by the node that they are in. ``alone``: the codes are no other fit's too;
    ``columns``: the whole block's, which then are read where they are, not copied."""

    def __init__(self, block: Block, k: int, fit: Fit, number: int, bins: int, alone: bool = True, columns: Columns | None = None):
        self.bins, self.features, self.held, self.order = bins, fit.features, None, None
        n = len(block.y)
        # Of labels 0 and 1 the whole numbers are below 2**25.
        self.weights = [np.empty(n, np.int32 if block.y.dtype == np.uint8 else np.float64) for _ in "gh"]
        found, at = [np.zeros(0, np.int32)], 0
        for start in range(0, n, STEP_ROWS):
            part = block.part(start, start + STEP_ROWS)
            rows = part.drawn(fit, number, part.trains(fit))
            found.append((rows + start).astype(np.int32))
            here = slice(None) if columns else rows
            p, y = _probability(part.margins[k][here]), part.y[here]
            if columns:
                at = start
            for out, w in zip(self.weights, (p - y, p * (1 - p))):
                out[at:at + len(p)] = _whole(w)
            at += len(p)
        rows = np.concatenate(found)
        if columns:
            self.codes, self.rows, self.order, self.held = columns.codes, None, rows, {0: (0, len(rows))}
            self.columns = columns
        else:
            self.weights = [w[:at].copy() for w in self.weights]
            self.codes, self.rows = (block.codes.take(rows, axis=1), None) if alone else (None, rows)

    def of(self, codes: np.ndarray) -> RoundRows:
        """With the codes of the whole block, where they are not its own."""
        if self.codes is None:
            self.codes = codes.take(self.rows, axis=1)
        return self

    @functools.cached_property
    def columns(self) -> Columns:
        return Columns(self.codes, self.features)

    def deal(self, tree: Tree) -> None:
        if self.held is None:
            self.order = np.arange(self.codes.shape[1], dtype=np.int32)
            self.held = {0: (0, len(self.order))}
        tree.deal(self.codes, self.order, self.held)

    def histogram(self, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        """(nodes x features x bins x 2) sums of gradient and hessian."""
        self.deal(tree)
        used, sizes, bins = self.columns.used, self.columns.sizes, self.bins
        n = len(used)
        places = np.arange(0, n * bins, bins)[:, None]
        out = np.zeros((len(nodes), n, bins, 2))
        for node, found in zip(nodes.tolist(), out):
            start, end = self.held[node]
            most = next((m for m in sorted((GROUP_BINS, bins * bins), reverse=True) if end - start >= PAIR_ROWS * m), None)
            groups = [] if most is None else self.columns.groups(most)
            sums = [np.zeros(math.prod(sizes[f] for f in g), np.complex128) for g, _ in groups]
            for rows in _steps(self.order, start, end):
                rows = rows.astype(np.intp)
                if most is None:
                    key = (used.take(rows, axis=1) + places).ravel()
                    for i, w in enumerate(self.weights):
                        found[..., i] += np.bincount(key, np.tile(w.take(rows).astype(np.float64), n), n * bins).reshape(n, bins)
                    continue
                # Both at once: real and imaginary parts add up on their own.
                both = np.empty(len(rows), np.complex128)
                both.real, both.imag = (w.take(rows) for w in self.weights)
                for total, (_, numbers) in zip(sums, groups):
                    np.add.at(total, numbers.take(rows).astype(np.intp), both)
            for total, (group, _) in zip(sums, groups):
                whole = total.reshape([sizes[f] for f in group])
                for axis, f in enumerate(group):
                    found[f, :sizes[f]] = whole.sum(axis=tuple(i for i in range(len(group)) if i != axis)).view(np.float64).reshape(-1, 2)
        return out.astype(np.int64)

    def advance(self, tree: Tree, margins: np.ndarray, rate: float, lookup: Lookup) -> None:
        """Add the tree's step to the margins of all rows of the block whose ``columns`` these
        are: those drawn are in their leaves already, the others are looked up."""
        self.deal(tree)
        step, rest = rate * tree.value, np.ones(len(margins), bool)
        for node, (start, end) in self.held.items():
            for rows in _steps(self.order, start, end):
                rows = rows.astype(np.intp)
                margins[rows] += step[node]
                rest[rows] = False
        rest = np.flatnonzero(rest)
        if len(rest):
            margins[rest] += step.take(lookup.leaf_of(tree, rows=rest))


def _scores(block: Block, k: int, fit: Fit) -> np.ndarray:
    """(training, held-out) x (log loss, errors, rows), as whole numbers."""
    out = np.zeros((2, 3), np.int64)
    for start in range(0, len(block.y), STEP_ROWS):
        part = block.part(start, start + STEP_ROWS)
        for i, rows in enumerate(map(np.flatnonzero, (part.trains(fit), part.held(fit)))):
            if not len(rows):
                continue
            m, y = part.margins[k].take(rows), part.y.take(rows)
            signed = np.where(y == 1, -m, m)
            loss = np.maximum(signed, 0) + np.log1p(np.exp(-np.abs(signed)))
            out[i] += int(_whole(loss).sum()), int(((m > 0) != (y == 1)).sum()), len(y)
    return out


def _best_splits(hist: np.ndarray, fit: Fit) -> tuple:
    """Per node: gain, feature place, bin, leaf value of node and children, and whether
    the left child has no more hessian than the right one."""
    g, h = (hist[..., i] / SCALE for i in (0, 1))
    gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    total_g, total_h = gl[:, :1, -1:], hl[:, :1, -1:]
    gr, hr = total_g - gl, total_h - hl
    gain = gl ** 2 / (hl + fit.l2) + gr ** 2 / (hr + fit.l2) - total_g ** 2 / (total_h + fit.l2)
    gain[(hl < fit.min_hessian) | (hr < fit.min_hessian)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    rows = np.arange(len(gain))
    feature, cut = np.divmod(best, hist.shape[2])
    children = [-a[rows, feature, cut] / (b[rows, feature, cut] + fit.l2) for a, b in ((gl, hl), (gr, hr))]
    own = -total_g[:, 0, 0] / (total_h[:, 0, 0] + fit.l2)
    return flat[rows, best], feature, cut, own, children, hl[rows, feature, cut] <= hr[rows, feature, cut]


class _Growing:
    """A fit's state. Of two open children only ``asked``, the one of less hessian, is
    summed over the rows; the other is what its parent has beyond it (whole numbers)."""

    def __init__(self, fit: Fit):
        self.fit, self.trees, self.history, self.total_gain = fit, [], [], None
        self.tree, self.nodes, self.asked, self.halves = None, np.zeros(0, int), np.zeros(0, int), None
        self.best, self.stopped = (np.inf, 0), False
        self.rounds = 0

    def open(self) -> bool:
        return not self.stopped and self.rounds < self.fit.rounds

    def add_tree(self) -> None:
        self.trees.append(self.tree)
        self.rounds += 1

    def without_trees(self, n_features: int) -> _Growing:
        """What a search needs: scores and gains."""
        self.total_gain, self.trees = gains(self.trees, n_features), []
        return self.done()

    def done(self) -> _Growing:
        self.tree = self.halves = None
        return self

    def start(self) -> None:
        self.tree, self.nodes, self.asked, self.halves = Tree.stump(), np.array([0]), np.array([0]), None

    def grow(self, hist: np.ndarray, level: int) -> None:
        """One level, from the sums of the nodes asked for."""
        if self.halves is not None:
            parents, left_asked = self.halves
            whole = np.empty((2 * len(hist), *hist.shape[1:]), hist.dtype)
            whole[::2] = np.where(left_asked[:, None, None, None], hist, parents - hist)
            whole[1::2] = parents - whole[::2]
            hist = whole
        gain, feature, cut, own, (left, right), left_less = _best_splits(hist, self.fit)
        if level == 0:
            self.tree.value[0] = own[0]
        split = gain > 1e-6
        used = np.arange(hist.shape[1]) if self.fit.features is None else np.array(self.fit.features)
        children = self.tree.split(self.nodes[split], used[feature[split]], cut[split], gain[split], left[split], right[split])
        self.nodes = children if level + 1 < self.fit.depth else np.zeros(0, int)
        self.asked = np.where(left_less[split], self.nodes[::2], self.nodes[1::2]) if len(self.nodes) else self.nodes
        self.halves = hist[split], left_less[split]

    def asks_scores(self) -> bool:
        """Of the round just added."""
        return bool(self.fit.patience) or self.fit.at is None or self.rounds in self.fit.at

    def scored(self, sums: np.ndarray) -> None:
        number = self.rounds
        values = {}
        for split, (loss, wrong, n) in zip(("train", "test"), sums.tolist()):
            if n:
                values[split] = {"logloss": loss / SCALE / n, "error": wrong / n}
                self.history.append((number, split, values[split]["logloss"], values[split]["error"], n))
        if self.fit.patience and "test" in values:
            now = values["test"][self.fit.watch]
            if now < self.best[0]:
                self.best = (now, number)
            self.stopped = number - self.best[1] >= self.fit.patience


def _joined(blocks: Sequence[Block], *fits: Fit) -> Block:
    """One block of all rows that the fits learn from or are scored on: going node by node
    takes as many calls for a small block as for a large one."""
    whole = Block(*(np.concatenate([getattr(b, name) for b in blocks], axis=-1)
                    for name in ("codes", "y", "fold", "draw", "share", "margins")))
    asked = np.flatnonzero(functools.reduce(np.logical_or, (whole.trains(f) | whole.held(f) for f in fits)))
    return whole.at(asked[_near(whole.codes.take(asked, axis=1))])


def _blocks(rows: DataFrame, binning: Binning, fits: Sequence[Fit], n_fits: int, margins: bool = True):
    """RDD of blocks of (x, y, fold, draw, share) rows, with the margins of ``n_fits`` if asked
    for. They hold no column that no fit asks for."""
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-n * n_fits // TASK_ROWS), max(cores, -(-n // MOST_ROWS))))
    draws, shares = any(f.subsample < 1 for f in fits), any(f.share is not None for f in fits)

    def made(batches):
        x = np.concatenate([feature_matrix(b.column("x"), len(binning.cuts)) for b in batches])
        y, fold, draw, share = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
                                for c in ("y", "fold", "draw", "share"))
        # Missing folds are NaN and stay as they are.
        short = fold.dtype if fold.dtype.kind == "f" else np.result_type(np.min_scalar_type(fold.min()), np.min_scalar_type(fold.max()), np.int16)
        block = Block(binning.codes(x), y if ((y != 0) & (y != 1)).any() else y.astype(np.uint8), fold.astype(short),
                      draw.view(np.uint64) if draws else draw[:0].view(np.uint64), share if shares else share[:0], np.zeros((n_fits, len(y) if margins else 0)))
        block = block.at(_near(block.codes))
        return pa.record_batch([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    def pack(batches):
        # Blocks are as large as the batches are, joined up to BLOCK_ROWS.
        held: list = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield made(held)
                held = []
        if held:
            yield made(held)
    return rows.repartition(parts).mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def _summed(state, work, parts: int) -> dict:
    """{key: array} of work(block), added over all blocks."""
    def add(a, b):
        for key, value in b.items():
            a[key] = a[key] + value if key in a else value
        return a

    def run(blocks):
        total: dict = {}
        for block in blocks:
            add(total, work(block))
        yield total
    partial = state.mapPartitions(run)
    if parts > 16:
        return partial.treeReduce(add)
    out: dict = {}
    for p in partial.collect():
        add(out, p)
    return out


def _grown_alone(blocks: list[Block], fit: Fit, bins: int) -> _Growing:
    """A whole fit on all rows."""
    g = _Growing(fit)
    kept = [(Columns(block.codes, fit.features), Lookup(block.codes, bins)) for block in blocks]
    while g.open():
        views = [RoundRows(block, 0, fit, g.rounds, bins, columns=columns) for block, (columns, _) in zip(blocks, kept)]
        g.start()
        level = 0
        while len(g.asked):
            g.grow(_added(v.histogram(g.tree, g.asked) for v in views), level)
            level += 1
        for block, view, (_, lookup) in zip(blocks, views, kept):
            view.advance(g.tree, block.margins[0], fit.rate, lookup)
        g.add_tree()
        if g.asks_scores():
            g.scored(_added(_scores(block, 0, fit) for block in blocks))
    return g


def _added(arrays) -> np.ndarray:
    return functools.reduce(np.add, arrays)


def _fit_small(rows: DataFrame, binning: Binning, fits: Sequence[Fit], bins: int, keep_trees: bool) -> list[_Growing]:
    """The set on a broadcast table, one task a fit."""
    n_features = len(binning.cuts)
    sc = rows.sparkSession.sparkContext
    table = sc.broadcast([pickle.dumps(b) for b in _blocks(rows, binning, fits, 1).collect()])

    def run(job):
        blocks = [pickle.loads(b) for b in table.value]
        grown = _grown_alone([_joined(blocks, job[1])], job[1], bins) if blocks else _Growing(job[1])
        return job[0], grown.done() if keep_trees else grown.without_trees(n_features)
    order = sorted(enumerate(fits), key=lambda f: -f[1].cost())
    done = dict(sc.parallelize(order, max(1, len(fits))).map(run).collect())
    table.unpersist()
    return [done[i] for i in range(len(fits))]


def fit_set(rows: DataFrame, binning: Binning, fits: Sequence[Fit], bins: int = BINS, features_col: str = "features",
            small_bytes: int = SMALL_BYTES, keep_trees: bool = True) -> list[BoostedModel]:
    """Fit all of ``fits`` on rows (x array<double>, y, fold, draw, share); see the
    module. ``fold`` -1 marks rows that are only scored. A search that needs scores and
    importances alone drops the trees."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    ship(spark)
    n_features = len(binning.cuts)
    n = rows.count()
    if n * (n_features + ROW_BYTES) <= small_bytes:
        growing = _fit_small(rows, binning, fits, bins + 1, keep_trees)
    else:
        growing = _fit_large(rows, binning, fits, bins + 1)
        growing = growing if keep_trees else [g.without_trees(n_features) for g in growing]
    return [BoostedModel(binning, g.trees, g.fit.rate, features_col, n_features, g.history, g.best[1] if g.fit.patience else None,
                         g.stopped, g.rounds, g.total_gain) for g in growing]


@dataclass(frozen=True)
class Todo:
    """What a job asks of one fit: add the step of ``apply``, score the round, draw the rows
    of round ``begin``, sum ``nodes`` of ``tree``; what is None isn't asked."""
    apply: Tree | None = None
    scores: bool = False
    begin: int | None = None
    tree: Tree | None = None
    nodes: np.ndarray | None = None


class Kept:
    """What the task of one part keeps between the jobs of a set, as files in its executor's
    scratch folder. Jobs are numbered: files are those of job n - 1, or of n if another attempt has
    done it (then its sums are there too), or of no use."""

    def __init__(self, name: str, part: int, fits: Sequence[Fit], bins: int):
        tops = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")
        self.folder = os.path.join(tops[part % len(tops)], f"{name}-{part}")
        self.fits, self.bins = fits, bins

    def __enter__(self) -> Kept:
        os.makedirs(os.path.dirname(self.folder), exist_ok=True)
        self.lock = open(f"{self.folder}.lock", "a")
        fcntl.flock(self.lock, fcntl.LOCK_EX)
        return self

    def __exit__(self, *_) -> None:
        self.lock.close()

    def _path(self, *name) -> str:
        return os.path.join(self.folder, "-".join(map(str, name)))

    def load(self, *name):
        with open(self._path(*name), "rb") as f:
            return pickle.load(f)

    def dump(self, value, *name) -> None:
        """A file that is there is written over, not emptied first, which some systems wait for."""
        at = os.open(self._path(*name), os.O_WRONLY | os.O_CREAT, 0o600)
        with open(at, "wb") as f:
            f.write(pickle.dumps(value))

    @functools.cached_property
    def shapes(self) -> dict:
        """{array: (type, shape)}"""
        return self.load("shapes")

    def array(self, *name) -> np.ndarray:
        dtype, shape = self.shapes[name]
        return np.asarray(np.memmap(self._path(*name), dtype, "r+", shape=shape)) if math.prod(shape) else np.zeros(shape, dtype)

    def save(self, value: np.ndarray, *name) -> None:
        if self.shapes.get(name) == (value.dtype, value.shape):
            self.array(*name)[...] = value
        else:
            value.tofile(self._path(*name))
            self.shapes[name] = value.dtype, value.shape
            self.dump(self.shapes, "shapes")

    def done(self) -> int | None:
        """The last job that the files are of."""
        try:
            return self.load("done")
        except (OSError, EOFError, pickle.UnpicklingError):
            return None

    def drop(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def make(self, blocks: Sequence[Block], trees: dict, rounds: dict, job: int) -> None:
        """The files of job - 1, from the rows, the trees whose steps the margins have by then and
        the rounds that are under way or whose trees are to be added."""
        self.drop()
        os.makedirs(self.folder)
        self.shapes = {}
        whole = _joined(blocks, *self.fits) if blocks else None
        self.dump(0 if whole is None else len(whole.y), "rows")
        if whole is not None:
            for name in ("codes", "y", "fold", "draw", "share"):
                self.save(getattr(whole, name), name)
            lookup = Lookup(whole.codes, self.bins)
            for k, grown in trees.items():
                margins = np.zeros(len(whole.y))
                for at in range(0, len(grown), CHECKPOINT_ROUNDS):
                    for tree in grown[at:at + CHECKPOINT_ROUNDS]:
                        margins += (self.fits[k].rate * tree.value).take(lookup.leaf_of(tree))
                self.save(margins, "margins", k)
            for k, number in rounds.items():
                self.dump(self.begin(k, number, self.block(k)).held, "held", k)
        self.dump(job - 1, "done")

    def block(self, k: int) -> Block:
        return Block(*(self.array(name) for name in ("codes", "y", "fold", "draw", "share")), self.array("margins", k)[None])

    def columns(self, codes: np.ndarray, features: tuple | None) -> Columns:
        return KeptColumns(self, codes, features)

    def begin(self, k: int, number: int, block: Block) -> RoundRows:
        fit = self.fits[k]
        view = RoundRows(block, 0, fit, number, self.bins, columns=self.columns(block.codes, fit.features))
        for name, w in zip("gh", view.weights):
            self.save(w, name, k)
        if ("order", k) not in self.shapes:
            self.save(np.zeros(len(block.y), np.int32), "order", k)
        self.array("order", k)[:len(view.order)] = view.order
        return view

    def view(self, k: int, block: Block) -> RoundRows:
        """The round that is under way."""
        view = RoundRows.__new__(RoundRows)
        view.bins, view.features, view.codes, view.rows = self.bins, self.fits[k].features, block.codes, None
        view.columns = self.columns(block.codes, view.features)
        view.weights, view.order = [self.array(name, k) for name in "gh"], self.array("order", k)
        view.held = self.load("held", k)
        return view

    def run(self, job: int, todos: dict) -> dict | None:
        """The sums that job asks for; None if the files are of no use."""
        done = self.done()
        if done == job:
            return self.load("sums")
        if done != job - 1:
            return None
        self.dump(None, "done")
        out = {}
        if self.load("rows"):
            for k, todo in todos.items():
                self.one(k, todo, out)
        self.dump(out, "sums")
        self.dump(job, "done")
        return out

    def one(self, k: int, todo: Todo, out: dict) -> None:
        fit, block = self.fits[k], self.block(k)
        if todo.apply is not None:
            self.view(k, block).advance(todo.apply, block.margins[0], fit.rate, Lookup(block.codes, self.bins))
        if todo.scores:
            out["scores", k] = _scores(block, 0, fit)
        if todo.nodes is not None:
            view = self.view(k, block) if todo.begin is None else self.begin(k, todo.begin, block)
            out["hist", k] = view.histogram(todo.tree, todo.nodes)
            self.dump(view.held, "held", k)


class KeptColumns(Columns):
    """Columns whose sizes and numbers are made by one job for all."""

    def __init__(self, kept: Kept, codes: np.ndarray, features: tuple | None):
        self.kept, self.name, self.codes, self.made = kept, "all" if features is None else "_".join(map(str, features)), codes, {}
        self.used = codes if features is None else codes[list(features)]
        try:
            self.sizes = kept.load("sizes", self.name)
        except OSError:
            super().__init__(codes, features)
            kept.dump(self.sizes, "sizes", self.name)

    def groups(self, most: int) -> list:
        if most not in self.made:
            name = "groups", self.name, most
            try:
                places = self.kept.load(*name)
            except OSError:
                found = super().groups(most)
                for i, (_, numbers) in enumerate(found):
                    self.kept.save(numbers, *name, i)
                places = [g for g, _ in found]
                self.kept.dump(places, *name)
            self.made[most] = [(g, self.kept.array(*name, i)) for i, g in enumerate(places)]
        return self.made[most]


class Parts:
    """The parts of a set's rows, each kept by the executor that made it, and their jobs."""

    def __init__(self, rows: DataFrame, binning: Binning, fits: Sequence[Fit], bins: int):
        self.fits, self.bins, self.name, self.job = list(fits), bins, f"pf-boost-{uuid.uuid4().hex}", 0
        self.blocks = _blocks(rows, binning, fits, len(fits), margins=False).persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks.checkpoint()
        self.number, self.places = self.blocks.getNumPartitions(), None

    def _make(self, trees: dict, rounds: dict) -> None:
        """Where files are missing, make them; a cached row for each part says where it is."""
        name, fits, bins, job = self.name, self.fits, self.bins, self.job

        def made(part, blocks):
            with Kept(name, part, fits, bins) as kept:
                if kept.done() not in (job - 1, job):
                    kept.make([*blocks], trees, rounds, job)
            yield part
        if self.places is not None:
            self.places.unpersist()
        self.places = self.blocks.mapPartitionsWithIndex(made).persist(StorageLevel.MEMORY_ONLY)
        self.places.count()

    def sums(self, todos: dict, so_far: Callable) -> dict:
        """{("hist" or "scores", fit): sums over all parts} of one job. ``so_far`` gives what
        :meth:`Kept.make` needs."""
        self.job += 1
        name, fits, bins, job = self.name, self.fits, self.bins, self.job

        def work(part):
            with Kept(name, part, fits, bins) as kept:
                found = kept.run(job, todos)
            return {"missing": 1} if found is None else found
        for _ in range(MOST_TRIES):
            if self.places is None:
                self._make(*so_far())
            out = _summed(self.places, work, self.number)
            if "missing" not in out:
                return out
            self._make(*so_far())
        raise RuntimeError("executors were lost faster than their rows could be made again")

    def drop(self) -> None:
        if self.places is not None:
            name, fits, bins = self.name, self.fits, self.bins

            def dropped(part):
                with Kept(name, part, fits, bins) as kept:
                    kept.drop()
                    os.unlink(f"{kept.folder}.lock")
            self.places.foreach(dropped)
            self.places.unpersist()
        self.blocks.unpersist()


def _fit_large(rows: DataFrame, binning: Binning, fits: Sequence[Fit], bins: int) -> list[_Growing]:
    """The set on rows that stay where they are, in step."""
    growing = [_Growing(f) for f in fits]
    parts = Parts(rows, binning, fits, bins)
    fresh: dict = {}
    number = 0
    try:
        while True:
            # A round's first job adds the last one's trees to the margins.
            done = [k for k in fresh if growing[k].asks_scores()]
            asked = {k: g for k, g in enumerate(growing) if g.open()}
            for g in asked.values():
                g.start()
            todos = {k: Todo(fresh.get(k), k in done, number if k in asked else None, *((asked[k].tree, asked[k].asked) if k in asked else ()))
                     for k in {*fresh, *asked}}
            level = 0
            while todos and (level or asked or done):
                def so_far(level=level, todos=todos):
                    # The rows drawn before this job, and the trees that margins have by then.
                    return ({k: g.trees[:-1] if not level and k in fresh else g.trees for k, g in enumerate(growing)},
                            {k: number if level else number - 1 for k in todos if level or k in fresh})
                sums = parts.sums(todos, so_far)
                for k in done if not level else ():
                    growing[k].scored(sums.get(("scores", k), np.zeros((2, 3), np.int64)))
                for k, t in todos.items():
                    if t.nodes is not None:
                        growing[k].grow(sums["hist", k], level)
                level += 1
                todos = {k: Todo(tree=g.tree, nodes=g.asked) for k, g in asked.items() if len(g.asked)}
            # A fit that its history has just stopped drops the tree grown meanwhile.
            fresh = {k: g.tree for k, g in asked.items() if g.open()}
            for k in fresh:
                growing[k].add_tree()
            number += 1
            if not fresh:
                break
    finally:
        parts.drop()
    return growing


# --------------------------------------------------------------- estimator
@dataclass(frozen=True)
class Booster:
    """The estimator behind ``learners.boosted``. ``key_cols`` (or else the feature
    vector) decide by hash which rows a round draws."""
    maxIter: int = 20
    maxDepth: int = 5
    stepSize: float = 0.1
    subsamplingRate: float = 1.0
    seed: int = 42
    labelCol: str = "label"
    featuresCol: str = "features"
    maxBins: int = BINS
    l2: float = 1.0
    minHessian: float = 1.0
    keyCols: tuple | None = None
    #: Rounds whose scores the fit's history is to have (None: every one); see ``Fit.at``.
    scored: tuple | None = None

    def spec(self, **kw) -> Fit:
        return Fit(**{"rounds": self.maxIter, "depth": self.maxDepth, "rate": self.stepSize, "subsample": self.subsamplingRate,
                      "seed": self.seed, "l2": self.l2, "min_hessian": self.minHessian,
                      "at": self.scored, **kw})

    def unscored(self) -> Booster:
        """The same trees without scores of their rounds, but for a search or an early stop."""
        return replace(self, scored=())

    def rows(self, train: DataFrame, validation: DataFrame | None = None, fold_col: str | None = None,
             share: Column | None = None) -> DataFrame:
        """The input of :func:`fit_set`."""
        x = vector_to_array(self.featuresCol)
        draw = F.xxhash64(*(self.keyCols or [x]))

        def shaped(df, fold):
            return df.select(x.alias("x"), F.col(self.labelCol).cast("double").alias("y"), fold.cast("int").alias("fold"),
                             draw.alias("draw"), (F.lit(0.0) if share is None else share).alias("share"))
        rows = shaped(train, F.col(fold_col) if fold_col else F.lit(0))
        return rows if validation is None else rows.unionByName(shaped(validation, F.lit(EVAL)))

    def binning(self, train: DataFrame) -> Binning:
        first = train.select(F.size(vector_to_array(self.featuresCol)).alias("n")).first()
        return fit_binning(train, vector_to_array(self.featuresCol), first["n"] if first else 0, self.maxBins)

    def fit(self, train: DataFrame, validation: DataFrame | None = None, patience: int | None = None,
            metric: str = "error", binning: Binning | None = None) -> BoostedModel:
        """Fit on ``train``; with ``patience`` stop (N11) once ``metric`` on
        ``validation`` has not improved for that many rounds."""
        return fit_set(self.rows(train, validation), binning or self.binning(train),
                       [self.spec(patience=patience, watch=metric)], self.maxBins, self.featuresCol)[0]


def fit_folds(made: Sequence[Booster], train: DataFrame, folds: Sequence[int | None], fold_col: str = "fold",
              shares: Sequence[float | None] = (None,), share: Column | None = None,
              subsets: dict | None = None, binning: Binning | None = None) -> dict:
    """One set of boosters x folds x shares, keyed by (place of the booster, fold,
    share). Boosters that differ in ``maxIter`` alone are prefixes of one fit.
    ``subsets``: {fold: places of the features to use}. The fits have scores and
    importances, no trees; all share the bins of ``train``."""
    longest: dict = {}
    for b in made:
        key = replace(b, maxIter=0)
        longest[key] = max(longest.get(key, 0), b.maxIter)
    jobs = list(itertools.product(longest, folds, shares))
    at = tuple({b.maxIter for b in made})
    fits = [b.spec(rounds=longest[b], fold=f, share=s, features=subsets[f] if subsets else None, at=at) for b, f, s in jobs]
    one = made[0]
    models = fit_set(one.rows(train, fold_col=fold_col, share=share), binning or one.binning(train), fits, one.maxBins,
                     one.featuresCol, keep_trees=False)
    by_job = dict(zip(jobs, models))
    return {(i, f, s): by_job[replace(b, maxIter=0), f, s].first(b.maxIter) for i, b in enumerate(made) for f in folds for s in shares}


def scored_at(model: BoostedModel, split: str) -> float | None:
    """Accuracy of the fit's last round on a split; None without rows."""
    return next((1.0 - error for number, s, _, error, _ in model.history if number == model.rounds and s == split), None)


# ----------------------------------------------------------------- history
def history_table(model: BoostedModel, spark, metrics: Sequence[str] = ("logloss", "error")) -> DataFrame:
    """What the fit summed on its way: (split, round, metric, value)."""
    rows = [(s, n, m, {"logloss": loss, "error": error}[m]) for n, s, loss, error, _ in model.history for m in metrics]
    return spark.createDataFrame(rows, "split string, round int, metric string, value double")


STAGED = "split int, round int, score double, y tinyint"
SUMS = "split int, round int, part int, pos long, neg long, num double, ll double, err double"


def staged_scores(model: BoostedModel, parts: Sequence[DataFrame], label: str, rounds: Sequence[int], block: int) -> DataFrame:
    """(split, round, score, y): log-odds of every row after each wanted round;
    split is the part's place. A task hands on ``block`` rounds at a time."""
    x = vector_to_array(model.features_col)
    whole = None
    for i, df in enumerate(parts):
        one = df.select(F.lit(i).alias("split"), F.col(label).cast("tinyint").alias("y"), x.alias("x"))
        whole = one if whole is None else whole.unionByName(one)
    wanted = set(rounds)
    ship(whole.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes = model.binning.codes(feature_matrix(part.column("x"), model.n_features))
                staged = ((n, m) for n, m in enumerate(model.margins(codes), 1) if n in wanted)
                split, y = part.column("split").to_numpy(), part.column("y").to_numpy()
                while some := list(itertools.islice(staged, block)):
                    yield pa.record_batch([np.tile(split, len(some)), np.repeat(np.array([n for n, _ in some], np.int32), len(y)),
                                           np.concatenate([m for _, m in some]), np.tile(y, len(some))],
                                          names=["split", "round", "score", "y"])
    return whole.mapInArrow(run, STAGED)


#: Rows, and bytes of their codes and labels, up to which a history broadcasts the codes and
#: deals its rounds to tasks; rows of a round's order that are summed at a time.
HISTORY_ROWS, HISTORY_BYTES, HISTORY_STEP = 1 << 24, 128 << 20, 1 << 18


def history_by_rounds(rows: int, n_features: int) -> bool:
    """Whether each task of a history can hold all rows' codes; else scores are shuffled."""
    return rows <= HISTORY_ROWS and rows * (n_features + 1) <= HISTORY_BYTES


def staged_sums_small(model: BoostedModel, parts: Sequence[DataFrame], label: str, rounds: Sequence[int], eps: float) -> DataFrame:
    """SUMS of a table that :func:`history_by_rounds` allows (counted by the caller): each task
    has a stretch of the rounds and sorts all scores of a round itself, so none is shuffled."""
    spark = parts[0].sparkSession
    ship(spark)
    x = vector_to_array(model.features_col)

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                codes = model.binning.codes(feature_matrix(batch.column("x"), model.n_features))
                y = (batch.column("y").to_numpy(zero_copy_only=False) == 1).astype(np.uint8)
                yield pa.record_batch([pa.array([pickle.dumps((codes, y))], pa.binary())], names=["rows"])
    table = spark.sparkContext.broadcast([
        [r["rows"] for r in df.select(F.col(label).cast("tinyint").alias("y"), x.alias("x")).mapInArrow(coded, "rows binary").collect()]
        for df in parts])
    wanted = np.array(sorted({n for n in rounds if n <= model.rounds}), int)
    tasks = max(1, min(len(wanted), spark.sparkContext.defaultParallelism))

    def run(batches):
        found = []
        for task in (i for batch in batches for i in batch.column("id").to_pylist()):
            mine = np.array_split(wanted, tasks)[task].tolist()
            for split, rows in enumerate(table.value):
                if not (rows and mine):
                    continue
                codes, y = (np.concatenate(a, axis=-1) for a in zip(*map(pickle.loads, rows)))
                near = _near(codes)
                codes, y = codes.take(near, axis=1), y.take(near)
                margins, coded = np.zeros(len(y)), Lookup(codes, model.binning.bins())
                for number, tree in enumerate(model.list_of_trees[:mine[-1]], 1):
                    margins += (model.rate * tree.value).take(coded.leaf_of(tree))
                    if number in mine:
                        found.append((split, number, *_round_sums(margins, y, eps)))
        if found:
            split, number, *sums = zip(*found)
            yield pa.record_batch([pa.array(split, pa.int32()), pa.array(number, pa.int32()), pa.array([0] * len(split), pa.int32()),
                                   pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), *(pa.array(v, pa.float64()) for v in sums[2:])],
                                  names=[c.split()[0] for c in SUMS.split(", ")])
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, SUMS)


def _round_sums(margins: np.ndarray, y: np.ndarray, eps: float) -> list:
    """Sums of all scores of a round, stretch by stretch of their order: no other array is as
    long as the table. Equal scores stay in one stretch."""
    order = np.argsort(margins)
    score, label = margins.take(order), y.take(order)
    del order
    sums, start = [0, 0, 0.0, 0.0, 0.0], 0
    while start < len(score):
        end = min(start + HISTORY_STEP, len(score))
        end += int(np.searchsorted(score[end:], score[end - 1], "right"))
        some, pos = score[start:end], label[start:end].astype(np.int64)
        new = np.flatnonzero(np.r_[True, np.diff(some) != 0])
        run = _run_sums(0, 0, some[new], np.add.reduceat(pos, new), np.add.reduceat(1 - pos, new), sums[1], eps)
        sums, start = [a + b for a, b in zip(sums, run[2:])], end
    return sums


def _run_sums(split, rnd, score, pos, neg, below, eps) -> tuple:
    """Sums of one (split, round) over merged, ascending scores; ``below``: negatives
    that this task has seen under them."""
    under = below + np.cumsum(neg) - neg
    p = np.clip(_probability(score), eps, 1 - eps)
    return (split, rnd, int(pos.sum()), int(neg.sum()), float((pos * (under + 0.5 * neg)).sum()),
            float(-(pos * np.log(p) + neg * np.log(1 - p)).sum()), float(np.where(score > 0, neg, pos).sum()))


def staged_sums(staged: DataFrame, eps: float, ordered: bool) -> DataFrame:
    """SUMS of each task's stretch of the order (split, round, score): one shuffle
    by composite ranges for all AUCs, none if only log loss and error are wanted."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        tail, below, out = None, {}, {}

        def put(row):
            have = out.setdefault(row[:2], [0, 0, 0.0, 0.0, 0.0])
            for i, v in enumerate(row[2:]):
                have[i] += v

        def add(split, rnd, score, pos, neg):
            # A batch whose rows all merge into one leaves nothing before the tail.
            if not len(split):
                return
            edges = np.flatnonzero(np.r_[True, (np.diff(split) != 0) | (np.diff(rnd) != 0), True])
            for a, b in zip(edges[:-1], edges[1:]):
                key = int(split[a]), int(rnd[a])
                put(_run_sums(*key, score[a:b], pos[a:b], neg[a:b], below.get(key, 0), eps))
                below[key] = below.get(key, 0) + int(neg[a:b].sum())
        for batch in batches:
            split, rnd, score, y = (batch.column(c).to_numpy() for c in ("split", "round", "score", "y"))
            cols = [split, rnd, score, (y == 1).astype(np.int64), (y != 1).astype(np.int64)]
            if tail is not None:
                cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
            if not len(cols[0]):
                continue
            # Equal scores count half against each other, so they are merged first.
            new = np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in cols[:3]], axis=0)])
            cols = [c[new] for c in cols[:3]] + [np.add.reduceat(c, new) for c in cols[3:]]
            tail = [c[-1:] for c in cols]
            add(*[c[:-1] for c in cols])
        if tail is not None:
            add(*tail)
        if out:
            keys, values = zip(*out.items())
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                   pa.array([part] * len(keys), pa.int32()),
                                   *(pa.array([v[i] for v in values], t) for i, t in enumerate(
                                       [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]))],
                                  names=[c.split()[0] for c in SUMS.split(", ")])
    by = ["split", "round", "score"]
    return (staged.repartitionByRange(*by).sortWithinPartitions(*by) if ordered else staged).mapInArrow(run, SUMS)
