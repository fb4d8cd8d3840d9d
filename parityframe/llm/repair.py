"""Conversation structure repair (operator 13) by a grammar-compressed DP.

Each row of a conversation is a symbol: the initial of its role (s, u, a, or o for
any other) and its first fault (blank, duplicate, truncated or none). Edits turn the
roles into ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 2, Delete 3, the
only one for blank and duplicate rows, Insert of an empty user or assistant turn 2; a
truncated row that stays adds 1. Wanted are the least cost and, among its edit
strings, the ASCII-least (D < I < K < R): the audit.

The automaton of the pattern has four states, so a run of rows is a 4 x 4 matrix of
(cost, audit) cells under (min, plus), with audits concatenated. Cells of one place
that cost the same are never prefixes of each other (they edit the same rows, and
one more Insert costs more), so the least audit of a product is made of the least
audits of its factors, and matrices may be multiplied in any grouping:

1. Rows are sorted by Spark in ranges (``sequences.in_order``), so a long
   conversation lies in many tasks, and cut into segments of up to 1,024 rows.
   Duplicates are found by the least place of each (conversation, role, text).
2. A task takes the distinct symbol strings of its segments and compresses them
   with Re-Pair: the most frequent pairs of symbols become rules until no pair
   repeats. Each rule's matrix is computed once, from those of its two parts, and
   serves all conversations; its audits are ropes of its parts' audits. Ropes are
   compared from the left, skipping what they share.
3. Conversations are dealt by id and read in order as a stream: first the segments'
   matrices, which give cost and audit, then the rows, whose edits the audit names.
   Texts are never gathered; a conversation's audit (a letter a row) is.

Defined results: rows are ordered by turn (nulls first), ties by role, then by a
SHA-256 digest of role and text; null role or text is one space; rows with a null
conv_id are one conversation; an empty table gives no rows; repeated rows are
duplicates. Words of whitespace are ``[\\x20\\x09-\\x0D]``. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityframe.llm.common import read_table, ship
from parityframe.llm.sequences import SEGMENT_BITS, in_order, segment

KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 2, 3, 2, 1
#: States: at the start, after a system turn, after a user's, after an assistant's.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
#: Symbols: blank and duplicate rows, then sound ones by role, then truncated ones.
SYMBOLS = "bdsuaoSUAO"
#: Symbols that are compressed together.
TOGETHER = 1 << 16


# ------------------------------------------------------------------- ropes
class Rope:
    """Two audits one after the other."""
    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, len(left) + len(right)

    def __len__(self):
        return self.size


def joined(a, b):
    if not len(a) or not len(b):
        return a if len(a) else b
    return a + b if type(a) is type(b) is str and len(a) + len(b) <= 32 else Rope(a, b)


def flat(rope) -> str:
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if type(x) is str:
            out.append(x)
        else:
            stack += (x.right, x.left)
    return "".join(out)


def less(a, b) -> bool:
    """Whether a's letters come before b's; parts that both share are skipped."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if type(x) is type(y) is str:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if len(x) > n:
                left.append(x[n:])
            if len(y) > n:
                right.append(y[n:])
        elif type(y) is str or type(x) is Rope and len(x) >= len(y):
            left += (x.right, x.left)
            right.append(y)
        else:
            left.append(x)
            right += (y.right, y.left)
    return any(len(y) for y in right)


# ---------------------------------------------------------------- matrices
def times(vector: list, matrix: list) -> list:
    """Least (cost, audit) of each state: a vector by a matrix."""
    out: list = [None] * 4
    for cell, row in zip(vector, matrix):
        if cell is not None:
            for j, step in enumerate(row):
                if step is not None:
                    cost = cell[0] + step[0]
                    have = out[j]
                    if have is None or cost < have[0]:
                        out[j] = (cost, joined(cell[1], step[1]))
                    elif cost == have[0] and less(audit := joined(cell[1], step[1]), have[1]):
                        out[j] = (cost, audit)
    return out


def product(a: list, b: list) -> list:
    return [times(row, b) for row in a]


def _inserts() -> list:
    """What Inserts alone reach: one more letter at a time."""
    rows = []
    for state in range(4):
        row: list = [None] * 4
        at, n = state, 0
        while row[at] is None:
            row[at] = (INSERT * n, "I" * n)
            at, n = next(t for letter, t in STEPS[at].items() if letter in NAMES), n + 1
        rows.append(row)
    return rows


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> list:
    """One row's edits, then Inserts."""
    rows = []
    extra = STAYS_TRUNCATED if symbol.isupper() else 0
    for state in range(4):
        row: list = [None] * 4
        row[state] = (DELETE, "D")
        if symbol not in "bd":
            for letter, to in STEPS[state].items():
                cell = (KEEP + extra, "K") if letter == symbol.lower() else (REROLE + extra, "R") if letter in NAMES else None
                if cell and (row[to] is None or cell < row[to]):
                    row[to] = cell
        rows.append(row)
    return product(rows, INSERTS)


MATRICES = {ord(x): symbol_matrix(x) for x in SYMBOLS}


# ------------------------------------------------------------------ Re-Pair
def re_pair(strings: list[str], least: int = 2) -> tuple[list, list]:
    """(compressed strings, rules): rule number k, a pair of symbols, is the
    symbol 256 + k. Each round replaces the most frequent pairs that have no
    symbol in common."""
    text = np.frombuffer("\0".join(strings).encode("ascii"), np.uint8).astype(np.int64)
    rules: list = []
    while len(text) > 1:
        code = (text[:-1] << 32) | text[1:]
        code[(text[:-1] == 0) | (text[1:] == 0)] = -1
        pairs, counts = np.unique(code[code >= 0], return_counts=True)
        used, chosen = set(), {}
        for p in np.argsort(-counts, kind="stable"):
            if counts[p] < least:
                break
            pair = int(pairs[p]) >> 32, int(pairs[p]) & 0xFFFFFFFF
            if used.isdisjoint(pair):
                used.update(pair)
                chosen[int(pairs[p])] = 256 + len(rules)
                rules.append(pair)
        if not chosen:
            break
        wanted = np.array(sorted(chosen))
        names = np.array([chosen[int(c)] for c in wanted])
        near = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
        hits = np.flatnonzero(wanted[near] == code)
        # In a run of one symbol every second place starts a pair.
        run = np.r_[True, np.diff(hits) > 1]
        hits = hits[(hits - hits[np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))]) % 2 == 0]
        text[hits] = names[near[hits]]
        text = np.delete(text, hits + 1)
    cuts = np.flatnonzero(text == 0)
    return [part[part > 0].tolist() for part in np.split(text, cuts)], rules


def string_matrices(strings: list[str]) -> list:
    """The matrix of each symbol string, by rules that all strings share."""
    parts, rules = re_pair(strings)
    known = dict(MATRICES)
    for k, (a, b) in enumerate(rules):
        known[256 + k] = product(known[a], known[b])
    unit = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    out = []
    for part in parts:
        matrix = known[part[0]] if part else unit
        for symbol in part[1:]:
            matrix = product(matrix, known[symbol])
        out.append(matrix)
    return out


# ---------------------------------------------------------------- the steps
ROWS = "conv_id long, phase int, mid long, symbols string, initials string, costs array<long>, audits array<string>, turn long, role string, text string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def segment_matrices(segments: DataFrame) -> DataFrame:
    """``segments`` (conv_id, segment, symbols) with costs and audits of the 16
    cells (null: out of reach)."""
    def run(batches):
        held, seen, size = [], {}, 0
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "symbols")]
            for row in zip(*rows):
                held.append(row)
                if row[2] not in seen:
                    seen[row[2]] = None
                    size += len(row[2])
                if size > TOGETHER or len(held) > TOGETHER:
                    yield from made(held, seen)
                    held, seen, size = [], {}, 0
        yield from made(held, seen)

    def made(held, seen):
        cells = {}
        for string, matrix in zip(seen, string_matrices(list(seen)) if seen else ()):
            line = [cell for row in matrix for cell in row]
            cells[string] = [c and c[0] for c in line], [c and flat(c[1]) for c in line]
        for at in range(0, len(held), 1000):
            conv, number, symbols = zip(*held[at:at + 1000])
            yield pa.record_batch([pa.array(conv, pa.int64()), pa.array(number, pa.int64()),
                                   pa.array([cells[s][0] for s in symbols], pa.list_(pa.int64())),
                                   pa.array([cells[s][1] for s in symbols], pa.list_(pa.string()))],
                                  names=["conv_id", "segment", "costs", "audits"])
    return segments.select("conv_id", "segment", "symbols").mapInArrow(
        run, "conv_id long, segment long, costs array<long>, audits array<string>")


def _symbols(ordered: DataFrame) -> DataFrame:
    """(conv_id, segment, symbols, initials) of the stored rows."""
    firsts = ordered.groupBy("conv_id", "said").agg(F.min("mid").alias("mid")).select("mid", F.lit(True).alias("is_first"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    symbol = (F.when(F.col("blank"), "b").when(F.col("is_first").isNull(), "d")
              .when(F.col("truncated"), F.upper(initial)).otherwise(initial))
    rows = ordered.select("conv_id", "mid", "role", "blank", "truncated").join(firsts, "mid", "left")
    packed = rows.groupBy("conv_id", segment()).agg(F.sort_array(F.collect_list(F.struct(
        "mid", symbol.alias("symbol"), initial.alias("initial")))).alias("rows"))
    return packed.select("conv_id", "segment", F.array_join("rows.symbol", "").alias("symbols"),
                         F.array_join("rows.initial", "").alias("initials"))


def clean_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, said, blank, truncated) of every row."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    # The last character that is no whitespace, without a pattern over long texts.
    last = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)
    return rows.select("*", F.expr("unhex(substring(sha2(concat(char_length(role), ':', role, text), 256), 1, 32))").alias("said"),
                       (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))


def repair_stream(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Steps 1 and 2; then the rows that step 3 reads, sorted in tasks by
    conversation: its mark (phase 0), segment matrices (1), symbols and rows (2).
    ``ids``: every conversation that must appear; ``rows``: :func:`clean_rows`."""
    ship(rows.sparkSession)
    ordered = in_order(rows, ["conv_id", "turn", "role", "said"], "repair-rows")
    segments = _symbols(ordered)

    def shaped(df, phase, **columns):
        kinds = dict(c.split(" ", 1) for c in ROWS.split(", "))
        return df.select(*[columns.get(n, F.lit(phase) if n == "phase" else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
    c = F.col
    # A segment's symbols come before its first row.
    before = F.shiftleft("segment", SEGMENT_BITS)
    parts = [shaped(ids.distinct(), 0, conv_id=c("conv_id"), mid=F.lit(0)),
             shaped(segment_matrices(segments), 1, conv_id=c("conv_id"), mid=c("segment"), costs=c("costs"), audits=c("audits")),
             shaped(segments, 2, conv_id=c("conv_id"), mid=before, symbols=c("symbols"), initials=c("initials")),
             shaped(ordered, 2, conv_id=c("conv_id"), mid=c("mid"), turn=c("turn"), role=c("role"), text=c("text"))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "phase", "mid", F.col("symbols").isNull())


class Reader:
    """Reads one conversation's rows in order (step 3)."""

    def __init__(self, conv_id, keep_turns: bool):
        self.conv_id, self.keep = conv_id, keep_turns
        self.vector = INSERTS[0]
        self.audit: str | None = None
        self.at = self.state = self.place = 0
        self.last_initial = None
        self.turns = (None, None, 0)
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.sha = hashlib.sha256()
        self.cost = 0

    def matrix(self, costs, audits) -> None:
        cells = [None if k is None else (k, a) for k, a in zip(costs, audits)]
        self.vector = times(self.vector, [cells[i:i + 4] for i in range(0, 16, 4)])

    def symbols(self, symbols, initials) -> None:
        if self.audit is None:
            self._decide()
        self.counts["blank"] += symbols.count("b")
        self.counts["duplicate"] += symbols.count("d")
        self.counts["truncated"] += sum(map(symbols.count, "SUAO"))
        line = (self.last_initial or "") + initials
        self.counts["illegal"] += sum(line[i:i + 2] not in ("su", "ua", "au") for i in range(len(line) - 1))
        self.last_initial = initials[-1]

    def _decide(self) -> None:
        best = None
        for state in ACCEPTING:
            cell = self.vector[state]
            if cell and (best is None or cell[0] < best[0] or cell[0] == best[0] and less(cell[1], best[1])):
                best = cell
        self.cost, self.audit = best[0], flat(best[1])

    def row(self, turn, role, text) -> list:
        """Repaired turns up to this row, and the row itself unless deleted."""
        if turn is not None:
            low, high, n = self.turns
            self.turns = (turn, turn, 1) if low is None else (low, turn, n + (turn != high))
        out = self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[self.state][role[0]]
            out += self._said(role, text, edit)
        elif edit == "R":
            out += self._said(self._next(), text, edit)
        return out

    def inserts(self) -> list:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            out += self._said(self._next(), "", "I")
        return out

    def _next(self) -> str:
        letter, self.state = next((x, t) for x, t in STEPS[self.state].items() if x in NAMES)
        return NAMES[letter]

    def _said(self, role, text, edit) -> list:
        if self.keep:
            self.place += 1
            return [(self.conv_id, self.place - 1, role, text, edit)]
        self.sha.update((("\n" if self.place else "") + role + ":" + text).encode())
        self.place += 1
        return []

    def finished(self):
        """Turns after the last row, or the conversation's summary."""
        if self.audit is None:
            self._decide()
        rest = self.inserts()
        if self.keep:
            return rest
        low, high, n = self.turns
        gaps = 0 if low is None else high - low + 1 - n
        return [(self.conv_id, gaps, *self.counts.values(), self.cost, self.audit, self.sha.hexdigest())]


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string, edit string"


def _read(stream: DataFrame, keep_turns: bool) -> DataFrame:
    schema = TURNS if keep_turns else SUMMARY
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out: list = []
            for conv, phase, _, symbols, initials, costs, audits, turn, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if phase == 0:
                    if reader:
                        out += reader.finished()
                    reader = Reader(conv, keep_turns)
                elif phase == 1:
                    reader.matrix(costs, audits)
                elif symbols is not None:
                    reader.symbols(symbols, initials)
                else:
                    out += reader.row(turn, role, text)
            if out:
                yield made(out)
        if reader:
            yield made(reader.finished())

    def made(rows):
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], names=_names(schema))
    return stream.mapInArrow(run, schema)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text, edit), edit K, R or I."""
    return _read(repair_stream(clean_rows(conversations), conversations.select("conv_id")), True)


def repair_summary(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation: faults, cost, audit and the digest of the repaired
    ``role:text`` lines. ``ids`` may name conversations without rows."""
    ids = conversations.select("conv_id") if ids is None else ids
    return _read(repair_stream(clean_rows(conversations), ids), False)


# ------------------------------------------------------------------ the query
def damaged(conversations: DataFrame) -> DataFrame:
    """The query's stand-in: rows dropped, emptied, stripped of their stops,
    repeated or given another role by a checksum of conversation and turn."""
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    kind = F.pmod(F.crc32(key), F.lit(20))
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.expr("CASE WHEN kind = 4 THEN 'user' ELSE role END").alias("role"),
        F.expr("CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.explode(F.expr("sequence(1, IF(kind = 3, 2, 1))")).alias("copy")).drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return repair_summary(damaged(conversations), conversations.select("conv_id"))
