"""Conversation prefix trie (operator 12) by vertical bitmaps.

Input: one row a turn, ``(conv_id, pos, n_turns, turn_key, weight)``; a conversation
without turns has one row with a null ``pos``. A node is a distinct sequence of
first turns. Its key is a 128-bit BLAKE2b digest chained over the turns' keys
(128 bits of SHA-256), so that equal sequences have equal keys in every task; no
two different ones meet by chance.

1. Turns are grouped into blocks of ``BLOCK`` positions of a conversation, dealt by
   ranges of (block, conv_id). A long conversation thus lies in many tasks; the key
   at a block's start is chained over the digests of the blocks before it.
2. A shard is a run of ascending conversations of one block. For each (position,
   turn) it has the set of its conversations as bits of an integer. Depth first,
   the parent's set is intersected with the posting of the lowest conversation that
   is left, which is the next child: its popcount is the child's share of members,
   its lowest bit the smallest member, and the bits of ended conversations are its
   end list, ascending as the shard is.
3. Shares are summed by key. The digest over a node's members is taken from the
   shards' lists in order, as a stream, so that a node of any number of members
   takes the memory of one Arrow batch.
4. Subtree sums need no walk over levels: the smallest member of a node owns it, a
   conversation owns the last nodes of its path, and adds the sum of what it owns
   from each depth on to the node there. Every turn makes at most one addition,
   summed in the task first.

Nothing is sized by a node's members or a conversation's turns. The windows see one
row for each block of conversations longer than one.

Defined results: rows with a null conv_id belong to no conversation; an empty table
gives no rows, not even the root; turns that tie are ordered by role, then by their
digest; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parityframe.llm.common import read_table, ship, stored
from parityframe.llm.sequences import in_order, segment, segment_starts

#: Positions of a block; conversations and turns of a shard at most.
BLOCK = 1024
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 100_000
ROOT = b"\0" * 16
KEY = ["k1", "k2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()

SHARES = "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv_id long, weight long, ends string"
SUMS = "k1 long, k2 long, leaves long, saved long"


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _halves(keys: list) -> list:
    """Two int64 columns of 16-byte keys; None stays null."""
    both = np.frombuffer(b"".join(k or ROOT for k in keys), np.int64).reshape(-1, 2)
    empty = np.array([k is None for k in keys], bool)
    return [pa.array(both[:, i], mask=empty) for i in (0, 1)]


def _table(columns: list, schema: str) -> pa.RecordBatch:
    return pa.record_batch(columns, names=[c.split()[0] for c in schema.split(", ")])


def path_keys(start: bytes, turns: list, block: int) -> list:
    """Keys of the nodes along a block's turns. The last of a full block is the
    chained digest of the whole block, which the next block starts from."""
    keys, key = [], start
    for turn in turns:
        key = _digest(key, turn)
        keys.append(key)
    if len(turns) == block:
        keys[-1] = _digest(start, *turns)
    return keys


class Shard:
    """Conversations of one block, ascending; see the module."""

    def __init__(self, number: int, block: int):
        self.number, self.block = number, block
        self.ids: list = []
        self.lengths: list = []
        self.starts: list = []
        self.turns: list = []
        self.weights: list = []
        self.size = 0

    def add(self, conv, n_turns, start, turns, weights) -> None:
        self.ids.append(conv)
        self.lengths.append(n_turns)
        self.starts.append(start)
        self.turns.append(turns)
        self.weights.append(weights)
        self.size += len(turns)

    def nodes(self) -> Iterator[tuple]:
        """(key, parent, depth, members, smallest, weight, ends) of every node."""
        base = self.number * self.block
        deepest = max(map(len, self.turns))
        postings: list = [{} for _ in range(deepest)]
        alive = [0] * (deepest + 1)
        ended = [0] * (deepest + 1)
        groups: dict = {}
        for i, turns in enumerate(self.turns):
            bit = 1 << i
            for at, turn in enumerate(turns):
                postings[at][turn] = postings[at].get(turn, 0) | bit
                alive[at] |= bit
            if self.lengths[i] == base + len(turns):
                ended[len(turns)] |= bit
            groups[self.starts[i]] = groups.get(self.starts[i], 0) | bit

        def listed(bits):
            found = []
            while bits:
                low = bits & -bits
                found.append(self.ids[low.bit_length() - 1])
                bits ^= low
            return ",".join(map(str, found)) or None

        stack = []
        for start, members in groups.items():
            if not self.number:
                yield start, None, 0, members.bit_count(), self.ids[(members & -members).bit_length() - 1], 0, listed(members & ended[0])
            stack.append((members, 0, start, start))
        while stack:
            members, at, parent, start = stack.pop()
            left = members & alive[at]
            while left:
                i = (left & -left).bit_length() - 1
                turn = self.turns[i][at]
                child = left & postings[at][turn]
                left ^= child
                key = _digest(parent, turn) if at + 1 < self.block else _digest(start, *self.turns[i])
                yield (key, parent, base + at + 1, child.bit_count(), self.ids[i], self.weights[i][at],
                       listed(child & ended[at + 1]))
                if at + 1 < deepest:
                    stack.append((child, at + 1, key, start))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(conv, block, n_turns, start, turns, weights) of the rows of a batch."""
    items = batch.column("items")
    ends = np.cumsum([0, *(len(x) if x is not None else 0 for x in items)])
    flat = items.flatten()
    turns, weights = flat.field("turn_key").to_pylist(), flat.field("weight").to_pylist()
    for i, (conv, number, n, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "n_turns", "start")))):
        yield conv, number, n, start or ROOT, turns[ends[i]:ends[i + 1]], weights[ends[i]:ends[i + 1]]


def packed_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stored (conv_id, block, n_turns, items, start): the turns of each block in
    order, and the key at its start (null: the root's)."""
    ship(turns.sparkSession)
    rows = turns.groupBy("conv_id", F.expr(f"coalesce(pos div {block}, 0L)").alias("block")).agg(
        F.max("n_turns").alias("n_turns"),
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "turn_key", "weight")))).alias("items"))
    return _with_starts(stored(rows, "trie-blocks"), block)


def _with_starts(rows: DataFrame, block: int) -> DataFrame:
    def chain(batches):
        own = key = None
        for batch in batches:
            out: list = [[], [], []]
            for conv, number, _, _, turns, _ in _blocks(batch):
                if conv != own:
                    own, key = conv, ROOT
                # The digest of the block's turns stands for them.
                key = _digest(key, *turns)
                for column, value in zip(out, (conv, number + 1, key)):
                    column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                                  names=["conv_id", "block", "start"])
    long = rows.withColumn("start", F.lit(None).cast("binary")).where((F.col("block") + 1) * block < F.col("n_turns"))
    starts = long.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        chain, "conv_id long, block long, start binary")
    return rows.join(starts, ["conv_id", "block"], "left")


def shard_shares(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Step 2: each shard's nodes, with its share of members and ends."""
    def run(batches):
        shard = None
        for batch in batches:
            for conv, number, *rest in _blocks(batch):
                if shard and (shard.number != number or len(shard.ids) >= SHARD_CONVERSATIONS or shard.size >= SHARD_TURNS):
                    yield from shares(shard)
                    shard = None
                shard = shard or Shard(number, block)
                shard.add(conv, *rest)
        if shard:
            yield from shares(shard)

    def shares(shard):
        rows = []
        for row in shard.nodes():
            rows.append(row)
            if len(rows) == 4096:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    def made(rows):
        key, parent, *numbers, ends = zip(*rows)
        return _table([*_halves(key), *_halves(parent), *(pa.array(x, pa.int64()) for x in numbers), pa.array(ends, pa.string())], SHARES)
    return blocks.repartitionByRange("block", "conv_id").sortWithinPartitions("block", "conv_id").mapInArrow(run, SHARES)


def end_digests(shares: DataFrame) -> DataFrame:
    """(key, ends_sha256): shards hold disjoint ranges of conversations, so their
    lists in the order of their smallest one are the whole list in order."""
    def run(batches):
        own, state = None, None
        for batch in batches:
            out = []
            for k1, k2, ends in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ends"))):
                if (k1, k2) == own:
                    state.update(b",")
                else:
                    if own:
                        out.append((*own, state.hexdigest()))
                    own, state = (k1, k2), hashlib.sha256()
                state.update(ends.encode())
            if out:
                yield made(out)
        if own:
            yield made([(*own, state.hexdigest())])

    def made(rows):
        a, b, c = zip(*rows)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=[*KEY, "ends_sha256"])
    lists = shares.where("ends IS NOT NULL").select(*KEY, "conv_id", "ends")
    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def subtree_sums(blocks: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Step 4: (key, leaves, saved) over the nodes' subtrees; ``nodes`` has the
    owner (conv_id), depth, leaf and saved of each node itself."""
    owned = nodes.groupBy("conv_id", F.expr(f"greatest(depth - 1, 0L) div {block}").alias("block")).agg(
        F.collect_list(F.struct("depth", "leaf", "saved")).alias("owned"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    whole = blocks.join(owned, ["conv_id", "block"], "left").fillna(0, ["leaf", "saved"])
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # What blocks hold beyond this one; only conversations of several blocks have any.
    tails = whole.where(F.col("n_turns") > block).select("conv_id", "block", *[
        F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"tail_{c}") for c in ("leaf", "saved")])
    rows = whole.drop("leaf", "saved").join(tails, ["conv_id", "block"], "left").fillna(0, ["tail_leaf", "tail_saved"])
    rows = rows.where("owned IS NOT NULL OR tail_leaf > 0 OR tail_saved > 0")

    def run(batches):
        sums: dict = {}
        for batch in batches:
            extra = zip(*(batch.column(c).to_pylist() for c in ("owned", "tail_leaf", "tail_saved")))
            for (_, number, _, start, turns, _), (owned, leaf, saved) in zip(_blocks(batch), extra):
                own = {o["depth"]: o for o in owned or ()}
                keys = path_keys(start, turns, block)
                base = number * block
                for at in range(len(keys), -1 if not number else 0, -1):
                    o = own.get(base + at)
                    if o:
                        leaf, saved = leaf + o["leaf"], saved + o["saved"]
                    if leaf or saved:
                        total = sums.setdefault(keys[at - 1] if at else start, [0, 0])
                        total[0] += leaf
                        total[1] += saved
            if len(sums) > SHARD_TURNS:
                yield made(sums)
                sums = {}
        if sums:
            yield made(sums)

    def made(sums):
        leaves, saved = zip(*sums.values())
        return _table([*_halves(list(sums)), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], SUMS)
    return rows.mapInArrow(run, SUMS).groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and its key (k1, k2)."""
    blocks = stored(packed_blocks(turns, block), "trie-started")
    shares = stored(shard_shares(blocks, block), "trie-shares")
    nodes = shares.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), *[F.min(c).alias(c) for c in ("p1", "p2", "depth", "conv_id", "weight")])
    children = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "trie-nodes")
    own = nodes.select("conv_id", "depth", F.expr("CAST(n_children = 0 AS LONG)").alias("leaf"),
                       ((F.col("n_convs") - 1) * F.col("weight")).alias("saved"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(subtree_sums(blocks, own, block), KEY).join(end_digests(shares), KEY, "left")
            .join(parents, ["p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), *KEY))


# ------------------------------------------------------------------ the query
#: 128 bits of the SHA-256 of the role's length, the role and the text.
TURN_KEY = "unhex(substring(sha2(concat(char_length(role), ':', role, text), 256), 1, 32))"
#: Fixed values of the query's stand-in conversations.
FAMILY, HEADS = 100, 6


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """The query's input: each conversation c with the first h turns of c - c % 100
    in place of its own, h = crc32(c) % 6. Turns are numbered without gathering a
    conversation; its length and its family's head reach it by segment."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.expr(TURN_KEY).alias("turn_key"), F.char_length("text").cast("long").alias("weight"))
    ordered = in_order(rows, ["conv_id", "turn", "role", "turn_key"], "trie-turns")
    starts = segment_starts(ordered)
    items = ordered.groupBy("conv_id", segment()).agg(
        F.sort_array(F.collect_list(F.struct("mid", "turn_key", "weight"))).alias("items"))

    def placed(segments):
        return segments.select("*", F.posexplode("items").alias("at", "item")).withColumn("own", F.col("start") + F.col("at"))
    heads = placed(items.where(f"conv_id % {FAMILY} = 0").join(starts.where(f"conv_id % {FAMILY} = 0 AND start < {HEADS - 1}"),
                                                              ["conv_id", "segment"]))
    heads = heads.where(f"own < {HEADS - 1}").groupBy(F.col("conv_id").alias("family")).agg(
        F.sort_array(F.collect_list(F.struct("own", "item.turn_key", "item.weight"))).alias("head"))
    h = F.expr(f"CAST(crc32(CAST(conv_id AS STRING)) % {HEADS} AS INT)")
    convs = (starts.groupBy("conv_id").agg(F.max("n_rows").alias("n_rows")).withColumn("h", h)
             .withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}")).join(heads, "family", "left")
             .select("conv_id", "h", "n_rows", F.expr("slice(coalesce(head, array()), 1, h)").alias("head")))
    convs = stored(convs.withColumn("n_turns", F.size("head") + F.greatest(F.lit(0), F.col("n_rows") - F.col("h"))), "trie-convs")
    tails = placed(items.join(starts.join(convs.select("conv_id", "h", "n_turns", F.size("head").alias("n_head")), "conv_id"),
                              ["conv_id", "segment"])).where("own >= h")
    # A conversation without turns keeps one row, with no position.
    first = convs.select("conv_id", "n_turns", F.posexplode_outer("head").alias("pos", "item")).where("pos IS NOT NULL OR n_turns = 0")
    return tails.select("conv_id", (F.col("own") - F.col("h") + F.col("n_head")).alias("pos"), "n_turns",
                        "item.turn_key", "item.weight").unionByName(
        first.select("conv_id", F.col("pos").cast("long").alias("pos"), "n_turns", "item.turn_key", "item.weight"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_turns(read_table(spark, sf_dir, "conversations"))).drop(*KEY)


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda x: list_transform(range(8), lambda i: (ascii(x) >> i::INTEGER) & 1)))),
  lambda s, b: xor(s >> 1, CASE WHEN xor(s & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
OP12_SQL = f"""WITH clean AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT c, turn, role, length(text) AS w, substring(sha256(length(role) || ':' || role || text), 1, 32) AS t FROM clean),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, t) - 1 AS p FROM keyed),
ids AS (SELECT c, {_CRC} % {HEADS} AS h, c - c % {FAMILY} AS f FROM (SELECT DISTINCT c FROM own)),
heads AS (SELECT i.c, own.p, t, w FROM ids i JOIN own ON own.c = i.f AND own.p < i.h),
turns AS (SELECT * FROM heads UNION ALL
  SELECT i.c, p - h + (SELECT count(*) FROM heads WHERE heads.c = i.c), t, w FROM ids i JOIN own ON own.c = i.c AND p >= h),
path AS (SELECT c, p + 1 AS d, string_agg(t, '') OVER (PARTITION BY c ORDER BY p) AS k, w FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM ids),
n0 AS (SELECT k, min(d) AS d, min(c) AS c, count(*) AS n, min(w) AS w FROM path GROUP BY k),
kids AS (SELECT substring(k, 1, length(k) - 32) AS k, count(*) AS m FROM n0 WHERE d > 0 GROUP BY 1),
n1 AS (SELECT n0.*, coalesce(m, 0) AS m FROM n0 LEFT JOIN kids USING (k)),
added AS (SELECT path.k, sum(CASE WHEN n1.c = path.c AND m = 0 THEN 1 ELSE 0 END) OVER later AS l,
  sum(CASE WHEN n1.c = path.c THEN (n - 1) * n1.w ELSE 0 END) OVER later AS s FROM path JOIN n1 USING (k)
  WINDOW later AS (PARTITION BY path.c ORDER BY path.d DESC)),
sums AS (SELECT k, sum(l) AS l, sum(s) AS s FROM added GROUP BY k),
last AS (SELECT c, max(d) AS d FROM path GROUP BY c),
ended AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM path JOIN last USING (c, d) GROUP BY k)
SELECT n1.c AS conv_id, n1.d AS depth, up.c AS parent_conv_id, n1.n AS n_convs, n1.m AS n_children, CAST(l AS BIGINT) AS n_leaves,
  CAST(s AS BIGINT) AS saved_tokens, coalesce(e, '{NO_ENDS}') AS ends_sha256
FROM n1 JOIN sums USING (k) LEFT JOIN ended USING (k) LEFT JOIN n1 up ON n1.d > 0 AND up.k = substring(n1.k, 1, length(n1.k) - 32)"""
