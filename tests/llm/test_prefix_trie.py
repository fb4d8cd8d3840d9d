"""The prefix trie: odd and long conversations against SQL, blocks and shards of
any size, and the shard's bitmaps against plain counting."""

import collections

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parityframe.llm import prefix_trie as pt
from parityframe.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string"


def _rows():
    rows = [(0, i, "user" if i % 2 else "assistant", f"head {i % 3}") for i in range(4)]
    for c in range(1, 130):
        rows += [(c, i, "user", f"own {c % 3} {i}") for i in range(c % 5)]
    rows += [(200, i, "user", f"long {i // 2}") for i in range(40)] + [(201, i, "user", f"long {i // 2}") for i in range(40)]
    rows += [(202, i, "user", f"long {i // 2}" if i < 27 else "else") for i in range(33)] + [(203, i, "user", f"long {i // 2}") for i in range(24)]
    rows += [(300, None, None, None), (300, None, "", ""), (300, 1, "é", "🙂 ñ"), (300, 1, "user", "b"), (300, 1, "user", "a"),
             (-7, 3, "user", "x"), (-107, 3, "user", "x"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    return rows + rows[-6:-4]


def _plain(table):
    con = duckdb.connect()
    con.register("t", table)
    con.execute("CREATE VIEW conversations AS SELECT * FROM t")
    return sorted(con.execute(pt.OP12_SQL).fetchall(), key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("block,conversations", [(1024, 4096), (3, 4096), (8, 5), (1, 1)])
def test_odd_conversations(spark, monkeypatch, block, conversations):
    monkeypatch.setattr(pt, "SHARD_CONVERSATIONS", conversations)
    table = spark.createDataFrame(_rows(), SCHEMA).withColumns({c: F.lit("extra") for c in ("pos", "k1", "start", "items", "depth")})
    got = pt.prefix_trie(pt.rebuilt_turns(table), block).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == _plain(table.select("conv_id", "turn", "role", "text").toArrow())


def test_segments_of_one_conversation(spark, monkeypatch):
    """A conversation over many tasks and segments keeps its order."""
    from parityframe.llm import sequences
    monkeypatch.setattr(sequences, "SEGMENT_BITS", 2)
    table = spark.createDataFrame([(5, (i * 37) % 101, "user", f"t{i}") for i in range(101)] + [(6, 1, "user", "a"), (7, 1, "user", "a")], SCHEMA)
    got = pt.prefix_trie(pt.rebuilt_turns(table), 16).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == _plain(table.toArrow())


def test_no_conversations(spark):
    none = pt.prefix_trie(pt.rebuilt_turns(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)))
    assert none.count() == 0 and none.columns[:8] == COLUMNS


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=6), min_size=1, max_size=10))
def test_bitmaps_count_prefixes(paths):
    shard = pt.Shard(0, 4)
    members = collections.defaultdict(list)
    for i, turns in enumerate(paths):
        shard.add(10 * i, len(turns), pt.ROOT, turns[:4], [1] * len(turns[:4]))
        for d in range(min(4, len(turns)) + 1):
            members[tuple(turns[:d])].append(i)
    want = sorted((len(p), len(m), 10 * m[0], ",".join(str(10 * i) for i in m if len(paths[i]) == len(p)) or None) for p, m in members.items())
    assert sorted((d, n, c, ends) for _, _, d, n, c, _, ends in shard.nodes()) == want
    assert len({k for k, *_ in shard.nodes()}) == len(members)


def test_two_nodes_never_share_a_key_by_their_texts(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", "abc"), (4, 0, "abc", "")]
    keys = stored(spark.createDataFrame(rows, SCHEMA).select(F.expr(pt.TURN_KEY).alias("k")), "keys")
    assert keys.distinct().count() == 4
