"""N-gram Jaccard join (operator 2): token-combination prefixes.

A document's set holds its distinct 4-word shingles, as 64-bit hashes (a text
of fewer words is one shingle). Two documents link if their sets have a
Jaccard similarity of at least ``percent``/100; components are what links
connect.

Method
------
1. *Sets.* Documents with equal sets are one node (a 64-bit sum over the set).
   One of its rows, in its smallest block, stands for it from here on.
2. *Classes.* Shingles that many documents hold are frequent: at most
   ``most_frequent`` of them, from counts over all documents (each task leaves
   out what it met once). Any choice gives the same links; it only spares work.
3. *Prefixes.* Sets are ordered rare shingles first, each class by hash. A set
   of n that links to another lacks at most t = n - ceil(percent * n / 100) of
   its shingles there. A prefix of t + 1 rare shingles gives single-shingle
   signatures: two linked sets share one. Where the rare ones don't reach,
   the prefix goes on into frequent shingles, which are dealt to S classes by
   their low bits and give *pairs* of shingles of the same class as signatures.
   A class of m prefix shingles can lose m - 1 before no pair is left, so the
   prefix is extended until the rare ones plus the sum of m - 1 exceed t. S
   grows with the set, which keeps pairs as few as the prefix is long; sets
   within the length bound of each other share one of two size levels.
4. *Candidates.* Blocks of texts learn, one bit per signature, which of theirs
   another set has (packed routing, as in substring dedup; a signature that
   thousands hold is one entry per block). Sets with such signatures are
   written to the shared folder with their texts; the rest are done.
5. *Verification.* First every set is compared with one set for each of its
   signatures, the one that shares most of its own: a star and not all pairs.
   Signatures whose sets are now in one component are done. For the others sets
   are compared across components: first each set with the nearest one (by
   the maps below) of each other component, in a share of the signatures, then
   all pairs that are left. So no link that could connect anything is missed,
   and groups of thousands of near copies cost few comparisons for each.

Pairs are pruned before texts are read: by length (100 * smaller >= percent *
larger) and by 512-bit parity maps of the sets, which differ in no more places
than the sets do. Near copies with a few edits each, of which hardly two link,
thus leave few pairs. Nothing of the size of the input reaches the driver.

Defined results: a null text, or one without words, has an empty set, links
with nothing and is its own component; a null id never names a component
unless all its members lack one; rows of equal id and different texts are
documents of their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parityframe.llm import wordhash as wh
from parityframe.llm.common import (BITS, PACKED, PACKED_ARROW, block_count, packed_hashes, read_bits, read_table, shared_hashes,
                                    ship, stored, text_blocks, text_bytes)
from parityframe.llm.components import components

_IS_WORD = wh.word_table(wh.SPACES)
_LANE = wh.lane(21, wh.SPACES, lower=True)
_KIND_ROW, _KIND_TOKEN = 0, 1
#: A shingle in more documents than this can be a frequent one.
FREQUENT_FROM = 32
#: One of so many open signatures is looked at first.
FIRST_SHARE = 16
#: Nodes (8 bytes each) that are broadcast at most; beyond it they are joined.
BROADCAST_NODES = 1 << 20
#: Size levels: a step is a little more than the largest ratio of linked sizes.
_LEVEL_SLACK = 0.99


def shingle_sets(column, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text with words."""
    for a, _, data, offsets in wh.text_slices(column):
        w = wh.find_words(data, offsets, _IS_WORD)
        h = wh.word_hashes(w, _LANE)
        grams = wh.gram_hashes(h, shingle)
        for i in range(len(offsets) - 1):
            at, to = w.first[i], w.first[i + 1]
            n = to - at
            if n >= shingle:
                yield a + i, np.unique(grams[at:to - shingle + 1])
            elif n:
                # Hashes of shorter texts depend on their length.
                yield a + i, wh.gram_hashes(h[at:to], n)[:1] ^ np.uint64(n)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit number for the set: the sum of its mixed hashes."""
    return int(wh.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


#: Bits of a set's parity map, as this many 64-bit columns.
_MAP_COLUMNS = 8


def parity_map(s: np.ndarray) -> np.ndarray:
    """For each of 512 places whether an odd number of the set's shingles falls
    there. Two maps differ in at most as many places as the sets have shingles
    that the other lacks."""
    odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * _MAP_COLUMNS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differ(a: str, b: str):
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(_MAP_COLUMNS)), F.lit(0))


def _maps_allow(n_a, n_b, a: str, b: str, percent: int):
    """Whether the maps (columns a0.. and b0..) leave room for a link: linked
    sets differ in at most (100 - p) / (100 + p) of their summed sizes."""
    return _differ(a, b) * (100 + percent) <= (n_a + n_b) * (100 - percent)


def lacking(n: int, percent: int) -> int:
    """How many of its n shingles a set can lack in one that it links with."""
    return n - -(-percent * n // 100)


def _level(n: int, percent: int) -> int:
    return int(np.log(n) / -np.log(percent / 100 * _LEVEL_SLACK))


def _classes(level: int, percent: int) -> int:
    """Number of classes of frequent shingles for sets of a size level or the
    one below: about half the shingles that the smallest of them can lack."""
    smallest = (100 / (percent * _LEVEL_SLACK)) ** (level - 1)
    return max(1, int(((100 - percent) / 100 * smallest + 1) / 2))


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a sorted set; ``frequent`` is sorted."""
    n = len(s)
    need = lacking(n, percent) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        is_frequent = frequent[at] == s
        rare, common = s[~is_frequent], s[is_frequent]
    else:
        rare, common = s, s[:0]
    singles = wh.mix(rare[:need] ^ np.uint64(0x2545F4914F6CDD1D))
    if len(rare) >= need or n < 2:
        return singles
    found = [singles]
    level = _level(n, percent)
    for lv in (level, level + 1):
        size = _classes(lv, percent)
        of = (common & np.uint64(0xFFFFF)) % np.uint64(size)
        # What each further shingle adds: 0 for the first of its class, else 1.
        _, where = np.unique(of, return_index=True)
        adds = np.ones(len(common), dtype=np.int64)
        adds[where] = 0
        length = int(np.searchsorted(np.cumsum(adds), need - len(rare))) + 1
        prefix, of = common[:length], of[:length]
        order = np.argsort(of, kind="stable")
        prefix, of = prefix[order], of[order]
        for gap in range(1, length):
            same = of[gap:] == of[:-gap]
            if not same.any():
                break
            pair = prefix[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + prefix[gap:][same] * np.uint64(0xC2B2AE3D27D4EB4F)
            found.append(wh.mix(pair + np.uint64(lv + 1) * np.uint64(0x165667B19E3779F9)))
    return np.unique(np.concatenate(found))


#: Shingles that a task gathers before it counts them.
_GATHERED = 2_000_000


def _describe(shingle: int, percent: int):
    """Rows (block, id, text_hash, node, n), and counts of shingles near the prefixes."""
    names = ["kind", "block", "id", "text_hash", "node", "n"]

    def counted(near: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, count = np.unique(np.concatenate(near or [np.zeros(0, np.uint64)]), return_counts=True)
        token, count = token[count > 1], count[count > 1]
        for at in range(0, len(token), 1 << 16):
            t, c = token[at:at + (1 << 16)], count[at:at + (1 << 16)]
            yield pa.record_batch([pa.array(np.full(len(t), _KIND_TOKEN, np.int32)), pa.nulls(len(t), pa.int32()),
                                   pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int64()),
                                   pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, held = [], 0
        for batch in batches:
            rows = batch.num_rows
            node, n = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for i, s in shingle_sets(batch.column(2), shingle):
                node[i], n[i] = set_key(s), len(s)
                near.append(s[:2 * (lacking(len(s), percent) + 1)].copy())
                held += len(near[-1])
            yield pa.record_batch([pa.array(np.full(rows, _KIND_ROW, np.int32)), batch.column(0), batch.column(1),
                                   batch.column(3), pa.array(node), pa.array(n)], names=names)
            if held > _GATHERED:
                yield from counted(near)
                near, held = [], 0
        yield from counted(near)
    return run


def _frequent(described: DataFrame, most: int) -> np.ndarray:
    """The frequent shingles, ``most`` at most, sorted."""
    counts = stored(described.filter(F.col("kind") == _KIND_TOKEN).groupBy("node").agg(F.sum("n").alias("docs"))
                    .filter(F.col("docs") > FREQUENT_FROM), "shingle-counts")
    if counts.count() > most:
        sizes = counts.groupBy("docs").count().orderBy(F.desc("docs"))  # as many rows as different counts
        total, least = 0, None
        for row in sizes.toLocalIterator():
            total += row["count"]
            if total > most:
                break
            least = row["docs"]
        counts = counts.filter(F.col("docs") >= least) if least else counts.limit(0)
    tokens = counts.select("node").toArrow().column("node").to_numpy()
    return np.sort(np.ascontiguousarray(tokens).view(np.uint64))


_TOLD = BITS + ", node long"


def _owned_sets(texts: pa.Table, told: pa.Table, shingle: int) -> dict[int, tuple[int, np.ndarray]]:
    """node -> (row, set) of the nodes that this block stands for."""
    own = {v for v in told.column("node").to_pylist() if v is not None}
    found: dict[int, tuple[int, np.ndarray]] = {}
    if own:
        for i, s in shingle_sets(texts.column("text"), shingle):
            node = set_key(s)
            if node in own and node not in found:
                found[node] = (i, s)
    return found


def _all_signatures(sets, frequent, percent):
    each = [signatures(s, frequent, percent) for _, s in sets.values()]
    everything = np.concatenate(each) if each else np.zeros(0, np.uint64)
    distinct, count = np.unique(everything, return_counts=True)
    return each, distinct, count


def _signature_rows(frequent, shingle, percent, n_buckets):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return PACKED_ARROW.empty_table()
        hot = np.frombuffer(frequent.value, np.uint64)
        _, distinct, _ = _all_signatures(_owned_sets(texts, told, shingle), hot, percent)
        return packed_hashes(texts.column("block")[0].as_py(), distinct, n_buckets)
    return run


_MAP = [f"m{i}" for i in range(_MAP_COLUMNS)]
_CANDIDATE = "node long, n int, " + ", ".join(f"{m} long" for m in _MAP) + ", shared double, signatures array<long>, text binary"


def _candidate_rows(frequent, shingle, percent, n_buckets):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), *((m, pa.int64()) for m in _MAP),
                        ("shared", pa.float64()), ("signatures", pa.list_(pa.int64())), ("text", pa.binary())])

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        hot = np.frombuffer(frequent.value, np.uint64)
        sets = _owned_sets(texts, told, shingle)
        each, distinct, count = _all_signatures(sets, hot, percent)
        shared = read_bits(told, 0, distinct, n_buckets) | (count > 1)
        nodes, sizes, maps, share, kept, rows = [], [], [], [], [], []
        for (node, (row, s)), sig in zip(sets.items(), each):
            every, sig = len(sig), sig[shared[np.searchsorted(distinct, sig)]]
            if len(sig):
                share.append(len(sig) / every)
                nodes.append(node)
                sizes.append(len(s))
                maps.append(parity_map(s))
                kept.append(sig.view(np.int64))
                rows.append(row)
        maps = np.array(maps, dtype=np.int64).reshape(-1, _MAP_COLUMNS)
        # Verification shuffles texts; a shuffle's own compression is the weaker one.
        squeeze = zstandard.ZstdCompressor(level=3).compress
        texts = [squeeze((t.as_py() or "").encode()) for t in texts.column("text").take(pa.array(rows, pa.int64()))]
        return pa.table([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()),
                         *(pa.array(maps[:, i]) for i in range(_MAP_COLUMNS)), pa.array(share, pa.float64()), pa.array(kept, pa.list_(pa.int64())),
                         pa.array(texts, pa.binary())], schema=schema)
    return run


def _similar(shingle: int, percent: int):
    """Pairs (a, b, text_a, text_b) to links (a, b); texts are compressed."""
    def sets_of(keys, texts):
        """Each key's set, once."""
        _, first = np.unique(keys, return_index=True)
        whole = zstandard.ZstdDecompressor().decompress
        found = dict(shingle_sets(pa.array([whole(t.as_py()).decode() for t in texts.take(pa.array(first))], pa.string()), shingle))
        return {int(keys[at]): found[i] for i, at in enumerate(first)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sets_a, sets_b = sets_of(a, batch.column(2)), sets_of(b, batch.column(3))
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                s, t = sets_a[x], sets_b[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])
    return run


def _verified(pairs: DataFrame, candidates: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Texts that no pair needs stay where they are:
    the needed nodes are broadcast if their counted number allows it. Both
    joins are on a key that is unique in ``candidates``, so a set in thousands
    of pairs can be split by Spark."""
    pairs = stored(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)
    texts = candidates.select("node", "text").join(needed, "node", "left_semi")
    with_b = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    both = with_b.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(shingle, percent), "a long, b long")


def _near_enough(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _open_rows(candidates: DataFrame, so_far: DataFrame, centre, maps: DataFrame, share: int = 1) -> DataFrame:
    """(signature, before, node, n, component, map) of the sets that have a
    signature with sets of several components, without its centre, which is
    compared with all of them already. ``before`` is the set's open signature
    before this one. Of the signatures one in ``share`` is looked at."""
    looked_at = F.filter("signatures", lambda x: F.pmod(x, F.lit(share)) == 0) if share > 1 else F.col("signatures")
    named = candidates.select("node", "n", "shared", "signatures").join(so_far, "node", "left") \
        .select("node", "n", "shared", F.coalesce("component", "node").alias("component"), F.explode(looked_at).alias("signature"))
    several = named.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                             centre.alias("c")).filter("low <> high").select("signature", F.col("c.node").alias("centre"))
    found = stored(named.join(several, "signature").filter(F.col("node") != F.col("centre"))
                   .select("signature", "node", "component"), "open-signatures")
    in_order = Window.partitionBy("node").orderBy("signature")
    return found.withColumn("before", F.lag("signature").over(in_order)).join(maps, "node")


def _across(here: DataFrame, percent: int, also=None) -> DataFrame:
    """(a, b, component of a, differ) of sets of different components that
    share a signature and whose sizes and maps allow a link."""
    other = here.withColumnsRenamed({"node": "b", "n": "n_b", "component": "component_b", "before": "before_b"}
                                    | {m: f"b{m[1:]}" for m in _MAP})
    meet = (F.col("node") < F.col("b")) & (F.col("component") != F.col("component_b")) \
        & _near_enough(F.col("n"), F.col("n_b"), percent) & _maps_allow(F.col("n"), F.col("n_b"), "m", "b", percent)
    return here.join(other, "signature").filter(meet if also is None else meet & also).select(
        F.col("node").alias("a"), "b", "component", _differ("m", "b").alias("differ"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    percent: int = 85, most_frequent: int = 500_000) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, stands) of every row of ``docs``;
    ``stands`` marks the one document of each component that stands for it: that
    of the smallest id, null last, then of the smallest text_hash."""
    spark = docs.sparkSession
    ship(spark)
    n = block_count(text_bytes(docs, text_col))
    texts = text_blocks(docs, id_col, text_col, n)
    described = stored(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _describe(shingle, percent), "kind int, block int, id long, text_hash long, node long, n long"), "shingle-sets")
    rows = described.filter((F.col("kind") == _KIND_ROW) & (F.col("n") > 0))
    frequent = spark.sparkContext.broadcast(_frequent(described, most_frequent).tobytes())
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "text_hash")).alias("first")
    nodes = rows.groupBy("node").agg(F.min("block").alias("block"), F.min("id").alias("id"), first)

    # Candidates, with one exchange of the texts.
    owners = nodes.select("block", F.lit(-1).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("bits"), "node")
    by_block = texts.groupBy("block")
    packed = by_block.cogroup(owners.groupBy("block")).applyInArrow(_signature_rows(frequent, shingle, percent, n), PACKED)
    bits = packed.groupBy("bucket").applyInArrow(shared_hashes, BITS).withColumn("node", F.lit(None).cast("long"))
    told = owners.unionByName(bits)
    candidates = stored(by_block.cogroup(told.groupBy("block")).applyInArrow(
        _candidate_rows(frequent, shingle, percent, n), _CANDIDATE), "candidates")

    # Stars: each set against the centre of its signatures, the set that shares
    # most of its own. Of copies with edits that is the text they come from.
    centre = F.max(F.struct("shared", "node", "n"))
    held = candidates.select("node", "n", "shared", F.explode("signatures").alias("signature"))
    centres = held.groupBy("signature").agg(centre.alias("c"), F.count("*").alias("sets")) \
        .filter("sets > 1").select("signature", F.col("c.node").alias("a"), F.col("c.n").alias("n_a"))
    stars = held.join(centres, "signature") \
        .filter((F.col("node") != F.col("a")) & _near_enough(F.col("n"), F.col("n_a"), percent)) \
        .select("a", F.col("node").alias("b")).distinct()
    maps = candidates.select("node", "n", *_MAP)

    def mapped(side: str) -> DataFrame:
        return maps.withColumnsRenamed({"node": side, "n": f"n_{side}"} | {m: f"{side}{m[1:]}" for m in _MAP})
    stars = stars.join(mapped("b"), "b").join(mapped("a"), "a") \
        .filter(_maps_allow(F.col("n_a"), F.col("n_b"), "a", "b", percent)).select("a", "b")
    links = stored(_verified(stars, candidates, shingle, percent), "similar")
    so_far = components(links)

    # What stars leave open: signatures whose sets are in several components.
    # First a share of these signatures, and for each set and other component
    # only the set whose map is nearest; most of what links is one then.
    here = _open_rows(candidates, so_far, centre, maps, FIRST_SHARE)
    nearest = _across(here, percent).groupBy("b", "component").agg(F.min_by("a", "differ").alias("a")).select("a", "b")
    links = links.unionByName(stored(_verified(nearest, candidates, shingle, percent), "similar"))
    # Then every pair that is left. Sets that share a signature and also the
    # one before it in both lists have met there.
    here = _open_rows(candidates, components(links), centre, maps)
    rest = _across(here, percent, (F.col("before") != F.col("before_b")) | F.col("before").isNull() | F.col("before_b").isNull())
    more = _verified(rest.select("a", "b").distinct(), candidates, shingle, percent)
    whole = components(links.unionByName(more))

    # The smallest id of each component, then of each row.
    labelled = nodes.join(whole, "node", "left").select("node", "id", "first", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"), F.min("first").alias("first"))
    of_node = labelled.select("node", "component").join(least, "component").select("node", "component_id", "first")
    stands = F.col("id").eqNullSafe(F.col("first.id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
    linked = rows.join(of_node, "node").select("id", "text_hash", F.col("n").alias("n_shingles"), "component_id", stands.alias("stands"))
    empty = described.filter((F.col("kind") == _KIND_ROW) & (F.col("n") == 0)) \
        .select("id", "text_hash", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("stands"))
    return linked.unionByName(empty)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component in ``found`` (what
    near_duplicates gave), also where ids are null or repeated; of repeated rows
    one. What goes is stored first, so that Spark knows its size when it picks
    the join."""
    keys = found.groupBy("id", "text_hash").agg(F.count("*").alias("rows"), F.first("stands").alias("stands"))
    keys = stored(keys.filter((F.col("rows") > 1) | ~F.col("stands")), "duplicates") \
        .withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    same = docs[id_col].eqNullSafe(F.col("__id")) & F.xxhash64(docs[text_col]).eqNullSafe(F.col("__hash"))
    kept = docs.join(keys, same, "left_anti")
    repeated = keys.filter("stands")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


#: All sets are compared through shared shingles; components by recursion.
OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON least.a = d.doc_id
"""
