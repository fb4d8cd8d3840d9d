"""Class rebalancing.

All draws are portable hashes of (seed, tag, group, slot), so results do not
depend on partitioning and match an independent SQL implementation.
Slots are generated where the work already is (one slot per row of the
larger class, or ``spark.range`` for a given count), never by exploding a
large count inside one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityframe.functions.hashing import TWO_32, hash32, require_unique_key
from parityframe.operators.joins import keyed_join
from parityframe.operators.neighbors import knn_same_class
from parityframe.operators.ranking import exact_rank
from parityframe.session import checkpoint as _ckpt


#: Slots that one row expands to, or is joined to on average, at most.
SLOT_CHUNK = 4096


# ---------------------------------------------------------------- I5, I6
def group_bootstrap(df: DataFrame, groups: Sequence[str], label: str, key_cols: Sequence[str],
                    seed: int = 42, tie: str = "bootstrap", draw_key: str | None = None) -> DataFrame:
    """Inside each combination of ``groups``, draw the smaller class
    with replacement up to the size of the larger one and keep the larger
    class as is; groups with one class (or NULL keys) are dropped.

    On a tie the negatives are redrawn (``tie='bootstrap'``, the
    reference's branch) or both classes are kept (``tie='keep'``).

    Each row of the larger class is one draw slot: its pick is
    ``pmod(hash(seed, group, row key), n_small) + 1``, joined to the small
    class ranked by (hash, key) within the group. Slots are spread like the
    data; a hot group is split by the rank's hash buckets, and rows that are
    drawn very often are joined in copies.

    ``draw_key``: name of an extra output column holding, for drawn rows,
    the key of the slot row that drew them (NULL for kept rows), so
    (key, draw_key) identifies every output row even with repeated draws.
    """
    groups, keys = list(groups), list(key_cols)
    if df.isEmpty():
        raise ValueError("cannot resample an empty table")
    require_unique_key(df, keys)
    # Rows with another or no label have no class to balance.
    base = df.dropna(subset=groups).filter(F.col(label).isin(0, 1))
    counts = base.groupBy(*groups).agg(F.count_if(F.col(label) == 1).alias("__npos"),
                                       F.count_if(F.col(label) == 0).alias("__nneg"))
    counts = counts.where((F.col("__npos") > 0) & (F.col("__nneg") > 0))
    if tie == "keep":
        counts = counts.withColumn("__small", F.when(F.col("__npos") < F.col("__nneg"), F.lit(1))
                                   .when(F.col("__npos") > F.col("__nneg"), F.lit(0)))
    elif tie == "bootstrap":
        counts = counts.withColumn("__small", F.when(F.col("__npos") < F.col("__nneg"), F.lit(1)).otherwise(F.lit(0)))
    else:
        raise ValueError("tie must be 'bootstrap' or 'keep'")
    counts = counts.withColumn("__nsmall", F.when(F.col("__small") == 1, F.col("__npos")).otherwise(F.col("__nneg")))
    # A few rows that are drawn very often are joined in copies, one for each
    # SLOT_CHUNK draws that a row gets on average.
    counts = counts.withColumn("__copies", F.ceil(
        (F.col("__npos") + F.col("__nneg") - F.col("__nsmall")) / (F.col("__nsmall") * SLOT_CHUNK)).cast("int"))
    x = keyed_join(base, counts, groups)
    is_small = F.col(label) == F.col("__small")
    large = x.where(F.col("__small").isNull() | ~is_small)
    small = x.where(is_small)
    ranked = exact_rank(small.withColumn("__h", hash32(seed, *keys)), groups, "__h", keys, "__rn") \
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    slot_key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    draws = large.where(F.col("__small").isNotNull()).select(
        *groups, (F.pmod(hash32(f"{seed}|pick", *groups, *keys), F.col("__nsmall")) + 1).alias("__rn"),
        F.pmod(F.xxhash64(*keys), F.col("__copies")).cast("int").alias("__copy"), slot_key.alias("__slot_key"))
    drawn = keyed_join(draws, ranked.select(*df.columns, "__rn", "__copy"), groups + ["__rn", "__copy"])
    if draw_key is None:
        return large.select(*df.columns).unionByName(drawn.select(*df.columns))
    return (large.select(*df.columns, F.lit(None).cast("string").alias(draw_key))
            .unionByName(drawn.select(*df.columns, F.col("__slot_key").alias(draw_key))))


def balance_report(before: DataFrame, after: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    """``(groups..., label, n_before, n_after, status)`` with status
    'kept' or 'dropped' per group and class."""
    keys = list(groups) + [label]
    b = before.dropna(subset=list(groups)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_after"))
    j = keyed_join(b, a, keys, "full")
    return j.select(*keys, F.coalesce("n_before", F.lit(0)).cast("long").alias("n_before"),
                    F.coalesce("n_after", F.lit(0)).cast("long").alias("n_after"),
                    F.when(F.col("n_after").isNull(), F.lit("dropped")).otherwise(F.lit("kept")).alias("status"))


# ---------------------------------------------------------------------- I7
def sample_with_replacement(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows drawn with replacement. Slot s picks row rank
    ``pmod(hash(seed, 'pick', s), N) + 1``; slots come from ``spark.range``
    (distributed), ranks from :func:`exact_rank`."""
    keys = list(key_cols)
    total = df.count()
    if total == 0:
        raise ValueError("cannot sample from an empty table")
    require_unique_key(df, keys)
    spark = df.sparkSession
    ranked = exact_rank(df.withColumn("__h", hash32(seed, *keys)), [], "__h", keys, "__rn")
    slots = spark.range(1, n + 1).select(F.col("id").alias("__slot"),
                                         (F.pmod(hash32(f"{seed}|pick", "id"), F.lit(total)) + 1).alias("__rn"))
    return keyed_join(slots, ranked, ["__rn"]).select("__slot", *df.columns)


# ---------------------------------------------------------------- I1, I3, I4
def smote_need(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, need)``; need = majority count - n."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("need", (F.max("n").over(Window.partitionBy(F.lit(1))) - F.col("n")).cast("long"))


def smote(df: DataFrame, key: str, label: str, features: Sequence[str], k: int = 5, seed: int = 42,
          integer: str = "truncate", probe: int | None = None) -> DataFrame:
    """SMOTE. For each class below the majority count, ``need``
    synthetic rows ``x + u * (nb - x)`` where the base x, its neighbour nb
    (one of its k nearest same-class points) and u are drawn by portable
    hashes of (seed, class, slot). Originals are kept; output adds
    ``synthetic`` (bool), ``slot``, ``base_key``, ``nb_key``.

    Integer features of synthetic rows are truncated back to their type
    (``integer='truncate'``) or copied from the base row (``'base'``).
    Neighbours are searched only for bases that are actually drawn.
    ``probe`` searches that many nearest cells only (approximate: measure it with
    ``neighbors.recall``); a neighbour that it misses is replaced by a farther
    one of the same class, never by none while the cells hold k.
    """
    feats = list(features)
    require_unique_key(df, [key])
    need = smote_need(df, label)
    pts = df.select(key, label, *feats)
    ranked = exact_rank(pts.withColumn("__h", hash32(f"{seed}|rank", key)), [label], "__h", [key], "__rn")
    # Slots 1..need of each class: first numbers of chunks, dealt out, then the
    # chunks, so that no task expands a large class alone.
    chunks = need.filter("need > 0").select(
        label, "n", "need", F.explode(F.sequence(F.lit(0), F.col("need") - 1, F.lit(SLOT_CHUNK))).alias("__first"))
    slots = chunks.repartition(label, "__first").select(
        label, "n", F.explode(F.sequence(F.col("__first") + 1, F.least(F.col("need"), F.col("__first") + SLOT_CHUNK))).alias("slot"))
    others = F.least(F.lit(k), F.col("n") - 1)
    slots = slots.select(label, "slot",
                         (F.pmod(hash32(f"{seed}|base", label, "slot"), F.col("n")) + 1).alias("__rn"),
                         F.when(others > 0, F.pmod(hash32(f"{seed}|nb", label, "slot"), F.greatest(others, F.lit(1))) + 1)
                         .alias("__nb"),
                         (hash32(f"{seed}|u", label, "slot") / F.lit(TWO_32)).alias("__u"))
    originals = df.withColumns({"synthetic": F.lit(False), "slot": F.lit(None).cast("long"),
                                "base_key": F.lit(None).cast(df.schema[key].dataType),
                                "nb_key": F.lit(None).cast(df.schema[key].dataType)})
    base = keyed_join(slots, ranked.select(label, "__rn", F.col(key).alias("base_key"),
                                           *[F.col(f).alias(f"__b_{f}") for f in feats]), [label, "__rn"])
    base = base.transform(_ckpt)
    nbrs = knn_same_class(pts, key, label, feats, k=k, queries=base.select(F.col("base_key").alias(key)), probe=probe)
    nb = nbrs.select(F.col(key).alias("base_key"), F.col("nb_rank").cast("long").alias("__nb"), "nb_key")
    j = keyed_join(base, nb, ["base_key", "__nb"], "left")
    nb_feats = pts.select(F.col(key).alias("nb_key"), *[F.col(f).alias(f"__n_{f}") for f in feats])
    j = keyed_join(j, nb_feats, ["nb_key"], "left")
    cols = {}
    for f in feats:
        dt = df.schema[f].dataType
        b, nbv = F.col(f"__b_{f}").cast("double"), F.coalesce(F.col(f"__n_{f}"), F.col(f"__b_{f}")).cast("double")
        v = b + F.col("__u") * (nbv - b)
        if isinstance(dt, T.IntegralType):
            v = F.col(f"__b_{f}") if integer == "base" else v.cast(dt)
        cols[f] = v
    synth = j.select(F.lit(None).cast(df.schema[key].dataType).alias(key), label,
                     *[cols[f].alias(f) for f in feats], F.lit(True).alias("synthetic"), "slot", "base_key", "nb_key")
    other = [c for c in df.columns if c not in set([key, label] + feats)]
    for c in other:
        synth = synth.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    return originals.unionByName(synth.select(*originals.columns))
