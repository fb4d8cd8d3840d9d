"""Label encoding with a kept code map.

The fitted state is a DataFrame ``(column, value, code)``: the sorted distinct
values of each string column numbered 0..n-1 (code-point order, which equals
Python's ``sorted``). All columns are fitted from one scan via an unpivot: the
distinct (column, value) pairs are sorted by range partitions and numbered
within them, plus the rows of the same column in earlier partitions, so no
task holds a column's whole value list. The map is stored once; it is measured
before it is applied: a small one is broadcast, a large one meets narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parityframe.session import checkpoint as _ckpt


@dataclass(frozen=True)
class LabelEncoding:
    mapping: DataFrame          # (column string, value string, code int)
    sizes: dict                 # column -> number of classes

    @property
    def total(self) -> int:
        return sum(self.sizes.values())


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def encoder_map(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """E1/E2 map: ``(column, value, code)`` for every column."""
    cols = list(columns) if columns is not None else string_columns(df)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("s")
    ).select("s.column", "s.value").where(F.col("value").isNotNull()).distinct()
    # Stored, so that counts and rows see the same partitions.
    ranged = _ckpt(long.repartitionByRange("column", "value").withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("column", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("column").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("column", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("column", "__part").orderBy("value")
    numbered = ranged.withColumn("__rn", F.row_number().over(inside)).join(offsets, ["column", "__part"])
    return numbered.select("column", "value", (F.col("__before") + F.col("__rn") - 1).cast("int").alias("code"))


def fit_label_encoder(df: DataFrame, columns: Sequence[str] | None = None) -> LabelEncoding:
    """Fit E1/E2: the stored map and the number of classes per column."""
    cols = list(columns) if columns is not None else string_columns(df)
    mapping = _ckpt(encoder_map(df, cols))
    sizes = {r["column"]: int(r["n"]) for r in mapping.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return LabelEncoding(mapping, {c: sizes.get(c, 0) for c in cols})


#: Entries and bytes of a map that is broadcast; a larger one meets narrow rows.
BROADCAST_ENTRIES, BROADCAST_BYTES = 1 << 20, 64 << 20


def _is_small(mapping: DataFrame, entries: int, most_bytes: int) -> bool:
    row = mapping.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 16).alias("b")).first()
    return row["n"] <= entries and (row["b"] or 0) <= most_bytes


def _looked_up(df: DataFrame, mapping: DataFrame, columns: Sequence[str], by: str, give: str, entries: int, most_bytes: int) -> DataFrame:
    """``df`` plus, for each of ``columns``, ``__got_<place>``: what the map gives for
    it (null if nothing). A small map is broadcast, so no row moves. Beyond the bound
    only (row number, column, value) meets the map, once for all columns, and comes
    back as one row of codes; whole rows move once, however many columns there are.
    The table is stored first, so that its row numbers hold."""
    cols = list(columns)
    key = {c: F.col(f"`{c}`").cast("string" if by == "value" else "int") for c in cols}
    if _is_small(mapping, entries, most_bytes):
        out = df
        for i, c in enumerate(cols):
            m = mapping.where(F.col("column") == c).select(F.col(by).alias("__by"), F.col(give).alias(f"__got_{i}"))
            out = out.withColumn("__key", key[c]).join(F.broadcast(m), F.col("__key") == F.col("__by"), "left").drop("__key", "__by")
        return out
    kept = _ckpt(df.withColumn("__row", F.monotonically_increasing_id()))
    long = kept.select("__row", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), key[c].alias("key")) for c in cols])).alias("s")).select("__row", "s.*").where("key IS NOT NULL")
    met = long.join(mapping.select("column", F.col(by).alias("key"), F.col(give).alias("__got")), ["column", "key"])
    narrow = met.groupBy("__row").agg(*[F.max(F.when(F.col("column") == c, F.col("__got"))).alias(f"__got_{i}") for i, c in enumerate(cols)])
    return kept.join(narrow, "__row", "left").drop("__row")


def apply_label_encoder(df: DataFrame, enc: LabelEncoding, unseen: str = "error", entries: int = BROADCAST_ENTRIES,
                        most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """E1 transform: replace each fitted column by its integer code.
    ``unseen='error'`` fails on a value absent from the map; ``'null'``
    gives NULL. NULL stays NULL."""
    if unseen not in ("error", "null"):
        raise ValueError("unseen must be 'error' or 'null'")
    cols = list(enc.sizes)
    found = _looked_up(df, enc.mapping, cols, "value", "code", entries, most_bytes)
    out = {}
    for i, c in enumerate(cols):
        code = F.col(f"__got_{i}")
        if unseen == "error":
            code = F.when(F.col(f"`{c}`").isNotNull() & code.isNull(),
                          F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.col(f"`{c}`").cast("string")))).otherwise(code)
        out[c] = code.cast("int").alias(c)
    return found.select(*[out.get(x, F.col(f"`{x}`")) for x in df.columns])


def decode_columns(df: DataFrame, mapping: DataFrame, columns: Sequence[str], entries: int = BROADCAST_ENTRIES,
                   most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Replace integer codes by their values (NULL for unknown codes)."""
    cols = list(columns)
    found = _looked_up(df, mapping, cols, "code", "value", entries, most_bytes)
    out = {c: F.col(f"__got_{i}").alias(c) for i, c in enumerate(cols)}
    return found.select(*[out.get(x, F.col(f"`{x}`")) for x in df.columns])
