"""Benchmark decontamination (operator 1), DataFrame functions only.

Finds the words of a document inside any 10 consecutive words of a benchmark
item (an item of fewer words is one window).

Method
------
*Winnowing.* Both sides hash every run of k words (k = 4) and keep the
smallest hash of each 10 - k + 1 consecutive runs. Two texts that share 10 words
share the smallest hash within them, so joining the fingerprints misses no
shared window, while a document gives few rows. *Extension.* Each matched
fingerprint is placed in both texts and every item window around it is
compared word by word, so hash collisions don't count. Items shorter than 10
words go the same way with windows of their own length, once for each length
that occurs (nine at most).

The benchmark's fingerprints are broadcast if their counted number is at most
``broadcast_rows``; words then stay within a task until a fingerprint matches.
Beyond it documents' fingerprints are joined by shuffle without their words
(AQE splits hot ones) and only matched documents are read again.

Defined results: a null or empty text has no words and no hits; benchmark rows
without id or words are left out; equal items and repeated rows give each
their result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parityframe.llm.common import read_table, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z. lower() does the same, much faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def run_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each word on, as far as k words remain."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(hashed, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def winnowed(hashes: Column, window: int) -> Column:
    """The distinct smallest hashes of all ``window`` consecutive ones."""
    if window == 1:
        return F.array_distinct(hashes)
    smallest = F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)),
                           lambda i: F.array_min(F.slice(hashes, i, window)))
    return F.when(F.size(hashes) >= window, F.array_distinct(smallest)).otherwise(F.array().cast("array<bigint>"))


def _shape(length: int) -> tuple[int, int]:
    """(k, window) for item windows of ``length`` words."""
    k = min(4, length)
    return k, length - k + 1


def _places(hashes: Column, h: Column) -> Column:
    """Places (from 0) of h among hashes."""
    marked = F.transform(hashes, lambda x, i: F.when(x == h, i))
    return F.filter(marked, lambda i: i.isNotNull())


def _prints(rows: DataFrame, length: int) -> DataFrame:
    k, window = _shape(length)
    rows = rows.withColumn("hashes", run_hashes(F.col("words"), k))
    return rows.withColumn("print", F.explode(winnowed(F.col("hashes"), window)))


def _item_prints(items: DataFrame, length: int) -> DataFrame:
    """(print, item_id, item_words, q): the item's words around the run, as far as
    windows that hold it reach, and the run's place in them. What a row carries
    does not grow with its item."""
    _, window = _shape(length)
    at = _prints(items, length).select("print", "item_id", "words", F.explode(_places(F.col("hashes"), F.col("print"))).alias("at"))
    at = at.withColumn("low", F.greatest(F.lit(0), F.col("at") - (window - 1)))
    return at.select("print", "item_id", F.slice("words", F.col("low") + 1, F.col("at") + length - F.col("low")).alias("item_words"),
                     (F.col("at") - F.col("low")).alias("q"))


def _starts(length: int) -> Column:
    """Starts in the document of the item's windows that hold the matched run
    (at q of the item): every place of the run, every window around it,
    compared word by word."""
    _, window = _shape(length)
    q, words, item = F.col("q"), F.col("words"), F.col("item_words")

    def around(p: Column) -> Column:
        def same(back: Column) -> Column:
            fits = (back <= q) & (back <= p) & (q - back + length <= F.size(item)) & (p - back + length <= F.size(words))
            return F.when(fits, F.slice(words, p - back + 1, length) == F.slice(item, q - back + 1, length)) \
                .otherwise(F.lit(False))
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(window - 1)), same), lambda back: p - back)
    return F.flatten(F.transform(_places(F.col("hashes"), F.col("print")), around))


_HIT = ("id", "text_hash", "n_words", "item_id", "start", "length")


#: Bytes of the items' words that are broadcast at most.
BROADCAST_BYTES = 64 << 20


def _may_broadcast(item_prints: DataFrame, rows: int) -> bool:
    size = item_prints.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("item_words", " "))).alias("b")).first()
    return size["n"] <= rows and (size["b"] or 0) <= BROADCAST_BYTES


def _hits(docs: DataFrame, items: DataFrame, length: int, broadcast_rows: int) -> DataFrame:
    """_HIT columns of every window of ``items`` (item_id, words) that a
    document holds, and a row without item for every document."""
    item_prints = _item_prints(items, length)
    doc_words = docs.withColumn("words", split_words(F.col("text"))).drop("text")
    n_words = F.size("words").cast("long").alias("n_words")
    nothing = F.array(F.lit(None).cast("int"))
    if _may_broadcast(item_prints, broadcast_rows):
        k, window = _shape(length)
        prints = doc_words.withColumn("hashes", run_hashes(F.col("words"), k)).withColumn(
            "print", F.explode(F.array_append(winnowed(F.col("hashes"), window), F.lit(None).cast("long"))))
        matched = prints.join(F.broadcast(item_prints), "print", "left") \
            .filter(F.col("print").isNull() | F.col("item_id").isNotNull())
        starts = F.when(F.col("item_id").isNull(), nothing).otherwise(_starts(length))
        return matched.select("id", "text_hash", n_words, "item_id", F.explode(starts).alias("start"),
                              F.lit(length).alias("length"))
    slim = _prints(doc_words, length).select("id", "text_hash", "print").join(item_prints, "print").distinct() \
        .withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    again = doc_words.dropDuplicates(["id", "text_hash"]).withColumn("hashes", run_hashes(F.col("words"), _shape(length)[0]))
    matched = again.join(slim, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    return matched.select("id", "text_hash", n_words, "item_id", F.explode(_starts(length)).alias("start"),
                          F.lit(length).alias("length")) \
        .unionByName(doc_words.select("id", "text_hash", n_words, F.lit(None).cast("long").alias("item_id"),
                                      F.lit(None).cast("int").alias("start"), F.lit(length).alias("length")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", length: int = 10,
                  broadcast_rows: int = 200_000) -> DataFrame:
    """(id, text_hash, n_words, n_hit, items) for every row of ``docs``; items
    are the sorted ids, as strings, of the items with a window in the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), split_words(F.col(item_text_col)).alias("words")) \
        .filter(F.col("item_id").isNotNull() & (F.size("words") > 0))
    shape = F.least(F.size("words"), F.lit(length))
    lengths = sorted(r[0] for r in items.select(shape).distinct().collect())  # ``length`` rows at most
    rows_and_hits = None
    for n in lengths or [length]:
        hits = _hits(rows, items.filter(shape == n), n, broadcast_rows)
        if rows_and_hits is not None:
            hits = hits.filter(F.col("item_id").isNotNull())  # the first has all documents
        rows_and_hits = hits if rows_and_hits is None else rows_and_hits.unionByName(hits)
    rows_and_hits = stored(rows_and_hits.select(*_HIT), "benchmark-hits")  # short rows; the texts are read once
    counted = rows_and_hits.filter(F.col("item_id").isNull()).select("id", "text_hash", "n_words")
    found = rows_and_hits.filter(F.col("item_id").isNotNull()).drop("n_words").distinct()
    covered = found.select("id", "text_hash", F.explode(F.expr("sequence(start, start + length - 1)")).alias("place")) \
        .distinct().groupBy("id", "text_hash").agg(F.count("*").alias("n_hit"))
    named = found.groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))

    def attached(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
        return left.join(right, F.col("id").eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__hash")),
                         "left").drop("__id", "__hash")
    return attached(attached(counted, covered), named).select(
        "id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark. The keys that
    go are stored first, so that Spark knows their size when it picks the join."""
    gone = stored(contamination(docs, benchmark, id_col, text_col).filter("n_hit > 0")
                  .select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__id"))
                     & F.xxhash64(docs[text_col]).eqNullSafe(F.col("__hash")), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
  FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM starts),
places AS (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
  FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (
  SELECT doc_id, item_id, i, p.n AS n
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM places) p JOIN windows USING (n, k)),
covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS spot FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
