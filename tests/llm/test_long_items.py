"""Benchmark items of any length: what is broadcast does not carry them."""

import pytest
from pyspark.sql import functions as F

from parityframe.llm import decontamination as dc


def test_rows_do_not_grow_with_the_item(spark):
    words = [f"w{i * i % 9973}x{i}" for i in range(50_000)]
    items = spark.createDataFrame([(1, words)], "item_id long, words array<string>")
    size = dc._item_prints(items, 10).agg(F.count("*").alias("n"), F.max(F.size("item_words")).alias("most")).first()
    assert 10_000 < size.n <= 50_000 and size.most <= 16


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_passages_of_a_long_item_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", most)
    words = [f"w{i % 211}q{i}" for i in range(3000)]
    texts = {i: " ".join(["before"] * (i % 4) + words[at:at + n] + ["after"] * (i % 3))
             for i, (at, n) in enumerate([(0, 10), (1, 9), (2990, 10), (2991, 9), (1500, 40), (0, 3000), (777, 11)])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.id: r.n_hit for r in dc.contamination(docs, items).collect()}
    assert got == {0: 10, 1: 0, 2: 10, 3: 0, 4: 40, 5: 3000, 6: 11}
