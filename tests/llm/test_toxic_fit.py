"""What the toxicity fit counts, draws and does with few examples."""

import numpy as np
import pytest

from parityframe.llm import toxicity as tx

PLAIN, BAD = "some plain words of text", "vile scum talk"


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, f"{BAD} no{i}" if i % 10 == 0 else f"{PLAIN} no{i}") for i in range(400)]
    marks = [(i, int(i % 10 == 0)) for i in range(200)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def _watch(monkeypatch):
    """The arguments of each fit."""
    seen, fit = [], tx.nnpu_fit

    def nnpu_fit(rows, columns, toxic, *args, **kw):
        seen.append((toxic, kw.get("times", np.ones(len(toxic)))))
        return fit(rows, columns, toxic, *args, **kw)
    monkeypatch.setattr(tx, "nnpu_fit", nnpu_fit)
    return seen


def test_features_are_counted_over_all_documents(spark, tables, monkeypatch):
    """However few rows are drawn for the fit, the places are the same."""
    docs, marks = tables
    seen = _watch(monkeypatch)
    whole = tx.fit_toxicity(docs, marks, least_sigmas=2.0)
    few = tx.fit_toxicity(docs, marks, max_unlabelled=100, least_sigmas=2.0)
    assert whole.places.tolist() == few.places.tolist() and len(whole.places)
    assert [int((~t).sum()) for t, _ in seen][0] == 400 and 60 < (~seen[1][0]).sum() < 140


def test_a_repeated_id_cannot_fill_the_sample(spark, tables, monkeypatch):
    docs, marks = tables
    hot = spark.range(3000).selectExpr("10L as doc_id", f"'{BAD} hot' as text")
    seen = _watch(monkeypatch)
    tx.fit_toxicity(docs.unionByName(hot), marks, max_positives=50, max_unlabelled=100, least_sigmas=0.5)
    toxic, times = seen[0]
    assert len(toxic) < 150 and 35 < times[toxic].sum() < 65 and 70 < times[~toxic].sum() < 130
    assert times[~toxic].max() in (88, 89)  # 3000 of 3400, of 100


def test_few_positives_reject_nothing(spark, tables):
    docs, marks = tables
    few = marks.filter("doc_id < 40")  # 4 toxic ones
    fitted = tx.fit_toxicity(docs, few, least_sigmas=0.0)
    assert not len(fitted.places)
    assert {(r.score, r.predicted) for r in tx.score_toxicity(docs, fitted).collect()} == {(0.0, 0)}
