"""The pipeline's near-duplicate stage: five-word shingles, 80 percent."""

import numpy as np

import corpus_pipeline


def _linked(x, y):
    a, b = ({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (x.split(), y.split()))
    return 100 * len(a & b) >= 80 * len(a | b)


def _stay(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_a_fifth_cut_or_appended_goes(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:405])), (3, " ".join(words[95:])),
            (4, " ".join(words + [f"more{i}" for i in range(120)])), (5, " ".join(words[:390]))]
    assert [_linked(rows[0][1], t) for _, t in rows[1:]] == [True, True, True, False]
    assert _linked(rows[1][1], rows[4][1])  # so 5 goes by way of 2
    assert _stay(spark, rows) == [1]
    assert _stay(spark, [rows[0], rows[4]]) == [1, 5]


def test_stage_against_plain_comparison(spark):
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for i in range(120):
        words = list(base[:int(rng.integers(100, 151))])
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = f"edit{i}x{at}"
        texts[i] = " ".join(words)
    for i in range(120, 160):
        texts[i] = " ".join(f"s{j}" for j in rng.integers(0, 3, rng.integers(1, 9)))
    root = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if root[i] != root[j] and _linked(texts[i], texts[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    want = sorted(i for i, r in root.items() if i == r)
    assert 10 < len(want) < 150
    assert _stay(spark, list(texts.items())) == want


def test_one_document_of_each_component(spark):
    """Also where all ids of a component are null, or several texts have one id."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words + [x]) for x in ("a", "b", "c"))
    rows = [(None, a), (None, b), (None, b), (None, "other text without an id at all"), (None, None), (None, None)]
    rows += [(7, a.replace("w", "v")), (7, b.replace("w", "v")), (8, c.replace("w", "v")), (7, "a text of its own under the same id")]
    rows += [(None, a.replace("w", "u")), (9, b.replace("w", "u")), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted((i, (t or "")[:2]) for i, t in kept if i) == [(7, "a "), (7, "v0"), (9, ""), (9, "u0")]
    assert sorted((t or "")[:2] for i, t in kept if not i) == ["", "ot", "w0"]
    assert (9, b.replace("w", "u")) in kept
