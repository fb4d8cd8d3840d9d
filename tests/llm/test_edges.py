"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, for every operator and stage."""

import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from parityframe.llm import queries

LONG = " ".join(f"w{i % 7919} x{i * 31 % 104729}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ITEM = "what is the capital of the largest country on the second smallest continent of all"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "block", "node", "n_words", "n_tokens", "score", "labels", "kept_text", "words", "print", "ids", "n_lines", "part"]


def _rows():
    texts = [None, "", " \n\t ", "one", "the MIT License\nthe MIT License", LONG, LONG, LONG + " tail", PASSAGE + " a", "b " + PASSAGE,
             f"Q: {ITEM}?", "É À ß ñ", "you idiot scum trash", "\n\n\n", "a" * 300_000, "x\x00y z"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(100 + i, "same line\n" + f"own {i}", "en", "s", 1) for i in range(12)]
    rows += [(None, "no id here", "en", "s", 1), (None, None, None, None, None), (3, "one", "en", "s", 3),
             (200, PASSAGE, "en", "s", 1), (200, "another text of the same id", "en", "s", 1)]
    return rows


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for name, rows, extra in (("odd", _rows(), False), ("clash", _rows(), True), ("empty", [], False)):
        d = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame(rows, SCHEMA)
        if extra:
            docs = docs.withColumns({c: F.lit(f"extra {c}") for c in CLASH})
        docs.write.parquet(os.path.join(d, "documents.parquet"))
        items = [(1, ITEM), (2, None), (3, ""), (4, "no id"), (None, "without an id"), (5, "single")] if rows else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(d, "benchmark.parquet"))
        marks = [(12, 1, 1), (3, 1, 0), (None, 1, 1), (7, 1, 0)] if rows else []
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
        pages = [(i, f"http://a{i % 3}.net/en/{i}", "h") for i in range(9)] + [(3, None, None), (None, "x", "")] if rows else []
        talks = [(c, t, "user" if t % 2 else "assistant", f"said {t}.") for c in range(7) for t in range(c)] + [
            (3, None, None, None), (None, 1, "user", "x"), (6, 1, "user", "said 1.")] if rows else []
        for table, found, schema in (("pages", pages, "page_id long, url string, html string"),
                                     ("conversations", talks, "conv_id long, turn long, role string, text string")):
            df = spark.createDataFrame(found, schema)
            if extra:
                df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASH + ["host", "rule", "verdict", "pos", "mid", "phase", "depth"]})
            df.write.parquet(os.path.join(d, f"{table}.parquet"))
        made[name] = d
    return made


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, folders, name):
    run = queries.QUERIES[name]

    def results(df):
        if name != "op8_packed_tokens":
            return sorted(map(tuple, df.collect()), key=repr)
        # Rows follow the tasks; the pieces in them don't.
        return sorted([(d, o, r.ids[4 * a:4 * b]) for r in df.collect()
                       for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:])], key=repr)
    odd = run(spark, folders["odd"])
    got = results(odd)
    assert results(run(spark, folders["clash"])) == got
    rows = {"op8_packed_tokens": None, "op11_url_filter": 11, "op12_prefix_trie": None, "op13_structure_repair": 7}.get(name, len(_rows()))
    assert rows is None or len(got) == rows
    none = run(spark, folders["empty"])
    assert none.count() == 0 and none.schema.names == odd.schema.names


def _by_id(df):
    return {r[0]: r for r in df.collect() if r[0] not in (None, 3, 200)}


def test_defined_results(spark, folders):
    d, q = folders["odd"], queries.QUERIES
    op1 = _by_id(q["op1_decontamination"](spark, d))
    assert (op1[0].n_words, op1[0].n_hit, op1[10].n_hit, op1[10].n_items) == (0, 0, 15, 1)
    op2 = _by_id(q["op2_ngram_jaccard"](spark, d))
    assert (op2[0].n_shingles, op2[0].component_id) == (0, 0) and op2[6].component_id == op2[7].component_id == 5
    op3 = _by_id(q["op3_line_dedup"](spark, d))
    assert (op3[0].n_lines, op3[0].n_dropped) == (1, 0) and (op3[100].n_lines, op3[100].n_dropped) == (2, 1)
    op7 = _by_id(q["op7_substring_dedup"](spark, d))
    assert op7[6].n_removed == op7[6].n_words == 120_000 and op7[9].n_removed == 60 and op7[8].n_removed == 0
    op9 = _by_id(q["op9_license_scan"](spark, d))
    assert (op9[4].n_base, op9[4].first_word, op9[4].last_word) == (2, 1, 4) and op9[0].first_word is None
    op10 = _by_id(q["op10_fingerprints"](spark, d))
    assert op10[5].fingerprint == op10[6].fingerprint and op10[5].n_chars == len(LONG)


def test_pipeline_stages(spark, folders):
    for d in (folders["odd"], folders["clash"], folders["empty"]):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.stored(stage(spark, docs, d), "stage")
            if i + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == columns
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0


def test_pipeline_by_brute_force(spark):
    """Each stage on the smallest tables against a plain Python version."""
    from tests.llm import plain
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else kept
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "stage")
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in queries.QUERIES["op6_toxicity"](spark, sf).collect()}
            want = {i: t for i, t in before.items() if not scores[i]}
        elif name == "line dedup":
            want = plain.without_frequent_lines(before, 10)
        elif name == "n-gram Jaccard join":
            stands = plain.components(before, 5, 80)      # the stage's own shingles and similarity
            want = {i: t for i, t in before.items() if stands[i] == i}
        elif name == "benchmark decontamination":
            want = {i: t for i, t in before.items() if not plain.contaminated(t, items)}
        else:
            want = before
        if name == "byte-level BPE":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
        else:
            got = docs.collect()
            assert {r.doc_id: r.text for r in got} == want
            if name != "toxicity":
                assert all(r.n_chars == len(r.text) for r in got)
            kept = want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_keeps_all_and_fits(lengths):
    from parityframe.llm.packing import best_fit_decreasing
    rows = best_fit_decreasing(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= 64 for r in rows)
    # Against a plain search for the fullest row that takes the piece.
    free, want = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(64 - n)
            want += 1
    assert len(rows) == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), max_size=12),
       st.sets(st.integers(0, 400), max_size=12), st.sets(st.integers(0, 400), max_size=400))
def test_linked_sets_share_a_signature(base, less, more, frequent):
    from parityframe.llm import wordhash as wh
    from parityframe.llm.ngram_join import signatures

    def hashed(numbers):
        return np.sort(wh.mix(np.array(sorted(numbers), dtype=np.uint64) + np.uint64(7)))
    x, y = set(base), (set(base) - less) | more
    if x != y and y and 100 * len(x & y) >= 85 * len(x | y):
        hot = hashed(frequent) if frequent else np.zeros(0, np.uint64)
        assert set(signatures(hashed(x), hot, 85).tolist()) & set(signatures(hashed(y), hot, 85).tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ñ\n", max_size=60), max_size=8))
def test_word_hashes_tell_words(texts):
    from parityframe.llm import wordhash as wh
    column = pa.array(texts, pa.string())
    ln, table = wh.lane(5, wh.SPACES, lower=False), wh.word_table(wh.SPACES)
    for a, b, data, offsets in wh.text_slices(column, limit=40):
        w = wh.find_words(data, offsets, table)
        want = [x for t in texts[a:b] for x in t.split()]
        h = wh.word_hashes(w, ln).tolist()
        assert len(h) == len(want) and np.diff(w.first).tolist() == [len(t.split()) for t in texts[a:b]]
        assert all((h[i] == h[j]) == (want[i] == want[j]) for i in range(len(h)) for j in range(i))


def test_components(spark):
    from parityframe.llm.components import components
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 100), (7, 7), (200, 100)] + [(1000, i) for i in range(300, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 31)} | {50: 50, 100: 50, 200: 50} | {i: 300 for i in range(300, 400)} | {1000: 300}
    assert got == want


def test_nnpu_learns_from_positives_and_unlabelled():
    from parityframe.llm.toxicity import nnpu_fit
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    ones = np.c_[truth & (rng.random(4000) < 0.9), rng.random(4000) < 0.5]
    positives = np.flatnonzero(truth)[:200]
    matrix = np.r_[ones[positives], ones]
    rows, columns = np.nonzero(matrix)
    weights, bias = nnpu_fit(rows, columns, np.r_[np.ones(200, bool), np.zeros(4000, bool)], 2, 0.2)
    score = 1 / (1 + np.exp(-(ones @ weights + bias)))
    assert ((score >= 0.5) == truth).mean() > 0.95


def test_automaton_markup():
    from parityframe.llm.licenses import Automaton, Template, words_of
    a = Automaton((Template("t", "one two <<beginOptional>>three<<endOptional>> <<var;2>> four"),))

    def accepts(text):
        tokens = [a.token.get(w, 0) for w in words_of(text)]
        return bool(a.run(tokens, 0, len(tokens)))
    assert accepts("One two x four") and accepts("one TWO three x y four") and accepts("one two three four four")
    assert not accepts("one two four") and not accepts("one two x y z four") and not accepts("one three x four")


def test_line_runs_in_batches(spark):
    from parityframe.llm.lines import LineRuns, drop_lines
    docs = spark.createDataFrame([(i, f"same\nrow {i % 7}\nonly {i}") for i in range(40)], "doc_id long, text string")
    runs = LineRuns(spark, min_docs=6, fan=2)
    for i in range(5):
        runs.add(docs.filter(F.col("doc_id") % 5 == i))
    assert len(runs.levels) > 1
    for bound in (0, 100):
        cut = {r.doc_id: r.text for r in drop_lines(docs, runs.frequent(), broadcast_keys=bound).collect()}
        assert cut == {i: f"only {i}" if i % 7 < 5 else f"row {i % 7}\nonly {i}" for i in range(40)}


def test_stored_line_runs_are_merged_as_they_lie(spark):
    """Old runs meet new keys and each other without being shuffled or sorted,
    whatever the session's setting, which stays as it was."""
    from parityframe.llm.lines import LineRuns, _stored_order, merged_pair
    setting = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    docs = spark.createDataFrame([(i, f"same\nrow {i % 7}\nonly {i}") for i in range(40)], "doc_id long, text string")
    runs = LineRuns(spark, min_docs=6, fan=2, buckets=3)
    for i in range(3):
        runs.add(docs.filter(F.col("doc_id") % 3 == i))
    assert spark.conf.get(setting) == "false"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]

    def steps(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [plan.count(s) for s in ("Exchange hash", "Sort [", "SortMergeJoin")]
    with _stored_order(spark):
        assert steps(merged_pair(runs.levels[0][0], runs.levels[1][0])) == [0, 0, 1]
        # One exchange and one sort: the new batch's own keys.
        assert steps(runs.new_keys(docs)) == [1, 1, 1]
    whole = {(r.a, r.b) for r in runs.frequent().collect()}
    one = LineRuns(spark, min_docs=6, fan=3, buckets=5)
    one.add(docs)
    assert {(r.a, r.b) for r in one.frequent().collect()} == whole and len(whole) == 1 + 5


def test_near_copies_of_one_text(spark, monkeypatch):
    """A text, its copies with edits at random places, a passage that other
    texts share, short texts: components as plain comparison finds them, with
    most shingles frequent and without the broadcast."""
    from parityframe.llm import ngram_join as nj
    from tests.llm import plain
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(120):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 7)):
            words[at] = f"edit{i}x{at}"
        texts[i] = " ".join(words)
    for i in range(120, 170):
        texts[i] = " ".join(base[:40] + [f"own{i}w{j}" for j in range(rng.integers(1, 60))])
    for i in range(170, 220):
        texts[i] = " ".join(f"s{j}" for j in rng.integers(0, 4, rng.integers(1, 9)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain.components(texts)
    assert len(set(want.values())) > 20
    for least, nodes in ((32, 1 << 20), (1, 0)):
        monkeypatch.setattr(nj, "FREQUENT_FROM", least)
        monkeypatch.setattr(nj, "BROADCAST_NODES", nodes)
        got = nj.near_duplicates(docs)
        assert {r.id: r.component_id for r in got.collect()} == want
    twice = docs.unionByName(docs.filter("doc_id < 30"))
    kept = nj.one_of_each(twice, nj.near_duplicates(twice))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
