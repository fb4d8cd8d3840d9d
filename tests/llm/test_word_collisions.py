"""Words that a polynomial modulo 2**64 takes for equal whatever its base."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parityframe.llm import queries
from parityframe.llm import wordhash as wh

ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = ONE.translate(str.maketrans("ab", "ba"))
SAME = [f"w{i}" for i in range(12)]


def _rows():
    texts = [[*SAME, ONE], [*SAME, OTHER], [ONE, *SAME[:6], ONE.upper(), *SAME[6:]], [OTHER, *SAME[:6], OTHER, *SAME[6:]],
             [ONE, OTHER] * 20, [OTHER, ONE] * 20, [*SAME, ONE], [ONE * 3], [OTHER * 3], [ONE.upper() * 3]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op7_substring_dedup"])
def test_rows_are_those_of_sql(spark, tmp_path, name):
    spark.createDataFrame(_rows(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


@pytest.mark.parametrize("lower", [True, False])
def test_long_words_hash_as_words(lower):
    words = [ONE, OTHER, ONE.upper(), "é" * 40, "É" * 40, "x" * 31, "x" * 32, "x" * 33, "X" * 33, ONE]
    for at in (1 << 19, 40):
        found = []
        for _, _, data, offsets in wh.text_slices(pa.array([" ".join(words[:5]), " ".join(words[5:])]), limit=at):
            found += wh.word_hashes(wh.find_words(data, offsets, wh.word_table(wh.SPACES)), wh.lane(3, wh.SPACES, lower)).tolist()
        folded = [w.translate({c: c + 32 for c in range(65, 91)}) if lower else w for w in words]
        assert np.array_equal(np.equal.outer(found, found), [[a == b for b in folded] for a in folded])
