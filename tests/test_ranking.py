"""Property: the distributed exact rank equals a plain sort, whatever the
group sizes (including one hot group and NULL groups) and partitioning."""

from hypothesis import given, settings
from hypothesis import strategies as st

from parityframe.functions.hashing import hash32
from parityframe.operators.ranking import exact_rank


@settings(max_examples=4, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", None]), min_size=1, max_size=120),
       st.integers(min_value=1, max_value=9), st.integers(min_value=2, max_value=16))
def test_exact_rank_matches_sort(spark, groups, parts, bits):
    rows = [(i, g) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(parts)
    df = df.withColumn("h", hash32(7, "k"))
    got = {r.k: r.rn for r in exact_rank(df, ["g"], "h", ["k"], "rn", bucket_bits=bits).collect()}
    hv = {r.k: r.h for r in df.collect()}
    want = {}
    for g in set(groups):
        ks = sorted((hv[k], k) for k, gg in rows if gg == g)
        for i, (_, k) in enumerate(ks):
            want[k] = i + 1
    assert got == want
