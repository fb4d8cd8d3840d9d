"""Applying a code map: broadcast or by narrow rows, the same rows."""

import pytest

from parityframe.operators import encode as en

ROWS = [(i, f"v{i % 7}" if i % 5 else None, f"w{i % 3}", f"x{i % 11}", float(i)) for i in range(60)] + [(3, "v3", "w0", "x3", 3.0)]


def table(spark):
    return spark.createDataFrame(ROWS, "id int, `a.b` string, c string, d string, m double")


@pytest.mark.parametrize("entries", [1 << 20, 0])
def test_codes_there_and_back(spark, entries):
    df = table(spark)
    coder = en.fit_label_encoder(df, ["c", "d"])
    coded = en.apply_label_encoder(df, coder, entries=entries)
    values = {"c": sorted({r[2] for r in ROWS}), "d": sorted({r[3] for r in ROWS})}
    want = sorted((i, a or "", values["c"].index(c), values["d"].index(d), m) for i, a, c, d, m in ROWS)
    assert sorted((r.id, r["a.b"] or "", r.c, r.d, r.m) for r in coded.collect()) == want and coded.columns == df.columns
    back = en.decode_columns(coded, coder.mapping, ["c", "d"], entries=entries)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


@pytest.mark.parametrize("entries", [1 << 20, 0])
def test_unseen_values(spark, entries):
    coder = en.fit_label_encoder(table(spark).where("id < 2"), ["c"])
    got = en.apply_label_encoder(table(spark), coder, "null", entries=entries)
    assert got.where("c IS NULL").count() == sum(r[2] == "w2" for r in ROWS)
    with pytest.raises(Exception, match="unseen value in c: w2"):
        en.apply_label_encoder(table(spark), coder, entries=entries).collect()


def test_shuffles_do_not_grow_with_columns(spark):
    df = table(spark)

    def exchanges(columns, entries):
        coder = en.fit_label_encoder(df, columns)
        plan = en.apply_label_encoder(df, coder, entries=entries)._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("Initial Plan")[-1]
        return plan.count("Exchange hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(["c"], 0) == exchanges(["c", "d"], 0) > 0 and exchanges(["c", "d"], 1 << 20) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
