"""Ordered values: the cut plan gives what the plain plan gives."""

import random

from pyspark.sql import functions as F

from galeframe.operators import ordered as o

def values():
    return {
        "prev": o.previous("v"),
        "next": o.following("v"),
        "top": o.whole(F.max, F.col("v")),
        "low": o.whole(F.min, F.col("v")),
        "pos": o.position(),
        "n": o.row_count(),
        "running": o.running_sum(F.col("v")),
        "before": o.last_known(F.col("w")),
        "after": o.next_known(F.col("w")),
    }


def sample(spark):
    """One key with a third of all rows, ties in time, and missing values."""
    rng = random.Random(7)
    out = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rng.randrange(1, 60)
        out.append((key, rng.randrange(40), i, rng.randrange(1000), rng.choice([None, rng.randrange(9)])))
    return spark.createDataFrame(out, "k int, t int, seq int, v int, w int")


def test_cut_and_plain_plans_agree(spark, rows):
    df = sample(spark)
    plain = rows(o.with_ordered(df, ["k"], ["t", "seq"], values()))
    spark.conf.set("galeframe.hot.rows", "25")
    spark.conf.set("galeframe.hot.pieces", "64")
    try:
        hot = o.hot_keys(df, ["k"])
        assert hot.rows.count() >= 1
        pieces = o.cut_hot_keys(df, ["k"], F.col("t"), hot.rows)
        cut_into = pieces.filter("k = 0").select("_piece").distinct().count()
        assert cut_into > 5
        cut = rows(o.with_ordered(df, ["k"], ["t", "seq"], values()))
    finally:
        spark.conf.unset("galeframe.hot.rows")
        spark.conf.unset("galeframe.hot.pieces")
    assert cut == plain


def test_no_hot_key_means_one_shuffle_and_no_join(spark):
    out = o.with_ordered(sample(spark), ["k"], ["t", "seq"], {"prev": o.previous("v"), "pos": o.position()})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Join" not in plan


def test_parts_are_bounded_and_complete(spark):
    df = o.in_parts(sample(spark), ["k"], ["t", "seq"], 50)
    sizes = [r["count"] for r in df.groupBy("k", "part").count().collect()]
    assert max(sizes) == 50 and sum(sizes) == 900
