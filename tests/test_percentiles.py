"""Exact percentiles of large keys against the plain aggregate and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.operators import grid_stats, layers
from galeframe.operators.percentiles import percentiles

PROBS = [0.0, 0.05, 0.5, 0.6, 0.95, 0.99, 1.0]


@pytest.fixture
def small_tasks(spark):
    spark.conf.set("galeframe.hot.rows", "60")
    yield
    spark.conf.unset("galeframe.hot.rows")


def fields():
    rng = np.random.default_rng(3)
    return {
        "even": rng.random(5000),
        "tail": np.exp(rng.standard_normal(4000) * 6),
        "ties": rng.integers(0, 4, 3000).astype(float),
        "same": np.full(500, 2.5),
        "signs": np.append(rng.standard_normal(900), [1e308, -1e308, 1.7e308, -1.7e308]),
        "close": 1.0 + np.arange(800) * 2.0**-52,
        "few": rng.random(20),
        None: rng.standard_normal(700),
    }


def table(spark):
    rows = [(k, float(x)) for k, v in fields().items() for x in v]
    rows += [("even", None), ("even", float("nan")), ("none", None), ("none", float("nan"))]
    return spark.createDataFrame(rows, "k string, value double")


def test_large_keys(spark, small_tasks):
    got = {r["k"]: r for r in percentiles(table(spark), ["k"], F.col("value"), PROBS).collect()}
    assert set(got) == {*fields(), "none"}
    assert got["none"]["_q"] is None and got["none"]["_lo"] is None
    for k, v in fields().items():
        v = np.sort(v)
        at = [(len(v) - 1) * p for p in PROBS]
        expected = [v[int(a)] if a == int(a) else (1 - (a - int(a))) * v[int(a)] + (a - int(a)) * v[int(a) + 1] for a in at]
        assert got[k]["_q"] == pytest.approx(expected, rel=1e-12), k
        assert (got[k]["_lo"], got[k]["_hi"]) == (v[0], v[-1])


def test_same_as_the_plain_aggregate(spark):
    rows = table(spark).where("k IN ('even', 'ties', 'few', 'none') OR k IS NULL")
    plain = {r["k"]: r["_q"] for r in percentiles(rows, ["k"], F.col("value"), PROBS).collect()}
    spark.conf.set("galeframe.hot.rows", "60")
    try:
        cut = {r["k"]: r["_q"] for r in percentiles(rows, ["k"], F.col("value"), PROBS).collect()}
    finally:
        spark.conf.unset("galeframe.hot.rows")
    assert set(plain) == set(cut)
    for k, q in plain.items():
        assert cut[k] == (q if q is None else pytest.approx(q, rel=1e-12))


def test_ranges_and_levels_of_large_fields(spark, small_tasks):
    cells = table(spark).where("k IN ('even', 'same', 'ties')")
    ranges = {r["k"]: (r["range_low"], r["range_high"]) for r in grid_stats.value_range(cells, ["k"]).collect()}
    for k in ("even", "ties"):
        assert ranges[k] == pytest.approx(tuple(np.quantile(fields()[k], [0.05, 0.95])))
    assert ranges["same"] == (2.5, 2.5)
    levels = [r["level"] for r in grid_stats.contour_levels(cells.where("k = 'even'"), ["k"]).orderBy("level_no").collect()]
    assert levels == pytest.approx(np.round(np.quantile(fields()["even"], grid_stats.CONTOUR_QUANTILES), 3))
    shown = layers.shown_rain(cells, ["k"])
    assert shown.columns == ["k", "value", "shown"] and shown.count() == cells.count()


def test_no_values(spark, small_tasks):
    assert percentiles(table(spark).limit(0), ["k"], F.col("value"), PROBS).count() == 0
