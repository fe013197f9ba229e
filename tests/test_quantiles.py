"""Quantiles against numpy, hot groups and nulls included."""

import random

import numpy as np
import pytest

from ledgerloom.operators import quantiles


def test_quantiles_equal_numpy(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, 1.0, 2.5, rnd.random() * 100])) for _ in range(900)] + [("one", 7.0), ("none", None)]
    got = {r.k: (r.a, r.b) for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", (0.05, 0.5), ("a", "b")).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        own = [v for key, v in rows if key == k and v is not None]
        assert got[k] == (pytest.approx(tuple(np.quantile(own, [0.05, 0.5]))) if own else (None, None))
