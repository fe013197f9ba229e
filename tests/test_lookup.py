"""Interval index, latest rows and nearest values against loops over all rows, hot keys and stretches included."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lookup

START = datetime.date(1999, 12, 25)


def day(n):
    return None if n is None else START + datetime.timedelta(n)


@pytest.mark.parametrize("span", [0, 7, 3000])
def test_valid_row_equals_loop(spark, span):
    rnd = random.Random(span)
    some = lambda n: rnd.randint(-n, n) if rnd.random() < 0.9 else None
    cards = [(rnd.choice(["hot", "hot", "b", None]), i, s, None if rnd.random() < 0.2 or s is None else s + rnd.randint(-3, 2 * span + 3)) for i in range(150) for s in [some(span + 3)]]
    asked = [(i, rnd.choice(["hot", "hot", "b", "c", None]), some(span)) for i in range(300)]
    left = spark.createDataFrame([(i, k, day(d)) for i, k, d in asked], "i int, key string, day date")
    right = spark.createDataFrame([(k, i, day(s), day(e)) for k, i, s, e in cards], "key string, id int, s date, e date")
    latest = {r.i: r.id for r in lookup.as_of(left, right, ["key"], "day", "s", "e", ["id"], "id").collect()}
    first = {r.i: r.id for r in lookup.valid_row(left, right, ["key"], "day", "s", "e", ["id"], [F.col("id")]).collect()}
    for i, k, d in asked:
        fit = [(-s, c) for key, c, s, e in cards if k is not None and key == k and d is not None and s is not None and s <= d and (e is None or d <= e)]
        assert latest[i] == (min(fit)[1] if fit else None) and first[i] == (min(c for _, c in fit) if fit else None)
    assert lookup.as_of(left.where("day is null"), right, ["key"], "day", "s", "e", ["id"], "id").where("id is not null").collect() == []
    assert lookup.as_of(left, right.where("false"), ["key"], "day", "s", "e", ["id"], "id").where("id is not null").collect() == []


def test_latest_and_nearest_equal_loops(spark):
    rnd = random.Random(4)
    some = lambda n: rnd.randint(0, n) if rnd.random() < 0.95 else None
    held = [(rnd.choice(["hot", "hot", "b", None]), some(700), i) for i in range(200)]
    asked = [(i, rnd.choice(["hot", "hot", "b", "c", None]), some(900)) for i in range(300)]
    left = spark.createDataFrame([(i, k, day(d), d and d * 1.0) for i, k, d in asked], "i int, key string, day date, value double").withColumn("value", F.coalesce("value", F.when(F.col("day").isNotNull(), 0.0)))
    right = spark.createDataFrame([(k, day(d), None if d is None else d * 1.0, i) for k, d, i in held], "key string, at date, v double, id int")
    latest = {r.i: r.id for r in lookup.latest_before(left, right, ["key"], "day", "at", ["id"], "id").collect()}
    near = {r.i: r.id for r in lookup.nearest_value(left, right.where("v is not null"), ["key"], "value", "v", ["id"], "id", 40.0).collect()}
    for i, k, d in asked:
        own = [(v, c) for key, v, c in held if key == k and k is not None and v is not None]
        before = [(-v, c) for v, c in own if d is not None and v <= d]
        assert latest[i] == (min(before)[1] if before else None)
        assert near[i] == (min((abs(v - d) if d is not None else 0, c) for v, c in own)[1] if own else None)
