"""Exact quantiles of groups, however few the groups and many their values: values are counted, and ranks found over ranges of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(keys, names): the linear quantile of value at each fraction; null for groups without a value. Null keys are a group.

    Equal values are counted first, with sums on the map side. Distinct values are dealt by ranges of (keys, value), so that one group may
    lie in many tasks; a range's counts are added up in order, and what earlier ranges of the group hold is carried over.
    """
    own = {k: f"_g{n}" for n, k in enumerate(keys)}
    groups = list(own.values())
    counted = rows.groupBy(*[F.col(k).alias(g) for k, g in own.items()], F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = written(counted.repartitionByRange(*groups, "_v").withColumn("_part", F.spark_partition_id()), "quantile-counts")
    known = dealt.where("_v is not null")
    pieces = known.groupBy(*groups, "_part").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*groups)).alias("_all"))
    local = Window.partitionBy(*groups, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = lambda a, b, more: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in [*groups, *more]))
    ranked = known.withColumn("_upto", F.sum("_n").over(local)).alias("r").join(starts.alias("s"), same("r", "s", ["_part"]))
    ranked = ranked.select(*[F.col(f"r.{g}") for g in groups], "_v", "_all", (F.col("_before") + F.col("_upto")).alias("_upto"), (F.col("_before") + F.col("_upto") - F.col("r._n")).alias("_from"))
    picked = []
    for n, f in enumerate(fractions):
        at = (F.col("_all") - 1) * f
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picked.append(F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("_v"))).alias(f"_{side}{n}"))
    found = ranked.groupBy(*groups).agg(F.max("_all").alias("_all"), *picked)
    every = dealt.select(*groups).distinct()
    met = every.alias("e").join(found.alias("f"), same("e", "f", []), "left")
    share = [(F.col("_all") - 1) * f - F.floor((F.col("_all") - 1) * f) for f in fractions]
    return met.select(*[F.col(f"e.{g}").alias(k) for k, g in own.items()], *[(F.col(f"_lo{n}") + (F.col(f"_hi{n}") - F.col(f"_lo{n}")) * s).alias(name) for n, (s, name) in enumerate(zip(share, names))])


def winsorized(rows: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """rows with the value cut to its group's linear quantiles."""
    bounds = quantiles(rows, keys, value, (low, high), ("_low", "_high"))
    return rows.join(bounds, keys).withColumn(f"{value}_winsorized", F.least(F.greatest(F.col(value), F.col("_low")), F.col("_high"))).drop("_low", "_high")
