"""Isolation forest: trees grown on a bounded sample, every row scored.

TREES trees of SAMPLE rows each are grown from the TREES * SAMPLE rows with the smallest hashes, which are all of them in a small table; that
bound does not depend on the table. A tree splits its rows at a random value of a random column until it has isolated them or is
log2(SAMPLE) deep. Trees are five arrays of numbers; a batch of rows goes down all of them at once, so scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE = 100, 256


def usual_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grown(rows: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (column, value, left, right, depth) of a tree; column -1 in a leaf, whose depth counts what it would take to isolate its rows."""
    deepest, nodes = int(np.ceil(np.log2(max(2, len(rows))))), []

    def grow(own: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + float(usual_depth(len(own)))))
        low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(0), np.zeros(0))
        able = np.flatnonzero(high > low)
        if depth < deepest and len(able):
            column = int(rng.choice(able))
            value = float(rng.uniform(low[column], high[column]))
            below = own[:, column] < value
            if below.any():  # a value at the lower end would part nothing
                nodes[at] = (column, value, grow(own[below], depth + 1), grow(own[~below], depth + 1), 0.0)
        return at

    grow(rows, 0)
    return nodes


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, size: int = SAMPLE, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.size, self.roots, nodes = min(size, len(sample)), [], []
        for _ in range(trees if len(sample) else 0):
            own = grown(sample[rng.choice(len(sample), self.size, replace=False)], rng)
            self.roots.append(len(nodes))
            nodes += [(c, v, a + self.roots[-1], b + self.roots[-1], d) for c, v, a, b, d in own]
        self.column, self.value, self.left, self.right, self.depth = (np.array(x) for x in zip(*nodes)) if nodes else (np.zeros(0),) * 5

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean depth / usual depth): near 1 for what is soon alone, about a half or less for the usual."""
        if not self.roots or self.size < 2:
            return np.full(len(rows), 0.5)
        at = np.tile(np.array(self.roots), (len(rows), 1))
        while (inner := self.column[at] >= 0).any():
            value = np.take_along_axis(rows, np.maximum(self.column[at], 0), axis=1)
            at = np.where(inner, np.where(value < self.value[at], self.left[at], self.right[at]), at)
        return 2.0 ** -(self.depth[at].mean(axis=1) / float(usual_depth(self.size)))


def isolation_scores(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """rows with anomaly_score; null where one of columns (numbers) is null or NaN. The sample is drawn by hash of key and columns."""
    numbers = [F.col(c).cast("double") for c in columns]
    known = F.lit(True)
    for c in numbers:
        known = known & c.isNotNull() & ~F.isnan(c)
    drawn = rows.where(known).select(*[c.alias(f"c{n}") for n, c in enumerate(numbers)], F.xxhash64(key, *columns).alias("h")).orderBy("h", *[f"c{n}" for n in range(len(numbers))]).limit(TREES * SAMPLE)
    forest = rows.sparkSession.sparkContext.broadcast(Forest(drawn.drop("h").toPandas().to_numpy(float).reshape(-1, len(columns))))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            table = np.column_stack([p.to_numpy(float) for p in (part if isinstance(part, tuple) else (part,))])
            fine = ~np.isnan(table).any(axis=1)
            out = np.full(len(table), np.nan)
            for at in range(0, len(table), 2_000):
                own = np.flatnonzero(fine[at : at + 2_000]) + at
                out[own] = forest.value.scores(table[own]) if len(own) else out[own]
            yield pd.Series(out)

    return rows.withColumn("anomaly_score", F.when(known, score(*numbers)))
