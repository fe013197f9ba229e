"""Approximate nearest neighbours by inner product: balanced posting lists and an in-memory centroid graph.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm of all, so that the largest inner product is the
smallest distance. Centroids are fitted on a sample of at most ``sample_rows`` distinct vectors (a documented bound; large
clusters are split, so lists are balanced); every vector is indexed. A vector goes to its nearest centroid's list and, on
a boundary, to others whose distance is within ``1 + closure`` of the nearest, unless such a centroid is much nearer to one
that it has already. Centroids are linked in a graph of nearest and random neighbours, searched best first in batches, for vectors
and queries alike and at every size. A query takes all lists whose centroid lies within ``1 + prune`` of its nearest one (squared distances), and in any case enough of
them to hold TOP + 1 vectors.

Equal vectors are one entry with the TOP + 1 smallest ids of their group, the only ones that a tie can ever return, and
equal queries are searched once; so a hot vector makes no hot list. Lists are dealt to buckets of about PART entries by list
and by entry, and a bucket meets at most about PART queries at once. The driver and each task hold centroids and sizes of lists:
there is a list for each ``list_rows`` vectors up to ``most_lists``, and beyond that lists grow and are cut into buckets' shares.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most take no
part, as queries or candidates; so do rows without id. Of rows that share an id each may be found, and none finds its own
id. Scores are sums in double precision, in order of component; ties go to the smaller id. No query gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PART = 8_192


@dataclass
class Index:
    """What tasks need of a fitted index: centroids, their graph, M, and closure and pruning factors."""

    centroids: np.ndarray
    graph: np.ndarray
    largest: float
    closure: float
    prune: float
    copies: int
    beam: int

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest**2 - (x**2).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]]).astype(np.float32)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of about the k nearest centroids of each row, by best-first search of the graph, whatever
        its size; places that no centroid fills have distance infinity."""
        count, beam = len(self.centroids), max(48, k)
        rows = np.arange(len(x))[:, None]
        entry = np.unique(np.linspace(0, count - 1, 16).astype(np.int64))
        ids = np.tile(entry, (len(x), 1))
        d = distances(x, self.centroids[entry])
        seen = np.zeros((len(x), count), dtype=bool)
        seen[:, entry] = True
        done = np.zeros_like(ids, dtype=bool)
        while not done.all():
            at = np.argsort(np.where(done, np.inf, d), axis=1, kind="stable")[:, :4]
            open_ = ~np.take_along_axis(done, at, axis=1)
            np.put_along_axis(done, at, True, axis=1)
            near = self.graph[np.take_along_axis(ids, at, axis=1)]
            fresh = np.broadcast_to(open_[:, :, None], near.shape).reshape(len(x), -1).copy()
            near = near.reshape(len(x), -1)
            fresh &= ~seen[rows, near]
            seen[rows, near] |= fresh
            order = np.argsort(near, axis=1, kind="stable")
            by_id = np.take_along_axis(near, order, axis=1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], by_id[:, 1:] == by_id[:, :-1], axis=1)
            new = np.where(fresh & ~twice, ((x[:, None, :] - self.centroids[near]) ** 2).sum(axis=2), np.inf)
            ids, d, done = np.hstack([ids, near]), np.hstack([d, new]), np.hstack([done, ~np.isfinite(new)])
            keep = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d, done = (np.take_along_axis(a, keep, axis=1) for a in (ids, d, done))
        return ids[:, :k], d[:, :k]

    def assign(self, x: np.ndarray) -> list[list[int]]:
        """Lists of each row: the nearest and those of the boundary, none within half the row's distance of one taken before."""
        ids, d = self.nearest(x, 4 * self.copies)
        out = []
        for own, dist in zip(ids.tolist(), d.tolist()):
            taken = [own[0]]
            for c, v in zip(own[1:], dist[1:]):
                if len(taken) == self.copies or v > (1 + self.closure) ** 2 * dist[0] + 1e-12:
                    break
                if all(4 * ((self.centroids[c] - self.centroids[t]) ** 2).sum() > v for t in taken):
                    taken.append(c)
            out.append(taken)
        return out

    def lists(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[list[int]]:
        """Lists to search for each query: all within the ratio, and at least as many as hold `least` vectors. The graph is
        searched with a beam that doubles until the ratio ends inside it."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0))] * len(q)
        todo, beam, count = np.arange(len(q)), min(self.beam, len(self.centroids)), len(self.centroids)
        while len(todo):
            ids, d = self.nearest(q[todo], beam)
            for row, own, dist in zip(todo.tolist(), ids, d):
                found[row] = own, dist
            todo = todo[d[:, -1] <= (1 + self.prune) * d[:, 0] + 1e-12] if beam < count else todo[:0]
            beam = min(2 * beam, count)
        out = []
        for row, (own, dist) in enumerate(found):
            own, dist = own[np.isfinite(dist)], dist[np.isfinite(dist)]
            many = int((dist <= (1 + self.prune) * dist[0] + 1e-12).sum())
            if sizes[own[:many]].sum() < least:
                enough = np.searchsorted(np.cumsum(sizes[own]), least) + 1
                if enough > len(own):
                    own = np.argsort(((q[row] - self.centroids) ** 2).sum(axis=1), kind="stable")
                    enough = np.searchsorted(np.cumsum(sizes[own]), least) + 1
                many = max(many, int(enough))
            out.append(own[:many].tolist())
        return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * x @ c.T, 0)


def clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means centroids of x; clusters over twice the mean size are then split in two, as long as that parts them."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()

    def owners() -> np.ndarray:
        return np.concatenate([np.argmin(distances(x[i : i + 4096], c), axis=1) for i in range(0, len(x), 4096)])

    for _ in range(rounds):
        own = owners()
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    own = owners()
    todo, more = [i for i, n in enumerate(np.bincount(own, minlength=len(c))) if n > 2 * len(x) / len(c)], []
    pending = [x[own == i] for i in todo]
    c = np.delete(c, todo, axis=0)
    while pending:
        part = pending.pop()
        a, b = part[rng.integers(len(part))], part[rng.integers(len(part))]
        for _ in range(4):
            side = ((part - a) ** 2).sum(axis=1) > ((part - b) ** 2).sum(axis=1)
            if not 0 < side.sum() < len(part):
                break
            a, b = part[~side].mean(axis=0), part[side].mean(axis=0)
        if not 0 < side.sum() < len(part):
            more.append(part.mean(axis=0))
            continue
        for half in (part[~side], part[side]):
            pending.append(half) if len(half) > 2 * len(x) / k else more.append(half.mean(axis=0))
    return np.vstack([c, *[m[None] for m in more]]).astype(np.float32)


def graph_of(c: np.ndarray, rng: np.random.Generator, near: int = 20, far: int = 6) -> np.ndarray:
    """For each centroid its nearest others and some random ones."""
    near = min(near, max(1, len(c) - 1))
    rows = []
    for i in range(0, len(c), 1024):
        d = distances(c[i : i + 1024], c)
        rows.append(np.argpartition(d, near, axis=1)[:, : near + 1] if len(c) > near + 1 else np.tile(np.arange(len(c)), (len(d), 1)))
    return np.hstack([np.vstack(rows), rng.integers(0, len(c), (len(c), far))])


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the rows that take part, as they are."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad: Column = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, list_rows: int = 256, sample_rows: int = 40_000, most_lists: int = 8_192, closure: float = 0.02, prune: float = 0.36, copies: int = 3, beam: int = 128, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` rows of vectors found nearest to each row of queries, both as of usable()."""
    spark = vectors.sparkSession
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = vectors.distinct().withColumn("place", place).where(F.col("place") <= top + 1)
    entries = written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "v", "ids"), "ann-entries")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = entries.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, sample_rows / stats["n"])
    sample = entries.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("entry").limit(sample_rows).select("v").toArrow()
    sample = np.asarray(sample["v"].combine_chunks().flatten(), dtype=np.float64).reshape(sample.num_rows, -1)
    rng = np.random.default_rng(seed)
    model = Index(np.zeros((1, 1)), np.zeros((1, 1)), float(np.sqrt(stats["m"])), closure, prune, copies, beam)
    x = model.lift(sample)
    model.centroids = clusters(x, max(1, min(most_lists, stats["n"] // list_rows, len(x))), rng)
    model.graph = graph_of(model.centroids, rng)
    sent = spark.sparkContext.broadcast(model)

    def matrix(column: pd.Series) -> np.ndarray:
        return np.array(column.tolist(), dtype=np.float64)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                rows = batch.iloc[i : i + 512]
                own = sent.value.assign(sent.value.lift(matrix(rows["v"])))
                yield rows.assign(list=own).explode("list").assign(home=[c == o[0] for o in own for c in o]).astype({"list": "int32"})

    postings = written(entries.mapInPandas(post, "entry long, v array<double>, ids array<long>, list int, home boolean"), "ann-postings")
    counts = np.zeros((2, len(model.centroids)), dtype=np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.when(F.col("home"), F.size("ids")).otherwise(0)).alias("home")).collect():
        counts[:, r["list"]] = r["n"], r["home"]
    sizes = spark.sparkContext.broadcast(counts)

    buckets = max(1, -(-int(counts[0].sum()) // PART))
    slices = -(-counts[0] // PART)  # a list above the bound is cut into as many buckets' shares

    def bucket_of(list_: np.ndarray, slice_: np.ndarray) -> np.ndarray:
        return (list_ * 7919 + slice_) % buckets

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                rows = batch.iloc[i : i + 512]
                out = []
                for query, v, own in zip(rows["query"], rows["v"], sent.value.lists(sent.value.lift(matrix(rows["v"]), query=True), sizes.value[1], top + 1)):
                    by: dict[int, set[int]] = {}
                    for c in own:
                        for k in range(int(slices[c])):
                            by.setdefault(int(bucket_of(c, k)), set()).add(c)
                    out += [(query, v, b, sorted(cs)) for b, cs in by.items()]
                yield pd.DataFrame(out, columns=["query", "v", "bucket", "lists"]).astype({"bucket": "int32"})

    asked = queries.groupBy("v").agg(F.min("id").alias("query"))
    asked = written(asked.select("query", "v").mapInPandas(select, "query long, v array<double>, bucket int, lists array<int>"), "ann-asked")
    turns = asked.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("turns"))
    left = asked.join(turns, "bucket").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int"))
    cuts = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(slices)], "list int, slices int"))
    share = F.pmod(F.xxhash64("entry"), F.greatest(F.col("slices"), F.lit(1)))
    right = postings.join(cuts, "list").withColumn("bucket", F.pmod(F.col("list").cast("long") * 7919 + share, F.lit(buckets)).cast("int")).join(turns, "bucket")
    right = right.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))

    def compare(asking: pd.DataFrame, having: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(having):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "ids": pd.Series(dtype=object)})
        having = having.sort_values(["list", "entry"])
        v, ids, entry = matrix(having["v"]), having["ids"].tolist(), having["entry"].to_numpy()
        first = dict(zip(*np.unique(having["list"].to_numpy(), return_index=True)))
        size = dict(zip(*np.unique(having["list"].to_numpy(), return_counts=True)))
        found = []
        for query, q, own in zip(asking["query"], asking["v"], asking["lists"]):
            q = np.asarray(q, dtype=np.float64)
            at = np.concatenate([np.arange(first[c], first[c] + size[c]) for c in own if c in first] or [np.zeros(0, dtype=np.int64)])
            if not len(at):
                continue
            rough = v[at] @ q
            if len(at) > 4 * top + 4:
                least = np.partition(rough, len(at) - 4 * top - 4)[len(at) - 4 * top - 4]
                at = at[rough >= least - 1e-9 * max(1.0, abs(least))]
            at = at[np.unique(entry[at], return_index=True)[1]]
            scores = np.zeros(len(at))
            for j in range(len(q)):
                scores += v[at, j] * q[j]
            best = np.argsort(-scores, kind="stable")[: top + 1]
            found += [(query, scores[b], ids[at[b]]) for b in best]
        return pd.DataFrame(found, columns=["query", "score", "ids"])

    keys = ["bucket", "turn"]
    found = left.select(*keys, "query", "v", "lists").groupBy(*keys).cogroup(right.select(*keys, "list", "entry", "v", "ids").groupBy(*keys)).applyInPandas(compare, "query long, score double, ids array<long>")
    found = found.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("k", best).where(F.col("k") <= top + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "score"))).alias("found"))
    named = queries.distinct().join(asked.select("query", F.col("v").alias("qv")).distinct(), F.col("v") == F.col("qv")).select("id", "query")
    others = named.join(found, "query").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, top).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
