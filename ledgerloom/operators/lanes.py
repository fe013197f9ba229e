"""Matching invoice lines with approved lanes and executed references: exact keys, fuzzy candidates, weighted similarity.

Similarities are computed once for each distinct (origin, destination, vehicle, unit) of the lines, and candidates meet through
words of places or through equal ends, so that work follows distinct combinations and not lines times lanes. What shares no word
with any lane has, by the rule, every lane as a candidate: such keys are scanned against lanes in blocks of BLOCK keys, and a task
that has seen its lanes hands on only those that can be among a key's best.
"""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, places
from . import lookup
from .shared import written

BLOCK = 10_000
#: A key's lines are scored in shares of about this many rows.
SHARE = 50_000
#: Largest bonus that a rate may add to a lane's score, and what rounding may be off.
RATE_BONUS, SLACK = 0.12, 1e-9
KEY = ["origin", "destination", "vehicle", "unit"]


def normalized(rows: DataFrame) -> DataFrame:
    """rows with o, d, v, u: normal forms of the four parts of a lane."""
    return rows.withColumns({"o": places.place(F.col("origin")), "d": places.place(F.col("destination")), "v": places.vehicle(F.col("vehicle")), "u": places.unit(F.col("unit"))})


def exact(lines: DataFrame, lanes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct keys of lines with lane_id, method and confidence by exact key, reversed key, alias key, reversed alias key.

    Of lanes with one key the last counts (largest lane_id); aliases (raw_place, normal_place) replace normal places.
    """
    known = normalized(lanes).groupBy("o", "d", "v", "u").agg(F.max("lane_id").alias("lane_id"))
    names = aliases.groupBy("raw_place").agg(F.max("normal_place").alias("normal_place"))
    keys = normalized(lines.select(*KEY).distinct())
    for side in ("o", "d"):
        keys = keys.join(names.select(F.col("raw_place").alias(f"_{side}"), F.col("normal_place").alias(f"alias_{side}")), F.col(side) == F.col(f"_{side}"), "left").drop(f"_{side}")
        keys = keys.withColumn(f"alias_{side}", F.coalesce(f"alias_{side}", side))
    tiers = (("EXACT_NORM_KEY", 1.0, "o", "d"), ("REVERSED_KEY", 0.97, "d", "o"), ("ALIAS_KEY", 0.98, "alias_o", "alias_d"), ("ALIAS_REVERSED_KEY", 0.96, "alias_d", "alias_o"))
    tries = keys.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(m).alias("method"), F.lit(c).alias("confidence"), F.col(a).alias("to"), F.col(b).alias("td")) for i, (m, c, a, b) in enumerate(tiers)])).alias("t"))
    hits = tries.join(known.select(F.col("o").alias("ko"), F.col("d").alias("kd"), F.col("v").alias("kv"), F.col("u").alias("ku"), "lane_id"), (F.col("t.to") == F.col("ko")) & (F.col("t.td") == F.col("kd")) & (F.col("v") == F.col("kv")) & (F.col("u") == F.col("ku")))
    best = hits.groupBy(*KEY).agg(F.min_by(F.struct("lane_id", "t.method", "t.confidence"), "t.tier").alias("m")).select(*KEY, "m.*")
    return lines.select(*KEY).distinct().join(best, KEY, "left")


def candidates(keys: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, lane_id) that are scored, and the keys (key) that meet all lanes. Lanes that share a word of either end; without any
    such at the origin those that share one at the destination, and the other way round only if the destination has no words; all
    lanes if that leaves none."""
    ends = {}
    for side, own, other in (("o", "ot", "lot"), ("d", "dt", "ldt")):
        ends[side] = keys.select("key", F.explode(own).alias("t")).join(known.select("lane_id", F.explode(other).alias("t")), "t").select("key", "lane_id").distinct()
    lost_o = keys.select("key").join(ends["o"].select("key").distinct(), "key", "left_anti")
    found = ends["o"].join(ends["d"], ["key", "lane_id"])
    found = found.unionByName(ends["d"].join(lost_o, "key", "left_semi")).unionByName(ends["o"].join(keys.where(F.size("dt") == 0).select("key"), "key", "left_semi"))
    return found, keys.select("key").join(found.select("key").distinct(), "key", "left_anti")


def _scored(pairs: DataFrame, top: int) -> DataFrame:
    """(key, lane_id, lane_rate, raw, direction, relaxed) of the lanes of each key that can be among the best `top` of any line.

    Before a sequence ratio is computed, a pair's score lies between what words and bonuses alone give and that plus the largest
    ratios that the lengths of both texts allow; what cannot reach a key's `top`-th lower bound is dropped.
    """
    base, lane_base = F.split("v", " ")[0], F.split("lv", " ")[0]
    fits = (F.col("v") == F.col("lv")) | (base == lane_base)
    bonus = F.when(F.col("v") == F.col("lv"), 0.08).when(fits, 0.04).otherwise(0.0) + F.when(F.col("u") == F.col("lu"), 0.03).otherwise(0.0)
    some = Window.partitionBy("key")
    gated = pairs.withColumn("fits", fits).withColumn("some", F.max("fits").over(some)).where("fits or not some")
    longest = lambda a, b: F.when((F.char_length(a) + F.char_length(b)) == 0, 1.0).otherwise(2 * F.least(F.char_length(a), F.char_length(b)) / (F.char_length(a) + F.char_length(b)))

    def score(ratio, way: str) -> Column:
        (lo, lot), (ld, ldt) = (("lo", "lot"), ("ld", "ldt")) if way == "f" else (("ld", "ldt"), ("lo", "lot"))
        end = lambda a, b, at, bt: 0.65 * numbers.similarity_of_sets(F.col(at), F.col(bt)) + 0.35 * ratio(F.col(a), F.col(b))
        return 0.5 * end("o", lo, "ot", lot) + 0.5 * end("d", ld, "dt", ldt) + bonus - (0.0 if way == "f" else 0.02)

    none = lambda a, b: F.lit(0.0)
    bounded = gated.withColumns({"least": F.greatest(score(none, "f"), score(none, "b")), "most": F.greatest(score(longest, "f"), score(longest, "b"))})
    whole = some.orderBy(F.desc("least")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = bounded.withColumn("nth", F.nth_value("least", top).over(whole)).where(f"nth is null or most >= nth - {RATE_BONUS + SLACK}")
    scored = near.select("key", "lane_id", "lane_rate", score(places.sequence_ratio, "f").alias("f"), score(places.sequence_ratio, "b").alias("b"), (~F.col("some")).alias("relaxed"))
    ranked = scored.select("key", "lane_id", "lane_rate", F.greatest("f", "b").alias("raw"), F.when(F.col("b") > F.col("f"), "REVERSED").otherwise("FORWARD").alias("direction"), "relaxed")
    return able(ranked, top)


def able(ranked: DataFrame, top: int) -> DataFrame:
    """Of a key's lanes those within the largest rate bonus of its `top`-th score: no other is among the best of any line."""
    by_raw = Window.partitionBy("key").orderBy(F.desc("raw")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranked.withColumn("nth", F.nth_value("raw", top).over(by_raw)).where(f"nth is null or raw >= nth - {RATE_BONUS + SLACK}").drop("nth")


def _scanned(lost: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """_scored() for keys that meet all lanes: blocks of BLOCK keys go to every task of lanes, which hands on what can matter."""
    asked = lost.select("key", "o", "d", "v", "u", "ot", "dt").withColumn("n", F.row_number().over(Window.partitionBy(F.pmod("key", F.lit(64))).orderBy("key")))
    asked = asked.withColumn("block", F.floor(F.col("n") * 64 / BLOCK)).drop("n")
    found = None
    for r in asked.select("block").distinct().orderBy("block").toLocalIterator():  # one for each BLOCK keys
        own = asked.where(F.col("block") == r["block"]).drop("block").toPandas()
        part = _scan_block(own, known, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return known.select(F.lit(0).cast("long").alias("key"), "lane_id", "lane_rate", F.lit(0.0).alias("raw"), F.lit("").alias("direction"), F.lit(False).alias("relaxed")).where("false")
    # A task relaxes the vehicle where none of its own lanes fits; only where none of all tasks' does it count.
    return able(found.withColumn("strict", F.min("relaxed").over(Window.partitionBy("key"))).where("relaxed = strict").drop("strict"), top)


def _scan_block(asked: pd.DataFrame, known: DataFrame, top: int) -> DataFrame:
    shared = known.sparkSession.sparkContext.broadcast(asked)  # at most some BLOCK rows
    kind = known.schema["lane_id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ratios = list(shared.value.itertuples(index=False)), {}
        best: dict[tuple, list] = {}

        def ratio(a: str, b: str) -> float:
            if (a, b) not in ratios:
                if len(ratios) > 500_000:
                    ratios.clear()
                ratios[a, b] = difflib.SequenceMatcher(None, a, b).ratio()
            return ratios[a, b]

        def end(a: str, b: str, at, bt) -> float:
            at, bt = set(at), set(bt)
            return 0.65 * (len(at & bt) / len(at | bt) if at and bt else 1.0 if not at and not bt else 0.0) + 0.35 * ratio(a, b)

        for batch in batches:
            for lane in batch.itertuples(index=False):
                for k in keys:
                    fits = k.v == lane.lv or k.v.split(" ")[0] == lane.lv.split(" ")[0]
                    bonus = (0.08 if k.v == lane.lv else 0.04 if fits else 0.0) + (0.03 if k.u == lane.lu else 0.0)
                    f = 0.5 * end(k.o, lane.lo, k.ot, lane.lot) + 0.5 * end(k.d, lane.ld, k.dt, lane.ldt) + bonus
                    r = 0.5 * end(k.o, lane.ld, k.ot, lane.ldt) + 0.5 * end(k.d, lane.lo, k.dt, lane.lot) + bonus - 0.02
                    held = best.setdefault((k.key, not fits), [[], []])  # the `top` best scores, and lanes that may count
                    (heapq.heappush if len(held[0]) < top else heapq.heappushpop)(held[0], max(f, r))
                    if len(held[0]) < top or max(f, r) >= held[0][0] - RATE_BONUS - SLACK:
                        held[1].append((max(f, r), lane.lane_id, lane.lane_rate, "REVERSED" if r > f else "FORWARD"))
                        if len(held[1]) > 4 * top + 1_000 and len(held[0]) == top:
                            held[1] = [x for x in held[1] if x[0] >= held[0][0] - RATE_BONUS - SLACK]
        rows = [(key, x[1], x[2], x[0], x[3], relaxed) for (key, relaxed), (nth, held) in best.items() for x in held if len(nth) < top or x[0] >= nth[0] - RATE_BONUS - SLACK]
        yield pd.DataFrame(rows, columns=["key", "lane_id", "lane_rate", "raw", "direction", "relaxed"])

    return known.select("lane_id", "lane_rate", "lo", "ld", "lv", "lu", "lot", "ldt").mapInPandas(scan, f"key long, lane_id {kind}, lane_rate double, raw double, direction string, relaxed boolean")


def fuzzy(lines: DataFrame, lanes: DataFrame, top: int = 5) -> DataFrame:
    """The `top` lanes of each line (line_id, KEY, rate): (line_id, lane_id, place, score, direction, relaxed), best first; ties:
    the smaller lane_id. lanes: lane_id, KEY and rate.

    Of a key's lanes only those can be among the best of any line that come within the largest rate bonus of the key's
    `top`-th score without it. Lines and these lanes meet by key, a key's lines in shares of about SHARE rows, and a
    share's scores are one matrix of which `top` a row are kept, so pairs of lines and lanes are never shuffled or sorted.
    """
    keys = normalized(lines.groupBy(*KEY).agg(F.ceil(F.count("*") / SHARE).alias("shares")))
    keys = written(keys.withColumns({"key": F.xxhash64(*KEY), "ot": places.tokens(F.col("o")), "dt": places.tokens(F.col("d"))}), "lane-keys")
    known = normalized(lanes).select("lane_id", F.col("rate").cast("double").alias("lane_rate"), *[F.col(c).alias(f"l{c}") for c in "odvu"])
    known = written(known.withColumns({"lot": places.tokens(F.col("lo")), "ldt": places.tokens(F.col("ld"))}), "lanes")
    met, lost = candidates(keys, known)
    ranked = _scored(met.join(keys.drop("shares"), "key").join(known, "lane_id"), top).unionByName(_scanned(written(keys.drop("shares").join(lost, "key", "left_semi"), "lane-keys-lost"), known, top))
    ranked = written(ranked, "lanes-ranked")
    rows = lines.select("line_id", F.xxhash64(*KEY).alias("key"), F.col("rate").cast("double").alias("rate"))
    shares = keys.select("key", "shares")
    rows = rows.join(shares, "key").withColumn("share", F.pmod(F.xxhash64("line_id"), F.col("shares"))).drop("shares")
    spread = ranked.join(shares, "key").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    line, lane = lines.schema["line_id"].dataType.simpleString(), lanes.schema["lane_id"].dataType.simpleString()

    def best(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        theirs = theirs.sort_values("lane_id", kind="stable")
        raw, lane_rate = theirs["raw"].to_numpy(), theirs["lane_rate"].to_numpy(float)
        out = []
        step = max(1, 4_000_000 // max(1, len(theirs)))
        for at in range(0, len(mine), step):
            part = mine.iloc[at : at + step]
            rate = part["rate"].to_numpy(float)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                close = np.maximum(0.0, 1.0 - np.abs(rate - lane_rate) / lane_rate * 100.0 / 50.0)
            close = np.where((rate > 0) & (lane_rate > 0), close, 0.0)
            score = raw + np.where(np.isnan(rate), 0.0, RATE_BONUS * close)
            order = np.argsort(-score, axis=1, kind="stable")[:, :top]  # lanes stand by lane_id, so ties do
            n = order.shape[1]
            flat = order.ravel()
            out.append(pd.DataFrame({
                "line_id": np.repeat(part["line_id"].to_numpy(), n), "lane_id": theirs["lane_id"].to_numpy()[flat], "place": np.tile(np.arange(1, n + 1), len(part)),
                "raw": np.take_along_axis(score, order, axis=1).ravel(), "direction": theirs["direction"].to_numpy()[flat], "relaxed": theirs["relaxed"].to_numpy()[flat],
            }))
        return pd.concat(out) if out and len(theirs) else pd.DataFrame(columns=["line_id", "lane_id", "place", "raw", "direction", "relaxed"])

    kept = rows.groupBy("key", "share").cogroup(spread.groupBy("key", "share")).applyInPandas(best, f"line_id {line}, lane_id {lane}, place int, raw double, direction string, relaxed boolean")
    return kept.select("line_id", "lane_id", "place", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("raw"))), 4).alias("score"), "direction", "relaxed")


#: Weights of equal ends and vehicle and of near distance and rate, how fast nearness falls, least score.
WEIGHTS = {"origin": 0.35, "destination": 0.35, "vehicle": 0.1, "distance": 0.1, "rate": 0.1}
DISTANCE_KM, RATE_PCT, LEAST = 15.0, 30.0, 0.6


def weighted(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """lines (line_id, KEY, distance_km, rate) with method, ref_id, ref_rate, score: the reference of the same KEY (`direct`), else
    the most similar one at LEAST or above (`similarity`) of the same vehicle and unit or, where no reference has these, of all; else
    `none`. Ties: the smallest ref_id. refs: ref_id, KEY, distance_km, rate. Places are compared as they are: bring normal forms.

    WEIGHTS leave two ways to reach LEAST: both ends are equal, or one is, with the vehicle, and the nearnesses of distance and
    rate come to 1.5 together, so that the distances differ by half of DISTANCE_KM at most. The first is an equi join, the second one too, on
    the end, the vehicle and bins of distance; no reference is met that shares neither end.
    """
    ends = ["origin", "destination", "vehicle", "unit"]
    known = refs.select("ref_id", *[F.col(c).alias(f"r_{c}") for c in ends], F.col("distance_km").alias("r_distance"), F.col("rate").alias("r_rate"))
    asked = lines.select(*ends, "distance_km", "rate").distinct()
    pooled = known.select(F.col("r_vehicle").alias("vehicle"), F.col("r_unit").alias("unit")).distinct().withColumn("pooled", F.lit(True))
    direct = known.groupBy(*[F.col(f"r_{c}").alias(c) for c in ends]).agg(F.min_by(F.struct("ref_id", F.col("r_rate").alias("ref_rate")), "ref_id").alias("direct"))
    asked = asked.join(direct, ends, "left").join(pooled, ["vehicle", "unit"], "left")
    todo = asked.where("direct is null").drop("direct").withColumn("pooled", F.coalesce("pooled", F.lit(False)))
    # Within the pool a reference with both ends equal would be direct, so both ends matter outside it alone.
    both = todo.where("not pooled").join(known, (F.col("origin") == F.col("r_origin")) & (F.col("destination") == F.col("r_destination")))
    half = DISTANCE_KM / 2
    binned = todo.where("distance_km is not null and rate is not null").withColumn("bin", F.floor(F.col("distance_km") / half))
    spread = known.where("r_distance is not null and r_rate is not null and r_rate <> 0").withColumn("r_bin", F.explode(F.array(*[F.floor(F.col("r_distance") / half) + i for i in (-1, 0, 1)])))
    allowed = (F.col("vehicle") == F.col("r_vehicle")) & (F.col("bin") == F.col("r_bin")) & (~F.col("pooled") | (F.col("unit") == F.col("r_unit")))
    one = [binned.join(spread, (F.col(e) == F.col(f"r_{e}")) & (F.col(f) != F.col(f"r_{f}")) & allowed).drop("bin", "r_bin") for e, f in (("origin", "destination"), ("destination", "origin"))]
    pairs = both.unionByName(one[0]).unionByName(one[1])
    equal = lambda c: F.when(F.col(c) == F.col(f"r_{c}"), WEIGHTS[c]).otherwise(0.0)
    distance = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("distance_km") - F.col("r_distance")) / DISTANCE_KM)
    rate = F.when(F.col("r_rate") != 0, F.greatest(F.lit(0.0), 1.0 - F.abs((F.col("rate") - F.col("r_rate")) / F.col("r_rate")) * 100.0 / RATE_PCT))
    near = lambda c, w: F.when(F.col("distance_km" if w == "distance" else "rate").isNotNull() & c.isNotNull(), WEIGHTS[w] * c).otherwise(0.0)
    score = equal("origin") + equal("destination") + equal("vehicle") + near(distance, "distance") + near(rate, "rate")
    scored = pairs.withColumn("score", score).where(F.col("score") >= LEAST)
    names = [*ends, "distance_km", "rate"]
    best = scored.groupBy(*names).agg(F.min_by(F.struct("ref_id", F.col("r_rate").alias("ref_rate"), "score"), F.struct(-F.col("score"), "ref_id")).alias("near"))
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in names))
    settled = asked.where("direct is not null").select(*names, F.lit("direct").alias("method"), "direct.ref_id", "direct.ref_rate", F.lit(None).cast("double").alias("score"))
    settled = settled.unionByName(best.select(*names, F.lit("similarity").alias("method"), "near.ref_id", "near.ref_rate", F.round("near.score", 3).alias("score")))
    met = lines.alias("l").join(settled.alias("s"), same("l", "s"), "left")
    return met.select("l.*", F.coalesce("method", F.lit("none")).alias("method"), "ref_id", "ref_rate", "score")


def executed_reference(lines: DataFrame, by_shipment: DataFrame, by_lane: DataFrame) -> DataFrame:
    """lines (line_id, refs array in order, lane, actual) with the executed rate of the first known shipment reference, else of
    the lane's best candidate (site fit, then samples, then nearness of rates; ties: smallest candidate_id), and its method.

    Fit and samples do not depend on the line, so a lane keeps only the candidates that are best in both, and among those a line looks up
    the nearest rate. by_shipment has one rate for a reference; line_id may repeat if its rows are equal in refs.
    """
    first = lines.select("line_id", F.posexplode("refs").alias("pos", "ref")).join(by_shipment.select("ref", F.col("rate").alias("shipment_rate")), "ref").groupBy("line_id").agg(F.min_by("shipment_rate", "pos").alias("shipment_rate"))
    rank = F.struct("fit", "samples")
    best = by_lane.where("lane is not null").groupBy("lane").agg(F.max(rank).alias("rank"))
    able = by_lane.join(best, (by_lane["lane"] == best["lane"]) & (rank == F.col("rank")), "left_semi").where("rate is not null").withColumnRenamed("rate", "lane_rate")
    joined = lookup.nearest_value(lines.join(first, "line_id", "left"), able, ["lane"], "actual", "lane_rate", ["lane_rate"], "candidate_id", 1_000.0)
    method = F.when(F.col("shipment_rate").isNotNull(), "shipment_reference").when(F.col("lane_rate").isNotNull(), "lane_median")
    return joined.select(*lines.columns, F.coalesce("shipment_rate", "lane_rate").alias("executed_rate"), method.alias("method"))


#: Texts up to this length are looked up whole; values that tell beginnings and ends of texts of one length apart.
WHOLE, MARKS = 16, 4096


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b) of short (a, x) and long (b, y) with x, not empty, inside y. x is filed under itself up to WHOLE characters, else under its
    last 16, 32, 64, ... (as many as it has), and y asks for all its substrings of the lengths that are filed, so no pair is missed, and only
    texts above WHOLE meet without a match. What starts and ends as nothing filed of its length is not asked for."""
    n = F.char_length("x")
    size = F.when(n <= WHOLE, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("int"))
    # A length and what a text starts and ends with, in few enough values to be broadcast whatever the texts are.
    marked = lambda rows: rows.withColumn("mark", F.col("q") * MARKS + F.pmod(F.hash(F.left("k", F.lit(1)), F.right("k", F.lit(1))), F.lit(MARKS)))
    filed = marked(short.where(n > 0).withColumn("q", size).withColumn("k", F.right("x", F.col("q"))))
    known = filed.select("q", "mark").distinct()
    asked = long.join(F.broadcast(known.select("q").distinct()), F.char_length("y") >= F.col("q")).withColumn("i", F.explode(F.sequence(F.lit(1), F.char_length("y") - F.col("q") + 1)))
    asked = marked(asked.withColumn("k", F.substring("y", F.col("i"), F.col("q")))).join(F.broadcast(known.select("mark")), "mark", "left_semi").where(F.position("k", "y") == F.col("i"))
    # A text that is filed whole is its own key.
    met = filed.select("a", "k", F.when(n > WHOLE, F.col("x")).alias("x")).join(asked.select("b", "k", F.when(F.col("q") >= WHOLE, F.col("y")).alias("y")), "k")
    return met.where(F.col("x").isNull() | F.col("y").contains(F.col("x"))).select("a", "b")


def documents_of_lines(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """(line_id, document_id): a document belongs to a line if either reference contains the other, or by row number."""
    ref = F.upper(F.trim("ref"))
    a, b = lines.select(F.col("line_id").alias("a"), ref.alias("x")), documents.select(F.col("document_id").alias("b"), ref.alias("y"))
    back = contained(b.select(F.col("b").alias("a"), F.col("y").alias("x")), a.select(F.col("a").alias("b"), F.col("x").alias("y"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
    by_row = lines.select(F.col("line_id").alias("a"), "row_no").join(documents.select(F.col("document_id").alias("b"), "row_no"), "row_no").select("a", "b")
    return contained(a, b).unionByName(back).unionByName(by_row).distinct().select(F.col("a").alias("line_id"), F.col("b").alias("document_id"))


#: Ids up to this length are matched through what is left of them when characters are taken out, up to LEVELS of them.
SHORT, LEVELS = 40, 3


def _less(column: str) -> Column:
    """column, an array of texts, with the texts that have one character less."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))
    return F.array_distinct(F.concat(F.col(column), F.flatten(F.transform(column, one))))


def nearest_ids(typed: DataFrame, known: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(typed, known, ratio): the known id of largest indel similarity at or above the threshold; ties: the smallest id.

    Level by level, 1 to LEVELS: ids that come to the same text when at most so many characters are taken out of either meet in an equi
    join. What does not meet at level m has more than m characters of its own on one side, which bounds its similarity, so an id whose best
    one exceeds that bound is settled, and only others go to the next level. What is left after the last, and ids too
    long for this, are scanned against the known ones in blocks of BLOCK ids: known ids stay where they are, and a task
    hands on its best for each. Neither emits pairs of all with all, and nothing is left out.
    """
    typed, known = written(typed.select("typed").where("typed is not null").distinct(), "ids-typed"), written(known.select("known").where("known is not null").distinct(), "ids-known")
    n = F.char_length("typed")
    todo, found = typed.where(n <= SHORT - LEVELS).withColumn("k", F.array("typed")), None
    filed = known.where(F.char_length("known") <= SHORT).withColumn("k", F.array("known"))
    rank = F.struct(-F.col("ratio"), F.col("known"))
    for level in range(1, LEVELS + 1):
        todo, filed = todo.withColumn("k", _less("k")), filed.withColumn("k", _less("k"))
        pairs = todo.select("typed", F.explode("k").alias("k")).join(filed.select("known", F.explode("k").alias("k")), "k").select("typed", "known").distinct()
        best = pairs.withColumn("ratio", places.indel_ratio(F.col("typed"), F.col("known"))).groupBy("typed").agg(F.min_by(F.struct("known", "ratio"), rank).alias("b")).select("typed", "b.*")
        unmet = 100 * (1 - (level + 1) / (2 * n + level + 1))
        settled = written(best.where((F.col("ratio") > unmet + 1e-9) | (unmet < threshold - 1e-9)), "ids-settled")
        found = settled if found is None else found.unionByName(settled)
        todo = written(todo.join(settled.select("typed"), "typed", "left_anti"), "ids-open")
        if todo.isEmpty():
            break
    rest = written(typed.join(found.select("typed"), "typed", "left_anti"), "ids-rest")
    scanned = _scan_ids(rest, known)
    best = found if scanned is None else found.unionByName(scanned.groupBy("typed").agg(F.min_by(F.struct("known", "ratio"), rank).alias("b")).select("typed", "b.*"))
    return best.where(F.col("ratio") >= threshold)


def _scan_ids(rest: DataFrame, known: DataFrame) -> DataFrame | None:
    """Each task's best known id for each of rest, in blocks."""
    asked = rest.withColumn("n", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("typed"), F.lit(64))).orderBy("typed"))).withColumn("block", F.floor(F.col("n") * 64 / BLOCK)).drop("n")
    found = None
    for r in asked.select("block").distinct().orderBy("block").toLocalIterator():
        own = [x["typed"] for x in asked.where(F.col("block") == r["block"]).select("typed").toLocalIterator()]
        shared = known.sparkSession.sparkContext.broadcast(own)  # at most some BLOCK ids

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best: dict[str, tuple[float, str]] = {}
            for batch in batches:
                texts = batch["known"].tolist()
                table = places.IdTable(texts)
                for x in shared.value:
                    ratios = table.ratios(x)
                    top = ratios.max()
                    own = (-top, min(texts[i] for i in np.flatnonzero(ratios == top)))
                    if x not in best or own < best[x]:
                        best[x] = own
            yield pd.DataFrame([(x, k, -r) for x, (r, k) in best.items()], columns=["typed", "known", "ratio"])

        part = known.mapInPandas(scan, "typed string, known string, ratio double")
        found = part if found is None else found.unionByName(part)
    return found


def document_confidence(documents: DataFrame) -> DataFrame:
    """documents (document_id, file_name, ids, shipment) with filename_match, content_match, fuzzy_id, fuzzy_ratio, confidence: 90
    where file name and shipment contain one another, 95 where the shipment is among ids, else at least 10 less than the best
    similarity of 75 or more (ties: the first id). Upper and lower case are alike but in similarities. Without file name
    or shipment nothing matches."""
    name, shipment = F.upper(F.col("file_name")), F.upper(F.col("shipment"))
    rows = documents.withColumns({
        "filename_match": F.coalesce(name.contains(shipment) | shipment.contains(name), F.lit(False)),
        "content_match": F.coalesce(F.array_contains(F.transform("ids", F.upper), shipment), F.lit(False)),
    })
    split = rows.where("not content_match and shipment is not null").select("document_id", "shipment", F.posexplode("ids").alias("at", "id")).where("id is not null")
    near = split.withColumn("ratio", places.indel_ratio(F.col("shipment"), F.col("id"))).where("ratio >= 75").groupBy("document_id", "shipment").agg(F.min_by(F.struct("id", "ratio"), F.struct(-F.col("ratio"), F.col("at"))).alias("f"))
    base = F.when(F.col("content_match"), 95.0).when(F.col("filename_match"), 90.0).otherwise(0.0)
    return rows.join(near, ["document_id", "shipment"], "left").select(*documents.columns, "filename_match", "content_match", F.col("f.id").alias("fuzzy_id"), F.col("f.ratio").alias("fuzzy_ratio"), F.greatest(base, F.coalesce(F.col("f.ratio") - 10, F.lit(0.0))).alias("confidence"))


def routed_places(rows: DataFrame, aliases: DataFrame, place: str) -> DataFrame:
    """rows with place_normal and place_source. aliases: ordinal, raw_place, normalized_place, place_group, status, of which the last
    row of a place counts: `active` ones replace the place, `review` and other (blocked) ones only mark it."""
    raw = places.clean(F.col("raw_place"))
    group = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("place_group", F.lit("")))), "[^a-z0-9_]+", "_"), "^_+|_+$|_(?=_)", "")
    status = F.lower(places.clean(F.coalesce("status", F.lit(""))))
    known = aliases.select(raw.alias("_raw"), F.coalesce(F.nullif(places.clean(F.col("normalized_place")), F.lit("")), raw).alias("_normal"), F.coalesce(F.nullif(group, F.lit("")), F.lit("site")).alias("_group"), F.coalesce(F.nullif(status, F.lit("")), F.lit("active")).alias("_status"), "ordinal").where("_raw <> ''")
    last = lookup.last_per_key(known, ["_raw"], F.col("ordinal")).drop("ordinal")
    met = rows.withColumn("_place", places.clean(F.col(place))).join(last, F.col("_place") == F.col("_raw"), "left")
    kind = F.when(F.col("_status") == "active", "alias:").when(F.col("_status") == "review", "review:").otherwise("blocked:")
    source = F.when(F.col("_place") == "", "blank").when(F.col("_raw").isNull(), "fallback").otherwise(F.concat(kind, F.col("_group")))
    return met.select(*rows.columns, F.when(F.col("_status") == "active", F.col("_normal")).otherwise(F.col("_place")).alias("place_normal"), source.alias("place_source"))
