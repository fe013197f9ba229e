"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's words (lower-cased, cut at white space) are hashed to 31 bits; each run of K words has a polynomial hash modulo the
Mersenne prime 2^31 - 1 (Horner's form of the rolling hash, since array functions keep no running state). Of every WINDOW
neighbouring hashes the minimum is chosen, the rightmost on ties, and each choice is kept once with its position, so any
K + WINDOW - 1 common words of two texts leave a common hash.

Defined results: fewer than K words make one run, fewer than WINDOW runs one window; null, empty or blank text has no hash
and the empty fingerprint. Two texts without hashes have likeness 1, one without has likeness 0 to any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, WINDOW = 5, 8
PRIME = (1 << 31) - 1
BASE = 1_000_003


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _word_hashes(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x00]+", " ")), " ")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(PRIME)))


def _horner(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = (total * F.lit(BASE) + t) % F.lit(PRIME)
    return total


def _runs(hashes: Column) -> Column:
    """The polynomial hash of each K neighbouring words, or of all of them if there are fewer."""
    few = F.array(F.aggregate(hashes, F.lit(1).cast("long"), lambda a, h: (a * F.lit(BASE) + h) % F.lit(PRIME)))
    many = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (K - 1), F.lit(1))), lambda h, i: _horner([h, *[F.get(hashes, i + j) for j in range(1, K)]]))
    return F.when(F.size(hashes) < K, few).otherwise(many)


def _chosen(runs: Column) -> Column:
    """Each window's minimum as hash * 2^32 + (2^32 - 1 - position): the smallest such number is the rightmost minimum."""
    placed = F.transform(runs, lambda h, i: F.shiftleft(h, 32) + (F.lit((1 << 32) - 1) - i))
    return let(
        placed,
        lambda p: F.array_distinct(F.when(F.size(p) <= WINDOW, F.array(F.array_min(p))).otherwise(
            F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - (WINDOW - 1), F.lit(1))), lambda c, i: F.least(c, *[F.get(p, i + j) for j in range(1, WINDOW)])))),
    )


def marks(text: Column) -> Column:
    """array<long> of the text's chosen hashes with positions (see _chosen), in order of position."""
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"[\s\x00]+", " ")) == "", F.lit(True))
    return F.when(blank, F.array().cast("array<bigint>")).otherwise(let(_word_hashes(text), lambda h: let(_runs(h), _chosen)))


def hashes(marked: Column) -> Column:
    """The distinct hashes of marks(), as int."""
    return F.array_distinct(F.transform(marked, lambda m: F.shiftright(m, 32).cast("int")))


def positions(marked: Column) -> Column:
    """The word positions at which the chosen runs start."""
    return F.transform(marked, lambda m: F.lit((1 << 32) - 1) - m.bitwiseAND(F.lit((1 << 32) - 1)))


def text_form(distinct: Column) -> Column:
    return F.lower(F.array_join(F.transform(distinct, lambda h: F.hex(h)), "-"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``marks``, and from them ``hashes`` and ``positions``; rows and other columns as they are."""
    return docs.withColumn("marks", marks(F.col(text))).withColumns({"hashes": hashes(F.col("marks")), "positions": positions(F.col("marks"))})


LEAST_ID = -(1 << 63)


def followers(keys: DataFrame, range_rows: int = 5_000) -> DataFrame:
    """keys (id, h, ...), each pair once, with next_id and next_h: the next pair in ascending order, after the last the first.

    Keys are dealt to ranges of about `range_rows`, which are written, so they do not change when a task is repeated. Rows of
    a range are in one window; its last key is followed by the first of the next, which a window over ranges finds.
    """
    pair = F.struct("id", "h")
    ranged = written(keys.repartitionByRange(max(1, keys.count() // range_rows), "id", "h").withColumn("range", F.spark_partition_id()), "fingerprint-ranges")
    firsts, in_order = ranged.groupBy("range").agg(F.min(pair).alias("first")), Window.orderBy("range")
    after = F.coalesce(F.lead("first").over(in_order), F.first("first").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    next_first = firsts.select(F.col("range").alias("of"), after.alias("after"))
    led = ranged.withColumn("next", F.lead(pair).over(Window.partitionBy("range").orderBy("id", "h"))).join(next_first, F.col("range") == F.col("of"))
    return led.select(*keys.columns, F.coalesce("next.id", "after.id").alias("next_id"), F.coalesce("next.h", "after.h").alias("next_h"))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs as (doc_id, n_chars, text, edited, marks, next_hashes): the text's last half replaced by as much of
    the next document's beginning.

    Documents are dealt once by (id, hash of text), and both joins use that exchange; what a document needs of its successor
    (as many characters as it gives up, and its hashes) goes to it in a second, smaller one. A null doc_id and the
    smallest long are the same; equal rows have one successor; a document that is alone follows itself.
    """
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    keys = written(own.select("id", "h", half.alias("take")).distinct(), "fingerprint-keys")
    repeated = keys.count() < docs.count()
    need = followers(keys).select(F.col("id").alias("to_id"), F.col("h").alias("to_h"), "next_id", "next_h", "take")
    full = own.withColumn("marks", marks(F.col("text")))
    sent = need.join(full, (F.col("next_id") == F.col("id")) & (F.col("next_h") == F.col("h"))).select(
        "to_id", "to_h", F.substring("text", F.lit(1), F.col("take")).alias("given"), hashes(F.col("marks")).alias("next_hashes"))
    if repeated:
        sent = sent.dropDuplicates(["to_id", "to_h"])
    joined = full.join(sent, (F.col("to_id") == F.col("id")) & (F.col("to_h") == F.col("h")))
    kept = F.substring("text", F.lit(1), F.char_length("text") - half)
    doc_id = F.when(F.col("id") != LEAST_ID, F.col("id")).alias("doc_id")
    return joined.select(doc_id, F.char_length("text").cast("long").alias("n_chars"), "text", F.concat(kept, "given").alias("edited"), "marks", "next_hashes")
