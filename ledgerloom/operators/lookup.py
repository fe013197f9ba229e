"""Equi, interval and as-of lookups against reference tables, duplicate detection, merges and comparisons.

Reference rows are brought to one row a key first (aggregates that combine on the map side), so a join never multiplies the
larger side; Spark broadcasts the reduced table if it is small, and otherwise shuffles and splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given ascending order. The order has to be total for a defined result."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def last_per_key(rows: DataFrame, keys: Sequence[str], ordinal: Column) -> DataFrame:
    """The row of each key with the largest ordinal: what a map holds after inserting rows in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_row")).select(*keys, "_row.*")


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """left with the columns of right's first row by key (null where none)."""
    return left.join(one_per_key(right, keys, order), list(keys), "left")


def _known(keys: Sequence[str], *more: Column) -> Column:
    """Whether all keys, and more, are not null."""
    known = F.lit(True)
    for c in (*map(F.col, keys), *more):
        known = known & c.isNotNull()
    return known


def valid_row(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, start: str, end: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """left with `columns` of the first row of right, by `order` (total), that is valid on its day (start <= day <= end, open end
    allowed); null where none is, and for null keys and days.

    An interval index: the days asked for are divided into blocks of 1, 8, 64, ... days. A row of right is filed under the few blocks that
    make up its interval, and of each block only the first row in order is kept, by one aggregation that combines on the map side. A
    day lies in one block of each size, so each (key, day) that occurs asks for as many rows as there are sizes. Left rows
    are then joined by (key, day): a hot key is spread over its days, and nothing is gathered for a key.
    """
    asked = left.select(*keys, day).where(_known(keys, F.col(day))).distinct()
    reach = asked.agg(F.min(F.unix_date(day)).alias("low"), F.max(F.unix_date(day)).alias("high")).first()
    if reach["low"] is None:
        return left.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    low, high, sizes = reach["low"], reach["high"], 1
    while 8**sizes <= high - low:
        sizes += 1
    a, b = F.greatest(F.unix_date(start) - low, F.lit(0)), F.least(F.coalesce(F.unix_date(end), F.lit(high)), F.lit(high)) - low
    rows = right.where(_known(keys, F.col(start))).select(*keys, F.struct(F.struct(*order).alias("order"), F.struct(*columns).alias("row")).alias("_hit"), a.cast("long").alias("_a"), b.cast("long").alias("_b")).where("_a <= _b")
    first, after = (lambda k: F.floor((F.col("_a") + 8**k - 1) / 8**k)), (lambda k: F.floor((F.col("_b") + 1) / 8**k))  # noqa: E731  whole blocks of size k

    def stretch(x: Column, y: Column) -> Column:
        return F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))

    def blocks(k: int) -> Column:
        """Whole blocks of size k of an interval that no larger block in it holds."""
        inner = first(k + 1) < after(k + 1)
        own = F.when(inner, F.concat(stretch(first(k), 8 * first(k + 1)), stretch(8 * after(k + 1), after(k)))).otherwise(stretch(first(k), after(k)))
        return F.transform(own, lambda n: F.struct(F.lit(k).alias("k"), n.alias("n")))

    filed = [blocks(k) for k in range(sizes + 1)]
    index = rows.select(*keys, "_hit", F.explode(F.concat(*filed)).alias("_block")).groupBy(*keys, "_block").agg(F.min("_hit.order").alias("_order"), F.min_by("_hit", "_hit.order").alias("_hit"))
    here = (F.unix_date(day) - low).cast("long")
    probes = asked.select(*keys, day, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(here / 8**k).alias("n")) for k in range(sizes + 1)])).alias("_block"))
    found = probes.join(index, [*keys, "_block"]).groupBy(*keys, day).agg(F.min_by("_hit", "_order").alias("_hit"))
    return left.join(found, [*keys, day], "left").select(*[left[c] for c in left.columns], *[F.col(f"_hit.row.{c}").alias(c) for c in columns])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, start: str, end: str, columns: Sequence[str], tie: str) -> DataFrame:
    """left with `columns` of the valid row of right (start <= day <= end, open end allowed) that starts last; ties: smallest `tie`."""
    return valid_row(left, right, keys, day, start, end, columns, [-F.unix_date(F.col(start)), F.col(tie)])


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, at: str, columns: Sequence[str], tie: str, stretch: Callable[[Column], Column] = lambda d: F.floor(F.unix_date(d) / 64)) -> DataFrame:
    """left with `columns` of right's row by key with the latest `at` not after day; ties: the smallest `tie`. Null keys and days find nothing.

    Right is reduced to a row for each (key, at) and left to its distinct (key, day), both by aggregations that combine on the
    map side. A window runs over each stretch of time of a key (`stretch` of a moment, not falling), and what came last before a
    stretch is carried over from earlier ones, a row for each. Left rows are joined by (key, day), so that a hot key is spread over its days.
    """
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    own = list(names.values())
    held = right.where(_known(keys, F.col(at))).groupBy(*[F.col(k).alias(n) for k, n in names.items()], F.col(at).alias("_at")).agg(F.min_by(F.struct(*columns), tie).alias("_hit"))
    asked = left.where(_known(keys, F.col(day))).select(*[F.col(k).alias(n) for k, n in names.items()], F.col(day).alias("_at")).distinct()
    both = asked.join(held, [*own, "_at"], "full").withColumn("_stretch", stretch(F.col("_at")))
    within = Window.partitionBy(*own, "_stretch").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*own).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    last = both.groupBy(*own, "_stretch").agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_at"))).alias("_hit"))
    carried = last.select(*own, "_stretch", F.last("_hit", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    found = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(within)).join(carried, [*own, "_stretch"], "left").select(*own, F.col("_at").alias("_day"), F.coalesce("_hit", "_carried").alias("_hit"))
    same = F.col(day) == F.col("_day")
    for k, n in names.items():
        same = same & (F.col(k) == F.col(n))
    return left.join(found.where("_hit is not null"), same, "left").select(*[left[c] for c in left.columns], *[F.col(f"_hit.{c}").alias(c) for c in columns])


def nearest_value(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, at: str, columns: Sequence[str], tie: str, width: float) -> DataFrame:
    """left with `columns` of right's row by key whose `at` is nearest to value; ties: the smallest `tie`. A null value takes the
    smallest tie of all. `width` of stretches of values."""
    lower, upper = F.col("_lower"), F.col("_upper")
    row = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), *columns)
    rows = right.where(_known(keys, F.col(at)))
    known = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by(row, tie).alias("_any"))
    met = left.join(known, list(keys), "left")
    search = F.coalesce((F.col("_n") > 1) & F.col(value).isNotNull(), F.lit(False))  # else there is nothing to choose from
    asked = met.where(search).withColumns({"_asked": F.col(value), "_back": -F.col(value)})
    rows = rows.join(known.where("_n > 1").select(*keys), list(keys), "left_semi").withColumn("_up", -F.col(at))
    stretch = lambda v: F.floor(v / width)
    both = latest_before(asked, rows.withColumn("_lower", row), keys, "_asked", at, ["_lower"], tie, stretch)
    both = latest_before(both, rows.withColumn("_upper", row), keys, "_back", "_up", ["_upper"], tie, stretch)
    gap = lambda s: F.struct(F.abs(s["at"] - F.col(value)).alias("gap"), s["tie"].alias("tie"))
    found = both.withColumn("_any", F.when(lower.isNull() | (upper.isNotNull() & (gap(upper) < gap(lower))), upper).otherwise(lower))
    return met.where(~search).unionByName(found.select(*met.columns)).select(*left.columns, *[F.col(f"_any.{c}").alias(c) for c in columns])


def convert(left: DataFrame, policies: DataFrame, source: str, target: str, amount: str, day: str) -> DataFrame:
    """left with fx_policy_id, converted_amount (4 digits) and error_code; the first valid policy in order of policy_id counts."""
    rows = policies.select(F.col("from_currency").alias(source), F.col("to_currency").alias(target), "policy_id", "fx_rate", "rate_date", "valid_from", "valid_to").where("valid_to is not null")
    same = F.col(source) == F.col(target)
    joined = valid_row(left, rows.where(~same), [source, target], day, "valid_from", "valid_to", ["policy_id", "fx_rate", "rate_date", "valid_from", "valid_to"], [F.col("policy_id")])
    stale = (F.col("rate_date") < F.col("valid_from")) | (F.col("rate_date") > F.col("valid_to"))
    error = F.when(same, None).when(F.col("policy_id").isNull(), "FX_POLICY_REQUIRED").when(stale, "FX_POLICY_VALIDATION_FAILED")
    money = F.floor(F.col(amount) * F.col("fx_rate") * 10000 + 0.5) / 10000
    return joined.select(*left.columns, F.when(error.isNull(), F.col("policy_id")).alias("fx_policy_id"), F.when(same, F.col(amount)).when(error.isNull(), money).alias("converted_amount"), error.alias("error_code"))


def duplicate_invoices(invoices: DataFrame, previous: DataFrame) -> DataFrame:
    """invoices (vendor_hash, invoice_hash, amount) with duplicate_count, verdict and reason_code against previous invoices.

    The verdict needs only how many there are and how far their amounts reach, so previous rows are reduced by key first.
    """
    keys = ["vendor_hash", "invoice_hash"]
    known = previous.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("amount").alias("_lo"), F.max("amount").alias("_hi"))
    joined = invoices.join(known, keys, "left")
    same = F.greatest(F.abs(F.col("_lo") - F.col("amount")), F.abs(F.col("_hi") - F.col("amount"))) <= 0.01
    none = F.col("_n").isNull()
    return joined.select(
        *invoices.columns, F.coalesce("_n", F.lit(0)).alias("duplicate_count"), F.when(none, "PASS").when(same, "ZERO").otherwise("AMBER").alias("verdict"),
        F.when(none, None).when(same, "DUPLICATE_INVOICE").otherwise("AMOUNT_MISMATCH").alias("reason_code"),
    )


def seen(rows: DataFrame, known: DataFrame, key: str, ordinal: str) -> DataFrame:
    """rows with `duplicate`: the key is known already, or an earlier row of this batch (smaller ordinal) has it."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ordinal).alias("_first"))
    marked = rows.join(first, key, "left").join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    return marked.withColumn("duplicate", F.coalesce(F.col("_known"), F.lit(False)) | F.coalesce(F.col(ordinal) > F.col("_first"), F.lit(False))).drop("_first", "_known")


def merge(base: DataFrame, sides: Sequence[DataFrame], key: str, ordinal: str = "ordinal") -> DataFrame:
    """base with each side's fields put over its own where the side has them; of a side's rows with one key the last counts."""
    for side in sides:
        fields = [c for c in side.columns if c not in (key, ordinal)]
        one = last_per_key(side, [key], F.col(ordinal)).select(key, *[F.col(c).alias(f"_{c}") for c in fields])
        joined = base.join(one, key, "left")
        base = joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns], *[F.col(f"_{c}").alias(c) for c in fields if c not in base.columns])
    return base


def compare(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A row for each key and field on which two extractions differ (missing on one side included), with hashes of the values."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.upper(F.regexp_replace(F.trim(F.col(f).cast("string")), r"\s+", " ")).alias(f) for f in fields]).unpivot([key], list(fields), "field", name)

    both = tall(left, "left_value").join(tall(right, "right_value"), [key, "field"], "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    return both.select(key, "field", F.sha2("left_value", 256).alias("left_hash"), F.sha2("right_value", 256).alias("right_hash"))


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows, and old ones whose key no new row has."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """table after changes in order of ordinal: the last change of a key replaces its row."""
    return replace_rows(table, last_per_key(changes, keys, F.col(ordinal)).select(*table.columns), keys)


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key (Spark limits groups on the map side before it shuffles them)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def illegal_transitions(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Moves (from, to) that are neither a standstill nor allowed."""
    return moves.where("from <> to").join(allowed.select("from", "to").distinct(), ["from", "to"], "left_anti")
