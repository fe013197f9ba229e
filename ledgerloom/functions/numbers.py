"""Rounding, deltas, bands and the verdict order. Tracks A and B differ in rounding and in the sign of deltas; both are here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in order, and the fixed peg of dirham to dollar.
VERDICTS = ("PASS", "AMBER", "ZERO", "FAILED")
PEG = 3.6725


def half_up(x: Column, digits: int = 2) -> Column:
    """Ties toward plus infinity, as track A rounds."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5).cast("double") / scale


def half_even(x: Column, digits: int = 2) -> Column:
    """Ties to even, as track B rounds; the double's shortest decimal form decides what a tie is."""
    return F.bround(x.cast("decimal(28,8)"), digits).cast("double")


def rank(verdict: Column) -> Column:
    """PASS 0 to FAILED 3; anything else null."""
    return F.when(verdict == "PASS", 0).when(verdict == "AMBER", 1).when(verdict == "ZERO", 2).when(verdict == "FAILED", 3)


def verdict_of(rank_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), rank_ + 1)


def worst(verdict: Column) -> Column:
    """Aggregate: the most severe verdict; PASS for none."""
    return verdict_of(F.coalesce(F.max(rank(verdict)), F.lit(0)))


def band_to_verdict(band: Column) -> Column:
    return F.when(band == "PASS", "PASS").when(band == "WARN", "AMBER").when(band.isin("HIGH", "CRITICAL"), "ZERO")


def delta_unsigned(a: Column, b: Column) -> Column:
    """Percent by which a differs from b, never negative; null for a null or a zero b (track A)."""
    return F.when(b != 0, F.abs((a - b) / F.nullif(b, F.lit(0.0))) * 100)


def delta_signed(a: Column, b: Column) -> Column:
    """The same with its sign (track B)."""
    return F.when(b != 0, (a - b) / F.nullif(b, F.lit(0.0)) * 100)


def band_of_delta(delta: Column, passes: float = 2, warns: float = 5, high: float = 10) -> Column:
    size = F.abs(delta)
    return F.when(delta.isNull(), "UNKNOWN").when(size <= passes, "PASS").when(size <= warns, "WARN").when(size <= high, "HIGH").otherwise("CRITICAL")


def number(text: Column) -> Column:
    """The number a cell shows, without commas, currency marks and blanks; null if none."""
    return F.regexp_replace(text.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def first_number(text: Column) -> Column:
    """The first number inside a text, commas dropped."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def excel_date(text: Column) -> Column:
    """A day from an Excel serial (20000 to 60000) or one of five written forms; else null."""
    t = F.trim(text)
    serial = t.try_cast("double")
    written = F.coalesce(*[F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))], F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    return F.when(serial.between(20000, 60000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))).otherwise(written)


def similarity_of_sets(a: Column, b: Column) -> Column:
    """Jaccard of two arrays: 1 for two empty ones, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def rate_closeness(invoice: Column, lane: Column, decay: float = 50.0) -> Column:
    """1 at equal rates, falling to 0 at `decay` percent apart; 0 where either is missing or not positive."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(invoice - lane) / F.nullif(lane, F.lit(0.0)) * 100 / decay)
    return F.when((invoice > 0) & (lane > 0), near).otherwise(0.0)
