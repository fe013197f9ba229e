"""Writers: fixed columns, datasets, append logs, replacement by source, and named sheets with a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; what df lacks is blank."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_source(df: DataFrame, path: str, source: str = "source") -> None:
    """Replaces the rows of each source that df has, and no others (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def csv_datasets(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def sheets(tables: dict[str, DataFrame], order: dict[str, Sequence[str]], folder: str) -> DataFrame:
    """Writes each sheet sorted by its keys (null as blank) and returns the manifest (sheet, n_rows, content_hash).

    The hash adds up row hashes, so it depends on the rows and not on how they are dealt.
    """
    manifest = None
    for name in sorted(tables):
        df = tables[name]
        keys = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in order.get(name, ())]
        (df.orderBy(*keys) if keys else df).write.mode("overwrite").parquet(f"{folder}/{name}")
        one = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string").alias("content_hash")).select(F.lit(name).alias("sheet"), "n_rows", "content_hash")
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.write.mode("overwrite").parquet(f"{folder}/99_manifest")
    return manifest


def rate_seeds(lanes: DataFrame) -> DataFrame:
    """Rows of a rate card table from approved lanes (origin, destination, vehicle, unit, median_rate_usd, median_distance_km,
    samples, lane_id). Missing parts are empty, a missing unit is per truck, missing numbers are 0."""
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    number = lambda c, digits: F.bround(F.coalesce(F.col(c), F.lit(0.0)), digits).alias(c)
    ends = [part(F.col(c)) for c in ("origin", "destination", "vehicle")]
    unit = F.coalesce(F.nullif(F.trim("unit"), F.lit("")), F.lit("per truck"))
    return lanes.select(
        F.upper(F.concat_ws("||", *ends, unit)).alias("lane"), number("median_rate_usd", 4).alias("contracted_rate"), F.lit("PER_TRUCK").alias("rate_basis"), F.lit("USD").alias("currency"), F.lit("Y").alias("match_eligible"),
        F.coalesce("lane_id", F.lit("")).alias("lane_id"), number("median_distance_km", 2), F.coalesce("samples", F.lit(0)).cast("long").alias("samples"), F.lit("DOMESTIC").alias("workflow_type"),
        F.concat(F.lit("origin="), ends[0], F.lit(" dest="), ends[1], F.lit(" veh="), ends[2]).alias("notes"),
    )
