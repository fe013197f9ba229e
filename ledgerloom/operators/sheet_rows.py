"""Rows of the audit workbook's sheets on headers, duplicates and taxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = ("invoice_no", "vendor", "issue_date", "currency", "invoice_total")


def headers(invoices: DataFrame, key: str) -> DataFrame:
    """(key, field_name, actual_value, match_status, severity): five rows for each invoice; blank counts as missing, and the currency is always there."""
    tall = invoices.select(key, *[F.col(c).cast("string").alias(c) for c in HEADER]).unpivot([key], list(HEADER), "field_name", "actual_value")
    there = F.nullif("actual_value", F.lit("")).isNotNull() | (F.col("field_name") == "currency")
    return tall.select(key, "field_name", "actual_value", F.when(there, "PRESENT").otherwise("MISSING").alias("match_status"), F.when(~there, "AMBER").alias("severity"))


def duplicates(checked: DataFrame) -> DataFrame:
    """(sheet, id, status, severity) of checked invoices (id, duplicate_count, verdict, reason_code) that have a reason and a duplicate."""
    found = checked.where("reason_code is not null and duplicate_count > 0")
    return found.select(F.lit("duplicate").alias("sheet"), "id", F.col("reason_code").alias("status"), F.when(F.col("verdict") == "ZERO", "ZERO").otherwise("AMBER").alias("severity"))


def tax(lines: DataFrame, policies: DataFrame) -> DataFrame:
    """(sheet, id, status, severity) of every line: whether an exchange policy (id, fx_policy_id) applied. Taxes are not assessed here, so none fails."""
    known = policies.where("fx_policy_id is not null").select("id").distinct().withColumn("_known", F.lit(True))
    return lines.join(known, "id", "left").select(F.lit("tax").alias("sheet"), "id", F.when(F.col("_known"), "POLICY_MATCH").otherwise("NOT_ASSESSED").alias("status"), F.lit("PASS").alias("severity"))
