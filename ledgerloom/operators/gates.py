"""Triggers that ask for a person before an invoice is approved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Triggers with their severity and the roles that may resolve them, the dirhams of a dollar, and limits.
TRIGGERS = {
    "HGT_01": ("ZERO", "FINANCE_APPROVER"), "HGT_02": ("ZERO", "COST_CONTROL_LEAD,FINANCE_APPROVER"), "HGT_03": ("AMBER", "COST_CONTROL_LEAD"), "HGT_04": ("ZERO", "FINANCE_APPROVER"),
    "HGT_05": ("ZERO", "MARINE_LEAD"), "HGT_06": ("AMBER", "WAREHOUSE_MANAGER"), "HGT_07": ("ZERO", "COMPLIANCE_LEAD"), "HGT_08": ("AMBER", "DOCUMENT_CONTROLLER"),
}
DIRHAMS, LARGE, SURE = 3.6725, 100_000.0, 0.95
STORES, MARINE, COMPLIANCE = ("WAREHOUSE_HANDLING", "WAREHOUSE_STORAGE"), "MOSB_EVIDENCE_MISSING", "COMPLIANCE"


def human_gates(jobs: DataFrame, lines: DataFrame) -> DataFrame:
    """(job_id, trigger_id, severity, required_role) of jobs (job_id, invoice_total, currency, parser_confidence) and their lines (job_id, band,
    rate_status, fx_override, reason_codes, evidence_status, charge_component, required_evidence). Lines are reduced to a row for each job by
    flags that combine on the map side; a job without lines has its own triggers alone. Missing totals are 0, missing confidence is 1."""
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    missing = F.col("evidence_status") == "MISSING"
    seen = lines.groupBy("job_id").agg(
        some(F.col("band").isin("HIGH", "CRITICAL")).alias("HGT_02"), some(F.col("rate_status") == "UNKNOWN").alias("HGT_03"), some(F.col("fx_override")).alias("HGT_04"), some(F.array_contains("reason_codes", MARINE)).alias("HGT_05"),
        some(missing & F.col("charge_component").isin(*STORES)).alias("HGT_06"), some(missing & F.array_contains("required_evidence", COMPLIANCE)).alias("HGT_07"),
    )
    total = F.coalesce(F.col("invoice_total").cast("double"), F.lit(0.0)) * F.when(F.col("currency") == "USD", DIRHAMS).otherwise(1.0)
    met = jobs.join(seen, "job_id", "left").withColumns({"HGT_01": total >= LARGE, "HGT_08": F.coalesce("parser_confidence", F.lit(1.0)) < SURE})
    each = F.array_compact(F.array(*[F.when(F.col(t), F.struct(F.lit(t).alias("trigger_id"), F.lit(s).alias("severity"), F.lit(r).alias("required_role"))) for t, (s, r) in TRIGGERS.items()]))
    return met.select("job_id", F.explode(each).alias("t")).select("job_id", "t.*")
