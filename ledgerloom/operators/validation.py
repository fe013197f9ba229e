"""Validation of invoices: a schema check that stops the rest, then totals, duplicates, rates, currencies and dates together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed currencies, and the references of a shipment with their confidence, the surest first.
CURRENCIES = ("AED", "USD")
REFERENCES = {"bl_number": 0.95, "shipment_ref": 0.9, "job_number": 0.85, "do_number": 0.8}
ISSUE = "array<struct<code:string,severity:string,path:string,expected:string,actual:string>>"


def _issue(code: str, severity: str, path: Column, expected: Column, actual: Column) -> Column:
    text = lambda c, name: c.cast("string").alias(name)
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text(path, "path"), text(expected, "expected"), text(actual, "actual"))


def required_issues(invoices: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(invoice_id, issue) for each of fields that is null or blank."""
    each = [F.when(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).isNull(), _issue("REQUIRED_FIELD_MISSING", "error", F.lit(f), F.lit("a value"), F.col(f))) for f in fields]
    return invoices.select("invoice_id", F.explode(F.array_compact(F.array(*each))).alias("issue"))


def currency_and_date_issues(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(invoice_id, issue) of invoices (currency, issue_date, due_date) and of lines (invoice_id, line_id, currency): currencies outside the allowed ones, a
    due date before the issue date, and lines in another allowed currency than their invoice (a warning). Lines without a currency pass."""
    allowed = F.lit("|".join(CURRENCIES))
    own = [
        F.when(~F.coalesce(F.col("currency").isin(*CURRENCIES), F.lit(False)), _issue("UNSUPPORTED_CURRENCY", "error", F.lit("currency"), allowed, F.col("currency"))),
        F.when(F.col("due_date") < F.col("issue_date"), _issue("DUE_DATE_BEFORE_ISSUE_DATE", "error", F.lit("dueDate"), F.lit(">= issueDate"), F.col("due_date"))),
    ]
    found = invoices.select("invoice_id", F.explode(F.array_compact(F.array(*own))).alias("issue"))
    said = lines.where("currency <> ''").select("invoice_id", F.concat(F.lit("lines."), F.col("line_id").cast("string"), F.lit(".currency")).alias("path"), F.col("currency").alias("said"))
    met = said.join(invoices.select("invoice_id", "currency"), "invoice_id")
    issue = F.when(~F.col("said").isin(*CURRENCIES), _issue("UNSUPPORTED_CURRENCY", "error", F.col("path"), allowed, F.col("said"))).when(~F.col("said").eqNullSafe(F.col("currency")), _issue("FX_RATE_MISSING", "warning", F.col("path"), F.col("currency"), F.col("said")))
    return found.unionByName(met.select("invoice_id", issue.alias("issue")).where("issue is not null"))


def validated(invoices: DataFrame, lines: DataFrame, required: tuple[str, ...], others: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((invoice_id, valid, n_issues), (invoice_id, issue)): an invoice that fails the schema check has those issues alone; others are given
    what currency_and_date_issues and the frames (invoice_id, issue) of `others` find. Valid is one without an error."""
    missing = required_issues(invoices, required)
    fine = invoices.join(missing.select("invoice_id").distinct(), "invoice_id", "left_anti")
    rest = currency_and_date_issues(fine, lines)
    for more in others:
        rest = rest.unionByName(more.join(fine.select("invoice_id"), "invoice_id", "left_semi"))
    issues = missing.unionByName(rest)
    counted = issues.groupBy("invoice_id").agg(F.count("*").alias("n_issues"), F.bool_or(F.col("issue.severity") == "error").alias("bad"))
    verdicts = invoices.select("invoice_id").join(counted, "invoice_id", "left")
    return verdicts.select("invoice_id", (~F.coalesce("bad", F.lit(False))).alias("valid"), F.coalesce("n_issues", F.lit(0)).alias("n_issues")), issues
