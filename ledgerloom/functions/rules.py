"""Per-line rules as Column builders: each returns a column, or a struct of the rule's results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import PEG, band_of_delta, delta_unsigned, half_up

# Ordered keyword tables (first hit wins; plain substrings of the lower-cased text).
CHARGE_CODES = (
    ("TRANSPORT", ("transport", "freight", "haulage")), ("DEMURRAGE", ("demurrage", "dem")), ("DETENTION", ("detention", "det")), ("STORAGE", ("storage", "wharf")),
    ("HANDLING", ("handling", "load", "unload", "crane")), ("CUSTOMS", ("customs", "clearance", "boe")), ("INSURANCE", ("insurance",)),
)
TYPE_B = (
    ("INSPECTION", ("customs inspection", "inspection by customs", "customs inspection fee")),
    ("CUSTOMS", ("customs clearance", "bill of entry", "boe", "customs duty", "export customs", "import customs", "customs documentation", "shj customs", "code opening", "customs gate pass")),
    ("DO", ("master do", "house do", "delivery order", "do fee", "document delivery order")),
    ("INLAND", ("transport", "truck", "trucking", "inland", "fb from", "cipca", "mosb", "road freight", "appointment charge")),
    ("THC", ("terminal handling", "port handling", "thc", "tsc", "discharging", "loading", "unloading", "berth", "stevedoring")),
    ("DETENTION", ("container detention", "line detention", "detention")),
    ("STROAGE", ("warehouse storage", "yard storage", "port storage", "storage", "stroage")),
)
ROUTES = (
    ("check_duplicate_invoice", 0.9, ("duplicate",)), ("check_rate_card", 0.85, ("rate", "price", "cost")), ("check_contract_validity", 0.85, ("contract", "valid", "expir")),
    ("check_evidence_required", 0.85, ("evidence", "document", "proof")), ("check_tax_vat", 0.9, ("vat", "tax", "trn")), ("check_fx_policy", 0.85, ("fx", "exchange", "currency", "convert")),
    ("match_shipment_reference", 0.85, ("shipment", "bl", "delivery", "job")), ("build_validation_explanation", 0.8, ("explain", "reason", "finding")),
)
EVIDENCE = {
    "TRANSPORT": ("BL", "DN", "PO"), "INLAND": ("BL", "DN", "PO"), "DEMURRAGE": ("BL", "DN", "DEM_DET_CALC"), "DETENTION": ("BL", "DN", "DEM_DET_CALC"),
    "STORAGE": ("DN", "WAREHOUSE_RECEIPT"), "STROAGE": ("DN", "WAREHOUSE_RECEIPT"), "HANDLING": ("DN", "LIFT_LOG"), "THC": ("DN", "LIFT_LOG"),
    "CUSTOMS": ("BOE", "CUSTOMS_DECL"), "INSPECTION": ("BOE", "CUSTOMS_DECL"), "INSURANCE": ("INSURANCE_CERT",), "GENERAL": ("DN", "PO"),
}
EVIDENCE_ALIASES = {
    "BL": r"\bBL\b|bill of lading", "DN": r"\bDN\b|delivery note|dispatch note", "PO": r"\bPO\b|purchase order", "BOE": r"\bBOE\b|bill of entry",
    "CUSTOMS_DECL": r"customs declaration|customs proof", "DEM_DET_CALC": r"demurrage|detention|free\s*time|tariff", "WAREHOUSE_RECEIPT": r"warehouse receipt|storage invoice",
    "LIFT_LOG": r"lift log|terminal invoice|port invoice", "INSURANCE_CERT": r"insurance cert|insurance certificate",
}
EXPLANATIONS = {
    "DUPLICATE_INVOICE": "This invoice appears to be a duplicate. A previous invoice with the same vendor and invoice number was found with a matching amount.",
    "AMOUNT_MISMATCH": "A previous invoice with the same vendor and invoice number was found but with a different amount. This may indicate a corrected re-issue.",
    "RATE_VARIANCE": "The applied rate differs from the contracted rate by more than the allowed threshold.",
    "RATE_NOT_FOUND": "No contracted rate was found for this charge code and lane combination.",
    "CONTRACT_EXPIRED": "The vendor contract was expired at the time of this transaction.",
    "CONTRACT_NOT_FOUND": "No active contract was found for this vendor.",
    "VAT_RATE_MISMATCH": "The VAT amount calculated does not match the expected 5% UAE VAT.",
    "EVIDENCE_MISSING": "Required supporting documents are missing for this charge line.",
    "QTY_X_RATE_MISMATCH": "The product of quantity and rate does not match the declared line amount.",
    "COST_VARIANCE_EXCEEDS_2PCT": "The cost variance exceeds the 2% threshold defined in the Cost Guard policy.",
}
ACTIONS = {"ZERO": "Review required. This item cannot be approved without resolution.", "AMBER": "Reviewer attention needed. Verify and approve or escalate.", "PASS": "No action required."}
HINTS = {"ZERO": "Escalate to Contract/Admin for resolution.", "AMBER": "Ops Lead or Finance Manager may approve if variance is justified."}
LEGACY_STATUS = {
    "CREATED": "UPLOADED", "UPLOADING": "UPLOADED", "UPLOADED": "UPLOADED", "QUEUED": "UPLOADED", "PARSING": "PARSING", "VALIDATING": "VALIDATING",
    "REVIEW_REQUIRED": "NEEDS_REVIEW", "APPROVED": "APPROVED", "EXPORTING": "EXPORTED", "COMPLETED": "EXPORTED", "FAILED": "VALIDATION_FAILED", "REJECTED": "REJECTED",
}
STATES = ("UPLOADED", "PARSING", "PARSE_FAILED", "VALIDATING", "VALIDATION_FAILED", "NEEDS_REVIEW", "APPROVED", "REJECTED", "EXPORTED")
TRANSITIONS = {
    "UPLOADED": ("PARSING", "VALIDATING", "PARSE_FAILED", "VALIDATION_FAILED", "NEEDS_REVIEW", "APPROVED", "EXPORTED", "REJECTED"),
    "PARSING": ("VALIDATING", "PARSE_FAILED", "NEEDS_REVIEW", "VALIDATION_FAILED"), "PARSE_FAILED": ("PARSING", "REJECTED"), "VALIDATING": ("APPROVED", "VALIDATION_FAILED", "NEEDS_REVIEW"),
    "VALIDATION_FAILED": ("VALIDATING", "REJECTED", "NEEDS_REVIEW"), "NEEDS_REVIEW": ("APPROVED", "REJECTED"), "APPROVED": ("EXPORTED",),
}


def lookup(key: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """The table's entry for key, as an array for sequences; default (null) for none."""
    out = None
    for k, v in table.items():
        value = F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out if default is None else out.otherwise(default)


def any_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def charge_code(description: Column) -> Column:
    text, out = F.lower(description), None
    for code, words in CHARGE_CODES:
        out = F.when(any_of(text, words), code) if out is None else out.when(any_of(text, words), code)
    return out.otherwise("GENERAL")


def unit_of(code: Column) -> Column:
    return F.when(code == "TRANSPORT", "TEU").when(code == "HANDLING", "LIFT").otherwise("LS")


def type_b(description: Column) -> Column:
    """struct(type_b, confidence, matched_keyword)."""
    text = F.lower(description)
    words, out = F.split(text, r"\s+"), None
    for category, keywords in TYPE_B:
        for k in keywords:
            exact = (text == k) | F.array_contains(words, k)
            found = F.struct(F.lit(category).alias("type_b"), F.when(exact, 0.95).otherwise(0.85).alias("confidence"), F.lit(k).alias("matched_keyword"))
            out = F.when(text.contains(k), found) if out is None else out.when(text.contains(k), found)
    return out.otherwise(F.struct(F.lit("OTHERS").alias("type_b"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("matched_keyword")))


def route(question: Column, role: Column) -> Column:
    """struct(routed_to, confidence)."""
    text, out = F.lower(question), None
    bonus = F.when(any_of(F.lower(role), ("finance", "approver")), 0.05).otherwise(0.0)
    for target, confidence, words in ROUTES:
        found = F.struct(F.lit(target).alias("routed_to"), F.least(F.lit(1.0), half_up(bonus + confidence)).alias("confidence"))
        out = F.when(any_of(text, words), found) if out is None else out.when(any_of(text, words), found)
    return out.otherwise(F.struct(F.lit("check_cost_guard").alias("routed_to"), F.least(F.lit(1.0), half_up(bonus + 0.5)).alias("confidence")))


def contract_row_id(code: Column, lane: Column) -> Column:
    return F.concat(F.lit("CR-"), F.upper(F.substring(F.sha2(F.concat(code, F.lit("|"), F.coalesce(lane, F.lit(""))), 256), 1, 12)))


def rate_type(contracted: Column, applied: Column, basis: Column) -> Column:
    exception = basis.rlike(r"(?i)AT_COST|AS_PER_OFFER|LUMP_SUM")
    return F.when(contracted.isNotNull() & applied.isNotNull(), "CONTRACT_NUMERIC").when(exception, "TEXT_EXCEPTION").otherwise("MISSING_RATE")


def ai_rate_status(kind: Column, variance: Column) -> Column:
    size, review = F.abs(variance), "AUTO_COMPARE_REQUIRE_REVIEW_EVIDENCE"
    return (
        F.when(kind == "MISSING_RATE", "MISSING_RATE_NO_AUTO_PASS").when(kind == "TEXT_EXCEPTION", "EXCEPTION_EVIDENCE_REQUIRED").when(variance.isNull(), review)
        .when(size <= 2, "AUTO_COMPARE_OK").when(size <= 5, "AUTO_COMPARE_WITH_DUPLICATE_REVIEW").otherwise(review)
    )


def rate_check(contracted: Column, applied: Column, basis: Column) -> Column:
    """struct(verdict, reason_code, variance_pct, variance_amount, rate_type, ai_rate_status, evidence_status).

    The verdict reads the unrounded variance, ai_rate_status the rounded one; a zero contract rate counts as no variance.
    """
    raw = F.when(contracted == 0, 0.0).otherwise((applied - contracted) / F.nullif(contracted, F.lit(0.0)) * 100)
    size, kind = F.abs(raw), rate_type(contracted, applied, basis)
    verdict = F.when(contracted.isNull() | applied.isNull(), "AMBER").when(size <= 2, "PASS").when(size <= 5, "AMBER").otherwise("ZERO")
    reason = F.when(contracted.isNull(), "RATE_NOT_FOUND").when(applied.isNull(), "RATE_NOT_APPLIED").when(size <= 2, None).when(size <= 5, "RATE_VARIANCE").otherwise("RATE_EXCEEDS_THRESHOLD")
    rounded = half_up(raw)
    evidence = F.when(contracted.isNull() | applied.isNull(), None).when(size <= 2, "MATCHED_AMOUNT").otherwise("PARTIAL")
    return F.struct(
        verdict.alias("verdict"), reason.alias("reason_code"), rounded.alias("variance_pct"), half_up(applied - contracted).alias("variance_amount"),
        kind.alias("rate_type"), ai_rate_status(kind, rounded).alias("ai_rate_status"), evidence.alias("evidence_status"),
    )


def cost_guard(qty: Column, rate: Column, amount: Column, standard: Column) -> Column:
    """struct(qty_x_rate, variance_pct, reason_code)."""
    product, raw = qty * rate, (amount - standard) / F.nullif(standard, F.lit(0.0)) * 100
    mismatch = F.abs(product - amount) > 0.01
    compared = ~mismatch & (standard > 0)
    reason = F.when(mismatch, "QTY_X_RATE_MISMATCH").when(standard.isNull(), "STANDARD_RATE_NOT_AVAILABLE").when((standard > 0) & (F.abs(raw) > 2), "COST_VARIANCE_EXCEEDS_2PCT")
    return F.struct(product.alias("qty_x_rate"), F.when(compared, half_up(raw)).alias("variance_pct"), reason.alias("reason_code"))


def cost_guard_verdict(reason: Column) -> Column:
    """A line's share in its invoice's verdict; the first mismatch ends the fold, which equals the maximum."""
    return F.when(reason == "QTY_X_RATE_MISMATCH", "ZERO").when(reason.isNotNull(), "AMBER").otherwise("PASS")


def derive_band(band: Column, verdict: Column, reason: Column, delta: Column) -> Column:
    """Given band, else by verdict, else by reason, else by size of the delta; never HIGH."""
    v = F.upper(F.coalesce(verdict, F.lit("")))
    return (
        F.when(F.nullif(band, F.lit("")).isNotNull(), band).when(v == "ZERO", "CRITICAL").when(v.isin("AMBER", "WARN"), "WARN").when(v == "PASS", "PASS")
        .when(reason == "QTY_X_RATE_MISMATCH", "CRITICAL").when(F.nullif(reason, F.lit("")).isNotNull(), "WARN").when(F.abs(delta) > 2, "WARN").otherwise("PASS")
    )


def vat(amount: Column, currency: Column, rate: Column) -> Column:
    """struct(verdict, expected_vat, applied_vat, reason_code)."""
    expected, applied = amount * 0.05, amount * rate
    small = F.abs(applied - expected) <= 0.01
    verdict = F.when(rate.isNull(), "AMBER").when(rate == 0.05, "PASS").when(small, "AMBER").otherwise("ZERO")
    reason = F.when(rate.isNull(), "VAT_RATE_NOT_SPECIFIED").when(rate == 0.05, F.when(currency == "USD", "FX_VAT_CHECK_REQUIRED")).when(small, "VAT_ROUNDING").otherwise("VAT_RATE_MISMATCH")
    return F.struct(verdict.alias("verdict"), expected.alias("expected_vat"), applied.alias("applied_vat"), reason.alias("reason_code"))


def demurrage(code: Column, dates: Column, tariff: Column, free_time: Column, invoice: Column, final: Column) -> Column:
    """struct(verdict, missing_inputs, reason_code)."""
    gaps = F.array_compact(F.array(*[F.when(~F.coalesce(x, F.lit(False)), label) for x, label in ((dates, "DATES"), (tariff, "TARIFF"), (free_time, "FREE_TIME"), (invoice, "INVOICE"))]))
    missing = F.when(code.isin("DEMURRAGE", "DETENTION", "STORAGE"), gaps).otherwise(F.array().cast("array<string>"))
    none = F.size(missing) == 0
    verdict = F.when(none, "PASS").when(final, "ZERO").otherwise("AMBER")
    reason = F.when(none, None).when(final, "DEMDET_FINAL_MISSING_INPUTS").otherwise("DEMDET_PARTIAL_INPUTS")
    return F.struct(verdict.alias("verdict"), missing.alias("missing_inputs"), reason.alias("reason_code"))


def fx_policy_stub(source: Column, target: Column) -> Column:
    """struct(verdict, policy_rate, reason_code): only equal currencies pass; the peg is known but never applied."""
    same, pegged = source == target, source.isin("AED", "USD") & target.isin("AED", "USD")
    return F.struct(
        F.when(same, "PASS").otherwise("AMBER").alias("verdict"), F.when(same, 1.0).when(pegged, PEG).alias("policy_rate"), F.when(~same, "FX_RATE_UNVERIFIABLE").alias("reason_code")
    )


def customs(code: Column, hs_code: Column, documents: Column) -> Column:
    """struct(verdict, boe_found, hs_code_valid, reason_code)."""
    own = code == "CUSTOMS"
    boe = own & F.exists(documents, lambda d: d.rlike(r"(?i)BOE|Bill of Entry|customs declaration|CUSTOMS_DECL"))
    valid = F.regexp_replace(hs_code, r"\.", "").rlike(r"^\d{4,10}$")
    verdict = F.when(~own, "PASS").when(~boe, "ZERO").when(hs_code.isNull() | ~valid, "AMBER").otherwise("PASS")
    reason = F.when(~own, None).when(~boe, "CUSTOMS_BOE_MISSING").when(hs_code.isNull(), "CUSTOMS_HS_CODE_MISSING").when(~valid, "CUSTOMS_HS_CODE_INVALID")
    return F.struct(verdict.alias("verdict"), boe.alias("boe_found"), F.when(boe, valid).alias("hs_code_valid"), reason.alias("reason_code"))


def evidence_required(code: Column, present: Column) -> Column:
    """struct(verdict, required, missing): none missing passes, one is AMBER, more are ZERO."""
    required = lookup(code, EVIDENCE, F.array(*[F.lit(x) for x in EVIDENCE["GENERAL"]]))

    def has(document: str) -> Column:
        return F.exists(present, lambda d: d.rlike("(?i)" + EVIDENCE_ALIASES[document]))

    found = F.array_compact(F.array(*[F.when(has(d), d) for d in EVIDENCE_ALIASES]))
    missing = F.array_except(required, found)
    verdict = F.when(F.size(missing) == 0, "PASS").when(F.size(missing) == 1, "AMBER").otherwise("ZERO")
    return F.struct(verdict.alias("verdict"), required.alias("required"), missing.alias("missing"))


def lane_key(*parts: Column) -> Column:
    """Upper-cased parts joined by a double pipe; null when all are empty."""
    given = [F.coalesce(p, F.lit("")) for p in parts]
    return F.when(F.concat(*given) == "", None).otherwise(F.concat_ws("||", *[F.upper(F.trim(p)) for p in given]))


def lane_check(origin: Column, destination: Column, vehicle: Column, unit: Column, distance: Column, invoiced: Column, reference: Column) -> Column:
    """struct(lane_key, rate_band, short_run, fixed_suspect, delta_pct, band, verdict, reason_code, risk_score, rbr_trigger).

    The risk score never exceeds 0.4, so its trigger at 0.8 is never set; that is the rule as it stands.
    """
    key, delta = lane_key(origin, destination, vehicle, unit), delta_unsigned(invoiced, reference)
    band, short, fixed = band_of_delta(delta), F.coalesce(distance <= 10, F.lit(False)), F.coalesce(distance <= 2, F.lit(False))
    rate_band = F.when(distance.isNull(), "UNKNOWN").when(distance <= 50, "SHORT_RUN").when(distance > 300, "LONG_HAUL").otherwise("STANDARD")
    verdict = F.when(key.isNull() | (band == "UNKNOWN"), "AMBER").when((band == "CRITICAL") & (delta > 15), "ZERO").when(band.isin("HIGH", "CRITICAL"), "AMBER").otherwise("PASS")
    base = F.when(key.isNull(), "DOMESTIC_LANE_MISSING").when(band == "HIGH", "DOMESTIC_RATE_HIGH").when(band == "CRITICAL", "DOMESTIC_RATE_CRITICAL")
    shorter = F.when(short, F.coalesce(F.concat(base, F.lit("_SHORT_RUN")), F.lit("DOMESTIC_SHORT_RUN"))).otherwise(base)
    reason = F.when(fixed, F.coalesce(F.concat(shorter, F.lit("_FIXED_SUSPECT")), F.lit("DOMESTIC_FIXED_COST_SUSPECT"))).otherwise(shorter)
    risk = half_up(F.least(F.lit(1.0), delta / 15) * 0.4)
    return F.struct(
        key.alias("lane_key"), rate_band.alias("rate_band"), short.alias("short_run"), fixed.alias("fixed_suspect"), half_up(delta).alias("delta_pct"), band.alias("band"),
        verdict.alias("verdict"), reason.alias("reason_code"), risk.alias("risk_score"), F.coalesce(risk >= 0.8, F.lit(False)).alias("rbr_trigger"),
    )


def contract_validity(found: Column, valid_from: Column, valid_to: Column, day: Column) -> Column:
    """struct(verdict, reason_code) of dates as text, compared as text."""
    reason = F.when(~found, "CONTRACT_NOT_FOUND").when(day < valid_from, "CONTRACT_NOT_YET_ACTIVE").when(day > valid_to, "CONTRACT_EXPIRED")
    return F.struct(F.when(reason.isNull(), "PASS").otherwise("ZERO").alias("verdict"), reason.alias("reason_code"))


def shipment_echo(refs: dict[str, tuple[Column, float]]) -> Column:
    """struct(verdict, matches): the references given, in order, with their fixed confidences; no lookup takes place."""
    each = [F.when(F.nullif(c, F.lit("")).isNotNull(), F.struct(c.alias("shipment_ref"), F.lit(confidence).alias("confidence"), F.lit(name).alias("matched_via"))) for name, (c, confidence) in refs.items()]
    matches = F.array_compact(F.array(*each))
    n = F.size(matches)
    return F.struct(F.when(n == 0, "ZERO").when(n == len(refs), "PASS").otherwise("AMBER").alias("verdict"), matches.alias("matches"))


def explanation(reason: Column, rule: Column, line: Column, severity: Column) -> Column:
    """struct(explanation, recommended_action, reviewer_hint)."""
    default = F.concat(F.lit("Validation finding for rule "), rule, F.lit(" on line "), F.coalesce(line, F.lit("null")), F.lit("."))
    return F.struct(F.coalesce(lookup(reason, EXPLANATIONS), default).alias("explanation"), lookup(severity, ACTIONS).alias("recommended_action"), lookup(severity, HINTS).alias("reviewer_hint"))


def approval_gate(verdict: Column, approved: Column, export_type: Column, variance_aed: Column) -> Column:
    """struct(allowed, required_approver_role, error_code)."""
    waiting = (verdict == "AMBER") & (export_type == "FINAL_APPROVED") & ~F.coalesce(approved, F.lit(False))
    known = verdict.isin("PASS", "AMBER", "ZERO") & export_type.isin("FINAL_APPROVED", "REVIEW_PACK") | (verdict == "PASS")
    return F.struct(
        known.alias("allowed"), F.when(waiting, F.when(variance_aed < 500, "OPS_LEAD").otherwise("FINANCE_APPROVER")).alias("required_approver_role"),
        F.when(verdict == "FAILED", "VALIDATION_FAILED").when(~known, "INVALID_STATE").alias("error_code"),
    )


def executed_verdict(delta: Column, samples: Column, method: Column) -> Column:
    size = F.abs(delta)
    few = (method == "lane_median") & (samples < 3)
    return F.when(delta.isNull() | few, "REVIEW").when(size <= 2, "PASS").when(size <= 5, "WATCH").when(size <= 10, "REVIEW").otherwise("FAIL")


def final_verdict(special: Column, band: Column, delta: Column, autofail: float = 15) -> Column:
    """Track B: a CRITICAL delta that is not above autofail (a negative one, say) counts as verified."""
    return (
        F.when(F.nullif(special, F.lit("")).isNotNull(), special).when(band.isNull() | (band == "UNKNOWN"), "PENDING_REVIEW").when((band == "CRITICAL") & (delta > autofail), "FAIL")
        .when(band.isin("HIGH", "WARN"), "PENDING_REVIEW").otherwise("VERIFIED")
    )


def promote_executed(method: Column, current: Column, lane_id: Column, actual: Column, executed: Column) -> Column:
    """Whether an executed reference replaces the current one."""
    now, then = F.abs((actual - current) / F.nullif(current, F.lit(0.0)) * 100), F.abs((actual - executed) / F.nullif(executed, F.lit(0.0)) * 100)
    blank = F.trim(F.coalesce(lane_id, F.lit(""))) == ""
    return F.when(method.startswith("shipment_reference") | current.isNull() | blank, True).when(then.isNull(), False).when(now.isNull(), True).otherwise(then + 1e-6 < now)


def upload_kind(name: Column, mime: Column) -> Column:
    n = F.lower(name)
    out = F.when((mime == "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet") | n.endswith(".xlsx"), "xlsx")
    return out.when((mime == "text/markdown") | n.endswith(".md"), "md").when((mime == "text/plain") | n.endswith(".txt"), "txt").when((mime == "application/pdf") | n.endswith(".pdf"), "pdf").otherwise("unknown")


def issue_codes(checks: dict[str, Column]) -> Column:
    """Codes of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in checks.items()]))


def vision_issues(doc_type: Column, confidence: Column, length: Column, has_amount: Column, has_shipment: Column) -> Column:
    """Codes of what a parsed page lacks; any makes it AMBER."""
    invoice = doc_type.isin("CARRIER_RHS", "CARRIER_EVG", "CARRIER_CMA", "PORT_ALLIED", "PORT_CSP", "AIRPORT_FEES")
    return issue_codes({
        "UNKNOWN_DOCTYPE": doc_type == "UNKNOWN", "VISION_LOW_CONFIDENCE": confidence < 0.6, "LOW_TEXT_LENGTH": length < 80, "CUSTOMS_FINAL_REVIEW_REQUIRED": doc_type == "BOE_CUSTOMS",
        "INVOICE_AMOUNT_MISSING": invoice & ~has_amount, "NO_SHIPMENT_NO": ~has_shipment,
    })


def evidence_status(doc_type: Column, has_amount: Column) -> Column:
    return F.when(has_amount, "MATCHED_AMOUNT").when(doc_type.isin("DELIVERY_ORDER", "DELIVERY_NOTE", "AIRPORT_APPOINTMENT"), "NOT_APPLICABLE").when(doc_type == "BOE_CUSTOMS", "PARTIAL").when(doc_type == "UNKNOWN", "MISSING").otherwise("PARTIAL")


def rate_sheet_severity(verdict: Column, kind: Column, status: Column, evidence: Column) -> Column:
    special = kind.isin("TEXT_EXCEPTION", "MISSING_RATE") | status.isin("AUTO_COMPARE_WITH_DUPLICATE_REVIEW", "AUTO_COMPARE_REQUIRE_REVIEW_EVIDENCE", "EXCEPTION_EVIDENCE_REQUIRED", "MISSING_RATE_NO_AUTO_PASS")
    return F.when(verdict == "ZERO", "ZERO").when((kind == "TEXT_EXCEPTION") & (evidence == "MISSING"), "ZERO").when(F.coalesce(special, F.lit(False)) | (verdict == "AMBER"), "AMBER").otherwise("PASS")


def hash_status(expected: Column, actual: Column, pending: str = "pending") -> Column:
    """struct(verdict, status): only a hash that is given and differs counts against a source."""
    wrong = F.coalesce(actual != expected, F.lit(False))
    return F.struct(F.when(expected == pending, "AMBER").when(wrong, "ZERO").otherwise("PASS").alias("verdict"), F.when(expected == pending, "HASH_UNVERIFIED").when(wrong, "SOURCE_HASH_MISMATCH").otherwise("SOURCE_HASH_MATCH").alias("status"))


def parse_issue(message: Column) -> Column:
    m, out = F.upper(message), None
    for mark, kind in (("PDF_ENCRYPTED", "PDF_ENCRYPTED"), ("PDF_TOO_LARGE", "PDF_TOO_LARGE"), ("SCANNED_PAGE_DETECTED", "SCANNED_PAGE_DETECTED"), ("PARSE_PDF_UNSUPPORTED", "PDF_PARSE_UNSUPPORTED")):
        out = F.when(m.contains(mark), kind) if out is None else out.when(m.contains(mark), kind)
    return out


def may_approve(role: Column, variance_aed: Column) -> Column:
    return role == F.when(variance_aed < 500, "COST_CONTROL_LEAD").otherwise("FINANCE_APPROVER")


def can_resolve(role: Column, roles: Column) -> Column:
    return F.array_contains(F.split(roles, ","), role)


def literal_text(x: Column) -> Column:
    """A cell that would read as a formula gets a leading apostrophe."""
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


# Scores of evidence statuses, and the scores from which evidence passes or is amber.
EVIDENCE_SCORES = {"MATCHED_EXACT": 95, "MATCHED_AMOUNT": 85, "MATCHED_APPROVAL": 80, "PARTIAL": 60, "MISSING": 0, "CONFLICT": 0, "NOT_APPLICABLE": 100}
PASS_READY, AMBER_FROM = 85, 60


def evidence_score(status: Column) -> Column:
    """The score of an evidence status; null for none that is known."""
    out = F.lit(None).cast("int")
    for name, score in EVIDENCE_SCORES.items():
        out = F.when(status == name, score).otherwise(out)
    return out


def evidence_verdict(score: Column, critical: Column, final: Column) -> Column:
    """PASS and AMBER by score; below, critical evidence is ZERO where a final answer is asked for, and AMBER otherwise."""
    return F.when(score >= PASS_READY, "PASS").when((score >= AMBER_FROM) | ~(critical & final), "AMBER").otherwise("ZERO")
