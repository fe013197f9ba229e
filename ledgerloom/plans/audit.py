"""Queries of invoice rules, rate lookups and gates (scalar rules R, joins J, aggregates A, windows W, unions U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, places, rules
from ..operators import lookup, quantiles, recon, validation
from .base import CARDS, LINES, Tables, pick, query, sql_cases, sql_list, sql_pick

C = F.col
ROUND = "floor(({}) * 100 + 0.5) / 100"
CODE_SQL = f"CASE {sql_cases(rules.CHARGE_CODES, chr(39).join(['contains(lower(description), ', '{k}', ')']))} ELSE 'GENERAL' END"


@query("r1_normalize_lines", LINES + f", coded AS (SELECT *, {CODE_SQL} AS charge_code FROM lines) SELECT line_id, charge_code, CASE charge_code WHEN 'TRANSPORT' THEN 'TEU' WHEN 'HANDLING' THEN 'LIFT' ELSE 'LS' END AS unit, qty, amount, currency, qty IS NULL AND rate IS NULL AS rejected FROM coded")
def _(t: Tables) -> DataFrame:
    coded = t.lines().withColumn("charge_code", rules.charge_code(C("description")))
    return coded.select("line_id", "charge_code", rules.unit_of(C("charge_code")).alias("unit"), "qty", "amount", "currency", (C("qty").isNull() & C("rate").isNull()).alias("rejected"))


TYPE_B_SQL = " ".join(
    f"WHEN contains(lower(description), '{k}') THEN {{'type_b': '{c}', 'confidence': CASE WHEN lower(description) = '{k}' OR list_contains(string_split(lower(description), ' '), '{k}') THEN 0.95 ELSE 0.85 END::DOUBLE, 'matched_keyword': '{k}'}}"
    for c, words in rules.TYPE_B for k in words
)


@query("r2_type_b", LINES + f"SELECT line_id, b.type_b, b.confidence, b.matched_keyword FROM (SELECT line_id, CASE {TYPE_B_SQL} ELSE {{'type_b': 'OTHERS', 'confidence': 0.5::DOUBLE, 'matched_keyword': NULL}} END AS b FROM lines)")
def _(t: Tables) -> DataFrame:
    return t.lines().select("line_id", rules.type_b(C("description")).alias("b")).select("line_id", "b.*")


@query("r2b_type_b_by_table", LINES + f", r AS (SELECT unnest({sql_list(['INSPECTION', 'CUSTOMS', 'DO'])}) AS type_b, unnest([1, 2, 3]) AS priority, unnest({sql_list(['customs inspection', 'customs clearance', 'delivery order'])}) AS keyword) SELECT line_id, arg_min(type_b, priority) AS type_b FROM lines JOIN r ON contains(lower(description), keyword) GROUP BY line_id")
def _(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame([("INSPECTION", 1, "customs inspection"), ("CUSTOMS", 2, "customs clearance"), ("DO", 3, "delivery order")], "type_b string, priority int, keyword string")
    distinct = t.lines().select("line_id", F.lower("description").alias("d"))
    return distinct.join(F.broadcast(table), C("d").contains(C("keyword"))).groupBy("line_id").agg(F.min_by("type_b", "priority").alias("type_b"))


VARIANCE = "CASE WHEN contracted_rate = 0 THEN 0.0 ELSE (applied_rate - contracted_rate) / contracted_rate * 100 END"
RATE_SQL = f"""
  SELECT line_id, contracted_rate, applied_rate, CASE WHEN contracted_rate IS NULL OR applied_rate IS NULL THEN 'AMBER' WHEN abs(v) <= 2 THEN 'PASS' WHEN abs(v) <= 5 THEN 'AMBER' ELSE 'ZERO' END AS verdict,
    CASE WHEN contracted_rate IS NULL THEN 'RATE_NOT_FOUND' WHEN applied_rate IS NULL THEN 'RATE_NOT_APPLIED' WHEN abs(v) <= 2 THEN NULL WHEN abs(v) <= 5 THEN 'RATE_VARIANCE' ELSE 'RATE_EXCEEDS_THRESHOLD' END AS reason_code,
    {ROUND.format('v')} AS variance_pct, {ROUND.format('applied_rate - contracted_rate')} AS variance_amount, rate_type,
    CASE WHEN rate_type = 'MISSING_RATE' THEN 'MISSING_RATE_NO_AUTO_PASS' WHEN rate_type = 'TEXT_EXCEPTION' THEN 'EXCEPTION_EVIDENCE_REQUIRED' WHEN abs({ROUND.format('v')}) <= 2 THEN 'AUTO_COMPARE_OK'
         WHEN abs({ROUND.format('v')}) <= 5 THEN 'AUTO_COMPARE_WITH_DUPLICATE_REVIEW' ELSE 'AUTO_COMPARE_REQUIRE_REVIEW_EVIDENCE' END AS ai_rate_status,
    CASE WHEN contracted_rate IS NULL OR applied_rate IS NULL THEN NULL WHEN abs(v) <= 2 THEN 'MATCHED_AMOUNT' ELSE 'PARTIAL' END AS evidence_status,
    'CR-' || upper(substr(sha256(charge_code || '|' || lane), 1, 12)) AS contract_row_id
  FROM (SELECT *, {VARIANCE} AS v, CASE WHEN contracted_rate IS NOT NULL AND applied_rate IS NOT NULL THEN 'CONTRACT_NUMERIC' WHEN regexp_matches(rate_basis, '(?i)AT_COST|AS_PER_OFFER|LUMP_SUM') THEN 'TEXT_EXCEPTION' ELSE 'MISSING_RATE' END AS rate_type FROM found)"""


def rate_checks(t: Tables) -> DataFrame:
    found = lookup.lookup(t.applied(), t.rate_cards(), ["charge_code", "lane"], [-F.unix_date("effective_from"), C("card_id")])
    return found.withColumn("c", rules.rate_check(C("contracted_rate"), C("applied_rate"), C("rate_basis"))).select(*found.columns, "c.*")


@query("j1_r3_r4_r5_r6_rate_check", CARDS + ", one AS (SELECT * FROM rate_cards QUALIFY row_number() OVER (PARTITION BY charge_code, lane ORDER BY effective_from DESC, card_id) = 1), found AS (SELECT a.*, contracted_rate FROM applied a LEFT JOIN one USING (charge_code, lane))" + RATE_SQL)
def _(t: Tables) -> DataFrame:
    return rate_checks(t).select("line_id", "contracted_rate", "applied_rate", "verdict", "reason_code", "variance_pct", "variance_amount", "rate_type", "ai_rate_status", "evidence_status", rules.contract_row_id(C("charge_code"), C("lane")).alias("contract_row_id"))


@query("j1b_rate_check_batch", CARDS + ", last AS (SELECT charge_code, arg_max(card_id, card_id) AS card_id FROM rate_cards GROUP BY charge_code), found AS (SELECT a.line_id, a.charge_code, a.lane, a.rate_basis, a.applied_rate, r.contracted_rate FROM applied a LEFT JOIN last USING (charge_code) LEFT JOIN rate_cards r ON r.card_id = last.card_id) SELECT line_id, verdict, reason_code, variance_pct FROM (" + RATE_SQL + ")")
def _(t: Tables) -> DataFrame:
    last = lookup.last_per_key(t.rate_cards().select("charge_code", "card_id", "contracted_rate"), ["charge_code"], C("card_id")).select("charge_code", "contracted_rate")
    found = t.applied().join(last, "charge_code", "left")
    return found.select("line_id", rules.rate_check(C("contracted_rate"), C("applied_rate"), C("rate_basis")).alias("c")).select("line_id", "c.verdict", "c.reason_code", "c.variance_pct")


@query("j3_rate_as_of", CARDS + "SELECT line_id, lane, day, card_id, contracted_rate FROM (SELECT a.line_id, a.lane, a.day, r.card_id, r.contracted_rate, a.rowid AS k, row_number() OVER (PARTITION BY a.rowid ORDER BY r.effective_from DESC, r.card_id) AS n FROM (SELECT *, row_number() OVER () AS rowid FROM applied) a LEFT JOIN rate_cards r ON r.charge_code = a.charge_code AND r.lane = a.lane AND r.effective_from <= a.day AND a.day <= coalesce(r.effective_to, DATE '9999-12-31')) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    return lookup.as_of(t.applied(), t.rate_cards(), ["charge_code", "lane"], "day", "effective_from", "effective_to", ["card_id", "contracted_rate"], "card_id").select("line_id", "lane", "day", "card_id", "contracted_rate")


@query("j4_ledger_as_of", "SELECT order_id, day, ledger_order, ledger_rate FROM (SELECT o.o_orderkey AS order_id, o.o_orderdate::DATE AS day, l.o_orderkey AS ledger_order, l.o_totalprice AS ledger_rate, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l.o_orderdate DESC, l.o_orderkey) AS n FROM orders o LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') l ON l.o_custkey = o.o_custkey AND l.o_orderdate <= o.o_orderdate) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    orders = t.orders.select(C("o_custkey").alias("lane"), C("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("day"))
    ledger = t.orders.where("o_orderstatus = 'F'").select(C("o_custkey").alias("lane"), C("o_orderkey").alias("ledger_order"), C("o_totalprice").alias("ledger_rate"), F.to_date("o_orderdate").alias("at"))
    return lookup.latest_before(orders, ledger, ["lane"], "day", "at", ["ledger_order", "ledger_rate"], "ledger_order").select("order_id", "day", "ledger_order", "ledger_rate")


@query("r7_cost_guard", LINES + "SELECT line_id, qty * rate AS qty_x_rate, variance_pct, reason_code FROM guarded")
def _(t: Tables) -> DataFrame:
    return recon.cost_guard(t.lines()).select("line_id", "qty_x_rate", "variance_pct", "reason_code")


@query("r7_invoice_verdict", LINES + "SELECT order_id, CASE max(CASE WHEN reason_code = 'QTY_X_RATE_MISMATCH' THEN 2 WHEN reason_code IS NOT NULL THEN 1 ELSE 0 END) WHEN 2 THEN 'ZERO' WHEN 1 THEN 'AMBER' ELSE 'PASS' END AS verdict, count(*) AS n_lines FROM guarded GROUP BY order_id")
def _(t: Tables) -> DataFrame:
    return recon.invoice_verdicts(t.lines())


BAND_SQL = "CASE WHEN reason_code = 'QTY_X_RATE_MISMATCH' THEN 'CRITICAL' WHEN reason_code IS NOT NULL THEN 'WARN' WHEN abs(variance_pct) > 2 THEN 'WARN' ELSE 'PASS' END"


@query("r17_r18_bands", LINES + f"SELECT band, CASE band WHEN 'PASS' THEN 'PASS' WHEN 'WARN' THEN 'AMBER' ELSE 'ZERO' END AS verdict, count(*) AS n FROM (SELECT {BAND_SQL} AS band FROM guarded) GROUP BY band")
def _(t: Tables) -> DataFrame:
    return recon.cost_guard(t.lines()).groupBy("band").agg(F.count("*").alias("n")).select("band", numbers.band_to_verdict(C("band")).alias("verdict"), "n")


@query("r8_vat", LINES + "SELECT line_id, CASE WHEN vat_rate IS NULL THEN 'AMBER' WHEN vat_rate = 0.05 THEN 'PASS' WHEN abs(amount * vat_rate - amount * 0.05::DOUBLE) <= 0.01 THEN 'AMBER' ELSE 'ZERO' END AS verdict, amount * 0.05::DOUBLE AS expected_vat, amount * vat_rate AS applied_vat, CASE WHEN vat_rate IS NULL THEN 'VAT_RATE_NOT_SPECIFIED' WHEN vat_rate = 0.05 THEN CASE WHEN currency = 'USD' THEN 'FX_VAT_CHECK_REQUIRED' END WHEN abs(amount * vat_rate - amount * 0.05::DOUBLE) <= 0.01 THEN 'VAT_ROUNDING' ELSE 'VAT_RATE_MISMATCH' END AS reason_code FROM lines")
def _(t: Tables) -> DataFrame:
    return t.lines().select("line_id", rules.vat(C("amount"), C("currency"), C("vat_rate")).alias("v")).select("line_id", "v.*")


@query("r9_demurrage", LINES + f""", d AS (SELECT line_id, part_id, {CODE_SQL} AS code, list_filter([CASE WHEN part_id % 2 <> 0 THEN 'DATES' END, CASE WHEN part_id % 3 <> 0 THEN 'TARIFF' END, CASE WHEN part_id % 5 <> 0 THEN 'FREE_TIME' END, CASE WHEN part_id % 7 <> 0 THEN 'INVOICE' END], lambda x: x IS NOT NULL) AS gaps FROM lines),
  e AS (SELECT *, CASE WHEN code IN ('DEMURRAGE', 'DETENTION', 'STORAGE') THEN gaps ELSE [] END AS m FROM d)
  SELECT line_id, CASE WHEN len(m) = 0 THEN 'PASS' WHEN part_id % 4 = 0 THEN 'ZERO' ELSE 'AMBER' END AS verdict, array_to_string(m, ',') AS missing, CASE WHEN len(m) = 0 THEN NULL WHEN part_id % 4 = 0 THEN 'DEMDET_FINAL_MISSING_INPUTS' ELSE 'DEMDET_PARTIAL_INPUTS' END AS reason_code FROM e""")
def _(t: Tables) -> DataFrame:
    p = C("part_id")
    checked = rules.demurrage(rules.charge_code(C("description")), p % 2 == 0, p % 3 == 0, p % 5 == 0, p % 7 == 0, p % 4 == 0)
    return t.lines().select("line_id", checked.alias("d")).select("line_id", "d.verdict", F.array_join("d.missing_inputs", ",").alias("missing"), "d.reason_code")


@query("r10_fx_stub", LINES + "SELECT currency, target, CASE WHEN currency = target THEN 'PASS' ELSE 'AMBER' END AS verdict, CASE WHEN currency = target THEN 1.0 WHEN target IN ('AED', 'USD') THEN 3.6725 END::DOUBLE AS policy_rate, CASE WHEN currency <> target THEN 'FX_RATE_UNVERIFIABLE' END AS reason_code, count(*) AS n FROM (SELECT currency, ['AED', 'USD', 'KRW'][part_id % 3 + 1] AS target FROM lines) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    lines = t.lines().select("currency", pick(("AED", "USD", "KRW"), C("part_id")).alias("target"))
    return lines.withColumn("f", rules.fx_policy_stub(C("currency"), C("target"))).select("currency", "target", "f.*").groupBy("currency", "target", "verdict", "policy_rate", "reason_code").agg(F.count("*").alias("n"))


DOCS = ("BOE copy", "Delivery note 7", "Bill of Lading", "PO 4500", "Free  time letter", "lift log", "warehouse receipt", "insurance certificate", "customs declaration", "photo")


def with_documents(t: Tables) -> DataFrame:
    p = C("part_id")
    return t.lines().select("*", F.array(pick(DOCS, p), pick(DOCS, p + C("supp_id")), pick(DOCS, C("supp_id") * 3 + 1)).alias("docs"), F.when(p % 4 == 0, None).when(p % 4 == 1, "84.71.30").when(p % 4 == 2, "84A1").otherwise("123").alias("hs_code"))


DOCS_SQL = LINES + f", d AS (SELECT *, {CODE_SQL} AS code, [{sql_pick(DOCS, 'part_id')}, {sql_pick(DOCS, 'part_id + supp_id')}, {sql_pick(DOCS, 'supp_id * 3 + 1')}] AS docs, CASE part_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '84.71.30' WHEN 2 THEN '84A1' ELSE '123' END AS hs_code FROM lines)"


@query("r11_customs", DOCS_SQL + ", e AS (SELECT *, code = 'CUSTOMS' AND len(list_filter(docs, lambda x: regexp_matches(x, '(?i)BOE|Bill of Entry|customs declaration|CUSTOMS_DECL'))) > 0 AS boe, regexp_matches(replace(hs_code, '.', ''), '^\\d{4,10}$') AS ok FROM d) SELECT line_id, CASE WHEN code <> 'CUSTOMS' THEN 'PASS' WHEN NOT boe THEN 'ZERO' WHEN ok THEN 'PASS' ELSE 'AMBER' END AS verdict, boe AS boe_found, CASE WHEN boe THEN ok END AS hs_code_valid, CASE WHEN code <> 'CUSTOMS' THEN NULL WHEN NOT boe THEN 'CUSTOMS_BOE_MISSING' WHEN hs_code IS NULL THEN 'CUSTOMS_HS_CODE_MISSING' WHEN NOT ok THEN 'CUSTOMS_HS_CODE_INVALID' END AS reason_code FROM e")
def _(t: Tables) -> DataFrame:
    return with_documents(t).select("line_id", rules.customs(rules.charge_code(C("description")), C("hs_code"), C("docs")).alias("c")).select("line_id", "c.*")


EVIDENCE_SQL = " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in rules.EVIDENCE.items())
FOUND_SQL = ", ".join(f"CASE WHEN len(list_filter(docs, lambda x: regexp_matches(x, '(?i){p}'))) > 0 THEN '{k}' END" for k, p in rules.EVIDENCE_ALIASES.items())


@query("r12_evidence", DOCS_SQL + f", e AS (SELECT line_id, CASE code {EVIDENCE_SQL} END AS required, [{FOUND_SQL}] AS found FROM d), f AS (SELECT line_id, required, list_filter(required, lambda x: NOT list_contains(found, x)) AS missing FROM e) SELECT line_id, CASE len(missing) WHEN 0 THEN 'PASS' WHEN 1 THEN 'AMBER' ELSE 'ZERO' END AS verdict, array_to_string(required, ',') AS required, array_to_string(missing, ',') AS missing FROM f")
def _(t: Tables) -> DataFrame:
    return with_documents(t).select("line_id", rules.evidence_required(rules.charge_code(C("description")), C("docs")).alias("e")).select("line_id", "e.verdict", F.array_join("e.required", ",").alias("required"), F.array_join("e.missing", ",").alias("missing"))


LANE_SQL = LINES + """, k AS (SELECT line_id, upper(trim(origin)) || '||' || upper(trim(destination)) || '||' || upper(trim(vehicle)) || '||' || 'PER TRUCK' AS lane_key, distance_km,
    CASE WHEN standard_amount <> 0 THEN abs((amount * (1 + part_id % 5 * 0.04::DOUBLE) - standard_amount) / standard_amount) * 100 END AS delta FROM lines),
  b AS (SELECT *, CASE WHEN delta IS NULL THEN 'UNKNOWN' WHEN delta <= 2 THEN 'PASS' WHEN delta <= 5 THEN 'WARN' WHEN delta <= 10 THEN 'HIGH' ELSE 'CRITICAL' END AS band, coalesce(distance_km <= 10, false) AS short_run, coalesce(distance_km <= 2, false) AS fixed_suspect FROM k),
  r AS (SELECT *, CASE band WHEN 'HIGH' THEN 'DOMESTIC_RATE_HIGH' WHEN 'CRITICAL' THEN 'DOMESTIC_RATE_CRITICAL' END AS r0 FROM b),
  s AS (SELECT *, CASE WHEN short_run THEN coalesce(r0 || '_SHORT_RUN', 'DOMESTIC_SHORT_RUN') ELSE r0 END AS r1 FROM r),
  lane AS (SELECT line_id, lane_key, CASE WHEN distance_km IS NULL THEN 'UNKNOWN' WHEN distance_km <= 50 THEN 'SHORT_RUN' WHEN distance_km > 300 THEN 'LONG_HAUL' ELSE 'STANDARD' END AS rate_band, short_run, fixed_suspect, floor(delta * 100 + 0.5) / 100 AS delta_pct, band,
    CASE WHEN band = 'UNKNOWN' THEN 'AMBER' WHEN band = 'CRITICAL' AND delta > 15 THEN 'ZERO' WHEN band IN ('HIGH', 'CRITICAL') THEN 'AMBER' ELSE 'PASS' END AS verdict,
    CASE WHEN fixed_suspect THEN coalesce(r1 || '_FIXED_SUSPECT', 'DOMESTIC_FIXED_COST_SUSPECT') ELSE r1 END AS reason_code, floor(least(1.0::DOUBLE, delta / 15) * 0.4::DOUBLE * 100 + 0.5) / 100 AS risk_score, false AS rbr_trigger FROM s)
"""


def lanes(t: Tables) -> DataFrame:
    invoiced = C("amount") * (1 + C("part_id") % 5 * 0.04)
    checked = rules.lane_check(C("origin"), C("destination"), C("vehicle"), F.lit("PER TRUCK"), C("distance_km"), invoiced, C("standard_amount"))
    return t.lines().select("line_id", checked.alias("l")).select("line_id", "l.*")


@query("r13_lane_check", LANE_SQL + "SELECT * FROM lane")
def _(t: Tables) -> DataFrame:
    return lanes(t)


@query("a1_lane_summary", LANE_SQL + "SELECT count(*) AS total, count_if(short_run) AS short_run_count, count_if(fixed_suspect) AS fixed_cost_suspect_count, count_if(lane_key IS NULL) AS lanes_missing, count_if(band = 'PASS') AS band_pass, count_if(band = 'WARN') AS band_warn, count_if(band = 'HIGH') AS band_high, count_if(band = 'CRITICAL') AS band_critical, count_if(band = 'UNKNOWN') AS band_unknown FROM lane")
def _(t: Tables) -> DataFrame:
    bands = [F.count_if(C("band") == b).alias(f"band_{b.lower()}") for b in ("PASS", "WARN", "HIGH", "CRITICAL", "UNKNOWN")]
    return lanes(t).agg(F.count("*").alias("total"), F.count_if("short_run").alias("short_run_count"), F.count_if("fixed_suspect").alias("fixed_cost_suspect_count"), F.count_if(C("lane_key").isNull()).alias("lanes_missing"), *bands)


ROUTE_SQL = " ".join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{k}{chr(39)})' for k in words)} THEN {{'to': '{to}', 'c': {c}::DOUBLE}}" for to, c, words in rules.ROUTES)


@query("r14_route_question", f"SELECT conv_id, turn, r.to AS routed_to, least(1.0::DOUBLE, floor((r.c + bonus) * 100 + 0.5) / 100) AS confidence FROM (SELECT conv_id, turn, CASE {ROUTE_SQL} ELSE {{'to': 'check_cost_guard', 'c': 0.5::DOUBLE}} END AS r, CASE WHEN turn % 2 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations))")
def _(t: Tables) -> DataFrame:
    role = F.when(C("turn") % 2 == 0, "Finance Approver").otherwise("viewer")
    return t.conversations.select("conv_id", "turn", rules.route(F.coalesce("text", F.lit("")), role).alias("r")).select("conv_id", "turn", "r.*")


EXPLAIN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.EXPLANATIONS.items())


@query("r15_explanations", LINES + f"SELECT reason_code, count(*) AS n, CASE reason_code {EXPLAIN} ELSE 'Validation finding for rule COSTGUARD on line null.' END AS explanation, CASE WHEN reason_code = 'QTY_X_RATE_MISMATCH' THEN '{rules.ACTIONS['ZERO']}' ELSE '{rules.ACTIONS['AMBER']}' END AS recommended_action, CASE WHEN reason_code = 'QTY_X_RATE_MISMATCH' THEN '{rules.HINTS['ZERO']}' ELSE '{rules.HINTS['AMBER']}' END AS reviewer_hint FROM guarded WHERE reason_code IS NOT NULL GROUP BY reason_code")
def _(t: Tables) -> DataFrame:
    counted = recon.cost_guard(t.lines()).where("reason_code is not null").groupBy("reason_code", "line_verdict").agg(F.count("*").alias("n"))
    return counted.withColumn("e", rules.explanation(C("reason_code"), F.lit("COSTGUARD"), F.lit(None).cast("string"), C("line_verdict"))).select("reason_code", "n", "e.*")


@query("j2_r16_contracts", "WITH contracts AS (SELECT s_suppkey AS vendor, 'C' || s_suppkey AS contract_id, strftime(DATE '1996-01-01' + (s_suppkey % 6 * 200)::INT, '%Y-%m-%d') AS valid_from, strftime(DATE '1996-01-01' + (s_suppkey % 6 * 200 + 1000)::INT, '%Y-%m-%d') AS valid_to FROM supplier WHERE s_suppkey % 5 <> 0), x AS (SELECT l_orderkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS d, c.contract_id, c.valid_from, c.valid_to FROM lineitem LEFT JOIN contracts c ON c.vendor = l_suppkey), y AS (SELECT *, CASE WHEN contract_id IS NULL THEN 'CONTRACT_NOT_FOUND' WHEN d < valid_from THEN 'CONTRACT_NOT_YET_ACTIVE' WHEN d > valid_to THEN 'CONTRACT_EXPIRED' END AS reason_code FROM x) SELECT l_orderkey AS order_id, contract_id, CASE WHEN reason_code IS NULL THEN 'PASS' ELSE 'ZERO' END AS verdict, reason_code FROM y")
def _(t: Tables) -> DataFrame:
    start = F.date_add(F.lit("1996-01-01").cast("date"), (C("s_suppkey") % 6 * 200).cast("int"))
    contracts = t.supplier.where("s_suppkey % 5 <> 0").select(C("s_suppkey").alias("supp_id"), F.concat(F.lit("C"), C("s_suppkey").cast("string")).alias("contract_id"), F.date_format(start, "yyyy-MM-dd").alias("valid_from"), F.date_format(F.date_add(start, 1000), "yyyy-MM-dd").alias("valid_to"))
    found = lookup.lookup(t.lines(), contracts, ["supp_id"], [C("contract_id")])
    return found.select("order_id", "contract_id", rules.contract_validity(C("contract_id").isNotNull(), C("valid_from"), C("valid_to"), F.date_format("day", "yyyy-MM-dd")).alias("v")).select("order_id", "contract_id", "v.*")


POLICY = "WITH policies AS (SELECT nation_id AS policy_id, f AS from_currency, g AS to_currency, 3.6725::DOUBLE + nation_id / 1000.0::DOUBLE AS fx_rate, DATE '1995-01-01' + (nation_id * 90)::INT AS valid_from, DATE '1995-01-01' + (nation_id * 90 + 150)::INT AS valid_to, DATE '1995-01-01' + (nation_id * 90 + CASE WHEN nation_id % 4 = 0 THEN 400 ELSE 10 END)::INT AS rate_date FROM (SELECT n_nationkey AS nation_id, CASE WHEN n_nationkey % 2 = 0 THEN 'USD' ELSE 'AED' END AS f, CASE WHEN n_nationkey % 2 = 0 THEN 'AED' ELSE 'USD' END AS g FROM nation)) "


@query("j5_fx_convert", POLICY + ", x AS (SELECT row_number() OVER () AS k, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id, l_extendedprice AS amount, CASE WHEN l_suppkey % 3 = 0 THEN 'USD' ELSE 'AED' END AS currency, l_shipdate::DATE AS day FROM lineitem), y AS (SELECT x.*, p.*, row_number() OVER (PARTITION BY k ORDER BY policy_id) AS n FROM x LEFT JOIN policies p ON x.currency <> 'AED' AND p.from_currency = x.currency AND p.to_currency = 'AED' AND x.day BETWEEN p.valid_from AND p.valid_to), z AS (SELECT *, CASE WHEN currency = 'AED' THEN NULL WHEN policy_id IS NULL THEN 'FX_POLICY_REQUIRED' WHEN rate_date < valid_from OR rate_date > valid_to THEN 'FX_POLICY_VALIDATION_FAILED' END AS error_code FROM y WHERE n = 1) SELECT line_id, CASE WHEN error_code IS NULL THEN policy_id END AS fx_policy_id, CASE WHEN currency = 'AED' THEN amount WHEN error_code IS NULL THEN floor(amount * fx_rate * 10000 + 0.5) / 10000 END AS converted_amount, error_code FROM z")
def _(t: Tables) -> DataFrame:
    n = C("n_nationkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (n * 90).cast("int"))
    policies = t.nation.select(
        n.alias("policy_id"), F.when(n % 2 == 0, "USD").otherwise("AED").alias("from_currency"), F.when(n % 2 == 0, "AED").otherwise("USD").alias("to_currency"), (F.lit(3.6725) + n / 1000.0).alias("fx_rate"),
        start.alias("valid_from"), F.date_add(start, 150).alias("valid_to"), F.date_add(start, F.when(n % 4 == 0, 400).otherwise(10)).alias("rate_date"))
    lines = t.lines().select("line_id", "amount", "currency", F.lit("AED").alias("target"), "day")
    return lookup.convert(lines, policies, "currency", "target", "amount", "day").select("line_id", "fx_policy_id", "converted_amount", "error_code")


@query("j6_a4_duplicates", "WITH inv AS (SELECT o_orderkey, sha256(o_custkey::VARCHAR) AS vendor_hash, sha256(strftime(o_orderdate, '%Y-%m')) AS invoice_hash, CASE WHEN o_orderkey % 2 = 0 THEN 100.0::DOUBLE ELSE o_totalprice END AS amount FROM orders), prev AS (SELECT * FROM inv WHERE o_orderkey % 3 = 0), a AS (SELECT i.o_orderkey, count(p.o_orderkey) AS n, bool_and(abs(p.amount - i.amount) <= 0.01) AS same FROM inv i LEFT JOIN prev p USING (vendor_hash, invoice_hash) GROUP BY i.o_orderkey) SELECT o_orderkey AS order_id, n AS duplicate_count, CASE WHEN n = 0 THEN 'PASS' WHEN same THEN 'ZERO' ELSE 'AMBER' END AS verdict, CASE WHEN n = 0 THEN NULL WHEN same THEN 'DUPLICATE_INVOICE' ELSE 'AMOUNT_MISMATCH' END AS reason_code FROM a")
def _(t: Tables) -> DataFrame:
    inv = t.orders.select(C("o_orderkey").alias("order_id"), F.sha2(C("o_custkey").cast("string"), 256).alias("vendor_hash"), F.sha2(F.date_format("o_orderdate", "yyyy-MM"), 256).alias("invoice_hash"), F.when(C("o_orderkey") % 2 == 0, 100.0).otherwise(C("o_totalprice")).alias("amount"))
    return lookup.duplicate_invoices(inv, inv.where("order_id % 3 = 0")).select("order_id", "duplicate_count", "verdict", "reason_code")


@query("j7_seen_keys", "WITH r AS (SELECT event_id, user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS k FROM events), known AS (SELECT DISTINCT k FROM r WHERE event_id % 10 = 0) SELECT event_id, coalesce(k IN (SELECT k FROM known), false) OR row_number() OVER (PARTITION BY k ORDER BY event_id) > 1 AS duplicate FROM r WHERE event_id % 10 <> 0")
def _(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.concat_ws("|", C("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd HH")).alias("k"))
    return lookup.seen(rows.where("event_id % 10 <> 0"), rows.where("event_id % 10 = 0"), "k", "event_id").select("event_id", "duplicate")


@query("j8_merge_results", "WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS note FROM orders), s1 AS (SELECT l_orderkey AS id, arg_max(l_returnflag, k) AS status FROM (SELECT *, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey AS k FROM lineitem WHERE l_linenumber > 2) GROUP BY 1), s2 AS (SELECT l_orderkey AS id, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT id, coalesce(s1.status, b.status) AS status, note, s2.n FROM b LEFT JOIN s1 USING (id) LEFT JOIN s2 USING (id)")
def _(t: Tables) -> DataFrame:
    base = t.orders.select(C("o_orderkey").alias("id"), C("o_orderstatus").alias("status"), C("o_orderpriority").alias("note"))
    ordinal = C("l_linenumber").cast("long") * 100000000 + C("l_partkey") * 10000 + C("l_suppkey")
    s1 = t.lineitem.where("l_linenumber > 2").select(C("l_orderkey").alias("id"), C("l_returnflag").alias("status"), ordinal.alias("ordinal"))
    s2 = t.lineitem.select(C("l_orderkey").alias("id"), C("l_linenumber").alias("n"), C("l_linenumber").alias("ordinal"))
    return lookup.merge(base, [s1, s2], "id")


@query("j10_compare_extractions", "WITH a AS (SELECT o_orderkey AS id, upper(regexp_replace(trim(o_orderpriority), '\\s+', ' ', 'g')) AS priority, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS id, upper(CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE regexp_replace(trim(o_orderpriority), '\\s+', ' ', 'g') END) AS priority, o_orderstatus AS status FROM orders WHERE o_orderkey % 11 <> 0), u AS (SELECT id, 'priority' AS field, a.priority AS l, b.priority AS r FROM a FULL JOIN b USING (id) UNION ALL SELECT id, 'status', a.status, b.status FROM a FULL JOIN b USING (id)) SELECT id, field, sha256(l) AS left_hash, sha256(r) AS right_hash FROM u WHERE l IS DISTINCT FROM r")
def _(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderkey % 7 <> 0").select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("priority"), C("o_orderstatus").alias("status"))
    b = t.orders.where("o_orderkey % 11 <> 0").select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 5 == 0, "other").otherwise(C("o_orderpriority")).alias("priority"), C("o_orderstatus").alias("status"))
    return lookup.compare(a, b, "id", ["priority", "status"])


@query("a3_final_recon", LINES + ", r AS (SELECT currency, shipment_ref, line_id, order_id, line_no, reason_code, amount::DECIMAL(18,4) AS a, (amount - CASE WHEN variance_pct > 0 THEN amount * variance_pct / 100 ELSE 0 END)::DECIMAL(18,4) AS b FROM guarded), s AS (SELECT currency, shipment_ref, sum(a) AS invoice_total, sum(b) AS reviewed_total, (list(reason_code ORDER BY order_id, line_no, line_id) FILTER (reason_code IS NOT NULL))[1] AS evidence_ref FROM r GROUP BY 1, 2) SELECT currency, shipment_ref, invoice_total::DOUBLE AS invoice_total, reviewed_total::DOUBLE AS reviewed_total, (invoice_total - reviewed_total)::DOUBLE AS variance, CASE WHEN invoice_total > 0 THEN (invoice_total - reviewed_total)::DOUBLE / invoice_total::DOUBLE * 100 ELSE 0 END AS variance_pct, CASE WHEN invoice_total = reviewed_total THEN 'MATCHED' ELSE 'MISMATCH' END AS recon_status, evidence_ref FROM s")
def final_recon(t: Tables) -> DataFrame:
    out = recon.final_recon(t.lines())
    return out.withColumns({c: C(c).cast("double") for c in ("invoice_total", "reviewed_total", "variance")})


@query("a2_a7_r21_reconcile", LINES + ", s AS (SELECT order_id, sum(amount::DECIMAL(18,2)) AS line_total, sum(CASE WHEN NOT contains(lower(description), 'bank') THEN amount::DECIMAL(18,2) END) AS type_b_total FROM lines GROUP BY 1), j AS (SELECT s.*, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN line_total + 50 ELSE line_total END AS invoice_total, o_orderkey % 2 = 0 AS domestic FROM s JOIN orders ON o_orderkey = order_id), k AS (SELECT *, CASE WHEN invoice_total IS NULL THEN 'FINAL_SUBTOTAL_MISSING' WHEN abs(invoice_total - line_total) > CASE WHEN domestic THEN 100 ELSE 0.01 END THEN 'LINE_TOTAL_MISMATCH' WHEN abs(line_total - type_b_total) > CASE WHEN domestic THEN 100 ELSE 0.01 END THEN 'TYPEB_TOTAL_MISMATCH' END AS reason FROM j) SELECT order_id, line_total::DOUBLE AS line_total, CASE WHEN reason IS NULL THEN 'PASS' WHEN reason = 'TYPEB_TOTAL_MISMATCH' THEN 'ZERO' ELSE 'AMBER' END AS verdict, reason FROM k")
def _(t: Tables) -> DataFrame:
    money = C("amount").cast("decimal(18,2)")
    sums = t.lines().groupBy("order_id").agg(F.sum(money).alias("line_total"), F.sum(F.when(~F.lower("description").contains("bank"), money)).alias("type_b_total"))
    j = sums.join(t.orders.select(C("o_orderkey").alias("order_id")), "order_id")
    total = F.when(C("order_id") % 9 == 0, None).when(C("order_id") % 4 == 0, C("line_total") + 50).otherwise(C("line_total"))
    return j.select("order_id", C("line_total").cast("double").alias("line_total"), recon.reconcile(total, C("line_total"), C("type_b_total"), C("order_id") % 2 == 0).alias("r")).select("order_id", "line_total", "r.*")


@query("a5_gate", LINES + f", b AS (SELECT order_id, line_id, max(CASE {BAND_SQL} WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END) AS r FROM guarded GROUP BY 1, 2), e AS (SELECT order_id, line_id, CASE WHEN part_id % 20 = 0 THEN 2 ELSE 1 END AS r FROM lines WHERE part_id % 10 = 0), p AS (SELECT order_id, line_id, greatest(max(b.r), coalesce(max(e.r), 0)) AS r FROM b LEFT JOIN e USING (order_id, line_id) GROUP BY 1, 2), d AS (SELECT o_orderkey AS order_id, 2 AS r FROM orders WHERE o_orderkey % 50 = 0), n AS (SELECT order_id, CASE WHEN distance_km IS NULL THEN 1 WHEN distance_km > 395 THEN 2 ELSE 0 END AS r FROM lines), u AS (SELECT order_id, r, 1 AS line FROM p UNION ALL SELECT order_id, r, 0 FROM e UNION ALL SELECT order_id, r, 0 FROM d UNION ALL SELECT order_id, r, 0 FROM n) SELECT order_id AS job_id, ['PASS', 'AMBER', 'ZERO'][max(r) + 1] AS verdict, count_if(line = 1 AND r = 2) AS n_zero, count_if(line = 1 AND r = 1) AS n_amber FROM u GROUP BY 1")
def _(t: Tables) -> DataFrame:
    guarded = recon.cost_guard(t.lines()).withColumnRenamed("order_id", "job_id")
    evidence = guarded.where("part_id % 10 = 0").select("job_id", "line_id", F.when(C("part_id") % 20 == 0, "ZERO").otherwise("AMBER").alias("severity"))
    duplicates = t.orders.where("o_orderkey % 50 = 0").select(C("o_orderkey").alias("job_id"), F.lit("ZERO").alias("severity"))
    far = guarded.select("job_id", F.when(C("distance_km").isNull(), "AMBER").when(C("distance_km") > 395, "ZERO").otherwise("PASS").alias("verdict"))
    return recon.gate(guarded.select("job_id", "line_id", "band"), evidence, duplicates, far)


@query("a6_counts", LINES + f"SELECT count_if(band = 'CRITICAL') AS n_critical, count_if(band = 'WARN') AS n_warn, count(*) AS n_lines, printf('%d of %d lines need review', count_if(band <> 'PASS'), count(*)) AS summary FROM (SELECT {BAND_SQL} AS band FROM guarded)")
def _(t: Tables) -> DataFrame:
    bad = F.count_if(C("band") != "PASS")
    return recon.cost_guard(t.lines()).agg(F.count_if(C("band") == "CRITICAL").alias("n_critical"), F.count_if(C("band") == "WARN").alias("n_warn"), F.count("*").alias("n_lines"), F.format_string("%d of %d lines need review", bad, F.count("*")).alias("summary"))


@query("a9_a10_medians", LINES + "SELECT origin, destination, vehicle, median(rate) AS rate, median(distance_km) AS distance_km, count(*) AS n FROM lines GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    keys = ["origin", "destination", "vehicle"]
    rate, distance = quantiles.quantiles(t.lines(), keys, "rate", (0.5,), ("rate",)), quantiles.quantiles(t.lines(), keys, "distance_km", (0.5,), ("distance_km",))
    return t.lines().groupBy(*keys).agg(F.count("*").alias("n")).join(rate, keys).join(distance, keys)


@query("a11_winsorize", LINES + ", q AS (SELECT vehicle, currency, quantile_cont(amount, 0.05) AS lo, quantile_cont(amount, 0.95) AS hi FROM lines GROUP BY 1, 2) SELECT line_id, least(greatest(amount, lo), hi) AS amount_winsorized FROM lines JOIN q USING (vehicle, currency)")
def _(t: Tables) -> DataFrame:
    return quantiles.winsorized(t.lines(), ["vehicle", "currency"], "amount").select("line_id", "amount_winsorized")


@query("a12_a26_value_counts", LANE_SQL + "SELECT 'band' AS field, band AS value, count(*) AS n FROM lane GROUP BY 2 UNION ALL SELECT 'verdict', verdict, count(*) FROM lane GROUP BY 2 UNION ALL SELECT 'rate_band', rate_band, count(*) FROM lane GROUP BY 2")
def _(t: Tables) -> DataFrame:
    fields = ["band", "verdict", "rate_band"]
    return lanes(t).unpivot([], fields, "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


@query("a13_lane_reference", LINES + ", f AS (SELECT origin, destination, shipment_ref, min(line_id) AS met FROM lines GROUP BY 1, 2, 3), r AS (SELECT origin, destination, string_agg(shipment_ref, ' | ' ORDER BY met, shipment_ref) AS refs FROM f GROUP BY 1, 2) SELECT l.origin, l.destination, count(*) AS n, arg_min(l.vehicle, l.line_id) FILTER (l.vehicle <> '') AS vehicle, any_value(r.refs) AS refs FROM lines l JOIN r USING (origin, destination) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    keys = ["origin", "destination"]
    seen = t.lines().groupBy(*keys, "shipment_ref").agg(F.min("line_id").alias("at"))  # a reference once, where it is met first
    refs = seen.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shipment_ref"))), lambda x: x["shipment_ref"]), " | ").alias("refs"))
    first = F.min_by(F.nullif("vehicle", F.lit("")), F.when(C("vehicle") != "", C("line_id")))
    return t.lines().groupBy(*keys).agg(F.count("*").alias("n"), first.alias("vehicle")).join(refs, keys)


@query("a14_type_b_tie_out", LINES + "SELECT currency, sum(CASE WHEN part_id % 12 = 2 THEN amount::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS thc, sum(CASE WHEN part_id % 12 = 4 THEN amount::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS storage, sum(amount::DECIMAL(18,2))::DOUBLE AS total FROM lines GROUP BY 1")
def _(t: Tables) -> DataFrame:
    money = C("amount").cast("decimal(18,2)")
    kind = F.when(C("description") == "THC", "THC").when(C("description") == "yard storage charge", "STORAGE").otherwise("OTHER")
    wide = t.lines().select("currency", kind.alias("b"), money.alias("m")).groupBy("currency").pivot("b", ["THC", "STORAGE", "OTHER"]).agg(F.sum("m"))
    zero = F.lit(0).cast("decimal(28,2)")
    thc, storage, other = (F.coalesce(C(c), zero) for c in ("THC", "STORAGE", "OTHER"))
    return wide.select("currency", thc.cast("double").alias("thc"), storage.cast("double").alias("storage"), (thc + storage + other).cast("double").alias("total"))


@query("a17_completion_rate", "SELECT o_custkey AS unit, floor(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) * 10000 + 0.5) / 10000 AS completion FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy(C("o_custkey").alias("unit")).agg(numbers.half_up(F.avg(F.when(C("o_orderstatus") == "F", 1.0).otherwise(0.0)), 4).alias("completion"))


@query("a18_a19_table_counts", " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n, count(*) >= {low} AS healthy FROM {x}" for x, low in (("orders", 1000), ("customer", 100), ("part", 100), ("supplier", 50), ("nation", 25), ("region", 6))))
def _(t: Tables) -> DataFrame:
    out = None
    for name, low in (("orders", 1000), ("customer", 100), ("part", 100), ("supplier", 50), ("nation", 25), ("region", 6)):
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (C("n") >= low).alias("healthy"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a20_graph_degrees", "WITH e AS (SELECT 'c' || o_custkey AS a, 'p' || l_partkey AS b, c_nationkey AS ca, l_partkey % 7 AS cb FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey), u AS (SELECT a AS node, cb AS other FROM e UNION ALL SELECT b, ca FROM e) SELECT node, count(*) AS degree, count(DISTINCT other) AS communities FROM u GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = t.orders.join(t.lineitem, C("o_orderkey") == C("l_orderkey")).join(t.customer, C("c_custkey") == C("o_custkey"))
    ends = F.explode(F.array(F.struct(F.concat(F.lit("c"), C("o_custkey").cast("string")).alias("node"), (C("l_partkey") % 7).alias("other")), F.struct(F.concat(F.lit("p"), C("l_partkey").cast("string")).alias("node"), C("c_nationkey").cast("long").alias("other"))))
    return e.select(ends.alias("e")).groupBy("e.node").agg(F.count("*").alias("degree"), F.count_distinct("e.other").alias("communities"))


@query("a22_master_checks", "SELECT count(*) AS n, count(DISTINCT p_partkey) AS n_keys, count_if(p_name IS NULL OR p_brand IS NULL OR p_type IS NULL) AS n_incomplete, count_if(p_size NOT BETWEEN 1 AND 40) AS n_outside FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("n_keys"), F.count_if(C("p_name").isNull() | C("p_brand").isNull() | C("p_type").isNull()).alias("n_incomplete"), F.count_if(~C("p_size").between(1, 40)).alias("n_outside"))


@query("a25_a28_output_checks", LINES + "SELECT count(*) AS n, count_if(abs(qty * rate - amount) > 0.05) AS n_product, count_if(qty IS NULL) AS n_no_qty, count_if(rate IS NULL) AS n_no_rate, count_if(trim(vehicle) = '') AS n_no_vehicle FROM lines")
def _(t: Tables) -> DataFrame:
    return t.lines().agg(F.count("*").alias("n"), F.count_if(F.abs(C("qty") * C("rate") - C("amount")) > 0.05).alias("n_product"), F.count_if(C("qty").isNull()).alias("n_no_qty"), F.count_if(C("rate").isNull()).alias("n_no_rate"), F.count_if(F.trim("vehicle") == "").alias("n_no_vehicle"))


@query("a29_rule_shares", "SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("share", C("n") / F.sum("n").over(Window.partitionBy()))


@query("a24_tool_log", "SELECT event_type AS tool, CASE WHEN value < 10 THEN 'ERROR' ELSE 'OK' END AS status, count(*) AS n, max(value) AS slowest FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(C("event_type").alias("tool"), F.when(C("value") < 10, "ERROR").otherwise("OK").alias("status")).agg(F.count("*").alias("n"), F.max("value").alias("slowest"))


@query("r20_approval_gate", "WITH g AS (SELECT o_orderkey AS order_id, ['PASS', 'AMBER', 'ZERO', 'FAILED'][o_orderkey % 4 + 1] AS v, CASE WHEN o_custkey % 2 = 0 THEN 'FINAL_APPROVED' ELSE 'REVIEW_PACK' END AS x, o_custkey % 3 = 0 AS ok, o_totalprice / 100 AS var FROM orders) SELECT order_id, v <> 'FAILED' AS allowed, CASE WHEN v = 'AMBER' AND x = 'FINAL_APPROVED' AND NOT ok THEN CASE WHEN var < 500 THEN 'OPS_LEAD' ELSE 'FINANCE_APPROVER' END END AS required_approver_role, CASE WHEN v = 'FAILED' THEN 'VALIDATION_FAILED' END AS error_code FROM g")
def _(t: Tables) -> DataFrame:
    gate = rules.approval_gate(pick(("PASS", "AMBER", "ZERO", "FAILED"), C("o_orderkey")), C("o_custkey") % 3 == 0, F.when(C("o_custkey") % 2 == 0, "FINAL_APPROVED").otherwise("REVIEW_PACK"), C("o_totalprice") / 100)
    return t.orders.select(C("o_orderkey").alias("order_id"), gate.alias("g")).select("order_id", "g.*")


@query("r43_r44_transitions", f"WITH m AS (SELECT user_id, event_id, {sql_pick(rules.STATES, 'event_id * 5 + user_id')} AS \"from\", {sql_pick(rules.STATES, 'event_id')} AS \"to\" FROM events), a(\"from\", \"to\") AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, bs in rules.TRANSITIONS.items() for b in bs)}) SELECT event_id, \"from\", \"to\" FROM m ANTI JOIN a USING (\"from\", \"to\") WHERE \"from\" <> \"to\"")
def _(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([(a, b) for a, bs in rules.TRANSITIONS.items() for b in bs], "from string, to string")
    moves = t.events.select("event_id", pick(rules.STATES, C("event_id") * 5 + C("user_id")).alias("from"), pick(rules.STATES, C("event_id")).alias("to"))
    return lookup.illegal_transitions(moves, allowed).select("event_id", "from", "to")


@query("r44_legacy_status", f"SELECT event_id, CASE s {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in rules.LEGACY_STATUS.items())} END AS status FROM (SELECT event_id, {sql_pick((*rules.LEGACY_STATUS, 'BROKEN'), 'event_id')} AS s FROM events)")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", rules.lookup(pick((*rules.LEGACY_STATUS, "BROKEN"), C("event_id")), rules.LEGACY_STATUS).alias("status"))


ECHO = "WITH s AS (SELECT c_custkey AS k, [CASE WHEN c_custkey % 2 = 0 THEN 'BL' || c_custkey END, 'S' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'J' || c_custkey END, CASE WHEN c_custkey % 5 <> 0 THEN 'DN' || c_custkey END] AS v FROM customer), e AS (SELECT CASE WHEN k % 60 = 1 THEN 0 ELSE len([x FOR x IN v IF x <> '']) END AS n, k, CASE WHEN k % 60 = 1 THEN NULL ELSE [x FOR x IN v IF x <> ''][1] END AS best FROM s) SELECT k AS c_custkey, CASE n WHEN 0 THEN 'ZERO' WHEN 4 THEN 'PASS' ELSE 'AMBER' END AS verdict, n::INT AS n, best FROM e"


@query("r47_shipment_echo", ECHO)
def _(t: Tables) -> DataFrame:
    """Four references in order of their confidence, each of which may be missing or blank; some customers have none."""
    key, k = C("c_custkey"), C("c_custkey").cast("string")
    given = {"bl_number": F.when(key % 2 == 0, F.concat(F.lit("BL"), k)), "shipment_ref": F.concat(F.lit("S"), k), "job_number": F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("J"), k)), "do_number": F.when(key % 5 != 0, F.concat(F.lit("DN"), k))}
    echo = rules.shipment_echo({f: (F.when(key % 60 != 1, given[f]), c) for f, c in validation.REFERENCES.items()})
    return t.customer.select("c_custkey", echo.alias("e")).select("c_custkey", "e.verdict", F.size("e.matches").alias("n"), F.get("e.matches", F.lit(0))["shipment_ref"].alias("best"))


VALIDATED = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 'V' END AS vendor, ['AED', 'USD', 'KRW'][o_custkey % 3 + 1] AS cur, o_orderdate::DATE AS issue, o_orderdate::DATE + ((o_orderkey % 5)::INT - 1) AS due FROM orders),
l AS (SELECT l_orderkey AS k, ['AED', 'USD', '', 'EUR'][l_partkey % 4 + 1] AS cur, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem),
i AS (SELECT k, 'REQUIRED_FIELD_MISSING' AS code, 'error' AS severity FROM o WHERE vendor = ' ' UNION ALL SELECT k, 'UNSUPPORTED_CURRENCY', 'error' FROM o WHERE vendor <> ' ' AND cur = 'KRW' UNION ALL SELECT k, 'DUE_DATE_BEFORE_ISSUE_DATE', 'error' FROM o WHERE vendor <> ' ' AND due < issue
  UNION ALL SELECT k, 'UNSUPPORTED_CURRENCY', 'error' FROM l JOIN o USING (k) WHERE vendor <> ' ' AND l.cur = 'EUR' UNION ALL SELECT k, 'FX_RATE_MISSING', 'warning' FROM l JOIN o USING (k) WHERE vendor <> ' ' AND l.cur IN ('AED', 'USD') AND l.cur <> o.cur
  UNION ALL SELECT k, 'DUPLICATE_INVOICE', 'error' FROM o WHERE vendor <> ' ' AND k % 14 = 3)
SELECT o.k AS invoice_id, NOT coalesce(bool_or(severity = 'error'), false) AS valid, count(code) AS n_issues, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM o LEFT JOIN i USING (k) GROUP BY o.k"""  # fmt: skip


@query("r24_r26_validated_invoices", VALIDATED)
def _(t: Tables) -> DataFrame:
    """Each invoice with whether it is valid; a blank vendor stops all other rules, lines may have a currency of their own."""
    k = C("o_orderkey")
    inv = t.orders.select(k.alias("invoice_id"), F.when(k % 10 == 0, " ").otherwise("V").alias("vendor"), pick(("AED", "USD", "KRW"), C("o_custkey")).alias("currency"), F.to_date("o_orderdate").alias("issue_date"), F.date_add(F.to_date("o_orderdate"), (k % 5).cast("int") - 1).alias("due_date"))
    lines = t.lineitem.select(C("l_orderkey").alias("invoice_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"), pick(("AED", "USD", "", "EUR"), C("l_partkey")).alias("currency"))
    issue = F.struct(F.lit("DUPLICATE_INVOICE").alias("code"), F.lit("error").alias("severity"), F.lit("invoice").alias("path"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    twice = inv.where("invoice_id % 14 = 3").select("invoice_id", issue.alias("issue"))
    verdicts, issues = validation.validated(inv, lines, ("vendor", "issue_date"), [twice])
    codes = issues.groupBy("invoice_id").agg(F.array_join(F.array_sort(F.collect_set("issue.code")), ",").alias("codes"))
    return verdicts.join(codes, "invoice_id", "left").withColumn("codes", F.coalesce("codes", F.lit("")))


@query("r27_numeric_integrity", LINES + "SELECT line_id, CASE WHEN qty IS NULL OR rate IS NULL THEN NULL WHEN abs(qty * rate - amount) <= 0.01 THEN 'PASS' ELSE 'AMBER' END AS status FROM lines")
def _(t: Tables) -> DataFrame:
    return t.lines().select("line_id", F.when(C("qty").isNull() | C("rate").isNull(), None).when(F.abs(C("qty") * C("rate") - C("amount")) <= 0.01, "PASS").otherwise("AMBER").alias("status"))


TRACK_B = LINES + ", x AS (SELECT line_id, part_id, supp_id, distance_km, CASE WHEN standard_amount <> 0 THEN (amount * (1 + part_id % 5 * 0.05::DOUBLE) - standard_amount) / standard_amount * 100 END AS delta, CASE WHEN part_id % 47 = 0 THEN 'SPECIAL_PASS' END AS special FROM lines), b AS (SELECT *, CASE WHEN delta IS NULL THEN 'UNKNOWN' WHEN abs(delta) <= 2 THEN 'PASS' WHEN abs(delta) <= 5 THEN 'WARN' WHEN abs(delta) <= 10 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM x) "


@query("r28_r29_r30_r31_track_b", TRACK_B + "SELECT line_id, delta AS delta_pct, band, CASE WHEN special IS NOT NULL THEN special WHEN band = 'UNKNOWN' THEN 'PENDING_REVIEW' WHEN band = 'CRITICAL' AND delta > 15 THEN 'FAIL' WHEN band IN ('HIGH', 'WARN') THEN 'PENDING_REVIEW' ELSE 'VERIFIED' END AS verdict, CASE WHEN distance_km <= 10 THEN 1 ELSE 0 END AS short_run_flag, CASE WHEN distance_km <= 2 THEN 1 ELSE 0 END AS fixed_cost_suspect, floor(least(1.0::DOUBLE, coalesce(abs(delta), 0) / 15) * 0.4::DOUBLE * 1000 + 0.5) / 1000 AS risk_score FROM b")
def _(t: Tables) -> DataFrame:
    delta = numbers.delta_signed(C("amount") * (1 + C("part_id") % 5 * 0.05), C("standard_amount"))
    rows = t.lines().select("line_id", "part_id", "distance_km", delta.alias("delta_pct")).withColumn("band", numbers.band_of_delta(C("delta_pct")))
    special = F.when(C("part_id") % 47 == 0, "SPECIAL_PASS")
    risk = numbers.half_up(F.least(F.lit(1.0), F.coalesce(F.abs("delta_pct"), F.lit(0.0)) / 15) * 0.4, 3)
    return rows.select("line_id", "delta_pct", "band", rules.final_verdict(special, C("band"), C("delta_pct")).alias("verdict"), F.when(C("distance_km") <= 10, 1).otherwise(0).alias("short_run_flag"), F.when(C("distance_km") <= 2, 1).otherwise(0).alias("fixed_cost_suspect"), risk.alias("risk_score"))


@query("r32_executed_verdict", LINES + ", m AS (SELECT origin, destination, median(amount) AS ref, count(*) AS n FROM lines WHERE part_id % 8 = 0 GROUP BY 1, 2), x AS (SELECT line_id, n, CASE WHEN ref <> 0 THEN (amount - ref) / ref * 100 END AS d FROM lines LEFT JOIN m USING (origin, destination)) SELECT line_id, CASE WHEN d IS NULL OR n < 3 THEN 'REVIEW' WHEN abs(d) <= 2 THEN 'PASS' WHEN abs(d) <= 5 THEN 'WATCH' WHEN abs(d) <= 10 THEN 'REVIEW' ELSE 'FAIL' END AS executed_verdict FROM x")
def _(t: Tables) -> DataFrame:
    lines = t.lines()
    ref = lines.where("part_id % 8 = 0").groupBy("origin", "destination").agg(F.median("amount").alias("ref"), F.count("*").alias("samples"))
    joined = lines.join(ref, ["origin", "destination"], "left")
    return joined.select("line_id", rules.executed_verdict(numbers.delta_signed(C("amount"), C("ref")), C("samples"), F.lit("lane_median")).alias("executed_verdict"))


@query("r33_r34_r35_promote", LINES + ", x AS (SELECT line_id, part_id, amount AS actual, CASE WHEN part_id % 6 <> 0 THEN standard_amount END AS cur, CASE WHEN part_id % 5 = 0 THEN '' ELSE 'LN' END AS lane_id, coalesce(rate, amount / 3.6725::DOUBLE) AS usd, amount * (1 + part_id % 3 / 100.0::DOUBLE) AS ex, CASE WHEN part_id % 9 = 0 THEN 'shipment_reference' ELSE 'lane_median' END AS method FROM lines), y AS (SELECT *, abs((actual - cur) / nullif(cur, 0) * 100) AS now, abs((actual - ex) / nullif(ex, 0) * 100) AS thn FROM x), z AS (SELECT *, CASE WHEN method = 'shipment_reference' OR cur IS NULL OR lane_id = '' THEN true WHEN thn IS NULL THEN false WHEN now IS NULL THEN true ELSE thn + 1e-6::DOUBLE < now END AS promoted FROM y) SELECT line_id, promoted, CASE WHEN promoted THEN ex ELSE cur END AS reference, usd FROM z")
def _(t: Tables) -> DataFrame:
    p = C("part_id")
    rows = t.lines().select("line_id", p, "amount", F.when(p % 6 != 0, C("standard_amount")).alias("cur"), F.when(p % 5 == 0, "").otherwise("LN").alias("lane_id"), F.coalesce("rate", C("amount") / numbers.PEG).alias("usd"), (C("amount") * (1 + p % 3 / 100.0)).alias("ex"))
    promoted = rules.promote_executed(F.when(p % 9 == 0, "shipment_reference").otherwise("lane_median"), C("cur"), C("lane_id"), C("amount"), C("ex"))
    return rows.select("line_id", promoted.alias("promoted"), F.when(promoted, C("ex")).otherwise(C("cur")).alias("reference"), "usd")


@query("r23_totals", "WITH s AS (SELECT l_orderkey, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT) AS lines_minor FROM lineitem GROUP BY 1), i AS (SELECT l_orderkey AS invoice_id, lines_minor::BIGINT AS lines_minor, (lines_minor + CASE WHEN l_orderkey % 6 = 0 THEN 2 ELSE 1 END)::BIGINT AS subtotal_minor, (lines_minor // 20)::BIGINT AS tax_minor FROM s), j AS (SELECT *, subtotal_minor + tax_minor + CASE WHEN invoice_id % 8 = 0 THEN 5 ELSE 0 END AS total_minor FROM i) SELECT invoice_id, 'SUBTOTAL_MISMATCH' AS code, 'error' AS severity, subtotal_minor::VARCHAR AS expected, lines_minor::VARCHAR AS actual FROM j WHERE abs(lines_minor - subtotal_minor) > 1 UNION ALL SELECT invoice_id, 'TOTAL_MISMATCH', 'error', total_minor::VARCHAR, (subtotal_minor + tax_minor)::VARCHAR FROM j WHERE abs(subtotal_minor + tax_minor - total_minor) > 1")
def _(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(C("l_orderkey").alias("invoice_id")).agg(F.sum(F.floor(C("l_extendedprice") * 100 + 0.5)).alias("lines_minor"))
    i = sums.withColumn("subtotal_minor", C("lines_minor") + F.when(C("invoice_id") % 6 == 0, 2).otherwise(1)).withColumn("tax_minor", F.expr("lines_minor div 20"))
    return recon.totals_issues(i.withColumn("total_minor", C("subtotal_minor") + C("tax_minor") + F.when(C("invoice_id") % 8 == 0, 5).otherwise(0)))


@query("r22_r24_r26_issues", "WITH o AS (SELECT o_orderkey AS invoice_id, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'V' || o_custkey END AS vendor, ['AED', 'USD', 'KRW'][o_custkey % 3 + 1] AS currency, o_orderdate::DATE AS issue, o_orderdate::DATE + ((o_orderkey % 5)::INT - 1) AS due FROM orders), u AS (SELECT invoice_id, 'REQUIRED_FIELD_MISSING' AS code FROM o WHERE vendor = '' UNION ALL SELECT invoice_id, 'CURRENCY_NOT_ALLOWED' FROM o WHERE currency NOT IN ('AED', 'USD') UNION ALL SELECT invoice_id, 'DUE_BEFORE_ISSUE' FROM o WHERE due < issue) SELECT invoice_id, code, 'error' AS severity FROM u")
def _(t: Tables) -> DataFrame:
    o = t.orders.select(C("o_orderkey").alias("invoice_id"), F.when(C("o_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit("V"), C("o_custkey").cast("string"))).alias("vendor"), pick(("AED", "USD", "KRW"), C("o_custkey")).alias("currency"), F.to_date("o_orderdate").alias("issue"), F.date_add(F.to_date("o_orderdate"), (C("o_orderkey") % 5).cast("int") - 1).alias("due"))
    none = F.lit(None).cast("string")
    checks = [("REQUIRED_FIELD_MISSING", "error", F.nullif("vendor", F.lit("")).isNull(), none, C("vendor")), ("CURRENCY_NOT_ALLOWED", "error", ~C("currency").isin("AED", "USD"), none, C("currency")), ("DUE_BEFORE_ISSUE", "error", C("due") < C("issue"), C("issue"), C("due"))]
    return recon.issues(o, "invoice_id", checks).select("invoice_id", "code", "severity")


@query("r25_rate_reference_issues", CARDS + ", a AS (SELECT line_id, day, charge_code, lane, floor(applied_rate * 100 + 0.5)::BIGINT AS minor, row_number() OVER () AS k FROM applied), f AS (SELECT a.*, floor(r.contracted_rate * 100 + 0.5)::BIGINT AS ref, row_number() OVER (PARTITION BY k ORDER BY r.effective_from DESC, r.card_id) AS n FROM a LEFT JOIN rate_cards r ON r.charge_code = a.charge_code AND r.lane = a.lane AND r.effective_from <= a.day AND a.day <= coalesce(r.effective_to, DATE '9999-12-31')) SELECT line_id, CASE WHEN ref IS NULL THEN 'RATE_NOT_FOUND' ELSE 'RATE_MISMATCH' END AS code FROM f WHERE n = 1 AND minor IS NOT NULL AND (ref IS NULL OR minor <> ref AND (ref = 0 OR abs(minor - ref) / ref::DOUBLE * 100 > 2))")
def _(t: Tables) -> DataFrame:
    found = lookup.as_of(t.applied(), t.rate_cards(), ["charge_code", "lane"], "day", "effective_from", "effective_to", ["contracted_rate", "card_id"], "card_id")
    m = found.select("line_id", F.floor(C("applied_rate") * 100 + 0.5).alias("minor"), F.floor(C("contracted_rate") * 100 + 0.5).alias("ref")).where("minor is not null")
    far = (C("ref") == 0) | (F.abs(C("minor") - C("ref")) / F.nullif(C("ref"), F.lit(0)) * 100 > 2)
    return m.select("line_id", F.when(C("ref").isNull(), "RATE_NOT_FOUND").when((C("minor") != C("ref")) & far, "RATE_MISMATCH").alias("code")).where("code is not null")
