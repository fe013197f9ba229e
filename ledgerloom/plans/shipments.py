"""Queries over the shipment register (E), lanes and executed references (J11 to J24), windows, set operations and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places
from ..operators import anomalies, lanes, logistics, lookup
from .audit import lanes as lane_checks
from .base import LINES, Tables, pick, query

C = F.col

# How register cells follow from an order: (modulus, remainder, days after the order).
DATES = {
    "receipt_DSV_INDOOR": (3, 0, 20), "receipt_DSV_OUTDOOR": (7, 1, 21), "receipt_MOSB": (5, 2, 30), "receipt_AGI": (6, 1, 29), "receipt_DAS": (8, 3, 33), "receipt_MIR": (4, 0, 25), "receipt_SHU": (9, 4, 25),
    "etd": (2, 0, 1), "atd": (4, 0, 2), "eta": (3, 1, 10), "ata": (5, 0, 26), "attestation": (10, 2, 12), "do_collection": (6, 5, 14), "customs_start": (7, 3, 18), "customs_close": (7, 0, 27), "final_delivery": (11, 0, 28),
}
FLAGS = {"flag_AGI": (5, 1), "flag_DAS": (7, 2), "flag_MIR": (4, 0), "flag_SHU": (3, 1)}


def register(t: Tables) -> DataFrame:
    k, day = C("o_orderkey"), F.to_date("o_orderdate")
    dates = [F.when(k % 101 == 7, "n/a").when(k % m == r, F.date_format(F.date_add(day, n), "yyyy-MM-dd")).alias(c) for c, (m, r, n) in DATES.items()]
    flags = [F.when(k % 53 == 5, "?").when(k % m == r, " o").alias(c) for c, (m, r) in FLAGS.items()]
    return t.orders.select(F.concat(F.lit("SCT-"), k.cast("string")).alias("unit_id"), k.alias("line_no"), *flags, *dates)


REGISTER = "WITH register AS (SELECT 'SCT-' || o_orderkey AS unit_id, o_orderkey AS line_no, " + ", ".join([f"CASE WHEN o_orderkey % 53 = 5 THEN '?' WHEN o_orderkey % {m} = {r} THEN 'O' END AS {c}" for c, (m, r) in FLAGS.items()] + [f"CASE WHEN o_orderkey % 101 <> 7 AND o_orderkey % {m} = {r} THEN o_orderdate::DATE + {n} END AS {c}" for c, (m, r, n) in DATES.items()]) + ", o_orderkey % 101 = 7 AS broken FROM orders)"
REQ = ", req AS (" + " UNION ALL ".join(f"SELECT unit_id, line_no, '{s}' AS site FROM register WHERE flag_{s} = 'O'" for s in logistics.SITES) + ")"
REC = ", rec AS (" + " UNION ALL ".join(f"SELECT unit_id, line_no, '{x}' AS location, {i} AS seq, receipt_{x} AS day FROM register WHERE receipt_{x} IS NOT NULL" for i, x in enumerate(logistics.LOCATIONS)) + ")"
MIL = ", mil AS (" + " UNION ALL ".join(f"SELECT unit_id, line_no, '{code}' AS code, {i} AS seq, {c} AS day FROM register WHERE {c} IS NOT NULL" for i, (code, c) in enumerate(logistics.MILESTONES)) + ")"


@query("e1_requirements", REGISTER + REQ + " SELECT * FROM req")
def _(t: Tables) -> DataFrame:
    return logistics.requirements(register(t))


@query("e2_receipts", REGISTER + REC + " SELECT unit_id, location, day FROM rec UNION ALL SELECT unit_id, x, NULL FROM register, (SELECT unnest(['" + "', '".join(logistics.LOCATIONS) + "']) AS x) WHERE broken")
def _(t: Tables) -> DataFrame:
    return logistics.receipts(register(t)).select("unit_id", "location", "day")


@query("e3_e8_milestones", REGISTER + MIL + " SELECT unit_id, line_no, code, day FROM mil")
def _(t: Tables) -> DataFrame:
    return logistics.milestones(register(t))


FACTS = REGISTER + REQ + REC + MIL + """, u AS (SELECT g.unit_id, g.final_delivery, list_sort([x FOR x IN [CASE WHEN flag_AGI = 'O' THEN 'AGI' END, CASE WHEN flag_DAS = 'O' THEN 'DAS' END, CASE WHEN flag_MIR = 'O' THEN 'MIR' END, CASE WHEN flag_SHU = 'O' THEN 'SHU' END] IF x IS NOT NULL]) AS declared,
  [x FOR x IN [CASE WHEN receipt_AGI IS NOT NULL THEN 'AGI' END, CASE WHEN receipt_DAS IS NOT NULL THEN 'DAS' END, CASE WHEN receipt_MIR IS NOT NULL THEN 'MIR' END, CASE WHEN receipt_SHU IS NOT NULL THEN 'SHU' END] IF x IS NOT NULL] AS at_sites,
  receipt_MOSB IS NOT NULL AS has_mosb, receipt_DSV_INDOOR IS NOT NULL OR receipt_DSV_OUTDOOR IS NOT NULL AS has_wh, receipt_MOSB, receipt_AGI, receipt_DAS, receipt_MIR, receipt_SHU, ata, customs_close, broken, flag_AGI,
  (SELECT max(day) FROM rec WHERE rec.unit_id = g.unit_id) AS last_receipt, (SELECT arg_max(code, day - seq * INTERVAL 1 SECOND) FROM mil WHERE mil.unit_id = g.unit_id) AS last_ms,
  (SELECT list(location) FROM rec WHERE rec.unit_id = g.unit_id AND day = (SELECT max(day) FROM rec r2 WHERE r2.unit_id = g.unit_id)) AS last_locs, (SELECT count(*) FROM rec WHERE rec.unit_id = g.unit_id) AS n_rec FROM register g)"""


@query("e4_w3_units", FACTS + """ SELECT unit_id, CASE WHEN final_delivery IS NOT NULL THEN 'M140_FINAL_DELIVERED' WHEN len(at_sites) > 0 THEN 'M130_SITE_RECEIVED' WHEN has_mosb THEN 'M115_MOSB_STAGED' WHEN has_wh THEN 'M110_WAREHOUSE_RECEIVED' ELSE coalesce(last_ms, 'M00_PLANNED') END AS current_stage,
  CASE WHEN len(last_locs) > 1 THEN 'MULTI_LOCATION' WHEN len(last_locs) = 1 THEN last_locs[1] ELSE '' END AS current_location,
  CASE WHEN has_wh AND has_mosb AND len(at_sites) > 0 THEN 'WH_MOSB_SITE' WHEN has_mosb AND len(at_sites) > 0 THEN 'MOSB_SITE' WHEN has_wh AND len(at_sites) > 0 THEN 'WH_SITE' WHEN len(at_sites) > 0 THEN 'DIRECT_SITE' WHEN has_mosb THEN 'MOSB_STAGE' WHEN has_wh THEN 'WH_ONLY' ELSE 'UNKNOWN' END AS routing,
  len(declared)::INT AS n_required, len(at_sites)::INT AS n_received, len([x FOR x IN declared IF NOT list_contains(at_sites, x)])::INT AS n_gaps FROM u""")
def _(t: Tables) -> DataFrame:
    return logistics.units(register(t))


EARLY = "(" + " UNION ALL ".join(f"SELECT unit_id, '{s}' AS s, receipt_{s} AS d, ata, customs_close, receipt_MOSB FROM u WHERE receipt_{s} IS NOT NULL" for s in logistics.SITES) + ")"
NO_NEWS = "n_rec = 0 AND final_delivery IS NULL"
OFFSHORE = "(list_contains(declared, 'AGI') OR list_contains(declared, 'DAS'))"
REACHED = "(final_delivery IS NOT NULL OR receipt_AGI IS NOT NULL OR receipt_DAS IS NOT NULL)"


@query("e5_validation_log", FACTS + f""" SELECT unit_id, 'V-REC-001' AS rule, 'BLOCK' AS level, 'RECEIPT_DT_NOT_DATE' AS reason, unnest(['{"', '".join(logistics.LOCATIONS)}']) AS subject FROM u WHERE broken
  UNION ALL SELECT unit_id, 'V-DEST-001', 'AMBER', 'ALL_DEST_BLANK', '' FROM u WHERE len(declared) = 0 UNION ALL SELECT unit_id, 'V-DEST-002', 'WARN', 'DEST_FLAG_NOT_O_OR_BLANK', unnest(['AGI', 'DAS', 'MIR', 'SHU']) FROM u WHERE flag_AGI = '?'
  UNION ALL SELECT unit_id, 'V-DEST-003', 'OPEN', 'REQUIRED_DEST_NO_RECEIPT', unnest([x FOR x IN declared IF NOT list_contains(at_sites, x)]) FROM u UNION ALL SELECT unit_id, 'V-DEST-004', 'WARN', 'RECEIPT_WITHOUT_DEST_FLAG', unnest([x FOR x IN at_sites IF NOT list_contains(declared, x)]) FROM u
  UNION ALL SELECT unit_id, 'V-DEST-005', 'INFO_SPLIT_DELIVERY', 'MULTIPLE_DEST_REQUIRED', array_to_string(declared, '|') FROM u WHERE len(declared) > 1 UNION ALL SELECT unit_id, 'V-REC-002', 'WARN', 'RECEIPT_BEFORE_ATA', s FROM {EARLY} WHERE d < ata
  UNION ALL SELECT unit_id, 'V-REC-003', 'AMBER', 'SITE_RECEIPT_BEFORE_CUSTOMS_CLOSE', s FROM {EARLY} WHERE d < customs_close UNION ALL SELECT unit_id, 'V-REC-004', 'BLOCK', 'FINAL_DELIVERY_BEFORE_RECEIPT', '' FROM u WHERE final_delivery < last_receipt
  UNION ALL SELECT unit_id, 'V-REC-005', 'OPEN', 'NO_RECEIPT_NO_FINAL', '' FROM u WHERE {NO_NEWS} UNION ALL SELECT unit_id, 'V-MOSB-001', 'AMBER', 'MOSB_MISSING_FOR_OFFSHORE', '' FROM u WHERE {OFFSHORE} AND {REACHED} AND NOT has_mosb
  UNION ALL SELECT unit_id, 'V-MOSB-002', 'BLOCK', 'MOSB_AFTER_SITE_RECEIPT', s FROM {EARLY} WHERE s IN ('AGI', 'DAS') AND d < receipt_MOSB UNION ALL SELECT unit_id, 'V-MOSB-003', 'WARN', 'MOSB_WITHOUT_OFFSHORE_FLAG', '' FROM u WHERE has_mosb AND NOT {OFFSHORE}""")
def _(t: Tables) -> DataFrame:
    return logistics.validation_log(register(t))


@query("e6_actions", FACTS + f""" SELECT unit_id, 'REQUEST_SITE_RECEIPT_DATE' AS rule, unnest([x FOR x IN declared IF NOT list_contains(at_sites, x)]) AS subject FROM u UNION ALL SELECT unit_id, 'REVIEW_DESTINATION_FLAG', unnest([x FOR x IN at_sites IF NOT list_contains(declared, x)]) FROM u
  UNION ALL SELECT unit_id, 'REQUEST_MOSB_STAGING_EVIDENCE', 'MOSB' FROM u WHERE {OFFSHORE} AND {REACHED} AND NOT has_mosb UNION ALL SELECT unit_id, 'FOLLOW_UP_SITE_DELIVERY', array_to_string(declared, '|') FROM u WHERE has_wh AND len(declared) > 0 AND len(at_sites) = 0
  UNION ALL SELECT unit_id, 'REQUEST_DELIVERY_STATUS_UPDATE', '' FROM u WHERE {NO_NEWS} UNION ALL SELECT unit_id, 'REVIEW_DATE_CONFLICT', '' FROM u WHERE final_delivery < last_receipt
  UNION ALL SELECT unit_id, 'REVIEW_MOSB_SEQUENCE', 'MOSB' FROM u WHERE receipt_AGI < receipt_MOSB OR receipt_DAS < receipt_MOSB""")
def _(t: Tables) -> DataFrame:
    return logistics.actions(register(t)).select("unit_id", "rule", "subject")


CANON = REGISTER + REC + ", ev AS (SELECT unit_id, 'M040_DEPARTED' AS event_type, 10 AS event_rank, NULL AS site, coalesce(atd, etd) AS day FROM register UNION ALL SELECT unit_id, 'M050_ARRIVED', 20, NULL, coalesce(ata, eta) FROM register UNION ALL SELECT unit_id, 'M100_FINAL_DELIVERED', 90, NULL, final_delivery FROM register UNION ALL SELECT unit_id, 'WH_RECEIPT', 40, location, day FROM rec WHERE location LIKE 'DSV%' UNION ALL SELECT unit_id, 'SITE_RECEIPT', 80, location, day FROM rec WHERE location IN ('AGI', 'DAS', 'MIR', 'SHU'))"


@query("e7_canonical_events", CANON + " SELECT * FROM ev WHERE day IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return logistics.canonical_events(register(t))


@query("e10_w1_dwell", CANON + " SELECT unit_id, min(day) FILTER (event_type = 'WH_RECEIPT') AS first_store, min(day) FILTER (event_type = 'SITE_RECEIPT') AS first_site, (min(day) FILTER (event_type = 'SITE_RECEIPT') - min(day) FILTER (event_type = 'WH_RECEIPT'))::INT AS dwell_days, arg_max(event_type, day::TIMESTAMP + event_rank * INTERVAL 1 SECOND) AS last_event FROM ev WHERE day IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return logistics.dwell(logistics.canonical_events(register(t)))


@query("e9_identifiers", "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT 'SCT-' || k AS unit_id, t.scheme, t.value, t.normalized, 0.98::DOUBLE AS confidence FROM o, LATERAL (VALUES ('CASE_NO', 'case  ' || k || '.0', 'CASE-' || k || '-0', true), ('ShipmentUnit', 'SCT-' || k, 'SCT-' || k, true), ('sourceLineId', k || '.0', k::VARCHAR, true), ('invoiceNo', 'inv/' || c || '/' || k, 'INV-' || c || '-' || k, k % 2 = 0), ('SCT_REF', 'sct_' || c, 'SCT-' || c, k % 3 = 0)) t(scheme, value, normalized, given) WHERE t.given")
def _(t: Tables) -> DataFrame:
    k, c = C("o_orderkey").cast("string"), C("o_custkey").cast("string")
    base = t.orders.select(F.concat(F.lit("SCT-"), k).alias("unit_id"), "o_orderkey", "o_custkey")
    given = (F.concat(F.lit("case  "), k, F.lit(".0")), C("unit_id"), F.concat(k, F.lit(".0")), F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("inv/"), c, F.lit("/"), k)).otherwise(" "), F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("sct_"), c)))
    return logistics.identifiers(base, dict(zip(logistics.SCHEMES, given)))


@query("a15_merge_cases", "WITH r AS (SELECT (o_custkey % 90)::VARCHAR AS case_no, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS note, o_orderdate::DATE AS d FROM orders) SELECT case_no, arg_min(note, seq) FILTER (note <> '') AS note, max(d) AS d FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    r = t.orders.select((C("o_custkey") % 90).cast("string").alias("case_no"), C("o_orderkey").alias("seq"), F.when(C("o_orderkey") % 3 == 0, "").otherwise(C("o_orderpriority")).alias("note"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return logistics.merged_cases(r, "case_no", "seq", ["d"])


@query("a16_j22_gap_profile", REGISTER + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS site, count_if(flag_{s} = 'O') AS required, count_if(flag_{s} = 'O' AND receipt_{s} IS NOT NULL) AS received FROM register" for s in logistics.SITES) + ")")
def _(t: Tables) -> DataFrame:
    f = logistics.facts(register(t)).select("unit_id", "at_sites", F.explode("declared").alias("site"))
    return f.groupBy("site").agg(F.count("*").alias("required"), F.count_if(F.array_contains("at_sites", C("site"))).alias("received"))


def lane_table(t: Tables) -> DataFrame:
    """Approved lanes: one for each distinct lane of the even parts' lines."""
    kept = t.lines().where("part_id % 2 = 0").groupBy("origin", "destination", "vehicle").agg(F.min("part_id").alias("p"), F.median("rate").alias("rate"))
    return kept.select("origin", "destination", "vehicle", F.lit("per truck").alias("unit"), C("p").alias("lane_id"), C("p").alias("ref_id"), "rate")


@query("j11_j12_exact_lanes")
def _(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame([("KHALIFA PORT", "JEBEL ALI PORT"), ("ICAD 2", "MUSSAFAH")], "raw_place string, normal_place string")
    return lanes.exact(t.lines().withColumn("unit", F.lit("PERTRIP")), lane_table(t), aliases)


@query("j13_w2_fuzzy_lanes")
def _(t: Tables) -> DataFrame:
    return lanes.fuzzy(t.lines().withColumn("unit", F.lit("RT")).dropDuplicates(["line_id"]), lane_table(t))


REFS = """, keyed AS (SELECT line_id, row_number() OVER () AS k, upper(trim(origin)) AS o, upper(trim(destination)) AS d, upper(trim(vehicle)) AS v, CASE WHEN part_id % 5 = 0 THEN 'PER RT' ELSE 'PER TRUCK' END AS u, distance_km AS km, rate, part_id FROM lines),
refs AS (SELECT o, d, v, 'PER TRUCK' AS u, min(part_id) AS ref_id, median(rate) AS rate, median(km) AS km FROM keyed WHERE part_id % 4 = 0 GROUP BY o, d, v),
asked AS (SELECT q.*, x.ref_id AS direct, EXISTS (SELECT 1 FROM refs p WHERE p.v = q.v AND p.u = q.u) AS pooled FROM keyed q LEFT JOIN refs x ON x.o = q.o AND x.d = q.d AND x.v = q.v AND x.u = q.u),
scored AS (SELECT q.k, r.ref_id, CASE WHEN q.o = r.o THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN q.d = r.d THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN q.v = r.v THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN q.km IS NOT NULL AND r.km IS NOT NULL THEN 0.1::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(q.km - r.km) / 15.0::DOUBLE) ELSE 0.0::DOUBLE END
    + CASE WHEN q.rate IS NOT NULL AND r.rate <> 0 THEN 0.1::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - abs((q.rate - r.rate) / r.rate) * 100.0::DOUBLE / 30.0::DOUBLE) ELSE 0.0::DOUBLE END AS score
  FROM asked q JOIN refs r ON NOT q.pooled OR (r.v = q.v AND r.u = q.u) WHERE q.direct IS NULL),
best AS (SELECT k, ref_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, ref_id) AS n FROM scored WHERE score >= 0.6::DOUBLE) WHERE n = 1)
SELECT line_id, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN b.ref_id IS NOT NULL THEN 'similarity' ELSE 'none' END AS method, coalesce(direct, b.ref_id) AS ref_id, round(b.score, 3) AS score FROM asked LEFT JOIN best b USING (k)"""  # fmt: skip


@query("j14_weighted_reference", LINES + REFS)
def _(t: Tables) -> DataFrame:
    """References are lanes of every fourth part; lines by the trip find no pool of their unit and so meet those of every vehicle."""
    shown = lambda c: F.upper(F.trim(c)).alias(c)
    keyed = t.lines().select("line_id", "part_id", *map(shown, ("origin", "destination", "vehicle")), F.when(C("part_id") % 5 == 0, "PER RT").otherwise("PER TRUCK").alias("unit"), "distance_km", "rate")
    kept = keyed.where("part_id % 4 = 0").groupBy("origin", "destination", "vehicle").agg(F.min("part_id").alias("ref_id"), F.median("rate").alias("rate"), F.median("distance_km").alias("distance_km"))
    return lanes.weighted(keyed, kept.withColumn("unit", F.lit("PER TRUCK"))).select("line_id", "method", "ref_id", "score")


@query("j11_s16_place_routing", "WITH a AS (SELECT n_nationkey AS ordinal, CASE WHEN n_nationkey % 6 = 5 THEN 'CHINA' ELSE replace(n_name, '_', ' ') END AS raw, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'Port & ' || replace(n_name, '_', ' ') END AS normal, CASE n_nationkey % 3 WHEN 0 THEN 'Sea  Port' WHEN 1 THEN '' ELSE 'site-2' END AS grp, ['active', 'review', 'closed', ''][n_nationkey % 4 + 1] AS status FROM nation), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY raw ORDER BY ordinal DESC) = 1), c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE upper(replace(n_name, '_', ' ')) END AS place FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT c_custkey, CASE WHEN status IN ('active', '') AND normal <> '' THEN upper(replace(normal, '&', 'AND')) ELSE place END AS place_normal, CASE WHEN place = '' THEN 'blank' WHEN raw IS NULL THEN 'fallback' ELSE CASE status WHEN '' THEN 'alias:' WHEN 'active' THEN 'alias:' WHEN 'review' THEN 'review:' ELSE 'blocked:' END || CASE grp WHEN 'Sea  Port' THEN 'sea_port' WHEN '' THEN 'site' ELSE 'site_2' END END AS place_source FROM c LEFT JOIN l ON l.raw = c.place")
def _(t: Tables) -> DataFrame:
    """Customers' places by an alias table with statuses that is written as CSV and read back."""
    from ..sources import sheets, sinks
    from .io import folder

    k = C("n_nationkey")
    table = t.nation.select(
        k.cast("string").alias("ordinal"), F.when(k % 6 == 5, "china").otherwise(C("n_name")).alias("raw_place"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Port & "), C("n_name"))).alias("normalized_place"),
        F.when(k % 3 == 0, "Sea  Port").when(k % 3 == 1, "").otherwise("site-2").alias("place_group"), pick(("active", "review", "closed", ""), k).alias("status"))
    target = folder(t, "aliases")
    sinks.csv_datasets({"aliases": table}, target)
    aliases = sheets.read_delimited(t.spark, f"{target}/aliases").withColumn("ordinal", C("ordinal").cast("int"))
    placed = t.customer.join(t.nation, C("c_nationkey") == k).select("c_custkey", F.when(C("c_custkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("place"))
    return lanes.routed_places(placed, aliases, "place").select("c_custkey", "place_normal", "place_source")


EXEC = LINES + ", s AS (SELECT shipment_ref AS ref, median(amount) AS rate FROM lines WHERE part_id % 5 = 0 GROUP BY 1), c AS (SELECT origin AS lane, destination, median(amount) AS rate, count(*) AS samples, length(destination) % 3 AS fit, min(part_id) * 100 + min(supp_id) AS candidate_id FROM lines WHERE part_id % 3 = 0 GROUP BY 1, 2), b AS (SELECT l.line_id, l.amount, c.rate, l.k, row_number() OVER (PARTITION BY k ORDER BY fit DESC, samples DESC, abs(c.rate - l.amount), candidate_id) AS n FROM (SELECT *, row_number() OVER () AS k FROM lines) l LEFT JOIN c ON c.lane = l.origin), x AS (SELECT l.line_id, s.rate AS srate, l.amount FROM lines l LEFT JOIN s ON s.ref = l.shipment_ref) "


@query("j15_j16_executed_reference", "WITH lines0 AS (SELECT 1) SELECT * FROM (" + EXEC + "SELECT l.line_id, coalesce(s.rate, b.rate) AS executed_rate, CASE WHEN s.rate IS NOT NULL THEN 'shipment_reference' WHEN b.rate IS NOT NULL THEN 'lane_median' END AS method FROM (SELECT *, row_number() OVER () AS k FROM lines) l LEFT JOIN s ON s.ref = l.shipment_ref LEFT JOIN (SELECT k AS bk, rate FROM b WHERE n = 1) b ON b.bk = l.k)")
def _(t: Tables) -> DataFrame:
    lines = t.lines()
    asked = lines.select("line_id", F.array(F.lit("none"), C("shipment_ref")).alias("refs"), C("origin").alias("lane"), C("amount").alias("actual"))
    by_shipment = lines.where("part_id % 5 = 0").groupBy(C("shipment_ref").alias("ref")).agg(F.median("amount").alias("rate"))
    by_lane = lines.where("part_id % 3 = 0").groupBy(C("origin").alias("lane"), "destination").agg(F.median("amount").alias("rate"), F.count("*").alias("samples"), (F.min("part_id") * 100 + F.min("supp_id")).alias("candidate_id")).withColumn("fit", F.length("destination") % 3)
    return lanes.executed_reference(asked, by_shipment, by_lane).select("line_id", "executed_rate", "method")


@query("j17_j18_a8_documents", "WITH l AS (SELECT o_orderkey AS line_id, 'HVDC-' || o_orderkey AS ref, o_orderkey AS row_no FROM orders), d AS (SELECT o_orderkey * 10 AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'SCT HVDC-' || o_orderkey ELSE o_orderkey::VARCHAR END AS ref, o_orderkey + 1 AS row_no FROM orders WHERE o_orderkey % 3 = 0) SELECT line_id, count(*) AS n_documents FROM (SELECT line_id, document_id FROM l JOIN d ON contains(l.ref, d.ref) OR contains(d.ref, l.ref) UNION SELECT line_id, document_id FROM l JOIN d ON l.row_no = d.row_no) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    k = C("o_orderkey")
    lines = t.orders.select(k.alias("line_id"), F.concat(F.lit("HVDC-"), k.cast("string")).alias("ref"), k.alias("row_no"))
    docs = t.orders.where("o_orderkey % 3 = 0").select((k * 10).alias("document_id"), F.when(k % 2 == 0, F.concat(F.lit("sct HVDC-"), k.cast("string"))).otherwise(k.cast("string")).alias("ref"), (k + 1).alias("row_no"))
    return lanes.documents_of_lines(lines, docs).groupBy("line_id").agg(F.count("*").alias("n_documents"))


@query("j19_j20_fuzzy_ids")
def _(t: Tables) -> DataFrame:
    """Best shipment by indel similarity of at least 75 of every typed reference, and the confidence that follows."""
    number = lambda c: F.lpad((c % 2000).cast("string"), 4, "0")
    known = t.orders.select(F.concat(F.lit("HVDC-ADOPT-SCT-"), number(C("o_orderkey"))).alias("known"))
    typed = t.customer.select("c_custkey", F.concat(F.lit("HVDC-ADPT-SCT-"), number(C("c_custkey"))).alias("typed"))
    best = typed.join(lanes.nearest_ids(typed, known, 75.0), "typed")
    return best.select("c_custkey", C("known").alias("shipment"), "ratio", F.greatest(F.lit(0.0), C("ratio") - 10).alias("confidence"))


@query("j20_document_confidence", "SELECT o_orderkey AS document_id, CASE o_orderkey % 4 WHEN 0 THEN 90.0::DOUBLE WHEN 1 THEN 95.0::DOUBLE WHEN 2 THEN 200.0::DOUBLE * (length('HVDC-' || o_orderkey) - 1) / (2 * length('HVDC-' || o_orderkey) - 1) - 10 ELSE 0.0::DOUBLE END AS confidence, o_orderkey % 4 = 0 AS filename_match, o_orderkey % 4 = 1 AS content_match FROM orders")
def _(t: Tables) -> DataFrame:
    """A document for each order: named after its shipment, naming it in its text, naming it with a letter missing, or neither."""
    k = C("o_orderkey")
    shipment = F.concat(F.lit("HVDC-"), k.cast("string"))
    ids = F.when(k % 4 == 1, F.array(F.lit("zz"), F.lower(shipment))).when(k % 4 == 2, F.array(F.lit("qq"), F.regexp_replace(shipment, "^H", ""))).otherwise(F.array().cast("array<string>"))
    docs = t.orders.select(k.alias("document_id"), F.when(k % 4 == 0, F.concat(F.lit("dn "), F.lower(shipment), F.lit(".pdf"))).otherwise("scan.pdf").alias("file_name"), ids.alias("ids"), shipment.alias("shipment"))
    return lanes.document_confidence(docs).select("document_id", "confidence", "filename_match", "content_match")


@query("j21_special_zones", LINES + " SELECT line_id, destination IN ('Mirfa PMO Samsung', 'Al Markaz') AS special FROM lines")
def _(t: Tables) -> DataFrame:
    zones = t.spark.createDataFrame([("Mirfa PMO Samsung",), ("Al Markaz",)], "destination string").withColumn("special", F.lit(True))
    return t.lines().join(zones, "destination", "left").select("line_id", F.coalesce("special", F.lit(False)).alias("special"))


@query("j23_replace_ocr_lines", "SELECT l_orderkey AS id, l_returnflag AS status, false AS fresh FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_orderstatus, true FROM orders WHERE o_orderkey % 5 = 0")
def _(t: Tables) -> DataFrame:
    old = t.lineitem.select(C("l_orderkey").alias("id"), C("l_returnflag").alias("status"), F.lit(False).alias("fresh"))
    kept = lookup.replace_rows(old, t.orders.where("o_orderkey % 5 = 0").select(C("o_orderkey").alias("id"), C("o_orderstatus").alias("status"), F.lit(True).alias("fresh")), ["id"])
    return kept.where("fresh or id % 5 <> 0")


@query("j24_first_waybill", LINES + ", f AS (SELECT order_id, arg_min(origin, line_no * 1000000 + part_id * 100 + supp_id) AS o FROM lines GROUP BY 1) SELECT line_id, o AS document_origin FROM lines JOIN f USING (order_id)")
def _(t: Tables) -> DataFrame:
    lines = t.lines()
    first = lines.groupBy("order_id").agg(F.min_by("origin", C("line_no") * 1000000 + C("part_id") * 100 + C("supp_id")).alias("document_origin"))
    return lines.join(first, "order_id").select("line_id", "document_origin")


@query("w4_contiguous_block", "WITH e AS (SELECT user_id, event_id, CASE WHEN value < 5 THEN 1 ELSE 0 END AS blank FROM events) SELECT user_id, count(*) AS n FROM (SELECT *, sum(blank) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e) WHERE b = 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    blanks = F.sum(F.when(C("value") < 5, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.events.withColumn("b", blanks).where("b = 0").groupBy("user_id").agg(F.count("*").alias("n"))


@query("w5_d2_numbered_lines", LINES + ", one AS (SELECT DISTINCT order_id, part_id, description FROM lines) SELECT order_id, part_id, 'L' || lpad((row_number() OVER (PARTITION BY order_id ORDER BY part_id, description))::VARCHAR, 3, '0') AS line_code FROM one")
def _(t: Tables) -> DataFrame:
    one = t.lines().select("order_id", "part_id", "description").distinct()
    number = F.row_number().over(Window.partitionBy("order_id").orderBy("part_id", "description"))
    return one.select("order_id", "part_id", F.concat(F.lit("L"), F.lpad(number.cast("string"), 3, "0")).alias("line_code"))


@query("w6_d3_first_per_key", "SELECT o_custkey AS vendor, arg_min(o_orderkey, o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select(C("o_custkey").alias("vendor"), C("o_orderkey").alias("first_order"), C("o_orderstatus").alias("status"))
    return lookup.one_per_key(rows, ["vendor"], [C("first_order")])


@query("o1_o2_sorted_sheet", "SELECT c_custkey, coalesce(c_mktsegment, '') AS segment, c_acctbal FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), "c_acctbal").orderBy("segment", "c_custkey")


@query("u1_u2_findings", LINES + ", a AS (SELECT line_id, 'VAT' AS rule, 'ZERO' AS severity FROM lines WHERE vat_rate <> 0.05 AND abs(amount * vat_rate - amount * 0.05::DOUBLE) > 0.01 UNION ALL SELECT line_id, 'COSTGUARD', CASE reason_code WHEN 'QTY_X_RATE_MISMATCH' THEN 'ZERO' ELSE 'AMBER' END FROM guarded WHERE reason_code IS NOT NULL) SELECT rule, severity, count(*) AS n FROM a GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    from ..functions import rules
    from ..operators import recon

    vat = t.lines().select("line_id", rules.vat(C("amount"), C("currency"), C("vat_rate"))["verdict"].alias("severity")).where("severity = 'ZERO'").withColumn("rule", F.lit("VAT"))
    cost = recon.cost_guard(t.lines()).where("reason_code is not null").select("line_id", C("line_verdict").alias("severity"), F.lit("COSTGUARD").alias("rule"))
    return vat.unionByName(cost).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("k3_k5_upsert", "SELECT o_orderkey AS id, coalesce((SELECT arg_max(l_returnflag, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey), o_orderstatus) AS status FROM orders")
def _(t: Tables) -> DataFrame:
    table = t.orders.select(C("o_orderkey").alias("id"), C("o_orderstatus").alias("status"))
    changes = t.lineitem.select(C("l_orderkey").alias("id"), C("l_returnflag").alias("status"), (C("l_linenumber").cast("long") * 10000000 + C("l_partkey") * 1000 + C("l_suppkey")).alias("seq"))
    return lookup.upsert(table, changes, ["id"], "seq")


@query("k7_fixed_columns", "SELECT p_partkey AS no, p_name AS description, '' AS shipment_ref, p_retailprice AS rate FROM part")
def _(t: Tables) -> DataFrame:
    from ..sources import sinks

    return sinks.fixed_columns(t.part.select(C("p_partkey").alias("no"), C("p_name").alias("description"), C("p_retailprice").alias("rate")), ["no", "description", "shipment_ref", "rate"])


GATES = """, o AS (SELECT order_id, sum(amount::DECIMAL(18,2) * CASE WHEN order_id % 3 = 0 THEN 3.6725 ELSE 1 END) AS total, bool_or(rate IS NULL) AS unknown_rate, bool_or(reason_code = 'QTY_X_RATE_MISMATCH') AS critical,
  bool_or(part_id % 50 = 7) AS fx, bool_or(part_id % 60 = 11) AS marine, bool_or(part_id % 9 = 0 AND part_id % 2 = 0) AS store, bool_or(part_id % 9 = 0 AND part_id % 4 = 3) AS rules FROM guarded GROUP BY 1)
SELECT order_id, t.id AS trigger_id, t.s AS severity, t.r AS required_role FROM o, LATERAL (VALUES ('HGT_01', 'ZERO', 'FINANCE_APPROVER', total >= 100000), ('HGT_02', 'ZERO', 'COST_CONTROL_LEAD,FINANCE_APPROVER', critical), ('HGT_03', 'AMBER', 'COST_CONTROL_LEAD', unknown_rate),
  ('HGT_04', 'ZERO', 'FINANCE_APPROVER', fx), ('HGT_05', 'ZERO', 'MARINE_LEAD', marine), ('HGT_06', 'AMBER', 'WAREHOUSE_MANAGER', store), ('HGT_07', 'ZERO', 'COMPLIANCE_LEAD', rules), ('HGT_08', 'AMBER', 'DOCUMENT_CONTROLLER', order_id % 10 < 4)) t(id, s, r, fits) WHERE coalesce(fits, false)"""  # fmt: skip


@query("r19_human_gates", LINES + GATES)
def _(t: Tables) -> DataFrame:
    """All eight triggers: total in dirhams, bands, rates, overrides, evidence of marine, stores and compliance, confidence."""
    from ..operators import gates, recon

    p = C("part_id")
    lines = recon.cost_guard(t.lines()).select(
        C("order_id").alias("job_id"), "band", F.when(C("rate").isNull(), "UNKNOWN").otherwise("KNOWN").alias("rate_status"), (p % 50 == 7).alias("fx_override"), F.when(p % 60 == 11, F.array(F.lit("MOSB_EVIDENCE_MISSING"))).alias("reason_codes"),
        F.when(p % 9 == 0, "MISSING").otherwise("OK").alias("evidence_status"), F.when(p % 2 == 0, pick(("WAREHOUSE_HANDLING", "WAREHOUSE_STORAGE"), p)).alias("charge_component"), F.when(p % 4 == 3, F.array(F.lit("BOE"), F.lit("COMPLIANCE"))).alias("required_evidence"))
    jobs = t.lines().groupBy(C("order_id").alias("job_id")).agg(F.sum(C("amount").cast("decimal(18,2)")).alias("invoice_total")).withColumns({"currency": F.when(C("job_id") % 3 == 0, "USD").otherwise("AED"), "parser_confidence": F.when(C("job_id") % 10 < 4, 0.9).when(C("job_id") % 10 == 9, None).otherwise(0.95)})
    return gates.human_gates(jobs, lines).select(C("job_id").alias("order_id"), "trigger_id", "severity", "required_role")


@query("r36_line_view_risk", "WITH x AS (SELECT l_orderkey AS id, l_linenumber AS n, ['PASS', 'WARN', 'CRITICAL', 'HIGH'][l_partkey % 4 + 1] AS band, ['PASS', 'AMBER', 'ZERO'][l_suppkey % 3 + 1] AS rate_status FROM lineitem) SELECT CASE WHEN band IN ('CRITICAL', 'HIGH') THEN 'HIGH' WHEN band = 'WARN' THEN 'MEDIUM' WHEN rate_status = 'ZERO' THEN 'HIGH' WHEN rate_status = 'AMBER' THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    band, status = pick(("PASS", "WARN", "CRITICAL", "HIGH"), C("l_partkey")), pick(("PASS", "AMBER", "ZERO"), C("l_suppkey"))
    risk = F.when(band.isin("CRITICAL", "HIGH"), "HIGH").when(band == "WARN", "MEDIUM").when(status == "ZERO", "HIGH").when(status == "AMBER", "MEDIUM").otherwise("LOW")
    return t.lineitem.groupBy(risk.alias("risk")).agg(F.count("*").alias("n"))


@query("r38_header_checks", "WITH h AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'INV' || o_orderkey END AS invoice_no, 'V' || o_custkey AS vendor, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE::VARCHAR END AS issue_date, 'AED' AS currency, CASE WHEN o_orderkey % 6 <> 0 THEN 1 END AS total FROM orders) SELECT id, t.f AS field_name, CASE WHEN t.ok THEN 'PRESENT' ELSE 'MISSING' END AS match_status, CASE WHEN NOT t.ok THEN 'AMBER' END AS severity FROM h, LATERAL (VALUES ('invoice_no', invoice_no <> ''), ('vendor', true), ('issue_date', issue_date IS NOT NULL), ('currency', true), ('invoice_total', total IS NOT NULL)) t(f, ok)")
def _(t: Tables) -> DataFrame:
    from ..operators import sheet_rows

    k = C("o_orderkey")
    h = t.orders.select(k.alias("id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("INV"), k.cast("string"))).alias("invoice_no"), F.concat(F.lit("V"), C("o_custkey").cast("string")).alias("vendor"), F.when(k % 5 != 0, F.to_date("o_orderdate")).alias("issue_date"), F.lit("AED").alias("currency"), F.when(k % 6 != 0, C("o_totalprice")).alias("invoice_total"))
    return sheet_rows.headers(h, "id").select("id", "field_name", "match_status", "severity")


@query("m1_anomaly", LINES + " SELECT line_id, 0 AS anomaly FROM lines")
def _(t: Tables) -> DataFrame:
    """The rule's own branch without a forest library: no anomaly anywhere."""
    return lane_checks(t).select("line_id", F.lit(0).alias("anomaly"))


@query("m1_isolation_scores")
def _(t: Tables) -> DataFrame:
    """How soon random splits isolate a line by amount, rate, quantity and distance."""
    lines = t.lines().select("line_id", "amount", "rate", "qty", "distance_km")
    return anomalies.isolation_scores(lines, ["amount", "rate", "qty", "distance_km"], "line_id").select("line_id", F.round("anomaly_score", 6).alias("anomaly_score"), (C("anomaly_score") >= 0.6).alias("anomaly"))


LIST_DATES = {"ETD": (2, 0, 1), "ATD": (4, 0, 2), "ETA": (3, 1, 10), "ATA": (5, 0, 12), "last out wh": (4, 1, 24), "DHL WH": (13, 2, 14), "DSV Indoor": (3, 0, 15), "DSV Al Markaz": (11, 4, 16), "AAA Storage": (17, 5, 17), "DSV Outdoor": (7, 1, 18), "DSV MZP": (19, 6, 19), "MOSB": (5, 2, 26), "MIR": (4, 0, 28), "SHU": (9, 4, 27), "DAS": (8, 3, 33), "AGI": (6, 1, 29)}
LIST = "WITH w AS (SELECT 'C' || o_orderkey AS case_no, o_orderkey AS k, " + ", ".join(f"CASE WHEN o_orderkey % {m} = {r} THEN o_orderdate::DATE + {n} END AS \"{c}\"" for c, (m, r, n) in LIST_DATES.items()) + " FROM orders), h AS (SELECT *, CASE WHEN AGI IS NOT NULL THEN 'AGI' WHEN DAS IS NOT NULL THEN 'DAS' WHEN SHU IS NOT NULL THEN 'SHU' WHEN MIR IS NOT NULL THEN 'MIR' WHEN k % 2 = 0 THEN 'Depot' END AS here FROM w), e AS (" + " UNION ALL ".join(
    ["SELECT case_no, 'M040_DEPARTED' AS event_type, 10 AS event_rank, 'P1' AS site, NULL AS zone, coalesce(ATD, ETD) AS day, 'ETD/ATD' AS source_column FROM h", "SELECT case_no, 'M050_ARRIVED', 20, NULL, NULL, coalesce(ATA, ETA), 'ETA/ATA' FROM h", "SELECT case_no, 'WH_ISSUE', 60, here, NULL, \"last out wh\", 'last out wh' FROM h", "SELECT case_no, 'M100_FINAL_DELIVERED', 90, here, NULL, greatest(MIR, SHU, DAS, AGI), 'Final_Location' FROM h"]
    + [f"SELECT case_no, 'WH_RECEIPT', 40, '{site}', '{zone}', \"{c}\", '{c}' FROM h" for c, (site, zone) in logistics.STORE_COLUMNS.items()] + [f"SELECT case_no, 'SITE_RECEIPT', 80, '{site}', NULL, {c}, '{c}' FROM h" for c, site in logistics.SITE_COLUMNS.items()]
) + ") SELECT * FROM e WHERE day IS NOT NULL"


@query("e7_list_events", LIST)
def _(t: Tables) -> DataFrame:
    """A warehouse list of all orders: six stores, five sites, issue and final delivery."""
    k, day = C("o_orderkey"), F.to_date("o_orderdate")
    dates = [F.when(k % m == r, F.date_format(F.date_add(day, n), "yyyy-MM-dd")).alias(c) for c, (m, r, n) in LIST_DATES.items()]
    return logistics.list_events(t.orders.select(F.concat(F.lit("C"), k.cast("string")).alias("case_no"), F.lit("P1").alias("POL"), F.lit(" ").alias("POD"), F.when(k % 2 == 0, "Depot").otherwise("").alias("Final_Location"), *dates))
