"""Events, units, validation log and actions derived from a wide shipment register.

A register row has unit_id, line_no, flag_<site>, receipt_<location> and one text column for each milestone. Every derivation
is one pass over the register (unpivot or arrays inside the row); nothing has to be shuffled but by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, places

# Sites, warehouses, milestones and their order.
SITES = ("AGI", "DAS", "MIR", "SHU")
OFFSHORE = ("AGI", "DAS")
WAREHOUSES = ("DSV_INDOOR", "DSV_OUTDOOR")
LOCATIONS = (*WAREHOUSES, "MOSB", *SITES)
MILESTONES = (("M50_ETD", "etd"), ("M55_ATD", "atd"), ("M60_ETA", "eta"), ("M70_ATA", "ata"), ("M80_ATTESTATION", "attestation"), ("M90_DO_COLLECTED", "do_collection"), ("M91_CUSTOMS_STARTED", "customs_start"), ("M92_CUSTOMS_CLOSED", "customs_close"), ("M140_FINAL_DELIVERED", "final_delivery"))
SCHEMES = ("CASE_NO", "ShipmentUnit", "sourceLineId", "invoiceNo", "SCT_REF")
RANKS = {"M040_DEPARTED": 10, "M050_ARRIVED": 20, "WH_RECEIPT": 40, "SITE_RECEIPT": 80, "M100_FINAL_DELIVERED": 90}


DATE_CELLS = (*[f"receipt_{x}" for x in LOCATIONS], *[c for _, c in MILESTONES])


def _complete(register: DataFrame) -> DataFrame:
    """register with blank columns for the milestones that it does not have."""
    return register.withColumns({c: F.lit(None).cast("string") for _, c in MILESTONES if c not in register.columns})


def day_of(cell: str) -> Column:
    """A parsed date cell of facts()."""
    return F.get("day", F.lit(DATE_CELLS.index(cell)))


def requirements(register: DataFrame) -> DataFrame:
    """(unit_id, line_no, site) of each flag that is O."""
    wide = register.select("unit_id", "line_no", *[F.col(f"flag_{s}").alias(s) for s in SITES]).unpivot(["unit_id", "line_no"], list(SITES), "site", "flag")
    return wide.where(places.flag(F.col("flag"))["status"] == "ok").drop("flag")


def receipts(register: DataFrame) -> DataFrame:
    """(unit_id, line_no, location, raw, day) of each receipt cell that is not blank; day is null where it is no date."""
    wide = register.select("unit_id", "line_no", *[F.col(f"receipt_{x}").alias(x) for x in LOCATIONS]).unpivot(["unit_id", "line_no"], list(LOCATIONS), "location", "raw")
    return wide.where(F.nullif(F.trim("raw"), F.lit("")).isNotNull()).withColumn("day", numbers.excel_date(F.col("raw")))


def milestones(register: DataFrame) -> DataFrame:
    """(unit_id, line_no, code, day) of each milestone with a date."""
    wide = _complete(register).select("unit_id", "line_no", *[F.col(c).alias(code) for code, c in MILESTONES]).unpivot(["unit_id", "line_no"], [code for code, _ in MILESTONES], "code", "raw")
    return wide.select("unit_id", "line_no", "code", numbers.excel_date(F.col("raw")).alias("day")).where("day is not null")


def facts(register: DataFrame) -> DataFrame:
    """register rows with arrays: declared sites, dated receipts and milestones, and what follows from them. Each date cell is parsed once,
    in a generator, through which the optimiser does not copy expressions into those that use its days (column day)."""
    register = _complete(register).withColumn("day", F.explode(F.array(F.array(*[numbers.excel_date(F.col(c)) for c in DATE_CELLS]))))

    def dated(pairs: list[tuple[str, str]]) -> Column:
        return F.filter(F.array(*[F.struct(F.lit(name).alias("name"), day_of(c).alias("day")) for name, c in pairs]), lambda x: x["day"].isNotNull())

    declared = F.array_compact(F.array(*[F.when(places.flag(F.col(f"flag_{s}"))["status"] == "ok", s) for s in SITES]))
    rows = register.withColumns({
        "declared": declared, "received": dated([(x, f"receipt_{x}") for x in LOCATIONS]), "reached": dated(list(MILESTONES)), "final_day": day_of("final_delivery"),
        "ata_day": day_of("ata"), "closed_day": day_of("customs_close"), "mosb_day": day_of("receipt_MOSB"),
    })
    at = F.transform("received", lambda r: r["name"])
    rows = rows.withColumns({
        "at_sites": F.array_intersect(F.array(*[F.lit(s) for s in SITES]), at), "has_warehouse": F.arrays_overlap(at, F.array(*[F.lit(w) for w in WAREHOUSES])), "has_mosb": F.array_contains(at, "MOSB"),
        "last_receipt": F.array_max(F.transform("received", lambda r: r["day"])), "last_reached": F.array_max(F.transform("reached", lambda r: r["day"])),
    })
    latest = F.transform(F.filter("received", lambda r: r["day"] == F.col("last_receipt")), lambda r: r["name"])
    milestone = F.get(F.transform(F.filter("reached", lambda r: r["day"] == F.col("last_reached")), lambda r: r["name"]), F.lit(0))
    site = F.size("at_sites") > 0
    stage = F.when(F.col("final_day").isNotNull(), "M140_FINAL_DELIVERED").when(site, "M130_SITE_RECEIVED").when(F.col("has_mosb"), "M115_MOSB_STAGED").when(F.col("has_warehouse"), "M110_WAREHOUSE_RECEIVED").otherwise(F.coalesce(milestone, F.lit("M00_PLANNED")))
    routing = (
        F.when(F.col("has_warehouse") & F.col("has_mosb") & site, "WH_MOSB_SITE").when(F.col("has_mosb") & site, "MOSB_SITE").when(F.col("has_warehouse") & site, "WH_SITE").when(site, "DIRECT_SITE")
        .when(F.col("has_mosb"), "MOSB_STAGE").when(F.col("has_warehouse"), "WH_ONLY").otherwise("UNKNOWN")
    )
    offshore_reached = F.col("final_day").isNotNull() | F.arrays_overlap("at_sites", F.array(*[F.lit(s) for s in OFFSHORE]))
    return rows.withColumns({
        "current_stage": stage, "current_location": F.when(F.size(latest) > 1, "MULTI_LOCATION").when(F.size(latest) == 1, latest[0]).otherwise(""), "routing": routing,
        "missing_sites": F.array_except("declared", "at_sites"), "unflagged_sites": F.array_except("at_sites", "declared"), "offshore": F.arrays_overlap("declared", F.array(*[F.lit(s) for s in OFFSHORE])),
        "no_news": (F.size("received") == 0) & F.col("final_day").isNull(), "final_too_early": F.coalesce(F.col("final_day") < F.col("last_receipt"), F.lit(False)), "offshore_reached": offshore_reached,
        "before_mosb": F.transform(F.filter("received", lambda r: r["name"].isin(*OFFSHORE) & (r["day"] < F.col("mosb_day"))), lambda r: r["name"]),
    })


def units(register: DataFrame) -> DataFrame:
    """(unit_id, current_stage, current_location, routing, n_required, n_received, n_gaps)."""
    f = facts(register)
    return f.select("unit_id", "current_stage", "current_location", "routing", F.size("declared").alias("n_required"), F.size("at_sites").alias("n_received"), F.size("missing_sites").alias("n_gaps"))


def _rows(f: DataFrame, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(unit_id, rule, level, reason, subject): a row for each element of each rule's array of subjects, in one pass."""
    packed = F.flatten(F.array(*[F.transform(subjects, _named(rule, level, reason)) for rule, level, reason, subjects in rules]))
    return f.select("unit_id", F.explode(packed).alias("r")).select("unit_id", "r.*")


def _named(rule: str, level: str, reason: str):
    return lambda s: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.lit(reason).alias("reason"), s.alias("subject"))


def _if(condition: Column, subject: Column | None = None) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(subject if subject is not None else F.lit(""))).otherwise(F.array().cast("array<string>"))


def validation_log(register: DataFrame) -> DataFrame:
    f = facts(register)
    warned = F.array_compact(F.array(*[F.when(places.flag(F.col(f"flag_{s}"))["status"] == "warn", s) for s in SITES]))
    broken = F.array_compact(F.array(*[F.when((F.nullif(F.trim(F.col(f"receipt_{x}")), F.lit("")).isNotNull()) & day_of(f"receipt_{x}").isNull(), x) for x in LOCATIONS]))

    def early(day: str) -> Column:
        return F.transform(F.filter("received", lambda r: r["name"].isin(*SITES) & (r["day"] < F.col(day))), lambda r: r["name"])

    return _rows(f, [
        ("V-REC-001", "BLOCK", "RECEIPT_DT_NOT_DATE", broken), ("V-DEST-001", "AMBER", "ALL_DEST_BLANK", _if(F.size("declared") == 0)), ("V-DEST-002", "WARN", "DEST_FLAG_NOT_O_OR_BLANK", warned),
        ("V-DEST-003", "OPEN", "REQUIRED_DEST_NO_RECEIPT", F.col("missing_sites")), ("V-DEST-004", "WARN", "RECEIPT_WITHOUT_DEST_FLAG", F.col("unflagged_sites")),
        ("V-DEST-005", "INFO_SPLIT_DELIVERY", "MULTIPLE_DEST_REQUIRED", _if(F.size("declared") > 1, F.array_join("declared", "|"))), ("V-REC-002", "WARN", "RECEIPT_BEFORE_ATA", early("ata_day")),
        ("V-REC-003", "AMBER", "SITE_RECEIPT_BEFORE_CUSTOMS_CLOSE", early("closed_day")), ("V-REC-004", "BLOCK", "FINAL_DELIVERY_BEFORE_RECEIPT", _if(F.col("final_too_early"))),
        ("V-REC-005", "OPEN", "NO_RECEIPT_NO_FINAL", _if(F.col("no_news"))), ("V-MOSB-001", "AMBER", "MOSB_MISSING_FOR_OFFSHORE", _if(F.col("offshore") & F.col("offshore_reached") & ~F.col("has_mosb"))),
        ("V-MOSB-002", "BLOCK", "MOSB_AFTER_SITE_RECEIPT", F.col("before_mosb")), ("V-MOSB-003", "WARN", "MOSB_WITHOUT_OFFSHORE_FLAG", _if(F.col("has_mosb") & ~F.col("offshore"))),
    ])


def actions(register: DataFrame) -> DataFrame:
    f = facts(register)
    return _rows(f, [
        ("REQUEST_SITE_RECEIPT_DATE", "Site Receiving Coordinator", "REQUIRED_DEST_NO_RECEIPT", F.col("missing_sites")), ("REVIEW_DESTINATION_FLAG", "Logistics Data Steward", "RECEIPT_WITHOUT_DEST_FLAG", F.col("unflagged_sites")),
        ("REQUEST_MOSB_STAGING_EVIDENCE", "Marine Supervisor", "MOSB_MISSING_FOR_OFFSHORE", _if(F.col("offshore") & F.col("offshore_reached") & ~F.col("has_mosb"), F.lit("MOSB"))),
        ("FOLLOW_UP_SITE_DELIVERY", "Warehouse Execution Coordinator", "WH_RECEIVED_NO_SITE_DELIVERY", _if(F.col("has_warehouse") & (F.size("declared") > 0) & (F.size("at_sites") == 0), F.array_join("declared", "|"))),
        ("REQUEST_DELIVERY_STATUS_UPDATE", "Forwarder / Site Logistics", "NO_RECEIPT_NO_FINAL", _if(F.col("no_news"))), ("REVIEW_DATE_CONFLICT", "Logistics Data Steward", "FINAL_DELIVERY_BEFORE_RECEIPT", _if(F.col("final_too_early"))),
        ("REVIEW_MOSB_SEQUENCE", "Marine Supervisor", "MOSB_AFTER_SITE_RECEIPT", _if(F.size("before_mosb") > 0, F.lit("MOSB"))),
    ])


def canonical_events(register: DataFrame) -> DataFrame:
    """(unit_id, event_type, event_rank, site, day): departures, arrivals, receipts and final delivery in one form."""
    f = facts(register)

    def one(kind: str, site: Column, day: Column) -> Column:
        return F.struct(F.lit(kind).alias("event_type"), F.lit(RANKS[kind]).alias("event_rank"), site.alias("site"), day.alias("day"))

    none = F.lit(None).cast("string")
    fixed = F.array(one("M040_DEPARTED", none, F.coalesce(day_of("atd"), day_of("etd"))), one("M050_ARRIVED", none, F.coalesce(F.col("ata_day"), day_of("eta"))), one("M100_FINAL_DELIVERED", none, F.col("final_day")))
    store = F.transform(F.filter("received", lambda r: r["name"].isin(*WAREHOUSES)), lambda r: one("WH_RECEIPT", r["name"], r["day"]))
    sites = F.transform(F.filter("received", lambda r: r["name"].isin(*SITES)), lambda r: one("SITE_RECEIPT", r["name"], r["day"]))
    return f.select("unit_id", F.explode(F.filter(F.concat(fixed, store, sites), lambda e: e["day"].isNotNull())).alias("e")).select("unit_id", "e.*")


# A warehouse list's columns of stores and sites with what they stand for, and ranks of its events.
STORE_COLUMNS = {"DHL WH": ("DHL", "WAREHOUSE"), "DSV Indoor": ("DSV_AUH", "INDOOR"), "DSV Al Markaz": ("AMZ", "INDOOR"), "AAA Storage": ("AAA", "OPEN_YARD"), "DSV Outdoor": ("DSV_AUH", "OUTDOOR"), "DSV MZP": ("MOSB", "OPEN_YARD")}
SITE_COLUMNS = {"MOSB": "MOSB_SITE", "MIR": "MIR", "SHU": "SHU", "DAS": "DAS", "AGI": "AGI"}
LIST_RANKS = {"M040_DEPARTED": 10, "M050_ARRIVED": 20, "WH_RECEIPT": 40, "WH_ISSUE": 60, "SITE_RECEIPT": 80, "M100_FINAL_DELIVERED": 90}


def list_events(cases: DataFrame) -> DataFrame:
    """(case_no, event_type, event_rank, site, zone, day, source_column) of a warehouse list: rows (case_no, ATD, ETD, ATA, ETA, `last out wh`, POL, POD, Final_Location, and
    STORE_COLUMNS and SITE_COLUMNS), all text. The final delivery is the latest receipt at one of the four sites; where it was and where goods
    were issued from is the last of these sites with a receipt, in order MIR, SHU, DAS, AGI, else the final location. Each date is parsed once."""
    dates = ["ETD", "ATD", "ETA", "ATA", "last out wh", *STORE_COLUMNS, *SITE_COLUMNS]
    rows = cases.withColumn("_d", F.explode(F.array(F.array(*[numbers.excel_date(F.col(f"`{c}`")) for c in dates]))))
    day = lambda c: F.get("_d", F.lit(dates.index(c)))
    sites = ("MIR", "SHU", "DAS", "AGI")
    final = F.greatest(*[day(s) for s in sites])
    here = F.coalesce(*[F.when(day(s).isNotNull(), s) for s in reversed(sites)], F.nullif(F.trim("Final_Location"), F.lit("")))
    none = F.lit(None).cast("string")

    def one(kind: str, when: Column, site: Column, zone: Column, source: str) -> Column:
        return F.struct(F.lit(kind).alias("event_type"), F.lit(LIST_RANKS[kind]).alias("event_rank"), F.nullif(F.trim(site), F.lit("")).alias("site"), zone.alias("zone"), when.alias("day"), F.lit(source).alias("source_column"))

    events = [one("M040_DEPARTED", F.coalesce(day("ATD"), day("ETD")), F.col("POL"), none, "ETD/ATD"), one("M050_ARRIVED", F.coalesce(day("ATA"), day("ETA")), F.col("POD"), none, "ETA/ATA")]
    events += [one("WH_RECEIPT", day(c), F.lit(site), F.lit(zone), c) for c, (site, zone) in STORE_COLUMNS.items()] + [one("WH_ISSUE", day("last out wh"), here, none, "last out wh")]
    events += [one("SITE_RECEIPT", day(c), F.lit(site), none, c) for c, site in SITE_COLUMNS.items()] + [one("M100_FINAL_DELIVERED", final, here, none, "Final_Location")]
    return rows.select("case_no", F.explode(F.filter(F.array(*events), lambda e: e["day"].isNotNull())).alias("e")).select("case_no", "e.*")


def dwell(events: DataFrame) -> DataFrame:
    """(unit_id, first_store, first_site, dwell_days, last_event): our definition of the latest-per-unit and dwell views."""
    store, site = F.col("event_type") == "WH_RECEIPT", F.col("event_type") == "SITE_RECEIPT"
    out = events.groupBy("unit_id").agg(F.min(F.when(store, F.col("day"))).alias("first_store"), F.min(F.when(site, F.col("day"))).alias("first_site"), F.max_by("event_type", F.struct("day", "event_rank")).alias("last_event"))
    return out.withColumn("dwell_days", F.datediff("first_site", "first_store"))


def identifiers(register: DataFrame, schemes: dict[str, Column]) -> DataFrame:
    """(unit_id, scheme, value, normalized, confidence) of each identifier that is given; the rule has five SCHEMES."""
    wide = register.select("unit_id", *[c.alias(name) for name, c in schemes.items()]).unpivot(["unit_id"], list(schemes), "scheme", "value")
    return wide.where(F.nullif(F.trim("value"), F.lit("")).isNotNull()).withColumns({"normalized": places.case_id(F.col("value")), "confidence": F.lit(0.98)})


def merged_cases(records: DataFrame, key: str, ordinal: str, latest: list[str]) -> DataFrame:
    """One row for each case: of most fields the first value that is not empty, of `latest` ones the largest date."""
    fields = [c for c in records.columns if c not in (key, ordinal)]
    aggregates = [F.max(numbers.excel_date(F.col(c))).alias(c) if c in latest else F.min_by(c, F.when(F.nullif(c, F.lit("")).isNotNull(), F.col(ordinal))).alias(c) for c in fields]
    return records.where(F.nullif(F.trim(key), F.lit("")).isNotNull()).groupBy(key).agg(*aggregates)
