"""Waybills: fields, lane with the way it was found, times, confidence and flags of each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waybills as W


def _once(rows: DataFrame, name: str, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """rows with an array of columns (texts), which is computed once a row, since the optimiser copies no expression out of a generator; and how
    each is read from it."""
    return rows.withColumn(name, F.explode(F.array(F.array(*columns.values())))), {k: F.get(F.col(name), F.lit(n)) for n, k in enumerate(columns)}


def parsed(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with W.FIELDS, W.TIMES, origin, destination, their sites, method, confidence and flags. A way of finding the lane that comes
    later fills what earlier ones left open; a table replaces both. Null texts have nothing but flags."""
    said = F.coalesce(F.col(text), F.lit(""))
    rows, raw = _once(documents, "_raw", W.fields(said) | {"section": F.coalesce(W.first(said, W.ROUTING, flags="(?is)"), F.lit(""))})
    origins, destinations = W.candidates(said, raw["section"])
    rows, o = _once(rows, "_o", origins)
    rows, d = _once(rows, "_d", destinations)
    rows, o = _once(rows, "_c", {k: W.cleaned(c) for k, c in o.items()})
    rows, o = _once(rows, "_vo", {k: W.if_valid(c) for k, c in o.items()})
    rows, d = _once(rows, "_vd", {k: W.if_valid(c) for k, c in d.items()})
    pair = lambda k: F.when(o[k].isNotNull() & d[k].isNotNull(), F.struct(o[k].alias("o"), d[k].alias("d")))
    table, spoken = F.coalesce(pair("t0"), pair("t1")), F.coalesce(pair("s"), F.struct(o["l"].alias("o"), d["l"].alias("d")))
    rows, lane = _once(rows, "_lane", {"ro": F.coalesce(o["r0"], o["r1"], o["r2"]), "rd": F.coalesce(d["r0"], d["r1"]), "to": table["o"], "td": table["d"], "so": spoken["o"], "sd": spoken["d"], "dd": d["d"]})
    whole = lane["ro"].isNotNull() & lane["rd"].isNotNull()
    tabled = ~whole & lane["to"].isNotNull()
    some = lambda *keys: F.coalesce(*[lane[k] for k in keys]).isNotNull()
    method = F.when(whole, "routing_section_clean").when(tabled, "table").when(some("ro", "rd"), "routing_section_clean").when(some("so", "sd"), "text").when(some("dd"), "direct_label")
    rows, found = _once(rows, "_l", {
        "origin": F.when(whole, lane["ro"]).when(tabled, lane["to"]).otherwise(F.coalesce(lane["ro"], lane["so"])),
        "destination": F.when(whole, lane["rd"]).when(tabled, lane["td"]).otherwise(F.coalesce(lane["rd"], lane["sd"], lane["dd"])), "method": method,
    })
    own = {c: raw[c] for c in (*W.FIELDS, *W.TIMES)} | found
    rows = rows.select(*[F.col(f"`{c}`") for c in documents.columns if c not in own], *[c.alias(k) for k, c in own.items()])
    rows = rows.withColumns({"origin_site": W.site(F.col("origin")), "destination_site": W.site(F.col("destination"))})
    one = lambda c, points=1.0: F.when(c, points).otherwise(0.0)
    points = sum((one(F.col(c).isNotNull()) for c in W.REQUIRED), F.lit(0.0)) + one(W.valid_place(F.col("destination"))) + one(W.valid_place(F.col("origin")), 0.5) + one(F.col("req_truck_type").isNotNull())
    rows = rows.withColumn("confidence", F.least(F.lit(1.0), F.round(points / (len(W.REQUIRED) + 2), 4)))
    flags = F.array_compact(F.array(
        F.when(F.col("trip_no").isNull(), "TRIP_NO_MISSING"), F.when(F.col("origin").isNull() | F.col("destination").isNull(), "LANE_INCOMPLETE"), F.when(~W.valid_place(F.col("origin")), "ORIGIN_INVALID"),
        F.when(~W.valid_place(F.col("destination")), "DESTINATION_INVALID"), F.when(F.col("confidence") < 0.8, "LOW_CONFIDENCE"),
    ))
    return rows.withColumn("flags", flags)
