"""Queries over delivery notes that Spark derives from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col as C

from ..functions import waybills
from ..operators import waybills as operators
from .base import Tables, pick, query, sql_pick

PLACES = ("DSV Mussafah Yard", "Mirfa Site UAE", "M44 Warehouse", "Head Plate ABC", "Customer Name & Address", "Terms and Conditions", "uae", "12345", "Plot 7", "Somewhere", "Port", "Khalifa Port, gate 3", "  ", "Issued by Samsung")
VALID = ("true", "true", "true", "false", "false", "false", "false", "false", "true", "false", "false", "true", "false", "false")


@query("f12_location_validity", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 29 = 0 THEN false ELSE {sql_pick(VALID, 'o_orderkey')} = 'true' END AS valid FROM orders")
def _(t: Tables) -> DataFrame:
    k = C("o_orderkey")
    return t.orders.select(k.alias("id"), waybills.valid_place(F.when(k % 29 == 0, F.concat(F.lit("Mirfa Site "), F.repeat(F.lit("x"), F.lit(100)))).otherwise(pick(PLACES, k))).alias("valid"))


def notes(t: Tables) -> DataFrame:
    """A note for each order: a routing section, a lane in a sentence, a table, a destination alone, no lane."""
    k = C("o_orderkey")
    head = F.format_string("DSV Delivery Note/Waybill #: WB-%s\nPrinted Date: 1/2/2024\nOrder Number: 12-%sAUH\nJob No. HVDC-%s-MOSB\nPO No: PO-2026-%s\n", k, k, k, k)
    trip = F.when(k % 3 != 0, F.concat(F.lit("Trip No.: T-"), k.cast("string"), F.lit("\n"))).otherwise("")
    truck = F.when(k % 2 == 0, "Req. Truck Type: Flatbed 40\n").otherwise("")
    kinds = (
        "Routing and Destination:\nLoading Address: DSV Mussafah Yard Head Plate 12\nDestination: Mirfa Site\nHead Plate 12\n", "goods go\nfrom: Khalifa Port Zone to: M44 Warehouse Yard\n",
        "Loading Point | Destination\nMina Zayed Port | Jebel Ali Site\n", "Destination: Shuweihat Site 9\n", "no lane\n",
    )
    times = F.when(k % 7 == 0, "Loading Finish Date/Time: 3/4/2024 10:20\n").otherwise("")
    return t.orders.select(k.alias("id"), F.concat(head, trip, truck, pick(kinds, k), times).alias("text"))


WAYBILL_SQL = f"""WITH w AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, {sql_pick(('DSV Mussafah Yard Head Plate 12', 'Khalifa Port Zone', 'Mina Zayed Port', '', ''), 'o_orderkey')} AS o,
  {sql_pick(('MOSB_YARD', 'KHALIFA_PORT', 'MINA_ZAYED_PORT', '', ''), 'o_orderkey')} AS origin_site, {sql_pick(('MIRFA_SITE', 'M44 Warehouse Yard', 'JEBEL_ALI_PORT', 'SHUWEIHAT_SITE', ''), 'o_orderkey')} AS destination_site,
  {sql_pick(('routing_section_clean', 'text', 'table', 'text', ''), 'o_orderkey')} AS method, 3 + (o_orderkey % 3 <> 0)::INT + CASE WHEN o_orderkey % 5 < 4 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 < 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + (o_orderkey % 2 = 0)::INT AS points FROM orders),
c AS (SELECT *, least(1.0::DOUBLE, round(points / 6.0::DOUBLE, 4)) AS confidence FROM w)
SELECT id, 'WB-' || id AS waybill_no, CASE WHEN id % 3 <> 0 THEN 'T-' || id END AS trip_no, CASE WHEN length('12-' || id || 'AUH') >= 6 THEN '12-' || id || 'AUH' END AS order_no, CASE WHEN id % 7 = 0 THEN '3/4/2024 10:20' END AS loading_finish_dt,
  nullif(method, '') AS method, nullif(origin_site, '') AS origin_site, nullif(destination_site, '') AS destination_site, confidence,
  array_to_string([x FOR x IN [CASE WHEN id % 3 = 0 THEN 'TRIP_NO_MISSING' END, CASE WHEN k >= 3 THEN 'LANE_INCOMPLETE' END, CASE WHEN k >= 3 THEN 'ORIGIN_INVALID' END, CASE WHEN k = 4 THEN 'DESTINATION_INVALID' END, CASE WHEN confidence < 0.8 THEN 'LOW_CONFIDENCE' END] IF x IS NOT NULL], ',') AS flags FROM c"""  # fmt: skip


@query("f13_waybill_fields", WAYBILL_SQL)
def _(t: Tables) -> DataFrame:
    found = operators.parsed(notes(t))
    return found.select("id", "waybill_no", "trip_no", "order_no", "loading_finish_dt", "method", "origin_site", "destination_site", "confidence", F.array_join("flags", ",").alias("flags"))
