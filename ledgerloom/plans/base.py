"""How the given tables are read as invoice lines, rate cards and so on, and the registry of queries with their SQL.

The same derivation is written twice, once with DataFrame functions and once as SQL text for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DESCRIPTIONS = (
    "Inland transport by flatbed", "Customs Inspection fee at port", "THC", "container detention 5 days", "yard storage charge", "BOE and customs clearance", "Delivery Order fee",
    "crane unloading at berth", "demurrage details", "marine insurance premium", "Bank commission", "download of academic papers",
)
PLACES = ("Musaffah", "M44 store", "Mina Zayed", "Jebel  Ali Freezone", "MOSB yard", "Shuweihat power station", "Mirfa PMO Samsung", "Al Markaz", "I.C.A.D. 2", "Khalifa Port")
VEHICLES = ("Flatbed HAZ", "FB", "lowbed CICPA", "14 mtr lb", "23 METER Lowbed", "3 Ton pickup", "7T", "", "Reefer-truck", "LB")
BASES = ("PER_TEU", "AT_COST", "lump_sum", "PER_TRIP")


class Tables:
    """The given tables of one folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        return self.lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
            p.alias("part_id"), s.alias("supp_id"), pick(DESCRIPTIONS, p).alias("description"), F.when(p % 17 != 0, F.col("l_quantity")).alias("qty"),
            F.when(p % 19 != 0, F.col("l_extendedprice") / F.col("l_quantity") * F.when(p % 23 == 0, 1.1).otherwise(1.0)).alias("rate"), F.col("l_extendedprice").alias("amount"),
            F.when(s % 3 == 0, "USD").otherwise("AED").alias("currency"), F.when(p % 29 != 0, F.col("l_tax")).alias("vat_rate"),
            F.when(p % 11 == 0, None).when(p % 13 == 0, 0.0).otherwise(F.col("l_extendedprice") / (1 + (p % 9 - 4) / 100.0)).alias("standard_amount"),
            F.to_date("l_shipdate").alias("day"), F.concat(F.lit("HVDC-"), (F.col("l_orderkey") % 500).cast("string")).alias("shipment_ref"),
            pick(PLACES, p).alias("origin"), pick(PLACES, s).alias("destination"), pick(VEHICLES, p + s).alias("vehicle"), F.when(p % 31 == 0, None).otherwise((p * 7 + s) % 400).cast("double").alias("distance_km"),
        )

    def rate_cards(self) -> DataFrame:
        p = F.col("p_partkey")
        start = F.date_add(F.lit("1992-01-01").cast("date"), ((p % 5) * 700).cast("int"))
        return self.part.select(
            p.alias("card_id"), pick(("TRANSPORT", "STORAGE", "CUSTOMS", "HANDLING"), p).alias("charge_code"), F.concat(F.lit("L"), (p % 40).cast("string")).alias("lane"),
            F.when(p % 37 == 0, 0.0).when(p % 41 == 0, None).otherwise(F.col("p_retailprice")).alias("contracted_rate"), start.alias("effective_from"),
            F.when(p % 3 != 0, F.date_add(start, 900)).alias("effective_to"),
        )

    def applied(self) -> DataFrame:
        """Lines with what a rate lookup needs: charge code, lane, applied rate near the card's price, basis."""
        p = F.col("l_partkey")
        price = F.col("p_retailprice") * (1 + F.col("l_tax") - 0.04)
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"), pick(("TRANSPORT", "STORAGE", "CUSTOMS", "HANDLING", "INSURANCE"), p).alias("charge_code"),
            F.concat(F.lit("L"), (p % 40).cast("string")).alias("lane"), F.when(p % 43 != 0, price).alias("applied_rate"), pick(BASES, F.col("l_suppkey")).alias("rate_basis"), F.to_date("l_shipdate").alias("day"),
        )


def pick(values: tuple[str, ...], number):
    """values[number modulo their count]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values, number: str) -> str:
    return f"{sql_list(values)}[({number}) % {len(values)} + 1]"


def sql_cases(rules, test: str) -> str:
    """CASE branches of an ordered keyword table; test is SQL with {k} for the keyword."""
    return " ".join(f"WHEN {' OR '.join(test.format(k=k) for k in words)} THEN '{value}'" for value, words in rules)


LINES = f"""WITH lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id, l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
    {sql_pick(DESCRIPTIONS, 'l_partkey')} AS description, CASE WHEN l_partkey % 17 <> 0 THEN l_quantity END AS qty,
    CASE WHEN l_partkey % 19 <> 0 THEN l_extendedprice / l_quantity * CASE WHEN l_partkey % 23 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END END AS rate, l_extendedprice AS amount,
    CASE WHEN l_suppkey % 3 = 0 THEN 'USD' ELSE 'AED' END AS currency, CASE WHEN l_partkey % 29 <> 0 THEN l_tax END AS vat_rate,
    CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice / (1 + (l_partkey % 9 - 4) / 100.0::DOUBLE) END AS standard_amount,
    l_shipdate::DATE AS day, 'HVDC-' || (l_orderkey % 500) AS shipment_ref, {sql_pick(PLACES, 'l_partkey')} AS origin, {sql_pick(PLACES, 'l_suppkey')} AS destination,
    {sql_pick(VEHICLES, 'l_partkey + l_suppkey')} AS vehicle, CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE ((l_partkey * 7 + l_suppkey) % 400)::DOUBLE END AS distance_km
  FROM lineitem),
guarded AS (
  SELECT *, CASE WHEN abs(qty * rate - amount) > 0.01 THEN NULL WHEN standard_amount > 0 AND qty * rate IS NOT NULL THEN floor((amount - standard_amount) / standard_amount * 100 * 100 + 0.5) / 100 END AS variance_pct,
    CASE WHEN abs(qty * rate - amount) > 0.01 THEN 'QTY_X_RATE_MISMATCH' WHEN standard_amount IS NULL THEN 'STANDARD_RATE_NOT_AVAILABLE'
         WHEN standard_amount > 0 AND abs((amount - standard_amount) / standard_amount * 100) > 2 THEN 'COST_VARIANCE_EXCEEDS_2PCT' END AS reason_code
  FROM lines)
"""
CARDS = f"""WITH rate_cards AS (
  SELECT p_partkey AS card_id, {sql_pick(('TRANSPORT', 'STORAGE', 'CUSTOMS', 'HANDLING'), 'p_partkey')} AS charge_code, 'L' || (p_partkey % 40) AS lane,
    CASE WHEN p_partkey % 37 = 0 THEN 0.0 WHEN p_partkey % 41 = 0 THEN NULL ELSE p_retailprice END AS contracted_rate,
    DATE '1992-01-01' + ((p_partkey % 5) * 700)::INT AS effective_from, CASE WHEN p_partkey % 3 <> 0 THEN DATE '1992-01-01' + ((p_partkey % 5) * 700 + 900)::INT END AS effective_to
  FROM part),
applied AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id, {sql_pick(('TRANSPORT', 'STORAGE', 'CUSTOMS', 'HANDLING', 'INSURANCE'), 'l_partkey')} AS charge_code,
    'L' || (l_partkey % 40) AS lane, CASE WHEN l_partkey % 43 <> 0 THEN p_retailprice * (1 + l_tax - 0.04::DOUBLE) END AS applied_rate, {sql_pick(BASES, 'l_suppkey')} AS rate_basis, l_shipdate::DATE AS day
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name, with SQL that gives the same rows."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return build

    return register
