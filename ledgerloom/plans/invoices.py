"""Queries over invoice tables and texts that Spark derives from orders and their lines; SQL takes the same figures from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col as C

from ..functions import line_items as items
from ..operators import line_items
from .base import Tables, query, sql_cases

CATEGORY = "CASE " + sql_cases(((name, words) for name, words in items.CATEGORIES), "contains(lower(description), '{k}')") + " ELSE {other} END"
LINE = "WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS part, max(l_quantity) AS qty, max(l_extendedprice) AS amount, floor(max(l_extendedprice)) / 20.0::DOUBLE AS vat FROM lineitem GROUP BY 1, 2) "


def lines(t: Tables) -> DataFrame:
    """One row for each order and line number: box, quantity, amount, VAT."""
    one = t.lineitem.groupBy(C("l_orderkey").alias("doc_id"), C("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"), F.max("l_quantity").alias("qty"), F.max("l_extendedprice").alias("amount"))
    return one.withColumns({"vat": F.floor(C("amount")) / 20.0, "box": F.when(C("part") % 5 == 0, "").otherwise(F.concat(F.lit("TCLU"), F.lpad(C("part").cast("string"), 7, "0")))})


def money(c) -> F.Column:
    return F.format_number(c, 2)


def tables(t: Tables) -> DataFrame:
    """A table for each order, in one of four layouts; an order's few lines are its rows."""
    k, text = C("doc_id") % 4, lambda *cells: F.array(*[c if isinstance(c, F.Column) else F.lit(c) for c in cells])
    row = (
        F.when(k == 0, text(C("n").cast("string"), F.concat(F.lit(" Customs inspection "), C("box")), money(C("amount")), money(C("vat")), money(C("amount") + C("vat"))))
        .when(k == 1, text("Gate", "Gate pass -", F.when(C("box") == "", "none").otherwise(F.concat(F.lit(" "), F.lower("box"))), money(C("amount"))))
        .when(k == 2, text("Quay", "", "loading of cargo", money(C("amount")), money(C("vat")), money(C("amount") + C("vat"))))
        .otherwise(F.when(C("n") % 2 == 1, text(C("n").cast("string"), F.concat(F.lit("Container Return Service Charge  AED "), money(C("amount"))), "7.00")).otherwise(text("9", "Container Return Service Charge", money(C("amount")))))
    )
    head = (
        F.when(k == 0, F.array(text("No", "Description/Container No", "Amount", "VAT", "Total"))).when(k == 1, F.array(text("Service", "Tariff Description", "Equipment No.", "Amount (Excl. Tax)")))
        .when(k == 2, F.array(text("Code", "", "Tariff Description", "Qty", "Tax", "Total Amount"), text("Service", "1.00", "x", "2.00", "", ""))).otherwise(F.array(text("No", "Charge", "Sum")))
    )
    foot = F.when(k == 0, F.array(text("", "Total", "1.00", "1.00", "2.00"))).when(k == 2, F.array(text("Total", "", "", "5.00"))).otherwise(F.array().cast("array<array<string>>"))
    grouped = lines(t).withColumn("row", row).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda x: x["row"]).alias("body"))
    kind = F.when(k == 0, "PORT_ALLIED").when(k == 1, "PORT_CSP").when(k == 2, "PORT_CSP").otherwise("CARRIER_CMA")
    return grouped.select("doc_id", F.lit(1).alias("page"), F.lit(2).alias("table_index"), kind.alias("doc_type"), F.concat(head, "body", foot).alias("rows"))


TABLE_ITEMS = (
    LINE + ", x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r, CASE WHEN part % 5 = 0 THEN '' ELSE 'TCLU' || lpad(part::VARCHAR, 7, '0') END AS box FROM l), items AS ("
    "SELECT doc_id, r AS row_no, 'table:inspection' AS source, 'Customs inspection' AS description, box AS container, amount, vat, round(amount + vat, 2) AS total, 'PORT_ALLIED' AS doc_type FROM x WHERE doc_id % 4 = 0 "
    "UNION ALL SELECT doc_id, r, 'table:csp_detail', 'Gate Gate pass', box, amount, NULL, amount, 'PORT_CSP' FROM x WHERE doc_id % 4 = 1 AND box <> '' "
    "UNION ALL SELECT doc_id, r + 1, 'table:csp_summary', 'Quay loading of cargo', '', amount, NULL, round(amount + vat, 2), 'PORT_CSP' FROM x WHERE doc_id % 4 = 2 "
    "UNION ALL SELECT doc_id, r + 1, 'table:cma', 'Container Return Service Charge', '', amount, NULL, amount, 'CARRIER_CMA' FROM x WHERE doc_id % 4 = 3) "
)


@query("f20_table_line_items", TABLE_ITEMS + "SELECT doc_id, row_no, source, description, container, amount, vat, total, " + CATEGORY.format(other="CASE doc_type WHEN 'CARRIER_CMA' THEN 'OTHERS' ELSE 'Inspection' END") + " AS category FROM items")
def _(t: Tables) -> DataFrame:
    found = line_items.table_line_items(tables(t))
    return found.select("doc_id", "row_no", "source", "description", "container", "amount", "vat", "total", items.category(C("description"), C("doc_type")).alias("category"))


def texts(t: Tables) -> DataFrame:
    """A text for each order, with charge lines of one of seven kinds between other lines."""
    k = C("o_orderkey")
    price, vat, box = C("o_totalprice"), F.floor(C("o_totalprice")) / 20.0, F.concat(F.lit("TCLU"), F.lpad((k % 10_000_000).cast("string"), 7, "0"))
    plain = lambda c: F.regexp_replace(money(c), ",", "")
    kinds = [
        F.format_string("1 Container inspection fee USD %s %s %s\n2 Office rent AED 5.00\n 31 Admin charges aed 12.50", plain(price), plain(vat), plain(price + vat)),
        F.format_string("Being Admin & Inspection\nCharges %s AED %s AED %s AED %s", F.lower(box), money(price), money(vat), money(price + vat)),
        F.format_string("TWCS Inspection Charges CNOS. %s per unit 1.00 %s %s", box, money(price), money(vat)),
        F.format_string("Maqta Charges 1 %s %s 0 0.00 %s\nAppointment charges 1 3.00 4.00", money(vat), money(price), money(price + vat)),
        F.format_string("Container Return Service Charge AED %s and more", money(price)),
        F.format_string("Evergreen Shipping Agency\nISPS/D 10.00 USD x %s 0.00%%\nContainer Maintenance Charge none", plain(price)),
        F.format_string("DEBIT NOTE\n%s\nImport 12345 %s\nDEBIT NOTE\nnothing here\nDebit note\n x\n %s\nC538", (k + 10_000_000).cast("string"), F.format_number(F.floor(price), 0), F.format_number(F.floor(vat) + 10, 0)),
    ]
    said = kinds[6]
    for n in range(5, -1, -1):
        said = F.when(k % 7 == n, kinds[n]).otherwise(said)
    return t.orders.select(k.alias("doc_id"), F.when(k % 7 == 6, "BOE_CUSTOMS").otherwise("UNKNOWN").alias("doc_type"), F.concat(F.lit("Header line\n"), said, F.lit("\nthank you")).alias("text"))


TEXT_ITEMS = (
    "WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, floor(o_totalprice) / 20.0::DOUBLE AS vat, 'TCLU' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') AS box FROM orders), items AS ("
    "SELECT k AS doc_id, 0 AS ordinal, 'text:carrier_row' AS source, 'Container inspection fee' AS description, '' AS container, 'USD' AS currency, price AS amount, vat, round(price + vat, 2) AS total FROM o WHERE k % 7 = 0 "
    "UNION ALL SELECT k, 1, 'text:carrier_row', 'Admin charges', '', 'AED', 12.5, NULL, 12.5 FROM o WHERE k % 7 = 0 "
    "UNION ALL SELECT k, 0, 'text:allied', 'Being Admin & Inspection Charges', box, 'AED', price, vat, round(price + vat, 2) FROM o WHERE k % 7 = 1 "
    "UNION ALL SELECT k, 0, 'text:twcs', 'TWCS Inspection Charges', box, 'AED', price, NULL, price FROM o WHERE k % 7 = 2 "
    "UNION ALL SELECT k, 0, 'text:airport_fee', 'Maqta Charges', '', 'AED', price, 0.0, round(price + vat, 2) FROM o WHERE k % 7 = 3 "
    "UNION ALL SELECT k, 1, 'text:airport_fee', 'Appointment charges', '', 'AED', 4.0, 0.0, 4.0 FROM o WHERE k % 7 = 3 "
    "UNION ALL SELECT k, 0, 'text:cma', 'Container Return Service Charge', '', 'AED', price, NULL, price FROM o WHERE k % 7 = 4 "
    "UNION ALL SELECT k, 0, 'text:evg', 'ISPS/D', '', 'USD', price, NULL, price FROM o WHERE k % 7 = 5 "
    "UNION ALL SELECT k, 1, 'text:evg', 'Container Maintenance Charge', '', 'AED', 175.0, NULL, 175.0 FROM o WHERE k % 7 = 5 "
    "UNION ALL SELECT k, 0, 'text:customs_debit', 'Pre-Clear Debit ' || (k + 10000000), '', 'AED', floor(price), NULL, floor(price) FROM o WHERE k % 7 = 6 "
    "UNION ALL SELECT k, 1, 'text:customs_debit', 'Pre-Clear Debit', '', 'AED', floor(vat) + 10, NULL, floor(vat) + 10 FROM o WHERE k % 7 = 6) "
)


@query("f21_text_line_items", TEXT_ITEMS + "SELECT doc_id, ordinal, source, description, container, currency, amount, vat, total, " + CATEGORY.format(other="CASE WHEN doc_id % 7 = 6 THEN 'Customs' ELSE 'OTHERS' END") + " AS category FROM items")
def _(t: Tables) -> DataFrame:
    found = line_items.text_line_items(texts(t))
    return found.select("doc_id", "ordinal", "source", "description", "container", "currency", "amount", "vat", "total", items.category(C("description"), C("doc_type")).alias("category"))


@query("f22_generic_lines", LINE + """, g AS (SELECT doc_id, n, qty, amount, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS r FROM l),
found AS (SELECT doc_id, 'pdf_t_3_' || r AS line_id, 'freight load ' || qty::INT || ' kg' || CASE WHEN n % 2 = 0 THEN ' USD' ELSE '' END AS description, CASE WHEN n % 2 = 0 THEN 'USD' ELSE 'AED' END AS currency, amount, qty::INT::DOUBLE AS qty, 0.85 AS confidence FROM g WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'pdf_l_' || r, 'freight of goods', CASE WHEN n % 2 = 0 THEN 'USD' ELSE 'AED' END, amount, NULL, CASE WHEN doc_id % 2 = 0 THEN 0.85 ELSE 0.6 END FROM g WHERE doc_id % 3 = 1
  UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL, NULL::DOUBLE, NULL::DOUBLE, 0.0 FROM g WHERE doc_id % 3 = 2)
SELECT doc_id, line_id, description, currency, amount, qty, confidence::DOUBLE AS confidence FROM found""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """Orders by threes: with a table, with text alone (every other one beside a table without amounts), with neither."""
    k, usd = C("doc_id") % 3, F.when(C("n") % 2 == 0, "USD").otherwise("")
    weight = F.concat(C("qty").cast("int").cast("string"), F.lit(" kg"))
    one = lines(t).select("doc_id", "n", F.array(money(C("amount")), F.lit("freight load"), weight, usd).alias("row"), F.concat(F.lit("freight of goods "), money(C("amount")), F.lit(" "), usd).alias("said"))
    docs = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "row", "said"))).alias("all"))
    rows = F.concat(F.array(F.array(F.lit("Price"), F.lit("Item"), F.lit("Weight"), F.lit("Currency"))), F.transform("all", lambda x: x["row"]), F.array(F.array(F.lit("9.99"), F.lit("Total"), F.lit(""), F.lit(""))))
    table = lambda rows: F.array(F.struct(F.lit(3).alias("page"), rows.alias("rows")))
    none = table(F.array(F.array(F.lit("Item"), F.lit("Sum")), F.array(F.lit("text"), F.lit("text"))))
    empty = F.array().cast("array<struct<page:int,rows:array<array<string>>>>")
    docs = docs.select("doc_id", F.when(k == 1, F.concat(F.array_join(F.transform("all", lambda x: x["said"]), "\n"), F.lit("\nshort 1\nno figures in this line"))).otherwise("nothing to see").alias("text"), F.when(k == 0, table(rows)).when((k == 1) & (C("doc_id") % 2 == 0), none).otherwise(empty).alias("tables"))
    return line_items.generic_lines(docs).select("doc_id", "line_id", "description", "currency", "amount", "qty", "confidence")


@query("d2_f20_f21_numbered_items", LINE + """SELECT doc_id, 'L' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY place)::VARCHAR, 3, '0') AS line_id, CASE WHEN place < 1000 THEN 'table:cma' ELSE 'text:cma' END AS source, amount, 'MATCHED_AMOUNT' AS evidence_status
FROM (SELECT doc_id, amount, min(place) AS place FROM (SELECT doc_id, amount, n AS place FROM l WHERE doc_id % 4 = 3 UNION ALL SELECT o_orderkey, o_totalprice, 1000 FROM orders WHERE o_orderkey % 4 = 3) GROUP BY 1, 2)""")
def _(t: Tables) -> DataFrame:
    """Tables and texts of every fourth order together: table rows come first, equal amounts once."""
    said = t.orders.select(C("o_orderkey").alias("doc_id"), F.lit("CARRIER_CMA").alias("doc_type"), F.format_string("Container Return Service Charge AED %s", money(C("o_totalprice"))).alias("text")).where("doc_id % 4 = 3")
    found = line_items.numbered(line_items.table_line_items(tables(t).where("doc_id % 4 = 3")), line_items.text_line_items(said))
    return found.select("doc_id", "line_id", "source", "amount", "evidence_status")
