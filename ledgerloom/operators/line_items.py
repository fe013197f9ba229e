"""Charge lines of invoice documents: from tables of four layouts, from text, and of unknown layouts.

Tables are rows of (doc_id, page, table_index, doc_type, rows array<array<string>>); rows of a table are split up at once, so a
document's tables need not lie in one task. Only numbering brings a document's lines together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import line_items as items

FIELDS = ("layout", "row_no", "source", "description", "container", "currency", "amount", "vat", "total")


def number(text: Column) -> Column:
    """The first number of a cell, to two digits; null without one."""
    return F.round(F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double"), 2)


def described(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^[ :;-]+|[ :;-]+$", ""), 1, 160)


def table_line_items(tables: DataFrame) -> DataFrame:
    """(doc_id, page, table_index, doc_type, and FIELDS) of each charge row; a row may serve several layouts. Null cells count as empty.

    inspection: columns two to five are description with container, amount, VAT, total. csp_detail: columns by name, rows with a
    container. csp_summary: the last of a row's numbers is the total, the third last the amount. cma: any row that names the charge.
    """
    cells = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))
    split = tables.withColumn("rows", cells).where(F.size("rows") > 0)
    first, second = F.get("rows", F.lit(0)), F.array_join(F.coalesce(F.get("rows", F.lit(1)), F.array().cast("array<string>")), " | ")
    place = lambda name: (F.array_position(F.transform(first, lambda c: F.upper(c).contains(name)), True) - 1).cast("int").alias(name)
    split = split.select(
        "doc_id", "page", "table_index", "doc_type", F.upper(F.array_join(first, " | ")).alias("head"), F.when((F.size("rows") > 1) & F.upper(second).contains("SERVICE"), 2).otherwise(1).alias("start"),
        *map(place, ("SERVICE", "TARIFF DESCRIPTION", "EQUIPMENT NO", "AMOUNT")), F.posexplode("rows").alias("r", "row"),
    )
    head, r, row = F.col("head"), F.col("r"), F.col("row")
    cell = lambda i: F.get(row, i if isinstance(i, Column) else F.lit(i))
    at = lambda name: F.when(F.col(name) >= 0, F.get(row, F.col(name)))
    joined, none = F.array_join(row, " "), F.lit(None).cast("double")

    def item(layout: int, no: Column, source: str, text: Column, container: Column, amount: Column, vat: Column, total: Column) -> Column:
        return F.struct(F.lit(layout).alias("layout"), no.alias("row_no"), F.lit(f"table:{source}").alias("source"), described(text).alias("description"), container.alias("container"), F.lit("AED").alias("currency"), amount.alias("amount"), vat.alias("vat"), total.alias("total"))

    box = F.regexp_extract(F.upper(cell(1)), items.CONTAINER, 0)
    rest = F.trim(F.when(box == "", cell(1)).otherwise(F.replace(cell(1), box, F.lit(""))))
    charges = F.when(rest == "", "Admin & Inspection Charges").otherwise(rest)
    inspected = head.contains("DESCRIPTION/CONTAINER NO") & head.contains("AMOUNT") & head.contains("TOTAL") & (r >= 1) & (F.size(row) >= 5) & (F.trim(joined) != "") & (F.upper(F.trim(cell(1))) != "TOTAL")
    inspected = inspected & (number(cell(2)).isNotNull() | number(cell(4)).isNotNull())
    equipment, service = F.upper(F.trim(at("EQUIPMENT NO"))), F.coalesce(at("SERVICE"), F.lit(""))
    detailed = head.contains("EQUIPMENT NO") & head.contains("AMOUNT") & (r >= 1) & equipment.rlike(f"^(?:{items.CONTAINER})$") & number(at("AMOUNT")).isNotNull()
    numbers = F.filter(F.transform(row, number), lambda n: n.isNotNull())
    n = F.size(numbers)
    summed = head.contains("TARIFF DESCRIPTION") & head.contains("TOTAL AMOUNT") & (r >= F.col("start")) & ~F.upper(joined).contains("TOTAL") & (F.size(row) >= 4) & (n > 0)
    named = joined.contains(items.RETURN_SERVICE)
    priced = F.regexp_extract(joined, "(?i)" + items.RETURNED.pattern, 1)
    returned = number(F.when(priced != "", priced).otherwise(F.try_element_at(row, F.lit(-1))))
    found = F.array_compact(F.array(
        F.when(inspected, item(0, r, "inspection", charges, box, number(cell(2)), number(cell(3)), number(cell(4)))),
        F.when(detailed, item(1, r, "csp_detail", F.trim(F.concat_ws(" ", service, F.coalesce(at("TARIFF DESCRIPTION"), service))), equipment, number(at("AMOUNT")), none, number(at("AMOUNT")))),
        F.when(summed, item(2, r, "csp_summary", F.trim(F.concat_ws(" ", cell(0), cell(2))), F.lit(""), F.when(n >= 3, F.try_element_at(numbers, F.lit(-3))).otherwise(F.try_element_at(numbers, F.lit(-1))), none, F.try_element_at(numbers, F.lit(-1)))),
        F.when(named & returned.isNotNull(), item(3, r + 1, "cma", F.lit(items.RETURN_SERVICE), F.lit(""), returned, none, returned)),
    ))
    return split.select("doc_id", "page", "table_index", "doc_type", F.explode(found).alias("i")).select("doc_id", "page", "table_index", "doc_type", *[F.col(f"i.{c}") for c in FIELDS])


def text_line_items(documents: DataFrame) -> DataFrame:
    """(doc_id, doc_type, ordinal, source, ...) of each charge line in the texts of documents (doc_id, doc_type, text)."""
    return documents.lateralJoin(items.text_line_items(F.col("text").outer())).drop("text")


def numbered(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """A document's charge lines from tables, then text, equal ones once (tables first), with line_no and its form L001, category and status."""
    both = tables.select("doc_id", "doc_type", F.struct(F.lit(0).alias("a"), F.col("page").cast("long").alias("b"), F.col("table_index").cast("long").alias("c"), F.col("layout").alias("d"), F.col("row_no").alias("e")).alias("place"), *FIELDS[2:])
    both = both.unionByName(texts.select("doc_id", "doc_type", F.struct(F.lit(1).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).alias("d"), F.col("ordinal").alias("e")).alias("place"), *FIELDS[2:]))
    keys = ["doc_id", F.lower("description").alias("_key"), "container", "amount", "vat", "total"]
    one = both.groupBy(*keys).agg(F.min("place").alias("place"), F.min_by(F.struct("doc_type", "source", "description", "currency"), "place").alias("s")).drop("_key").select("*", "s.*").drop("s")
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    status = F.when(F.coalesce("total", "amount").isNotNull(), "MATCHED_AMOUNT").otherwise("PARTIAL")
    return one.withColumns({"line_no": no, "category": items.category(F.col("description"), F.col("doc_type")), "evidence_status": status}).withColumn("line_id", F.format_string("L%03d", "line_no")).drop("place")


def generic_lines(documents: DataFrame) -> DataFrame:
    """A row for each line of documents (doc_id, text, tables), and one without a line for those that have none: confidence 0.85 where
    there are lines and tables, 0.6 for lines without tables, 0 for none."""
    found = documents.lateralJoin(items.generic_lines(F.col("text").outer(), F.col("tables").outer()))
    some = F.size(F.coalesce("tables", F.array())) > 0
    confidence = F.when(F.col("line_id").isNull(), 0.0).when(some, 0.85).otherwise(0.6)
    return found.withColumn("confidence", confidence).drop("text", "tables")
