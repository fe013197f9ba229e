"""Charge lines on hand-made documents: what tables, text patterns and generic rows give, odd cells, SQL by registered names."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import line_items as items
from ledgerloom.operators import line_items


def of(text):
    return [r[1:] for r in items.TextLineItems().eval(text)]


def test_text_patterns():
    assert of(None) == of("") == of("nothing 5.00") == []
    assert of("12 Container reposition USD 10 2.5 12.5\n1 Stamps AED 3") == [("text:carrier_row", "Container reposition", "", "USD", 10.0, 2.5, 12.5)]
    assert of("7 ISPS fee AED 9") == [("text:carrier_row", "ISPS fee", "", "AED", 9.0, None, 9.0)]
    assert of("5 admin AED 20 15") == [("text:carrier_row", "admin", "", "AED", 15.0, None, 15.0)]  # what comes before a smaller total is no VAT
    assert of("EVERGREEN shipping agency isps/d 10.00 USD") == [("text:evg", "ISPS/D", "", "USD", 36.73, None, 36.73)]
    assert of("DEBIT NOTE\n12345678\nإستيراد 1234 5,600 \nDEBIT NOTE\nnone") == [("text:customs_debit", "Pre-Clear Debit 12345678", "", "AED", 5600.0, None, 5600.0)]
    assert of("DPC Charges 1 5.00 6.00\nMaqta Charges 1 1.00 2.00 0 0.00 3.00") == [("text:airport_fee", "DPC Charges", "", "AED", 6.0, 0.0, 6.0), ("text:airport_fee", "Maqta Charges", "", "AED", 2.0, 0.0, 3.0)]


def generic(text, tables):
    return [tuple(r) for r in items.GenericLines().eval(text, tables)]


def test_generic_rows():
    rows = [["Charge", "Qty", "Sum"], ["Towing", "3 box", "USD 1,000.50"], ["towing", "2 TEU", None], ["Subtotal", "", "9"], ["none", "", "0"], ["x", "", "1.2.3"], ["short"]]
    got = generic("ignored 12345", [{"page": 2, "rows": rows}])
    assert got == [("pdf_t_2_0", "Towing USD 1,000.50", "USD", 3.0, 3.0, None, "table"), ("pdf_t_2_1", "towing", "AED", 2.0, 2.0, None, "table")]  # the first column with a figure has the amounts
    assert generic("Fuel surcharge 1,200.00 USD 2\nshort 1\n" + "x" * 201 + " 1", None) == [("pdf_l_0", "Fuel surcharge", "USD", 2.0, None, None, "text")]
    assert generic(None, []) == generic("no figures here", [{"page": 1, "rows": [["a", "b"]]}]) == [(None,) * 7]
    assert generic("12,500.00", None) == [("pdf_l_0", "12,500.00", "AED", 12500.0, None, None, "text")]


def test_tables_and_numbering(spark):
    box = "TCLU4265791"
    rows = [
        ("a", 1, 0, "PORT_ALLIED", [["#", "Description/Container No", "Amount", "VAT", "Total"], ["1", f"{box}", "1,000.555", "x", "1050"], ["2", "TOTAL", "1", "1", "1"], ["3", None, None, "1", None], ["4", "only"]]),
        ("a", 1, 1, "PORT_CSP", [["Equipment No", "Amount"], [box.lower(), "7"], ["none", "8"], [box, None]]),
        ("b", 1, 0, "UNKNOWN", [["Tariff Description", "", "", "Total Amount"], ["thc", "", "", "5"], ["x", "y", "z", "none"]]),
        ("b", 1, 1, "CARRIER_CMA", [["Container Return Service Charge", "AED 5.00"], None]), ("c", 1, 0, "UNKNOWN", None), ("c", 1, 1, "UNKNOWN", []),
    ]
    tables = spark.createDataFrame(rows, "doc_id string, page int, table_index int, doc_type string, rows array<array<string>>")
    found = line_items.table_line_items(tables)
    got = sorted((r.doc_id, r.table_index, r.row_no, r.source, r.description, r.container, r.amount, r.vat, r.total) for r in found.collect())
    assert got == [
        ("a", 0, 1, "table:inspection", "Admin & Inspection Charges", box, pytest.approx(1000.555, abs=0.0051), None, 1050.0), ("a", 1, 1, "table:csp_detail", "", box, 7.0, None, 7.0),
        ("b", 0, 1, "table:csp_summary", "thc", "", 5.0, None, 5.0), ("b", 1, 1, "table:cma", "Container Return Service Charge", "", 5.0, None, 5.0),
    ]
    texts = spark.createDataFrame([("b", "CARRIER_CMA", "container return service charge AED 5\nContainer Return Service Charge AED 6"), ("d", None, None)], "doc_id string, doc_type string, text string")
    both = line_items.numbered(found, line_items.text_line_items(texts)).where("doc_id = 'b'").orderBy("line_id").collect()
    assert [(r.line_id, r.source, r.amount, r.category) for r in both] == [("L001", "table:csp_summary", 5.0, "THC"), ("L002", "table:cma", 5.0, "OTHERS"), ("L003", "text:cma", 6.0, "OTHERS")]
    items.register(spark)
    texts.createOrReplaceTempView("item_texts")
    assert [tuple(r) for r in spark.sql("SELECT t.doc_id, i.amount FROM item_texts t, LATERAL text_line_items(t.text) i ORDER BY i.ordinal").collect()] == [("b", 5.0), ("b", 6.0)]
    docs = texts.select("doc_id", "text", F.lit(None).cast("array<struct<page:int,rows:array<array<string>>>>").alias("tables"))
    assert sorted((r.doc_id, r.amount, r.confidence) for r in line_items.generic_lines(docs).where("amount is null or doc_id = 'b'").collect() if r.amount) == [("b", 5.0, 0.6), ("b", 6.0, 0.6)]
    assert [(r.doc_id, r.confidence) for r in line_items.generic_lines(docs).where("line_id is null").collect()] == [("d", 0.0)]
