"""A delivery note in full, and notes with nothing in them."""

from pyspark.sql import functions as F

from ledgerloom.functions import waybills
from ledgerloom.operators import waybills as operators

NOTE = """DSV SOLUTIONS Delivery Note/Waybill # : 0126-04466AUH
Printed Date: 12/01/2026  DO #: DO-9  Cust. Ref. #: C-1  BOL # B-2
Order Number: 0126-04466AUH
Job Number: HVDC-DSV-HE-MOSB-335
PO Number: PO-2026-001234
Routing and Destination:
Loading Address: DSV Mussafah Yard
Destination: MIRFA SITE
Trip No.: TRIP-2026-0445
Head Plate: 77123
Driver Name: A. Driver
Arrival for loading Date/Time: 12/01/2026 08:00
Loading finish Date/Time: 12/01/2026 09:30
"""


def test_note_in_full(spark):
    docs = spark.createDataFrame([(1, NOTE, "x"), (2, None, "x"), (3, "Order No. LOADING\nPO No. PO\nfrom: nowhere here to: terms and conditions\n", "x")], "id int, text string, flags string")
    rows = {r.id: r for r in operators.parsed(docs).collect()}
    r = rows[1]
    assert (r.waybill_no, r.trip_no, r.order_no, r.job_no, r.po_no, r.do_no, r.head_plate) == ("0126-04466AUH", "TRIP-2026-0445", "0126-04466AUH", "HVDC-DSV-HE-MOSB-335", "PO-2026-001234", "DO-9", "77123")
    assert (r.origin_site, r.destination_site, r.method, r.loading_finish_dt) == ("MOSB_YARD", "MIRFA_SITE", "routing_section_clean", "12/01/2026 09:30")
    assert r.confidence == round(5.5 / 6, 4) and r.flags == []
    for n in (2, 3):
        assert rows[n].confidence == 0.0 and rows[n].order_no is None and rows[n].flags == ["TRIP_NO_MISSING", "LANE_INCOMPLETE", "ORIGIN_INVALID", "DESTINATION_INVALID", "LOW_CONFIDENCE"]
    known = docs.select(waybills.is_waybill(F.col("text")).alias("w")).collect()
    assert [k.w for k in known] == [True, False, False]
