"""Boundaries, ties and traps of the rules on small rows."""

import datetime
import difflib
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, places, rules
from ledgerloom.functions import text as T
from ledgerloom.operators import documents, lanes, logistics, lookup, recon
from ledgerloom.plans import texts
from ledgerloom.plans.base import Tables
from ledgerloom.sources import sheets, sinks
from ledgerloom.streaming import jobs

C = F.col


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_rounding(spark):
    assert values(spark, [2.5, -2.5, 0.125, -0.125], "x double", numbers.half_up(C("x"), 0)) == [3.0, -2.0, 0.0, 0.0]
    assert values(spark, [0.125, 0.135, -0.125], "x double", numbers.half_even(C("x"), 2)) == [0.12, 0.14, -0.12]


@pytest.mark.parametrize("applied, verdict, status", [(102.0, "PASS", "AUTO_COMPARE_OK"), (102.004, "AMBER", "AUTO_COMPARE_OK"), (105.0, "AMBER", "AUTO_COMPARE_WITH_DUPLICATE_REVIEW"), (105.01, "ZERO", "AUTO_COMPARE_REQUIRE_REVIEW_EVIDENCE"), (94.99, "ZERO", "AUTO_COMPARE_REQUIRE_REVIEW_EVIDENCE")])
def test_rate_boundaries(spark, applied, verdict, status):
    r = values(spark, [applied], "x double", rules.rate_check(F.lit(100.0), C("x"), F.lit(None).cast("string")))[0]
    assert (r.verdict, r.ai_rate_status) == (verdict, status)


def test_rate_edges(spark):
    rows = [(0.0, 5.0, None), (None, 5.0, "at_cost"), (None, 5.0, None), (5.0, None, None)]
    got = [(r.verdict, r.reason_code, r.rate_type) for r in values(spark, rows, "c double, a double, b string", rules.rate_check(C("c"), C("a"), C("b")))]
    assert got == [("PASS", None, "CONTRACT_NUMERIC"), ("AMBER", "RATE_NOT_FOUND", "TEXT_EXCEPTION"), ("AMBER", "RATE_NOT_FOUND", "MISSING_RATE"), ("AMBER", "RATE_NOT_APPLIED", "MISSING_RATE")]


def test_keyword_traps(spark):
    assert values(spark, ["details", "download", "academic", "Ocean Freight", "x"], "d string", rules.charge_code(C("d"))) == ["DETENTION", "HANDLING", "DEMURRAGE", "TRANSPORT", "GENERAL"]
    got = [(r.type_b, r.confidence) for r in values(spark, ["THC", "the thc fee", "thcs", "none"], "d string", rules.type_b(C("d")))]
    assert got == [("THC", 0.95), ("THC", 0.95), ("THC", 0.85), ("OTHERS", 0.5)]


def test_lane_edges(spark):
    rows = [(None, 100.0, 100.0), (2.0, 115.0, 100.0), (2.01, 115.01, 100.0), (10.01, 110.0, 100.0), (300.01, 1.0, 0.0)]
    got = values(spark, rows, "km double, a double, b double", rules.lane_check(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(""), C("km"), C("a"), C("b")))
    assert [(r.rate_band, r.band, r.verdict, r.fixed_suspect) for r in got] == [("UNKNOWN", "PASS", "PASS", False), ("SHORT_RUN", "CRITICAL", "AMBER", True), ("SHORT_RUN", "CRITICAL", "ZERO", False), ("SHORT_RUN", "HIGH", "AMBER", False), ("LONG_HAUL", "UNKNOWN", "AMBER", False)]
    assert got[1].reason_code == "DOMESTIC_RATE_CRITICAL_SHORT_RUN_FIXED_SUSPECT"
    assert values(spark, [("", "")], "a string, b string", rules.lane_key(C("a"), C("b"))) == [None]


def test_reconcile_and_final_verdict(spark):
    rows = [(None, 1.0, 1.0, False), (1.0, 1.005, 1.005, False), (1.0, 1.02, 1.02, False), (1.0, 101.0, 101.0, True), (5.0, 5.0, 6.0, False)]
    got = [r.reason for r in values(spark, rows, "i2 double, l double, b double, d boolean", recon.reconcile(C("i2"), C("l"), C("b"), C("d")))]
    assert got == ["FINAL_SUBTOTAL_MISSING", None, "LINE_TOTAL_MISMATCH", None, "TYPEB_TOTAL_MISMATCH"]
    rows = [("CRITICAL", -50.0), ("CRITICAL", 15.1), ("UNKNOWN", None), ("PASS", 0.0)]
    assert values(spark, rows, "b string, d double", rules.final_verdict(F.lit(None).cast("string"), C("b"), C("d"))) == ["VERIFIED", "FAIL", "PENDING_REVIEW", "VERIFIED"]


def test_as_of_edges(spark):
    d = datetime.date
    cards = spark.createDataFrame([("k", 1, d(2024, 1, 1), d(2024, 6, 30), 10.0), ("k", 2, d(2024, 6, 30), None, 20.0), ("k", 3, d(2024, 6, 30), None, 30.0)], "key string, id int, s date, e date, rate double")
    days = [d(2023, 12, 31), d(2024, 1, 1), d(2024, 6, 29), d(2024, 6, 30), d(2030, 1, 1)]
    rows = spark.createDataFrame([("k", x) for x in days] + [("z", days[1]), (None, days[1])], "key string, day date")
    got = {(r.key, r.day): r.rate for r in lookup.as_of(rows, cards, ["key"], "day", "s", "e", ["rate"], "id").collect()}
    assert [got["k", x] for x in days] == [None, 10.0, 10.0, 20.0, 20.0] and got["z", days[1]] is None and got[None, days[1]] is None


def test_text_helpers(spark):
    assert values(spark, ["mail a.b@example.com now"], "t string", T.masked(C("t"))) == ["mail " + "•" * 15 + " now"]
    assert values(spark, ["TCLU4265791 x", "TCLU4265790"], "t string", T.containers(C("t"))) == [["TCLU4265791"], ["TCLU4265790"]]
    assert values(spark, ["X-0005, 0200", "X-1"], "t string", T.expand_reference(C("t"))) == [["X-0005", "X-0200"], ["X-1"]]
    assert values(spark, ["IBAN AED 5.00\nAED 1,234.50 AED 7"], "t string", T.amounts(C("t"))) == [[1234.5, 7.0]]
    assert values(spark, ["=1", "a"], "t string", rules.literal_text(C("t"))) == ["'=1", "a"]
    docs = spark.createDataFrame([(1, "a\nb x@example.org password: abc"), (2, None)], "id int, t string")
    assert {(r.type, r.line_no) for r in documents.dlp_findings(docs, "id", "t").collect()} == {("EMAIL", 2), ("CREDENTIAL", 2)}


def test_places_and_similarity(spark):
    assert values(spark, ["mina  zayed free port", "MOSB", None], "t string", places.place(C("t"))) == ["MINA ZAYED PORT", "AL MASAOOD (MOSB)", ""]
    assert values(spark, ["FB haz", "lowbed", "7t"], "t string", places.vehicle(C("t"))) == ["FLATBED HAZMAT", "LOWBED", "7 TON PU"]
    assert values(spark, [("abcd", "bcde"), ("", "")], "a string, b string", places.sequence_ratio(C("a"), C("b"))) == [0.75, 1.0]
    assert values(spark, [("abc", "abd")], "a string, b string", places.indel_ratio(C("a"), C("b"))) == [pytest.approx(66.6667, 1e-4)]
    assert values(spark, ["ﬁle"], "t string", places.nfkc(C("t"))) == ["file"]


def test_latest_before_edges(spark):
    day = datetime.date
    ledger = spark.createDataFrame([("a", day(2024, 1, 1), 5, 1.0), ("a", day(2024, 1, 3), 9, 2.0), ("a", day(2024, 1, 3), 7, None), (None, day(2024, 1, 1), 1, 9.0), ("b", None, 2, 8.0)], "key string, at date, id int, rate double")
    rows = spark.createDataFrame([("a", day(2023, 12, 31)), ("a", day(2024, 1, 1)), ("a", day(2024, 1, 2)), ("a", day(2024, 1, 3)), ("a", day(2024, 1, 3)), ("a", None), (None, day(2024, 5, 1)), ("b", day(2024, 5, 1))], "key string, day date")
    got = sorted((tuple(r) for r in lookup.latest_before(rows, ledger, ["key"], "day", "at", ["id", "rate"], "id").collect()), key=str)
    want = [("a", day(2023, 12, 31), None, None), ("a", day(2024, 1, 1), 5, 1.0), ("a", day(2024, 1, 2), 5, 1.0), *[("a", day(2024, 1, 3), 7, None)] * 2, ("a", None, None, None), (None, day(2024, 5, 1), None, None), ("b", day(2024, 5, 1), None, None)]
    assert got == sorted(want, key=str)


def test_exact_lanes(spark):
    known = spark.createDataFrame([(1, "Musaffah", "Mirfa", "FB", "per truck"), (2, "Jebel Ali", "MOSB", "Lowbed", "truck")], "lane_id int, origin string, destination string, vehicle string, unit string")
    rows = spark.createDataFrame([("MUSAFFAH", "MIRFA", "flatbed", ""), ("mosb", "jebel ali", "lb", "trip"), ("Depot 9", "Elsewhere", "FB", "")], "origin string, destination string, vehicle string, unit string")
    aliases = spark.createDataFrame([], "raw_place string, normal_place string")
    got = {r.origin: (r.lane_id, r.method) for r in lanes.exact(rows, known, aliases).collect()}
    assert got == {"MUSAFFAH": (1, "EXACT_NORM_KEY"), "mosb": (2, "REVERSED_KEY"), "Depot 9": (None, None)}


def test_fuzzy_lanes_equal_brute_force(spark, monkeypatch):
    columns = "origin string, destination string, vehicle string, unit string, rate double"
    lane_rows = [(i, o, d, v, u, 100.0 + 20 * i) for i, (o, d, v, u) in enumerate([("Musaffah", "Mirfa PMO", "FB", "per truck"), ("Jebel Ali", "MOSB", "Lowbed", "truck"), ("Mina Zayed", "Mirfa", "FB haz", "RT"), ("Khalifa Port", "Al Markaz", "7T", ""), ("Mirfa", "Musaffah", "FB", ""), ("ICAD 2", "Mirfa yard", "3T", "RT"), ("Al Markaz", "Port Rashid", "FB", "")])]
    asked = [("MUSAFFAH", "MIRFA", "flatbed", "", 110.0), ("mosb", "jebel ali", "lb", "trip", 130.0), ("Depot 9", "Elsewhere", "FB", "", None), ("Depot 9", "Mirfa", "zeppelin", "RT", 150.0), ("Musaffah", "", "FB", "", 90.0), ("Musaffah", "Nowhere", "FB", "", 500.0), ("", "Mirfa", "7T", "", 0.0), (None, None, None, None, 5.0), ("MUSAFFAH", "MIRFA", "flatbed", "", 300.0)]
    known = spark.createDataFrame(lane_rows, "lane_id int, " + columns)
    lines = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "line_id int, " + columns)
    words = lambda c: places.tokens(C(c))
    plain = lambda df, key: {r[key]: r for r in lanes.normalized(df).select(key, "o", "d", "v", "u", "rate", words("o").alias("ot"), words("d").alias("dt")).collect()}
    ls, qs = plain(known, "lane_id"), plain(lines, "line_id")
    jaccard = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    end = lambda x, y, a, b: 0.65 * jaccard(a, b) + 0.35 * difflib.SequenceMatcher(None, x, y).ratio()

    def best(q, top):
        near = lambda side: {i for i, x in ls.items() if set(x[side]) & set(q[side])}
        found = near("ot") if q.ot else set(ls)
        if q.dt:
            found = found & near("dt") if found else near("dt")
        found = found or set(ls)
        base = lambda v: v.split(" ")[0]
        fit = {i for i in found if base(ls[i].v) == base(q.v)} or found
        out = []
        for i in fit:
            x = ls[i]
            bonus = (0.08 if q.v == x.v else 0.04 if base(q.v) == base(x.v) else 0) + (0.03 if q.u == x.u else 0)
            bonus += 0.12 * max(0.0, 1 - abs(q.rate - x.rate) / x.rate * 100 / 50) if q.rate and q.rate > 0 else 0
            f = (end(q.o, x.o, q.ot, x.ot) + end(q.d, x.d, q.dt, x.dt)) / 2 + bonus
            r = (end(q.o, x.d, q.ot, x.dt) + end(q.d, x.o, q.dt, x.ot)) / 2 + bonus - 0.02
            out.append((-round(max(f, r), 9), i, "REVERSED" if r > f else "FORWARD"))
        return [(i, round(max(0.0, min(0.99, -s)), 4), way) for s, i, way in sorted(out)[:top]]

    got = {}
    for r in sorted(lanes.fuzzy(lines, known, 2).collect(), key=lambda r: (r.line_id, r.place)):
        got.setdefault(r.line_id, []).append((r.lane_id, r.score, r.direction))
    assert got == {i: best(q, 2) for i, q in qs.items()}
    monkeypatch.setattr(lanes, "BLOCK", 1)
    monkeypatch.setattr(lanes, "SHARE", 1)
    again = {}
    for r in sorted(lanes.fuzzy(lines, known.repartition(4), 2).collect(), key=lambda r: (r.line_id, r.place)):
        again.setdefault(r.line_id, []).append((r.lane_id, r.score, r.direction))
    assert again == got and lanes.fuzzy(lines, known.where("false")).collect() == []


def test_numbers_meet_only_references_that_hold_them(spark):
    """Of what ends in the same figures, only what a number can be inside of a reference is dealt out."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        lines = spark.range(300).selectExpr("cast(id as int) AS line_id", "concat('HVDC-', (id + 100) * 10000 + 7777) AS ref", "cast(id as int) AS row_no")
        docs = lines.selectExpr("line_id + 1000 AS document_id", "replace(ref, 'HVDC-', '') AS ref", "row_no + 1000 AS row_no")
        found = lanes.documents_of_lines(lines, docs)
        assert {tuple(r) for r in found.collect()} == {(n, n + 1000) for n in range(300)}
        todo, met = [found._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                met.append(node.metrics().apply("shuffleRecordsWritten").value())
        assert met and sum(met) <= 4000
    finally:
        for k in plain:
            spark.conf.unset(k)


def test_contained_references_and_nearest_ids(spark):
    lines = [(1, "hvdc-123", 5), (2, "HVDC-12", 6), (3, " 7 ", 7), (4, "", 8), (5, None, 9), (6, "HVDC-ADOPT-SCT-0001, 0002", 10)]
    docs = [(10, "HVDC-12", 0), (11, "sct hvdc-123 b", 0), (12, "0002", 7), (13, "", 0), (14, "17", 0), (15, "adopt-sct-0001, 0002", 0)]
    got = {tuple(r) for r in lanes.documents_of_lines(spark.createDataFrame(lines, "line_id int, ref string, row_no int"), spark.createDataFrame(docs, "document_id int, ref string, row_no int")).collect()}
    clean = lambda s: (s or "").strip().upper()
    want = {(a, b) for a, x, i in lines for b, y, j in docs if i == j or clean(x) and clean(y) and (clean(x) in clean(y) or clean(y) in clean(x))}
    assert got == want and len(want) > 5
    rng = random.Random(5)
    ids = ["".join(rng.choice("AB-01") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    typed, known = ids[:60], ids[60:]
    typed += ["HVDC-ADPT-SCT-0007", "A" * 70, "", "HVDC-ADOPT-SCT-00 x"]
    known += ["HVDC-ADOPT-SCT-0100", "HVDC-ADOPT-SCT-0013", "A" * 66 + "B", "A" * 300, "HVDC-ADOPT-SCT"]
    found = lanes.nearest_ids(spark.createDataFrame([(x,) for x in typed], "typed string"), spark.createDataFrame([(x,) for x in known], "known string").repartition(3), 75.0)

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _lcs_row(row, x, b)
        return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0

    want = {}
    for x in set(typed):
        best = max(ratio(x, y) for y in set(known))
        if best >= 75:
            want[x] = best
    assert {r.typed: pytest.approx(r.ratio) for r in found.collect()} == want
    for r in found.collect():
        assert r.known == min(y for y in known if ratio(r.typed, y) == ratio(r.typed, r.known)) and ratio(r.typed, r.known) == pytest.approx(r.ratio)
    table = places.IdTable([*known, "C" * 400])
    assert all(list(table.ratios(x)) == pytest.approx([ratio(x, y) for y in table.texts]) for x in typed)


def _lcs_row(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[-1], row[j + 1]))
    return out


def test_masks_equal_re_sub(spark, sf_dir):
    rows = texts.noted(Tables(spark, sf_dir)).select("text", T.masked(C("text")).alias("m")).collect()
    for r in rows:
        want = r.text
        for p in (r"[\w\.-]+@[\w\.-]+", r"\b(\+?\d[\d\-\s]{6,}\d)\b"):
            want = re.sub(p, lambda m: "\u2022" * len(m[0]), want)
        assert r.m == want
    assert any("\u2022" in r.m for r in rows) and values(spark, [None], "t string", T.masked(C("t"))) == [None]


def test_ocr_pages_of_odd_json(spark):
    rows = [(1, None), (2, "no json"), (3, '{"pages": [{"page": 1, "words": [{"text": "BOE 12345", "confidence": 0.5}, {"text": "x", "confidence": 1.0}]}, {"page": 2}]}')]
    got = [(r.k, r.page, r.text, r.n_words, r.confidence, r.references) for r in documents.ocr_pages(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect()]
    assert got == [(3, 1, "BOE 12345 x", 2, 0.75, ["BOE 12345"]), (3, 2, "", 0, None, [])]


def test_upsert_seen_and_transitions(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, seq int")
    assert sorted(map(tuple, lookup.upsert(table, changes, ["id"], "seq").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3), (None, 4)], "k string, n int")
    got = {r.n: r.duplicate for r in lookup.seen(rows, spark.createDataFrame([("m",)], "k string"), "k", "n").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_workbooks_and_lines(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [["Invoice"], [], ["Description", "Qty", "Amount (AED)", "Amount (USD)"], ["Trucking", "2", "367", "100"], ["", "1", "3", "4"]]
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    found = sheets.read_workbooks(spark, str(tmp_path))
    assert [(r.description, r.qty, r.amount) for r in sheets.lines(found).collect()] == [("Trucking", "2", "100")]


def test_replace_source_and_empty_tables(spark, tmp_path):
    target = str(tmp_path / "t")
    sinks.replace_source(spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string"), target)
    sinks.replace_source(spark.createDataFrame([(3, "b")], "id int, source string"), target)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 3]
    empty = spark.createDataFrame([], "unit_id string, line_no int, " + ", ".join(f"flag_{s} string" for s in logistics.SITES) + ", " + ", ".join(f"receipt_{x} string" for x in logistics.LOCATIONS) + ", etd string, atd string, eta string, ata string, customs_close string, final_delivery string")
    assert logistics.units(empty).count() == logistics.validation_log(empty).count() == 0


def test_streams(spark, sf_dir, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    counts = jobs.run_to(jobs.window_counts(jobs.table_stream(spark, source), "ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    whole = spark.read.parquet(source).groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert counts.count() > 0 and counts.join(whole, ["day", "event_type", "n"], "left_anti").count() == 0
    polls = spark.createDataFrame([("a", "DONE", 2), ("a", "RUNNING", 3), ("b", "RUNNING", 1)], "job_id string, status string, at int")
    assert {r.job_id: r.status for r in jobs.latest_status(polls).collect()} == {"a": "DONE", "b": "RUNNING"}
