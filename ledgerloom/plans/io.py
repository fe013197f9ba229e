"""Queries of sources and streams: sheets found in cell tables, matrices, delimited text, and the append log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shared
from ..sources import sheets
from ..streaming import jobs
from .base import Tables, query

C = F.col


def folder(t: Tables, name: str) -> str:
    return shared.folder(t.spark, name)


def event_stream(t: Tables) -> DataFrame:
    """The events table as a stream: laid out as a folder of files, since a stream reads folders."""
    target = folder(t, "events")
    t.events.write.parquet(target)
    return jobs.table_stream(t.spark, target)


def order_cells(t: Tables) -> DataFrame:
    """Each order as a sheet: a title, a header and a row for each line."""
    sheet = C("o_orderkey").cast("string").alias("sheet")
    cell = lambda row, col, text: F.struct(F.lit(row).cast("long").alias("row"), F.lit(col).alias("col"), text.alias("text"))
    head = t.orders.select(sheet, F.explode(F.array(cell(0, 0, F.lit("Invoice")), cell(0, 1, C("o_orderpriority")), cell(2, 0, F.lit("No.")), cell(2, 1, F.lit("Charge Description")), cell(2, 2, F.lit("Qty")), cell(2, 3, F.lit("Amount (AED)")), cell(2, 4, F.lit("Amount (USD)")))).alias("c")).select("sheet", "c.*")
    row = (C("l_linenumber") * 100000000 + C("l_partkey") * 1000 + C("l_suppkey")).cast("long")
    one = t.lineitem.groupBy(C("l_orderkey").cast("string").alias("sheet"), row.alias("row")).agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"), F.max("l_extendedprice").alias("a"))
    body = one.select("sheet", "row", F.explode(F.array(*[F.struct(F.lit(i).alias("col"), x.alias("text")) for i, x in ((1, F.concat(F.lit("part "), C("p").cast("string"))), (2, C("q").cast("int").cast("string")), (3, F.lit("0")), (4, F.floor("a").cast("string")))])).alias("c")).select("sheet", "row", "c.*")
    return head.unionByName(body)


@query("s1_s2_s3_s6_sheet_lines", "SELECT l_orderkey::VARCHAR AS sheet, 'part ' || max(l_partkey) AS description, max(l_quantity)::INT::VARCHAR AS qty, floor(max(l_extendedprice))::BIGINT::VARCHAR AS amount FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey")
def _(t: Tables) -> DataFrame:
    return sheets.lines(order_cells(t)).select("sheet", "description", "qty", "amount")


@query("s4_s13_header_rows", "SELECT o_orderkey::VARCHAR AS sheet, 2::BIGINT AS header_row FROM orders")
def _(t: Tables) -> DataFrame:
    return sheets.first_keyword_row(order_cells(t), ["qty", "amount", "description", "rate"])


@query("s5_matrix", "SELECT c_custkey, charge, amount FROM (SELECT c_custkey, unnest(['transport', 'storage', 'customs']) AS charge, unnest([CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_custkey::DOUBLE END, 5.0::DOUBLE]) AS amount FROM customer) WHERE amount IS NOT NULL AND amount <> 0")
def _(t: Tables) -> DataFrame:
    k = C("c_custkey")
    wide = t.customer.select(k, F.when(k % 2 == 0, C("c_acctbal")).alias("transport"), F.when(k % 3 == 0, 0.0).otherwise(k.cast("double")).alias("storage"), F.lit(5.0).alias("customs"))
    return sheets.matrix_lines(wide, ["c_custkey"], ["transport", "storage", "customs"])


@query("s12_s16_k6_csv_round_trip", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _(t: Tables) -> DataFrame:
    from ..sources import sinks

    target = folder(t, "csv")
    sinks.csv_datasets({"nation": t.nation.select("n_nationkey", "n_name", "n_regionkey")}, target)
    return sheets.read_delimited(t.spark, f"{target}/nation")


@query("s12_markdown_tables", "SELECT o_orderkey::VARCHAR AS sheet, count(*) * 0 + 4 AS n_cells FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("# x\n| No | Amount |\n|---|---|\n| 1 | "), C("o_totalprice").cast("string"), F.lit(" |\nend"))
    return sheets.markdown_cells(t.orders.select("o_orderkey", text.alias("md")), "o_orderkey", "md").groupBy("sheet").agg(F.count("*").alias("n_cells"))


@query("s15_s17_json_round_trip", "SELECT s_suppkey AS lane_id, s_name AS name, s_acctbal AS rate FROM supplier")
def _(t: Tables) -> DataFrame:
    target = folder(t, "json")
    t.supplier.select(C("s_suppkey").alias("lane_id"), C("s_name").alias("name"), C("s_acctbal").alias("rate")).write.json(target)
    return t.spark.read.schema("lane_id long, name string, rate double").json(target)


@query("s20_typed_csv", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS size, p_partkey % 2 = 0 AS flag FROM part")
def _(t: Tables) -> DataFrame:
    shown = t.part.select("p_partkey", F.when(C("p_partkey") % 5 == 0, "").otherwise(C("p_size").cast("string")).alias("size"), F.when(C("p_partkey") % 2 == 0, "TRUE").otherwise("false").alias("flag"))
    return shown.select("p_partkey", F.nullif("size", F.lit("")).try_cast("int").alias("size"), (F.lower("flag") == "true").alias("flag"))


@query("s23_invoice_candidates", "SELECT 'f' || (o_custkey % 50) AS folder, 'f' || (o_custkey % 50) || '/' || min(CASE WHEN o_orderkey % 10 = 0 THEN 'invoice_' || lpad(o_orderkey::VARCHAR, 9, '0') || '.xlsx' END) AS path FROM orders GROUP BY o_custkey % 50 HAVING count_if(o_orderkey % 10 = 0) > 0")
def _(t: Tables) -> DataFrame:
    name = F.when(C("o_orderkey") % 10 == 0, F.concat(F.lit("invoice_"), F.lpad(C("o_orderkey").cast("string"), 9, "0"), F.lit(".xlsx"))).otherwise(F.concat(F.lit("note_"), C("o_orderkey").cast("string"), F.lit(".csv")))
    files = t.orders.select(F.concat(F.lit("f"), (C("o_custkey") % 50).cast("string"), F.lit("/"), name).alias("path"), C("o_totalprice").alias("length"))
    return sheets.invoice_candidates(files).where("score >= 8").select("folder", "path")


@query("k1_sheets", "SELECT 'lines' AS sheet, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def _(t: Tables) -> DataFrame:
    from ..sources import sinks

    tables = {"lines": t.lineitem, "orders": t.orders}
    return sinks.sheets(tables, {"lines": ["l_orderkey"], "orders": ["o_orderkey"]}, folder(t, "sheets")).select("sheet", "n_rows")


@query("t1_k4_trace_stream", "SELECT event_id, event_type AS step, ts AS at, floor(value)::BIGINT AS ms FROM events")
def _(t: Tables) -> DataFrame:
    return jobs.run_to(jobs.trace_log(event_stream(t)), folder(t, "trace"), folder(t, "trace-checkpoint"))


@query("t2_rerun_guard", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    runs = event_stream(t).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"), F.lit("ok").alias("status")).where("event_type <> 'error'")
    return jobs.run_to(jobs.first_runs(runs, ["user_id", "event_type"], "at", "3650 days").select("user_id", "event_type"), folder(t, "guard"), folder(t, "guard-checkpoint"))


def sliced_events(t: Tables, slices: int = 4) -> str:
    """The events table as a folder that has grown by stretches of time, so that a stream meets them in that order."""
    target = folder(t, "events")
    reach = t.events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    size = (reach["b"] - reach["a"]) / slices if reach["a"] else None
    for n in range(slices if size is not None else 0):
        until = C("ts") < F.lit(reach["a"] + (n + 1) * size) if n < slices - 1 else F.lit(True)
        t.events.where((C("ts") >= F.lit(reach["a"] + n * size)) & until).write.mode("append").parquet(target)
    if size is None:
        t.events.write.parquet(target)
    return target


STATUSES = {"view": "PENDING", "signup": "PENDING", "click": "RUNNING", "purchase": "DONE", "error": "FAILED"}


@query("t3_polled_status", """WITH p AS (SELECT user_id || '-' || floor(epoch(ts) / 86400)::BIGINT AS job, ts, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM events),
o AS (SELECT *, row_number() OVER w AS n, lag(ts) OVER w AS before FROM p WINDOW w AS (PARTITION BY job ORDER BY ts, status)),
e AS (SELECT job, min(n) FILTER (status IN ('DONE', 'FAILED')) AS terminal, min(n) FILTER (ts - before > INTERVAL 6 HOURS) AS gap, max(n) AS last FROM o GROUP BY job),
c AS (SELECT job, least(coalesce(terminal, last), coalesce(gap - 1, last)) AS n, coalesce(gap <= coalesce(terminal, last), false) AS late, terminal IS NULL AND gap IS NULL AS silent FROM e)
SELECT c.job, CASE WHEN late OR silent AND o.ts + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 10 DAYS FROM events) THEN 'TIMEOUT' ELSE o.status END AS status, c.n::BIGINT AS n_polls FROM c JOIN o ON o.job = c.job AND o.n = c.n""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """What a user did on a day, as polls of a job: statuses with a cached terminal one, silence of six hours is a timeout."""
    events = jobs.table_stream(t.spark, sliced_events(t))
    job = F.concat_ws("-", "user_id", F.floor(F.unix_seconds(C("ts").cast("timestamp")) / 86400))
    polls = events.select(job.alias("job"), C("ts").cast("timestamp").alias("at"), F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])[C("event_type")].alias("status"))
    return jobs.final_status(jobs.run_to(jobs.polled(polls), folder(t, "polls"), folder(t, "polls-checkpoint"))).select("job", "status", "n_polls")


@query("t4_paired_extractions", """WITH a AS (SELECT event_id // 2 AS k, ts, event_type, floor(value / 20) AS v FROM events WHERE event_id % 2 = 0 AND event_id % 10 <> 4),
b AS (SELECT event_id // 2 AS k, ts, event_type, floor(value / 20) AS v FROM events WHERE event_id % 2 = 1 AND event_id % 14 <> 5),
m AS (SELECT coalesce(a.k, b.k) AS pair, a.k AS x, b.k AS y, a.ts AS at1, b.ts AS at2, a.event_type <> b.event_type AS t, a.v <> b.v AS d FROM a FULL JOIN b ON a.k = b.k AND b.ts BETWEEN a.ts - INTERVAL 6 MINUTES AND a.ts + INTERVAL 6 MINUTES)
SELECT pair, CASE WHEN y IS NULL THEN 'LEFT_ONLY' WHEN x IS NULL THEN 'RIGHT_ONLY' WHEN t OR d THEN 'DISAGREE' ELSE 'AGREE' END AS verdict,
  CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN array_to_string([z FOR z IN [CASE WHEN t THEN 'event_type' END, CASE WHEN d THEN 'value' END] IF z IS NOT NULL], ',') END AS differ FROM m""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """Neighbouring events as two extractions of one document, some without an answer; a far later one on each side lets the
    watermark pass all others."""
    target = sliced_events(t)
    last = t.events.agg(F.max("ts").alias("ts")).select(F.explode(F.array(F.lit(-2).cast("long"), F.lit(-3).cast("long"))).alias("event_id"), (C("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    rest = {f.name: F.lit(None).cast(f.dataType) for f in t.events.schema if f.name not in last.columns}
    last.withColumns(rest).select(*t.events.columns).write.mode("append").parquet(target)
    k = C("event_id")
    side = lambda rows: rows.select(F.floor(k / 2).alias("pair"), C("ts").cast("timestamp").alias("at"), "event_type", F.floor(C("value") / 20).alias("value"))
    stream = jobs.table_stream(t.spark, target)
    left, right = side(stream.where((k % 2 == 0) & (k % 10 != 4))), side(jobs.table_stream(t.spark, target).where((k % 2 != 0) & (k % 14 != 5)))
    found = jobs.run_to(jobs.paired(left, right, "pair", ["event_type", "value"], "6 minutes"), folder(t, "pairs"), folder(t, "pairs-checkpoint"))
    return found.select("pair", "verdict", "differ")
