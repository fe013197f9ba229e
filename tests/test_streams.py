"""Polled statuses and paired extractions over streams that are stopped and go on from their checkpoint."""

import datetime

from ledgerloom.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def at(hours):
    return START + datetime.timedelta(hours=hours)


def test_polled_jobs_across_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    first = [("a", at(0), "PENDING"), ("a", at(1), "RUNNING"), ("b", at(0), "DONE"), ("c", at(0), "PENDING"), ("c", at(9), "RUNNING"), ("d", at(1), "RUNNING"), (None, at(0), "DONE"), ("e", None, "DONE"), ("f", at(0), None)]
    then = [("a", at(3), "FAILED"), ("a", at(4), "DONE"), ("b", at(5), "FAILED"), ("g", at(400), "RUNNING")]

    def run(rows):
        spark.createDataFrame(rows, "job string, at timestamp, status string").coalesce(1).write.mode("append").parquet(source)
        found = jobs.run_to(jobs.polled(jobs.table_stream(spark, source)), out, checkpoint)
        return {r.job: (r.status, r.n_polls) for r in jobs.final_status(found).collect()}, found.count()

    got, _ = run(first)
    assert got == {"a": ("RUNNING", 2), "b": ("DONE", 1), "c": ("TIMEOUT", 1), "d": ("RUNNING", 1)}
    got, n = run(then)
    assert got == {"a": ("FAILED", 3), "b": ("DONE", 1), "c": ("TIMEOUT", 1), "d": ("TIMEOUT", 1), "g": ("RUNNING", 1)}
    assert run([("b", at(401), "FAILED")]) == (got, n)  # cached: nothing more is given out


def test_paired_extractions_across_a_restart(spark, tmp_path):
    left, right, out, checkpoint = (str(tmp_path / x) for x in ("left", "right", "out", "checkpoint"))
    schema = "doc int, at timestamp, ref string, amount double"

    def run(a, b):
        for rows, path in ((a, left), (b, right)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        pairs = jobs.paired(jobs.table_stream(spark, left), jobs.table_stream(spark, right), "doc", ["ref", "amount"], "10 minutes")
        return sorted((r.doc, r.verdict, r.differ) for r in jobs.run_to(pairs, out, checkpoint).collect())

    assert run([(1, at(0), "x", 1.0), (2, at(0), None, 2.0), (3, at(0), "z", 3.0)], [(1, at(0.1), "x", 1.0), (4, at(0), "q", 4.0)]) == [(1, "AGREE", "")]
    got = run([(5, at(1), "v", 5.0), (99, at(999), "", 0.0)], [(2, at(0.1), None, 9.0), (5, at(2), "v", 5.0), (98, at(999), "", 0.0)])
    assert got == [(1, "AGREE", ""), (2, "DISAGREE", "amount"), (3, "LEFT_ONLY", None), (4, "RIGHT_ONLY", None), (5, "LEFT_ONLY", None), (5, "RIGHT_ONLY", None)]


def test_jobs_of_one_group_do_not_touch_each_other(spark, tmp_path):
    """Forty jobs in three groups: done, failed, silent, late, and one that comes last and lets the watermark pass the others."""
    rows = [(f"j{n}", at(n % 5 + hour), status) for n in range(40) for hour, status in ((0, "PENDING"), (1 + 8 * (n % 4 == 3), ("DONE", "FAILED", "RUNNING", "DONE")[n % 4]))]
    source, got = str(tmp_path / "in"), {}
    for part in (rows[:50], rows[50:], [("last", at(900), "PENDING")]):
        spark.createDataFrame(part, "job string, at timestamp, status string").coalesce(1).write.mode("append").parquet(source)
        found = jobs.run_to(jobs.polled(jobs.table_stream(spark, source), groups=3), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        got = {r.job: (r.status, r.n_polls) for r in jobs.final_status(found).collect()}
    ends = (("DONE", 2), ("FAILED", 2), ("TIMEOUT", 2), ("TIMEOUT", 1))
    assert got == {f"j{n}": ends[n % 4] for n in range(40)} | {"last": ("PENDING", 1)}
