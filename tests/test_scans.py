"""Positions, masks and placeholders of repository scans, balanced objects against a letter-by-letter automaton, isolation trees walked one by one."""

import json
import random

import numpy as np

from ledgerloom.functions import scans
from ledgerloom.operators import anomalies
from ledgerloom.operators import scans as operators


def hits(text):
    return [(h[0], h[2], h[3], h[4], h[5]) for h in scans.private_hits(text)]


def test_what_counts_and_where():
    assert hits(None) == hits("") == hits("plain text") == []
    assert hits("a\nRate_USD = 120.5") == [("rate_usd_raw", 2, 18, 2, "Rate_USD = 120.5")]
    assert hits("[REDACTED " + "x" * 10 + " Rate_USD: 55") == [] and hits("[REDACTED " + "x" * 40 + " Rate_USD: 55")[0][0] == "rate_usd_raw"
    assert hits("MSCU1234567 ABCU0000000 TCLU7654321") == [("container_no", 24, 35, 1, "TCLU7654321")]
    assert hits("You@example.com me@corp.org you2@corp.org") == [("email", 16, 27, 1, "me@corp.org")]
    assert hits("1234567890123 900101-1234567") == [("pii", 14, 28, 1, "900101-1234567")]
    assert [h[0] for h in hits("KRW 5\nUSD")] == [] and [h[0] for h in hits("krw 5 to USD")] == ["fx_policy_violation"]
    assert hits("signed: someone here")[0][0] == "approval_text" and hits("x" * 5 + "\n  Approved by  me\n")[0][3] == 2


def test_repository_paths(spark):
    rows = [("src/a.md", "TRN: 123456789012345"), ("tests/a.md", "TRN: 123456789012345"), ("src/a.exe", "TRN: 123456789012345"), ("src\\b.TS", "ghp_" + "a" * 30), ("src/skip.json", "TRN: 123456789012345"), ("src/none.md", None)]
    found = operators.repository(spark.createDataFrame(rows, "path string, text string"), ("tests",), ("skip.json",)).collect()
    assert sorted((r.path, r.category) for r in found) == [("src/a.md", "trn"), ("src\\b.TS", "api_key")]


def test_cells(spark):
    grid = spark.createDataFrame([("p", "s", 0, 1, "call 12-345 678 or 123 4567 x"), ("p", "s", 2, 0, ""), ("p", "s", 3, 0, None), ("p", "s", 4, 2, "a.b@example.org")], "path string, sheet string, row int, col int, text string")
    got = {(r.row, r.col, r.category, r.value) for r in operators.cells(grid).collect()}
    assert (4, 2, "EMAIL", "a.b***org") in got and {g[2] for g in got} <= {"EMAIL", "PHONE"} and len(got) >= 2


def letter_by_letter(text):
    out, depth, start, string, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if not depth:
            if c == "{":
                depth, start = 1, i
        elif string:
            escaped, string = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            string = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                out.append((start, i + 1))
    return out


def test_balanced_objects():
    rnd = random.Random(8)
    for _ in range(3000):
        text = "".join(rnd.choices('{}"\\ab: ', k=rnd.randint(0, 30)))
        assert list(scans.objects(text)) == letter_by_letter(text), text
    objects = [{"a": 'x } \\ " {', "b": [{"c": "{"}]}, {}, {"n": 1}]
    text = "so " + " and ".join(map(json.dumps, objects)) + " {"
    assert [json.loads(text[s:e]) for s, e in scans.objects(text)] == objects and list(scans.objects(None)) == []
    assert len(list(scans.objects('{"' + "x" * 1_000_000 + '"}'))) == 1


def test_isolation_scores(spark):
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(500, 3))
    sample[0] = [40, -40, 40]
    forest = anomalies.Forest(sample, trees=20, size=64)

    def walked(row, root):
        while forest.column[root] >= 0:
            root = forest.left[root] if row[forest.column[root]] < forest.value[root] else forest.right[root]
        return forest.depth[root]

    want = [2 ** -(np.mean([walked(r, root) for root in forest.roots]) / float(anomalies.usual_depth(64))) for r in sample]
    got = forest.scores(sample)
    assert np.allclose(got, want) and got.argmax() == 0 and got[0] > 0.7 and np.median(got) < 0.55
    rows = [(i, float(x), float(y)) for i, (x, y, _) in enumerate(sample)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, 1.0), (902, 1.0, 1.0)]
    scored = {r.id: r.anomaly_score for r in anomalies.isolation_scores(spark.createDataFrame(rows, "id int, x double, y double"), ["x", "y"], "id").collect()}
    assert scored[900] is None and scored[901] is None and max((v, k) for k, v in scored.items() if v)[1] == 0
    assert {r.anomaly_score for r in anomalies.isolation_scores(spark.createDataFrame([(1, 2.0)] * 5, "id int, x double"), ["x"], "id").collect()} and anomalies.isolation_scores(spark.createDataFrame([], "id int, x double"), ["x"], "id").collect() == []
