"""op13 against a brute-force scan that counts every window anew, and the odd cases its docstring names."""

import hashlib
import random
import re
from collections import Counter
from math import log2

from pyspark.sql import functions as F

from ledgerloom.llm import queries, secret_scan

POLICY = secret_scan.Policy()
UUID = "550e8400-e29b-41d4-a716-446655440000"


def passes(window):
    """The rule of a window, from the window alone."""
    entropy = sum(-n / len(window) * log2(n / len(window)) for n in Counter(window).values())
    digits, letters = sum(c.isdigit() for c in window), [c for c in window if c.isalpha()]
    if digits < 2 or not letters:
        return False
    lower, upper = any(c.islower() for c in letters), any(c.isupper() for c in letters)
    if all(c in "0123456789abcdefABCDEF" for c in window) and lower != upper:
        return digits >= 4 and len(letters) >= 3 and entropy >= POLICY.hex_bits - 1e-12
    if lower and upper:
        return entropy >= POLICY.mixed_bits - 1e-12
    return digits >= 3 and entropy >= POLICY.one_case_bits - 1e-12


def brute(text):
    text = text or ""
    base = []
    for rank, (kind, pattern, group, least) in enumerate(secret_scan.BASE):
        base += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    own = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{16,}", text):
        run, at = m.group(), m.start()
        hit = [any(passes(run[i : i + 16]) for i in range(max(0, c - 15), min(c, len(run) - 16) + 1)) for c in range(len(run))]
        if text[:at].endswith("://") or run.startswith("//") and text[:at].endswith(":") or any(w.lower() in run.lower() for w in POLICY.words) or any(re.fullmatch(p, run) for p in POLICY.allowed):
            continue
        for s, e in ((g.start() + at, g.end() + at) for g in re.finditer("1+", "".join("01"[h] for h in hit))):
            if not any(a <= s and e <= b for a, _, b in base):
                own.append((s, 3, e))
    return [(secret_scan.KINDS[k], s, e) for s, k, e in sorted(own)]


def random_texts(count):
    rnd = random.Random(7)
    bits = [lambda: "".join(rnd.choices("0123456789abcdef", k=rnd.randint(10, 45))), lambda: "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=rnd.randint(10, 60))), lambda: "AKIA" + "".join(rnd.choices("ABCXYZ0189", k=rnd.randint(8, 20))),
            lambda: rnd.choice(["password=", "Token : '", "api_key\"=\"", "APIKEY=", "secret", "paſſword=", "toKen="]) + "".join(rnd.choices("abcXYZ019._-", k=rnd.randint(3, 20))), lambda: rnd.choice(["wörter und so", "a" * 50, "ab12" * 12, UUID, "the quick", "https://", "\n", "中文 \U0001f600", "0123456789abcdefghij"])]
    return [rnd.choice(["", " ", "\n"]).join(rnd.choice(bits)() for _ in range(rnd.randint(0, 9))) for _ in range(count)]


def test_scanner_equals_windows_counted_anew():
    scanner = secret_scan.Scanner(POLICY)
    texts = [None, "", *random_texts(600)]
    assert sum("entropy" in str(scanner.spans(t)) for t in texts) > 50
    for t in texts:
        assert scanner.spans(t) == brute(t), t


def test_query_over_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        base = [s for s in want if s[0] != "entropy"]
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert (r.spans, r.base_sha256) == (join(want), hashlib.sha256(join(base).encode()).hexdigest())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in secret_scan.KINDS[:3])


def test_odd_rows(spark):
    long = "x " * 200_000 + "9fJ2kLmQ8xTz4Vb7Nw1Rp5Yd" + " y" * 200_000
    rows = [(1, None, "s"), (1, None, "s"), (None, "", "s"), (2, long, "s"), (3, "Zq7" * 100_000, "s"), (4, "\U0001f600 secret:abcdefg secret:abcdefgh", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secret_scan.scan(docs).withColumn("masked", secret_scan.masked(F.coalesce("text", F.lit("")), F.col("spans")))
    assert got.columns == ["doc_id", "text", "spans", "masked"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert by[1, None].spans == [] and by[None, ""].spans == [] and by[3, rows[4][1]].spans == []
    assert [tuple(s) for s in by[2, long].spans] == [("entropy", 400_000, 400_024)] and by[2, long].masked == long.replace("9fJ2kLmQ8xTz4Vb7Nw1Rp5Yd", "*" * 24)
    assert [tuple(s) for s in by[4, rows[5][1]].spans] == [("assign", 17, 32)] and by[4, rows[5][1]].masked == "\U0001f600 secret:abcdefg " + "*" * 15
    assert secret_scan.scan(docs.where("false")).collect() == []
