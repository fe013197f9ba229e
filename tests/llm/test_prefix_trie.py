"""op12 against its SQL, and small tables with bands, blocks and queues cut short against a trie built in Python."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from ledgerloom.llm import prefix_trie, queries


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = set()
    words = lambda seq: len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
    for seq, own in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        kids = lambda s: [k for k in members if len(k) == len(s) + 1 and k[: len(s)] == s]
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(seq))
        out.add((min(own), len(seq), min(members[seq[:-1]]) if seq else None, len(own), len(kids(seq)), sum(not kids(s) for s in below), sum((len(members[s]) - 1) * words(s) for s in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def found(df, **how):
    rows = prefix_trie.trie(prefix_trie.paths(prefix_trie.rebuilt(prefix_trie.turns(df))), **how).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = con.execute(queries.OP12_SQL).fetchall()
    got = [tuple(r) for r in queries.op12_prefix_trie(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def random_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-25, 90), 60):
        rows += [(c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a b c", "a b", "\xa0x y\tz", "", None])) for t in range(rnd.choice([1, 1, 2, 3, 4, 6]))]
    rows += [(200 + k, t, "user", "hot text here") for k in range(40) for t in range(6)]  # a hot conversation, copied
    rows += [(300, t, "user", f"w{t} x") for t in range(60)]
    return rows + [(None, 0, "user", "none"), (1, 7, "user", "same"), (1, 7, "user", "same")]


@pytest.mark.parametrize("seed", [1, 2])
def test_small_bands_blocks_and_queues(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", depth int").repartition(3)
    assert found(df, band=3, most=2) == brute(rows)


def test_odd_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set() == found(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))
    rows = [(7, 0, "user", "x"), (7, 1, None, None), (27, 0, "user", "y " * 50_000)]  # bases 0 and 20 are absent
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_queue_spills_and_keeps_order():
    rnd = random.Random(5)
    queue, want = prefix_trie.SpillingQueue(most=10, piece=3), []
    for _ in range(500):
        m = (rnd.randint(-20, 0), rnd.randint(0, 2), 0, rnd.randint(0, 99))
        queue.push(m)
        want.append(m)
    assert queue.runs
    got = []
    for due in sorted({m[:2] for m in want}):
        got += list(queue.pop_due(due))
    assert got == sorted(want) and not queue
