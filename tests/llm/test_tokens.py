"""op1 and op9 against the tokenizers library on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing, queries, sstable
from ledgerloom.llm.common import library_encoder

ODD = ["\u00c0\u00c9 \u00df\u0130x \u01c5 \u00b2\u00bd3 na\u00efve\u00a0\u00ad\u0085x", "A\u030a J\u030c \u03a3\u03a3 \u0141\u00d3D\u0179'S \u0149 \u212b", None, "", " ", "a  b   c\n\n d", "\x1c!\x1d!", "don't  'll\t\u3000x\u2003 \u00e9e\u0301 \u0130\u03a3\u03c3 123 4 <|endoftext|>", "w" * 5000, "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c", "trail  ", "\x00\x7f it's \x0b_-\x1f OK\x0c'LL ~!", "\r\n x"]


def reference(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, lower", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces_equal_whole_texts(name, lower):
    whole = reference(name)
    got = [np.frombuffer(x, "<u4").tolist() for x in library_encoder(public_tokenizers.path(name), lower).texts(ODD)]
    assert got == [whole(t) for t in ODD]


def documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def check_packing(rows, texts, capacity=4096):
    whole = reference("word_bpe_49k.json")
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        ids, at = whole(text) + [2], 0
        for r in sorted(docs[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    assert padding <= 0.01 * total


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check_packing(queries.op1_packing(spark, sf_dir).collect(), {r.doc_id: r.text for r in docs.collect()})
    odd = documents(spark).where("doc_id <> 3 or length = 'x'")
    check_packing(packing.pack(odd, public_tokenizers.path("word_bpe_49k.json")).collect(), {i: t for i, t in enumerate(ODD)})
    assert packing.pack(documents(spark).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_pack_lengths_fill():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 400, 500).tolist()
    windows = packing.pack_lengths(lengths, 100)
    assert sum(n for w in windows for *_, n in w) == sum(lengths)
    assert all(s == 100 or s & (s - 1) == 0 for s in (sum(n for *_, n in w) for w in windows))
    assert sum(packing.best_fill({7: 3, 5: 1}, 20)) == 19
    assert sum(packing.best_fill({7: 3, 5: 1}, 21)) == 21


def test_sstable_round_trip(spark, sf_dir):
    whole = reference("byte_bpe_50k.json")
    rows = sorted(queries.op9_sstable(spark, sf_dir).collect())
    start = 0
    for r, d in zip(rows, sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()), strict=True):
        ids = whole(d.text) + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (d.doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_sstable_lookup_and_odd_rows(spark):
    whole = reference("byte_bpe_50k.json")
    shards = sstable.write(documents(spark), lambda: library_encoder(public_tokenizers.path("byte_bpe_50k.json"), False, "<u2"), 2, shard_bytes=2000)
    assert shards.count() > 1
    rows = sstable.read(shards).collect()
    assert len(rows) == len(ODD) + 2
    keys = spark.createDataFrame([(0,), (3,), (None,), (99,), (-5,)], "doc_id long")
    got = sorted(((r.doc_id, r.ids) for r in sstable.lookup(shards, keys).collect()), key=str)
    want = [(i, whole(ODD[i]) + [2]) for i in (0, 3, 3)] + [(None, whole("no id") + [2])]
    assert got == sorted(want, key=str)
    empty = sstable.write(documents(spark).limit(0), lambda: library_encoder(public_tokenizers.path("byte_bpe_50k.json"), False, "<u2"), 2)
    assert sstable.read(empty).count() == 0


def test_sstable_groups_and_bloom_filter(spark, monkeypatch):
    monkeypatch.setattr(sstable, "GROUP", 2)
    rows = [(i // 3, "word " * (i % 7)) for i in range(300)]
    shards = sstable.write(spark.createDataFrame(rows, "doc_id long, text string"), lambda: library_encoder(public_tokenizers.path("byte_bpe_50k.json"), False, "<u2"), 2, shard_bytes=300)
    assert shards.count() > 6
    at = {}
    for r in sorted(sstable.read(shards).collect(), key=lambda r: r.start):
        at.setdefault("next", 0)
        assert r.start == at["next"]
        at["next"] += r.n_tokens
    found = sstable.lookup(shards, spark.range(-5, 200).withColumnRenamed("id", "doc_id")).groupBy("doc_id").count().collect()
    assert sorted((r["doc_id"], r["count"]) for r in found) == [(i, 3) for i in range(100)]
    keys, bits = [sstable.key_of(i) for i in range(20_000)], 200_000
    held = {b for k in keys for b in sstable._bloom_at(k, bits, 7)}
    wrong = sum(all(b in held for b in sstable._bloom_at(sstable.key_of(i), bits, 7)) for i in range(-20_000, 0))
    assert wrong < 0.012 * 20_000
