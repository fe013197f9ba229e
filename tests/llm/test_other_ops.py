"""op7, op8, op10 and the pipeline against tiktoken, exact search, SQL and the stages' own contracts."""

import hashlib
import io

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import ann, bpe, queries, warc

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "don't  stop\n\n now", "éü中文 \U0001f600", "a" * 5000, "ab" * 40, "\x00\x1c x", "12345 67", "=-=" * 60, "the" * 43, "xyzzy0123" * 300]


def test_bpe_equals_tiktoken(spark, sf_dir):
    code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(ODD)], "doc_id long, text string, ids binary").drop("ids")
    for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN, decoded="decoded").collect():
        want = code.encode_ordinary(r.text or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and bytes(r.decoded) == (r.text or "").encode()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_bpe(spark, sf_dir).collect():
        ids = np.array(code.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    again = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())


def exact(vectors, query, top):
    ids, x = np.array(list(vectors)), np.array(list(vectors.values()))
    score = x @ vectors[query]
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:top]
    return [int(ids[i]) for i in order]


def test_ann_recall(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{big}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}
    got = {}
    for r in sorted(queries.op8_ann(spark, big).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12
    assert set(got) == {i for i in vectors if i % 20 == 0} and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(v) & set(exact(vectors, q, 20))) / 20 for q, v in got.items()]) >= 0.9


def test_ann_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 2.0]), (7, None), (8, [0.0, 0.0]), (9, [nan, 1.0]), (10, [None, 1.0]), (11, [1.0]), (None, [1.0, 1.0]), (40, [-1.0, 0.5])]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in sorted(ann.search(vectors, vectors.where("id % 20 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == {0: [(1, 5, 1.0), (2, 20, 1.0), (3, 6, 0.0), (4, 40, -1.0)], 20: [(1, 0, 1.0), (2, 5, 1.0), (3, 6, 0.0), (4, 40, -1.0)], 40: [(1, 6, 1.0), (2, 0, -1.0), (3, 5, -1.0), (4, 20, -1.0)]}
    none = ann.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ann.search(none, none).count() == 0


def test_ann_graph_and_hot_vector(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(600, 8)).astype(np.float32)
    model = ann.Index(c, ann.graph_of(c, rng), 1.0, 0.1, 0.3, 3, 32)
    q = rng.normal(size=(50, 8)).astype(np.float32)
    ids, _ = model.nearest(q, 8)
    want = np.argsort(ann.distances(q, c), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids.tolist(), want.tolist())]) > 0.95
    hot = [(i, [1.0, 0.0, 0.0]) for i in range(3000)] + [(3000 + i, list(map(float, 0.1 * rng.normal(size=3)))) for i in range(500)]
    vectors = ann.usable(spark.createDataFrame(hot, "vec_id long, embedding array<double>"))
    found = ann.search(vectors, vectors.where("id in (100, 2900)"), list_rows=16, beam=16).where("score = 1.0").groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    assert {r.query_id: sorted(r.v) for r in found} == {100: list(range(20)), 2900: list(range(20))}


def test_warc_against_sql(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{big}/pages.parquet'")
    rows = queries.op10_warc(spark, big)
    columns = sorted(rows.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.ORACLE_SQL['op10_warc']})").fetchall()
    assert sorted(map(tuple, rows.select(*columns).collect()), key=str) == sorted(want, key=str) and want


def test_warc_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", "a", 0), (1, "u", "a", 0), (2, None, None, 0), (None, "v\r\nX: y", "", 0), *[(i, "w", "x", 0) for i in range(5, 60)]], "page_id long, url string, html string, digest int")
    for file in (F.lit(0), F.lit(None).cast("string")):
        counts = warc.volumes(pages, file, 10)
        left = warc.leaves(pages, file, counts)
        assert left.count() == 59 and left.select("volume").distinct().count() == 6
        files = warc.write(pages, file, counts)
        assert files.count() == 6 and sorted(map(tuple, warc.read(files).collect()), key=str) == sorted(map(tuple, left.collect()), key=str)
        assert warc.audit(warc.read(files), warc.leaves(pages.repartition(7), file, counts)).count() == 0
        assert warc.audit(left.limit(0), left.limit(0)).count() == 0
        bad = warc.leaves(pages.withColumn("html", F.when(F.col("page_id") == 33, "y").when(F.col("page_id").isNull(), "").otherwise(F.col("html"))), file, counts)
        assert [r.page_id for r in warc.audit(left, bad).collect()] == [33]
        lost = {r.page_id: r for r in warc.audit(left, warc.leaves(pages.where("page_id is null or page_id <> 20"), file, counts)).collect()}
        behind = {r.page_id for r in left.alias("a").join(left.where("page_id = 20").alias("b"), "volume").where("a.page_id > 20").select("a.page_id").collect()}
        assert set(lost) == behind | {20} and lost[20].right_digest is None
        assert all(lost[i].right_offset < lost[i].offset and lost[i].right_length == lost[i].length for i in behind)
        null = warc.audit(left, warc.leaves(pages.where("page_id is not null"), file, counts)).collect()
        assert [r.page_id for r in null if r.right_digest is None] == [None]
        twice = warc.audit(left, warc.leaves(pages.dropDuplicates(), file, counts)).collect()
        assert [r.page_id for r in twice if r.right_digest is None] == [1]


def test_warc_broken_file():
    raw = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(p, o, n) for p, o, n, _ in warc.parse(io.BytesIO(raw + raw))] == [(7, 0, len(raw)), (7, len(raw), len(raw))]
    assert [(p, o, n) for p, o, n, _ in warc.parse(io.BytesIO(raw + b"junk" + raw))] == [(7, 0, len(raw)), (None, len(raw), len(raw) + 4)]


def test_warc_resumes_behind_damage():
    one = lambda page, body, more=b"": b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (page, more, len(body), body)
    long = one(1, b"ab\ncd", b"WARC-Target-URI: " + b"x" * 5000 + b"\r\n")
    raw = long + b"WARC/1.1\r\nbroken\r\n" + one(2, b"") + b"\njunk\n" + one(3, b"WARC/1.1\r\n") + one(4, b"y")[:-3]
    for step in (64, 1 << 20):
        got = list(warc.parse(io.BytesIO(raw), step))
        assert [r[0] for r in got] == [1, None, 2, None, 3, 4] and [r[1] for r in got] == [sum(n for _, _, n, _ in got[:i]) for i in range(len(got))]
        assert sum(r[2] for r in got) == len(raw) and got[0][3] == hashlib.sha256(long).hexdigest()


def test_warc_null_file_and_long_url(spark):
    pages = spark.createDataFrame([(1, "u", "a", None), (2, "v" * 1_200_000, "b", None), (3, "w", "c", "null"), (4, "", "d", "a b/%"), (5, "", "e", "=null")], "page_id long, url string, html string, f string")
    counts = warc.volumes(pages, F.col("f"))
    files = warc.write(pages, F.col("f"), counts)
    assert files.select("path").distinct().count() == 4
    assert warc.audit(warc.read(files), warc.leaves(pages, F.col("f"), counts)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "packing"]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    groups = {r.doc_id: r.component_id for r in queries.op4_jaccard_join(spark, sf_dir).collect()}
    kept = {r.doc_id for r in rows}
    assert kept <= {i for i, c in groups.items() if i == c} and len(kept) > 0.9 * len(set(groups.values()))
    assert docs.count() > len(kept)


def test_pipeline_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "the words of this text are plain", "en", "s", 32), (2, "the words of this text are plain", "en", "s", 32), (None, "another text of plain words", "en", "s", 27), (9, "12 34", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        out = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == corpus_pipeline.COLUMNS
        assert sorted((r.doc_id or 0) for r in out.collect()) == ([] if empty else [0, 2])
