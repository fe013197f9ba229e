"""The registered queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, jaccard_join, language_id, packing, prefix_trie, secret_scan, sstable, substring_dedup, url_filters, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited(_table(spark, sf_dir, "documents")).withColumn("edited_marks", fingerprints.marks(F.col("edited")))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprints.hashes(F.col("marks")).alias("own"),
        fingerprints.hashes(F.col("edited_marks")).alias("other"), "next_hashes",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.text_form(F.col("own")).alias("fingerprint"), fingerprints.text_form(F.col("other")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("other")).alias("near_edited"), fingerprints.likeness(F.col("own"), F.col("next_hashes")).alias("near_next"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages).select("page_id", "judged.*")


OP3_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
hosts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parsed),
rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT h.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM hosts h JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, f.rule,
       coalesce(f.verdict, CASE WHEN regexp_matches(h.host, '^(.*\\.)?ads[-.]') OR regexp_matches(h.host, '\\btrack(er|ing)?\\b')
                                  OR regexp_matches(h.path, '^/([^/]+/)*banner/') THEN 'block' ELSE 'allow' END) AS verdict
FROM hosts h LEFT JOIN fits f USING (page_id)"""


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(_table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where(F.col("id") % 20 == 0))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(sstable.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeats of what other documents have first, and the spans of its own that went."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", F.col("kept_text").alias("text"), F.size("removed").alias("n_removed"), "removed")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    predicted = language_id.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "language.*")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, decoded="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits an archive of all pages (1000 ids a file), written as WARC files and read back, against a replica derived from
    the table: the first letter of every 97th page's html is another, and files whose number leaves 3 by 7 have lost their
    last 100 ids. A row for each record that differs in content or place."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    file = F.floor(F.col("page_id") / 1000)
    rotten = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html"))
    lost = F.coalesce((file % 7 == 3) & (F.col("page_id") % 1000 >= 900), F.lit(False))
    replica, counts = pages.withColumn("html", rotten).where(~lost), warc.volumes(pages, file)
    return warc.audit(warc.read(warc.write(pages, file, counts)), warc.leaves(replica, file, counts)).drop("volume")


OP10_SQL = """
WITH record AS (
  SELECT page_id, page_id // 1000 AS file,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
         coalesce(html, '') AS body, CASE WHEN page_id % 97 = 5 THEN '#' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS rotten
  FROM pages),
bytes AS (
  SELECT page_id, file, head || octet_length(encode(body)) || repeat(chr(13) || chr(10), 2) || body || repeat(chr(13) || chr(10), 2) AS l,
         CASE WHEN file % 7 = 3 AND page_id % 1000 >= 900 THEN NULL
              ELSE head || octet_length(encode(rotten)) || repeat(chr(13) || chr(10), 2) || rotten || repeat(chr(13) || chr(10), 2) END AS r
  FROM record),
hashed AS (
  SELECT page_id, file, octet_length(encode(l)) AS llen, octet_length(encode(r)) AS rlen, sha256(l) AS lsha, sha256(r) AS rsha FROM bytes),
placed AS (
  SELECT *, coalesce(sum(llen) OVER before, 0)::BIGINT AS loff, coalesce(sum(rlen) OVER before, 0)::BIGINT AS roff FROM hashed
  WINDOW before AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file, page_id, loff AS "offset", llen::BIGINT AS length, sha256(loff || ':' || llen || ':' || lsha) AS digest,
       CASE WHEN rsha IS NOT NULL THEN roff END AS right_offset, rlen::BIGINT AS right_length, CASE WHEN rsha IS NOT NULL THEN sha256(roff || ':' || rlen || ':' || rsha) END AS right_digest
FROM placed WHERE rsha IS NULL OR loff <> roff OR llen <> rlen OR lsha <> rsha"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(whitening.usable(_table(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.turns(_table(spark, sf_dir, "conversations"))
    found = prefix_trie.trie(prefix_trie.paths(prefix_trie.rebuilt(own)))
    return found.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


OP12_SQL = """
WITH own AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (  -- crc32 bit by bit: a byte is mixed in, then eight shifts (-1)
  SELECT DISTINCT conv, list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(conv::VARCHAR) + 1), lambda k: [ord(substr(conv::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS bits FROM own),
h AS (
  SELECT conv, conv - conv % 20 AS base,
         xor(list_reduce(bits, lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 4 AS h FROM steps),
rebuilt AS (
  SELECT h.conv, 0 AS part, o.j, o.said, o.words FROM h JOIN own o ON o.conv = h.base AND o.j <= h.h
  UNION ALL SELECT h.conv, 1, o.j, o.said, o.words FROM h JOIN own o ON o.conv = h.conv AND o.j > h.h),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY part, j) AS depth FROM rebuilt),
paths AS (
  SELECT conv, depth, md5(list(said) OVER (PARTITION BY conv ORDER BY depth)::VARCHAR) AS key, words FROM numbered
  UNION ALL SELECT conv, 0, '', 0 FROM h),
up AS (
  SELECT *, lag(key) OVER (PARTITION BY conv ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv) AS ends FROM paths),
nodes AS (
  SELECT key, min(conv) AS conv, min(depth) AS depth, count(*) AS n_convs, min(parent) AS parent, (count(*) - 1) * min(words) AS own,
         sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '')) AS ends FROM up GROUP BY key),
fan AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
totals AS (
  SELECT p.key, sum(n.own) AS saved, count(*) FILTER (f.key IS NULL) AS leaves
  FROM nodes n LEFT JOIN fan f ON f.key = n.key JOIN paths p ON p.conv = n.conv AND p.depth <= n.depth GROUP BY p.key)
SELECT n.conv AS conv_id, n.depth, u.conv AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN totals t USING (key) LEFT JOIN fan f USING (key) LEFT JOIN nodes u ON u.key = n.parent"""


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.listed(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_fingerprints, op3_url_filters, op4_jaccard_join, op5_substring_dedup, op6_language_id, op7_bpe, op8_ann, op9_sstable, op10_warc, op11_whitening, op12_prefix_trie, op13_secret_scan)
}
ORACLE_SQL: dict[str, str] = {"op3_url_filters": OP3_SQL, "op10_warc": OP10_SQL, "op12_prefix_trie": OP12_SQL}
