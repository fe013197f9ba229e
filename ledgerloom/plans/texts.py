"""Queries over documents, pages and conversations: evidence, extraction, data-loss scans (S, F, J17 to J20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, places, rules
from ..functions import text as T
from ..operators import documents
from ..operators import scans as scan_operators
from .base import LINES, PLACES, VEHICLES, Tables, pick, query, sql_list, sql_pick

C = F.col

#: Texts of documents with logistics references mixed in, so that the patterns meet something.
NOTES = (
    "HVDC-ADOPT-SCT-0{n} container TCLU4265791 BL NO: SELAB12345678", "BOE 20251234 paid AED 1,250.00 on 2025-03-14", "IBAN AE07 AED 99,999.00\nTotal AED 75.50", "MSKU1234565 TGHU 123456-7 gate pass",
    "Mail ops.team{n}@example.com or +971 50 123 4567", "contract rate: 12.50 approved by Lee", "HVDC_ADOPT_HE_0{n} delivery order no DOCHP12345678", "password: hunter2 margin: 12.5",
)


def noted(t: Tables) -> DataFrame:
    d = C("doc_id")
    note = F.replace(pick(NOTES, d), F.lit("{n}"), F.lpad((d % 997).cast("string"), 3, "0"))
    return t.documents.select("doc_id", F.concat(note, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"), F.concat(F.lit("HVDC-ADOPT-SCT-0"), F.lpad((d % 997).cast("string"), 3, "0"), F.lit(", 0200 note.md")).alias("file_name"))


NOTED = f"WITH noted AS (SELECT doc_id, replace({sql_list(NOTES)}[doc_id % 8 + 1], '{{n}}', lpad((doc_id % 997)::VARCHAR, 3, '0')) || chr(10) || coalesce(text, '') AS text, 'HVDC-ADOPT-SCT-0' || lpad((doc_id % 997)::VARCHAR, 3, '0') || ', 0200 note.md' AS file_name FROM documents)".replace("\\n", "\n").replace("AED 99,999.00\nTotal", "AED 99,999.00' || chr(10) || 'Total")


@query("s7_evidence_markdown", NOTED + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS span, unnest(range(len(string_split(text, chr(10))))) + 1 AS line_no FROM noted), f AS (SELECT doc_id, line_no, coalesce(" + ", ".join(f"nullif(regexp_extract(span, '{p}'), '')" for p in documents.REFERENCES) + ") AS reference FROM l), g AS (SELECT doc_id, line_no::INT AS line_no, reference, 0.85::DOUBLE AS confidence FROM f WHERE reference IS NOT NULL) SELECT * FROM g UNION ALL SELECT doc_id, 1, NULL, 0.2 FROM noted WHERE doc_id NOT IN (SELECT doc_id FROM g)")
def _(t: Tables) -> DataFrame:
    return documents.evidence_lines(noted(t), "doc_id", "text", 0.85, 0.2).drop("text_span")


@query("s8_evidence_text", NOTED + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS span FROM noted) SELECT doc_id, count(*) AS n FROM l WHERE coalesce(" + ", ".join(f"nullif(regexp_extract(span, '{p}'), '')" for p in documents.REFERENCES) + ") IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return documents.evidence_lines(noted(t), "doc_id", "text", 0.8).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("s9_page_confidence", "SELECT doc_id, least(1.0::DOUBLE, length(coalesce(text, '')) / 500.0::DOUBLE) AS confidence, CASE WHEN trim(coalesce(text, '')) = '' THEN 'SCANNED' ELSE 'TEXT' END AS kind, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, ceil(length(coalesce(text, '')) / 2000.0::DOUBLE)::BIGINT AS n_spans FROM documents")
def _(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.least(F.lit(1.0), F.char_length(text) / 500).alias("confidence"), F.when(F.trim(text) == "", "SCANNED").otherwise("TEXT").alias("kind"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.ceil(F.char_length(text) / 2000).alias("n_spans"))


PAGE_WORDS = 400


@query("s10_s11_json_evidence", NOTED + f""", w AS (SELECT doc_id, i, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws, unnest(generate_series(0, len(ws) // {PAGE_WORDS})) AS page FROM (SELECT doc_id, text, 0 AS i FROM noted)),
  p AS (SELECT doc_id, page, list_slice(ws, page * {PAGE_WORDS} + 1, page * {PAGE_WORDS} + {PAGE_WORDS}) AS own FROM w), x AS (SELECT doc_id, page, own, array_to_string(own, ' ') AS text FROM p)
  SELECT doc_id, page::INT AS page, len(own)::BIGINT AS n_words, round(round(list_sum(list_transform(own, lambda z: length(z) % 10)) / 10.0::DOUBLE / nullif(len(own), 0), 9), 4) AS confidence, sha256(text) AS text_sha256, ({" + ".join(f"least(20, len(regexp_extract_all(text, '{p}')))" for p in documents.REFERENCES)})::BIGINT AS n_references FROM x""")
def _(t: Tables) -> DataFrame:
    """Documents as the JSON of a recogniser, 400 words a page, parsed back into pages, confidences and evidence."""
    words = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    page = lambda i: F.struct(i.cast("int").alias("page"), F.transform(F.slice("ws", i * PAGE_WORDS + 1, F.lit(PAGE_WORDS)), lambda w: F.struct(w.alias("text"), (F.char_length(w) % 10 / 10).alias("confidence"))).alias("words"))
    paged = noted(t).select("doc_id", words.alias("ws")).select("doc_id", F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.floor(F.size("ws") / PAGE_WORDS).cast("int")), page).alias("pages"))).alias("json"))
    pages = documents.ocr_pages(paged, "doc_id", "json")
    return pages.select("doc_id", "page", "n_words", "confidence", F.sha2("text", 256).alias("text_sha256"), F.size("references").cast("long").alias("n_references"))


@query("s22_corpus_chunks", "WITH d AS (SELECT doc_id, '# Head' || (doc_id % 7) || chr(10) || coalesce(text, '') || chr(10) || '## Tail' || chr(10) || 'end' AS md FROM documents), c AS (SELECT doc_id, unnest(string_split(regexp_replace(md, '(^|\\n)(#{1,6} )', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS body FROM d) SELECT doc_id, trim(regexp_extract(body, '^#{1,6} ([^\\n]*)', 1)) AS heading, sha256(body) AS sha256 FROM c WHERE trim(body) <> ''")
def _(t: Tables) -> DataFrame:
    md = t.documents.select("doc_id", F.concat(F.lit("# Head"), (C("doc_id") % 7).cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## Tail\nend")).alias("md"))
    return documents.chunks(md, "doc_id", "md").select("doc_id", "heading", "sha256")


@query("f14_document_type", NOTED + ", u AS (SELECT doc_id, regexp_replace(upper(text), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g') AS x FROM noted), d AS (SELECT doc_id, CASE WHEN contains(x, 'GATE PASS') OR doc_id % 7 = 3 THEN 'BOE_CUSTOMS' WHEN contains(x, 'DELIVERY ORDER') OR doc_id % 7 = 5 THEN 'DELIVERY_ORDER' ELSE 'UNKNOWN' END AS doc_type FROM u) SELECT doc_id, doc_type, CASE doc_type WHEN 'BOE_CUSTOMS' THEN 95 WHEN 'DELIVERY_ORDER' THEN 92 ELSE 0 END AS confidence FROM d")
def _(t: Tables) -> DataFrame:
    """By text and file name: every seventh document's name is Arabic for customs declaration, every other seventh's a delivery order."""
    name = F.when(C("doc_id") % 7 == 3, "بيان  جمركي 7.pdf").when(C("doc_id") % 7 == 5, "delivery order.pdf").otherwise("scan.pdf")
    return noted(t).select("doc_id", T.document_type(C("text"), name).alias("d")).select("doc_id", "d.*")


@query("f15_f10_shipments", NOTED + ", m AS (SELECT doc_id, list_transform(regexp_extract_all(upper(text), 'HVDC[\\s\\-_/]*ADOPT[\\s\\-_/]*(?:SCT|HE)[\\s\\-_/]*\\d{4}'), lambda x: 'HVDC-ADOPT-' || regexp_extract(x, 'SCT|HE') || '-' || right(x, 4)) AS own, ['HVDC-ADOPT-SCT-0' || lpad((doc_id % 997)::VARCHAR, 3, '0'), 'HVDC-ADOPT-SCT-0200'] AS listed FROM noted) SELECT doc_id, array_to_string(list_sort(list_distinct(own || listed)), ',') AS refs FROM m")
def _(t: Tables) -> DataFrame:
    return noted(t).select("doc_id", F.array_join(F.array_sort(T.shipments(C("text"), C("file_name"))), ",").alias("refs"))


@query("f10_expand_references", "SELECT o_orderkey AS order_id, 'HVDC-' || lpad((o_orderkey % 100)::VARCHAR, 4, '0') || ',' || 'HVDC-' || lpad((o_custkey % 90 + 200)::VARCHAR, 4, '0') AS refs FROM orders")
def _(t: Tables) -> DataFrame:
    ref = F.concat(F.lit("HVDC-"), F.lpad((C("o_orderkey") % 100).cast("string"), 4, "0"), F.lit(", "), (C("o_custkey") % 90 + 200).cast("string"))
    return t.orders.select(C("o_orderkey").alias("order_id"), F.array_join(T.expand_reference(ref), ",").alias("refs"))


DIGITS = " + ".join(f"(CASE WHEN substr(c, {i + 1}, 1) BETWEEN 'A' AND 'Z' THEN {sql_list(T.CONTAINER_LETTERS.values()).replace(chr(39), '')}[ascii(substr(c, {i + 1}, 1)) - 64] ELSE try_cast(substr(c, {i + 1}, 1) AS INT) END) * {2**i}" for i in range(10))


@query("f16_f17_containers", NOTED + f", k AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(upper(text), '\\b[A-Z]{{3}}[UJZ]\\s?\\d{{6}}-?\\d\\b'), lambda x: regexp_replace(x, '[\\s\\-]', '', 'g'))) AS c FROM noted), v AS (SELECT doc_id, c, ({DIGITS}) % 11 % 10 = substr(c, 11, 1)::INT AS ok FROM k) SELECT doc_id, c AS container, ok AS valid FROM v QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY doc_id)")
def _(t: Tables) -> DataFrame:
    return noted(t).select("doc_id", F.explode(T.containers(C("text"))).alias("container")).withColumn("valid", T.container_valid(C("container")))


@query("f18_numbers_and_dates", NOTED + ", d AS (SELECT doc_id, regexp_extract_all(text, '\\b\\d{4}-\\d{2}-\\d{2}\\b') AS dates, regexp_extract_all(upper(text), '\\b(SELA[A-Z0-9]{8,})\\b') AS bl, regexp_extract_all(upper(text), '\\b(DOCHP\\d{8,})\\b') AS dn FROM noted) SELECT doc_id, dates[1] AS first_date, bl[1] AS bl_number, dn[1] AS do_number FROM d")
def _(t: Tables) -> DataFrame:
    first = lambda a: F.get(a, F.lit(0))
    return noted(t).select("doc_id", first(T.every(C("text"), r"\b\d{4}-\d{2}-\d{2}\b")).alias("first_date"), first(T.every(F.upper("text"), r"\b(SELA[A-Z0-9]{8,})\b", 1)).alias("bl_number"), first(T.every(F.upper("text"), r"\b(DOCHP\d{8,})\b", 1)).alias("do_number"))


@query("f19_amounts", NOTED + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM noted), a AS (SELECT doc_id, unnest(regexp_extract_all(x, '(?i)\\bAED\\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\\.\\d{2})?|[0-9]+(?:\\.\\d{2})?)\\b', 1)) AS v FROM l WHERE NOT regexp_matches(x, '(?i)IBAN|A/C|ACCOUNT|BANK|SWIFT|TRN|CLIENT\\s+NO|TAX\\s*(?:REGN|NUMBER)')) SELECT DISTINCT doc_id, replace(v, ',', '')::DOUBLE AS amount FROM a")
def _(t: Tables) -> DataFrame:
    return noted(t).select("doc_id", F.explode(T.amounts(C("text"))).alias("amount"))


@query("f30_mask_pii")
def _(t: Tables) -> DataFrame:
    """Masked texts by hash; the oracle has no replacement of one length by another, so tests hold all texts against re.sub."""
    return noted(t).select("doc_id", T.masked(C("text")).alias("m")).select("doc_id", F.sha2("m", 256).alias("masked_sha256"), F.char_length("m").alias("n_chars"))


@query("f31_dlp_scan", NOTED + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM noted), h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, len(regexp_extract_all(x, '{p}')) AS n FROM l" for k, p in T.DLP) + ") SELECT doc_id, type, sum(n)::BIGINT AS n FROM h WHERE n > 0 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return documents.dlp_findings(noted(t), "doc_id", "text").groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("f32_f33_dlp_guard", NOTED + ", h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS violation_type, list_slice(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'), 1, 5) AS m FROM noted" for k, p in T.GUARD) + ") SELECT doc_id, violation_type, len(m)::BIGINT AS n, array_to_string(list_transform(m, lambda x: CASE WHEN length(x) > 6 THEN left(x, 3) || '***' || right(x, 3) ELSE '***' END), ' ') AS snippets FROM h WHERE len(m) > 0")
def _(t: Tables) -> DataFrame:
    found = noted(t).select("doc_id", F.posexplode(T.guarded(C("text"))).alias("at", "v")).select("doc_id", "at", "v.*")
    return found.groupBy("doc_id", "violation_type").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "snippet"))), lambda x: x["snippet"]), " ").alias("snippets"))


@query("a27_f40_pii_by_source", "SELECT source, sum(len(regexp_extract_all(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b')))::BIGINT AS n_email, count(*) AS n_docs FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(dict(T.DLP)["EMAIL"]), F.lit(0)))).alias("n_email"), F.count("*").alias("n_docs"))


@query("f25_numeric_cleaners", "SELECT o_orderkey AS order_id, o_totalprice AS value, floor(o_totalprice)::DOUBLE AS first FROM orders")
def _(t: Tables) -> DataFrame:
    whole = F.floor("o_totalprice").cast("string")
    shown = F.concat(F.lit("AED "), C("o_totalprice").cast("decimal(18,2)").cast("string"))
    return t.orders.select(C("o_orderkey").alias("order_id"), numbers.number(shown).alias("value"), numbers.first_number(F.concat(F.lit("about "), whole, F.lit(" or 7"))).alias("first"))


@query("f26_dates", "SELECT o_orderkey AS order_id, CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def _(t: Tables) -> DataFrame:
    d, k = F.to_date("o_orderdate"), C("o_orderkey") % 6
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd-MMM-yyyy")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).when(k == 3, serial).when(k == 4, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00"))).otherwise("soon")
    return t.orders.select(C("o_orderkey").alias("order_id"), numbers.excel_date(shown).alias("day"))


@query("f27_f28_flags_and_cases", "SELECT p_partkey, ['O', NULL, 'x'][p_partkey % 3 + 1] AS raw, CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 2 THEN 'X' END AS value, ['ok', 'blank', 'warn'][p_partkey % 3 + 1] AS status, CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN 'CASE-' || p_partkey ELSE 'UNKNOWN' END AS case_id FROM part")
def _(t: Tables) -> DataFrame:
    p = C("p_partkey")
    raw = F.when(p % 3 == 0, "O").when(p % 3 == 2, "x")
    case = F.when(p % 4 == 0, F.concat(p.cast("string"), F.lit(".00"))).when(p % 4 == 1, F.concat(F.lit(" case / "), p.cast("string"), F.lit("!"))).otherwise(" -- ")
    return t.part.select("p_partkey", raw.alias("raw"), places.flag(raw).alias("f"), places.case_id(case).alias("case_id")).select("p_partkey", "raw", "f.*", "case_id")


@query("f29_hashes", "SELECT c_custkey, sha256(c_name) AS sha256, sha1(c_name) AS sha1, substr(sha256(c_name), 1, 16) AS short FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("sha256"), F.sha1("c_name").alias("sha1"), F.substring(F.sha2("c_name", 256), 1, 16).alias("short"))


@query("k2_formula_guard", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '''' || ['=', '+', '-', '@'][p_partkey // 4 % 4 + 1] || p_name ELSE p_name END AS cell FROM part")
def _(t: Tables) -> DataFrame:
    p = C("p_partkey")
    cell = F.when(p % 4 == 0, F.concat(pick(("=", "+", "-", "@"), F.expr("p_partkey div 4")), C("p_name"))).otherwise(C("p_name"))
    return t.part.select("p_partkey", rules.literal_text(cell).alias("cell"))


@query("f2_f3_f4_normal_forms", f"SELECT DISTINCT l_partkey % 10 AS i, {sql_list(['MUSSAFAH', 'M44 WAREHOUSE', 'MINA ZAYED PORT', 'JEBEL ALI PORT', 'AL MASAOOD (MOSB)', 'SHUWEIHAT SITE SITE', 'MIRFA SITE SITE', 'AL MARKAZ WAREHOUSE', 'ICAD 2', 'KHALIFA PORT'])}[l_partkey % 10 + 1] AS place, {sql_list(['FLATBED HAZMAT', 'FLATBED', 'LOWBED CICPA', '14 METER LB (BR)', '23 METER LB', '3 TON PU', '7 TON PU', 'OTHER', 'REEFER-TRUCK', 'LOWBED'])}[l_partkey % 10 + 1] AS vehicle FROM lineitem")
def _(t: Tables) -> DataFrame:
    i = C("l_partkey") % 10
    return t.lineitem.select(i.alias("i"), places.place(pick(PLACES, i)).alias("place"), places.vehicle(pick(VEHICLES, i)).alias("vehicle")).distinct()


NORMAL = ("MUSSAFAH", "M44 WAREHOUSE", "MINA ZAYED PORT", "JEBEL ALI PORT", "AL MASAOOD (MOSB)", "SHUWEIHAT SITE SITE", "MIRFA SITE SITE", "AL MARKAZ WAREHOUSE", "ICAD 2", "KHALIFA PORT")
WORDS_SQL = "list_distinct(list_transform(list_filter(string_split({p}, ' '), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{w}'" for w in sorted(places.STOPWORDS)) + ")), lambda x: translate(x, '()', '')))"


@query("f5_f6_f8_similarities", LINES + f", t AS (SELECT line_id, amount, standard_amount, {WORDS_SQL.format(p=sql_list(NORMAL) + '[part_id % 10 + 1]')} AS a, {WORDS_SQL.format(p=sql_list(NORMAL) + '[supp_id % 10 + 1]')} AS b FROM lines) SELECT line_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(a || b))) END AS similarity, CASE WHEN amount > 0 AND standard_amount > 0 THEN round(greatest(0, 1 - abs(amount - standard_amount) / standard_amount * 100 / 50), 9) ELSE 0.0::DOUBLE END AS closeness FROM t")
def _(t: Tables) -> DataFrame:
    words = lambda c: places.tokens(places.place(C(c)))
    pairs = t.lines().select("origin", "destination").distinct()
    pairs = pairs.withColumn("similarity", numbers.similarity_of_sets(words("origin"), words("destination")))
    return t.lines().join(pairs, ["origin", "destination"]).select("line_id", "similarity", F.round(numbers.rate_closeness(C("amount"), C("standard_amount")), 9).alias("closeness"))


@query("f1_f7_sequence_ratio")
def _(t: Tables) -> DataFrame:
    pairs = t.lines().select("origin", "destination").distinct()
    return pairs.select("origin", "destination", places.sequence_ratio(places.upper_ascii(places.nfkc(C("origin"))), places.upper_ascii(places.nfkc(C("destination")))).alias("ratio"))


@query("l1_first_elements", "SELECT doc_id, array_to_string(list_slice(string_split(coalesce(text, ''), ' '), 1, 8), ' ') AS head FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 8), " ").alias("head"))


@query("d1_u3_u4_u5_sets", "WITH s AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderstatus)) AS a, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY 1) SELECT k, array_to_string(a, ',') AS statuses, len(list_filter(['F', 'O', 'X'], lambda x: list_contains(a, x))) AS n_common, len(list_filter(['F', 'O', 'X'], lambda x: NOT list_contains(a, x))) AS n_missing, len(list_distinct(a || ['F', 'O', 'X'])) AS n_either FROM s")
def _(t: Tables) -> DataFrame:
    wanted = F.array(F.lit("F"), F.lit("O"), F.lit("X"))
    s = t.orders.groupBy(C("o_custkey").alias("k")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("a"))
    return s.select("k", F.array_join("a", ",").alias("statuses"), F.size(F.array_intersect(wanted, C("a"))).cast("long").alias("n_common"), F.size(F.array_except(wanted, C("a"))).cast("long").alias("n_missing"), F.size(F.array_union(C("a"), wanted)).cast("long").alias("n_either"))


CELL_PATTERNS = " UNION ALL ".join(f"SELECT doc_id, r, c, '{k}' AS category, unnest(" + (f"list_filter(regexp_extract_all(x, '{p}'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= 7)" if k == "PHONE" else f"regexp_extract_all(x, '{p}')") + ") AS m FROM cells" for k, p in T.DLP)


@query("f32_cell_scan", NOTED + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS r FROM noted), cells AS (SELECT doc_id, r, unnest(string_split(line, '. ')) AS x, unnest(range(len(string_split(line, '. ')))) AS c FROM l), h AS (" + CELL_PATTERNS + ") SELECT doc_id::VARCHAR AS path, r::BIGINT AS \"row\", c::BIGINT AS col, category, count(*) AS n FROM h WHERE m <> '' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Documents as grids of cells, a row for each line, a column for each sentence."""
    rows = noted(t).select(C("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("row", "line"))
    grid = rows.select("path", F.lit("s").alias("sheet"), C("row").cast("long").alias("row"), F.posexplode(F.split("line", r"\. ")).alias("col", "text")).withColumn("col", C("col").cast("long"))
    return scan_operators.cells(grid).groupBy("path", "row", "col", "category").agg(F.count("*").alias("n"))


PLANTS = ("Rate_USD: 123.5", "[REDACTED] Rate_USD: 55", "box MSCU1234567 or TCLU7654321", "you@example.com, then real.name@corp.example.org", "approved by: nobody in particular", "code 1234567890123 and 900101-1234567", "nothing")


@query("f35_repository_scan")
def _(t: Tables) -> DataFrame:
    """Documents as files of a repository, with what is private, masked or a placeholder in their first line."""
    k = C("doc_id")
    path = F.concat(F.when(k % 9 == 0, "pkg/tests/").otherwise("src/"), k.cast("string"), pick((".md", ".json", ".pdf", ".PY"), k))
    return scan_operators.repository(t.documents.select(path.alias("path"), F.concat(pick(PLANTS, k), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")), ("tests",))


@query("s11_recogniser_answers", NOTED + ", h AS (SELECT doc_id, left(text, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM noted), f AS (SELECT doc_id, CASE WHEN a <> '' AND b <> '' THEN a || chr(10) || b ELSE a || b END AS t FROM h) SELECT doc_id, 2 AS page_count, sha256(t) AS text_sha256, CASE doc_id % 3 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, length(t) / 500.0::DOUBLE) END AS confidence FROM f")
def _(t: Tables) -> DataFrame:
    """Documents in two pages as a recogniser answers: annotated responses with confidences, plain pages with and without them."""
    half, text = F.floor(F.char_length("text") / 2).cast("int"), C("text")
    parts = (F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text)))
    plain = lambda sure: F.to_json(F.struct(F.array(*[F.struct(p.alias("text"), c.alias("confidence")) for p, c in zip(parts, sure)]).alias("pages")))
    word = lambda x: F.struct(F.lit(x).alias("confidence"))
    page = lambda *c: F.struct(F.lit(None).cast("double").alias("confidence"), F.array(F.struct(F.array(F.struct(F.array(*map(word, c)).alias("words"))).alias("paragraphs"))).alias("blocks"))
    noted_page = lambda p, *c: F.struct(F.struct(p.alias("text"), F.array(page(*c)).alias("pages")).alias("fullTextAnnotation"))
    rich = F.to_json(F.struct(F.array(noted_page(parts[0], 0.5, 1.0), noted_page(parts[1], 0.75)).alias("responses")))
    none = F.lit(None).cast("double")
    said = F.when(C("doc_id") % 3 == 0, rich).when(C("doc_id") % 3 == 1, plain((F.lit(0.25), F.lit(0.75)))).otherwise(plain((none, none)))
    found = documents.recognised(noted(t).select("doc_id", said.alias("j")), "doc_id", "j")
    return found.select("doc_id", "page_count", F.sha2("full_text", 256).alias("text_sha256"), "confidence")


@query("s10_parsed_documents", NOTED + " SELECT doc_id, 1 AS page_count, len(string_split(text, chr(10)))::BIGINT - len([x FOR x IN string_split(text, chr(10)) IF x = '']) AS n_spans, round(0.5::DOUBLE * (doc_id % 4) / 2, 3) AS confidence, 0.75::DOUBLE AS table_confidence FROM noted")
def _(t: Tables) -> DataFrame:
    """Documents as parsed pages: a span for each line, their confidences as given, and a table with a blank cell."""
    sure = (C("doc_id") % 4).cast("double") * 0.25
    spans = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), sure.alias("confidence")))
    table = F.struct(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(""), F.lit("d"))).alias("rows"))
    json = F.to_json(F.struct(F.array(F.struct(spans.alias("spans"), F.array(table).alias("tables"))).alias("pages")))
    found = documents.parsed_json(noted(t).select("doc_id", json.alias("j")), "doc_id", "j")
    return found.select("doc_id", "page_count", F.size("spans").cast("long").alias("n_spans"), "confidence", F.get("tables", F.lit(0))["confidence"].alias("table_confidence"))
