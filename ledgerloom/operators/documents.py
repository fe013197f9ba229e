"""Evidence and findings from tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Reference patterns of evidence lines, in order of preference.
REFERENCES = (r"(?i)\bHVDC[-\s]?[A-Z0-9\-]{4,20}", r"(?i)\bBOE[-\s]?\d{4,}", r"(?i)\bBL[-\s]?[A-Z0-9]{6,}", r"(?i)\bPO[-\s]?\d{4,}", r"(?i)\bINV[-\s]?\d{3,}")


def evidence_lines(docs: DataFrame, key: str, text: str, confidence: float, fallback: float | None = None) -> DataFrame:
    """(key, line_no, text_span, reference, confidence): each line's first matching reference; a text without any gives one
    row with the fallback confidence, if there is one."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "span"))
    reference = F.coalesce(*[F.nullif(F.regexp_extract("span", p, 0), F.lit("")) for p in REFERENCES])
    found = lines.select(key, (F.col("at") + 1).alias("line_no"), F.substring("span", 1, 200).alias("text_span"), reference.alias("reference"), F.lit(confidence).alias("confidence")).where("reference is not null")
    if fallback is None:
        return found
    rest = docs.join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(rest.select(key, F.lit(1).alias("line_no"), F.substring(F.col(text), 1, 200).alias("text_span"), F.lit(None).cast("string").alias("reference"), F.lit(fallback).alias("confidence")))


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_no, heading, body, sha256) of a markdown text cut before each heading line."""
    cut = docs.select(key, F.posexplode(F.split(text, r"(?md)(?=^#{1,6} )")).alias("chunk_no", "body")).where(F.trim("body") != "")
    return cut.select(key, "chunk_no", F.trim(F.regexp_extract("body", r"^#{1,6} ([^\n]*)", 1)).alias("heading"), "body", F.sha2("body", 256).alias("sha256"))


OCR = "pages array<struct<page: int, words: array<struct<text: string, confidence: double>>>>"


def ocr_pages(docs: DataFrame, key: str, json: str, most: int = 20) -> DataFrame:
    """(key, page, text, n_words, confidence, references) of each page of recognised documents given as JSON: words joined by
    spaces, their mean confidence (4 digits, null without words), and the first `most` references of each pattern. What is no
    such JSON has no pages."""
    pages = docs.select(key, F.explode(F.from_json(json, OCR)["pages"]).alias("p"))
    words = pages.select(key, F.col("p.page").alias("page"), F.coalesce("p.words", F.array().cast("array<struct<text:string,confidence:double>>")).alias("w"))
    text = F.array_join(F.transform("w", lambda w: w["text"]), " ")
    mean = F.round(F.round(F.aggregate("w", F.lit(0.0), lambda a, w: a + w["confidence"]) / F.nullif(F.size("w"), F.lit(0)), 9), 4)
    found = F.flatten(F.array(*[F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, most) for p in REFERENCES]))
    return words.select(key, "page", text.alias("text"), F.size("w").cast("long").alias("n_words"), mean.alias("confidence"), found.alias("references"))


WORD = "array<struct<words: array<struct<confidence: double>>>>"
PAGE = f"struct<fullTextAnnotation: struct<text: string, pages: array<struct<confidence: double, blocks: array<struct<paragraphs: {WORD}>>>>>, text: string, confidence: double>"
ANSWER = f"responses array<{PAGE}>, pages array<{PAGE}>"
PARSED = "pages array<struct<page_number: int, spans: array<struct<text: string, bbox: array<double>, confidence: double>>, tables: array<struct<rows: array<array<string>>>>>>"


def recognised(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, page_count, full_text, confidence, issues) of recognisers' answers: pages under `responses` or else `pages`, their texts joined by
    line breaks, the mean confidence of all words and pages; without any, a 500th of the text's length, at most 1; without text 0. A word without
    confidence has 0. What is no such JSON has no pages."""
    given = F.from_json(json, ANSWER)
    pages = F.coalesce(F.when(F.size(given["responses"]) > 0, given["responses"]), given["pages"], F.array().cast(f"array<{PAGE}>"))
    rows = docs.select(key, pages.alias("p"))
    text = F.filter(F.transform("p", lambda p: F.when(p["fullTextAnnotation"].isNotNull(), p["fullTextAnnotation"]["text"]).otherwise(p["text"])), lambda t: t != "")
    none = F.array().cast("array<double>")

    def of_page(p: Column) -> Column:
        words = F.flatten(F.transform(F.coalesce(p["blocks"], F.array().cast(f"array<struct<paragraphs:{WORD}>>")), lambda b: F.flatten(F.transform(F.coalesce(b["paragraphs"], F.array().cast(WORD)), lambda g: F.transform(F.coalesce(g["words"], F.array().cast("array<struct<confidence:double>>")), lambda w: F.coalesce(w["confidence"], F.lit(0.0)))))))
        return F.concat(words, F.when(p["confidence"].isNotNull(), F.array(p["confidence"])).otherwise(none))

    def known(p: Column) -> Column:
        inner = F.coalesce(p["fullTextAnnotation"]["pages"], F.array().cast(f"array<struct<confidence:double,blocks:array<struct<paragraphs:{WORD}>>>>"))
        return F.when(p["fullTextAnnotation"].isNotNull(), F.flatten(F.transform(inner, of_page))).when(p["confidence"].isNotNull(), F.array(p["confidence"])).otherwise(none)

    rows = rows.select(key, F.size("p").alias("page_count"), F.array_join(text, "\n").alias("full_text"), F.flatten(F.transform("p", known)).alias("c"))
    mean = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / F.size("c")
    unsure = (F.size("c") == 0) & (F.col("full_text") == "")
    confidence = F.when(F.size("c") > 0, mean).when(unsure, 0.0).otherwise(F.least(F.lit(1.0), F.char_length("full_text") / 500))
    issues = F.array_compact(F.array(F.when(unsure, "VISION_LOW_CONFIDENCE"), F.when(F.trim("full_text") == "", "SCANNED_PAGE_DETECTED")))
    return rows.select(key, "page_count", "full_text", confidence.alias("confidence"), issues.alias("issues"))


def parsed_json(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, page_count, spans, tables, confidence, issues) of parsed documents: spans (page, text up to 2000, bbox of four, confidence between 0 and 1, 0.5
    where it is missing or no number), tables (page, up to 40 rows, share of filled cells), the mean over pages with text of the mean
    confidence of all their spans as it is given, 0 where it is missing. A page without a number above 0 has its place. What is no JSON is an issue."""
    given = docs.select(key, F.from_json(json, PARSED)["pages"].alias("p"), F.get_json_object(json, "$").isNotNull().alias("ok"))
    pages = F.coalesce("p", F.array().cast("array<" + PARSED.split("array<", 1)[1]))
    number = lambda p, i: F.when(p["page_number"] >= 1, p["page_number"]).otherwise(i + 1)
    sure = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))
    said = lambda p: F.filter(F.coalesce(p["spans"], F.array().cast("array<struct<text:string,bbox:array<double>,confidence:double>>")), lambda s: s["text"] != "")
    span = lambda p, i: F.transform(said(p), lambda s: F.struct(number(p, i).alias("page"), F.substring(s["text"], 1, 2000).alias("text"), F.when(F.size(s["bbox"]) == 4, s["bbox"]).alias("bbox"), F.round(sure(s["confidence"]), 3).alias("confidence")))
    cells = lambda t: F.flatten(t["rows"])
    full = lambda p: F.filter(F.coalesce(p["tables"], F.array().cast("array<struct<rows:array<array<string>>>>")), lambda t: F.size(t["rows"]) > 0)
    share = lambda t: F.coalesce(F.size(F.filter(cells(t), lambda c: F.coalesce(c, F.lit("")) != "")) / F.nullif(F.size(cells(t)), F.lit(0)), F.lit(0.6))
    table = lambda p, i: F.transform(full(p), lambda t: F.struct(number(p, i).alias("page"), F.slice(t["rows"], 1, 40).alias("rows"), F.round(share(t), 3).alias("confidence")))
    rows = given.select(key, "ok", pages.alias("p")).select(key, "ok", F.size("p").alias("page_count"), F.flatten(F.transform("p", span)).alias("spans"), F.flatten(F.transform("p", table)).alias("tables"), F.transform(F.filter("p", lambda p: F.size(said(p)) > 0), lambda p: F.transform(p["spans"], lambda s: F.coalesce(s["confidence"], F.lit(0.0)))).alias("c"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)
    confidence = F.when(F.size("c") > 0, F.round(mean(F.transform("c", lambda a: F.round(mean(a), 3))), 3)).otherwise(0.0)
    issue = F.when(~F.col("ok"), "PDF_JSON_PARSE_FAILED").when(F.size("spans") == 0, "SCANNED_PAGE_DETECTED")
    return rows.select(key, "page_count", "spans", "tables", confidence.alias("confidence"), F.array_compact(F.array(issue)).alias("issues"))


def dlp_findings(docs: DataFrame, key: str, text: str, patterns=T.DLP, most: int | None = None) -> DataFrame:
    """(key, type, line_no, masked) of all matches of all patterns, at most `most` by text and pattern where that is the rule.

    Lines are exploded once and patterns are tried on them in one projection, those of the library only where the line has what
    they need.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))

    def hits_of(i: int, kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("type"), F.lit(i).alias("pattern"), T.snippet(m).alias("masked")))

    hits = [hits_of(i, kind, p) for i, (kind, p) in enumerate(patterns)]
    if patterns is T.DLP:
        none = F.array().cast("array<struct<type:string,pattern:int,masked:string>>")
        only = lambda places: F.flatten(F.array(*[hits[i] for i in sorted(places)]))
        rest = set(range(len(hits))) - T.DIGITS - T.ALWAYS
        hits = [F.when(F.col("line").rlike("[0-9]"), only(T.DIGITS)).otherwise(none), only(T.ALWAYS), F.when(F.col("line").rlike(T.SIGNS), only(rest)).otherwise(none)]
    found = lines.select(key, (F.col("at") + 1).alias("line_no"), F.explode(F.flatten(F.array(*hits))).alias("h")).select(key, "line_no", "h.*")
    if most is None:
        return found.drop("pattern")
    from .lookup import first_rows

    return first_rows(found, [key, "pattern"], [F.col("line_no"), F.col("masked")], most).drop("pattern", "place")
