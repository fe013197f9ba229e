"""Scans that need more than a matched text: positions, what stands before a match, balanced braces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Categories of the repository scan with their patterns, in order.
PRIVATE = (
    ("rate_usd_raw", (r"(?i)\bRate_USD\s*[=:]\s*\d{2,}(?:\.\d+)?", r"(?i)\bRate_AED\s*[=:]\s*\d{2,}(?:\.\d+)?")),
    ("trn", (r"(?i)\bTRN[_\s-]*[:=]?\s*['\"]?\d{15}\b",)),
    ("boe", (r"(?i)\bBOE[_-][:#]?\s*\d{4,}[A-Z0-9]{0,6}\b",)),
    ("bl_number", (r"(?i)\b(?:DSV|SAMSUNG|SCNT)[-_]?BL[_-]?\d{4,12}\b", r"(?i)\bBL[_-]?(?:NO|NUMBER|#)[_\s:=-]*\d{4,}[A-Z0-9]{0,4}\b")),
    ("container_no", (r"\b[A-Z]{4}\d{7}\b",)),
    ("voyage_ref", (r"(?i)\bVOY[_-](?:NO|NUMBER|#)?[_\s:=-]*[A-Z0-9]{4,10}\b",)),
    ("email", (r"\b[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}\b",)),
    ("phone", (r"(?:\+971|\+82|\+1|\+44)[\s-]?\d{1,4}[\s-]?\d{2,4}[\s-]?\d{2,6}", r"\b05\d{1}-?\d{3,4}-?\d{4}\b")),
    ("pii", (r"\b\d{6}-?\d{7}\b", r"\b\d{3}-\d{2}-\d{4}\b", r"\b[A-Z]\d{8}\b")),
    ("api_key", (r"\bsk-[A-Za-z0-9]{20,}", r"\bAKIA[0-9A-Z]{16}", r"\bghp_[A-Za-z0-9]{30,}", r"\bxox[abp]-[A-Za-z0-9-]{20,}")),
    ("approval_text", (r"(?im)^\s*(approved\s*by|signature|signed)[\s:][^\n]{2,80}$",)),
    ("amount_internal", (r"(?im)\b(raw_?amount|raw_?rate|internal_?amount)\s*[=:]\s*\d",)),
    ("fx_policy_violation", (r"(?i)\bKRW\b(?=.*USD)",)),
    ("sensitive_path", (r'"/private/[^"]+\.(?:pdf|xlsx)\b',)),
)
# Marks of what has been masked, and addresses and containers that stand for any.
MASKS = ("[REDACTED", "**[REDACTED", "[PRIVATE]", "sha256:", "FILE_HASH_", "VENDOR_HASH_", "INVOICE_HASH_", "RATE_BAND_", "RATE_BAND:")
ANYONE = ("xxx@yyy.com", "you@example.com", "user@example.com", "test@example.com", "admin@example.com", "noreply@example.com", "name@example.com", "name@domain.com", "email@example.com", "first.last@example.com")
ANY_BOX = re.compile(r"[A-Z]{4}(0+|1234567|9999999)")
BEFORE, BEHIND, SHOWN = 32, 4, 60
SUFFIXES = ("md", "json", "csv", "txt", "yaml", "yml", "toml", "py", "sh", "ts", "tsx", "js", "mjs")

HITS = T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("pattern", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("line_no", T.LongType()), T.StructField("match", T.StringType())]))
_compiled: list[tuple[str, int, re.Pattern]] = []


def patterns() -> list[tuple[str, int, re.Pattern]]:
    if not _compiled:
        flat = [(label, p) for label, own in PRIVATE for p in own]
        _compiled.extend((label, n, re.compile(p)) for n, (label, p) in enumerate(flat))
    return _compiled


def accepted(label: str, text: str, m: re.Match) -> bool:
    """Whether a match counts: nothing masked just before or behind it, no placeholder."""
    around, found = text[max(0, m.start() - BEFORE) : m.end() + BEHIND], m[0][:SHOWN]
    if any(x in around for x in MASKS):
        return False
    if label == "email":
        return found.lower() not in ANYONE
    if label == "container_no":
        return not ANY_BOX.fullmatch(found)
    return not (label == "pii" and found.isdigit() and len(found) == 13)


def private_hits(text: str | None) -> list[tuple]:
    """(category, pattern, start, end, line_no, match): the first accepted match of each pattern."""
    out = []
    for label, n, pattern in patterns():
        m = next((m for m in pattern.finditer(text or "") if accepted(label, text, m)), None)
        if m:
            out.append((label, n, m.start(), m.end(), text.count("\n", 0, m.start()) + 1, m[0][:SHOWN]))
    return out


@F.pandas_udf(HITS)
def repository_hits(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("category", "pattern", "start", "end", "line_no", "match"), h)) for h in private_hits(t)] for t in texts])


MARKS = re.compile(r'["\\{}]')


def objects(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of the balanced objects that are in no other: depth counts braces outside strings, and a string, which only counts inside
    an object, ends at a quote that no backslash escapes. One pass over quotes, backslashes and braces; an object that never ends
    hides what follows its first brace."""
    depth, start, string, skip = 0, -1, False, -1
    for m in MARKS.finditer(text or ""):
        at, c = m.start(), m[0]
        if at == skip or not depth and c != "{":
            continue
        if string:
            if c == "\\":
                skip = at + 1
            elif c == '"':
                string = False
        elif c == '"':
            string = True
        elif c == "{":
            start = at if not depth else start
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                yield start, at + 1


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(texts: pd.Series) -> pd.Series:
    """All balanced objects of a text, in order."""
    return pd.Series([[t[s:e] for s, e in objects(t)] for t in texts])


def first_json(text: Column) -> Column:
    """The first balanced object of a text, without marks of generated text and code fences; null if it has none."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)\[AI[-_]GENERATED\]", ""), r"(?s)```(?:json)?\s*(.*?)```", "$1")
    return F.get(json_objects(plain), F.lit(0))
