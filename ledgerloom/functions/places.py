"""Normal forms of places, vehicles and units, tokens of places, and text similarity of places."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Synonyms of places, in order, and words that say nothing about one.
SYNONYMS = (
    (r"\bMUSS?AFAH\b", "MUSSAFAH"), (r"\bMUSAFFAH\b", "MUSSAFAH"), (r"\bI\.?\s*C\.?\s*A\.?\s*D\.?\b", "ICAD"), (r"\bMINA\s+ZAYED\s+FREE\s*PORT\b", "MINA ZAYED PORT"),
    (r"\bJDN\s+MINA\s+ZAYED\b", "MINA ZAYED PORT"), (r"\bMINA\s+ZAYED\b", "MINA ZAYED PORT"), (r"\bJEBEL\s+ALI\b", "JEBEL ALI PORT"), (r"\bSHUWEIHAT\s+POWER\s+STATION\b", "SHUWEIHAT SITE"),
    (r"\bSHUWEIHAT\b", "SHUWEIHAT SITE"), (r"\bMIRFA\s+PMO\s+SAMSUNG\b", "MIRFA SITE"), (r"\bMIRFA\b", "MIRFA SITE"), (r"\bMIR\b", "MIRFA SITE"), (r"\bSHU\b", "SHUWEIHAT SITE"), (r"\bMOSB\b", "AL MASAOOD (MOSB)"),
)
STOPWORDS = ("THE", "OF", "AND", "&", "YARD", "WH", "WAREHOUSE", "STATION", "POWER", "PLANT", "PROJECT", "SAMSUNG", "DSV", "LLC", "FZE", "PJSC", "ROAD", "RD", "ST", "STREET", "AREA", "ZONE", "ABU", "DHABI")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; equal pairs of a batch are computed once."""
    known: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = difflib.SequenceMatcher(None, pair[0] or "", pair[1] or "").ratio()
        out.append(known[pair])
    return pd.Series(out)


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence: a column of its table at a time, as bits of one whole number."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for c in y:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(x) - v.bit_count()


def indel(x: str, y: str) -> float:
    """100 * 2 * LCS / (len(x) + len(y))."""
    return 200.0 * common_length(x, y) / (len(x) + len(y)) if x or y else 100.0


class IdTable:
    """indel() of one text against many at once: columns of characters, and a machine word of bits for each text."""

    def __init__(self, texts: list[str], longest: int = 256):
        self.texts, self.sizes = texts, np.array([len(t) for t in texts], dtype=np.int64)
        self.long = np.flatnonzero(self.sizes > longest)  # these are compared one by one
        short = np.where(self.sizes > longest, 0, self.sizes)
        letters = sorted(set("".join(t for t in texts if len(t) <= longest)))
        self.place = {c: i + 1 for i, c in enumerate(letters)}  # 0 stands for no character
        self.codes = np.zeros((int(short.max(initial=0)), len(texts)), dtype=np.int32)
        for j, t in enumerate(texts):
            if short[j]:
                self.codes[: len(t), j] = [self.place[c] for c in t]

    def ratios(self, x: str) -> np.ndarray:
        if len(x) > 62:
            return np.array([indel(x, t) for t in self.texts])
        masks = np.zeros(len(self.place) + 1, dtype=np.uint64)
        for i, c in enumerate(x):
            if c in self.place:
                masks[self.place[c]] |= np.uint64(1 << i)
        full = np.uint64((1 << len(x)) - 1)
        v = np.full(len(self.texts), full, dtype=np.uint64)
        for row in self.codes:
            u = v & masks[row]
            v = (v + u | v - u) & full
        common = len(x) - np.bitwise_count(v).astype(np.int64)
        total = len(x) + self.sizes
        out = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)
        for j in self.long:
            out[j] = indel(x, self.texts[j])
        return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel() of each pair; null counts as empty."""
    return pd.Series([indel(x or "", y or "") for x, y in zip(a, b)])


def upper_ascii(text: Column) -> Column:
    """Upper case, white space collapsed (no-break space included)."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s ]+", " ")))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(upper_ascii(text), F.lit("&"), F.lit(" AND ")), r"[^A-Z0-9\s\-()]", " "), r"\s+", " "))


def place(text: Column) -> Column:
    out = clean(text)
    for pattern, replacement in SYNONYMS:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return (
        F.when(out.contains("MOSB") | out.contains("MASAOOD"), "AL MASAOOD (MOSB)").when(out.contains("MARKAZ"), "AL MARKAZ WAREHOUSE").when(out.rlike(r"\bM44\b"), "M44 WAREHOUSE")
        .when(out.contains("MINA") & out.contains("ZAYED"), "MINA ZAYED PORT").when(out.contains("JEBEL") & out.contains("ALI"), "JEBEL ALI PORT").otherwise(out)
    )


def unit(text: Column) -> Column:
    u = F.regexp_replace(F.regexp_replace(upper_ascii(text), "PERTRUCK", "PER TRUCK"), "PERTRIP", "PER TRUCK")
    return F.when((u == "") | u.contains("TRUCK") | u.contains("TRIP"), "PER TRUCK").when(u.rlike(r"\bRT\b"), "PER RT").otherwise(u)


def vehicle(text: Column) -> Column:
    v = upper_ascii(text)
    low = v.contains("LB") | v.contains("LOWBED")

    def long(n: str) -> Column:
        return v.contains(n) & (v.contains("METER") | v.contains("MTR") | v.rlike(rf"\b{n}M\b")) & low

    base = (
        F.when(long("23"), "23 METER LB").when(long("14"), "14 METER LB (BR)").when(v.contains("LOWBED") | v.rlike(r"\bLB\b"), "LOWBED").when(v.contains("3 TON") | v.rlike(r"\b3T\b"), "3 TON PU")
        .when(v.contains("7 TON") | v.rlike(r"\b7T\b"), "7 TON PU").when(v.contains("FLATBED") | v.rlike(r"\bFB\b"), "FLATBED").when(v == "", "OTHER").otherwise(clean(v))
    )
    kind = F.when(base.startswith("LOWBED"), "LOWBED").when(base.startswith("FLATBED"), "FLATBED")
    mark = F.when(v.contains("HAZ") | v.contains("DG"), " HAZMAT").when(v.contains("CICPA"), " CICPA")
    return F.coalesce(F.concat(kind, mark), base)


def tokens(normal_place: Column) -> Column:
    """Distinct words in order, without stop words and brackets."""
    words = F.filter(F.split(upper_ascii(normal_place), r"\s+"), lambda t: (t != "") & ~t.isin(*STOPWORDS))
    return F.array_distinct(F.transform(words, lambda t: F.translate(t, "()", "")))


def case_id(text: Column) -> Column:
    """Upper-case runs joined by dashes; a number's trailing .0 goes; UNKNOWN for nothing."""
    t = F.trim(text)
    whole = F.when(t.rlike(r"^\d+\.0+$"), F.regexp_extract(t, r"^(\d+)", 1)).otherwise(t)
    token = F.regexp_replace(F.regexp_replace(F.upper(whole), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("UNKNOWN"))


def flag(text: Column) -> Column:
    """struct(value, status): O is ok, blank is blank, anything else a warning."""
    t = F.upper(F.trim(text))
    blank = F.coalesce(t == "", F.lit(True))
    return F.struct(F.when(blank, None).when(t == "O", "true").otherwise(t).alias("value"), F.when(blank, "blank").when(t == "O", "ok").otherwise("warn").alias("status"))
