"""Table functions for charge lines of invoice texts, and the category of a charge line.

`register` puts them into a session by name, for SQL: ``SELECT d.doc_id, i.* FROM docs d, LATERAL text_line_items(d.text) i``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Keywords of a charge line's category, in order, and the category of a document type without any.
CATEGORIES = (
    ("Inspection", ("customs inspection", "inspection by customs", "container inspection", "inspection fee", "admin & inspection", "twcs inspection")),
    ("Customs", ("customs clearance", "bill of entry", "boe", "customs duty", "customs declaration", "debit note", "pre-clear", "preclearance", "gate pass", "shj customs")),
    ("DO", ("master do", "house do", "delivery order", "do fee", "d/order", "d.o.no")),
    ("INLAND", ("transport", "truck", "trucking", "inland", "fb from", "cicpa", "cipca", "mosb", "road freight", "appointment charge")),
    ("THC", ("terminal handling", "port handling", "thc", "tsc", "discharging", "loading", "unloading", "berth", "stevedoring")),
    ("Detention", ("detention", "container detention", "line detention")),
    ("STROAGE", ("storage", "stroage", "yard storage", "warehouse storage", "port storage", "airport storage")),
)
FALLBACK = {
    "BOE_CUSTOMS": "Customs", "DELIVERY_ORDER": "DO", "DELIVERY_NOTE": "INLAND", "PORT_ALLIED": "Inspection", "PORT_CSP": "Inspection", "AIRPORT_FEES": "OTHERS",
    "AIRPORT_APPOINTMENT": "INLAND", "CARRIER_RHS": "OTHERS", "CARRIER_EVG": "OTHERS", "CARRIER_CMA": "OTHERS", "UNKNOWN": "OTHERS",
}
CONTAINER = r"\b[A-Z]{3}[UJZ]\d{7}\b"
# Patterns of charge lines in text, and the words of which a carrier's row has one.
CARRIER_ROW = re.compile(r"^\s*(\d{1,3})\s+([A-Za-z][A-Za-z0-9 &/().,\-]+?)\s+(AED|USD)\s+(.+)$", re.I)
CARRIER_WORDS = ("inspection", "reposition", "admin", "maintenance", "isps", "container")
ALLIED = re.compile(r"Being\s+Admin\s*&\s*Inspection\s+Charges\s+([A-Z]{3}[UJZ]\d{7})\s+AED\s+([0-9,]+\.\d{2})\s+AED\s+([0-9,]+\.\d{2})\s+AED\s+([0-9,]+\.\d{2})", re.I | re.S)
TWCS = re.compile(r"TWCS\s+Inspection\s+Charges\s+CNOS\.?\s*([A-Z]{3}[UJZ]\d{7}).{0,80}?1\.00\s+([0-9,]+\.\d{2})\s+([0-9,]+\.\d{2})", re.I | re.S)
AIRPORT = re.compile(r"(Appointment Charges|DPC Charges|Maqta Charges)\s+1\s+([0-9,]+\.\d{2})\s+([0-9,]+\.\d{2})(?:\s+0\s+0\.00\s+([0-9,]+\.\d{2}))?", re.I)
RETURN_SERVICE = "Container Return Service Charge"
RETURNED = re.compile(r"Container Return Service Charge\s+AED\s+([0-9,]+(?:\.\d{2})?)", re.I)
AGENCY, SECURITY, UPKEEP = "EVERGREEN SHIPPING AGENCY", "ISPS/D", "CONTAINER MAINTENANCE CHARGE"
SECURED = re.compile(r"ISPS/D\s+10\.00\s+USD\s+([\s\S]{0,80}?)(\d+\.\d{2})\s+0\.00%", re.I)
UPKEPT = re.compile(r"CONTAINER MAINTENANCE CHARGE\s+([0-9,]+\.\d{2})\s+AED", re.I)
SECURITY_AMOUNT, UPKEEP_AMOUNT = 36.73, 175.0
NOTE_STARTS = re.compile(r"\bDEBIT NOTE\b", re.I)
NOTE_NUMBER = re.compile(r"DEBIT NOTE\s*\n\s*(\d{8,})", re.I)
NOTE_AMOUNT = re.compile(r"(?:إستيراد|Import)\s+(\d{3,6})\s+([0-9,]+)(?:\s|\n)", re.I)
NOTE_OTHER_AMOUNT = re.compile(r"\n\s*([0-9,]{2,})\s*\n\s*C538", re.I)
# What generic rows are told by.
MONEY = re.compile(r"(?:AED|USD|KRW|EUR)?\s*([\d,]+\.?\d{0,2})\s*(?:AED|USD|KRW|EUR)?", re.I)
CURRENCY = re.compile(r"\b(AED|USD|KRW|EUR)\b", re.I)
QUANTITY = re.compile(r"\b(\d+(?:\.\d+)?)\s*(?:pcs|units|kg|ton|TEU|lot|set|ea|box|ctn)\b", re.I)
RATE = re.compile(r"\b([\d,]+\.?\d{0,2})\s*(?:/\s*(?:pcs|unit|kg|ton|TEU|lot|set|ea|box|ctn|day))\b", re.I)
FIGURES = re.compile(r"\s*\d[\d,.]*\s*(?:AED|USD|KRW|EUR)?")
HEADS = frozenset("description item charge product service line no qty quantity rate amount total price currency vendor supplier date invoice".split())
FEET = frozenset("subtotal total vat tax balance page continued remarks notes".split())

ITEM = "ordinal int, source string, description string, container string, currency string, amount double, vat double, total double"
GENERIC = "line_id string, description string, currency string, amount double, qty double, rate double, origin string"


def number(text: str | None) -> float | None:
    m = re.search(r"-?\d+(?:\.\d+)?", (text or "").replace(",", ""))
    return round(float(m.group()), 2) if m else None


def description(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip(" -:;")[:160]


def category(text: Column, doc_type: Column) -> Column:
    """The first category with a keyword in text, else that of the document type."""
    low = F.lower(text)
    out = None
    for name, words in CATEGORIES:
        fits = F.lit(False)
        for w in words:
            fits = fits | low.contains(w)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    by_type = F.create_map(*[F.lit(x) for pair in FALLBACK.items() for x in pair])
    return out.otherwise(F.coalesce(F.try_element_at(by_type, doc_type), F.lit("OTHERS")))


def _carrier_rows(text: str) -> Iterator[tuple]:
    for line in filter(None, map(str.strip, text.splitlines())):
        m = CARRIER_ROW.match(line)
        figures = [float(x) for x in re.findall(r"\d+(?:\.\d+)?", m[4])] if m and any(w in m[2].lower() for w in CARRIER_WORDS) else []
        if figures:
            total = round(figures[-1], 2)
            vat = round(figures[-2], 2) if len(figures) > 1 and round(figures[-2], 2) <= total else None
            yield "text:carrier_row", m[2], "", m[3].upper(), round(total - vat, 2) if vat else total, vat, total


def _patterns(text: str) -> Iterator[tuple]:
    for m in ALLIED.finditer(text):
        yield "text:allied", "Being Admin & Inspection Charges", m[1].upper(), "AED", number(m[2]), number(m[3]), number(m[4])
    for m in TWCS.finditer(text):
        yield "text:twcs", "TWCS Inspection Charges", m[1].upper(), "AED", number(m[2]), None, number(m[2])
    for m in AIRPORT.finditer(text):
        yield "text:airport_fee", m[1], "", "AED", number(m[3]), 0.0, number(m[4] or m[3])
    for m in RETURNED.finditer(text):
        yield "text:cma", RETURN_SERVICE, "", "AED", number(m[1]), None, number(m[1])


def _agency_rows(text: str) -> Iterator[tuple]:
    upper = text.upper()
    if AGENCY in upper:
        for mark, pattern, group, name, currency, usual in ((SECURITY, SECURED, 2, SECURITY, "USD", SECURITY_AMOUNT), (UPKEEP, UPKEPT, 1, UPKEEP.title(), "AED", UPKEEP_AMOUNT)):
            if mark in upper:
                m = pattern.search(text)
                amount = number(m[group]) if m else usual
                yield "text:evg", name, "", currency, amount, None, amount


def _debit_notes(text: str) -> Iterator[tuple]:
    starts = [m.start() for m in NOTE_STARTS.finditer(text)]
    for begin, end in zip(starts, [*starts[1:], len(text)]):
        note = text[begin:end]
        own, other = NOTE_AMOUNT.search(note), NOTE_OTHER_AMOUNT.search(note)
        amount = number(own[2]) if own else None
        if amount is None and other:
            amount = number(other[1])
        if amount is not None:
            named = NOTE_NUMBER.search(note)
            yield "text:customs_debit", "Pre-Clear Debit" + (f" {named[1]}" if named else ""), "", "AED", amount, None, amount


class TextLineItems:
    """A row for each charge line of a text, in order of patterns, then of the text. A null text has none."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        found = (x for part in (_carrier_rows, _patterns, _agency_rows, _debit_notes) for x in part(text or ""))
        for n, (source, name, *rest) in enumerate(found):
            yield n, source, description(name), *rest


def _amount(text: str) -> float | None:
    figures = re.sub(r"[^\d.]", "", text)
    return float(figures) if figures.count(".") < 2 and figures.strip(".") else None


class GenericLines:
    """Rows of invoices of unknown layout: those of tables, or where these give none, text lines that bear an amount. `tables` is an
    array of (page, rows); nulls count as empty. A document without lines gives one row of nulls."""

    def eval(self, text: str | None, tables: list | None) -> Iterator[tuple]:
        rows = [x for t in tables or [] if t is not None for x in self.of_table(t["page"], [[c or "" for c in r or []] for r in t["rows"] or []])]
        if rows:
            yield from ((f"pdf_t_{page}_{n}", *rest, "table") for n, (page, *rest) in enumerate(rows))
            return
        n = -1
        for n, rest in enumerate(self.of_text(text or "")):
            yield f"pdf_l_{n}", *rest, "text"
        if n < 0:
            yield (None,) * 7

    @staticmethod
    def words(row: list[str]) -> set[str]:
        return set(" ".join(c.lower().strip() for c in row).split())

    def of_table(self, page: int, rows: list[list[str]]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        head = next((i for i, r in enumerate(rows) if HEADS & self.words(r)), -1)
        order = ([rows[head]] if head >= 0 else []) + rows[head + 1 :]
        at = next((i for r in order for i, c in enumerate(r) if MONEY.search(c)), len(rows[0]) - 1)
        for n, row in enumerate(rows[head + 1 :], 1):
            words = self.words(row)
            amount = _amount(row[at].strip()) if not words & (FEET | HEADS) and 0 <= at < len(row) else None
            if not amount or amount <= 0:
                continue
            others = " ".join(c for i, c in enumerate(row) if i != at and c.strip())[:200]
            first = lambda pattern: next((float(m[1].replace(",", "")) for m in map(pattern.search, row) if m and m[1].strip(",.")), None)
            named = CURRENCY.search(" ".join(row))
            yield page, others or f"Table line {n}", named[1].upper() if named else "AED", amount, first(QUANTITY), first(RATE)

    @staticmethod
    def of_text(text: str) -> Iterator[tuple]:
        for line in map(str.strip, text.splitlines()):
            if not 8 <= len(line) <= 200 or not re.search(r"\d", line):
                continue
            amounts = [a for a in map(_amount, MONEY.findall(line)) if a]
            if amounts:
                named = CURRENCY.search(line)
                yield FIGURES.sub("", line).strip()[:200] or line[:100], named[1].upper() if named else "AED", amounts[-1], None, None


text_line_items = F.udtf(TextLineItems, returnType=ITEM, useArrow=True)
generic_lines = F.udtf(GenericLines, returnType=GENERIC, useArrow=True)


def register(spark: SparkSession) -> None:
    """The table functions text_line_items(text) and generic_lines(text, tables) for SQL in this session."""
    spark.udtf.register("text_line_items", text_line_items)
    spark.udtf.register("generic_lines", generic_lines)
