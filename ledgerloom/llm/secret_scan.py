"""Secrets in texts: three fixed kinds by pattern, and what else looks random by sliding-window Shannon entropy.

The base kinds are leftmost, non-overlapping matches, of which those below their least length are dropped: ``assign`` (a
keyword, a separator, a value of 8 or more characters; the span is the whole match), ``access`` (16 or more) and ``hex`` (32 or more).

The method's kind ``entropy``: candidate strings are runs of `CANDIDATE` of at least ``window`` characters. A window of that
many characters slides over each; counts of its characters, of each character class and the sum of c * log2(c) over counts are
kept up by the character that enters and the one that leaves, so a run costs its length and not length times window. A window
belongs to the narrowest class that holds it (hex, one case with digits, mixed cases with digits; letters or digits alone
belong to none) and is kept if its entropy reaches the class's bits. Windows of one run that overlap or touch make one span. The sum is
held in whole numbers, so the same window gives the same value wherever it stands. Suppressed are spans of runs that an
allow-list pattern matches as a whole, that hold an allow-listed word, or that start at ``://`` (hosts of addresses), and spans that lie
inside a base span.

A text is one row and is scanned whole, in one pass for each pattern; rows are independent, so nothing is shuffled and a lost
executor's tasks run again alone. Spark bounds Arrow batches in bytes, so a task holds one batch and one text's spans.

Defined results: null text counts as empty and has no spans; repeated rows and null ids are scanned like any other; columns of
docs named like the result's are replaced by it; an empty table gives no rows. Spans count code points, ends exclusive, in order of start, then kind
(assign, access, hex, entropy), then end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed values of the task: (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
CANDIDATE = r"[A-Za-z0-9+/=_-]"
#: Whole candidates that are no secrets: UUIDs, dates and times, words and numbers joined by dashes or slashes.
ALLOWED = (r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", r"\d{4}-\d\d-\d\d(?:T[\d+-]*)?", r"=+", r"[/_-]*(?:[A-Z]?[a-z]+|[A-Z]+|\d+)(?:[/_-]+(?:[A-Z]?[a-z]+|[A-Z]+|\d+))+[/_-]*")
WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxxxxxx", "abcdefgh", "ABCDEFGH", "01234567", "12345678")
SCALE = 1 << 32

SPAN = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Policy:
    """What the method adds: window, bits for each class, allow-list patterns (for whole candidates) and words (anywhere in them)."""

    window: int = 16
    hex_bits: float = 2.75
    one_case_bits: float = 3.2
    mixed_bits: float = 3.45
    allowed: tuple[str, ...] = ALLOWED
    words: tuple[str, ...] = WORDS


def classes() -> list[int]:
    """A bit for each class of an ASCII character: 1 digit, 2 hex letter (lower), 4 hex letter (upper), 8 other lower, 16 other upper, 32 the rest."""
    return [1 if chr(c).isdigit() else 2 if chr(c) in "abcdef" else 4 if chr(c) in "ABCDEF" else 8 if chr(c).islower() else 16 if chr(c).isupper() else 32 for c in range(128)]


class Scanner:
    """A policy made ready; one for each task."""

    def __init__(self, policy: Policy):
        w = self.window = policy.window
        self.runs = re.compile(f"{CANDIDATE}{{{w},}}")
        self.allowed = [re.compile(p) for p in policy.allowed]
        self.words = [x.lower() for x in policy.words]
        self.terms = [0] + [round(c * log2(c) * SCALE) for c in range(1, w + 1)]
        most = lambda bits: int((log2(w) - bits) * w * SCALE)  # noqa: E731  entropy >= bits: the sum is at most this
        self.most = {"hex": most(policy.hex_bits), "one": most(policy.one_case_bits), "mixed": most(policy.mixed_bits)}
        self.bits = classes()

    def limit(self, digit: int, low_hex: int, up_hex: int, low: int, up: int, rest: int) -> int:
        """The largest sum that a window with so many characters of each class may have; -1 where it belongs to no class."""
        lower, upper = low_hex + low, up_hex + up
        if digit < 2 or not lower + upper:
            return -1
        if not rest + low + up and (not lower or not upper):
            return self.most["hex"] if digit >= 4 and lower + upper >= 3 else -1
        return self.most["mixed"] if lower and upper else self.most["one"] if digit >= 3 else -1

    def windows(self, run: str) -> Iterator[int]:
        """Starts of the windows of run whose entropy reaches their class's bits."""
        w, terms, code, bits = self.window, self.terms, run.encode("ascii"), self.bits
        count, kind, total = [0] * 128, [0] * 33, 0
        for at, c in enumerate(code):
            n = count[c]
            total += terms[n + 1] - terms[n] if n < w else 0
            count[c] = n + 1
            kind[bits[c]] += 1
            if at >= w - 1:
                if total <= self.limit(kind[1], kind[2], kind[4], kind[8], kind[16], kind[32]):
                    yield at - w + 1
                c = code[at - w + 1]
                n = count[c]
                total += terms[n - 1] - terms[n]
                count[c] = n - 1
                kind[bits[c]] -= 1

    def suppressed(self, text: str, start: int, run: str) -> bool:
        low = run.lower()
        address = text[max(0, start - 3) : start] == "://" or run.startswith("//") and text[max(0, start - 1) : start] == ":"
        return address or any(x in low for x in self.words) or any(p.fullmatch(run) for p in self.allowed)

    def entropy(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.runs.finditer(text):
            own: list[list[int]] = []
            for at in self.windows(m.group()):
                if own and at <= own[-1][1]:
                    own[-1][1] = at + self.window
                else:
                    own.append([at, at + self.window])
            if own and not self.suppressed(text, m.start(), m.group()):
                yield from ((m.start() + s, m.start() + e) for s, e in own)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        text = text or ""
        found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text) if m.end(g) - m.start(g) >= least]
        found.sort()
        own, reach = list(found), 0
        base = []  # base spans that no earlier one holds, so both ends grow
        for s, _, e in found:
            if e > reach:
                base.append((s, e))
                reach = e
        at = 0
        for s, e in self.entropy(text):
            while at < len(base) and base[at][1] < e:
                at += 1
            if at == len(base) or base[at][0] > s:
                own.append((s, 3, e))
        return [(KINDS[k], s, e) for s, k, e in sorted(own)]


def scan(docs: DataFrame, text: str = "text", into: str = "spans", policy: Policy = Policy()) -> DataFrame:
    """docs with column ``into``: the spans of each text."""

    @F.pandas_udf(SPAN)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(policy)
        for texts in parts:
            yield pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in scanner.spans(t)] for t in texts], index=texts.index, dtype=object)

    return docs.withColumn(into, spans(F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with the characters of each span as ``*``; spans may overlap. Linear in the text: the stretches between spans are cut once."""
    merged = F.aggregate(
        spans, F.expr("cast(array() as array<struct<start:long,end:long>>)"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    return F.aggregate(
        merged, F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.repeat(F.lit("*"), (s["end"] - s["start"]).cast("int"))).alias("done"), s["end"].alias("at")),
        lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
