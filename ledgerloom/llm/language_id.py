"""Language identification, word first: known words score by their log frequency in each language; an unknown word backs
off to its character n-grams, the longest length of which any is known, down to single letters.

Training counts words and n-grams with Spark over a sample of labelled rows of about ``sample_rows`` (a documented bound: all
rows of small languages, equal parts of the others, by hash of text and doc_id, so the sample does not depend on partitions);
the model keeps ``words`` and ``grams`` entries, from each language's most frequent ones in turn, so its size is bounded and it
is sent to every task. Prediction reads whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text when no labelled row
is left to learn from. A column ``language`` of docs is replaced. The score is the posterior of the best language under equal priors; ties go to the smaller name.
Repeated rows are predicted each; a language of few rows is learned from those. Other columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_batches

ALPHANUMERIC = re.compile(r"[^\W\d_]+")
LONGEST = 5


@dataclass
class Model:
    """For each known word and n-gram a row of log frequencies, one for each language in order."""

    languages: list[str]
    words: list[str] = field(default_factory=list)
    word_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: list[str] = field(default_factory=list)
    gram_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame, sample_rows: int = 20_000, words: int = 60_000, grams: int = 120_000) -> Model:
    """Learns from labelled (text, lang), both not null."""
    drawn = F.pmod(F.xxhash64(*[c for c in ("text", "doc_id") if c in labelled.columns]), F.lit(1 << 40))
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang", drawn.alias("drawn"))
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = {lang: max(1, (most << 40) // rows[lang]) for lang, most in bounds(rows, sample_rows).items() if most < rows[lang]}
    if share:
        least = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
        labelled = labelled.where(F.coalesce(F.col("drawn") < least[F.col("lang")], F.lit(True)))
    split = F.split(F.lower("text"), r"[^\p{L}]+")
    counted = labelled.select("lang", F.explode(split).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    counted = counted.persist()
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, word, count in zip(batch["lang"], batch["word"], batch["count"]):
                padded = f" {word} "
                for n in range(1, LONGEST + 1):
                    for i in range(len(padded) - n + 1):
                        key = (lang, padded[i : i + n])
                        found[key] = found.get(key, 0) + count
            yield pd.DataFrame([(*k, c) for k, c in found.items()], columns=["lang", "word", "count"])

    pieces = counted.mapInPandas(cut, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))
    model = Model(languages)
    model.words, model.word_scores = _scores(counted, words, languages)
    model.grams, model.gram_scores = _scores(pieces.where("word <> ' '"), grams, languages)
    counted.unpersist()
    return model


def bounds(rows: dict[str, int], sample_rows: int) -> dict[str, int]:
    """Rows to take of each language: all of small ones, and of the others equal parts of what these leave."""
    out, left = {}, sample_rows
    for k, lang in enumerate(sorted(rows, key=lambda x: (rows[x], x))):
        out[lang] = min(rows[lang], max(1, left // (len(rows) - k)))
        left -= out[lang]
    return out


def _scores(counts: DataFrame, most: int, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Smoothed log frequencies of `most` entries, taken from each language's most frequent ones in turn (ties: larger count
    over all, smaller text). What a language lacks has the same frequency in each, however few rows it has."""
    if not languages:
        return [], np.zeros((0, 0))
    by = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"))  # an entry a language
    each = F.transform(F.array(*map(F.lit, languages)), lambda x: F.coalesce(F.try_element_at("by", x), F.lit(0).cast("long")))
    table = by.select("word", each.alias("counts")).withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("word").agg(F.min("rank").alias("rank"))
    top = table.join(best, "word").orderBy("rank", F.desc("total"), "word").limit(most).select("word", "counts").toArrow()
    counted = np.asarray(top["counts"].combine_chunks().flatten(), dtype=float).reshape(top.num_rows, len(languages))
    sums = np.maximum(counted.sum(axis=0), 1)
    floor = 0.5 / sums.max()
    return top["word"].to_pylist(), np.log((counted / sums + floor) / (1 + floor * max(1, top.num_rows)))


def words_of(text: str) -> list[str]:
    """The text's runs of letters in lower case, as Spark's split at [^\\p{L}]+ has them: no numerals such as superscripts."""
    found = ALPHANUMERIC.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


class Predictor:
    """Scores texts; rows of scores are kept for known words and for the first `limit` others."""

    def __init__(self, model: Model, limit: int = 60_000):
        self.model, self.limit = model, limit
        self.rows: dict[str, int] = {w: i for i, w in enumerate(model.words)}
        self.grams: dict[str, int] = {g: i for i, g in enumerate(model.grams)}
        self.scores = model.word_scores

    def unseen(self, word: str) -> np.ndarray:
        """Mean of the known n-grams of the longest length that has any."""
        padded = f" {word} "
        for n in range(min(LONGEST, len(padded)), 0, -1):
            found = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i : i + n])) is not None]
            if found:
                return self.model.gram_scores[found].mean(axis=0)
        return np.zeros(len(self.model.languages))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages = self.model.languages
        found = [words_of(t) if isinstance(t, str) else [] for t in texts]
        new = list({w for ws in found for w in ws if w not in self.rows})
        first = len(self.rows)
        if new and languages:
            self.rows.update(zip(new, range(first, first + len(new))))
            self.scores = np.vstack([self.scores, np.array([self.unseen(w) for w in new])])
        out = []
        for ws in found:
            if not ws or not languages:
                out.append(("und", 0.0))
                continue
            total = self.scores[np.fromiter(map(self.rows.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((languages[best], float(1 / np.exp(total - total[best]).sum())))
        if new and languages:
            keep = max(0, min(len(new), self.limit + len(self.model.words) - first))
            for w in new[keep:]:
                del self.rows[w]
            self.scores = self.scores[: first + keep]
        return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``language``: struct(lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        predictor = Predictor(sent.value)
        for batch in batches:
            out, chunk, chars = [], [], 0
            for t in batch:
                chunk.append(t)
                chars += len(t) if isinstance(t, str) else 0
                if chars >= 500_000:
                    out += predictor.texts(chunk)
                    chunk, chars = [], 0
            yield pd.DataFrame(out + predictor.texts(chunk), columns=["lang_pred", "score"])

    return small_batches(docs).withColumn("language", run(F.col(text)))
