"""Substring dedup by line and passage hashing.

A text's words are what stands between white space, A-Z in lower case; in scripts without spaces a word is two characters.
Hashed to 64 bits are lines of at least ``line_words`` words, and windows of exactly ``run_words`` words in sequence, over line ends
if need be. Windows start where content says so, so that equal passages are cut alike wherever they stand: at the first words
of lines and sentences and every ``run_words`` words from there, at words with a capital from A to Z or of LONG bytes, and at one of ANCHOR others by hash; further
windows end with the last words of lines and sentences. Digests are grouped globally; the occurrence that comes first by (doc_id, place) is kept, and elsewhere the line
or window goes. So what goes stands, word for word and at that length, in an earlier place; of a repeated passage, a few words
before the first start or after the last end may stay.

Rows are dealt to batches of about ``batch_bytes`` of text. A batch sends, for each of its distinct digests, the first
occurrence to the digest's bucket (so a hot digest is one entry for each batch, not for each row); a bucket answers with
the global first occurrences of repeated digests, and the batch cuts its texts. Batches, buckets and answers are bounded.

Defined results: null text stays null, with nothing removed; a null doc_id ranks after all others; rows that share a
doc_id are the same document, so occurrences of equal rank are all kept; columns ``kept_text`` and ``removed`` of docs are replaced; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, parts, text_bytes
from .shingles import chunks, mix, powers, words_in

#: Letters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana and Han (fixed values).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
WORD = re.compile(rf"[{UNSPACED}]{{1,2}}|[^\s{UNSPACED}]+|\n")
WIDE_ENDS = "\u3002\uff01\uff1f\uff0c\u3001\uff1b\uff1a"  # full-width sentence and clause marks
LONG, ANCHOR = 8, np.uint64(16)
CHUNK_CHARS = 1_000_000


class Words:
    """Words of some texts end to end: hashes, byte places, the text of each, and where lines and sentences begin.

    Texts with unspaced scripts are spelled with a space between words first; ``spelled`` has their words' spans.
    """

    def __init__(self, texts: list[str]):
        self.spelled: dict[int, list[tuple[int, int]]] = {}
        raw = []
        for i, t in enumerate(texts):
            if not t.isascii() and HAS_UNSPACED.search(t):
                found = [m.span() for m in WORD.finditer(t)]
                self.spelled[i] = [x for x in found if t[x[0]] != "\n"]
                t = " ".join([t[a:b] for a, b in found])
            raw.append(t.encode("utf-8", "surrogatepass"))
        self.buffer = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        self.text_ends = np.cumsum([len(r) + 1 for r in raw])
        self.hashes, self.starts, self.ends = words_in(self.buffer)
        self.bounds = np.searchsorted(self.starts, np.concatenate([[0], self.text_ends]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        n = len(self.hashes)
        breaks = np.flatnonzero(self.buffer == 10)
        line = np.searchsorted(breaks, self.starts)
        self.new_line = np.concatenate([[True], line[1:] != line[:-1]]) if n else np.zeros(0, dtype=bool)
        ends_sentence = np.isin(self.buffer[self.ends - 1], np.frombuffer(b".!?", dtype=np.uint8))
        if not all(map(str.isascii, texts)):
            three = (self.buffer[np.maximum(self.ends - 3, 0)].astype(np.int64) << 16) | (self.buffer[np.maximum(self.ends - 2, 0)].astype(np.int64) << 8) | self.buffer[self.ends - 1]
            ends_sentence |= np.isin(three, [int.from_bytes(c.encode(), "big") for c in WIDE_ENDS])
        self.new_sentence = self.new_line | (np.concatenate([[False], ends_sentence[:-1]]) if n else False)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        forward, self.inverse = powers(n + 1)
        np.cumsum(self.hashes * forward[:n], out=self.sums[1:])

    def digest(self, first: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.inverse[first] + mix((end - first).astype(np.uint64) + np.uint64(kind << 32)))

    def units(self, line_words: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digest, first word, end word) of lines that are long enough, then of windows."""
        n = len(self.hashes)
        first = np.flatnonzero(self.new_line)
        end = np.append(first[1:], n) if n else first
        long = end - first >= line_words
        lines, line_ends = first[long], end[long]
        begins = np.flatnonzero(self.new_sentence)
        closing = np.append(begins[1:], n) - run_words if n else begins
        place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        capital = self.buffer[self.starts] - np.uint8(65) < 26
        own = np.flatnonzero(capital | (self.ends - self.starts >= LONG) | (mix(self.hashes) % ANCHOR == 0) | (place % run_words == 0))
        starts = np.unique(np.concatenate([own, closing]))
        starts = starts[(starts >= 0) & (starts + run_words <= n)]
        starts = starts[self.text[starts] == self.text[starts + run_words - 1]]
        return (
            np.concatenate([self.digest(lines, line_ends, 1), self.digest(starts, starts + run_words, 0)]),
            np.concatenate([lines, starts]), np.concatenate([line_ends, starts + run_words]),
        )

    def spans(self, gone: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each text with words that go, the code-point spans of runs of them."""
        at = np.flatnonzero(gone)
        if not len(at):
            return {}
        run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (self.text[at[1:]] != self.text[at[:-1]])])
        first, last = at[run], at[np.append(np.flatnonzero(run)[1:] - 1, len(at) - 1)]
        out: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(self.text[first].tolist(), first.tolist(), last.tolist()):
            if i in self.spelled:
                own = self.spelled[i]
                out.setdefault(i, []).append((own[a - self.bounds[i]][0], own[b - self.bounds[i]][1]))
            else:
                out.setdefault(i, []).append((int(self.starts[a]), int(self.ends[b])))
        for i, found in out.items():
            if i not in self.spelled:
                begin = int(self.text_ends[i - 1]) if i else 0
                points = np.concatenate([[0], np.cumsum((self.buffer[begin : self.text_ends[i]] & 0xC0) != 0x80)])
                out[i] = [(int(points[a - begin]), int(points[b - begin])) for a, b in found]
        return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the spans; white space around a cut becomes one line break or space."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    joined = out[0]
    for part in out[1:]:
        left, right = joined.rstrip(), part.lstrip()
        gap = joined[len(left) :] + part[: len(part) - len(right)]
        joined = left + (("\n" if "\n" in gap else " " if gap else "") if left and right else "") + right
    return joined


def _doc(value) -> int:
    return (1 << 63) - 1 if value is None or pd.isna(value) else int(value)


def dedup(docs: DataFrame, line_words: int = 8, run_words: int = 25, batch_bytes: int = 4 << 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """docs (doc_id, text and any other columns) with ``kept_text`` and ``removed`` (code-point spans of the original text)."""
    docs = docs.drop("kept_text", "removed")
    names, schema = docs.columns, docs.schema
    total = text_bytes(docs)
    batches, buckets = parts(total, batch_bytes), parts(total, bucket_bytes)
    inner = [f"c{i}" for i in range(len(names))]
    id_at, text_at = inner[names.index("doc_id")], inner[names.index("text")]
    dealt = docs.toDF(*inner)
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64(id_at, text_at, F.spark_partition_id()), F.lit(batches)).cast("int"))
    dealt = dealt.repartition(F.col("batch"))

    def held(rows: pd.DataFrame) -> Iterator[tuple[list[int], Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For chunks of the rows that have text: their places, words, digests, first and end words, doc_ids and places of units."""
        at = [i for i, t in enumerate(rows[text_at]) if isinstance(t, str)]
        texts, docs = rows[text_at].tolist(), [_doc(d) for d in rows[id_at]]
        for chunk in chunks(at, lambda i: len(texts[i]), CHUNK_CHARS):
            words = Words([texts[i] for i in chunk])
            digest, first, end = words.units(line_words, run_words)
            of = words.text[first]
            yield chunk, words, digest, first, end, np.array([docs[i] for i in chunk], dtype=np.int64)[of], first - words.bounds[of]

    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        forget()
        found = [(digest, doc, place) for _, _, digest, _, _, doc, place in held(rows)]
        if not any(len(x[0]) for x in found):
            return pd.DataFrame({"bucket": pd.Series(dtype="int32"), "batch": pd.Series(dtype="int32"), "entries": pd.Series(dtype=object)})
        hashed, doc_ids, places = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((places, doc_ids, hashed))
        hashed, doc_ids, places = hashed[order], doc_ids[order], places[order]
        first = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]])
        counts = np.diff(np.r_[first, len(hashed)])
        hashed, doc_ids, places = hashed[first], doc_ids[first], places[first] * 2 + (counts > 1)
        bucket = ((hashed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        filled, starts = np.unique(bucket[order], return_index=True)
        out = [(b, key[0], pack(hashed[i], doc_ids[i], places[i])) for b, i in zip(filled.tolist(), np.split(order, starts[1:]))]
        return pd.DataFrame(out, columns=["bucket", "batch", "entries"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        entries = [unpack(e) for e in rows["entries"]]
        digests, doc_ids, places = (np.concatenate(x) for x in zip(*entries))
        owner = np.repeat(np.arange(len(entries)), [len(e[0]) for e in entries])
        order = np.lexsort((places, doc_ids, digests))
        sorted_digests = digests[order]
        starts = np.flatnonzero(np.r_[True, sorted_digests[1:] != sorted_digests[:-1]])
        counts = np.diff(np.r_[starts, len(order)])
        repeated = (counts > 1) | (np.maximum.reduceat(places[order] & 1, starts) == 1)
        group = np.repeat(np.arange(len(starts)), counts)
        take = repeated[group]
        mine, first = order[take], order[starts[group[take]]]
        by_owner = np.argsort(owner[mine], kind="stable")
        mine, first = mine[by_owner], first[by_owner]
        ends = np.searchsorted(owner[mine], np.arange(len(entries) + 1))
        out = [(rows["batch"].iloc[k], pack(digests[mine[a:b]], doc_ids[first[a:b]], places[first[a:b]])) for k in range(len(entries)) if (b := ends[k + 1]) > (a := ends[k])]
        return pd.DataFrame(out, columns=["batch", "entries"])

    def apply(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        forget()
        entries = [unpack(e) for e in answers["entries"]]
        known, first_doc, first_place = (np.concatenate(x) for x in zip(*entries)) if entries else (np.zeros(0, dtype=t) for t in ("<u8", "<i8", "<u4"))
        order = np.argsort(known)
        known, first_doc, first_place = known[order], first_doc[order], (first_place[order] >> 1).astype(np.int64)
        kept, removed = [t if isinstance(t, str) else None for t in rows[text_at]], [[] for _ in range(len(rows))]
        for chunk, words, digest, first, end, doc, place in held(rows) if len(known) else ():
            at = np.minimum(np.searchsorted(known, digest), len(known) - 1)
            again = (known[at] == digest) & ((first_doc[at] != doc) | (first_place[at] != place))
            edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            np.add.at(edge, first[again], 1)
            np.add.at(edge, end[again], -1)
            for i, spans in words.spans(np.cumsum(edge[:-1]) > 0).items():
                kept[chunk[i]] = cut(kept[chunk[i]], spans)
                removed[chunk[i]] = [{"start": a, "end": b} for a, b in spans]
        out = rows[inner].copy()
        out["kept_text"], out["removed"] = pd.Series(kept, index=out.index, dtype=object), pd.Series(removed, index=out.index, dtype=object)
        return out

    sent = dealt.select("batch", id_at, text_at).groupBy("batch").applyInPandas(send, "bucket int, batch int, entries binary")
    answers = sent.groupBy("bucket").applyInPandas(answer, "batch int, entries binary")
    out_schema = T.StructType([T.StructField(c, f.dataType, True) for c, f in zip(inner, schema.fields)] + [T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    cut_docs = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(apply, out_schema)
    return cut_docs.toDF(*names, "kept_text", "removed")


def pack(digests: np.ndarray, doc_ids: np.ndarray, places: np.ndarray) -> bytes:
    return digests.astype("<u8").tobytes() + doc_ids.astype("<i8").tobytes() + places.astype("<u4").tobytes()


def unpack(entries: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(entries) // 20
    raw = bytes(entries)
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<u4", n, 16 * n)



