"""Byte-level BPE by DuckDB recursive queries inside each Spark task.

Encoding: a task's texts are cut at white space and by the pattern into words; each distinct word it has not seen becomes
rows (word, position, token), at first a token for each byte; each row knows its follower's key. The recursive query joins
followers and the merge table (a merged token's id is its rank) and contracts each word's leftmost pair of minimum rank, until no word has a pair left. Decoding joins token rows with the
vocabulary and puts their bytes together by an ordered aggregation. Only distinct words enter the query, in blocks.

Defined results: null text is empty and has no ids; a word that is a token by itself is that token (as in tiktoken). Words
of over LONG_WORD bytes take the same contractions from a heap, since a contraction a step over all their rows costs the
square of their length; results are equal. Ids of unknown tokens are an error. Repeated rows and other columns are kept as they are; columns of the results' names are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PieceCache, per_worker, small_batches

LONG_WORD = 1_024
BLOCK_BYTES = 100_000
WORDS_KEPT = 450_000  # words that a worker remembers, the vocabulary's own among them

ENCODE = """
WITH RECURSIVE symbols(word, step, key, following, token) AS (
  SELECT word, 0, (word << 20) + pos, (word << 20) + pos + 1, token FROM bytes_of_words
  UNION ALL
  SELECT s.word, s.step + 1, s.key,
         CASE WHEN s.key = b.kept THEN b.after ELSE s.following END,
         CASE WHEN s.key = b.kept THEN b.merged ELSE s.token END
  FROM symbols s JOIN (
    SELECT word, min(code) >> 20 AS merged, (word << 20) + (min(code) & 1048575) AS kept,
           arg_min(gone, code) AS gone, arg_min(after, code) AS after
    FROM (SELECT l.word, (m.merged << 20) + (l.key & 1048575) AS code, r.key AS gone, r.following AS after
          FROM symbols l JOIN symbols r ON r.key = l.following JOIN merges m ON m.pair = (l.token << 32) + r.token)
    GROUP BY word) b ON s.word = b.word
  WHERE s.key <> b.gone)
SELECT s.word, s.token
FROM symbols s JOIN (SELECT word, max(step) AS step FROM symbols GROUP BY word) e ON s.word = e.word AND s.step = e.step
ORDER BY s.key
"""

DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocabulary v ON v.token = t.token GROUP BY t.doc
"""


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _is_text(word: bytes) -> bool:
    try:
        return bool(word.decode())
    except UnicodeDecodeError:
        return False


class Tables:
    """A DuckDB connection of one Python worker with the merge table and the vocabulary of a rank file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = ranks_of(path)
        self.words = regex.compile(pattern).findall
        self.known = {w.decode(): np.uint32(token).tobytes() for w, token in self.ranks.items() if _is_text(w)}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [((left << 32) + right, token) for word, token in self.ranks.items() for i in range(1, len(word)) if (left := self.ranks.get(word[:i])) is not None and (right := self.ranks.get(word[i:])) is not None]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = pd.DataFrame(pairs, columns=["pair", "merged"])
        vocabulary = pd.DataFrame({"token": list(self.ranks.values()), "hex": [w.hex() for w in self.ranks]})
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        del merges, vocabulary
        self.cache = PieceCache(self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        cut = list(map(self.words, pieces))
        distinct = set().union(*cut)
        known = self.known
        ids = {w: known[w] for w in distinct if w in known}
        new = list(distinct.difference(ids))
        raw = [w.encode() for w in new]
        ids |= ((w, self.encode_long(r)) for w, r in zip(new, raw) if len(r) > LONG_WORD)
        names, block, size = [], [], 0
        for w, r in [*zip(new, raw), (None, None)]:
            if block and (r is None or size >= BLOCK_BYTES):
                ids |= zip(names, self.encode_words(block))
                names, block, size = [], [], 0
            if r is not None and len(r) <= LONG_WORD:
                names.append(w)
                block.append(r)
                size += len(r)
        room = WORDS_KEPT - len(known)
        known |= [(w, ids[w]) for w in new[:room] if len(w) <= 64] if room > 0 else []
        get = ids.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        bytes_of_words = pd.DataFrame({"word": np.repeat(np.arange(len(words)), lengths), "pos": np.arange(len(raw)) - first, "token": self.single[raw]})
        self.con.register("bytes_of_words", bytes_of_words)
        out = self.con.execute(ENCODE).fetchnumpy()
        tokens, ends = out["token"].astype("<u4"), np.searchsorted(out["word"], np.arange(len(words)), side="right")
        return [t.tobytes() for t in np.split(tokens, ends[:-1])]

    def encode_long(self, word: bytes) -> bytes:
        """The same contractions, leftmost minimum rank first, by a heap of pairs."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        heap = [(r, i, 2) for i in range(len(word) - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(word) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(word) and (r := self.ranks.get(joined := parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(joined)))
        return np.array([self.ranks[p] for p in parts if p is not None], dtype="<u4").tobytes()

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of uint32 ids."""
        out, at = [b""] * len(ids), 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + len(ids[end]) // 4 <= 150_000):
                size += len(ids[end]) // 4
                end += 1
            lengths = np.array([len(x) // 4 for x in ids[at:end]])
            tokens = pd.DataFrame({"doc": np.repeat(np.arange(at, end), lengths), "pos": np.arange(lengths.sum()), "token": np.frombuffer(b"".join(ids[at:end]), dtype="<u4").astype(np.int64)})
            self.con.register("tokens", tokens)
            for doc, text in self.con.execute(DECODE).fetchall():
                out[doc] = bytes.fromhex(text)
            at = end
        return out


def tables(path: str, pattern: str) -> Tables:
    return per_worker(("bpe", path, pattern), lambda: Tables(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with a binary column of the text's ids as little-endian uint32, and if asked one of the bytes that these decode to.

    Both come from one Python worker a task, so its tables exist once.
    """
    out = F.pandas_udf("ids binary, decoded binary")

    @out
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = tables(path, pattern)
        for batch in batches:
            coded, back, chunk, chars = [], [], [], 0
            for t in [*batch, None]:
                chunk.append(t)
                chars += len(t or "")
                if chars >= 500_000 or len(coded) + len(chunk) > len(batch):
                    coded += own.cache.texts(chunk)
                    back += own.decode(coded[len(back) :]) if decoded else [None] * (len(coded) - len(back))
                    chunk, chars = [], 0
            yield pd.DataFrame({"ids": coded[: len(batch)], "decoded": back[: len(batch)]}, dtype=object)

    both = small_batches(df).withColumn("_coded", run(F.col(text)))
    return both.withColumns({ids: F.col("_coded.ids")} | ({decoded: F.col("_coded.decoded")} if decoded else {})).drop("_coded")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for; null ids are none."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(tables(path, pattern).decode([bytes(x) if x is not None else b"" for x in batch]), dtype=object)

    return df.withColumn(decoded, run(F.col(ids)))
