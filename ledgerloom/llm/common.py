"""What several operators share: the shared folder, sizes of tables, segments of text and a bounded cache for them."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the tokenizers' patterns see it (fixed values of Unicode's White_Space property).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f"[^{WHITE}]+")
SEGMENTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: What keeps a text from being cut by str.split and str.replace alone, with the same result.
ODD_WORD_ENDS = ("\x1c", "\x1d", "\x1e", "\x1f")
ODD_SPACE = ("  ", "\n\n", " \n", "\n ", "\0", "\t", "\x0b", "\x0c", "\r")
ODD_WIDE_SPACE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")


def cut_words(text: str) -> list[str]:
    """WORDS.findall(text)."""
    return WORDS.findall(text) if any(x in text for x in ODD_WORD_ENDS) else text.split()


def plain(text: str) -> bool:
    """Whether the text's white space is single spaces and line breaks, and it has no NUL."""
    return not any(x in text for x in ODD_SPACE) and (text.isascii() or not any(x in text for x in ODD_WIDE_SPACE))


def cut_segments(text: str) -> list[str]:
    """SEGMENTS.findall(text), but that an empty piece may come first."""
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") if plain(text) else SEGMENTS.findall(text)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset, a local one in local mode
    (tests), and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, if asked with a folder for each value of column ``by``: cuts lineage, outlives
    executors and is computed once."""
    path = shared_dir(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in all of docs, in one pass over that column."""
    return docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def small_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """df, whose texts Python workers shall get in batches of at most so many rows (a setting of the session)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def parts(total: int, each: int) -> int:
    """How many parts of about `each` make `total`; 1 at least."""
    return max(1, -(-total // each))


class PieceCache:
    """Encodes texts piece by piece: pieces never influence each other, so each distinct one is encoded once.

    ``encode`` maps a list of distinct pieces to a list of ``bytes``. The cache keeps the first ``limit`` short pieces
    a worker sees (frequent ones come early); others live for one chunk of texts, so memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 250_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def texts(self, texts: Iterable[str | None], chunk_chars: int = 1_000_000) -> Iterable[bytes]:
        chunk, chars = [], 0
        for t in texts:
            chunk.append(t or "")
            chars += len(chunk[-1])
            if chars >= chunk_chars:
                yield from self._chunk(chunk)
                chunk, chars = [], 0
        if chunk:
            yield from self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        known = self.known
        pieces = [cut_segments(t) for t in texts]
        new = list(set().union(*pieces).difference(known))
        if new:
            known.update(zip(new, self.encode(new), strict=True))
        get = known.__getitem__
        out = [b"".join(map(get, ps)) for ps in pieces]
        room = self.limit - (len(known) - len(new))
        for i, p in enumerate(new):
            if i >= room or len(p) > 64:
                del known[p]
        return out


_workers: dict = {}


def per_worker(key, make: Callable):
    """make() once for each Python worker and key; a worker holds one such object, and forgets it when it makes another."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = make()
    return _workers[key]


def forget() -> None:
    """Frees what per_worker() holds: workers are used again by stages that need their memory for other things."""
    _workers.clear()


#: What the two files' pre-tokenizers match; the first after lower-casing.
LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII text.
ASCII_LOWER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
ASCII_BYTE_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: From this character on, pieces take the library's whole pipeline.
FAR_LETTER = "\u0250"


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte that does not stand for itself: these follow from U+0100 in order."""
    other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + n) for n, b in enumerate(other)}


class LibraryEncoder(dict):
    """Ids of texts by the tokenizers library's file at path, piece by piece; strings of special tokens are ordinary text.

    Pieces never influence each other. Words of Latin pieces go to the library's model one by one; other pieces take its whole
    pipeline. The dict holds the first ``pieces`` short pieces that a worker meets, and ``words`` as many of their words, so
    memory is bounded. Its keys stand for a space and the key, or for the key alone if that starts with a line break or,
    without it, after a NUL; with ``lower`` (the lower-casing tokenizer with word ends) for the key.
    """

    def __init__(self, path: str, lower: bool, width: str, pieces: int, words: int):
        import unicodedata

        import regex

        if sys.byteorder != "little":
            raise RuntimeError("ids are written by little-endian machines")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tokenize, self.letters, self.lower, self.normal = self.tok.model.tokenize, byte_letters(), lower, unicodedata.normalize
        self.ascii_words = (ASCII_LOWER_WORDS if lower else ASCII_BYTE_WORDS).findall
        self.latin_words = regex.compile(LOWER_WORDS if lower else BYTE_WORDS).findall
        self.code, self.pieces, self.most_words, self.words = {"<u2": "H", "<u4": "I"}[width], pieces, words, {}

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            spelled = word.replace(" ", self.letters[32])
        else:
            spelled = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.tokenize(spelled)]).tobytes()
        if len(self.words) < self.most_words and len(word) <= 64:
            self.words[word] = ids
        return ids

    def __missing__(self, key: str) -> bytes:
        piece = key if self.lower or key[:1] == "\n" else key[1:] if key[:1] == "\0" else " " + key
        if piece.isascii():
            own = self.ascii_words(piece.lower() if self.lower else piece)
        elif max(piece) < FAR_LETTER:
            own = self.latin_words(self.normal("NFC", piece).lower() if self.lower else piece)
        else:
            own = None
        if own is None:
            ids = array(self.code, self.tok.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()
        else:
            known = self.words
            ids = b"".join([known.get(w) or self.word(w) for w in own])
        if len(self) < self.pieces and len(key) <= 64:
            self[key] = ids
        return ids

    def keys_of(self, text: str) -> list[str]:
        if self.lower:
            return cut_words(text)
        if plain(text):
            own = text.replace("\n", " \n").split(" ")
            if own[0][:1] != "\n":
                own[0] = "\0" + own[0]
            return own
        return ["\0" + p for p in SEGMENTS.findall(text)]

    def texts(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        get = self.__getitem__
        for t in texts:
            yield b"".join(map(get, self.keys_of(t))) if t else b""


def library_encoder(path: str, lower: bool, width: str = "<u4", pieces: int = 400_000, words: int = 350_000) -> LibraryEncoder:
    """The worker's encoder: ``lower`` for the lower-casing tokenizer with word ends, else the byte-level one."""
    return per_worker((path, lower, width), lambda: LibraryEncoder(path, lower, width, pieces, words))
