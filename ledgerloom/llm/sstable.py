"""Token ids as sorted-string-table shards: prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

A shard holds documents in ascending key order (8 bytes, big endian, sign bit flipped; a null doc_id has the empty key and
comes first). An entry is: bytes shared with the key before (1), bytes of its own (1), ids (uint32), own key bytes, ids
(``width`` bytes each). A block is closed at ``block_bytes``; its first entry shares nothing, so the index of first keys
allows binary search. After the blocks come the index, the Bloom filter and a 64-byte footer that tells where they are.

Documents are dealt by range of (doc_id, hash of text), so shards are globally ordered, and rows that share a doc_id may
span shards; all of them are kept, and a lookup returns each. Null text holds the end id alone. A shard is written under a
name of its own and then renamed, so a repeated task replaces it whole. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import library_encoder, parts, shared_dir, small_batches, text_bytes, written

MAGIC = b"LLSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index at, Bloom at, Bloom bits, hashes, entries, ids, id width, magic
META = "number long, shard string, first_key binary, last_key binary, n_docs long, n_ids long, bytes long"
GROUP, MAX_GROUPS = 1_000, 100_000  # shards of a group; groups whose bounds a lookup sends to its tasks, at most
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_at(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", blake2b(key, digest_size=16).digest())
    b |= 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes one shard to a file object, entries in ascending key order."""

    def __init__(self, out, width: int, block_bytes: int = 65536, bits_per_key: int = 10, hashes: int = 7):
        self.out, self.width, self.block_bytes, self.bits_per_key, self.hashes = out, width, block_bytes, bits_per_key, hashes
        self.block, self.index, self.keys, self.at, self.last, self.ids = bytearray(), [], [], 0, None, 0

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.block:
            self.index.append((key, self.at))
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(self.last, key)) if x != y), min(len(self.last), len(key)))
        n = len(ids) // self.width
        self.block += struct.pack("<BBI", shared, len(key) - shared, n) + key[shared:] + ids
        self.last, self.ids = key, self.ids + n
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        self.out.write(bytes(self.block))
        self.at += len(self.block)
        self.block = bytearray()

    def finish(self) -> int:
        self._close_block()
        index_at = self.at
        index = b"".join(struct.pack("<BQ", len(k), at) + k for k, at in self.index)
        bits = max(64, -(-len(self.keys) * self.bits_per_key // 8) * 8)
        bloom = np.zeros(bits, dtype=bool)
        for k in self.keys:
            bloom[_bloom_at(k, bits, self.hashes)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(index_at, index_at + len(index), bits, self.hashes, len(self.keys), self.ids, self.width, MAGIC))
        return index_at + len(index) + len(packed) + FOOTER.size


class Reader:
    """Reads a shard from a random-access file object: in order, or the entries of one key."""

    def __init__(self, file, size: int):
        self.file = file
        *head, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.index_at, self.bloom_at, self.bits, self.hashes, self.entries, self.ids, self.width = head
        raw, at, self.keys, self.starts = self._at(self.index_at, self.bloom_at - self.index_at), 0, [], []
        while at < len(raw):
            n, start = struct.unpack_from("<BQ", raw, at)
            self.keys.append(raw[at + 9 : at + 9 + n])
            self.starts.append(start)
            at += 9 + n
        self.bloom = None

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else self.index_at
        raw, at, key = self._at(self.starts[i], end - self.starts[i]), 0, b""
        while at < len(raw):
            shared, own, n = struct.unpack_from("<BBI", raw, at)
            key = key[:shared] + raw[at + 6 : at + 6 + own]
            at += 6 + own
            yield key, raw[at : at + n * self.width]
            at += n * self.width

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.starts)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[bytes]:
        """Ids of each entry with this key: Bloom filter, binary search in the sparse index, then blocks from there."""
        if self.bloom is None:
            self.bloom = np.unpackbits(np.frombuffer(self._at(self.bloom_at, self.bits // 8), dtype=np.uint8))
        if not all(self.bloom[_bloom_at(key, self.bits, self.hashes)]):
            return []
        found, i = [], max(0, bisect_right(self.keys, key) - 1)
        while i > 0 and self.keys[i] == key:
            i -= 1
        while i < len(self.starts) and self.keys[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, encode: Callable[[], object], end_id: int, width: int = 2, shard_bytes: int = 24 << 20, folder: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text) as shards below folder (default: a new one in the shared folder); returns META rows.

    ``encode`` makes, on the executor, an object whose ``texts`` maps texts to bytes of ids of that width. A shard is
    cut at ``shard_bytes`` of text by range of key; folder's scheme has to be one that Arrow's file systems open.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "sstable")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _files(folder)
        store.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"part-{number:08d}.sst"
        temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
        encoder, end, first, key = encode(), end_id.to_bytes(width, "little"), None, None
        with store.open_output_stream(temporary) as out:
            writer = Writer(out, width)
            for batch in batches:
                keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
                for doc_id, ids in zip(keys, encoder.texts(batch["text"]), strict=True):
                    key = key_of(doc_id)
                    first = key if first is None else first
                    writer.add(key, ids + end)
            size = writer.finish()
        if first is None:
            store.delete_file(temporary)
            return
        store.move(temporary, f"{base}/{name}")
        yield pd.DataFrame({"number": [number], "shard": [f"{folder}/{name}"], "first_key": [first], "last_key": [key], "n_docs": [len(writer.keys)], "n_ids": [writer.ids], "bytes": [size]})

    n = parts(text_bytes(docs), shard_bytes)
    dealt = small_batches(docs).select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    return written(dealt.mapInPandas(run, META), "sstable-meta")


def starts(shards: DataFrame) -> DataFrame:
    """(number, shard, start): how many ids come before each shard; sums inside groups of shards, then over groups."""
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = shards.select("number", "shard", "n_ids", F.floor(F.col("number") / GROUP).alias("group"))
    groups = grouped.groupBy("group").agg(F.sum("n_ids").alias("n_ids")).select("group", before(Window.orderBy("group")).alias("base"))
    inside = grouped.withColumn("inside", before(Window.partitionBy("group").orderBy("number")))
    return inside.join(groups, "group").select("number", "shard", (F.col("base") + F.col("inside")).alias("start"))


def read(shards: DataFrame) -> DataFrame:
    """ROWS for each document of the shards: where its ids start among all, how many, and their crc32 as uint32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, start in zip(batch["shard"], batch["start"]):
                store, path = _files(shard)
                with store.open_input_file(path) as f:
                    reader, rows = Reader(f, f.size()), []
                    for key, ids in reader.scan():
                        wide = np.frombuffer(ids, dtype=f"<u{reader.width}").astype("<u4").tobytes()
                        rows.append((doc_of(key), start, len(wide) // 4, zlib.crc32(wide)))
                        start += len(wide) // 4
                        if len(rows) >= 20_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    return starts(shards).repartition(max(1, shards.count()), "number").select("shard", "start").mapInPandas(run, ROWS)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids array<long>) for each entry whose doc_id is in keys; keys without an entry give no row.

    Keys go to the groups of shards whose range can hold them, there to the shards, and each shard answers its own keys by
    Bloom filter and binary search. Bounds of groups are sent to all tasks; more than MAX_GROUPS of them are an error.
    """
    grouped = shards.withColumn("group", F.floor(F.col("number") / GROUP))
    bounds = [(r["group"], bytes(r["first"]), bytes(r["last"])) for r in grouped.groupBy("group").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("group").limit(MAX_GROUPS + 1).collect()]
    if len(bounds) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of shards")
    firsts, lasts = [b[1] for b in bounds], [b[2] for b in bounds]

    @F.pandas_udf("array<long>")
    def owners(ids: pd.Series) -> pd.Series:
        keys = [key_of(None if pd.isna(k) else int(k)) for k in ids]
        return pd.Series([[bounds[i][0] for i in range(bisect_left(lasts, k), bisect_right(firsts, k))] for k in keys])

    def find(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("number")
        low, high, names = [bytes(k) for k in own["first_key"]], [bytes(k) for k in own["last_key"]], own["shard"].tolist()
        found = []
        for doc_id in asked["doc_id"]:
            k = key_of(None if pd.isna(doc_id) else int(doc_id))
            found += [(doc_id, names[i]) for i in range(bisect_left(high, k), bisect_right(low, k))]
        return pd.DataFrame(found, columns=["doc_id", "shard"]).astype({"doc_id": "Int64"})

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, path = _files(key[0])
        with store.open_input_file(path) as f:
            reader, out = Reader(f, f.size()), []
            for k in rows["doc_id"]:
                k = None if pd.isna(k) else int(k)
                out += [(k, np.frombuffer(ids, dtype=f"<u{reader.width}").astype(np.int64).tolist()) for ids in reader.get(key_of(k))]
        frame = pd.DataFrame(out, columns=["doc_id", "ids"])
        return frame.astype({"doc_id": "Int64"})

    asked = keys.select("doc_id").distinct().withColumn("group", F.explode(owners(F.col("doc_id"))))
    wanted = asked.groupBy("group").cogroup(grouped.select("group", "number", "shard", "first_key", "last_key").groupBy("group")).applyInPandas(find, "doc_id long, shard string")
    return wanted.groupBy("shard").applyInPandas(answer, "doc_id long, ids array<long>")


def token_table(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encodes docs by the tokenizers file at vocabulary (ids below 65,536) and returns the shards' META rows."""
    return write(docs, lambda: library_encoder(vocabulary, lower=False, width="<u2"), end_id)
