"""Merkle fixity audit of WARC replicas.

Each page is a WARC/1.1 ``resource`` record. A file's records are dealt to volumes by hash of (page_id, url), about
``volume_rows`` to each; how many volumes a file has is counted once and holds for all its replicas, so a record's
volume and its neighbours follow from its name alone, never from its content. In a volume, records stand in order of
(page_id, url, digest). ``write`` makes real files, a gzip member for each record, and ``read`` parses them again;
``leaves`` gives the same rows without files. Offsets and lengths are those of the uncompressed records.

A leaf of a volume's tree is a page_id: the hash of its records with their offset ranges. A node holds the leaves whose
page_ids agree but for their last 4 bits times its level, hashed in order with their ranges, and a volume has one root. So the
trees of two replicas have nodes of the same names, whatever records they lack. An audit compares the roots and then, level
by level, only the children of nodes that differ; below the leaves that are left, records are compared one by one.

Defined results: null url or html is empty text, line breaks in a url are percent-encoded; null page_ids make one leaf of each
volume; repeated rows are records of their own, equal ones are paired in order; a record that only one replica has is reported
with nulls on the other side, and those behind it with their changed offsets. What cannot be parsed is a record without
page_id up to the next line that says WARC/1.1. Two empty replicas agree. Columns other than page_id, url, html are not read.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, shared_dir, small_batches, written

BITS, MAX_FILES = 4, 50_000
RANGE = ["offset", "length", "digest"]
FIRST = b"WARC/1.1\r\n"
FIELDS = {"page": re.compile(rb"WARC-Record-ID: <urn:page:(-?\d*)>\r\n"), "size": re.compile(rb"Content-Length: (\d+)\r\n")}


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC record, trailing blank lines included."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    target = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def volumes(pages: DataFrame, file: Column, volume_rows: int = 4096) -> DataFrame:
    """(file, volumes) of the archive that replicas are held against, written once."""
    return written(pages.groupBy(file.alias("file")).agg(F.ceil(F.count("*") / volume_rows).cast("long").alias("volumes")), "warc-volumes")


def _dealt(pages: DataFrame, file: Column, counts: DataFrame, bodies: bool) -> DataFrame:
    """(file, volume, page_id, url, length, digest) of pages, with bodies (..., record); a file that counts lacks has one volume.

    Records are hashed before anything is joined. Up to MAX_FILES files' counts are broadcast, so records are not
    shuffled for them; more are joined by shuffling.
    """
    rows = pages.select(file.alias("file"), F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    rows = rows.select("file", "page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *["record"] * bodies)
    counts = counts.select(F.col("file").alias("of"), "volumes")
    if counts.limit(MAX_FILES + 1).count() <= MAX_FILES:
        counts = F.broadcast(counts)
    joined = rows.join(counts, F.col("file").eqNullSafe(F.col("of")), "left")
    volume = F.pmod(F.xxhash64("page_id", "url"), F.greatest(F.coalesce("volumes", F.lit(1)), F.lit(1))).alias("volume")
    return joined.select("file", volume, "page_id", "url", "length", "digest", *["record"] * bodies)


def leaves(pages: DataFrame, file: Column, counts: DataFrame) -> DataFrame:
    """(file, volume, page_id, offset, length, digest) of each record; bodies do not leave the first stage."""
    in_order = Window.partitionBy("file", "volume").orderBy("page_id", "url", "digest")
    offset = F.coalesce(F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    return _dealt(pages, file, counts, False).select("file", "volume", "page_id", offset, "length", "digest")


def write(pages: DataFrame, file: Column, counts: DataFrame, folder: str | None = None, part_bytes: int = 24 << 20) -> DataFrame:
    """Writes pages as <file>-<volume>.warc.gz below folder (default: a new one in the shared folder); returns (file, volume,
    path, records, bytes) of each. A file is written under a name of its own and then renamed, so a repeated task replaces it."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    dealt = _dealt(small_batches(pages), file, counts, True)
    n = parts(pages.agg(F.sum(F.octet_length("html")).alias("b")).first()["b"] or 0, part_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, own, temporary, records, size = None, None, "", 0, 0

        def done() -> pd.DataFrame:
            out.close()
            name = f"{'=null' if own[0] is None else quote(str(own[0]), safe='').replace('%', '=')}-{own[1]}.warc.gz"  # no name but null's has = before n
            store.move(temporary, f"{base}/{name}")
            return pd.DataFrame([(*own, f"{folder}/{name}", records, size)], columns=["file", "volume", "path", "records", "bytes"])

        for batch in batches:
            for f, v, raw in zip(batch["file"], batch["volume"], batch["record"]):
                key = (None if pd.isna(f) else f, v)
                if key != own:
                    if out is not None:
                        yield done()
                    own, temporary, records, size = key, f"{base}/.{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(temporary, compression=None)
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(member.compress(raw) + member.flush())
                records, size = records + 1, size + len(raw)
        if out is not None:
            yield done()

    ordered = dealt.repartition(n, "file", "volume").sortWithinPartitions("file", "volume", "page_id", "url", "digest")
    made = ordered.select(F.col("file").cast("string"), "volume", "record").mapInPandas(run, "file string, volume long, path string, records long, bytes long")
    return written(made.withColumn("file", F.col("file").cast(dealt.schema["file"].dataType)), "warc-files")


class Pieces:
    """A stream's lines, long ones in pieces: `piece`, and whether it starts a line (`fresh`)."""

    def __init__(self, stream: io.BufferedIOBase, step: int):
        self.stream, self.step, self.piece = stream, step, b"\n"
        self.next()

    def next(self) -> None:
        self.fresh = self.piece.endswith(b"\n")
        self.piece = self.stream.readline(self.step)

    def body(self, left: int) -> Iterator[bytes]:
        """The next `left` bytes; a new line starts behind them."""
        while left and (piece := self.stream.read(min(self.step, left))):
            yield piece
            left -= len(piece)
        self.piece = b"\n"
        self.next()


def parse(stream: io.BufferedIOBase, step: int = 1 << 20) -> Iterator[tuple[int | None, int, int, str]]:
    """(page_id, offset, length, SHA-256 of all bytes) of each record of an uncompressed stream. Header lines of any length are
    read in pieces. What has no sound header is one record without page_id, up to the next line that says WARC/1.1."""
    at, offset = Pieces(stream, step), 0
    while at.piece:
        digest, length, found = sha256(), 0, {}

        def take(piece: bytes) -> None:
            nonlocal length
            digest.update(piece)
            length += len(piece)

        if at.fresh and at.piece == FIRST:
            take(at.piece)
            at.next()
            while at.piece and not (at.fresh and at.piece in (FIRST, b"\r\n")):
                for name, pattern in FIELDS.items():
                    if at.fresh and name not in found and (m := pattern.fullmatch(at.piece)):
                        found[name] = m[1]
                take(at.piece)
                at.next()
        sound = at.piece == b"\r\n" and len(found) == len(FIELDS)
        if sound:
            take(at.piece)
            for piece in at.body(int(found["size"]) + 4):
                take(piece)
        else:
            while at.piece and not (at.fresh and at.piece == FIRST and length):
                take(at.piece)
                at.next()
        yield int(found["page"]) if sound and found["page"] else None, offset, length, digest.hexdigest()
        offset += length


def read(files: DataFrame) -> DataFrame:
    """The rows of leaves() from the files that write() made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, v, path in zip(batch["file"], batch["volume"], batch["path"]):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as raw, gzip.GzipFile(fileobj=raw) as plain, io.BufferedReader(plain, 1 << 20) as stream:
                    out = pd.DataFrame(list(parse(stream)), columns=["page_id", *RANGE]).astype({"page_id": "Int64"})
                yield out.assign(file=pd.Series([f] * len(out), dtype=object), volume=v)[["file", "volume", "page_id", *RANGE]]

    n = parts(files.agg(F.sum("bytes").alias("b")).first()["b"] or 0, 24 << 20)
    found = files.repartition(n, "path").select(F.col("file").cast("string"), "volume", "path").mapInPandas(run, "file string, volume long, page_id long, offset long, length long, digest string")
    return found.withColumn("file", F.col("file").cast(files.schema["file"].dataType))


def _with_range(x: Column) -> Column:
    return F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["digest"])


def tree(leaf: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """(file, volume, node, offset, length, digest) of the nodes of each level: first a page_id's records, last the roots. Each
    level is written, and the next one is made from it."""
    below, found = leaf.select("file", "volume", F.col("page_id").alias("node"), F.struct(*RANGE).alias("range")), []
    for level in range(levels + 1):
        node = F.col("node") if level == 0 else F.lit(0).cast("long") if level == levels else F.shiftright("node", BITS)
        grouped = below.groupBy("file", "volume", node.alias("node")).agg(F.array_sort(F.collect_list("range")).alias("under"))
        text = F.array_join(F.transform("under", _with_range), "|")
        length = F.aggregate("under", F.lit(0).cast("long"), lambda a, x: a + x["length"])
        made = grouped.select("file", "volume", "node", F.struct(F.col("under")[0]["offset"].alias("offset"), length.alias("length"), F.sha2(text, 256).alias("digest")).alias("range"))
        below = written(made, f"merkle-{name}-{level}")
        found.append(below.select("file", "volume", "node", "range.*"))
    return found


def levels_for(left: DataFrame, right: DataFrame) -> int:
    """Levels above the leaves until one node covers all page_ids."""
    r = left.select("page_id").unionAll(right.select("page_id")).agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    return 1 if r["lo"] is None else 1 + (r["lo"] ^ r["hi"]).bit_length() // BITS if r["lo"] ^ r["hi"] >= 0 else 17


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records that differ between two replicas' leaves(): file, volume, page_id, and offset, length, digest of either side."""
    left, right = written(left, "merkle-left"), written(right, "merkle-right")
    levels, key = levels_for(left, right), ["file", "volume", "node"]
    sides = [tree(x, levels, name) for x, name in ((left, "left"), (right, "right"))]

    def same(a: str, b: str, columns: list[str]) -> Column:
        return F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in columns))

    wrong = None
    for level in range(levels, -1, -1):
        a, b = (x[level] for x in sides)
        if wrong is not None:
            parents = wrong.withColumnRenamed("node", "up").alias("p")
            up = F.lit(0).cast("long") if level == levels - 1 else F.shiftright("node", BITS)
            a, b = (x.withColumn("up", up).alias("x").join(parents, same("x", "p", ["file", "volume", "up"]), "left_semi").drop("up") for x in (a, b))
        met = a.alias("a").join(b.alias("b"), same("a", "b", key), "full").where("not (a.digest <=> b.digest and a.offset <=> b.offset and a.length <=> b.length)")
        wrong = written(met.selectExpr(*[f"case when a.digest is null then b.{k} else a.{k} end as {k}" for k in key]), "merkle-wrong")

    found, names = wrong.withColumnRenamed("node", "page_id").alias("w"), ["file", "volume", "page_id"]
    copy = F.row_number().over(Window.partitionBy(*names).orderBy("offset")).alias("copy")
    a, b = (x.alias("x").join(found, same("x", "w", names), "left_semi").select("*", copy) for x in (left, right))
    met = a.alias("a").join(b.alias("b"), same("a", "b", [*names, "copy"]), "full").where("not (a.digest <=> b.digest and a.offset <=> b.offset and a.length <=> b.length)")
    ranged = {s: f"case when {s}.digest is not null then sha2(concat_ws(':', cast({s}.offset as string), cast({s}.length as string), {s}.digest), 256) end" for s in "ab"}
    return met.selectExpr(
        *[f"case when a.digest is null then b.{k} else a.{k} end as {k}" for k in names], "a.offset", "a.length", f"{ranged['a']} as digest",
        "b.offset as right_offset", "b.length as right_length", f"{ranged['b']} as right_digest",
    )
