"""Trie of conversation prefixes with subtree totals by time-forward processing.

A conversation's turns are numbered 1, 2, ... and each prefix gets a key of 128 bits: the exclusive or of hashes of (number, turn)
over the prefix. That is a running sum, so a conversation of any length is cut into blocks of `BLOCK` turns which are summed apart,
and a carry runs over blocks; equal prefixes of different conversations meet in their key by one aggregation with map-side sums, however hot they are.

Subtree totals go from the deepest nodes to the root. Along a conversation, nodes with the same number of members have the same
members; such a *chain* is one unit, whose only way down is its last node, so trees have at most two chains for each conversation
whatever its length. A chain with n members lies in band log(n) by base `BAND`. Connected chains of one band are a *shard*: it
hangs from one root and is at most `BAND` chains wide. Shards of a band are dealt to tasks, and each task gets its chains sorted by shard
and reverse level by Spark's external sort: a chain takes from a priority queue what its children have sent, adds its own, and
sends the total forward in the order to its parent. The queue spills sorted runs to the task's private scratch files, like a sort. What shard roots
send is summed for each receiver before it is shuffled, and is in the inbox of the next bands' chains; there are as many rounds as bands (logarithm of the number
of conversations). Within a chain totals are running sums again.

Defined results: turns go by turn number, null first; ties by role, then by a digest of role and text. Null role or text is empty. Rows
without conv_id take no part; repeated rows are turns of their own. Columns beside these four are ignored. No conversation gives no node, else there is a root.
"""

from __future__ import annotations

import hashlib
import heapq
import marshal
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 4_096
BAND = 1_024
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]


def running(rows: DataFrame, keys: list[str], at: str, what: dict[str, tuple[Callable, Column]], add: Callable) -> DataFrame:
    """rows with columns of running totals along `at` (whole numbers from 0) within keys, split into blocks: name -> (aggregate
    function, value); `add` joins two totals. Only keys that reach a second block have a carry, a row for each block."""
    rows = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    local = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({k: f(v).over(local) for k, (f, v) in what.items()})
    blocks = rows.groupBy(*keys, "_block").agg(*[f(v).alias(f"_{k}") for k, (f, v) in what.items()], F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.where(f"_block > 0 or _n >= {BLOCK - 1}").withColumns({f"_{k}": f(F.col(f"_{k}")).over(before) for k, (f, _) in what.items()})
    both = summed.join(carry.where("_block > 0").drop("_n"), [*keys, "_block"], "left")
    return both.withColumns({k: F.when(F.col(f"_{k}").isNull(), F.col(k)).otherwise(add(F.col(k), F.col(f"_{k}"))) for k in what}).drop("_block", *[f"_{k}" for k in what])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, j, digest, words), j from 1 in each conversation. Texts are reduced to digest and number of words before anything is
    shuffled. Rows are dealt by ranges of (conversation, turn), so that one conversation may lie in many tasks, and numbered within a range."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["turn", "role", "digest"]
    dealt = written(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    pieces = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("conv", "part", F.sum("n").over(before).alias("before")).where("before > 0")  # at most one for each range
    local = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order))
    return dealt.join(F.broadcast(starts), ["conv", "part"], "left").select("conv", (local + F.coalesce("before", F.lit(0))).alias("j"), "digest", "words")


def rebuilt(own: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """(conv, i, digest, words, last): the first h turns of conversation c - c % group, then c's own after its first h, where
    h = crc32(c) % shared; i = 0 stands for the empty start of each conversation."""
    convs = own.groupBy("conv").agg(F.count("*").alias("len"))
    base = F.col("conv") - F.col("conv") % group
    convs = convs.select("conv", "len", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).alias("h"))
    held = convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len")).where(f"base % {group} = 0")
    hb = F.least("h", F.coalesce("base_len", F.lit(0)))
    convs = written(convs.join(held, "base", "left").select("conv", "base", "h", hb.alias("hb"), (hb + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")), "convs")
    first = own.where((F.col("conv") % group == 0) & (F.col("j") < shared)).withColumnRenamed("conv", "base")
    start = convs.select("conv", F.lit(0).cast("long").alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"), "total")
    taken = convs.join(first, "base").where("j <= hb").select("conv", F.col("j").alias("i"), "digest", "words", "total")
    kept = own.join(convs, "conv").where("j > h").select("conv", F.expr("j - h + hb").alias("i"), "digest", "words", "total")
    return start.unionByName(taken).unionByName(kept).select("conv", "i", "digest", "words", (F.col("i") == F.col("total")).alias("last"))


def paths(rows: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, words, last): the key of each prefix and of the one before it."""
    own = lambda *what: F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*what))
    rows = rows.withColumns({"e1": own("i", "digest"), "e2": own("digest", F.lit(1), "i")})
    keyed = running(rows, ["conv"], "i", {"k1": (F.bit_xor, F.col("e1")), "k2": (F.bit_xor, F.col("e2"))}, lambda a, b: a.bitwiseXOR(b))
    up = lambda k, e: F.when(F.col("i") > 0, F.col(k).bitwiseXOR(F.col(e)))
    return keyed.select("conv", F.col("i").alias("depth"), "k1", "k2", up("k1", "e1").alias("p1"), up("k2", "e2").alias("p2"), "words", "last")


def ends_digests(found: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): SHA-256 of the conversations that end at a node, ascending, comma-joined. Ranges of (node, conversation)
    make stretches of text of at most BLOCK ids; a node's stretches, few beside its ids, meet in one task as a stream."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, out = None, [], []
        schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for b in batches:
            for depth, k1, k2, conv in zip(*(b.column(c).to_pylist() for c in (*KEY, "conv"))):
                if own != (depth, k1, k2) or len(ids) == BLOCK:
                    if ids:
                        out.append((*own, ids[0], ",".join(map(str, ids))))
                    own, ids = (depth, k1, k2), []
                ids.append(conv)
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                out = []
        if ids:
            out.append((*own, ids[0], ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha, out = None, None, []
        schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())])
        for b in batches:
            for depth, k1, k2, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids"))):
                if own == (depth, k1, k2):
                    sha.update(b"," + ids.encode())
                else:
                    if own:
                        out.append((*own, sha.hexdigest()))
                    own, sha = (depth, k1, k2), hashlib.sha256(ids.encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                out = []
        if own:
            out.append((*own, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    pieces = found.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(stretches, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends string")


class SpillingQueue:
    """A priority queue of tuples. Beyond `most` in memory, the later half goes to a scratch file as a sorted run; runs are
    read back in pieces and merged as they come due. Scratch files are the task's own and vanish with it."""

    def __init__(self, most: int = 500_000, piece: int = 5_000):
        self.most, self.piece, self.heap, self.runs = most, piece, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.most:
            self.heap.sort()
            half = len(self.heap) // 2
            file = tempfile.TemporaryFile()
            for at in range(half, len(self.heap), self.piece):
                marshal.dump(self.heap[at : at + self.piece], file)
            file.seek(0)
            del self.heap[half:]
            self._advance(self._read(file))

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    piece = marshal.load(file)
                except EOFError:
                    return
                yield from piece

    def _advance(self, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, id(run), run))

    def pop_due(self, due: tuple) -> Iterator[tuple]:
        """Takes out, in order, what starts with `due`."""
        k = len(due)
        while True:
            run = bool(self.runs) and (not self.heap or self.runs[0][0] <= self.heap[0])
            head = self.runs[0][0] if run else self.heap[0] if self.heap else None
            if head is None or head[:k] != due:
                return
            if run:
                _, _, rest = heapq.heappop(self.runs)
                self._advance(rest)
            else:
                heapq.heappop(self.heap)
            yield head

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)


TOTALS = "depth long, k1 long, k2 long, n_children long, n_leaves long, below long, carried long"


def forward(most: int = 500_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Time-forward processing of chains sorted by shard and reverse level; see the module's text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(most), None
        schema = pa.schema([(c, pa.int64()) for c in ("depth", "k1", "k2", "n_children", "n_leaves", "below", "carried")])
        names = ("s0", "s1", "s2", "depth", "k1", "k2", "top", "q1", "q2", "own", "children", "leaves", "saved")
        for b in batches:
            out = []
            for s0, s1, s2, depth, k1, k2, top, q1, q2, own, children, leaves, saved in zip(*(b.column(c).to_pylist() for c in names)):
                if shard != (s0, s1, s2):
                    if queue:
                        raise RuntimeError(f"messages of shard {shard} have not been taken")
                    shard = (s0, s1, s2)
                for m in queue.pop_due((-depth, k1, k2)):
                    children, leaves, saved = children + 1, leaves + m[3], saved + m[4]
                leaves = leaves or 1
                out.append((depth, k1, k2, children, leaves, saved, saved + own))
                if top != s0:  # else it is the shard's root, whose message crosses shards
                    queue.push((1 - top, q1, q2, leaves, saved + own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
        if queue:
            raise RuntimeError(f"messages of shard {shard} have not been taken")

    return each


def chain_totals(chains: DataFrame, bands: int, most: int = 500_000) -> DataFrame:
    """Totals of each chain, band by band."""
    done = sent = None
    for band in range(bands):
        own = chains.where(F.col("band") == band)
        if sent is None:
            own = own.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            inbox = sent.groupBy(*KEY).agg(F.sum("one").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            own = own.join(inbox, KEY, "left").na.fill(0, ["children", "leaves", "saved"])
        own = own.repartition("s0", "s1", "s2").sortWithinPartitions("s0", "s1", "s2", F.desc("depth"), "k1", "k2")
        found = written(own.mapInArrow(forward(most), TOTALS), "totals")
        roots = chains.where((F.col("band") == band) & (F.col("top") == F.col("s0")) & (F.col("top") > 0)).join(found, KEY)
        message = roots.select((F.col("top") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.lit(1).cast("long").alias("one"), F.col("n_leaves").alias("leaves"), F.col("carried").alias("saved"))
        sent = message if sent is None else sent.unionByName(message)
        done = found if done is None else done.unionByName(found)
    return done


def trie(found: DataFrame, band: int = BAND, most: int = 500_000) -> DataFrame:
    """A row for each node of paths: conv (smallest member), depth, parent_conv, n_convs, n_children, n_leaves, saved, ends."""
    found = written(found, "paths")
    nodes = found.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = written(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "nodes")
    largest = nodes.agg(F.max("n_convs").alias("n")).first()["n"] or 0
    bands = 1
    while band**bands < largest:
        bands += 1
    level = sum(((F.col("n_convs") > band**k).cast("int") for k in range(1, bands)), F.lit(0))
    tops = found.select("conv", *KEY).join(nodes.select(*KEY, "n_convs"), KEY).groupBy("conv", level.alias("band")).agg(F.min(F.struct(*KEY)).alias("s"))
    key = F.struct("k1", "k2")
    chains = nodes.groupBy("conv", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("depth"), F.max_by(key, "depth").alias("k"), F.min_by(F.struct("p1", "p2"), "depth").alias("q"), F.sum("own").alias("own"),
    ).withColumn("band", level)
    chains = chains.join(tops, ["conv", "band"]).select("conv", "n_convs", "band", "top", "depth", "k.k1", "k.k2", F.col("q.p1").alias("q1"), F.col("q.p2").alias("q2"), "own", F.col("s.depth").alias("s0"), F.col("s.k1").alias("s1"), F.col("s.k2").alias("s2"))
    chains = written(chains, "chains")
    totals = chain_totals(chains, bands, most).drop("carried")
    above = nodes.select((F.col("depth") + 1).alias("top"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv").alias("above"))
    chains = chains.join(totals, KEY).join(above, ["top", "q1", "q2"], "left")
    chains = chains.select("conv", "n_convs", "top", F.col("depth").alias("bottom"), F.col("own").alias("chain_own"), "n_children", "n_leaves", "below", "above")
    placed = running(nodes, ["conv", "n_convs"], "depth", {"so_far": (F.sum, F.col("own"))}, lambda a, b: a + b).join(chains, ["conv", "n_convs"])
    return placed.join(ends_digests(found.where("last")), KEY, "left").select(
        "conv", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("above")).alias("parent_conv"), "n_convs",
        F.when(F.col("depth") < F.col("bottom"), F.lit(1).cast("long")).otherwise(F.col("n_children")).alias("n_children"), "n_leaves",
        (F.col("below") + F.col("chain_own") - F.col("so_far") + F.col("own")).alias("saved"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends"),
    )
