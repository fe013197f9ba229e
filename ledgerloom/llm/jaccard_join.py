"""Exact n-gram Jaccard join by signature trees.

A text's set holds its distinct 5-word shingles. Texts of equal sets are one class. Two classes link at a Jaccard
similarity of 0.75 or more; components are returned.

Which classes may meet in a task follows from prefix filters. In any one global order of shingles, each class offers the first
n - ceil(0.75 n) + 1 + n // 8 of its n; two linked classes then share at least ``need`` = 1 + floor(0.75 n / 8) offered ones.
(1) In hash order, in the same pass that makes the sets, a class with fewer than ``need`` offered shingles that another class
offers is out. (2) Among the classes left, shingles are counted exactly and put in order of their counts, so that what
many texts share comes last; again classes with too few shared ones are out, and a class may leave out its need - 1 most
frequent ones, since two linked classes still meet in the rarest that they share. Classes that meet in a shingle make a
cluster, and so do clusters that share a class.

Clusters only deal classes out: a task gets whole clusters, about TREE classes in all, and one signature tree over all of them, in
order of size, decides which pairs link. Each node has the OR of its members'
token bitmaps, their size range and bitmap surplus; a dual traversal drops pairs of nodes whose sizes do not fit, whose
largest possible overlap (common bits plus surplus) is too small, or which one component holds already. What is left is
compared exactly, and a union-find keeps links that connect. So near copies cost about a comparison each, not one a pair.

Clusters above MEMBERS classes or SHINGLES are split: (a) parts by hash are joined; (b) what offers a common shingle but lies in
different components meets in blocks, by four members of each component; (c) what is still apart meets in full, blocks above
the bound as pairs of parts. (c) is complete, (a) and (b) leave little to it.

Shingles that meet in a task are joined there before they are sent, so a shingle that all texts hold is an entry for each
task. Sets are compared by 64-bit hashes, and a class is a 64-bit digest of its set. Defined results: null or blank text
has an empty set and links with nothing; null doc_ids take no part and keep a null component; of rows that share a doc_id
each has the component of its own text. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, parts, small_batches, text_bytes, written
from .components import components
from .shingles import chunks, sets

MEMBERS, SHINGLES = 4_000, 4_000_000  # bounds of a cluster, and of a block in a split one, that one task joins
FLUSH = 500_000  # entries that a task holds before it sends them
SURPLUS = 8  # a class offers n // SURPLUS shingles more than a prefix filter needs
LEAF, FAN = 8, 8
TREE = 2_000  # classes that one tree over several clusters has, about
LOW = np.uint64((1 << 32) - 1)


def class_of(own: np.ndarray) -> int:
    return int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def offered(n: int) -> int:
    return min(n, n - -(-3 * n // 4) + 1 + n // SURPLUS)


def need(n: int) -> int:
    """How many offered shingles a class of size n shares with any other that it links with, at least."""
    return 1 + (3 * n // 4) // SURPLUS


def needed(n: str) -> Column:
    return 1 + F.floor(F.floor(3 * F.col(n) / 4) / SURPLUS)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpack(entries: list[bytes], *types: str) -> list[np.ndarray]:
    """Columns of the given types from packed rows of them, end to end."""
    width, out = sum(np.dtype(t).itemsize for t in types), [[] for _ in types]
    for e in entries:
        n, at = len(e) // width, 0
        for column, t in zip(out, types):
            column.append(np.frombuffer(e, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(c) if c else np.zeros(0, dtype=t) for c, t in zip(out, types)]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each place starts a run of equal sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, dtype=bool)
    new = np.zeros(len(keys[0]) - 1, dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[True], new])


def _by_bucket(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (bucket, kind, packed columns) of the buckets that have any."""
    order = np.argsort(bucket, kind="stable")
    held, starts = np.unique(bucket[order], return_index=True)
    return [(int(b), kind, _pack(*(c[order[i:j]] for c in columns))) for b, i, j in zip(held, starts, [*starts[1:], len(order)])]


def _frame(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "entries"])


PACKED = "bucket long, kind int, entries binary"


def scan(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over all texts: rows (doc_id, class, n, null), and rows (null, class, n, hits) whose hits add up to how many
    of a class's offered shingles other classes offer, at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        tokens, classes, sizes, docs, count, seen = [], [], [], [], 0, set()

        def flush() -> pd.DataFrame:
            ids, valid, c, n = (np.array(x, dtype=t) for x, t in zip(zip(*docs), ("<i8", "u1", "<i8", "<i4")))
            out = _by_bucket((c.view("<u8") % np.uint64(buckets)).astype(np.int64), 1, ids, valid, c, n)
            if not tokens:
                return _frame(out)
            c, n = np.array(classes, dtype="<i8"), np.array(sizes, dtype="<i4")
            every, of = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            order = np.argsort(every)
            every, of = every[order], of[order]
            first = _runs(every)
            many = np.diff(np.append(np.flatnonzero(first), len(every)))
            alone = np.repeat(many == 1, many)
            hits = np.bincount(of[~alone], minlength=len(c)).astype("<i4")
            out += _by_bucket((c[hits > 0].view("<u8") % np.uint64(buckets)).astype(np.int64), 2, c[hits > 0], n[hits > 0], hits[hits > 0])
            sent = every[first]
            lonely = many == 1
            owner, size = np.where(lonely, c[of[first]], 0).astype("<i8"), np.where(lonely, n[of[first]], 0).astype("<i4")
            out += _by_bucket(((sent >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), 0, (sent & LOW).astype("<u4"), owner, size)
            return _frame(out)

        for batch in batches:
            rows = list(zip(batch["doc_id"], batch["text"]))
            for chunk in chunks(rows, lambda r: len(r[1]) if isinstance(r[1], str) else 0, 1_000_000):
                for (doc_id, _), s in zip(chunk, sets([t if isinstance(t, str) else None for _, t in chunk])):
                    c, valid = class_of(s), not pd.isna(doc_id)
                    docs.append((int(doc_id) if valid else 0, valid, c, len(s)))
                    if valid and len(s) and c not in seen:
                        seen.add(c)
                        tokens.append(s[: offered(len(s))])
                        classes.append(c)
                        sizes.append(len(s))
                        count += len(tokens[-1])
                if count >= FLUSH or len(docs) >= FLUSH:
                    yield flush()
                    tokens, classes, sizes, docs, count, seen = [], [], [], [], 0, set()
        if docs:
            yield flush()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = [[bytes(e) for e in rows["entries"][rows["kind"] == k]] for k in range(3)]
        token, c, n = _unpack(kinds[0], "<u4", "<i8", "<i4")
        order = np.lexsort((c, n, token))
        token, c, n = token[order], c[order], n[order]
        keep = _runs(token, n, c)
        token, c, n = token[keep], c[keep], n[keep].astype(np.int64)
        fits = (token[1:] == token[:-1]) & ((4 * n[:-1] >= 3 * n[1:]) | (n[:-1] == 0))
        lone = np.append(fits, False) | np.insert(fits, 0, False) if len(token) else np.zeros(0, dtype=bool)
        if len(token):  # a size of 0 tells that two classes of a task offer it
            starts = np.flatnonzero(_runs(token))
            known = np.repeat(n[starts] == 0, np.diff(np.append(starts, len(token))))
            lone = (lone | known) & (n > 0)
        hit, at, hits = np.unique(c[lone], return_index=True, return_counts=True)
        ids, valid, dc, dn = _unpack(kinds[1], "<i8", "u1", "<i8", "<i4")
        hc, hn, more = _unpack(kinds[2], "<i8", "<i4", "<i4")
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(np.concatenate([ids, np.zeros(len(hit) + len(hc), dtype="<i8")]), np.concatenate([valid == 0, np.ones(len(hit) + len(hc), dtype=bool)])),
            "class": np.concatenate([dc, hit, hc]), "n": np.concatenate([dn.astype(np.int64), n[lone][at], hn]),
            "hits": pd.arrays.IntegerArray(np.concatenate([np.zeros(len(ids), dtype=np.int64), hits, more]), np.concatenate([np.ones(len(ids), dtype=bool), np.zeros(len(hit) + len(hc), dtype=bool)])),
        })

    return docs.select("doc_id", "text").mapInPandas(run, PACKED).groupBy("bucket").applyInPandas(meet, "doc_id long, class long, n long, hits long")


class Links:
    """Union-find over the members of one task, starting from known components."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def bitmaps(own: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set: bit (hash mod width), width at least twice the largest set."""
    width = 1 << max(7, (2 * max(len(s) for s in own) - 1).bit_length())
    out = np.zeros((len(own), width // 64), dtype=np.uint64)
    for row, s in zip(out, own):
        bit = (s >> np.uint64(11)) & np.uint64(width - 1)
        np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def tree_links(own: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions whose sets link, enough of them to connect all that links do; labels are known components."""
    if len(own) == 2:
        return [(0, 1)] if labels[0] != labels[1] and similar(*own) else []
    links, found = Links(labels), []
    if len(set(labels)) < 2:
        return found
    order = sorted(range(len(own)), key=lambda i: (len(own[i]), labels[i]))
    sizes = np.array([len(own[i]) for i in order], dtype=np.int64)
    bits = bitmaps([own[i] for i in order])
    surplus = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = [(bits, sizes, sizes, surplus)]
    for width in [LEAF] + [FAN] * 20:
        b, lo, hi, extra = levels[-1]
        if len(b) == 1:
            break
        starts = np.arange(0, len(b), width)
        levels.append((np.bitwise_or.reduceat(b, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.maximum.reduceat(extra, starts)))
    root_of = np.array(order)

    def one_component(level: int) -> np.ndarray:
        """For each node the component that holds all its members, or -1."""
        roots = links.roots()[root_of]
        for width in ([LEAF] + [FAN] * 20)[:level]:
            starts = np.arange(0, len(roots), width)
            low, high = np.minimum.reduceat(roots, starts), np.maximum.reduceat(roots, starts)
            roots = np.where(low == high, low, -1)
        return roots

    def fits(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        b, lo, hi, extra = levels[level]
        one = one_component(level)
        ok = (4 * hi[i] >= 3 * lo[j]) & (4 * hi[j] >= 3 * lo[i]) & ~((one[i] == one[j]) & (one[i] >= 0) & ((i != j) | (level > 0)))
        i, j = i[ok], j[ok]
        most = np.concatenate([np.bitwise_count(b[i[k : k + 4096]] & b[j[k : k + 4096]]).sum(axis=1) for k in range(0, len(i), 4096)] or [np.zeros(0)]).astype(np.int64)
        ok[ok] = 7 * (most + np.minimum(extra[i], extra[j])) >= 3 * (lo[i] + lo[j])
        return ok

    def visit(level: int, i: np.ndarray, j: np.ndarray) -> None:
        ok = fits(level, i, j) & ((i != j) | (level > 0))
        i, j = i[ok], j[ok]
        if level == 0:
            for x, y in zip(i.tolist(), j.tolist()):
                x, y = order[x], order[y]
                a, b = links.find(x), links.find(y)
                if a != b and similar(own[x], own[y]):
                    links.parent[max(a, b)] = min(a, b)
                    found.append((x, y))
            return
        width, below = (LEAF if level == 1 else FAN), len(levels[level - 1][0])
        for k in range(0, len(i), 1024):
            a = (i[k : k + 1024, None] * width + np.arange(width)).repeat(width, axis=1)
            b = np.tile(j[k : k + 1024, None] * width + np.arange(width), (1, width))
            a, b = a.ravel(), b.ravel()
            inside = (a < below) & (b < below) & (a <= b)
            visit(level - 1, a[inside], b[inside])

    top = len(levels) - 1
    if top:
        visit(top, np.array([0]), np.array([0]))
    return found


def own_sets(rows: pd.DataFrame) -> tuple[list[int], list[np.ndarray]]:
    """Classes and sets of rows (class, text), each class once, in order; texts that are not of their row's class are left
    out (rows that share a doc_id)."""
    rows = rows.sort_values("class", kind="stable")
    classes, own = [], []
    for chunk in chunks(list(zip(rows["class"].tolist(), rows["text"].tolist())), lambda r: len(r[1]), 1_000_000):
        for (c, _), s in zip(chunk, sets([t for _, t in chunk])):
            if not (classes and classes[-1] == c) and class_of(s) == c:
                classes.append(c)
                own.append(s)
    return classes, own


def offers(texts: DataFrame, each: int, total: int, clusters: bool) -> DataFrame:
    """What classes of texts (class, text) offer when shingles are in order of their counts in texts.

    With clusters rows (a, b): classes that meet in a shingle, each with one of them; and rows (class, null) of classes that
    share enough. Else rows (token, class, n): offered shingles of two classes at least. ``total`` shingles are dealt to
    parts of about ``each``. A part asks for the counts of its distinct shingles and gets them, capped at 255, from buckets.
    """
    groups = parts(total, each)
    wide = np.uint64(groups)
    dealt = texts.select("class", "text").withColumn("part", F.pmod(F.xxhash64("class"), F.lit(groups))).repartition(F.col("part"))

    def keys_of(tokens: np.ndarray) -> np.ndarray:
        return (((tokens >> np.uint64(32)) % wide) << np.uint64(32)) | (tokens & LOW)

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        forget()
        every = np.sort(keys_of(np.concatenate([np.zeros(0, dtype=np.uint64), *own_sets(rows)[1]])))
        starts = np.flatnonzero(_runs(every))
        counts = np.minimum(np.diff(np.append(starts, len(every))), 255).astype("u1")
        keys = every[starts]
        return _frame(_by_bucket((keys >> np.uint64(32)).astype(np.int64), key[0], (keys & LOW).astype("<u4"), counts))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        entries = [bytes(e) for e in rows["entries"]]
        token, count = _unpack(entries, "<u4", "u1")
        order = np.argsort(token, kind="stable")
        starts = np.flatnonzero(_runs(token[order]))
        total = np.minimum(np.add.reduceat(count[order].astype(np.int64), starts), 255).astype("u1") if len(starts) else count
        out = np.zeros(len(token), dtype="u1")
        out[order] = np.repeat(total, np.diff(np.append(starts, len(token))))
        ends = np.cumsum([len(e) // 5 for e in entries])
        return pd.DataFrame({"part": rows["kind"].astype("int64"), "bucket": rows["bucket"], "counts": [x.tobytes() for x in np.split(out, ends[:-1])]})

    def offer(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        forget()
        classes, own = own_sets(rows)
        if not classes:
            return _frame([])
        known = np.frombuffer(b"".join(bytes(x) for x in answers.sort_values("bucket")["counts"]), dtype="u1")
        every = keys_of(np.concatenate(own))
        order = np.argsort(every)
        counts = np.zeros(len(every), dtype="u1")
        counts[order] = known[np.cumsum(_runs(every[order])) - 1]
        at, kept, keys = 0, [], []
        for i, s in enumerate(own):
            count, mine = counts[at : at + len(s)], every[at : at + len(s)]
            at += len(s)
            first = np.argsort(count, kind="stable")[: offered(len(s))]
            shared = first[count[first] > 1]
            least = need(len(s))
            if len(shared) >= least:
                kept.append(i)
                keys.append(mine[shared[: len(shared) - (least - 1)]])
        c = np.array([classes[i] for i in kept], dtype="<i8")
        if not len(c):
            return _frame([])
        key, of = np.concatenate(keys), np.repeat(np.arange(len(c)), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        if not clusters:
            n = np.array([len(own[i]) for i in kept], dtype="<i4")
            return _frame(_by_bucket((key >> np.uint64(32)).astype(np.int64), 0, (key & LOW).astype("<u4"), c[of], n[of]))
        first = _runs(key)
        lead = np.repeat(of[first], np.diff(np.append(np.flatnonzero(first), len(key))))
        pairs = np.unique((lead[~first].astype(np.int64) << 32) | of[~first])
        a, b = c[np.append(pairs >> 32, np.arange(len(c)))], c[np.append(pairs & ((1 << 32) - 1), np.arange(len(c)))]
        out = _by_bucket((a.view("<u8") % wide).astype(np.int64), 1, a, b)
        return _frame(out + _by_bucket((key[first] >> np.uint64(32)).astype(np.int64), 0, (key[first] & LOW).astype("<u4"), c[of[first]]))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = [[bytes(e) for e in rows["entries"][rows["kind"] == k]] for k in range(2)]
        token, c, *n = _unpack(kinds[0], "<u4", "<i8", *([] if clusters else ["<i4"]))
        order = np.lexsort((c, token))
        token, c = token[order], c[order]
        first = _runs(token)
        many = np.diff(np.append(np.flatnonzero(first), len(token)))
        if not clusters:
            keep = np.repeat(many > 1, many)
            bucket = int(rows["bucket"].iloc[0])
            return pd.DataFrame({"token": (bucket << 32) + token[keep].astype(np.int64), "class": c[keep], "n": n[0][order][keep].astype(np.int64)})
        lead = np.repeat(c[first], many)[~first]
        order = np.lexsort((c[~first], lead))
        lead, other = lead[order], c[~first][order]
        keep = _runs(lead, other)
        a, b = _unpack(kinds[1], "<i8", "<i8")
        return pd.DataFrame({"a": np.concatenate([a, lead[keep]]), "b": np.concatenate([b, other[keep]])})

    asked = dealt.groupBy("part").applyInPandas(ask, PACKED)
    answers = asked.groupBy("bucket").applyInPandas(answer, "part long, bucket long, counts binary")
    packed = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(offer, PACKED)
    return packed.groupBy("bucket").applyInPandas(meet, "a long, b long" if clusters else "token long, class long, n long")


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with ``maybe``: false for most rows whose doc_id is not in ids, true for all whose doc_id is.

    A bitmap of 2^25 hashed ids (4 MB at most, whatever the number of ids) is broadcast, so rows need not be shuffled to tell.
    """
    place, bucket, bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 25)).alias("place"), F.expr("bitmap_bucket_number(place)"), F.expr("bitmap_bit_position(place)")
    maps = ids.select(place).groupBy(bucket.alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))).cast("int") % 2 == 1
    joined = docs.withColumn("place", place).join(F.broadcast(maps), bucket == F.col("bucket"), "left")
    return joined.select(*[F.col(c) for c in docs.columns], F.coalesce(on, F.lit(False)).alias("maybe"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not in ids (null ids stay): only rows that the bitmap marks are shuffled for the exact answer."""
    rows = marked(docs, ids)
    unsure = rows.where("maybe").drop("maybe")
    return rows.where("not maybe").drop("maybe").unionByName(unsure.join(ids.distinct(), "doc_id", "left_anti").select(*docs.columns))


def _join_clusters(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, component) of members (class, n, cluster) whose clusters are within the bounds. A bucket holds whole clusters, about
    TREE classes or SHINGLES // 8 shingles of them, and one tree over all its classes decides which of them link."""
    total = members.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    bucket = F.pmod(F.xxhash64("cluster"), F.lit(max(parts(total["n"] or 0, SHINGLES // 8), parts(total["rows"], TREE)))).alias("bucket")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        classes, own = own_sets(rows)
        links = Links(list(range(len(own))))
        for x, y in tree_links(own, list(range(len(own)))) if len(own) > 1 else ():
            a, b = links.find(x), links.find(y)
            links.parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"class": classes, "component": [classes[r] for r in links.roots().tolist()]}).astype("int64")

    filled = members.select("class", bucket).join(texts, "class").select("bucket", "class", "text")
    return filled.groupBy("bucket").applyInPandas(run, "class long, component long")


def _join_blocks(members: DataFrame, texts: DataFrame, whole: bool) -> DataFrame:
    """Joins each (block, part) of members (block, part, class, n, component): edges (a, b), or with whole each (class, component).

    Blocks with the same smallest class, which mostly have the same members, go to one bucket (to several, if they are too
    many), and a class's text once to each of its buckets.
    """
    size = members.groupBy("block", "part").agg(F.min("class").alias("lead"), F.sum("n").alias("size"))
    share = size.groupBy("lead").agg(F.ceil(F.sum("size") / (4 * SHINGLES)).alias("shares"))
    total = members.agg(F.sum("n").alias("n")).first()["n"] or 0
    bucket = F.pmod(F.xxhash64("lead", F.when(F.col("shares") > 1, F.pmod(F.xxhash64("block", "part"), F.col("shares"))).otherwise(0)), F.lit(parts(total, SHINGLES // 4)))
    members = members.join(size.join(share, "lead").select("block", "part", bucket.alias("bucket")), ["block", "part"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known = {c: (label, its) for c, label, its in zip(rows["class"].tolist(), rows["component"].tolist(), rows["blocks"].tolist())}
        classes, own = own_sets(rows)
        labels, blocks = [known[c][0] for c in classes], {}
        for i, c in enumerate(classes):
            for b in known[c][1]:
                blocks.setdefault((b["block"], b["part"]), []).append(i)
        links, edges = Links(labels), []
        for _, members in sorted(blocks.items()):
            for x, y in tree_links([own[i] for i in members], [links.find(i) for i in members]) if len(members) > 1 else ():
                a, b = links.find(members[x]), links.find(members[y])
                if a != b:
                    links.parent[max(a, b)] = min(a, b)
                    edges.append((labels[a], labels[b]))
        if not whole:
            return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")
        return pd.DataFrame({"a": np.array(classes, dtype=np.int64), "b": np.array([classes[r] for r in links.roots()], dtype=np.int64)})

    packed = members.groupBy("bucket", "class").agg(F.min("component").alias("component"), F.collect_list(F.struct("block", "part")).alias("blocks"))
    filled = packed.join(texts, "class").select("bucket", "class", "component", "blocks", "text")
    return filled.groupBy("bucket").applyInPandas(run, "a long, b long")


def _sized(rows: DataFrame) -> DataFrame:
    """rows (block, class, n, component) with how many parts their block makes."""
    size = rows.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("long").alias("many"), F.count("*").alias("rows")).where("rows > 1")
    return rows.join(size.drop("rows"), "block")


def _apart(multi: DataFrame, component: DataFrame) -> DataFrame:
    """(block, class, n, component) of the blocks (token, class, n) that have more than one component; of blocks alike one."""
    rows = multi.join(component, "class").withColumnRenamed("token", "block")
    alike = rows.groupBy("block").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("hash"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return rows.join(alike.groupBy("rows", "hash").agg(F.min("block").alias("block")).select("block"), "block", "left_semi")


def _join_split(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, component) of members (class, n, cluster, many) whose clusters are above the bounds: see the module's text."""
    texts = written(texts.join(members.select("class"), "class", "left_semi"), "jaccard-split-texts")
    whole = members.select(F.col("cluster").alias("block"), F.pmod(F.xxhash64("class"), F.col("many")).alias("part"), "class", "n", F.col("class").alias("component"))
    component = written(_join_blocks(whole, texts, True).select(F.col("a").alias("class"), F.col("b").alias("component")), "jaccard-split-parts")
    total = members.agg(F.sum("n").alias("n")).first()["n"]
    multi = written(offers(texts, SHINGLES // 4, total, False), "jaccard-split-offers")
    few = F.row_number().over(Window.partitionBy("block", "component").orderBy(F.xxhash64("class", "block")))
    for complete in (False, True):
        across = _apart(multi, component)
        if not complete:
            across = across.withColumn("k", few).where("k <= 4").drop("k")
        across = written(across, "jaccard-split-apart")
        if across.isEmpty():
            break
        own = F.pmod(F.xxhash64("class"), F.col("many"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))
        dealt = _sized(across).withColumn("own", own).withColumn("other", other).withColumn("part", F.least("own", "other") * F.col("many") + F.greatest("own", "other"))
        merged = components(_join_blocks(written(dealt, "jaccard-split-dealt"), texts, False)).withColumnRenamed("component", "into")
        component = written(component.join(merged, F.col("component") == F.col("node"), "left").select("class", F.coalesce("into", "component").alias("component")), "jaccard-split-component")
    return component


def join(docs: DataFrame, bucket_bytes: int = 24 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text); see the module's text."""
    docs = small_batches(docs).select("doc_id", "text")
    scanned = written(scan(docs, parts(text_bytes(docs), bucket_bytes)), "jaccard-scan")
    rows = scanned.where("hits is null").select("doc_id", "n", "class")
    lead = written(rows.where("doc_id is not null and n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "jaccard-classes")
    enough = scanned.where("hits is not null").groupBy("class").agg(F.sum("hits").alias("hits"), F.max("n").alias("n")).where(F.col("hits") >= needed("n")).select("class")
    wanted = written(lead.join(enough, "class", "left_semi"), "jaccard-wanted")
    texts = written(wanted.join(marked(docs, wanted).where("maybe").drop("maybe"), "doc_id").select("class", "text"), "jaccard-texts")
    total = wanted.agg(F.sum("n").alias("n")).first()["n"] or 0

    met = written(offers(texts, SHINGLES // 4, total, True), "jaccard-met")
    able = met.where("a = b").select(F.col("a").alias("class")).distinct()
    cluster = components(met.where("a <> b"))
    members = able.join(cluster, F.col("class") == F.col("node")).join(wanted, "class").select("class", "n", F.col("component").alias("cluster"))
    size = members.groupBy("cluster").agg(F.count("*").alias("rows"), F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("long").alias("many")).where("rows > 1")
    members = written(members.join(size.drop("rows"), "cluster"), "jaccard-members")
    component = _join_clusters(members.where("many = 1"), texts)
    split = members.where("many > 1")
    if not split.isEmpty():
        component = component.unionAll(_join_split(split, texts))
    component = written(component, "jaccard-component")

    ids = lead.withColumnRenamed("doc_id", "lead").join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = ids.groupBy("component").agg(F.min("lead").alias("component_id"))
    named = ids.join(smallest, "component").select(F.col("class").alias("of"), "component_id")
    out = rows.join(named, (F.col("class") == F.col("of")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


__all__ = ["join", "marked", "offers", "scan", "tree_links", "without"]
