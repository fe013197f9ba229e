"""Packing of token sequences by minimum bin slack.

Whole windows of ``capacity`` ids are cut off each document; what remains (1 to capacity-1 ids) is packed. A window takes
the longest remaining piece, and a bitset subset-sum over the multiset of remaining lengths finds the fill closest to its
capacity; backtracking tells how many pieces of each length make it. A window that cannot be filled takes the longest
piece left and cuts it, and a group's last, short window is cut at powers of two, which need no padding.

Groups are ``group_tokens`` ids of one input partition, so packing needs no shuffle and bounded memory. Defined results:
null text is empty (its one id is the end id); repeated rows are packed each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import library_encoder, small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths (with repeats, as many as counts allow) whose sum is the largest up to capacity.

    Bit s of the bitset tells whether sum s can be reached. The states before each copy are kept for backtracking; the
    search ends as soon as capacity itself is reached.
    """
    mask, reach, states = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        for _ in range(min(counts[length], capacity // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            states.append((length, reach))
            reach = grown
            if reach >> capacity & 1:
                break
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(states):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in it, length): every unit of every item in exactly one piece, windows at most capacity."""
    by_length: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            by_length.setdefault(capacity, []).append((i, at))
            at += capacity
        if n > at:
            by_length.setdefault(n - at, []).append((i, at))
    windows = [[(i, at, capacity)] for i, at in by_length.pop(capacity, [])]
    counts = {n: len(v) for n, v in by_length.items()}

    def take(n: int) -> tuple[int, int, int]:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return (*by_length[n].pop(), n)

    while counts:
        seed = max(counts)
        chosen = [seed]
        counts[seed] -= 1
        rest = {n: c for n, c in counts.items() if c}
        chosen += best_fill(rest, capacity - seed)
        counts[seed] += 1
        slack = capacity - sum(chosen)
        times = min(counts[n] // chosen.count(n) for n in set(chosen)) if not slack else 1
        for _ in range(times):
            windows.append([take(n) for n in chosen])
        if slack and counts:
            i, at, n = take(max(counts))
            windows[-1].append((i, at, slack))
            by_length.setdefault(n - slack, []).append((i, at + slack))
            counts[n - slack] = counts.get(n - slack, 0) + 1
    if windows and (last := sum(p[2] for p in windows[-1])) < capacity:
        tail, pieces = windows.pop(), []
        room = 1 << last.bit_length() - 1
        for i, at, n in tail:
            while n:
                cut = min(n, room)
                pieces.append((i, at, cut))
                at, n, room, last = at + cut, n - cut, room - cut, last - cut
                if not room:
                    windows.append(pieces)
                    pieces, room = [], 1 << max(last.bit_length() - 1, 0)
    return windows


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, group_tokens: int = 4_000_000) -> DataFrame:
    """A row for each piece of each document of docs (doc_id, text); see SCHEMA and the module's text."""

    def group(ids: list, doc_ids: list, number: int) -> pd.DataFrame:
        rows = []
        base = (TaskContext.get().partitionId() << 42) + (number << 24)
        for s, window in enumerate(pack_lengths([len(x) // 4 for x in ids], capacity)):
            offset = 0
            for i, at, n in window:
                rows.append((doc_ids[i], at, n, zlib.crc32(ids[i][4 * at : 4 * (at + n)]), len(ids[i]) // 4, base + s, offset))
                offset += n
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = library_encoder(vocabulary, lower=True)
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, doc_ids, tokens, number = [], [], 0, 0
        for batch in batches:
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for key, one in zip(keys, encoder.texts(batch["text"]), strict=True):
                ids.append(one + end)
                doc_ids.append(key)
                tokens += len(one) // 4 + 1
                if tokens >= group_tokens:
                    yield group(ids, doc_ids, number)
                    ids, doc_ids, tokens, number = [], [], 0, number + 1
        if ids:
            yield group(ids, doc_ids, number)

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, SCHEMA)
