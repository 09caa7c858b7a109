"""Operator 6: best-two-fit packing of token sequences.

Pieces of equal length are interchangeable, so the packing is planned on the histogram of piece
lengths (at most ``capacity`` counts, whatever the corpus) and the plan is one list of bin patterns
with multiplicities. Bins are filled greedily, largest piece that fits first; then a bin's smallest
piece gives way to two unpacked pieces that fill the widened gap more tightly. Pieces find their
place by their rank among pieces of their length: ranks are counted per written partition and
shifted by counts per (partition, length), which go to the tasks that read the partition, so no task
holds all pieces of a hot length and nothing is broadcast but the plan.

Null texts are empty (the end id alone). Rows with equal doc_id, or without one, are packed each on its
own, and ties between pieces of one length do not change how many sequences there are. Very long texts
are cut as the contract says. Other columns are left out, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SideTables, column, cut, only, packed, release, slices
from .tokens import encoder

CAPACITY, _RANK_BITS = 2048, 48
#: Runs of text that a worker remembers from task to task, where it is to remember them.
RUNS = 1_000_000


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths of a bin) and how many bins use each.

    A pattern is used as often as the counts allow, so every round empties a length: the number of
    patterns is bounded by the number of distinct lengths, not of pieces.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    keys = sorted(left)
    plan = []
    while keys:
        bin_, gap, used = [], capacity, Counter()

        def largest(limit: int) -> int | None:
            i = bisect.bisect_right(keys, limit) - 1
            while i >= 0 and used[keys[i]] >= left[keys[i]]:
                i -= 1
            return keys[i] if i >= 0 else None

        while gap and (size := largest(gap)) is not None:
            bin_.append(size)
            used[size] += 1
            gap -= size
        if gap and len(bin_) > 1:
            small = bin_[-1]
            used[small] -= 1
            best = (small, None)
            for a in keys[bisect.bisect_left(keys, (small + 1) // 2) : bisect.bisect_left(keys, gap + small)]:
                if used[a] >= left[a]:
                    continue
                used[a] += 1
                b = largest(min(a, gap + small - a))
                used[a] -= 1
                if b is not None and a + b > best[0]:
                    best = (a + b, (a, b))
                    if a + b == gap + small:
                        break
            bin_.pop()
            bin_ += best[1] or (small,)
            for size in best[1] or (small,):
                used[size] += 1
        own = Counter(bin_)
        times = min(left[k] // n for k, n in own.items())
        plan.append((tuple(bin_), times))
        for k, n in own.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                keys.remove(k)
    return plan


def plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, last rank, first bin, pieces of that length in a bin, which of them, offset)."""
    rows, taken, bins = [], Counter(), 0
    for pattern, times in plan:
        own, offset, seen = Counter(pattern), 0, Counter()
        for size in pattern:
            rows.append((size, taken[size], taken[size] + own[size] * times - 1, bins, own[size], seen[size], offset))
            seen[size] += 1
            offset += size
        for size, n in own.items():
            taken[size] += n * times
        bins += times
    return rows


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, remember: bool) -> DataFrame:
    """Pieces of every document with their rank (``place``) among equal lengths of the partition."""

    def encode(batches):
        tokens = encoder(tokenizer_path, RUNS) if remember else encoder(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                rows = []
                ids, ends = tokens.with_end(column(some, "text"), end_id)
                data = memoryview(ids.astype("<u4").view(np.uint8))
                ends = ends.tolist()
                for doc_id, low, high in zip(column(some, "doc_id").to_pylist(), [0, *ends], ends):
                    for k, start in enumerate(range(low, high, capacity)):
                        stop = min(start + capacity, high)
                        rows.append((doc_id, k, start - low, stop - start, zlib.crc32(data[4 * start : 4 * stop]), part, seen[stop - start]))
                        seen[stop - start] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PIECES)], schema=_PIECES)
        if not remember:
            tokens.forget()

    return only(docs, doc_id="long", text="string").mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, remember: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each is packed at.

    Workers that ``remember`` encode faster but keep ``RUNS`` runs, memory that later stages lack.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id, remember), "pieces")
    per_part = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length = Window.partitionBy("length").orderBy("part")
    shifts = per_part.select("part", F.struct("length", (F.sum("n").over(by_length) - F.col("n")).alias("before")).alias("shift"))
    tables = SideTables.write(shifts.groupBy("part").agg(F.collect_list("shift").alias("shifts")).mapInArrow(_shifts, "part long, data binary"), 2, "shifts")
    release(per_part)
    # At most a few times the capacity, however many pieces there are.
    slots = np.array(sorted((size, low, nth, high, first, own, offset) for size, low, high, first, own, nth, offset in plan_rows(plan_bins(histogram, capacity))), np.int64).reshape(-1, 7)
    keys = (slots[:, 0] << _RANK_BITS) | slots[:, 1]

    def place(batches):
        own, before = None, None
        for batch in batches:
            part, length, rank = (column(batch, c).to_numpy().astype(np.int64) for c in ("part", "length", "place"))
            rank = rank.copy()
            for p in np.unique(part).tolist():
                if p != own:
                    own, before = p, np.zeros(capacity + 1, np.int64)
                    sizes, counts = tables.of(p)
                    before[sizes] = counts
                rank[part == p] += before[length[part == p]]
            # The last slots that begin at or before the rank; those of one begin follow one another.
            at = np.searchsorted(keys, (length << _RANK_BITS) | rank, side="right") - 1
            group = np.searchsorted(keys, keys[at])
            nth = (rank - slots[group, 1]) % slots[group, 5]
            row = slots[group + nth]
            sequence = row[:, 4] + (rank - row[:, 1]) // row[:, 5]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(row[:, 6])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _shifts(batches):
    for batch in batches:
        data = [packed(*(np.array([s[k] for s in own], np.int64) for k in ("length", "before"))) for own in column(batch, "shifts").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "part").cast(pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])
