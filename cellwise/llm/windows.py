"""Windows that occur again: the stages that suffix-array dedup and substring dedup share.

A window of ``width`` units (bytes or words) has an anchor: the place of the least hash among its runs
of ``anchor`` units, the leftmost if several are equal. Its key is the hash of the anchor with what lies
before it, if that is half of the rest of the window or more, or else with what comes after. Equal
windows have equal keys. Consecutive windows with one anchor and one side form a piece.

Three passes are made over the numbered rows, which are never shuffled:

1. every part's distinct keys are dealt out in sorted blocks; those seen twice go back to their parts;
2. pieces with such keys lend their texts, once for each different text of a group of rows; the texts of
   one key meet in a task, where a kernel tells which windows occur before;
3. the covered runs go back to their parts, where the operators strip them.

Texts arrive sorted by key and bytes, so copies stand together: each different text goes to the kernel
once, and its copies occur where it does. A key with more than ``limit`` different texts is split: its
windows are dealt out again, each by its own hash. So a key may have any number of places and of texts.

The order of places is that of (doc_id, row, unit), a null doc_id before all others. Rows that share a
doc_id are documents of their own: the first row counts as the earlier one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesview import Prefix, mix, spans
from .common import PART_BITS, ROW, SPACES, SideTables, column, cut, joined, packed, release, shuffles, slices, text_bytes

NULL_ID = -(2**63)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
SLICE, GROUP, LIMIT = 1 << 18, 16 << 20, 1000
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Spec:
    """What a window is made of."""

    words: bool
    width: int
    anchor: int


class Units:
    """The units of some texts: values, the texts' places in them, and the bytes behind."""

    def __init__(self, texts: pa.Array, words: bool):
        self.raw, offsets = text_bytes(texts)
        if words:
            self.starts, self.ends, self.firsts = spans(self.raw, offsets, IS_WORD)
            self.values = Prefix(self.raw, 2).runs(self.starts, self.ends)
        else:
            self.values, self.firsts = self.raw, offsets


def pieces(units: Units, spec: Spec) -> dict[str, np.ndarray]:
    """text, start, n (windows), key, at (place in the values) of all pieces."""
    values, firsts, width = units.values, units.firsts, spec.width
    count, rest = len(values) - width + 1, width - spec.anchor
    if count < 1:
        return {k: np.zeros(0, np.uint64 if k == "key" else np.int64) for k in ("text", "start", "n", "key", "at")}
    grams = Prefix(values).every(spec.anchor)
    # Hash above, place below: the least of a stretch names its leftmost place.
    low, have, span = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), 1, rest + 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: have - span], low[span - have :])
    anchor = (low[:count] & _LOW).astype(np.int64)
    left = anchor - np.arange(count) >= rest // 2
    edge = np.zeros(len(values) + 1, np.int32)
    np.add.at(edge, np.maximum(firsts[:-1], firsts[1:] - width + 1), 1)
    np.add.at(edge, firsts[1:], -1)
    valid = np.cumsum(edge)[:count] == 0
    tag = 2 * anchor + left
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (tag[1:] != tag[:-1])
    breaks, begin = np.flatnonzero(new | ~valid), np.flatnonzero(new)
    n = np.r_[breaks, count][np.searchsorted(breaks, begin) + 1] - begin
    text = np.searchsorted(firsts, begin, side="right") - 1
    at, side = anchor[begin], left[begin]
    lo = np.where(side, at - rest // 2, at)
    hi = np.where(side, at + spec.anchor, at + spec.anchor + rest - rest // 2)
    key = Prefix(values, 1).runs(lo, hi) ^ np.where(side, np.uint64(0), _LOW)
    return {"text": text, "start": begin - firsts[text], "n": n, "key": key, "at": begin}


def groups(batches, limit: int = GROUP):
    """(part, batches) of consecutive rows of one part, of about ``limit`` bytes of text."""
    waiting, size, now = [], 0, None
    for batch in batches:
        parts = column(batch, ROW).to_numpy() >> PART_BITS
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            for some in slices(batch.slice(a, b - a), "text", limit) if b > a else ():
                n = int(text_bytes(column(some, "text"))[1][-1])
                if waiting and (int(parts[a]) != now or size + n > limit):
                    yield now, waiting
                    waiting, size = [], 0
                now, size = int(parts[a]), size + n
                waiting.append(some)
    if waiting:
        yield now, waiting


def plain(rows: DataFrame) -> DataFrame:
    """What the passes read of numbered rows."""
    return rows.select(ROW, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_edges(buckets: int) -> np.ndarray:
    """The least key of every bucket but the first."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def fingerprints(rows: DataFrame, spec: Spec, buckets: int) -> DataFrame:
    """bucket, part, data: sorted distinct keys of a group of rows, and whether it has the key twice."""
    edges = bucket_edges(buckets)

    def run(batches):
        for part, some in groups(batches):
            found = [pieces(Units(column(s, "text"), spec.words), spec)["key"] for batch in some for s in slices(batch, "text", SLICE)]
            keys, times = np.unique(np.concatenate(found), return_counts=True)
            at = np.r_[0, np.searchsorted(keys, edges), len(keys)]
            full = np.flatnonzero(np.diff(at))
            data = [packed(keys[at[b] : at[b + 1]], times[at[b] : at[b + 1]] > 1) for b in full.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([part] * len(full), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "part", "data"])

    return plain(rows).mapInArrow(run, "bucket int, part long, data binary")


def by_bucket(batches):
    """(bucket, parts, blobs) of rows that are sorted by bucket."""
    now, parts, blobs = None, [], []
    for batch in batches:
        for bucket, part, data in zip(*(column(batch, c).to_pylist() for c in ("bucket", "part", "data"))):
            if bucket != now and blobs:
                yield now, parts, blobs
                parts, blobs = [], []
            now = bucket
            parts.append(part)
            blobs.append(data)
    if blobs:
        yield now, parts, blobs


def met(parts: list[int], blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their parts, and whether the key was seen twice."""
    arrays = [joined([b], 2) for b in blobs]
    keys = np.concatenate([a[0] for a in arrays]).view(np.uint64)
    of, twice = np.repeat(parts, [len(a[0]) for a in arrays]), np.concatenate([a[1] for a in arrays])
    order = np.argsort(keys, kind="stable")
    keys, of, twice = keys[order], of[order], twice[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[heads, len(keys)])
    return keys, of, np.repeat((sizes > 1) | (np.maximum.reduceat(twice, heads) > 0), sizes)


def shares(keys: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """(part, data): each part's sorted keys."""
    order = np.argsort(of, kind="stable")
    keys, of = keys[order], of[order]
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    data = [packed(np.unique(x)) for x in np.split(keys, heads[1:])] if len(heads) else []
    return pa.RecordBatch.from_arrays([pa.array(of[heads], pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])


def repeated_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """(part, data): the keys of each part that were seen twice or more anywhere."""

    def run(batches):
        for _, parts, blobs in by_bucket(batches):
            keys, of, often = met(parts, blobs)
            yield shares(keys[often], of[often])

    return dealt(blocks, buckets).mapInArrow(run, "part long, data binary")


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    return blocks.repartition(shuffles(blocks.sparkSession), "bucket").sortWithinPartitions("bucket")


#: Lent texts (kind 0): the least place of a text among its group of rows, the further places in that row
#: (``more``), and the text. Covered runs (kind 1): the part in ``row``, the runs in ``piece``.
LENT = "kind int, key long, doc_id long, row long, start long, n long, more binary, piece binary"
_LENT = pa.schema([("kind", pa.int32()), *[(k, pa.int64()) for k in ("key", "doc_id", "row", "start", "n")], ("more", pa.binary()), ("piece", pa.binary())])


def _runs_of(part: int, runs: list[np.ndarray]) -> pa.RecordBatch:
    key = int(mix(np.array([part], np.uint64))[0].view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((1, key, 0, part, 0, 0, b"", packed(*merged(*runs))), _LENT)], schema=_LENT)


def merged(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order, those of a row that meet or overlap made one."""
    if not len(row):
        return row, low, high
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    ids = np.cumsum(np.r_[0, row[1:] != row[:-1]])
    span = int(high.max()) + 1
    reach = np.maximum.accumulate(high + ids * span) - ids * span  # the furthest end so far in the row
    new = np.r_[True, (row[1:] != row[:-1]) | (low[1:] > reach[:-1])]
    heads = np.flatnonzero(new)
    return row[heads], low[heads], np.maximum.reduceat(high, heads)


def lend(rows: DataFrame, spec: Spec, keys: SideTables, within: bool) -> DataFrame:
    """The different texts of the pieces whose keys were seen twice, and what copies among them cover."""

    def run(batches):
        part, known = None, None
        for p, some in groups(batches):
            if p != part:
                part, known = p, np.sort(keys.of(p)[0].view(np.uint64))
            if not len(known):
                continue
            cols: list[list] = [[] for _ in range(6)]
            for batch in some:
                for s in slices(batch, "text", SLICE):
                    units = Units(column(s, "text"), spec.words)
                    found = pieces(units, spec)
                    at = np.minimum(np.searchsorted(known, found["key"]), len(known) - 1)
                    hit = np.flatnonzero(known[at] == found["key"])
                    if not len(hit):
                        continue
                    text, start, n, key, at = (found[c][hit] for c in ("text", "start", "n", "key", "at"))
                    end = at + n + spec.width - 1
                    a, b = (units.starts[at], units.ends[end - 1]) if spec.words else (at, end)
                    whole = units.raw.tobytes()
                    data = [whole[x:y] for x, y in zip(a.tolist(), b.tolist())]
                    if spec.words:
                        data = [b" ".join(d.split()) for d in data]
                    for c, v in zip(cols, (key.view(np.int64), column(s, "doc_id").to_numpy()[text], column(s, ROW).to_numpy()[text], start, n)):
                        c.append(v)
                    cols[5] += data
            if not cols[5]:
                continue
            key, doc, row, start, n = (np.concatenate(c) for c in cols[:5])
            order = np.lexsort((start, row, doc))
            data, head, more = cols[5], {}, {}
            rows_, docs_ = row.tolist(), doc.tolist()
            gone = []
            for i in order.tolist():
                first = head.setdefault(data[i], i)
                if first != i:
                    if within or rows_[first] != rows_[i]:
                        gone.append(i)
                    else:
                        more.setdefault(first, []).append(i)
            if gone:
                gone = np.asarray(gone)
                yield _runs_of(p, [row[gone], start[gone], start[gone] + n[gone] + spec.width - 1])
            kept = np.fromiter(head.values(), np.int64, len(head))
            others = [packed(start[more[i]]) if i in more else b"" for i in kept.tolist()]
            for k in range(0, len(kept), 5000):
                own = kept[k : k + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int32)), *[pa.array(v[own]) for v in (key, doc, row, start, n)], pa.array(others[k : k + 5000], pa.binary()), pa.array([data[i] for i in own.tolist()], pa.binary())], schema=_LENT)

    return plain(rows).mapInArrow(run, LENT)


#: A kernel gets texts, their windows, doc_ids, rows and starts; it says of each window whether it occurs before.
Kernel = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, Spec], np.ndarray]


class _Solver:
    """Texts sorted by key and content go in, covered runs and split windows come out."""

    def __init__(self, kernel: Kernel, spec: Spec, chunk: int, within: bool, limit: int, split: bool):
        self.kernel, self.spec, self.chunk, self.within, self.limit, self.split = kernel, spec, chunk, within, limit, split
        self.runs: list[list[np.ndarray]] = []
        self.crowded = None

    def cover(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.runs.append([row, low, high])

    def flush(self):
        """The runs found so far, by part."""
        if not any(len(r[0]) for r in self.runs):
            return
        row, low, high = (np.concatenate(x) for x in zip(*self.runs))
        self.runs = []
        order = np.argsort(row >> PART_BITS, kind="stable")
        row, low, high = row[order], low[order], high[order]
        heads = np.flatnonzero(np.r_[True, row[1:] >> PART_BITS != row[:-1] >> PART_BITS])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(row)]):
            yield _runs_of(int(row[a] >> PART_BITS), [row[a:b], low[a:b], high[a:b]])

    def copies(self, rows: pa.Table, which: np.ndarray) -> None:
        """All windows of these texts occur before."""
        if len(which):
            some = rows.take(which)
            for k, more in enumerate(some["more"].to_pylist()):
                if more:
                    start = joined([more], 1)[0]
                    self.cover(np.full(len(start), some["row"][k].as_py()), start, start + some["n"][k].as_py() + self.spec.width - 1)
            row, start, n = (some[c].to_numpy() for c in ("row", "start", "n"))
            self.cover(row, start, start + n + self.spec.width - 1)

    def solve(self, rows: pa.Table) -> None:
        """Whole keys. The only text of a key has no equal window in another one, and none in itself."""
        key = rows["key"].to_numpy()
        near = np.r_[False, key[1:] == key[:-1]]
        rows = rows.filter(pa.array(near | np.r_[near[1:], False])).combine_chunks()
        if not len(rows):
            return
        n, doc, row, start = (rows[c].to_numpy().astype(np.int64) for c in ("n", "doc_id", "row", "start"))
        again = self.kernel(rows["piece"].to_pylist(), n, doc, row, start, self.spec)
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        first = again & ~(np.r_[False, again[:-1]] & (k > 0))
        last = again & ~(np.r_[again[1:], False] & (k < n[of] - 1))
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        self.cover(row[of[a]], start[of[a]] + k[a], start[of[a]] + k[b] + self.spec.width)
        mores = rows["more"].to_pylist()
        for j in np.flatnonzero(np.fromiter(map(len, mores), np.int64, len(mores))).tolist():
            own = np.flatnonzero(of[a] == j)
            for s in joined([mores[j]], 1)[0].tolist() if len(own) else ():
                self.cover(np.full(len(own), row[j]), s + k[a[own]], s + k[b[own]] + self.spec.width)

    def different(self, rows: pa.Table) -> pa.Table:
        """The texts that differ, each at its least place; the windows of their copies all occur before.

        Without ``within``, copies in the row of that place stay.
        """
        if len(rows) < 2:
            return rows
        key, row, piece = rows["key"].to_numpy(), rows["row"].to_numpy(), rows["piece"].chunk(0)
        new = np.r_[True, (key[1:] != key[:-1]) | ~pc.equal(piece[1:], piece[:-1]).to_numpy(zero_copy_only=False)]
        if not self.within:
            new |= row == row[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        self.copies(rows, np.flatnonzero(~new))
        return rows.filter(pa.array(new)).combine_chunks()

    def windows(self, rows: pa.Table):
        """Each window as a text of its own (kind 2), under its own hash."""
        for batch in rows.to_batches(max_chunksize=500):
            data, n = column(batch, "piece").to_pylist(), column(batch, "n").to_numpy()
            out: list[tuple] = []
            units = Units(pa.array(data, pa.large_binary()), self.spec.words)
            hashes = Prefix(units.values, 1)
            mores = [joined([m], 1)[0] if m else np.zeros(0, np.int64) for m in column(batch, "more").to_pylist()]
            for j, (doc, row, start) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("doc_id", "row", "start")))):
                at = units.firsts[j] + np.arange(n[j])
                keys = mix(hashes.runs(at, at + self.spec.width) ^ np.uint64(1)).view(np.int64).tolist()
                a, b = (units.starts[at], units.ends[at + self.spec.width - 1]) if self.spec.words else (at, at + self.spec.width)
                base = int(units.starts[units.firsts[j]]) if self.spec.words else int(units.firsts[j])
                for k, (key, x, y) in enumerate(zip(keys, (a - base).tolist(), (b - base).tolist())):
                    out.append((2, key, doc, row, start + k, 1, packed(mores[j] + k) if len(mores[j]) else b"", data[j][x:y]))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _LENT)], schema=_LENT)

    def run(self, batches):
        self.open = None
        for batch in batches:
            runs = column(batch, "kind").to_numpy() == 1
            if runs.any():
                yield batch.filter(pa.array(runs))
                batch = batch.filter(pa.array(~runs))
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            if self.crowded is not None:
                more = rows["key"].to_numpy() == self.crowded
                yield from self.windows(rows.filter(pa.array(more)))
                rows = rows.filter(pa.array(~more))
            rows = self.different((rows if self.open is None else pa.concat_tables([self.open, rows])).combine_chunks())
            if not len(rows):
                continue
            key = rows["key"].to_numpy()
            edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
            done = 0
            while len(rows) - done > self.chunk:
                near = int(np.searchsorted(edges, done + self.chunk, side="right")) - 1
                stop = int(edges[near]) if edges[near] > done else int(edges[near + 1]) if near + 1 < len(edges) else 0
                if not stop:
                    break
                self.solve(rows.slice(done, stop - done))
                done = stop
            self.open = rows.slice(done)
            if self.split and len(rows) - int(edges[-1]) > self.limit:
                if done < edges[-1]:
                    self.solve(rows.slice(done, int(edges[-1]) - done))
                self.crowded = int(key[-1])
                yield from self.windows(rows.slice(int(edges[-1])))
                self.open = None
            if sum(len(r[0]) for r in self.runs) > 200_000:
                yield from self.flush()
        if self.open is not None and len(self.open):
            self.solve(self.open)
        yield from self.flush()


def solved(lent: DataFrame, spec: Spec, kernel: Kernel, chunk: int, within: bool, limit: int) -> tuple[DataFrame, DataFrame]:
    """(part, data): covered runs of units; and the table behind them, to be released."""

    def deal(df: DataFrame, split: bool) -> DataFrame:
        ordered = df.repartition(shuffles(df.sparkSession), "key").sortWithinPartitions("key", "piece", "doc_id", "row", "start")
        return ordered.mapInArrow(lambda batches: _Solver(kernel, spec, chunk, within, limit, split).run(batches), LENT)

    found = cut(deal(lent, True), "solved")
    runs, alone = found.where("kind = 1"), found.where("kind = 2")
    if not alone.isEmpty():
        runs = runs.unionByName(deal(alone, False).where("kind = 1"))
    return runs.select(F.col("row").alias("part"), F.col("piece").alias("data")), found


def covered(rows: DataFrame, keys: DataFrame, spec: Spec, kernel: Kernel, chunk: int, within: bool, limit: int | None = None) -> SideTables:
    """Row, low and high of the covered runs of units of every part, from the keys (part, data) seen twice.

    With ``within``, a window may repeat one of its own row.
    """
    known = SideTables.write(keys, 1, "keys")
    runs, found = solved(lend(rows, spec, known, within), spec, kernel, chunk, within, limit or LIMIT)
    out = SideTables.write(runs, 3, "runs")
    release(found)
    return out


class RowRuns:
    """The runs of one row after another, while a task reads its part."""

    def __init__(self, tables: SideTables):
        self.tables, self.part = tables, None

    def __call__(self, row: int) -> list[tuple[int, int]]:
        if row >> PART_BITS != self.part:
            self.part = row >> PART_BITS
            self.row, self.low, self.high = merged(*self.tables.of(self.part))
        a, b = np.searchsorted(self.row, [row, row + 1])
        return list(zip(self.low[a:b].tolist(), self.high[a:b].tolist()))
