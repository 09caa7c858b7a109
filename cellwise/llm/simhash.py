"""Operator 7: SimHash near-duplicates by segment popcounts.

A fingerprint is embedded as the bit counts of 32 two-bit segments. The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints, so links lie within Manhattan
distance 4: a range join in 32 dimensions. Its grid: the segments form G groups, of which at most four can
differ within that distance, so two linked fingerprints have equal counts in some G - 4 groups. Each
fingerprint enters one cell for every choice of G - 4 groups; of the members of a cell, those within
Manhattan distance 4 are verified by their Hamming distance. G grows with the number of different
fingerprints (7 to 12), so that cells stay small; any G gives the same links.

Within a cell only a spanning forest of the links is kept: a search removes every member it reaches,
so a tight cluster costs about one comparison a member and never lists its pairs. Cells of more than
``CELL`` different fingerprints are left out of the cells and linked through midpoints: two
fingerprints differ in four bits or fewer exactly if some value is within two bits of both.

Null texts have no words, like empty ones: fingerprint zero. Very long texts are hashed whole. A null
doc_id takes part in links, but never names a component unless all of it is null. Rows that repeat a
doc_id each get a row. Other columns are left out, whatever their names. An empty table gives no rows.
``keep_one`` decides row by row, whatever the ids.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesview import mix
from .common import PART_BITS, ROW, SideTables, by_part, column, cut, numbered, only, release, slices
from .components import components

RADIUS, SHINGLE, SEED, CELL = 4, 4, 42, 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x5555555555555555)


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``width`` words; of all words if there are fewer; none if there is none."""
    words = text.encode().translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    hash_ = xxhash.xxh64_intdigest
    return np.fromiter((hash_(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of documents from the hashes of their shingles."""
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        flat = np.concatenate([hashes[i] for i in some])
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(counts[some]) - counts[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, fingerprint (as a signed long) and the ``keys``, which are longs, of every row."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                texts = column(piece, "text").fill_null("").to_pylist()
                fp = fingerprint([shingle_hashes(t) for t in texts])
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), pa.array(fp.view(np.int64)), *[column(piece, k) for k in keys]], names=["doc_id", "fp", *keys])

    casts = {"doc_id": "long", "text": "string"} | dict.fromkeys(keys, "long")
    return only(docs, **casts).mapInArrow(run, ", ".join(f"{k} long" for k in ("doc_id", "fp", *keys)))


def embedded(fp: np.ndarray) -> np.ndarray:
    """The bit counts (0 to 2) of the 32 two-bit segments, each in the place of its segment."""
    return (fp & _ODD) + ((fp >> np.uint64(1)) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of embeddings: counts differ by two where only the upper bit does, else by one or none."""
    both = a ^ b
    low = both & _ODD
    return np.bitwise_count(low) + 2 * np.bitwise_count((both >> np.uint64(1)) & _ODD & ~low)


def near_to(fp: np.ndarray, at: np.ndarray | np.uint64, radius: int = RADIUS) -> np.ndarray:
    """Which fingerprints link with ``at``: the bound first, then the exact distance."""
    near = manhattan(embedded(fp), embedded(at)) <= radius
    some = np.flatnonzero(near)
    other = at[some] if np.ndim(at) else at
    near[some] = np.bitwise_count(fp[some] ^ other) <= radius
    return near


def grid(n: int) -> int:
    """How many groups of segments suit ``n`` fingerprints: the least work in cells and comparisons."""

    def work(groups: int) -> float:
        cells, segments = comb(groups, RADIUS), 32 * (groups - RADIUS) / groups
        return cells * (50 * n + n * n * 0.375**segments)  # two segments have equal counts with 3/8

    return min(range(RADIUS + 3, RADIUS + 9), key=work)


def cell_keys(fp: np.ndarray, groups: int = 7) -> np.ndarray:
    """The grid cells of each fingerprint: hashes of a choice of groups and of its segment counts there."""
    counts, out = embedded(fp), []
    masks = [np.uint64(sum(3 << 2 * int(k) for k in g)) for g in np.array_split(np.arange(32), groups)]
    for n, chosen in enumerate(combinations(masks, groups - RADIUS)):
        mask = np.bitwise_or.reduce(chosen)
        # The choice goes where segments are left out, so that different cells have different keys.
        out.append(mix((counts & mask) ^ mix(np.full(len(fp), n + 1, np.uint64))).view(np.int64))
    return np.stack(out, 1)


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among different fingerprints."""
    left, a, b = fp, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = near_to(left, at, radius)
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), at))
                b.append(found)
                front.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _cell_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells of rows sorted by cell."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    group = np.repeat(np.arange(len(starts)), sizes)
    a, b = [], []
    small = np.repeat(sizes <= 32, sizes)
    rows = np.flatnonzero(small)
    k, f = group[rows], fp[rows]
    for shift in range(1, 32):
        same = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(same):
            break
        near = same[near_to(f[same], f[same + shift])]
        a.append(f[near])
        b.append(f[near + shift])
    for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        x, y = forest(fp[s : s + n])
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=_EDGE)


def _verify(batches):
    """Links of sorted cells; the rows of the last cell wait for the next batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.concatenate([key, column(batch, "key").to_numpy()])
        fp = np.concatenate([fp, column(batch, "fp").to_numpy().view(np.uint64)])
        done = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if done:
            yield _edges(*_cell_links(key[:done], fp[:done]))
            key, fp = key[done:], fp[done:]
    if len(key):
        yield _edges(*_cell_links(key, fp))


def _cells(groups: int):
    def run(batches):
        for batch in batches:
            fp = column(batch, "fp").to_numpy()
            for k in range(0, len(fp), 5000):
                part = fp[k : k + 5000]
                keys = cell_keys(part.view(np.uint64), groups)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]))], names=["key", "fp"])

    return run


def _midpoints(batches):
    bits = [np.uint64(1 << i) for i in range(64)]
    masks = np.array([0, *bits, *(x | y for x, y in combinations(bits, 2))], np.uint64)
    for batch in batches:
        fp = column(batch, "fp").to_numpy().view(np.uint64)
        for k in range(0, len(fp), 500):
            part = fp[k : k + 500]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["key", "fp"])


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (u, v) that connect exactly what links within the radius connect; ``fps`` is distinct."""
    cells = fps.select("fp").mapInArrow(_cells(grid(fps.count())), "key long, fp long")
    large = cut(cells.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell), "large-cells")
    hot = not large.isEmpty()
    if hot:
        cold = cells.join(large, "key", "left_anti")
    else:
        cold = cells
    edges = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "u long, v long")
    if hot:
        members = cells.join(large, "key", "left_semi").select("fp").distinct()
        points = members.mapInArrow(_midpoints, "key long, fp long")
        least = points.groupBy("key").agg(F.min("fp").alias("v"))
        edges = edges.unionByName(points.join(least, "key").select(F.col("fp").alias("u"), "v").where("u <> v").distinct())
    return edges


def rooted(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """``fps``, one row a fingerprint, with the ``root`` of its component, itself a fingerprint."""
    roots = components(links(fps, cell)).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of ``docs``."""
    prints = cut(fingerprints(docs), "fingerprints")
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct-fingerprints")
    joined = cut(rooted(fps, cell), "rooted")
    # Least ids are taken before the exchange; the join itself may split a component of very many fingerprints.
    named = cut(joined.groupBy("root").agg(F.min("doc").alias("component_id")), "named")
    classes = cut(joined.join(named, "root").select("fp", "component_id"), "classes")
    release(fps, joined, named)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for every component: that with the least doc_id.

    Rows are numbered, so each is judged by its own text: of rows that share the least doc_id of a
    component the first by number stays, and a row with a null doc_id stays only if all of the
    component's are null. Null texts, empty texts and texts without words have one fingerprint and so are
    copies of each other. All columns stay. An empty table gives no rows.
    """
    rows, names = numbered(docs), docs.columns
    prints = cut(fingerprints(rows, ROW), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)
    fps = cut(prints.groupBy("fp").agg(F.min(rank).alias("first")), "distinct-fingerprints")
    joined = cut(rooted(fps), "rooted")
    kept = joined.groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    tables = SideTables.write(kept.mapInArrow(by_part(ROW), "part long, data binary"), 1, "kept")
    release(prints, fps, joined)

    def keep(batches):
        part, own = None, None
        for batch in batches:
            row, stay = column(batch, ROW).to_numpy(), np.zeros(len(batch), bool)
            for p in np.unique(row >> PART_BITS).tolist():
                if p != part:
                    part, own = p, tables.of(p)[0]
                stay |= np.isin(row, own)
            yield batch.filter(pa.array(stay)).select(names)

    return rows.mapInArrow(keep, docs.schema)
