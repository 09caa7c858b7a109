"""Operator 1: suffix-array dedup, the collection's index built column by column.

The collections are made of the pieces of text whose keys occur twice or more (see windows.py), all
pieces of a key in one collection. Every round inserts the next symbol of each text, one byte, from its
end, into the Burrows-Wheeler transform of the collection, and updates the common prefixes of
neighbouring suffixes; transform and prefixes are read from one pair of files and written to another, in
order. Neighbours that share ``width`` bytes begin with equal windows, and the first place of such a
group is its least (doc_id, row, start).

Each window lies whole in one piece, so rounds are bounded by the piece length (less than 2 * width
bytes), not by the longest document. The files belong to the task that writes them and end with it.

Rows that share a doc_id, and rows without one, are documents of their own, in the order of their rows:
the first keeps what they share. Null and empty texts give zero counts. Other columns are left out,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, column, numbered, shuffles
from .windows import RowRuns, Spec, covered, fingerprints, repeated_keys

CHUNK = 1000


def columnwise_index(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform (0 ends a text) and the common prefixes (up to ``depth``).

    Text k has the symbols symbols[starts[k] + i], i < lengths[k], all above 0. Common prefix k is that of
    the suffixes at k - 1 and k.
    """
    m, rounds, kinds = len(lengths), int(lengths.max(initial=0)), (symbols.dtype, np.min_scalar_type(depth))
    files = [[tempfile.TemporaryFile(buffering=0) for _ in ("bwt", "lcp")] for _ in (0, 1)]  # noqa: SIM115

    def write(side: int, kind: int, values: np.ndarray) -> None:
        files[side][kind].seek(0)
        files[side][kind].write(values)

    def read(side: int, kind: int, size: int) -> np.ndarray:
        files[side][kind].seek(0)
        return np.fromfile(files[side][kind], kinds[kind], size)

    def symbol(k: np.ndarray, r: int) -> np.ndarray:
        """The symbol before the suffix of length r of each text k, 0 if there is none."""
        rest = lengths[k] - r
        out = symbols[starts[k] + np.maximum(rest - 1, 0)]
        out[rest < 1] = 0
        return out

    active = np.arange(m, dtype=np.int32)
    at, size = active, m
    write(0, 0, symbol(active, 0))
    write(0, 1, np.zeros(m, kinds[1]))
    for r in range(1, rounds + 1):
        bwt, lcp = read((r - 1) % 2, 0, size), read((r - 1) % 2, 1, size)
        going = lengths[active] >= r
        if not going.all():
            active, at = active[going], at[going]
        by_symbol = np.argsort(bwt, kind="stable")
        place = np.empty(size, np.int32)
        place[by_symbol] = np.arange(size, dtype=np.int32)
        k = place[at]
        new = k + (m - size + np.count_nonzero(bwt))
        # The neighbours with the same first symbol, and the least prefix on the way to each.
        padded = np.append(lcp, kinds[1].type(0))
        before, after = by_symbol[k - 1], by_symbol[np.minimum(k + 1, size - 1)]
        own = bwt[at]
        has_before = (k > 0) & (bwt[before] == own)
        has_after = (k + 1 < size) & (bwt[after] == own)
        low, high = _least(padded, before, at, has_before, depth), _least(padded, at, after, has_after, depth)
        size += len(new)
        old = np.ones(size, bool)
        old[new] = False
        out = np.empty(size, kinds[0])
        out[old] = bwt
        out[new] = symbol(active, r)
        write(r % 2, 0, out)
        out = np.empty(size, kinds[1])
        out[old] = lcp
        out[new] = low
        out[new[has_after] + 1] = high[has_after]
        write(r % 2, 1, out)
        at = new
    result = read(rounds % 2, 0, size), read(rounds % 2, 1, size)
    for pair in files:
        for f in pair:
            f.close()
    return result


def _least(lcp: np.ndarray, left: np.ndarray, right: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """1 + min(lcp[left + 1 : right + 1]) where ``which``, ``depth`` at most."""
    out = np.zeros(len(left), lcp.dtype)
    if which.any():
        order = np.argsort(left[which], kind="stable")
        a, b = left[which][order] + 1, right[which][order] + 1
        ranges = np.minimum.reduceat(lcp, np.stack([a, b], 1).ravel())[::2]
        value = np.empty(len(a), lcp.dtype)
        value[order] = np.minimum(ranges, depth - 1) + 1
        out[which] = value
    return out


def suffixes(bwt: np.ndarray, m: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the length of every suffix in order, by walking the transform backwards."""
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[by_symbol] = np.arange(len(bwt))
    step += m - (len(bwt) - np.count_nonzero(bwt))
    text, size = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    active = np.arange(m)
    at = active.copy()
    text[at], size[at] = active, 0
    for r in range(1, int(lengths.max(initial=0)) + 1):
        going = lengths[active] >= r
        active, at = active[going], step[at[going]]
        text[at], size[at] = active, r
    return text, size


def occurs_before(data: list[bytes], n: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, spec: Spec) -> np.ndarray:
    """Whether each window of each text has an equal window at a smaller (doc_id, row, start) in these texts."""
    width = spec.width
    symbols = np.frombuffer(b"".join(data), np.uint8) + np.uint8(1)  # no byte of UTF-8 is 255
    lengths = n + width - 1
    begins, slots = np.cumsum(lengths) - lengths, np.cumsum(n) - n
    # Places in order, as one number.
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((start[of] + np.arange(len(of)) - slots[of], row[of], doc[of]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    bwt, lcp = columnwise_index(symbols, begins, lengths, width)
    text, size = suffixes(bwt, len(n), lengths)
    group = np.cumsum(lcp < width)
    whole = size >= width
    text, size, group = text[whole], size[whole], group[whole]
    slot = slots[text] + lengths[text] - size
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    again = np.empty(len(order), bool)
    again[slot] = rank[slot] > np.repeat(np.minimum.reduceat(rank[slot], heads), np.diff(np.r_[heads, len(group)]))
    return again


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_KINDS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def suffix_dedup(docs: DataFrame, width: int = 100, keep_text: bool = False, limit: int | None = None) -> DataFrame:
    """Sizes and checksum of what is left of every document; with ``keep_text`` the bytes as well."""
    spec = Spec(False, width, width // 3)
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    buckets = 4 * shuffles(docs.sparkSession)
    keys = repeated_keys(fingerprints(rows, spec, buckets), buckets)
    tables = covered(rows, keys, spec, occurs_before, CHUNK, True, limit)

    def strip(batches):
        runs_of = RowRuns(tables)
        for batch in batches:
            out = []
            for row, doc_id, text in zip(*(column(batch, c).to_pylist() for c in (ROW, "doc_id", "text"))):
                data, runs = (text or "").encode(), runs_of(row)
                kept, at = [], 0
                for low, high in runs:
                    kept.append(data[at:low])
                    at = high
                left = b"".join([*kept, data[at:]]) if runs else data
                out.append((doc_id, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            names = list(_KINDS)[: 5 + keep_text]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, _KINDS[k]) for k, x in zip(names, zip(*out))], names=names)

    return rows.mapInArrow(strip, _OUT + (", kept binary" if keep_text else ""))
