"""Operator 5: benchmark decontamination with suffix arrays of the training text.

Every shard of documents gets a suffix array over its words, ordered to the depth of a window. Each
test suffix (a 13-word window of an item, or a whole shorter item) is looked up by binary search,
which gives all its verbatim places; hashes order the words and the bytes of every match are compared.
Matches that go on word by word are followed to their ends: the longest one of a document is given with
its place there and in the item.

The items are dealt into blocks of about ``BLOCK_BYTES`` of text, written to the shared folder. A task
builds the array of a shard once and looks up one block after another, so the documents are read once
however many items there are, and memory holds one shard and one block (or the longest single text).

Null texts have no words: null documents are clean, items with a null text match nothing. Items with a
null item_id are searched like all others; in n_items they count as one item, in items_sha256 they have
no name. Repeated items count once. Every row of ``docs`` gives a row, whatever its doc_id. Of several
longest matches the first in the document counts, and the least item name. Other columns are left out,
whatever their names. Empty tables: no rows, or only clean ones.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesview import Prefix, same_bytes, spans
from .common import column, only, open_fs, shared_dir, shuffles, slices, text_bytes

WINDOW, BLOCK_BYTES, SHARD_BYTES = 13, 4 << 20, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


class Words:
    """The lower-cased words of texts: bytes, places, and hashes with a zero after each text."""

    def __init__(self, texts: pa.Array):
        raw, offsets = text_bytes(texts)
        self.raw = _LOWER[raw]
        self.starts, self.ends, self.firsts = spans(self.raw, offsets, IS_WORD)
        self.n = np.diff(self.firsts)
        hashes = np.maximum(Prefix(self.raw).runs(self.starts, self.ends), np.uint64(1))
        # Word k of text t stands at k + t; position firsts[t+1] + t holds the zero that ends the text.
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(hashes)) + self.text
        self.sequence = np.zeros(len(hashes) + len(self.n) + WINDOW, np.uint64)
        self.sequence[self.place] = hashes
        self.text_at = np.repeat(np.arange(len(self.n)), self.n + 1)


class TestWindows:
    """The distinct windows of some items, compared by their bytes, and where the items have them."""

    def __init__(self, item_ids: list[str | None], texts: list[str | None], width: int = WINDOW):
        self.words = Words(pa.array(texts, pa.large_string()))
        w, item, nth, length = self.words, [], [], []
        for t, n in enumerate(w.n.tolist()):
            count = n - width + 1 if n > width else min(n, 1)
            item.append(np.full(count, t))
            nth.append(np.arange(count))
            length.append(np.full(count, min(n, width)))
        self.item_ids = item_ids
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.item, self.nth, length = join(item), join(nth), join(length)
        at = w.firsts[self.item] + self.item + self.nth
        # Words are numbered by their bytes, so different windows stay apart even if their hashes agree.
        numbers: dict[bytes, int] = {}
        raw, ids = w.raw.tobytes(), np.zeros(len(w.sequence), np.int64)
        ids[w.place] = [numbers.setdefault(raw[x:y], len(numbers) + 1) for x, y in zip(w.starts.tolist(), w.ends.tolist())]
        grid = ids[at[:, None] + np.arange(width)]
        grid[np.arange(width) >= length[:, None]] = 0
        _, first, of = np.unique(grid, axis=0, return_index=True, return_inverse=True) if len(at) else (grid, at, at)
        self.of = of.ravel()  # the distinct window of every window of every item
        self.length, self.at = length[first], at[first]
        self.grid = w.sequence[self.at[:, None] + np.arange(width)]
        self.grid[np.arange(width) >= self.length[:, None]] = 0
        pairs = np.unique(np.stack([self.of, self.item], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(self.grid) + 1))


def suffix_array(sequence: np.ndarray, n: int, depth: int = WINDOW) -> np.ndarray:
    """Positions 0..n-1 ordered by the ``depth`` values from each on (ties in any order)."""
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    have = 1
    order = np.argsort(rank[:n], kind="stable")
    while have < depth:
        step = min(have, depth - have)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        key = rank * (rank.max() + 1) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(len(key), np.int64)
        sorted_ = key[order]
        fresh[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
        rank, have = fresh, have + step
    return order[order < n] if len(order) > n else order


def lookup(sequence: np.ndarray, order: np.ndarray, grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix the range of the suffix array that begins with it."""
    cols = np.arange(grid.shape[1])
    used = cols < length[:, None]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(grid), np.int64), np.full(len(grid), len(order))
        while len(act := np.flatnonzero(lo < hi)):
            mid = (lo[act] + hi[act]) // 2
            have = sequence[order[mid][:, None] + cols]
            differ = (have != grid[act]) & used[act]
            first = differ.argmax(1)
            any_ = differ[np.arange(len(act)), first]
            below = np.where(any_, have[np.arange(len(act)), first] < grid[act][np.arange(len(act)), first], upper)
            lo[act] = np.where(below, mid + 1, lo[act])
            hi[act] = np.where(below, hi[act], mid)
        return lo

    return bound(False), bound(True)


def matches(docs: Words, test: TestWindows, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(test window, position in the documents' sequence) of every verbatim place; ``order``: the suffix array."""
    if order is None or not len(test.grid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = lookup(docs.sequence, order, test.grid, test.length)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    at = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    # Hashes agree; now the bytes of each word, every distinct pair of words once.
    length = test.length[window]
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    pair = np.repeat(np.arange(len(window)), length)
    ours, theirs = at[pair] + within, test.at[window][pair] + within
    ours, theirs = ours - docs.text_at[ours], theirs - test.words.text_at[theirs]
    key, back = np.unique(ours * len(test.words.starts) + theirs, return_inverse=True)
    i, j = key // max(1, len(test.words.starts)), key % max(1, len(test.words.starts))
    size = docs.ends[i] - docs.starts[i]
    equal = size == test.words.ends[j] - test.words.starts[j]
    equal[equal] = same_bytes(docs.raw, docs.starts[i[equal]], test.words.raw, test.words.starts[j[equal]], size[equal])
    good = np.logical_and.reduceat(equal[back], np.cumsum(length) - length) if len(window) else np.zeros(0, bool)
    return window[good], at[good]


def longest(ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """For each place of ``ours`` the length of the longest run that stands in ``theirs`` too.

    Zeros separate and match nothing. Both are sorted as suffixes of one sequence, by doubling; the best
    partner of a suffix is the next one of ``theirs`` before or after it.
    """
    both = np.concatenate([theirs, [0], ours, [0]]).astype(np.int64)
    both[both == 0] = -np.arange(1, np.count_nonzero(both == 0) + 1)
    ranks = [np.unique(both, return_inverse=True)[1].astype(np.int64)]
    while (step := 1 << len(ranks) - 1) < len(ours):
        ahead = np.zeros_like(both)
        ahead[:-step] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (len(both) + 1) + ahead, return_inverse=True)[1].astype(np.int64))
        if ranks[-1].max() == len(both) - 1:
            break
    order = np.argsort(ranks[-1], kind="stable")
    spots = np.arange(len(order))
    before = np.maximum.accumulate(np.where(order < len(theirs), spots, -1))
    after = np.minimum.accumulate(np.where(order < len(theirs), spots, len(order))[::-1])[::-1]
    size = np.zeros(len(ours), np.int64)
    mine = np.flatnonzero((order > len(theirs)) & (order < len(both) - 1))
    for side in (before, after):
        some = mine[(side[mine] >= 0) & (side[mine] < len(order))]
        a, b = order[some], order[side[some]]
        common = np.zeros(len(some), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + common, b + common
            same = (x < len(both)) & (y < len(both))
            same[same] = ranks[k][x[same]] == ranks[k][y[same]]
            common[same] += 1 << k
        own = a - len(theirs) - 1
        size[own] = np.maximum(size[own], common)
    return size


def longest_matches(words: Words, test: TestWindows, window: np.ndarray, at: np.ndarray) -> dict[int, tuple]:
    """Text -> (words, place in the text, item, place in the item) of its longest verbatim match."""
    length = test.length[window]
    whole = np.flatnonzero(length == WINDOW)
    if len(whole):
        whole = whole[np.argsort(at[whole])]
        w, a = window[whole], at[whole]
        # Windows that follow one another in a text; in the items only those that occur here matter.
        spot = np.arange(len(a)) + np.cumsum(np.r_[False, np.diff(a) != 1])
        ours = np.zeros(int(spot[-1]) + 1, np.int64)
        ours[spot] = w + 1
        used = np.flatnonzero(np.isin(test.of, w))
        there = np.arange(len(used)) + np.cumsum(np.r_[False, (np.diff(used) != 1) | (np.diff(test.item[used]) != 0)])
        theirs = np.zeros(int(there[-1]) + 1, np.int64)
        theirs[there] = test.of[used] + 1
        length[whole] = longest(ours, theirs)[spot] + WINDOW - 1
    text = words.text_at[at]
    order = np.lexsort((at, -length, text))
    heads = order[np.r_[True, text[order][1:] != text[order][:-1]]]
    by_window = np.argsort(test.of, kind="stable")
    froms = np.searchsorted(test.of[by_window], np.arange(len(test.grid) + 1))
    window_at = dict(zip(at[whole].tolist(), window[whole].tolist()))
    best = {}
    for h in heads.tolist():
        t, n, place, w = int(text[h]), int(length[h]), int(at[h]), int(window[h])
        found = by_window[froms[w] : froms[w + 1]]
        if test.length[w] == WINDOW and n > WINDOW:
            steps = np.arange(n - WINDOW + 1)
            found = found[found + steps[-1] < len(test.of)]
            want = np.array([window_at[place + k] for k in steps.tolist()])
            found = found[(test.item[found + steps[-1]] == test.item[found]) & (test.of[found[:, None] + steps] == want).all(1)]
        ends = [(test.item_ids[test.item[i]] is None, test.item_ids[test.item[i]] or "", int(test.nth[i])) for i in found.tolist()]
        unnamed, name, nth = min(ends)
        best[t] = (n, place - int(words.firsts[t]) - t, None if unnamed else name, nth)
    return best


def by_name(items) -> list[str | None]:
    """Item ids in order, null last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


_BLOCKS: dict[str, TestWindows] = {}


def _block(uri: str) -> TestWindows:
    """A block of items; a process keeps the last one."""
    if uri not in _BLOCKS:
        fs, path = open_fs(uri)
        with fs.open_input_stream(path) as file:
            table = pa.ipc.open_stream(file.read()).read_all()
        _BLOCKS.clear()
        _BLOCKS[uri] = TestWindows(table["item_id"].to_pylist(), table["text"].to_pylist())
    return _BLOCKS[uri]


def blocks(benchmark: DataFrame, limit: int) -> list[str]:
    """Files of items, each of about ``limit`` bytes of text (an item stays whole)."""
    items = only(benchmark, item_id="string", text="string").where(F.octet_length("text") > 0).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n, folder = 1 + total // limit, shared_dir(benchmark.sparkSession, "items")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))

    def write(batches):
        now, some = None, []

        def put():
            uri = f"{folder}/{now:06d}-{uuid.uuid4().hex}.arrow"
            fs, path = open_fs(uri)
            fs.create_dir(open_fs(folder)[1], recursive=True)
            with fs.open_output_stream(path) as out, pa.ipc.new_stream(out, some[0].schema) as stream:
                for batch in some:
                    stream.write_batch(batch)
            return pa.RecordBatch.from_pydict({"uri": [uri]})

        for batch in batches:
            block = column(batch, "block").to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if some and block[a] != now:
                        yield put()
                        some = []
                    now = int(block[a])
                    some.append(batch.slice(a, b - a))
        if some:
            yield put()

    written = dealt.repartition(min(n, shuffles(benchmark.sparkSession)), "block").sortWithinPartitions("block", "item_id", "text").mapInArrow(write, "uri string")
    return sorted(r.uri for r in written.collect())  # a file name for some megabytes of items


_OUT = "doc_id long, n_words long, hits array<struct<low:long,high:long>>, items array<string>, longest_match long, match_at long, match_item string, match_item_at long"
_HITS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


@dataclass
class Found:
    """What a shard's texts have of all blocks: words, covered runs (text, low, high), items and longest matches by text."""

    words: Words
    runs: list[tuple[int, int, int]]
    items: dict[int, set]
    best: dict[int, tuple]


def search(texts: pa.Array, uris: list[str]) -> Found:
    """One suffix array, all blocks of items."""
    words = Words(texts)
    base = words.firsts[:-1] + np.arange(len(words.n))
    order = suffix_array(words.sequence, len(words.sequence) - WINDOW) if uris and len(words.starts) else None
    edge = np.zeros(len(words.sequence) + 1, np.int64)
    items: dict[int, set] = {}
    best: dict[int, tuple] = {}
    rank = lambda m: (-m[0], m[1], m[2] is None, m[2] or "", m[3])
    for uri in uris:
        test = _block(uri)
        window, at = matches(words, test, order)
        if not len(at):
            continue
        np.add.at(edge, at, 1)
        np.add.at(edge, at + test.length[window], -1)
        for t, w in np.unique(np.stack([words.text_at[at], window], 1), axis=0).tolist():
            items.setdefault(t, set()).update(test.item_ids[i] for i in test.items[test.items_from[w] : test.items_from[w + 1]].tolist())
        for t, found in longest_matches(words, test, window, at).items():
            best[t] = min(best.get(t, found), found, key=rank)
    covered = np.r_[False, np.cumsum(edge)[: len(words.sequence)] > 0, False]
    low, high = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    of = words.text_at[low] if len(low) else low
    return Found(words, list(zip(of.tolist(), (low - base[of]).tolist(), (high - base[of]).tolist())), items, best)


def locate(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, covered runs of words (``hits``), matching ``items`` and the longest match of every row."""
    uris = blocks(benchmark, limit)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", SHARD_BYTES):
                found = search(column(piece, "text"), uris)
                hits: dict[int, list] = {}
                for t, a, b in found.runs:
                    hits.setdefault(t, []).append({"low": a, "high": b})
                rows, none = range(len(piece)), (0, None, None, None)
                match = list(zip(*(found.best.get(t, none) for t in rows))) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "doc_id"), pa.array(found.words.n, pa.int64()), pa.array([hits.get(t, []) for t in rows], _HITS), pa.array([by_name(found.items.get(t, ())) for t in rows], pa.list_(pa.string())),
                     *(pa.array(m, k) for m, k in zip(match, (pa.int64(), pa.int64(), pa.string(), pa.int64())))],
                    names=["doc_id", "n_words", "hits", "items", "longest_match", "match_at", "match_item", "match_item_at"],
                )

    return only(docs, doc_id="long", text="string").mapInArrow(run, _OUT)


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The contract's columns for every row, and its longest verbatim match with the places."""
    found = locate(docs, benchmark, limit)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["high"] - r["low"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("hit"), "longest_match", "match_at", "match_item", "match_item_at",
    ).withColumn("contaminated", F.col("hit") & (20 * F.col("n_hit") >= F.col("n_words"))).drop("hit")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verbatim match of a window's words or more, and not contaminated.

    A short item (of fewer words than a window) alone removes a document only where it covers a twentieth
    of the words. Each row is judged by its own text, whatever its doc_id; ties and repeated rows are judged
    alike. Rows with null or empty texts stay. All columns stay. An empty table gives no rows, and an empty
    benchmark removes none.
    """
    uris = blocks(benchmark, BLOCK_BYTES)

    def keep(batches):
        for batch in batches:
            for piece in slices(batch, "text", SHARD_BYTES):
                found = search(column(piece, "text").cast(pa.string()), uris)
                n_hit = np.zeros(len(piece), np.int64)
                for t, a, b in found.runs:
                    n_hit[t] += b - a
                stay = (n_hit == 0) | (20 * n_hit < found.words.n)
                stay[[t for t, m in found.best.items() if m[0] >= WINDOW]] = False
                yield piece.filter(pa.array(stay))

    return docs.mapInArrow(keep, docs.schema)
