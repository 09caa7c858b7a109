"""Token ids of whole texts, each distinct run between spaces encoded once per worker.

A space followed by a character that is not white space starts a new pre-token in both public
vocabularies used here, so a text's ids are the ids of the runs between such places, in order (where the
next character might be white space of another script, no cut is made). So does an ASCII sign after an ASCII letter, and
what follows a single line feed behind a printed ASCII character. The tokenizers library encodes every
distinct run; repeats are found by hash and compared by their bytes. A text that holds one of the
vocabulary's special tokens is encoded by the library as a whole: it takes such a token out first, as one
id, wherever it stands. Tests hold the result against a tokenizer fresh from its file, on whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .bytesview import Prefix, same_bytes
from .common import text_bytes

_MAX_RUNS, _JOIN = 400_000, 2000
#: Bytes that begin a character which is not white space: the others, C2 and E1 to E3, begin some that are.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:] = True
_PRINTS, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_PRINTS[33:127] = _LETTER[65:91] = _LETTER[97:123] = True
_SIGN = _PRINTS & ~_LETTER
_SIGN[48:58] = False
#: Fixed values of the two public vocabularies: how they cut a text into words before merging.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOWER_CASE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Beyond these characters words are cut by the library itself.
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]*")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class _Memo(dict):
    """Numbers its keys in order of arrival; new ones wait in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.pending.append(key)
        return number


class RunEncoder:
    """Encode texts with a tokenizers file; memory is bounded by forgetting all runs when there are many."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts with this may hold an added token (None: there are none): what all begin with, up to the first letter.
        self._mark = re.match(r"[^\w]*", os.path.commonprefix(added))[0] if added else None
        self._letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})
        self._newline = _byte_letters()[10]
        self._words, self._lower = None, False
        # The parts' own states: the whole file as objects would take far more memory than the tokenizer.
        state = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        cuts, norms = state(self.tokenizer.pre_tokenizer), state(self.tokenizer.normalizer)
        steps = cuts.get("pretokenizers", [cuts])
        kinds = [n["type"] for n in norms.get("normalizers", [])]
        if steps[-1].get("type") == "ByteLevel":
            if not norms and len(steps) == 1 and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
                self._words = regex.compile(_BYTE_LEVEL)
            elif kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": _LOWER_CASE}:
                self._words, self._lower = regex.compile(_LOWER_CASE), True
        self._merger = Tokenizer(self.tokenizer.model)
        self.most = _MAX_RUNS
        self.forget()

    def forget(self):
        """Forget all runs. Run k has the bytes and ids that its starts and counts name; hashes are sorted."""
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.byte_starts, self.byte_counts = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs in one row, and their numbers: many in one text, for the library's cost per call is high."""
        simple = np.fromiter((self._words is not None and _PLAIN.fullmatch(r, r.startswith(" ")) is not None for r in runs), bool, len(runs))
        words, owns, memo = [], [], _Memo()
        for k in np.flatnonzero(simple).tolist():
            run = runs[k]
            if self._lower:
                own = self._words.findall(run.lower())
            else:
                # One word only if no cut can come after its first character, as in a text that begins with 'stress.
                whole = run[1:].isalpha() and (run[0] == " " or run[0].isalpha())
                own = (run,) if whole else self._words.findall(run)
            words += own
            owns += [k] * len(own)
        which = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        ids, sizes = self._merge(memo.pending)
        size = sizes[which]
        counts = np.bincount(np.asarray(owns, np.int64), size, len(runs)).astype(np.int64)
        found = [spread(ids, (np.cumsum(sizes) - sizes)[which], size)]
        others = np.flatnonzero(~simple)
        for k in range(0, len(others), _JOIN):
            group = [runs[i] for i in others[k : k + _JOIN].tolist()]
            encoding = self.tokenizer.encode(group, is_pretokenized=True, add_special_tokens=False)
            found.append(np.asarray(encoding.ids, np.uint32))
            counts[others[k : k + _JOIN]] = np.bincount(np.asarray(encoding.word_ids, np.int64), minlength=len(group))
        # The ids of the simple runs come first, then those of the others.
        order = np.r_[np.flatnonzero(simple), others]
        starts = np.empty(len(runs), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return spread(np.concatenate(found), starts, counts), counts

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, merged from their bytes, in one row, and their numbers."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        letters = "\n".join(words).encode().decode("latin-1").translate(self._letters).split(self._newline)
        found, each = [], []
        for k in range(0, len(letters), _JOIN):
            group = letters[k : k + _JOIN]
            encoding = self._merger.encode(group, is_pretokenized=True, add_special_tokens=False)
            found.append(np.asarray(encoding.ids, np.uint32))
            each.append(np.bincount(np.asarray(encoding.word_ids, np.int64), minlength=len(group)))
        return np.concatenate(found), np.concatenate(each)

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each run, learning those that are new."""
        hashes = Prefix(raw).runs(starts, ends)
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, kinds)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == kinds[known]
        new = np.flatnonzero(~known)
        number = np.empty(len(kinds), np.int64)
        number[known] = self.number[at[known]]
        number[new] = self._add(raw, starts[first[new]], ends[first[new]])
        self.hashes, self.number = np.insert(self.hashes, at[new], kinds[new]), np.insert(self.number, at[new], number[new])
        out = number[which]
        # A run is its hash's only if its bytes are; others with that hash are learnt by themselves.
        same = self.byte_counts[out] == ends - starts
        some = np.flatnonzero(same & (ends > starts))
        same[some] = same_bytes(raw, starts[some], self.bytes, self.byte_starts[out[some]], (ends - starts)[some])
        odd = np.flatnonzero(~same)
        out[odd] = self._add(raw, starts[odd], ends[odd])
        return out

    def _add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        data, size = raw.tobytes(), ends - starts
        ids, counts = self._learn([data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        base = len(self.counts)
        self.byte_starts = np.concatenate([self.byte_starts, len(self.bytes) + np.cumsum(size) - size])
        self.byte_counts = np.concatenate([self.byte_counts, size])
        self.bytes = np.concatenate([self.bytes, spread(raw, starts, size)])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, ids])
        return base + np.arange(len(starts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one row, and the number of ids of each text."""
        return self.encode_array(pa.array(texts, pa.large_string()))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for an array (null: empty)."""
        marked = np.zeros(len(texts), bool) if self._mark is None else pc.match_substring(texts, self._mark).fill_null(False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode(texts)
        ids, counts = self._encode(texts.filter(pa.array(~marked)))
        whole = [np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.filter(pa.array(marked)).to_pylist()]
        order, sizes = np.r_[np.flatnonzero(~marked), np.flatnonzero(marked)], np.empty(len(texts), np.int64)
        laid = np.r_[counts, np.fromiter(map(len, whole), np.int64, len(whole))]
        starts = np.empty(len(texts), np.int64)
        sizes[order], starts[order] = laid, np.cumsum(laid) - laid
        return spread(np.concatenate([ids, *whole]), starts, sizes), sizes

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.counts) > self.most:
            self.forget()
        raw, offsets = text_bytes(texts)
        cut = np.zeros(len(raw) + 1, bool)
        cut[:-2] = (raw[:-1] == 32) & _SOLID[raw[1:]]
        if self._words is not None:
            cut[1:-1] |= _LETTER[raw[:-1]] & _SIGN[raw[1:]]
            cut[2:-1] |= _PRINTS[raw[:-2]] & (raw[1:-1] == 10) & _SOLID[raw[2:]]
        cut[np.maximum(offsets[1:-1] - 1, 0)] = False  # no text goes on in the next one
        full = offsets[1:] > offsets[:-1]
        cut[offsets[:-1][full]] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.r_[starts[1:], len(raw)][: len(starts)]
        which = self._numbers(raw, starts, ends) if len(starts) else np.zeros(0, np.int64)
        counts = self.counts[which]
        before = np.r_[0, np.cumsum(counts)]
        return spread(self.flat, self.starts[which], counts), np.diff(before[np.searchsorted(starts, offsets)])

    def with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each with the end id behind, and the place after each text's."""
        ids, counts = self.encode_array(texts)
        ends = np.cumsum(counts)
        return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


def spread(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs values[starts : starts + counts], one after another."""
    return values[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]


_ENCODERS: dict[str, RunEncoder] = {}


def encoder(path: str, most: int = _MAX_RUNS) -> RunEncoder:
    """The process's encoder of a file, which takes long to load; it holds ``most`` runs, some 80 bytes each.

    Tasks that follow one another in a worker share what it has learnt, unless they make it ``forget``.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = RunEncoder(path)
    _ENCODERS[path].most = most
    return _ENCODERS[path]
