"""Token ids of whole texts by a public tokenizer, cached per pre-token.

The tokenizer merges bytes inside a pre-token only (a run of letters, one digit, a run of other
signs; white space is dropped), so a text's ids are the ids of its pre-tokens one after the other.
A block of texts is cut into pre-tokens with array operations, known ones are looked up by hash,
and only new ones go through the tokenizer. Chunks between white space with anything that is not
plain (signs outside Latin letters and ASCII, an apostrophe, a special token) are kept whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from stockloom.llm import text as T

CACHE_ENTRIES = 1_000_000  # pre-tokens a worker remembers before it starts over
_SLOTS_BITS = 22
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _classes() -> np.ndarray:
    table = np.full(256, _ODD, np.uint8)
    for b in range(0x21, 0x7F):
        table[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _OTHER
    table[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
    table[ord("'")] = _ODD
    table[0x80:0xC0] = _LETTER  # continuation: as its lead byte says
    table[[0xC3, 0xC4, 0xC5]] = _LETTER  # U+00C0 to U+017F
    return table


class WordTokens:
    """Ids of blocks of texts; keeps a bounded cache between calls."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        self._tokenizer = Tokenizer.from_file(path)
        # Plain pre-tokens can be told apart again only if each ends in a word-end token.
        size = self._tokenizer.get_vocab_size()
        self._ends = np.zeros(size, bool)
        for word, i in self._tokenizer.get_vocab().items():
            self._ends[i] = word.endswith("</w>")
        self._table = _classes()
        self._lower = np.arange(256, dtype=np.uint8)  # ids do not depend on the case of letters
        self._lower[65:91] += 32
        self._reset()

    def _reset(self) -> None:
        self._slots = np.zeros(1 << _SLOTS_BITS, np.int32)  # entry, 0 for none
        self._keys = np.zeros(1, np.uint64)
        self._starts = np.zeros(1, np.int64)
        self._sizes = np.zeros(1, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        """Starts, ends and plainness of the pre-tokens (or whole chunks) of a block."""
        kind = self._table[data]
        odd = kind == _ODD
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        inside = kind != _SPACE
        starts, ends = T.run_bounds(inside, offsets)
        seen = np.concatenate([[0], np.cumsum(odd)])
        whole = seen[ends] > seen[starts]
        marks = np.zeros(len(data) + 1, np.int32)
        marks[starts[whole]] += 1
        marks[ends[whole]] -= 1
        kept = np.cumsum(marks[:-1]) > 0
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = inside[1:] & ~kept[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        begins[starts] = True
        stops = np.zeros(len(data), bool)
        stops[ends - 1] = True
        stops |= inside & begins[1:]
        first = np.flatnonzero(begins[:-1])
        return first, np.flatnonzero(stops) + 1, ~kept[first]

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, 0 if unknown; a key may sit in either of two slots."""
        entry = self._slots[(keys >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)]
        missing = np.flatnonzero(self._keys[entry] != keys)
        second = self._slots[(keys[missing] & np.uint64((1 << _SLOTS_BITS) - 1)).astype(np.int64)]
        entry[missing] = np.where(self._keys[second] == keys[missing], second, 0)
        return entry

    def _encode(self, units: list[bytes], plain: np.ndarray) -> list[np.ndarray]:
        found: list = [None] * len(units)
        simple = np.flatnonzero(plain).tolist()
        groups = [simple[i : i + 512] for i in range(0, len(simple), 512)]
        texts = [" ".join(units[i].decode() for i in group) for group in groups]
        alone = np.flatnonzero(~plain).tolist()
        for group, encoded in zip(groups, self._batch(texts), strict=True):
            ids = np.array(encoded, np.uint32)
            cuts = np.flatnonzero(self._ends[ids]) + 1
            if len(cuts) == len(group):
                for i, part in zip(group, np.split(ids, cuts[:-1]), strict=True):
                    found[i] = part
            else:
                alone += group
        for i, ids in zip(alone, self._batch([units[i].decode() for i in alone]), strict=True):
            found[i] = np.array(ids, np.uint32)
        return found

    def _batch(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 16):  # encodings take much more room than their ids
            for e in self._tokenizer.encode_batch_fast(texts[at : at + 16], add_special_tokens=False):
                yield e.ids

    def _learn(self, keys: np.ndarray, units: list[bytes], plain: np.ndarray) -> None:
        parts = self._encode(units, plain)
        sizes = np.array([len(p) for p in parts], np.int64)
        base = len(self._keys)
        entries = np.arange(base, base + len(keys))
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(sizes) - sizes])
        self._ids = np.concatenate([self._ids, *parts])
        self._keys = np.concatenate([self._keys, keys])
        self._sizes = np.concatenate([self._sizes, sizes])
        first = (keys >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)
        second = (keys & np.uint64((1 << _SLOTS_BITS) - 1)).astype(np.int64)
        slot = np.where(self._slots[first] == 0, first, second)
        self._slots[slot] = entries

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block and n + 1 offsets into them."""
        starts, ends, plain = self._units(data, offsets)
        keys = T.range_hashes(T.prefix_hashes(self._lower[data]), starts, ends)
        if len(self._keys) > CACHE_ENTRIES:
            self._reset()
        entry = self._lookup(keys)
        unknown = np.flatnonzero(entry == 0)
        if len(unknown):
            fresh, at, back = np.unique(keys[unknown], return_index=True, return_inverse=True)
            at, base, raw = unknown[at], len(self._keys), data.tobytes()
            units = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._learn(fresh, units, plain[at])
            entry[unknown] = base + back
        sizes = self._sizes[entry]
        until = np.concatenate([[0], np.cumsum(sizes)])
        where = np.arange(until[-1]) + np.repeat(self._starts[entry] - until[:-1], sizes)
        return self._ids[where], until[np.searchsorted(starts, offsets)]


@cache
def word_tokens(path: str) -> WordTokens:
    """One tokenizer and cache for all tasks of a Python worker."""
    return WordTokens(path)


def plain_ids(path: str, texts: list[str | None]) -> list[list[int]]:
    """The tokenizer's own ids, without cache; for tests and small inputs."""
    tokenizer = Tokenizer.from_file(path)
    return [
        e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    ]


def column_ids(path: str, texts: list[str | None]) -> list[list[int]]:
    data, offsets = T.texts_of(pa.array(texts, pa.string()))
    ids, bounds = WordTokens(path).encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
