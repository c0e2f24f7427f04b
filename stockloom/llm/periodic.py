"""Maximal periodic runs of words, by longest common extensions on suffix trees.

For the words of a block of texts, and for the same read backwards, Ukkonen's algorithm builds a suffix
tree. The tour of a tree that visits its leaves in order gives, between neighbouring leaves, the depth of
their lowest common ancestor; the least of a range of them, from a table of ranges of powers of two, is
the ancestor of any two leaves in constant time, and with it how far two places agree to the right (or to
the left). Every run holds a Lyndon word of its period's length that is the longest one starting at its
place, by the order of words or by its reverse. So each place gives two candidate periods, the distances
to the next smaller suffix by either order, which are extended both ways; those that reach twice the
period are the runs, with their smallest periods.

Only stretches of repeated words need a tree. A run of length m and smallest period q <= m / 2 has m - q
>= m / 2 words in a row that occur again q words on, so with m >= ``shortest`` all its words lie in
strings of ``shortest / 2`` words that the text holds twice. Maximal stretches covered by such strings
hold each run whole; they are joined by separators that occur once and so can't be part of a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockloom.llm import text as T

SEPARATORS = r"[\x20\x09-\x0D]"
RUNS = "array<struct<start:long,length:long,period:long>>"

_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers 1..size-1 that ends with a 0 found nowhere else.

    Node v is entered by the edge with the numbers ``text[begin[v]:end[v]]``; a leaf's edge runs to
    the text's end. ``edges`` maps ``node * size + number`` to the node that the number leads to.
    """

    def __init__(self, text: list[int], size: int):
        self.text, self.size = text, size
        n = len(text)
        begin, end, link, edges = [0], [0], [0], {}
        active, edge, length, pending = 0, 0, 0, 0
        for i, c in enumerate(text):
            pending += 1
            last = 0
            while pending:
                if not length:
                    edge = i
                key = active * size + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = active
                        last = 0
                else:
                    b = begin[child]
                    span = min(end[child], i + 1) - b
                    if length >= span:
                        edge += span
                        length -= span
                        active = child
                        continue
                    if text[b + length] == c:
                        length += 1
                        if last:
                            link[last] = active
                        break
                    split = len(begin)
                    begin.append(b)
                    end.append(b + length)
                    link.append(0)
                    edges[key] = split
                    edges[split * size + c] = split + 1
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    begin[child] = b + length
                    edges[split * size + text[b + length]] = child
                    if last:
                        link[last] = split
                    last = split
                pending -= 1
                if active == 0 and length:
                    length -= 1
                    edge = i - pending + 1
                else:
                    active = link[active]
        self._begin, self._end, self._edges = begin, end, edges

    def tour(self, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and between each and the one before the depth of their common ancestor.

        With ``reverse`` numbers count from the largest down; the final 0 remains the smallest.
        """
        keys = np.fromiter(self._edges.keys(), np.int64, len(self._edges))
        children = np.fromiter(self._edges.values(), np.int64, len(self._edges))
        parent, number = np.divmod(keys, self.size)
        if reverse:
            number = np.where(number == 0, 0, self.size - number)
        order = np.lexsort((number, parent))
        starts = np.searchsorted(parent[order], np.arange(len(self._begin) + 1)).tolist()
        child, n = children[order].tolist(), len(self.text)
        begin, end = self._begin, self._end
        suffixes, depths, low = [], [], 0
        stack = [(0, 0)]  # node and its parent's depth
        while stack:
            node, above = stack.pop()
            if above < low:
                low = above
            depth = above + end[node] - begin[node]
            a, b = starts[node], starts[node + 1]
            if a == b:
                suffixes.append(n - depth)
                depths.append(low)
                low = n
            else:
                for c in reversed(child[a:b]):
                    stack.append((c, depth))
        return np.array(suffixes, np.int64), np.array(depths, np.int64)


class Extensions:
    """Longest common extensions of places of a text to the right, in constant time."""

    def __init__(self, tree: SuffixTree):
        order, depths = tree.tour()
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self._tables = [depths.astype(np.int32)]
        width = 1
        while 2 * width <= len(order):
            last = self._tables[-1]
            self._tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from places ``i != j`` on."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k, table in enumerate(self._tables):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank; the number of places if there is none."""
    out, stack, ranks = [0] * len(rank), [], rank.tolist()
    for i in range(len(ranks) - 1, -1, -1):
        own = ranks[i]
        while stack and ranks[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1] if stack else len(ranks)
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(numbers: np.ndarray, shortest: int = 2) -> np.ndarray:
    """(start, length, period) of the maximal runs of length at least max(shortest, 2 * period), in
    order of start and period. ``numbers`` are 1 or more."""
    n = len(numbers)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    text = numbers.tolist()
    size = int(numbers.max()) + 1
    tree = SuffixTree([*text, 0], size)
    ahead = Extensions(tree)
    behind = Extensions(SuffixTree([*text[::-1], 0], size))
    backwards, _ = tree.tour(reverse=True)
    other = np.empty(n + 1, np.int64)
    other[backwards] = np.arange(n + 1)
    found = []
    for rank in (ahead.rank, other):
        at = np.arange(n)
        to = _next_smaller(rank)[:n]
        right = ahead(at, to)
        left = np.zeros(len(at), np.int64)
        some = np.flatnonzero(at > 0)
        left[some] = behind(n - at[some], n - to[some])
        period = to - at
        whole = np.flatnonzero(left + right >= period)
        found.append(np.stack([at - left, period + left + right, period], axis=1)[whole])
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[runs[:, 1] >= np.maximum(shortest, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _covered(words: np.ndarray, per_text: np.ndarray, width: int) -> np.ndarray:
    """Whether a word lies in a string of ``width`` words that its text holds twice or more."""
    n = len(words)
    inside = np.zeros(n + 1, np.int64)
    if n < width:
        return inside[:n] > 0
    text = np.repeat(np.arange(len(per_text) - 1), np.diff(per_text)).astype(np.uint64)
    rolled = text[: n - width + 1].copy()
    for i in range(width):
        rolled = T.mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(rolled)])
    at = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    order = at[np.argsort(rolled[at], kind="stable")]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = rolled[order[1:]] == rolled[order[:-1]]
    again = order[same[1:] | same[:-1]]
    np.add.at(inside, again, 1)
    np.add.at(inside, again + width, -1)
    return np.cumsum(inside)[:n] > 0


def block_runs(words: np.ndarray, per_text: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, [start, length, period]) of the runs of a block of texts, given as word hashes."""
    inside = _covered(words, per_text, (shortest + 1) // 2)
    begins, ends = T.run_bounds(inside, per_text)
    long = ends - begins >= shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    sizes = ends - begins
    place = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    _, number = np.unique(words[place], return_inverse=True)
    # Stretches one behind the other, each followed by a number of its own.
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    joined = np.empty(len(place) + len(sizes), np.int64)
    joined[np.arange(len(place)) + stretch] = number + 1
    joined[np.cumsum(sizes + 1) - 1] = int(number.max()) + 2 + np.arange(len(sizes))
    found = runs_of(joined, shortest)
    in_stretch = np.searchsorted(np.cumsum(sizes + 1), found[:, 0], side="right")
    start = found[:, 0] - in_stretch  # without the separators before it
    start = place[start]
    text = np.searchsorted(per_text, start, side="right") - 1
    return text, np.stack([start - per_text[text], found[:, 1], found[:, 2]], axis=1)


def _scan(shortest: int):
    table = T.byte_table(SEPARATORS, lower=False)

    def scan(batches):
        for batch in batches:
            for rows, data, offsets in T.blocks(batch):
                hashes, starts, ends, per_text = T.words(data, offsets, table)
                text, found = block_runs(hashes, per_text, shortest)
                gone = np.zeros(len(hashes) + 1, np.int64)
                first = per_text[text] + found[:, 0]
                np.add.at(gone, first + found[:, 2], 1)
                np.add.at(gone, first + found[:, 1], -1)
                kept, sizes = _kept_texts(data, starts, ends, per_text, np.cumsum(gone)[:-1] == 0)
                n = rows.stop - rows.start
                counts = np.bincount(text, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(rows.start, n),
                        pa.array(np.diff(per_text)),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(0, np.cumsum(counts)), pa.int32()),
                            pa.StructArray.from_arrays([pa.array(c.copy()) for c in found.T], ["start", "length", "period"]),
                        ).cast(_RUN_TYPE),
                        pa.StringArray.from_buffers(n, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(kept)),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return scan


def _kept_texts(data, starts, ends, per_text, kept) -> tuple[bytes, np.ndarray]:
    """The kept words of each text joined by one blank, one text behind the other, and their sizes."""
    rows = len(per_text) - 1
    owner = np.repeat(np.arange(rows), np.diff(per_text))[kept]
    starts, ends = starts[kept], ends[kept]
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    sizes = ends - starts + ~last  # with the blank behind it
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out = data[np.minimum(place, max(len(data) - 1, 0))] if len(place) else np.zeros(0, np.uint8)
    out[(np.cumsum(sizes) - 1)[~last]] = 32
    return out.tobytes(), np.bincount(owner, weights=sizes, minlength=rows).astype(np.int64)


def find_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs``.

    Words are what blanks (space, tab to carriage return) leave of the whole text. A run is a stretch
    of consecutive words with smallest period q (words q apart are equal), of length max(shortest,
    2q) or more, that no neighbouring word extends; ``runs`` lists them by start (word number) and
    period, in full. ``collapsed`` joins the words by one blank, without those that some run holds
    after its first q words. Words are compared by 64-bit hashes.

    A null or blank text has no words and no runs. Rows are independent: repeated ones give repeated
    results, a null id is handed on, other columns are ignored. A text is handled by one task, which
    holds about a kilobyte for each word in its repeated stretches.
    """
    schema = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(_scan(shortest), schema)


def rewrite_words(
    docs: DataFrame, rewrite: Callable[[int, int], np.ndarray | None]
) -> DataFrame:
    """``doc_id, text`` with the words of some texts dealt anew, joined by one blank.

    ``rewrite`` is given the id and the number of words, at least one, and returns the numbers of the
    words that the text shall have, or None to leave it as it is. Rows without id or words stay.
    """
    table = T.byte_table(SEPARATORS, lower=False)

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, data, offsets in T.blocks(batch):
                n = rows.stop - rows.start
                texts = batch.column(1).slice(rows.start, n)
                low = table[data]
                starts, ends = T.run_bounds(low != 0, offsets)
                per_text = np.searchsorted(starts, offsets)
                changed = {}
                for i, name in enumerate(ids[rows]):
                    a, b = per_text[i], per_text[i + 1]
                    order = rewrite(name, int(b - a)) if name is not None and b > a else None
                    if order is not None:
                        words = [data[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                        changed[i] = b" ".join([words[w] for w in order.tolist()]).decode()
                if changed:
                    texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), texts], names=["doc_id", "text"])

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(deal, "doc_id long, text string")


def planted_period(doc_id: int, n: int) -> np.ndarray | None:
    """In one document of ten, by the checksum of its id, the words from some place on repeat."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order
