"""Exact removal of repeated substrings with longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller
document, or before in the same one. The suffixes are dealt to tasks so that equal strings meet:
every window of ``length`` bytes belongs to its anchor, the place in it whose ``KEY``-byte string
has the smallest hash (the first such place), which depends on the window alone. Windows in a row
with one anchor form a chunk, about 35 windows long.

1. Chunks go to the task of their anchor's hash. A chunk that occurred before is covered whole.
2. First occurrences under anchors with several different chunks get their bytes, and tasks sort
   the suffixes of such chunks. In suffix order, the previous and the next suffix with a smaller
   position are the closest matches that start earlier; the longer of the two common prefixes is the
   longest previous factor, and a window is covered if it reaches ``length``.
3. Covered ranges meet their documents, whose other bytes are kept.

Copies within one batch of a task are marked before the shuffle, so a string that fills much of the
input reaches its task once per batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm import text as T
from stockloom.llm.storage import Scratch

LENGTH = 100
KEY = 32  # bytes whose hash makes an anchor; at most the length
HOT = 20_000  # chunks under one anchor from which its windows are dealt by their own hashes
SORTED_BYTES = 1_500_000  # bytes whose suffixes are sorted at once

_SPAN_BITS = 9  # windows of a chunk: at most length - KEY + 1


def chunks(
    data: np.ndarray, offsets: np.ndarray, length: int, key: int = KEY
) -> tuple[np.ndarray, ...]:
    """Anchor hash, chunk hash, text, first window (in its text) and number of windows per chunk."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, none)
    sums = T.prefix_hashes(data)
    at = np.arange(len(data) - key + 1)
    hashes = T.range_hashes(sums, at, at + key)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, covered = length - key + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        low = np.minimum(low[:-step], low[step:])
        covered += step
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n), side="right") - 1
    whole = np.arange(n) + length <= offsets[text + 1]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, none)
    group = np.cumsum(first)[whole]
    size = np.bincount(group, minlength=len(start) + 1)[1:]
    chunk = T.range_hashes(sums, start, start + size + length - 1)
    return hashes[anchor[start]], chunk, text[start], start - offsets[text[start]], size


def covered_windows(
    data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int
) -> np.ndarray:
    """For chunks in order of their place (``starts`` in ``data``, ``sizes`` windows each): per
    window whether its longest previous factor reaches ``length``."""
    width = sizes + length - 1
    n = len(data)
    left = np.repeat(starts + width, width) - np.arange(n)  # bytes to the chunk's end
    rank = data.astype(np.int64)
    reach, steps = 1, []
    while reach < length:
        steps.append(min(reach, length - reach))
        reach += steps[-1]
    for step in steps:  # ranks of the first 1, 2, 4, ... length bytes; beyond a chunk's end: 0
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:] + 1
        ahead[left <= step] = 0
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
    position = np.flatnonzero(left >= length)  # window starts, in order of place
    order = np.argsort(rank[position], kind="stable")
    place, string = order, rank[position][order]
    smaller = [_nearest_smaller(place), _nearest_smaller(place[::-1])]
    smaller[1] = np.where(smaller[1][::-1] < 0, -1, len(place) - 1 - smaller[1][::-1])
    reached = np.zeros(len(place), bool)
    for near in smaller:
        reached |= (near >= 0) & (string[near] == string)
    found = np.zeros(len(place), bool)
    found[order] = reached
    return found


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the closest smaller value before each one, -1 without."""
    near = np.arange(len(values)) - 1
    open_ = np.flatnonzero(near >= 0)
    while len(open_):
        open_ = open_[values[near[open_]] > values[open_]]
        near[open_] = near[near[open_]]
        open_ = open_[near[open_] >= 0]
    return near


def _scan(length: int):
    names = ["meet", "chunk", "doc_id", "text_key", "place"]

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, parts = batch.column(1).to_numpy(zero_copy_only=False), []
            for row, at, data, offsets in _portions(batch, length):
                anchor, chunk, text, start, size = chunks(data, offsets, length)
                parts.append((anchor, chunk, text + row, start + at, size))
            if not parts:
                continue
            anchor, chunk, text, start, size = (np.concatenate(c) for c in zip(*parts, strict=True))
            known, dropped = _copies(anchor, chunk, ids[text], keys[text], start)
            salt = T.mix(np.arange(len(anchor), dtype=np.uint64) + chunk)
            meet = np.where(known, T.mix(anchor + salt), anchor)
            place = (start << (_SPAN_BITS + 1)) | (size << 1) | known
            columns = [T.signed(meet), T.signed(chunk), ids[text], keys[text], place]
            yield pa.RecordBatch.from_arrays([pa.array(c[~dropped]) for c in columns], names=names)

    return scan


def _portions(batch: pa.RecordBatch, length: int):
    """(first row, first window, bytes, offsets) of a batch's texts; a long text comes in parts that
    overlap by less than a window, so that every window is in exactly one part."""
    for rows, data, offsets in T.blocks(batch):
        if len(offsets) > 2 or len(data) <= 2 * T.BLOCK_BYTES:
            yield rows.start, 0, data, offsets
            continue
        for at in range(0, len(data), T.BLOCK_BYTES):
            part = data[at : at + T.BLOCK_BYTES + length - 1]
            yield rows.start, at, part, np.array([0, len(part)])


def _copies(anchor, chunk, ids, keys, start) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks of a batch have an equal one at an earlier place, and which state a first one
    again (the same place of the same document)."""
    both = T.mix(anchor + np.uint64(3) * T.mix(chunk))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    member = np.zeros(len(both), bool)
    member[1:] |= same
    member[:-1] |= same
    some = order[member]
    some = some[np.lexsort((start[some], keys[some], ids[some], both[some]))]
    group = both[some]
    begins = np.ones(len(some), bool)
    begins[1:] = group[1:] != group[:-1]
    first = some[np.maximum.accumulate(np.where(begins, np.arange(len(some)), 0))]
    at_first = (ids[some] == ids[first]) & (keys[some] == keys[first]) & (start[some] == start[first])
    known, dropped = np.zeros(len(both), bool), np.zeros(len(both), bool)
    known[some] = ~at_first
    dropped[some] = at_first & ~begins
    return known, dropped


def _cut_out(length: int):
    """Bytes of the listed chunks of each document; windows of hot anchors one by one."""
    names = ["meet", "doc_id", "text_key", "start", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches):
        for batch in batches:
            out = []
            for name, key, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for f in found:
                    start, size = f["start"], f["size"]
                    if not f["hot"]:
                        out.append((f["meet"], name, key, start, raw[start : start + size + length - 1]))
                        continue
                    own = np.frombuffer(raw[start : start + size + length - 1], np.uint8)
                    at = np.arange(size)
                    meets = T.signed(T.range_hashes(T.prefix_hashes(own), at, at + length))
                    out += [
                        (meets[i], name, key, start + i, raw[start + i : start + i + length]) for i in at.tolist()
                    ]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    return cut


def _covered(length: int):
    """Covered ranges among sorted rows; groups of one ``meet`` value are never split."""
    names = ["doc_id", "text_key", "start", "end"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        ids, keys = (table[c].to_numpy() for c in ("doc_id", "text_key"))
        begin, raw = table["start"].to_numpy(), table["bytes"].combine_chunks()
        order = np.lexsort((begin, keys, ids))
        i, k, b = ids[order], keys[order], begin[order]
        stated_twice = (i[1:] == i[:-1]) & (k[1:] == k[:-1]) & (b[1:] == b[:-1])
        order = order[np.concatenate([[True], ~stated_twice])]
        data, offsets = T.texts_of(raw.take(pa.array(order)))
        starts, sizes = offsets[:-1], np.diff(offsets) - length + 1
        found = covered_windows(data, starts, sizes, length)
        edge = np.zeros(len(found), bool)
        edge[np.cumsum(sizes) - sizes] = True
        previous = np.concatenate([[False], found[:-1]])
        run_first = np.flatnonzero(found & (edge | ~previous))
        following = np.concatenate([found[1:] & ~edge[1:], [False]])
        run_last = np.flatnonzero(found & ~following)
        row = np.searchsorted(np.cumsum(sizes), run_first, side="right")
        base = begin[order][row] - (np.cumsum(sizes) - sizes)[row]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[order][row]),
                pa.array(keys[order][row]),
                pa.array(base + run_first),
                pa.array(base + run_last + length),
            ],
            names=names,
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(4).nbytes
            if size < SORTED_BYTES:
                continue
            table = pa.Table.from_batches(held)
            meet, ends = table["meet"].to_numpy(), np.cumsum(_lengths(table))
            cuts = np.flatnonzero(meet[1:] != meet[:-1]) + 1
            done = 0
            while len(cuts) and cuts[-1] > done:
                limit = np.searchsorted(ends, (ends[done - 1] if done else 0) + SORTED_BYTES)
                own = cuts[(cuts > done) & (cuts <= limit)]
                stop = int(own[-1] if len(own) else cuts[cuts > done][0])
                yield solve(table.slice(done, stop - done))
                done = stop
            held = table.slice(done).combine_chunks().to_batches()
            size = sum(b.column(4).nbytes for b in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _lengths(table: pa.Table) -> np.ndarray:
    _, offsets = T.texts_of(table["bytes"])
    return np.diff(offsets)


def _keep(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        out = []
        for name, text, spans in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            raw, parts, done, removed, count, until = (text or "").encode(), [], 0, 0, 0, -1
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if s[0] > until:
                    count += 1
                    parts.append(raw[done : s[0]])
                until = max(until, s[1])
                done = until
            parts.append(raw[done:])
            kept = b"".join(parts)
            removed = len(raw) - len(kept)
            out.append((name, len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
        )


def covered_ranges(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Covered byte ranges (``start``, ``end``; they may overlap) of documents, by ``doc_id`` and
    ``text_key``, a hash of the text that tells documents with one id apart.

    Documents without id come after all others. Rows with equal id and text are one document.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.where(F.octet_length("text") >= length).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        "text",
    )
    found = rows.select("doc_id", "text_key", "text").mapInArrow(
        _scan(length), "meet long, chunk long, doc_id long, text_key long, place long"
    )
    # One shuffle and one sort by anchor serve all three window values.
    by_anchor = Window.partitionBy("meet")
    in_order = by_anchor.orderBy("chunk", "doc_id", "text_key", "place")
    fresh = F.lag("chunk").over(in_order).eqNullSafe(F.col("chunk"))
    twin = (F.lag("doc_id").over(in_order) == F.col("doc_id")) & (
        F.lag("place").over(in_order) == F.col("place")
    ) & (F.lag("text_key").over(in_order) == F.col("text_key"))
    ranked = found.select(
        "*",
        fresh.alias("again"),
        F.coalesce(twin, F.lit(False)).alias("twin"),
        F.lag("meet").over(in_order).isNull().alias("leads"),
        F.lead("meet").over(in_order).isNull().alias("trails"),
    ).where("NOT (leads AND trails) OR place % 2 = 1")
    repeated = scratch.store(
        ranked.where("NOT twin").select(
            "meet",
            "doc_id",
            "text_key",
            F.shiftright("place", _SPAN_BITS + 1).alias("start"),
            F.shiftright("place", 1).bitwiseAND((1 << _SPAN_BITS) - 1).alias("size"),
            (F.col("again") | (F.col("place") % 2 == 1)).alias("later"),
        )
    )
    direct = repeated.where("later").select(
        "doc_id", "text_key", "start", (F.col("start") + F.col("size") + (length - 1)).alias("end")
    )
    firsts = repeated.where("NOT later")
    # Stored, so that the join below reads plain shuffles, of which Spark can split a hot anchor's.
    several = scratch.store(firsts.groupBy("meet").agg(F.count("*").alias("n")).where("n > 1"))
    listed = (
        firsts.join(several, "meet")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("meet", "start", "size", (F.col("n") > hot).alias("hot"))).alias("found"))
    )
    pieces = rows.join(listed, ["doc_id", "text_key"])
    dealt = pieces.select("doc_id", "text_key", "text", "found").mapInArrow(
        _cut_out(length), "meet long, doc_id long, text_key long, start long, bytes binary"
    )
    compared = (
        dealt.repartition("meet")
        .sortWithinPartitions("meet")
        .mapInArrow(_covered(length), "doc_id long, text_key long, start long, end long")
    )
    return scratch.store(direct.unionByName(compared))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs),
    ``kept_sha256`` of the remaining bytes, and these as ``kept``.

    A null text counts as empty. Rows with equal id and text are one document stated twice: neither
    covers the other. Documents with one id and different texts are ordered by the texts' hashes,
    those without id come last. Other columns are ignored.
    """
    key = F.xxhash64("text").alias("text_key")
    ranges = covered_ranges(docs, length)
    spans = ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), "text", key).withColumn(
        "doc_id", F.coalesce("own", F.lit((1 << 63) - 1))
    )
    return (
        rows.join(spans, ["doc_id", "text_key"], "left")
        .select(F.col("own").alias("doc_id"), "text", "spans")
        .mapInArrow(
            _keep,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
        )
    )
