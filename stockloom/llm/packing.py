"""Packing token sequences with best-fit decreasing and certified bin counts.

Pieces are dealt to partitions evenly. Each partition is packed by best-fit decreasing, and a lower
bound from dual feasible functions on its lengths certifies its bin count when the two agree. While
the whole result has more bins than the bound on all lengths, partitions exchange documents: bins
that still have room are dissolved (all of a partition with a gap, the emptiest of a certified one),
their pieces are dealt anew to fewer partitions and packed again, and the outcome is kept if it
needs fewer bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm import text as T
from stockloom.llm.storage import Scratch
from stockloom.llm.tokens import word_tokens

END_ID = 0  # closes every document
PIECES_PER_PARTITION = 200_000
ROUNDS = 4

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PACKED_SCHEMA = PIECE_SCHEMA + ", part long, bin long, offset long, loose boolean"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """Each document's ids and a closing 0, cut into pieces of ``capacity`` where it is longer.

    A null text counts as empty. ``deal`` spreads pieces evenly over partitions, repeated rows
    included, and is the same when a task runs again.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32())] + [
        (name, pa.int64()) for name in ("start", "length", "ids_crc32", "deal")
    ])

    def cut(batches):
        tokens, row = word_tokens(tokenizer_path), 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for rows, data, offsets in T.blocks(batch):
                ids, bounds = tokens.encode(data, offsets)
                out = []
                for name, a, b in zip(names[rows], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        row += 1
                        out.append((name, piece, at, len(part), zlib.crc32(part.tobytes()), row))
                columns = list(zip(*out, strict=True))
                seed = np.array(columns[4], np.uint64) << np.uint64(32)
                deal = T.mix(seed + np.array(columns[5], np.uint64)) >> np.uint64(1)
                yield T.records(schema, [*columns[:5], deal.astype(np.int64)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A bound on the bins for ``counts[l]`` pieces of length l, from dual feasible functions.

    For each threshold t up to half the capacity, lengths above capacity - t count as a whole bin,
    lengths below t as nothing, others as themselves; each such function never lets one bin hold
    more than its capacity, so every rounded sum is a valid bound.
    """
    lengths = np.arange(capacity + 1, dtype=np.int64)
    number = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(counts * lengths)])
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = volume[capacity - t + 1] - volume[t]
    return int(np.max(large + -(-middle // capacity)))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset for each length, and every bin's fill."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room
    open_rooms, used = 0, []  # bit r is set if some bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, at = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = at, used[at]
        used[at] += size
        left = room - size
        if left:
            rooms[left].append(at)
            open_rooms |= 1 << left
    return bins, offsets, np.array(used, np.int64)


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("deal", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        # A certified partition offers only its emptiest bin for exchange, others every open one.
        gap = len(fill) > lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loose = (fill < capacity) & (gap | (np.arange(len(fill)) == np.argmin(fill)))
        extra = {"bin": bins, "offset": offsets, "loose": loose[bins]}
        for name, values in extra.items():
            table = table.append_column(name, pa.array(values))
        return table.select(
            ["doc_id", "piece", "start", "length", "ids_crc32", "deal", "part", "bin", "offset", "loose"]
        )

    return pack


def _packed(rows: DataFrame, parts: int, number: int, capacity: int) -> DataFrame:
    """Partition numbers are unique over the rounds, so that (part, bin) names a sequence."""
    dealt = rows.withColumn("part", F.pmod("deal", F.lit(parts)) + number)
    return dealt.groupBy("part").applyInArrow(_pack(capacity), PACKED_SCHEMA)


def _bins(rows: DataFrame) -> int:
    """Every sequence has exactly one piece at offset 0."""
    return rows.where("offset = 0").count()


def _bound(rows: DataFrame, capacity: int) -> int:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    return lower_bound(counts, capacity)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    per_partition: int = PIECES_PER_PARTITION,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and
    ``certified``: whether the whole packing meets the lower bound on its number of sequences.

    Pieces of a sequence lie gapless from offset 0. Every row of ``docs`` is packed, repeated and
    null ones too (a null or empty text is the closing 0 alone); other columns are ignored and an
    empty table gives no rows. No group is larger than about ``per_partition`` pieces.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.store(pieces(docs, tokenizer_path, capacity))
    parts = -(-max(rows.count(), 1) // per_partition)
    number, bound = parts, _bound(rows, capacity)
    done = scratch.store(_packed(rows, parts, 0, capacity))
    total = _bins(done)
    for _ in range(ROUNDS):
        if total <= bound or parts == 1:
            break
        loose = done.where("loose")
        parts = -(-max(loose.count(), 1) // per_partition)
        again = scratch.store(
            done.where("NOT loose").unionByName(
                _packed(loose.drop("part", "bin", "offset", "loose"), parts, number, capacity)
            )
        )
        number += parts
        if (count := _bins(again)) >= total:
            break
        done, total = again, count
    return done.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.shiftleft("part", 32) + F.col("bin")).alias("sequence_id"),
        "offset",
        F.lit(total == bound).alias("certified"),
    )
