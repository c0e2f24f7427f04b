"""Exact Jaccard join of n-gram sets by partitioning the universe of n-grams.

Sets with a Jaccard similarity of at least num/den differ in at most H = (den - num) / (den + num) of
the sum of their sizes. Sizes form bands such that a set's larger partners lie in its own band or the
next. A band hashes every n-gram to one of H + 1 segments (H for its largest pair), which cuts each
set into disjoint subsets. A set asks for partners in its own and in the next band: it spends a
budget of H + 1, with the sizes that its partners can have, on segments. One unit buys equality of
the subset (two sets that differ in no more than H places agree on some segment they both spend on);
two units, in the first ``DELETED`` segments, buy the one-deletion neighbourhood too, so that a
difference of one is found as well. The allocation takes the cheapest segments: small subsets are
frequent, so the largest come first, and a deletion neighbourhood replaces subsets of at most one
n-gram. Sets index all their segments in their own band only.

Equal sets are one node. Rows with equal signatures meet, and buckets of the same nodes become one.
Rows without a partner that sizes and parity sketches allow are left out: a sketch differs in no more
bits than the sets differ in n-grams, and the long ones have about as many bits as the set has n-grams,
so that they tell related texts from linked ones. A bucket's first node is compared with all others,
exactly, and what is linked becomes a component. Where a bucket still holds several components, each
node is compared with the one of another component whose sketch is nearest. At last, in buckets with
several components even then, all pairs across them are compared unless sizes or sketches rule them
out. No pair inside a component is listed, so a group of copies costs its size, not its square;
no link between components is lost.

How many links a document has is counted on demand inside each component, where all links lie: its
sets are cut into blocks, every pair of blocks is one product of incidence matrices, and only sums
per set leave the task. That takes the square of a component's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm import text as T
from stockloom.llm.components import components
from stockloom.llm.storage import Scratch

DELETED = 2  # segments with indexed one-deletion neighbourhoods
SEPARATORS = r"[\x20\x09-\x0D]"
BLOCK = 256  # sets of a component in one block
_COLUMNS = 4096  # n-grams that one product covers
_WORDS = 8  # 64-bit words of the short parity sketch of every set; a power of two
_LONGEST = 1 << 13  # bits that a long sketch is folded to before it travels with a signature
_FILTER_BITS = 1 << 23  # a filter of texts has a megabyte, whatever their number
_HELD_PAIRS = 1 << 18  # pairs that a task holds to tell repeated ones


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity num / den, and what follows from it."""

    num: int
    den: int

    def difference(self, total):
        """Most n-grams in which two linked sets differ, by the sum of their sizes."""
        return (self.den - self.num) * total // (self.den + self.num)

    def bands(self, largest: int) -> np.ndarray:
        """The largest size of each band, up to and one beyond ``largest``."""
        tops = [0, 1]
        while tops[-2] < largest:
            tops.append(max(tops[-1] + 1, tops[-1] * self.den // self.num))
        return np.array(tops)


def _node_ids(sets: list[np.ndarray]) -> np.ndarray:
    """One id per set, equal for equal sets."""
    sums = np.array([int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
    mixed = np.array([int(T.mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
    size = np.array([len(s) for s in sets], np.uint64)
    return T.signed(T.mix(sums + T.mix(mixed + size)))


def signatures(
    sets: list[np.ndarray], threshold: Threshold
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, whether the set asks with it) of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    values = np.concatenate(sets)
    tops = threshold.bands(int(sizes.max()))
    band = np.searchsorted(tops, sizes)
    partner = sizes * threshold.den // threshold.num  # the largest partner
    out = []
    for step in (0, 1):
        group = band + step
        top = tops[group]
        most = threshold.difference(2 * top)
        budget = threshold.difference(sizes + np.minimum(top, partner)) + 1
        # Different sets of sizes that allow no difference cannot link.
        use = (most > 0) & (partner > tops[group - 1]) & (budget > (1 if step else 0))
        if use.any():
            out.append(_in_band(values, sizes, group, most + 1, budget, use, index=step == 0))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (
        np.zeros(0, np.uint64),
        np.zeros(0, np.int64),
        np.zeros(0, bool),
    )


def _in_band(values, sizes, group, segments, budget, use, index: bool):
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values, owner = values[use[owner]], owner[use[owner]]
    base = np.where(use, segments, 0)
    base = np.cumsum(base) - base
    total = int((segments * use).sum())
    salt = T.mix(group.astype(np.uint64) + np.uint64(1 << 40))
    spread = T.mix(values + salt[owner])
    segment = (spread % segments[owner].astype(np.uint64)).astype(np.int64)
    slot = base[owner] + segment
    sums, hashed = np.zeros(total, np.uint64), T.mix(spread)
    np.add.at(sums, slot, hashed)
    counts = np.bincount(slot, minlength=total)

    who = np.repeat(np.flatnonzero(use), segments[use])
    own = np.arange(total) - base[who]
    order = np.lexsort((own, -counts, who))  # cheapest first: the largest subsets
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total) - base[who]
    need, plus = budget.copy(), np.zeros(total, bool)
    for j in range(DELETED):
        some = np.flatnonzero(use & (segments > j) & (need > 1))
        at = base[some] + j
        last = counts[order[base[some] + np.minimum(need[some], segments[some]) - 1]]
        short = need[some] > segments[some]
        swap = short | ((last <= 1) & (counts[at] > 1) & (rank[at] < need[some] - 1))
        plus[at[swap]] = True
        need[some[swap]] -= 1
    asks = (rank < need[who]) | plus
    tag = T.mix(own.astype(np.uint64) + salt[who])
    rows = asks | index
    found = [(T.mix(sums + tag)[rows], who[rows], asks[rows])]
    # Neighbourhoods: the subset itself and each subset without one n-gram, in a space of their own.
    beside = T.mix(tag + np.uint64(1))
    whole = (own < DELETED) & (plus | index)
    found.append((T.mix(sums + beside)[whole], who[whole], plus[whole]))
    single = (segment < DELETED) & (plus[slot] | index)
    at = slot[single]
    found.append((T.mix(sums[at] - hashed[single] + beside[at]), owner[single], plus[at]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _sets(batch: pa.RecordBatch, n: int):
    """(rows, n-gram sets) of a batch whose last column is the text."""
    table = T.byte_table(SEPARATORS)
    for rows, data, offsets in T.blocks(batch):
        hashes, _, _, per_text = T.words(data, offsets, table)
        yield rows, T.shingles(hashes, per_text, n)


def _describe(n: int):
    def describe(batches):
        for batch in batches:
            for rows, sets in _sets(batch, n):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(rows.start, rows.stop - rows.start),
                        "text_key": batch.column(1).slice(rows.start, rows.stop - rows.start),
                        "node": pa.array(_node_ids(sets)),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "short": pa.array([sketch(own).tobytes() for own in sets], pa.binary()),
                        "wide": pa.array([wide_sketch(own) for own in sets], pa.binary()),
                    }
                )

    return describe


def _sign(n: int, threshold: Threshold):
    def sign(batches):
        seen: set[int] = set()  # one set of a task stands for its equals
        for batch in batches:
            for _, sets in _sets(batch, n):
                fresh, nodes = [], []
                for node, own in zip(_node_ids(sets).tolist(), sets, strict=True):
                    if len(own) and node not in seen:
                        seen.add(node)
                        fresh.append(own)
                        nodes.append(node)
                signature, who, asks = signatures(fresh, threshold)
                yield pa.RecordBatch.from_pydict(
                    {
                        "signature": pa.array(T.signed(signature)),
                        "node": pa.array(np.array(nodes, np.int64)[who]),
                        "asks": pa.array(asks),
                    }
                )

    return sign


def _meet(batches):
    """Buckets of two or more nodes of which one asks, from rows sorted by signature and node.

    A bucket is renamed by a hash of its nodes: the many signatures that the same nodes share become
    one bucket. (Should two be named alike, their union only adds pairs to check.)"""
    names = ["signature", "node", "asks"]
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def shared(signature, node, asks) -> pa.RecordBatch:
        first = np.ones(len(signature), bool)
        first[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
        place = np.flatnonzero(first)
        asks = np.logical_or.reduceat(asks, place) if len(place) else asks
        signature, node = signature[place], node[place]
        begins = np.ones(len(signature), bool)
        begins[1:] = signature[1:] != signature[:-1]
        bucket = np.cumsum(begins) - 1
        size = np.bincount(bucket)
        asked = np.bincount(bucket, weights=asks) > 0
        keep = (size[bucket] > 1) & asked[bucket]
        name = np.add.reduceat(T.mix(node.view(np.uint64)), np.flatnonzero(begins)) if len(node) else node
        name = T.signed(T.mix(name.view(np.uint64) + size.astype(np.uint64)))[bucket]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (name, node, asks)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        rows = tuple(np.concatenate(pair) for pair in zip(held, columns, strict=True))
        open_from = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
        if open_from:
            yield shared(*(c[:open_from] for c in rows))
        held = tuple(c[open_from:] for c in rows)
    if len(held[0]):
        yield shared(*held)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the number of n-grams per hash value, as 64-bit words."""
    bit = T.mix(own ^ np.uint64(77))
    words = np.zeros(_WORDS, np.uint64)
    np.bitwise_xor.at(
        words, (bit >> np.uint64(61)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))
    )
    return words


def wide_sketch(own: np.ndarray) -> bytes:
    """A parity sketch with about as many bits as the set has n-grams, a power of two up to a limit."""
    bits = min(1 << max(9, (len(own) - 1).bit_length()), _LONGEST)
    place = (T.mix(own ^ np.uint64(78)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ; the longer is folded to the shorter one's width."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _key_filter(keys: DataFrame) -> bytes:
    """Bits that are set where a text key of ``keys`` falls; of a fixed number."""
    place = F.col("text_key").bitwiseAND(F.lit(_FILTER_BITS - 1))
    bits = keys.groupBy(F.shiftright(place, 15).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(place % 32768).alias("bits")
    )
    out = bytearray(_FILTER_BITS // 8)
    for row in bits.collect():  # at most _FILTER_BITS / 32768 rows
        out[row.part * 4096 : (row.part + 1) * 4096] = row.bits
    return bytes(out)


def _with_keys_in(bits: bytes):
    """Rows whose text key, the second column, falls on a set bit: all wanted ones and a few more."""

    def keep(batches):
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            place = batch.column(1).to_numpy() & (_FILTER_BITS - 1)
            yield batch.filter(pa.array(table[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0))

    return keep


def _detail(n: int):
    """Sets of the texts of wanted nodes; repeated rows of a task count once."""

    def detail(batches):
        seen: set[int] = set()
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for rows, sets in _sets(batch, n):
                found = []
                for want, node, own in zip(wanted[rows], _node_ids(sets).tolist(), sets, strict=True):
                    if node == want and node not in seen:
                        seen.add(node)
                        found.append((node, own))
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array([node for node, _ in found], pa.int64()),
                        "grams": pa.array([own.tobytes() for _, own in found], pa.binary()),
                    }
                )

    return detail


_INFO = "doc_id long, text_key long, node long, n long, short binary, wide binary"


def _linked(threshold: Threshold):
    def linked(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(threshold.den * common >= threshold.num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def _side(details: DataFrame, side: str, *columns: str) -> DataFrame:
    return details.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def _near(threshold: Threshold):
    def near(batches):
        for batch in batches:
            _, _, n_a, a, n_b, b = (c.to_pylist() for c in batch.columns)
            keep = [
                sketch_distance(x, y) <= threshold.difference(i + j)
                for i, x, j, y in zip(n_a, a, n_b, b, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near


def _narrowed(pairs: DataFrame, details: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs that long sketches, far smaller than the sets, don't rule out."""
    return (
        pairs.join(_side(details, "a", "n", "wide"), "a")
        .join(_side(details, "b", "n", "wide"), "b")
        .select("a", "b", "n_a", "wide_a", "n_b", "wide_b")
        .mapInArrow(_near(threshold), "a long, b long")
    )


def _verify(pairs: DataFrame, details: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs that are linked."""
    sets = pairs.join(_side(details, "a", "grams"), "a").join(_side(details, "b", "grams"), "b")
    return sets.select("a", "b", "grams_a", "grams_b").mapInArrow(_linked(threshold), "a long, b long")


class _Sketches:
    """Long sketches of the rows of a bucket, of 2 ** level bits each."""

    def __init__(self, column: pa.Array):
        data, ends = T.texts_of(column)
        self._words, self._at = data.view(np.uint64), ends[:-1] // 8
        self.level = np.log2(np.maximum(np.diff(ends) * 8, 1)).round().astype(np.int64)

    def _folded(self, rows: np.ndarray, level: int) -> np.ndarray:
        out = np.zeros((len(rows), 1 << (level - 6)), np.uint64)
        for own in np.unique(self.level[rows]).tolist():
            at = np.flatnonzero(self.level[rows] == own)
            width = 1 << (own - 6)
            words = self._words[self._at[rows[at]][:, None] + np.arange(width)]
            while words.shape[1] > out.shape[1]:
                half = words.shape[1] // 2
                words = words[:, :half] ^ words[:, half:]
            out[at] = words
        return out

    def distances(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of pairs of rows differ, the longer one folded."""
        common, out = np.minimum(self.level[left], self.level[right]), np.zeros(len(left), np.int64)
        for level in np.unique(common).tolist():
            at = np.flatnonzero(common == level)
            step = max(1, (1 << 18) >> (level - 6))
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                differing = self._folded(left[part], level) ^ self._folded(right[part], level)
                out[part] = np.bitwise_count(differing).sum(axis=1)
        return out


def _across(threshold: Threshold, nearest: bool):
    """Pairs of different components in a bucket, one of which asks, that sizes and sketches allow:
    all of them, or for each row the one with the nearest sketch. Rows come sorted by signature."""

    def solve(columns: list[np.ndarray], sketches: _Sketches):
        signature, node, asks, label, n = columns
        best = np.full(len(node), np.iinfo(np.int64).max)
        partner = np.full(len(node), -1)
        for step in range(1, len(signature)):
            left = np.flatnonzero(signature[step:] == signature[:-step])
            if not len(left):
                break
            right = left + step
            small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            keep = (label[left] != label[right]) & (asks[left] | asks[right])
            keep &= small * threshold.den >= large * threshold.num
            left, right, most = left[keep], right[keep], threshold.difference(small + large)[keep]
            bits = sketches.distances(left, right)
            near = bits <= most
            left, right, bits = left[near], right[near], bits[near]
            if not nearest:
                yield node[left], node[right]
                continue
            for one, other in ((left, right), (right, left)):  # each row is there once a step
                closer = bits < best[one]
                best[one[closer]], partner[one[closer]] = bits[closer], other[closer]
        if nearest:
            found = np.flatnonzero(partner >= 0)
            yield node[found], node[partner[found]]

    def across(batches):
        held = [np.zeros((0, 2), np.int64)]
        for columns, sketches in _buckets(batches):
            for one, other in solve(columns, sketches):
                held.append(np.stack([np.minimum(one, other), np.maximum(one, other)], axis=1))
            if sum(map(len, held)) > _HELD_PAIRS:
                held = [np.unique(np.concatenate(held), axis=0)]
                if len(held[0]) > _HELD_PAIRS // 2:
                    yield _pair_batch(held[0])
                    held = []
        if held:
            yield _pair_batch(np.unique(np.concatenate(held), axis=0))
        T.release()

    return across


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _buckets(batches):
    """Whole buckets of rows that come sorted by signature: plain columns, and sketches of the last
    one. Small buckets come together, a large one alone."""
    held: list[pa.RecordBatch] = []

    def parts(rows: pa.Table):
        signature = rows.column(0).to_numpy()
        begins = np.flatnonzero(np.diff(signature, prepend=signature[0] - 1))
        size = np.diff(np.append(begins, len(signature)))
        small = np.repeat(size <= 64, size)
        groups = [rows.filter(pa.array(small))] if small.any() else []
        groups += [rows.slice(b, n) for b, n in zip(begins.tolist(), size.tolist(), strict=True) if n > 64]
        for group in groups:
            plain = [c.to_numpy() for c in group.columns[:-1]]
            yield plain, _Sketches(group.column(group.num_columns - 1))

    for batch in batches:
        if not batch.num_rows:
            continue
        signature = batch.column(0).to_numpy()
        open_from = int(np.searchsorted(signature, signature[-1]))
        if held and signature[0] != held[-1].column(0)[held[-1].num_rows - 1].as_py():
            yield from parts(pa.Table.from_batches(held))
            held = []
        if open_from:
            held.append(batch.slice(0, open_from))
            yield from parts(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(open_from))
    if held:
        yield from parts(pa.Table.from_batches(held))


def _possible_rows(threshold: Threshold):
    """Rows that have a partner in their bucket, one of the two asking, that sizes and sketches allow;
    with each the first such node of the bucket."""

    def solve(columns: list[np.ndarray], sketches: _Sketches) -> pa.RecordBatch:
        signature, node, asks, n = columns
        found = np.zeros(len(node), bool)
        for step in range(1, len(signature)):
            left = np.flatnonzero(signature[step:] == signature[:-step])
            if not len(left):
                break
            left = left[~(found[left] & found[left + step])]  # both are known: a group ends early
            right = left + step
            small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            keep = (asks[left] | asks[right]) & (small * threshold.den >= large * threshold.num)
            left, right, most = left[keep], right[keep], threshold.difference(small + large)[keep]
            near = sketches.distances(left, right) <= most
            found[left[near]] = True
            found[right[near]] = True
            if found.all():
                break
        signature, node, asks = signature[found], node[found], asks[found]
        begins = np.flatnonzero(np.diff(signature, prepend=signature[0] - 1)) if len(node) else []
        leader = np.repeat(node[begins], np.diff(np.append(begins, len(node)))) if len(node) else node
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (signature, node, asks, leader)], names=["signature", "node", "asks", "leader"]
        )

    def possible(batches):
        for columns, sketches in _buckets(batches):
            yield solve(columns, sketches)
        T.release()

    return possible


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), count_links: bool = False
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``; with ``count_links`` also ``n_links``.

    A document's set holds its distinct shingles of ``words`` words (lower-cased A-Z, split at ASCII
    white space); with fewer words, the whole sequence. Documents link if their sets' Jaccard
    similarity reaches ``similarity`` (a fraction); ``component_id`` is the smallest ``doc_id``
    reachable by links and ``n_links`` the number of rows it links with, whose count compares all
    pairs of different texts of a component. A document without words (null, empty, blank) links
    with nothing and is its own component. Rows with one id are separate documents; a row without id takes part in links
    and is reported with the id of its component. Other columns are ignored.
    """
    threshold, scratch = Threshold(*similarity), Scratch(docs.sparkSession, "jaccard")
    info, labels, details = _joined(docs, words, threshold, scratch)
    named, least = _labelled(info, labels, scratch)
    found = named.join(least, "label", "left")
    columns = [
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("least.doc_id", "doc_id").alias("component_id"),
    ]
    if count_links:
        copies = info.where("n > 0").groupBy("node").agg(F.count("*").alias("copies"))
        counted = copies.join(_links(details, labels, copies, threshold), "node", "left").select(
            "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        )
        found = found.join(counted, "node", "left")
        columns.append(F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).alias("n_links"))
    return found.select(*columns)


def keep_one(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`: that of the smallest
    ``doc_id`` (null last, then by the text's hash). All columns stay, and so do documents without
    words. Of rows with the same id and text, one stays."""
    threshold, scratch = Threshold(*similarity), Scratch(docs.sparkSession, "jaccard")
    info, labels, _ = _joined(docs, words, threshold, scratch)
    named, least = _labelled(info, labels, scratch)
    gone = named.join(least, "label").where(
        ~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))
    )
    key = F.xxhash64("doc_id", "text_key").alias("row_key")
    gone = gone.select(key).distinct()
    again = named.where("label IS NOT NULL").groupBy(key).count().where("count > 1")
    row_key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    rows = docs.select(row_key.alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(gone, "row_key", "left_anti")
    if not again.isEmpty():
        blank = left.join(named.where("label IS NULL").select(key).distinct(), "row_key", "left_semi")
        left = left.join(blank.select("row_key").distinct(), "row_key", "left_anti")
        left = left.dropDuplicates(["row_key"]).unionByName(blank)
    return left.select("row.*")


def _joined(
    docs: DataFrame, words: int, threshold: Threshold, scratch: Scratch
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row its node and set size; components of the linked nodes; sets of the candidates."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    info = scratch.store(
        rows.mapInArrow(_describe(words), _INFO)
    )
    return info, *_components(rows, info, words, threshold, scratch)


def _labelled(
    info: DataFrame, labels: DataFrame, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """Per row its ``label`` (null without words), and per label its first row's id and text hash.

    The latter is stored, so that joins to it read plain shuffles, of which Spark can split a hot
    label's."""
    label = F.when(F.col("n") == 0, None).otherwise(F.coalesce("component", "node"))
    named = info.join(labels, "node", "left").select("doc_id", "text_key", "node", "n", label.alias("label"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("least"))
    return named, scratch.store(least)


def _links(
    details: DataFrame, labels: DataFrame, copies: DataFrame, threshold: Threshold
) -> DataFrame:
    """``node, links``: the rows of other nodes that each node links with."""
    members = labels.groupBy("component").agg(F.count("*").alias("members"))
    own = labels.join(members, "component").select(
        "node",
        "component",
        F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = (
        details.select("node", "grams")
        .join(own, "node")
        .join(copies, "node")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "component",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "block",
            "node",
            "copies",
            "grams",
        )
    )
    pairs_of = ("component", "i", "j")
    return (
        rows.repartition(*pairs_of)
        .sortWithinPartitions(*pairs_of)
        .mapInArrow(_count_links(threshold), "node long, links long")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)), np.float32)  # exact below 2 ** 24
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for begin in range(0, int(place[-1]) + 1, _COLUMNS):
        a, b = np.searchsorted(place, (begin, begin + _COLUMNS))
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[owner[a:b], place[a:b] - begin] = 1
        common += part @ part.T
    return common.astype(np.int64)


def _count_links(threshold: Threshold):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        _, i, j, block, node, copies, grams = zip(*rows, strict=True)
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        size, common = np.array([len(s) for s in sets]), _common(sets)
        either = size[:, None] + size[None, :] - common
        linked = threshold.den * common >= threshold.num * either
        np.fill_diagonal(linked, False)
        if i[0] != j[0]:  # pairs inside a block are counted where it meets itself
            side = np.array(block)
            linked &= side[:, None] != side[None, :]
        return pa.RecordBatch.from_pydict(
            {"node": pa.array(node, pa.int64()), "links": pa.array(linked @ np.array(copies))}
        )

    def count(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return count


def _components(
    rows: DataFrame, info: DataFrame, words: int, threshold: Threshold, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """``node, component`` of the nodes that have links, and the sets of all that may have some."""
    signed = rows.select("text").mapInArrow(
        _sign(words, threshold), "signature long, node long, asks boolean"
    )
    shared = scratch.store(
        signed.repartition("signature")
        .sortWithinPartitions("signature", "node")
        .mapInArrow(_meet, "signature long, node long, asks boolean")
        .groupBy("signature", "node")
        .agg(F.max("asks").alias("asks"))
    )
    missing = F.lit(-(1 << 63))
    row_key = (F.coalesce("doc_id", missing).alias("row_id"), F.col("text_key"))
    # Of the nodes that met others, few have one that sizes and sketches allow: short sketches say so
    # of most rows, long ones of what is left.
    met = shared.select("node").distinct()
    sketches = scratch.store(
        info.groupBy("node")
        .agg(
            F.min(F.struct(*row_key)).alias("first"),
            F.first("n").alias("n"),
            F.first("short").alias("short"),
            F.first("wide").alias("wide"),
        )
        .join(met, "node")
    )
    rows_left, possible = shared, "signature long, node long, asks boolean, leader long"
    for sketch_column in ("short", "wide"):
        rows_left = scratch.store(
            rows_left.select("signature", "node", "asks")
            .join(sketches.select("node", "n", sketch_column), "node")
            .select("signature", "node", "asks", "n", sketch_column)
            .repartition("signature")
            .sortWithinPartitions("signature")
            .mapInArrow(_possible_rows(threshold), possible)
        )
    scratch.drop(shared)
    wanted = scratch.store(
        sketches.join(rows_left.select("node").distinct(), "node").select("node", "first.*", "n", "wide")
    )
    scratch.drop(sketches)
    # Few texts are wanted: most are left out by a filter of bounded size before they travel. They are
    # stored, so that no task runs two Python workers.
    texts = scratch.store(
        rows.select(*row_key, "text").mapInArrow(
            _with_keys_in(_key_filter(wanted)), "row_id long, text_key long, text string"
        )
    )
    sets = scratch.store_by(
        texts.join(wanted.select("row_id", "text_key", "node"), ["row_id", "text_key"])
        .select("node", "text")
        .mapInArrow(_detail(words), "node long, grams binary"),
        "node",
    )
    scratch.drop(texts)
    stars = rows_left.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    compared = scratch.store(_narrowed(stars, wanted, threshold))
    links = scratch.store(_verify(compared, sets, threshold))
    labels = components(links, scratch)
    for nearest in (True, False):
        pairs = scratch.store(
            _open_rows(rows_left, labels, wanted)
            .repartition("signature")
            .sortWithinPartitions("signature")
            .mapInArrow(_across(threshold, nearest), "a long, b long")
            .distinct()
            .join(compared, ["a", "b"], "left_anti")
        )
        more = scratch.store(_verify(pairs, sets, threshold))
        compared = compared.unionByName(pairs)
        if not more.isEmpty():
            known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = components(known.unionByName(more), scratch)
    scratch.drop(rows_left, wanted)
    return scratch.store(labels), sets


def _open_rows(rows: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with sizes and long sketches."""
    labelled = rows.join(labels, "node", "left").select(
        "signature", "node", "asks", F.coalesce("component", "node").alias("label")
    )
    mixed = labelled.groupBy("signature").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    return (
        labelled.join(mixed.where("x != y").select("signature"), "signature", "left_semi")
        .join(wanted.select("node", "n", "wide"), "node")
        .select("signature", "node", "asks", "label", "n", "wide")
    )
