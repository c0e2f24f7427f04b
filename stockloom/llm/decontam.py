"""Benchmark passages in training texts, found with a distributed positional inverted index.

The index is a table in the shared folder: for each term of the benchmark and each document that holds
it the word positions, and for each document its number of words. It is dealt into shards of documents of
bounded size, the benchmark's windows into blocks, and each block meets each shard once; neither passes
through the driver. There a window starts from the posting list of its rarest term and intersects the
other terms' lists, shifted by their offsets, rarest first. What is left are exact phrase matches. A start
that has most of a window's terms within ``slop`` words of their place is a proximity match; of as many of
the rarest terms as may be missing and one more, absent ones included, one at least is there, so all such
starts come from their postings. No text is shuffled.

:func:`keep_clean` needs exact matches alone and makes its postings per block of texts instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm import text as T
from stockloom.llm.storage import Scratch

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"  # of the lower-cased text
ITEM_BYTES = 8_000_000  # benchmark text that one pass of keep_clean holds in a task
SHARD_WORDS = 4_000_000  # words of the documents in a shard, about
BLOCK_WINDOWS = 20_000  # windows of the benchmark in a block, about
NEAR_STARTS = 1_000_000  # starts of proximity matches that are looked at together

_INDEX = "term long, row long, id long, n long, places array<int>"
_FOUND = "row long, id long, n long, spans array<struct<start:int,end:int>>, windows array<long>, near array<long>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@dataclass(frozen=True)
class Phrases:
    """Windows of the benchmark over a vocabulary of term hashes."""

    vocabulary: np.ndarray  # sorted hashes
    terms: np.ndarray  # windows x width, index into the vocabulary, -1 beyond a window's end
    lengths: np.ndarray
    owner_starts: np.ndarray  # items of window w: owners[owner_starts[w]:owner_starts[w + 1]]
    owners: np.ndarray
    names: list[str]


def phrases(items: list[tuple[str | None, str | None]], width: int) -> Phrases:
    """Every run of ``width`` words of an item; an item with fewer words is one window."""
    names = sorted({name for name, _ in items if name is not None})
    index = {name: i for i, name in enumerate(names)}
    data, offsets = T.texts_of(pa.array([text for _, text in items], pa.string()))
    hashes, _, _, per_text = T.words(data, offsets, T.byte_table(SEPARATORS))
    vocabulary = np.unique(hashes)
    ids = np.searchsorted(vocabulary, hashes)
    windows: dict[tuple[int, ...], set[int]] = {}
    for row, (name, _) in enumerate(items):
        own = ids[per_text[row] : per_text[row + 1]].tolist()
        for at in range(max(1, len(own) - width + 1) if own else 0):
            owners = windows.setdefault(tuple(own[at : at + width]), set())
            if name is not None:
                owners.add(index[name])
    terms = np.full((len(windows), width), -1, np.int64)
    for row, window in enumerate(windows):
        terms[row, : len(window)] = window
    counts = [len(owners) for owners in windows.values()]
    return Phrases(
        vocabulary,
        terms,
        (terms >= 0).sum(axis=1),
        np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]),
        np.array([o for owners in windows.values() for o in sorted(owners)], np.int64),
        names,
    )


def find(
    hashes: np.ndarray, per_text: np.ndarray, wanted: Phrases, slop: int, share: float
) -> tuple[np.ndarray, ...]:
    """:func:`find_terms` in texts given as word hashes."""
    if len(wanted.vocabulary):
        ids = np.searchsorted(wanted.vocabulary, hashes)
        ids[ids == len(wanted.vocabulary)] = 0
        ids[wanted.vocabulary[ids] != hashes] = -2
    else:
        ids = np.full(len(hashes), -2)
    return find_terms(ids, per_text, wanted, slop, share)


def find_terms(
    ids: np.ndarray, per_text: np.ndarray, wanted: Phrases, slop: int, share: float
) -> tuple[np.ndarray, ...]:
    """(window, start) of the exact matches, then (window, text) of the proximity matches.

    ``ids`` has a place in the vocabulary for each word of the texts, -2 for other words.
    """
    none = np.zeros(0, np.int64)
    if not len(ids) or not len(wanted.terms):
        return none, none, none, none
    count = np.bincount(ids[ids >= 0], minlength=len(wanted.vocabulary))
    present = np.where(wanted.terms >= 0, count[wanted.terms], np.iinfo(np.int64).max)
    order = np.argsort(present, axis=1, kind="stable")  # offsets of a window, rarest term first
    rows = np.arange(len(wanted.terms))
    pivot = wanted.terms[rows, order[:, 0]]

    places = np.flatnonzero(ids >= 0)
    places = places[np.argsort(ids[places], kind="stable")]
    first = np.cumsum(count) - count
    size = count[pivot]
    window = np.repeat(rows, size)
    within = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
    start = places[np.repeat(first[pivot], size) + within] - order[window, 0]
    text = np.searchsorted(per_text, start + order[window, 0], side="right") - 1
    fits = (start >= per_text[text]) & (start + wanted.lengths[window] <= per_text[text + 1])
    window, start = window[fits], start[fits]
    for j in range(1, wanted.terms.shape[1]):
        offset = order[window, j]
        inside = j < wanted.lengths[window]
        same = ids[np.where(inside, start + offset, 0)] == wanted.terms[window, offset]
        window, start = window[same | ~inside], start[same | ~inside]

    # Terms of each window that may be missing; more absent ones rule it out in this block.
    spare = wanted.lengths - np.ceil(share * wanted.lengths - 1e-9).astype(np.int64)
    possible = (present == 0).sum(axis=1) <= spare
    near = [(none, none)]
    for rank in range(min(int(spare.max()) + 1, wanted.terms.shape[1])):
        # Starts whose terms of lower rank are missing; the others come from those terms.
        own = rows[possible & (spare >= rank) & (rank < wanted.lengths)]
        near += _near(ids, per_text, wanted, slop, order, spare, own, rank, places, first, count)
    near_window, near_text = map(np.concatenate, zip(*near, strict=True))
    return window, start, near_window, near_text


def _near(ids, per_text, wanted, slop, order, spare, own, rank, places, first, count):
    """(window, text) of the proximity matches of the windows ``own`` whose rarest term in its place
    is that of rank ``rank``, each pair once in a yield."""
    pivot = wanted.terms[own, order[own, rank]]
    ends = np.cumsum(count[pivot])
    shifts = np.arange(-slop, slop + 1)
    step = max(1, NEAR_STARTS // len(shifts))
    for at in range(0, int(ends[-1]) if len(ends) else 0, step):
        flat = np.arange(at, min(at + step, int(ends[-1])))
        row = np.searchsorted(ends, flat, side="right")
        place = places[first[pivot[row]] + flat - (ends[row] - count[pivot[row]])]
        text = np.repeat(np.searchsorted(per_text, place, side="right") - 1, len(shifts))
        window = np.repeat(own[row], len(shifts))
        start = ((place - order[own[row], rank])[:, None] + shifts).ravel()
        missing = np.full(len(window), rank)
        for j in range(rank + 1, wanted.terms.shape[1]):
            offset = order[window, j]
            term, there = wanted.terms[window, offset], j >= wanted.lengths[window]
            for shift in shifts.tolist():
                spot = start + offset + shift
                inside = (spot >= per_text[text]) & (spot < per_text[text + 1])
                there |= inside & (ids[np.where(inside, spot, 0)] == term)
            missing += ~there
            alive = missing <= spare[window]
            window, start, text, missing = window[alive], start[alive], text[alive], missing[alive]
        pairs = np.unique(np.stack([window, text], axis=1), axis=0)
        yield pairs[:, 0], pairs[:, 1]


def _owners(wanted: Phrases, window: np.ndarray, text: np.ndarray) -> dict[int, list[str]]:
    named: dict[int, set[int]] = {}
    for w, t in zip(window.tolist(), text.tolist(), strict=True):
        own = wanted.owners[wanted.owner_starts[w] : wanted.owner_starts[w + 1]]
        named.setdefault(t, set()).update(own.tolist())
    return {t: [wanted.names[i] for i in sorted(found)] for t, found in named.items()}


def _post(batches):
    """A posting with its positions for each distinct term of a text, and a row without term for the
    text itself."""
    table, base = T.byte_table(SEPARATORS), T.row_base()
    for batch in batches:
        for rows, data, offsets in T.blocks(batch):
            hashes, _, _, per_text = T.words(data, offsets, table)
            count = rows.stop - rows.start
            own, words = batch.column(0).slice(rows.start, count), np.diff(per_text)
            text = np.repeat(np.arange(count), words)
            order = np.lexsort((hashes, text))
            first = np.ones(len(order), bool)
            first[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
            begins = np.flatnonzero(first)
            holder = text[order[begins]]
            places = pa.array((order - per_text[text[order]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(T.signed(hashes[order[begins]])),
                    pa.array(base + holder),
                    own.take(pa.array(holder, pa.int64())),
                    pa.array(words[holder]),
                    pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), places),
                ],
                names=["term", "row", "id", "n", "places"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(count, pa.int64()),
                    pa.array(base + np.arange(count)),
                    own,
                    pa.array(words),
                    pa.nulls(count, pa.list_(pa.int32())),
                ],
                names=["term", "row", "id", "n", "places"],
            )
            base += count


def _windows_of(width: int):
    """The windows of each item: a number by their terms, the item's name, and the term hashes."""

    def cut(batches):
        table = T.byte_table(SEPARATORS)
        for batch in batches:
            for rows, data, offsets in T.blocks(batch):
                hashes, _, _, per_text = T.words(data, offsets, table)
                number, name, terms = [], [], []
                for own, a, b in zip(batch.column(0)[rows.start : rows.stop].to_pylist(), per_text[:-1], per_text[1:], strict=True):
                    for at in range(a, max(b - width + 1, a + (b > a))):
                        window = hashes[at : min(at + width, b)]
                        name.append(own)
                        terms.append(T.signed(window))
                        mixed = np.uint64(len(window))
                        for h in window:
                            mixed = T.mix(np.array([mixed ^ h]))[0]
                        number.append(int(mixed.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int64()), pa.array(name, pa.string()), pa.array(terms, pa.list_(pa.int64()))],
                    names=["window", "name", "terms"],
                )

    return cut


def _meet(slop: int, share: float):
    """The matches of one block's windows in one shard of the index."""

    def meet(index: pa.Table, windows: pa.Table) -> pa.Table:
        index = index.combine_chunks()
        whole = index.filter(index["term"].is_null()).sort_by("row")
        rows, n = whole["row"].to_numpy(), whole["n"].to_numpy()
        per_text = np.append(0, np.cumsum(n))
        terms = windows["terms"].combine_chunks()
        lengths = np.diff(terms.offsets.to_numpy())
        flat = terms.flatten().to_numpy()
        vocabulary = np.unique(flat)
        matrix = np.full((len(lengths), int(lengths.max()) if len(lengths) else 0), -1, np.int64)
        matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = np.searchsorted(vocabulary, flat)
        wanted = Phrases(vocabulary, matrix, lengths.astype(np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), [])

        postings = index.filter(index["term"].is_valid())
        ids = np.full(int(per_text[-1]), -2, np.int64)
        if postings.num_rows and len(vocabulary):
            places = postings["places"].combine_chunks()
            sizes = np.diff(places.offsets.to_numpy())
            term = np.searchsorted(vocabulary, postings["term"].to_numpy())
            start = per_text[np.searchsorted(rows, postings["row"].to_numpy())]
            ids[np.repeat(start, sizes) + places.flatten().to_numpy()] = np.repeat(term, sizes)
        window, start, near, near_text = find_terms(ids, per_text, wanted, slop, share)
        text = np.searchsorted(per_text, start, side="right") - 1
        numbers = windows["window"].to_numpy()
        spans = _spans_of(text, start - per_text[text], wanted.lengths[window])
        return pa.table(
            [
                whole["row"],
                whole["id"],
                whole["n"],
                pa.array([spans.get(i, []) for i in range(len(rows))], _SPANS),
                _per_text(text, numbers[window], len(rows)),
                _per_text(near_text, numbers[near], len(rows)),
            ],
            names=["row", "id", "n", "spans", "windows", "near"],
        )

    return meet


def _per_text(text: np.ndarray, numbers: np.ndarray, rows: int) -> pa.Array:
    """The distinct numbers of each text, as lists."""
    pairs = np.unique(np.stack([text, numbers], axis=1), axis=0)
    ends = np.append(0, np.cumsum(np.bincount(pairs[:, 0], minlength=rows)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs[:, 1].copy(), pa.int64()))


def _spans_of(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> dict[int, list]:
    """Per text the unions of the word ranges of its matches."""
    spans: dict[int, list] = {}
    for t, a, b in sorted(zip(text.tolist(), start.tolist(), (start + length).tolist(), strict=True)):
        own = spans.setdefault(t, [])
        if own and a <= own[-1]["end"]:
            own[-1]["end"] = max(b, own[-1]["end"])
        else:
            own.append({"start": a, "end": b})
    return spans


def benchmark_matches(
    docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, share: float = 0.8
) -> DataFrame:
    """Benchmark passages per document: ``doc_id, n_words, spans, item_ids, near_ids``.

    ``spans`` are the merged word ranges (end exclusive) inside any occurrence of a window of
    ``window`` consecutive item words (the whole item, if it has fewer words). ``item_ids`` are the
    items with such occurrences, as sorted strings; ``near_ids`` those with a proximity match:
    ``share`` of a window's terms within ``slop`` words of their place (exact matches included).

    A null text has no words, a null or wordless item no window; an item without id marks words but
    is not named. Repeated items and documents count as they stand: one row per input row. Other
    columns are ignored. Terms and windows are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession, "positions")
    asked = scratch.store(
        items.select(F.col("item_id").cast("string"), "text").mapInArrow(
            _windows_of(window), "window long, name string, terms array<long>"
        )
    )
    owners = scratch.store(asked.where("name IS NOT NULL").select("window", "name").distinct())
    windows = scratch.store(asked.groupBy("window").agg(F.first("terms").alias("terms")))
    vocabulary = scratch.store(windows.select(F.explode("terms").alias("term")).distinct().withColumn("asked", F.lit(True)))
    index = scratch.store(
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_post, _INDEX)
        .join(vocabulary, "term", "left")
        .where("asked OR term IS NULL")
        .drop("asked")
    )
    words = index.where("term IS NULL").agg(F.sum("n")).first()[0] or 0
    shards, blocks = -(-max(words, 1) // SHARD_WORDS), -(-max(windows.count(), 1) // BLOCK_WINDOWS)
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long").alias("shard")
    blocked = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("long"))
    needed = scratch.store(blocked.select(F.explode("terms").alias("term"), "block").distinct())
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    postings = index.where("term IS NOT NULL").join(needed, "term").select("term", "row", "id", "n", "places", "block", shard)
    texts = index.where("term IS NULL").select("term", "row", "id", "n", "places", every).select("*", shard)
    dealt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    found = scratch.store(
        postings.unionByName(texts)
        .groupBy("shard", "block")
        .cogroup(blocked.select("window", "terms", "block", dealt).groupBy("shard", "block"))
        .applyInArrow(_meet(slop, share), _FOUND)
    )
    whole = found.groupBy("row").agg(
        F.first("id").alias("doc_id"),
        F.first("n").alias("n_words"),
        _merged_spans(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    for matches, column in (("windows", "item_ids"), ("near", "near_ids")):
        named = (
            found.select("row", F.explode(matches).alias("window"))
            .join(owners, "window")
            .groupBy("row")
            .agg(F.sort_array(F.collect_set("name")).alias(column))
        )
        whole = whole.join(named, "row", "left")
    none = F.array().cast("array<string>")
    return whole.select(
        "doc_id", "n_words", "spans", *[F.coalesce(c, none).alias(c) for c in ("item_ids", "near_ids")]
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of an item word for word; all columns stay."""
    table = T.byte_table(SEPARATORS)
    for wanted in _parts(items, window):

        def decide(wanted=wanted):
            def clean(batch: pa.RecordBatch) -> np.ndarray:
                free = np.ones(batch.num_rows, bool)
                for rows, data, offsets in T.blocks(batch):
                    hashes, _, _, per_text = T.words(data, offsets, table)
                    _, start, _, _ = find(hashes, per_text, wanted, 0, 2.0)
                    free[rows.start + np.searchsorted(per_text, start, side="right") - 1] = False
                return free

            return clean

        docs = T.keep_rows(docs, decide)
    return docs


def _parts(items: DataFrame, window: int) -> list[Phrases]:
    """The items' windows, in parts of about ``ITEM_BYTES`` of text."""
    items = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("phrase"))
    size = items.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = -(-max(size, 1) // ITEM_BYTES)
    mine = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    return [
        phrases([tuple(r) for r in items.where(F.coalesce(mine, F.lit(0)) == part).collect()], window)
        for part in range(parts)
    ]


def _merged_spans(spans: Column):
    """Unions of overlapping or touching ranges of a sorted array."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")
        )
        return F.when(
            (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def hit_words(spans: str = "spans"):
    """Number of words inside the spans."""
    return F.aggregate(
        spans, F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]).cast("long")
    )


def words_of(text: str) -> list[str]:
    """The words that matching uses, for callers that need to show them."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
