"""Ranked lexical search by NRA: impact-sorted posting lists read from the top, no random access.

The index holds the postings of the terms that are asked for, dealt into shards of documents of
bounded size. Within a shard every item's lists are sorted by impact and read in step, ever longer
blocks at a time. What was read of a document gives the lower bound of its score; what its unread lists
can still give, at most their next entry each, the upper one. Reading goes on until no other document
can reach the k-th lower bound, not even in a tie, and the intervals of all that can are closed. Then
the shard's best are exact, and the best over all shards are the best of the shards' best.

Items are queries against all documents. They are dealt into blocks and each block meets each shard
once, so that a task holds one shard's postings of one block's terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm import text as T
from stockloom.llm.storage import Scratch

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"  # of the lower-cased text
SHARD = 1_000_000  # postings in a shard, about
BLOCK = 50_000  # terms of the items in a block, about
FIRST = 64  # entries of every list in the first read; each read goes four times as deep

_POSTINGS = "term long, row long, id long, tf long, n long"
_FOUND = "item long, item_id string, doc_id long, row long, score long"


def _term_counts(batch: pa.RecordBatch):
    """Runs of rows: (rows, row of each distinct term, its hash, its count, words per row)."""
    table = T.byte_table(SEPARATORS)
    for rows, data, offsets in T.blocks(batch):
        hashes, _, _, per_text = T.words(data, offsets, table)
        words = np.diff(per_text)
        owner = np.repeat(np.arange(len(words)), words)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        place = np.flatnonzero(first)
        yield rows, owner[place], hashes[place], np.diff(np.append(place, len(hashes))), words


def _post(batches):
    """A posting for each distinct term of a text, and for each run of texts one row without term:
    in ``tf`` the texts with terms, in ``n`` their terms."""
    base = T.row_base()
    for batch in batches:
        ids = batch.column(0)
        for rows, owner, hashes, counts, words in _term_counts(batch):
            n = len(owner)
            own = ids.slice(rows.start, rows.stop - rows.start).take(pa.array(owner))
            yield T.records(
                _schema(_POSTINGS),
                [T.signed(hashes), base + owner, own, counts, words[owner]],
            ) if n else T.records(_schema(_POSTINGS), [[], [], [], [], []])
            yield T.records(
                _schema(_POSTINGS),
                [[None], [None], [None], [int((words > 0).sum())], [int(words.sum())]],
            )
            base += rows.stop - rows.start


def _ask(batches):
    base = T.row_base()
    for batch in batches:
        for rows, owner, hashes, _, _ in _term_counts(batch):
            own = batch.column(0).slice(rows.start, rows.stop - rows.start).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(base + owner, pa.int64()), own, pa.array(T.signed(hashes))], names=["item", "item_id", "term"]
            )
            base += rows.stop - rows.start


def _schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))])


def impact(tf: Column, n: Column, documents: int, terms: int) -> Column:
    """What a posting gives per unit of its term's weight, as a whole number below a million."""
    length = 100 - 90 + F.expr(f"(90L * n * {documents}L) div {max(terms, 1)}L")
    return F.call_function("div", tf * F.lit(1_000_000_000), tf * F.lit(1000) + length * F.lit(8))


def top_of_lists(
    lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """(document, exact score) of every document that belongs to the ``k`` best or ties with the last.

    A list holds documents (0..documents-1, each once) and what it adds to their scores, a positive
    whole number, in descending order.
    """
    lower = np.zeros(documents, np.int64)
    open_to_all, alive = True, np.ones(documents, bool)
    depth, longest = 0, max((len(d) for d, _ in lists), default=0)
    while depth < longest:
        to = max(FIRST, depth * 4)
        for docs, adds in lists:
            docs, adds = docs[depth:to], adds[depth:to]
            if not open_to_all:
                docs, adds = docs[alive[docs]], adds[alive[docs]]
            lower[docs] += adds  # a list holds a document once
        depth = to
        left = [int(adds[depth]) if depth < len(adds) else 0 for _, adds in lists]
        most = sum(left)
        if not most:
            break
        if documents < k:
            continue
        least = int(np.partition(lower, documents - k)[documents - k])
        if open_to_all and most >= least:
            continue  # a document not met yet could still get in
        open_to_all = False
        # What is still open of a document: the next entries of the lists that haven't shown it.
        rest = np.full(documents, most)
        for (docs, _), bound in zip(lists, left, strict=True):
            if bound:
                rest[docs[:depth]] -= bound
        alive = lower + rest >= least
        if not rest[alive].any():
            break
    found = np.flatnonzero((lower > 0) & alive)
    if len(found) > k:
        least = np.partition(lower[found], len(found) - k)[len(found) - k]
        found = found[lower[found] >= least]
    return found, lower[found]


def _search(k: int):
    """The best documents of one shard for the items of one block."""

    def search(postings: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _schema(_FOUND).empty_table()
        term = postings["term"].to_numpy()
        row, gives = postings["row"].to_numpy(), postings["impact"].to_numpy()
        order = np.lexsort((-gives, term))
        term, gives, row = term[order], gives[order], row[order]
        rows, first, doc = np.unique(row, return_index=True, return_inverse=True)
        ids = postings["id"].combine_chunks().take(pa.array(order[first]))
        known, begins = np.unique(term, return_index=True)
        ends = np.append(begins[1:], len(term))

        item = asked["item"].to_numpy()
        order = np.argsort(item, kind="stable")
        item, weight = item[order], asked["w"].to_numpy()[order]
        wanted, names = asked["term"].to_numpy()[order], asked["item_id"].combine_chunks().take(pa.array(order))
        place = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        there = known[place] == wanted if len(known) else np.zeros(len(wanted), bool)
        out = [[], [], [], []]
        starts = np.flatnonzero(np.diff(item, prepend=item[0] - 1))
        for a, b in zip(starts, np.append(starts[1:], len(item)), strict=True):
            spans = [
                (slice(begins[place[i]], ends[place[i]]), weight[i]) for i in range(a, b) if there[i]
            ]
            found, score = top_of_lists([(doc[s], gives[s] * w) for s, w in spans], len(rows), k)
            out[0].append(np.full(len(found), a))
            out[1].append(found)
            out[2].append(score)
        at, found, score = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out[:3])
        keep = _first_of_ties(at, found, score, ids, k)
        at, found, score = at[keep], found[keep], score[keep]
        return pa.table(
            [pa.array(item[at]), names.take(pa.array(at)), ids.take(pa.array(found)), pa.array(rows[found]), pa.array(score)],
            schema=_schema(_FOUND),
        )

    return search


def _first_of_ties(at, found, score, ids: pa.Array, k: int) -> np.ndarray:
    """The first ``k`` of each item, by score and then by document id, a null one last."""
    unnamed = ids.is_null().to_numpy(zero_copy_only=False)[found]
    name = ids.fill_null(0).to_numpy(zero_copy_only=False)[found]
    order = np.lexsort((found, name, unnamed, -score, at))
    begins = np.flatnonzero(np.diff(at[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each row of ``items``.

    Terms are runs of ASCII letters, digits and other non-ASCII characters, A-Z lower-cased, of the
    whole texts. With N documents that have terms, L terms in them, n in this one, df documents with
    a term and tf occurrences, a term weighs ``w = floor(1000 ln((2N + 2) / (2df + 1)))`` and gives
    ``w * ((10^9 tf) div (1000 tf + 8 (10 + (90 n N) div L)))``, once for each distinct term of the
    item; scores are whole numbers below 2^63. Documents without a score are left out. Ties go by
    ascending ``doc_id``, a null one last, and rows with one id are documents of their own.

    Null and empty texts hold no term: as documents they count for nothing, as items they find
    nothing. Repeated items are ranked each for themselves. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lexical")
    asked = scratch.store(
        items.select(F.col("item_id").cast("string"), "text").mapInArrow(_ask, "item long, item_id string, term long")
    )
    wanted = scratch.store(asked.select("term", F.lit(True).alias("wanted")).distinct())
    index = scratch.store(
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_post, _POSTINGS)
        .join(wanted, "term", "left")
        .where("wanted OR term IS NULL")
        .drop("wanted")
    )
    documents, terms = index.where("term IS NULL").agg(F.sum("tf"), F.sum("n")).first()
    documents, terms = documents or 0, terms or 0
    ratio = F.lit(2 * documents + 2).cast("double") / (2 * F.count("*") + 1)
    weights = index.where("term IS NOT NULL").groupBy("term").agg(
        F.floor(F.log(ratio) * 1000).cast("long").alias("w"), F.count("*").alias("df")
    )
    weighed = scratch.store(asked.join(weights, "term").where("w > 0"))
    size = weighed.agg(F.count("*").alias("terms")).first().terms
    postings = index.where("term IS NOT NULL").count()
    shards, parts = -(-max(postings, 1) // SHARD), -(-max(size, 1) // BLOCK)

    blocked = weighed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(parts)))
    needed = scratch.store(blocked.select("term", "block").distinct())
    lists = (
        index.where("term IS NOT NULL")
        .select("term", "row", "id", impact(F.col("tf"), F.col("n"), documents, terms).alias("impact"))
        .join(needed, "term")
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    )
    queries = blocked.select(
        "item", "item_id", "term", "w", "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    best = (
        lists.groupBy("shard", "block")
        .cogroup(queries.groupBy(F.col("shard").cast("long"), "block"))
        .applyInArrow(_search(k), _FOUND)
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
