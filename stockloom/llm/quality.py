"""Quality scores by nearest-neighbour voting among labelled texts in a latent-semantic space.

A text is a bag of terms: trigrams of sign classes (letter, capital, digit, bar, ...), word lengths,
and repeated words. Terms are weighted by the square root of their share and by inverse document
frequency over all texts; a singular value decomposition of the labelled sample gives the latent
space. The labelled vectors are broadcast (their number and width are parameters), every text's
cosines to all of them are computed in blocks, and its nearest neighbours vote, weighted by
similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm import text as T

SAMPLE = 2_400  # labelled texts, half of each label
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8  # power of the cosine that weighs a vote
_GRAMS = 16**3
_LENGTHS = 16
TERMS = _GRAMS + _LENGTHS + 2
_ROWS = 64  # texts whose terms are counted at once
_SPACE = r"[\x20\x09-\x0D]"


def _classes() -> np.ndarray:
    table = np.full(256, 15, np.int64)
    table[128:] = table[97:123] = 1
    table[65:91] = 2
    table[48:58] = 3
    table[[9, 11, 12, 13, 32]] = 4
    for value, signs in enumerate(("\n", ".", ",", "!", "?", "|", "*", "#", "$%&@", "\"'()[]{}<>"), 5):
        table[list(signs.encode())] = value
    return table


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x terms."""
    n = len(offsets) - 1
    classes = _classes()[data]
    counts = np.zeros((n, TERMS), np.int64)
    if len(data) > 2:
        row = np.repeat(np.arange(n), np.diff(offsets))
        whole = row[2:] == row[:-2]
        code = row[2:] * _GRAMS + classes[:-2] * 256 + classes[1:-1] * 16 + classes[2:]
        counts[:, :_GRAMS] = np.bincount(code[whole], minlength=n * _GRAMS).reshape(n, _GRAMS)
    hashes, starts, ends, per_text = T.words(data, offsets, T.byte_table(_SPACE))
    if len(hashes):
        row = np.repeat(np.arange(n), np.diff(per_text))
        length = np.minimum(ends - starts, _LENGTHS) - 1
        counts[:, _GRAMS:-2] = np.bincount(row * _LENGTHS + length, minlength=n * _LENGTHS).reshape(n, -1)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        counts[:, -2:] = np.bincount(row * 2 + again, minlength=n * 2).reshape(n, 2)
    return counts


def _counted(batch: pa.RecordBatch):
    """(rows, counts) of small runs of a batch's texts."""
    for rows, data, offsets in T.blocks(batch):
        for a in range(0, len(offsets) - 1, _ROWS):
            own = offsets[a : a + _ROWS + 1]
            at = slice(rows.start + a, rows.start + a + len(own) - 1)
            yield at, term_counts(data[own[0] : own[-1]], own - own[0])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, per term, of texts that have it, over all rows."""

    def count(batches):
        total, texts = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, counts in _counted(batch):
                total += (counts > 0).sum(axis=0)
                texts += len(counts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"term": np.append(used, -1), "n": np.append(total[used], texts)}
        )

    sums = (
        docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    )
    frequencies, texts = np.zeros(TERMS, np.int64), 0
    for term, n in sums:
        if term < 0:
            texts = n
        else:
            frequencies[term] = n
    return texts, frequencies


@dataclass(frozen=True)
class Voters:
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled texts x dimensions, unit length
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit((weigh(counts, self.idf) @ self.axes).astype(np.float32))

    def scores(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the ``k`` nearest; ties at rank k all vote."""
        cosine = self.project(counts) @ self.vectors.T
        k = min(k, cosine.shape[1])
        bar = np.partition(cosine, -k, axis=1)[:, -k][:, None]
        votes = np.where(cosine >= bar, np.maximum(cosine, 1e-6), 0).astype(float) ** SHARPNESS
        return np.clip((votes @ self.labels) / votes.sum(axis=1), 0, 1)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return _unit((np.sqrt(share) * idf).astype(np.float32))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS
) -> Voters | None:
    """Learn from ``labels`` (``doc_id, label`` 0 or 1) of texts in ``docs``.

    At most ``sample`` labelled documents take part, drawn by a hash of their ids, half of each
    label where there are enough; null labels and ids are left out. The inverse document
    frequencies come from all texts. None if no labelled text is left.
    """
    order = F.xxhash64(F.lit("sample"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("deal", "doc_id"))
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", "label").distinct()
    drawn = known.withColumn("deal", order).withColumn("rank", rank).where(F.col("rank") <= sample // 2)
    chosen = {(r.doc_id, r.label) for r in drawn.collect()}  # at most ``sample`` rows
    ids = sorted({i for i, _ in chosen})
    if not ids:
        return None

    def features(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for rows, counts in _counted(batch):
                used = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(names[rows], pa.int64()),
                        "terms": pa.array(used, pa.list_(pa.int32())),
                        "counts": pa.array([c[u] for c, u in zip(counts, used, strict=True)], pa.list_(pa.int32())),
                    }
                )

    rows = (
        docs.where(F.col("doc_id").isin(ids))
        .select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(features, "doc_id long, terms array<int>, counts array<int>")
        .collect()
    )
    unique = sorted({(r.doc_id, tuple(r.terms), tuple(r.counts)) for r in rows})
    examples = [(t, c, label) for i, t, c in unique for label in (0, 1) if (i, label) in chosen]
    if not examples:
        return None
    texts, frequencies = document_frequencies(docs)
    idf = np.log((1 + texts) / (1 + frequencies))
    counts = np.zeros((len(examples), TERMS), np.int32)
    for i, (terms, values, _) in enumerate(examples):
        counts[i, list(terms)] = values
    weighted = weigh(counts, idf)
    values, vectors = np.linalg.eigh((weighted @ weighted.T).astype(float))
    keep = np.argsort(-values)[:dimensions]
    keep = keep[values[keep] > 1e-9]
    axes = (weighted.T @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32)
    return Voters(idf, axes, _unit(weighted @ axes), np.array([label for *_, label in examples], float))


def score(docs: DataFrame, voters: Voters | None, bar: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` per row: the voters' weighted label, and 1 from ``bar`` up.

    Null and empty texts are equally far from all voters and get the sample's share of label 1;
    without any voter all scores are 0.5. Other columns are ignored.
    """

    def vote(batches):
        for batch in batches:
            found = np.full(batch.num_rows, 0.5)
            if voters is not None:
                for rows, counts in _counted(batch):
                    found[rows] = voters.scores(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= bar).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        vote, "doc_id long, score double, predicted int"
    )
