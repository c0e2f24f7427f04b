"""Removal of sentences that repeat elsewhere in runs.

From every sentence starts a run of ``span`` consecutive sentences, and a shorter one where fewer
hold ``words`` words; a text of fewer than ``span`` sentences is one run. Every sentence thus lies in
a run, and the later of two equal texts loses all of them. Runs are hashed and joined over all
texts; sentences inside any run that is not the first of its kind (smallest document, then place)
are removed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.storage import Scratch

SPAN = 3
WORDS = 25
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+\s*|$)")
_MASK = (1 << 64) - 1


def split(text: str | None) -> list[str]:
    """Sentences with their end marks and the white space behind; joined, they are the text."""
    return [s for s in _SENTENCE.findall(text or "") if s]


def runs(sentences: list[str], span: int, words: int) -> list[tuple[int, int, int]]:
    """(hash, first, end) of the runs from each sentence that has words; case and spaces don't count.

    Sentences without words are passed over. A run by words is given where it is shorter than the
    run of ``span`` sentences, be it a single sentence.
    """
    keys = [s.lower().split() for s in sentences]
    use = [i for i, k in enumerate(keys) if any(c.isalnum() for w in k for c in w)]
    hashes = [xxhash.xxh3_64_intdigest(" ".join(keys[i])) for i in use]
    sizes = [len(keys[i]) for i in use]
    found = []
    for at in range(len(use)):
        mixed = total = n = 0
        for h, size in zip(hashes[at : at + span], sizes[at : at + span], strict=True):
            mixed = (mixed * 0x9E3779B97F4A7C15 + h + 1) & _MASK
            mixed ^= mixed >> 29
            n += 1
            by_words = total < words <= total + size
            total += size
            if by_words or n == span or n == len(use):
                found.append((mixed - (1 << 63), use[at], use[at + n - 1] + 1))
    return found


def _runs(span: int, words: int):
    schema = pa.schema([("run", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def scan(batches):
        for batch in batches:
            names, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, out = batch.column(2), []
            for i, text in enumerate(texts):
                out += [(h, names[i], keys[i], a, b) for h, a, b in runs(split(text.as_py()), span, words)]
                if len(out) > 50_000 or i + 1 == len(texts):
                    columns = list(zip(*out, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                    )
                    out = []

    return scan


def _cut(batches):
    for batch in batches:
        out = []
        for name, text, spans in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            sentences = split(text)
            covered = np.zeros(len(sentences), bool)
            for s in spans or ():
                covered[s["first"] : s["end"]] = True
            kept = "".join(s for s, gone in zip(sentences, covered, strict=True) if not gone)
            out.append((name, len(sentences), int(covered.sum()), None if text is None else kept))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["doc_id", "n_sentences", "n_removed", "text"],
        )


def remove_repeated_sentences(docs: DataFrame, span: int = SPAN, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_sentences, n_removed, text`` without the repeats.

    A run in several documents stays in the first: smallest ``doc_id`` (null last), then place. Rows
    with the same id and text are one document stated twice and keep the same sentences; the same
    id with other texts goes by the texts' hashes. A null text stays null and an empty one empty,
    without sentences. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sentences")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("text_key"), "text"
    )
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "first")
    found = scratch.store(
        rows.mapInArrow(_runs(span, words), "run long, doc_id long, text_key long, first int, end int")
    )
    # Stored, so that the join below reads plain shuffles, of which Spark can split a hot run's.
    again = scratch.store(
        found.groupBy("run").agg(F.min(place).alias("keep"), F.count("*").alias("n")).where("n > 1")
    )
    later = found.join(again, "run").where(place != F.col("keep"))
    spans = later.groupBy("text_key").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    return (
        rows.join(spans, "text_key", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut, "doc_id long, n_sentences int, n_removed int, text string")
    )
