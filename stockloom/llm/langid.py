"""Language identification with a blended-spectrum string kernel.

A text is the set of 1-, 2- and 3-grams it contains, over letters with everything else as one
boundary sign. The kernel of two texts is the size of their common set over the geometric mean of
their sizes. A few landmark texts give the Nyström feature map; one-versus-rest kernel ridge
regression on it is fitted on a bounded sample, and texts are scored by two matrix products a batch:
presence times landmarks, kernel values times weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm import text as T

LANDMARKS = 160  # texts, shared evenly by the languages
SAMPLE = 2_000  # labelled texts that the regression sees, shared evenly
RIDGE = 1e-2
UNKNOWN = "und"
_ORDERS = (1, 2, 3)
_BITS = 6
_ROWS = 256  # texts scored by one product
_LETTER = re.compile(r"[^\W\d_]")


def _signs() -> np.ndarray:
    """Letters a-z as 1 to 26, bytes of other scripts as 27 to 58, anything else 0."""
    table = np.zeros(256, np.int32)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = 27 + (np.arange(128) & 31)
    return table


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and code of every n-gram position; a code's order is its leading part."""
    signs, row = _signs()[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, codes = [], []
    for order in _ORDERS:
        n = len(signs) - order + 1
        if n <= 0:
            continue
        code = np.full(n, order << (_BITS * max(_ORDERS)), np.int32)
        for i in range(order):
            code |= signs[i : i + n] << (_BITS * i)
        whole = row[:n] == row[order - 1 :]
        rows.append(row[:n][whole])
        codes.append(code[whole])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(codes)


_CODES = (max(_ORDERS) + 1) << (_BITS * max(_ORDERS))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # n-grams of the landmarks, sorted
    landmarks: np.ndarray  # n-grams x landmarks, each column of unit length
    weights: np.ndarray  # landmarks x languages

    def scores(self, data: np.ndarray, offsets: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Regression values per text and language; ``column`` maps a code to its place."""
        row, code = grams(data, offsets)
        presence = np.zeros((len(offsets) - 1, len(self.codes) + 1), np.float32)
        presence[row, column[code]] = 1
        presence = presence[:, :-1]
        norm = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
        return (presence @ self.landmarks / norm) @ self.weights

    def columns(self) -> np.ndarray:
        column = np.full(_CODES, len(self.codes), np.int32)
        column[self.codes] = np.arange(len(self.codes))
        return column


def _sample(docs: DataFrame, per_language: int) -> list:
    """(language, n-gram codes) of a bounded sample, the same on every run, in a fixed order."""
    order = F.xxhash64(F.lit("sample"), "doc_id", F.octet_length("text"))
    ranked = docs.select("doc_id", "lang", order.alias("deal")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("deal", "doc_id"))
    chosen = ranked.withColumn("rank", rank).where(F.col("rank") <= per_language)
    ids = [r.doc_id for r in chosen.select("doc_id").collect()]  # at most SAMPLE by language count
    texts = docs.where(F.col("doc_id").isin(ids)) if ids else docs.limit(0)

    def sets(batches):
        for batch in batches:
            languages, found, names = batch.column(0), [], batch.column(2)
            for rows, data, offsets in T.blocks(batch):
                row, code = grams(data, offsets)
                found += _distinct(row, code, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays(
                [languages, pa.array(found, pa.list_(pa.int32())), names],
                names=["lang", "codes", "deal"],
            )

    rows = (
        texts.select("lang", "text", order.alias("deal"))
        .mapInArrow(sets, "lang string, codes array<int>, deal long")
        .collect()
    )
    return sorted({(r.deal, r.lang, tuple(r.codes)) for r in rows})


def _distinct(row: np.ndarray, code: np.ndarray, n: int) -> list[np.ndarray]:
    key = np.unique(row.astype(np.int64) * _CODES + code)
    cut = np.searchsorted(key, np.arange(n + 1) * _CODES)
    return [key[a:b] % _CODES for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fit(docs: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE) -> Model | None:
    """Learn from ``text`` and non-null ``lang``; texts without letters are left out.

    At most ``sample`` texts are used, evenly by language, drawn by a hash of their ids.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages = sorted(r.lang for r in usable.select("lang").distinct().collect())
    if not languages:
        return None
    rows = _sample(usable, max(1, sample // len(languages)))
    per, taken, marks = max(1, landmarks // len(languages)), dict.fromkeys(languages, 0), []
    for _, lang, codes in rows:
        if taken[lang] < per:
            taken[lang] += 1
            marks.append(codes)
    codes = np.unique(np.concatenate([np.array(m) for m in marks]))
    presence = np.zeros((len(rows), len(codes)), np.float32)
    target = np.full((len(rows), len(languages)), -1.0)
    for i, (_, lang, own) in enumerate(rows):
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        presence[i, at[codes[at] == own]] = 1
        target[i, languages.index(lang)] = 1
    presence /= np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
    columns = np.zeros((len(codes), len(marks)), np.float32)
    for j, own in enumerate(marks):
        columns[np.searchsorted(codes, own), j] = 1 / np.sqrt(len(own))
    kernel = (presence @ columns).astype(float)
    values, vectors = np.linalg.eigh((columns.T @ columns).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    # Every language weighs the same, however many texts it has.
    weight = 1 / (target > 0).sum(axis=0)[(target > 0).argmax(axis=1)][:, None]
    gram = features.T @ (features * weight) + RIDGE * np.eye(features.shape[1]) / len(rows)
    solved = np.linalg.solve(gram, features.T @ (target * weight))
    return Model(languages, codes, columns, (root @ solved).astype(np.float32))


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def _classifier(model: Model | None):
    """A function from a batch with a text column to its languages and scores."""
    column = model.columns() if model else None

    def classify(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        known = [bool(model and t and _LETTER.search(t)) for t in _texts(batch)]
        best, score = np.zeros(len(known), int), np.zeros(len(known))
        for rows, data, offsets in T.blocks(batch) if model else ():
            for a in range(0, len(offsets) - 1, _ROWS):
                own = offsets[a : a + _ROWS + 1]
                values = model.scores(data[own[0] : own[-1]], own - own[0], column)
                at = slice(rows.start + a, rows.start + a + len(own) - 1)
                best[at] = values.argmax(axis=1)
                score[at] = np.clip((values.max(axis=1) + 1) / 2, 0, 1)
        score[~np.array(known, bool)] = 0
        return [model.languages[b] if k else UNKNOWN for k, b in zip(known, best.tolist(), strict=True)], score

    return classify


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without null texts and those without letters, which :func:`predict` calls ``und``; all
    columns stay. If nothing could be learned, texts with letters stay all the same.
    """

    def decide():
        if model is None:
            return lambda batch: np.array([bool(t and _LETTER.search(t)) for t in _texts(batch)], bool)
        classify = _classifier(model)
        return lambda batch: np.array([n != UNKNOWN for n in classify(batch)[0]], bool)

    return T.keep_rows(docs, decide)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` per row: the language with the largest regression value, and
    that value moved from [-1, 1] to [0, 1]. A null text, or one without letters, is ``und`` with
    score 0, and so is every text if nothing could be learned. Other columns are ignored.
    """

    def label(batches):
        classify = _classifier(model)
        for batch in batches:
            named, score = classify(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named, pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        label, "doc_id long, lang_pred string, score double"
    )
