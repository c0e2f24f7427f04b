"""Secrets in texts: fixed patterns, and a battery of randomness tests on long tokens.

Base spans come from three patterns. The battery looks at every other token of 20 or more signs that
could be an encoded key: its encoding (hexadecimal, base 32, base 64, letters with digits) gives the
alphabet, and three tests ask whether its signs look drawn from it evenly and independently:
chi-squared uniformity, runs above and below the middle, and lag-one serial correlation. The
smallest of the three p-values, times three, is the token's p-value; ordinary strings get tiny ones.

The bar is set per band of lengths, since short tokens can look random by chance: the lowest p-value
is chosen at which ordinary strings make up at most ``RATE`` of the tokens that pass. Tokens hold a
digit, so how many of them are ordinary is seen where random ones hardly come, just below the least
bar. How many of those there pass a bar is seen from decoys, runs of letters without digits of the
same lengths, which take the same tests but are never reported. Counts cover all texts.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.storage import Scratch

KINDS = ("assign", "access", "hex", "random")
RATE = 0.05  # share of ordinary strings among the tokens that pass
LEAST_P = 0.01  # no token below this p-value passes in any band
SIDE_P = 1e-4  # from here to LEAST_P the ordinary strings are counted
LEAST_LENGTH = 20
GRID = [10 ** (-i / 4) for i in range(8, -1, -1)]  # p-values that may become a bar: 0.01 to 1

SCHEMA = (
    "doc_id long, base array<struct<kind:string,start:int,end:int>>, "
    "tokens array<struct<start:int,end:int,p:double>>, decoys array<struct<length:int,p:double>>"
)


def _either_case(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")  # maximal runs: a shorter one never matches in part
_HINT = re.compile("passw|secret|token|api", re.IGNORECASE)
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}")
_DIGIT = re.compile("[0-9]")

#: The signs of each encoding in their usual order, narrowest first.
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kinds numbered as in ``KINDS``."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(values: np.ndarray, size: int) -> float:
    """The battery's p-value for symbols 0..size-1 being even and independent."""
    n = len(values)
    df, counts = size - 1, np.bincount(values, minlength=size)
    chi = float((counts.astype(float) ** 2).sum()) * size / n - n
    spread = 2 / (9 * df)  # the cube root of chi-squared over df is nearly normal
    uniform = _two_sided(((chi / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))

    high = values * 2 >= size
    above, runs = int(high.sum()), 1 + int((high[1:] != high[:-1]).sum())
    pairs = 2 * above * (n - above)
    if not pairs:
        return 0.0
    mean = pairs / n + 1
    variance = pairs * (pairs - n) / (n * n * (n - 1))
    alternating = _two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0

    centred = values - values.mean()
    power = float((centred**2).sum())
    serial = _two_sided(float((centred[1:] * centred[:-1]).sum()) / power * math.sqrt(n))
    return min(1.0, 3 * min(uniform, alternating, serial))


def _values(token: str, alphabet: str) -> np.ndarray:
    place = {c: i for i, c in enumerate(alphabet)}
    return np.array([place[c] for c in token], np.int64)


def token_p(token: str) -> float | None:
    """The p-value in the narrowest encoding that has all signs of the token; None without one."""
    signs = set(token)
    for alphabet in ALPHABETS:
        if signs <= set(alphabet):
            return randomness(_values(token, alphabet), len(alphabet))
    return None


def band(length):
    """Lengths 20-23, 24-31, 32-47, 48-71 ... : each bar serves lengths within a factor."""
    return int(math.log(length / LEAST_LENGTH, 1.4))


def _examine(text: str) -> tuple[list, list, list]:
    base = base_spans(text)
    tokens, decoys = [], []
    for m in _TOKEN.finditer(text):
        token = m[0].strip("-_+/")
        if len(token) < LEAST_LENGTH or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if not _DIGIT.search(token):
            if token.isalpha():
                decoys.append({"length": len(token), "p": randomness(_values(token.lower(), LETTERS), 26)})
        elif (p := token_p(token)) is not None:
            start = m.start() + m[0].index(token)
            tokens.append({"start": start, "end": start + len(token), "p": p})
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base], tokens, decoys


def _scan(batches):
    types = SCHEMA_TYPES
    for batch in batches:
        found = [_examine(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([f[i] for f in found], types[i]) for i in range(3))],
            names=["doc_id", "base", "tokens", "decoys"],
        )


SCHEMA_TYPES = (
    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])),
    pa.list_(pa.struct([("length", pa.int32()), ("p", pa.float64())])),
)


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, tested tokens and decoys of every text; null counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, SCHEMA)


def bar(tokens: np.ndarray, decoys: np.ndarray, rate: float = RATE) -> float | None:
    """The lowest step of ``GRID`` at which at most ``rate`` of the passing tokens are ordinary.

    Both arrays count p-values from ``SIDE_P`` to ``LEAST_P``, then from each grid step to the next.
    A share ``LEAST_P`` of random tokens may fall short of the grid. What tokens have beyond that, over
    what decoys have there, is the number of ordinary tokens for each decoy.
    """
    passing, false = (cells[:0:-1].cumsum()[::-1] for cells in (tokens, decoys))
    ordinary = max(0.0, tokens[0] - LEAST_P * passing[0])
    weight = ordinary / max(1.0, decoys[0] - LEAST_P * false[0])
    good = (g for g, t, d in zip(GRID, passing.tolist(), false.tolist(), strict=True) if t and weight * d <= rate * t)
    return next(good, None)


def bars(scanned: DataFrame, rate: float = RATE) -> dict[int, float]:
    """The :func:`bar` of every length band that has one.

    Counts per band and grid step reach the driver: a few numbers for each factor 1.4 of length.
    """
    step = F.aggregate(
        F.array(*[F.lit(g) for g in (SIDE_P, *GRID)]), F.lit(-1), lambda n, g: n + (F.col("p") >= g).cast("int")
    )
    length_band = F.floor(F.log(F.col("length") / LEAST_LENGTH) / math.log(1.4)).cast("int")
    tokens = scanned.select(F.inline("tokens")).selectExpr("end - start AS length", "p", "1 AS hit")
    decoys = scanned.select(F.inline("decoys")).selectExpr("length", "p", "0 AS hit")
    counted = (
        tokens.unionByName(decoys)
        .groupBy(length_band.alias("band"), step.alias("step"))
        .agg(F.sum("hit").alias("tokens"), F.sum(1 - F.col("hit")).alias("decoys"))
        .collect()
    )
    levels = {}
    for row in counted:
        cells = levels.setdefault(row.band, np.zeros((2, 1 + len(GRID)), np.int64))
        if row.step >= 0:
            cells[:, row.step] += (row.tokens, row.decoys)
    chosen = {at: bar(*cells, rate) for at, cells in levels.items()}
    return {at: lowest for at, lowest in chosen.items() if lowest is not None}


def _spans(row_base, row_tokens, limits: dict[int, float]) -> list[tuple[int, int, int]]:
    found = [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in row_base]
    for t in row_tokens:
        if t["p"] >= max(LEAST_P, limits.get(band(t["end"] - t["start"]), 2.0)):
            found.append((t["start"], 3, t["end"]))
    return sorted(found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _report(limits: dict[int, float]):
    def report(batches):
        for batch in batches:
            rows = [
                _spans(b, t, limits)
                for b, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            base = [[s for s in spans if s[1] < 3] for spans in rows]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in rows], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(list(map(_joined, rows)), pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return report


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts ``n_assign, n_access, n_hex, n_random``,
    ``base_sha256`` of the base spans and all ``spans`` as ``kind:start:end`` joined by commas, by
    start, then kind as in ``KINDS``; positions are code points, ends exclusive.

    Null and empty texts have no spans, an empty table no rows; other columns are ignored.
    """
    scanned = Scratch(docs.sparkSession, "secrets").store(scan(docs))
    return scanned.drop("decoys").mapInArrow(
        _report(bars(scanned, rate)),
        "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string",
    )


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``; all columns and rows stay.

    Overlapping spans become one mark, named after the first. ``n_chars``, where present, is
    brought up to date. A null text stays null.
    """
    counted = Scratch(docs.sparkSession, "secrets").store(scan(docs).drop("base"))
    limits = bars(counted, rate)
    at = docs.columns.index("text")

    def replaced(text: str | None) -> str | None:
        if not text:
            return text
        base, tokens, _ = _examine(text)
        out, done = [], 0
        for start, kind, end in _spans(base, tokens, limits):
            if start >= done:
                out += [text[done:start], f"[{KINDS[kind]}]"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def rewrite(batches):
        for batch in batches:
            texts = pa.array([replaced(t) for t in batch.column(at).to_pylist()], pa.string())
            columns = [texts if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    clean = docs.mapInArrow(rewrite, docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean
