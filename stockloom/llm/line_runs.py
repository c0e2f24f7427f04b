"""Removal of lines that many documents share, counted in levelled sorted runs of line hashes.

Documents come in batches. A batch's line keys are counted per document, merge-anti-joined against the
keys that the runs already know to be frequent, and what is left becomes a run of its own: a table of
128-bit key hashes with document counts, hash-bucketed and sorted by the hash. Once a level holds
``fanout`` runs, they are merged into one run of the next level, so that a key is rewritten about as
often as there are levels, and the levels grow with the logarithm of the batches. Runs of the same
buckets join and merge bucket by bucket, without a shuffle of what was stored before.

Only built-in functions of Spark are used.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm.storage import Scratch

KEY = ("h1", "h2")
_BLANK = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order: A-Z lower-cased, blanks at both ends stripped."""
    # Only ASCII letters fold; ``lower`` is faster but folds others too.
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.transform(F.split(folded, "\n"), lambda line: F.btrim(line, F.lit(_BLANK)))


def _hashed(*values: str) -> list[Column]:
    """Two independent 64-bit hashes of the values."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


class LineRuns:
    """Document counts of line keys, in levels of sorted runs below the shared folder.

    A key is settled in a run that counts it in ``min_docs`` documents or more; later batches don't
    carry it any further. ``levels[i]`` names the runs of level i, oldest first.
    """

    def __init__(
        self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 2
    ):
        self._spark, self._scratch = spark, Scratch(spark, "line-runs")
        self.min_docs, self.min_chars, self.fanout = min_docs, min_chars, fanout
        self._buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def add(self, docs: DataFrame) -> None:
        """Count a batch of documents (each row is one); a row must come in one batch only."""
        keys = F.array_distinct(line_keys(_text()))
        counts = (
            docs.select(F.explode(keys).alias("key"))
            .where(F.char_length("key") >= self.min_chars)
            .select(*[h.alias(n) for n, h in zip(KEY, _hashed("key"), strict=True)])
            .groupBy(*KEY)
            .agg(F.count("*").alias("n_docs"))
        )
        for run in self._runs():
            counts = counts.join(self._settled(run), list(KEY), "left_anti")
        self._place(0, self._write(counts))

    def frequent(self) -> DataFrame:
        """The keys found in ``min_docs`` documents or more of all batches."""
        return self._merged(self._runs()).where(F.col("n_docs") >= self.min_docs).select(*KEY)

    def clean(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n_lines, n_dropped, kept`` per row of ``docs``: its lines without frequent ones.

        ``kept`` joins the remaining lines by newlines, empty if there are none. A null or empty text
        is one empty line. Equal rows give equal results, one for each; other columns are ignored.
        """
        frequent = self._scratch.store(self.frequent())
        rows = docs.select(F.col("doc_id").cast("long"), _text().alias("text"))
        keyed = rows.select("*", *[h.alias(n) for n, h in zip("ab", _hashed("doc_id", "text"), strict=True)])
        found = (
            keyed.select("a", "b", F.posexplode(line_keys(F.col("text"))).alias("at", "key"))
            .where(F.char_length("key") >= self.min_chars)
            .select("a", "b", "at", *[h.alias(n) for n, h in zip(KEY, _hashed("key"), strict=True)])
            .join(frequent, list(KEY))
            .groupBy("a", "b")
            .agg(F.collect_set("at").alias("dropped"))
        )
        # Stored, so that the join below reads two plain shuffles, of which Spark can split hot rows.
        found = self._scratch.store(found)
        lines = keyed.select("doc_id", "a", "b", F.split("text", "\n").alias("lines"))
        joined = lines.join(found, ["a", "b"], "left")
        left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
        kept = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(
            F.array_join(F.transform(left, lambda at: F.get("lines", at)), "\n")
        )
        return joined.select(
            "doc_id",
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
            kept.alias("kept"),
        )

    def _runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _settled(self, run: str) -> DataFrame:
        return self._spark.table(run).where(F.col("n_docs") >= self.min_docs).select(*KEY)

    def _merged(self, runs: list[str]) -> DataFrame:
        union = None
        for run in runs:
            rows = self._spark.table(run)
            union = rows if union is None else union.unionByName(rows)
        if union is None:
            union = self._spark.createDataFrame([], "h1 long, h2 long, n_docs long")
        return union.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"))

    def _write(self, counts: DataFrame) -> str:
        """A run: one sorted file per bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        (
            counts.repartition(self._buckets, *KEY)
            .sortWithinPartitions(*KEY)
            .write.bucketBy(self._buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{self._scratch.path}/{name}")
            .saveAsTable(name)
        )
        return name

    def _place(self, level: int, run: str) -> None:
        """Add a run to a level; a full level is merged into one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        old, self.levels[level] = self.levels[level], []
        self._place(level + 1, self._write(self._merged(old)))
        for name in old:
            self._spark.sql(f"DROP TABLE {name}")
            self._scratch.delete(f"{self._scratch.path}/{name}")


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4
) -> DataFrame:
    """:meth:`LineRuns.clean` of ``docs`` by counts over all of them, taken in ``batches``.

    Every row belongs to exactly one batch, by the hash of its id.
    """
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    for batch in range(batches):
        runs.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch))
    return runs.clean(docs)
