"""Lexical search, line dedup and periodic runs against direct computations."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.compare import difference, duck
from stockloom.llm import lexical, line_runs, periodic, queries
from stockloom.llm.oracle import ORACLES
from tests.llm.conftest import messy_rows, prose

FOLDER = "/root/testdata/sf0.001"


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- lexical search ---------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def ranked(docs, items, k):
    """(item, rank, document, score) by scoring every pair."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for name, text in items:
        scored = []
        for doc, own in counts:
            m = 100 - 90 + (90 * sum(own.values()) * n_docs) // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * own[t] // (1000 * own[t] + 8 * m))
                for t in set(terms_of(text))
                if t in own
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(name, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


ITEMS = [
    ("a", prose(1, 30)),
    ("a", prose(1, 30)),
    ("b", "the river the river THE"),
    ("c", "nowhere-to-be-seen"),
    ("d", None),
    (None, prose(9, 500)),
    ("e", "one two same 123 naïve 好"),
    ("f", ""),
]


@pytest.mark.parametrize("shard, block, first", [(lexical.SHARD, lexical.BLOCK, lexical.FIRST), (300, 40, 2)])
def test_search_equals_scoring_every_pair(spark, messy, monkeypatch, shard, block, first):
    """Also with many shards, blocks and short reads."""
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    items = spark.createDataFrame([(*i, "x", "y") for i in ITEMS], "item_id string, text string, row string, w string")
    found = [str((r.item_id, r.rank, r.doc_id, r.score)) for r in lexical.search(messy, items, k=4).collect()]
    assert sorted(found) == ranked([r[:2] for r in messy_rows()], ITEMS, 4)


def test_search_in_or_for_nothing(spark, messy, nothing):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical.search(nothing, items).collect() == []
    assert lexical.search(messy, items.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_reading_from_the_top_finds_the_best_with_all_ties(data):
    documents = data.draw(st.integers(1, 40))
    lists = []
    for _ in range(data.draw(st.integers(0, 5))):
        docs = data.draw(st.lists(st.integers(0, documents - 1), unique=True, max_size=documents))
        adds = sorted(data.draw(st.lists(st.integers(1, 6), min_size=len(docs), max_size=len(docs))), reverse=True)
        lists.append((np.array(docs, np.int64), np.array(adds, np.int64)))
    k, first = data.draw(st.integers(1, 5)), lexical.FIRST
    lexical.FIRST = data.draw(st.integers(1, 4))
    try:
        found, score = lexical.top_of_lists(lists, documents, k)
    finally:
        lexical.FIRST = first
    total = np.zeros(documents, np.int64)
    for docs, adds in lists:
        np.add.at(total, docs, adds)
    reach = sorted(total[total > 0])[-k:]
    expected = {d: int(s) for d, s in enumerate(total) if reach and s >= reach[0] > 0}
    assert dict(zip(found.tolist(), score.tolist(), strict=True)) == expected


# --- line dedup -------------------------------------------------------------------------------

LINE_ROWS = [
    (1, "Shared Line\nown 1\nshared line \n\n"),
    (2, "\t shared line\nown 2"),
    (3, "SHARED LINE"),
    (4, None),
    (5, ""),
    (6, "École\nécole\n\n"),
    (7, "École"),
    (7, "École"),
    (None, "own 1\nx"),
    (None, "own 1\nx"),
    (8, "\n".join(f"line {i % 50}" for i in range(5000))),
    (9, "line 7\nkept\r\nline 8\x0b"),
    (10, "line 8 \nline 7\nline 7"),
]


def without_frequent_lines(rows, min_docs, min_chars):
    keys = [[folded(x).strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for _, t in rows]
    df = Counter(k for own in keys for k in set(own))
    out = []
    for (doc, text), own in zip(rows, keys, strict=True):
        gone = [len(k) >= min_chars and df[k] >= min_docs for k in own]
        lines = (text or "").split("\n")
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((doc, len(lines), sum(gone), kept))
    return sorted(map(str, out))


def row_texts(frame):
    return sorted(str(tuple(r)) for r in frame.collect())


@pytest.mark.parametrize("min_docs, min_chars, batches", [(3, 1, 4), (2, 1, 1), (2, 6, 7), (1, 1, 2)])
def test_lines_of_many_documents_go(spark, min_docs, min_chars, batches):
    frame = spark.createDataFrame([(*r, "x", 1) for r in LINE_ROWS], "doc_id long, text string, key string, h1 int")
    found = line_runs.drop_frequent_lines(frame.repartition(3), min_docs, min_chars, batches)
    assert row_texts(found) == without_frequent_lines(LINE_ROWS, min_docs, min_chars)


def test_lines_of_messy_rows(messy, nothing):
    rows = [r[:2] for r in messy_rows()]
    assert row_texts(line_runs.drop_frequent_lines(messy, 2)) == without_frequent_lines(rows, 2, 1)
    assert line_runs.drop_frequent_lines(nothing).collect() == []


def test_runs_are_merged_in_levels_and_settled_keys_stay_out(spark):
    runs = line_runs.LineRuns(spark, min_docs=2, fanout=2)
    batch = spark.createDataFrame([(1, "hot\na"), (2, "hot\nb")], "doc_id long, text string")
    for n in range(1, 8):
        runs.add(batch.where(F.lit(n == 1)).unionByName(batch.limit(1)))
        assert [len(level) for level in runs.levels] == [int(b) for b in reversed(f"{n:b}")]
    counts = {r.n_docs for run in runs._runs() for r in spark.table(run).collect()}
    assert runs.frequent().count() == 2  # "hot" and "a"; "hot" is settled by the first batch
    assert 3 in counts and max(counts) < 8


# --- periodic runs ----------------------------------------------------------------------------


def runs_by_definition(words, shortest):
    """(start, length, period) of every maximal run."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            to = at
            while to + q < n and words[to] == words[to + q]:
                to += 1
            length = to - at + q
            own = words[at : at + length]
            smaller = any(own[p:] == own[:-p] for p in range(1, q))
            if length >= max(shortest, 2 * q) and not smaller:
                out.append((at, length, q))
            at = max(to, at) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40), st.integers(2, 12))
def test_runs_equal_their_definition(words, shortest):
    found = [tuple(r) for r in periodic.runs_of(np.array(words, np.int64), shortest).tolist()]
    assert found == runs_by_definition(words, shortest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=60), min_size=1, max_size=5), st.integers(2, 13))
def test_runs_of_a_block_of_texts(texts, shortest):
    words = np.array([w for t in texts for w in t], np.uint64)
    text, found = periodic.block_runs(words, np.cumsum([0, *map(len, texts)]), shortest)
    expected = [(i, *r) for i, t in enumerate(texts) for r in runs_by_definition(t, shortest)]
    assert [(i, *r) for i, r in zip(text.tolist(), found.tolist(), strict=True)] == expected


def test_a_suffix_tree_holds_every_suffix_in_order():
    rng = random.Random(3)
    for n in (1, 2, 7, 60, 300):
        text = [*(rng.randint(1, 3) for _ in range(n)), 0]
        order, common = periodic.SuffixTree(text, 4).tour()
        assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:])
        for a, b, depth in zip(order, order[1:], common[1:], strict=False):
            same = [x == y for x, y in zip(text[a:], text[b:], strict=False)]
            assert depth == (same.index(False) if False in same else len(same))


RUN_ROWS = [
    (1, "a b " * 9 + "c"),
    (2, "x " * 11),
    (3, "x " * 12 + "\ny"),
    (4, None),
    (5, " \n"),
    (6, "p q r s t u v w é " * 4 + "p q"),
    (6, "Ä Ä " * 7),
    (None, "m n o " * 5),
    (20, " ".join(f"w{i % 37}" for i in range(500)) + " x y" * 8),
]


def expected_runs(rows, shortest=12):
    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = runs_by_definition(words, shortest)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        out.append((doc, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(map(str, out))


def test_runs_of_texts(spark, messy, nothing):
    frame = spark.createDataFrame([(*r, "x") for r in RUN_ROWS], "doc_id long, text string, runs string").repartition(2)
    for rows, table in ((RUN_ROWS, frame), ([r[:2] for r in messy_rows() if len(r[1] or "") < 20000], None)):
        table = messy.where("text IS NULL OR length(text) < 20000") if table is None else table
        found = [
            (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(table).collect()
        ]
        assert sorted(map(str, found)) == expected_runs(rows)
    assert periodic.find_runs(nothing).collect() == []


def test_digests_of_runs_in_planted_texts(spark, tmp_path):
    rows = [(i, " ".join(f"w{random.Random(i).randrange(9) + k % 31}" for k in range(20 + i))) for i in range(60)]
    rows += [(100, None), (101, "x " * 30), (102, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            words = words[:a] + [words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(a, n)]
        runs = runs_by_definition(words, 12)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        row = found[doc]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


# --- the given tables -------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_line_dedup"])
def test_query_equals_its_sql(spark, name):
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert difference(found, duck(FOLDER).execute(ORACLES[name]).fetchdf()) == ""
