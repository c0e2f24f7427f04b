"""Jaccard join, repeated substrings and repeated sentences against direct computations."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockloom.llm import jaccard, repeats, sentences
from stockloom.llm import text as T
from stockloom.llm.components import components
from stockloom.llm.storage import Scratch
from tests.llm.conftest import edited, messy_rows, prose


def grams(text, n):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def direct_components(rows, n, num, den):
    """(id, n_shingles, component, links) per row; the component is the smallest id that links reach."""
    sets, group = [grams(r[1], n) for r in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                group[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return [
        (row[0], len(s), least.get(find(i), row[0]) if s else row[0], links[i])
        for i, (row, s) in enumerate(zip(rows, sets, strict=True))
    ]


def key(row):
    return [(v is None, v or 0) for v in row]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard_join_equals_all_pairs(messy, n, num, den):
    found = jaccard.near_duplicates(messy, n, (num, den), count_links=True).collect()
    expected = direct_components(messy_rows(), n, num, den)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_links_are_counted_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = [(i, edited(prose(70, 120), i, 1 + i % 9), None) for i in range(30)]
    rows += [(100 + i, rows[i % 3][1], None) for i in range(7)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = jaccard.near_duplicates(docs, 4, (85, 100), count_links=True).collect()
    expected = direct_components(rows, 4, 85, 100)
    assert sorted(map(tuple, found)) == sorted(expected)
    assert len({n for *_, n in expected}) > 3


def test_jaccard_join_of_nothing(nothing):
    assert jaccard.near_duplicates(nothing).collect() == []


def test_keep_one_leaves_one_row_of_each_group(messy):
    kept = jaccard.keep_one(messy.withColumn("row_key", F.concat(F.lit("mine "), F.col("doc_id"))), 5, (80, 100))
    assert kept.dtypes == messy.dtypes
    assert all(r.row_key == (None if r.doc_id is None else f"mine {r.doc_id}") for r in kept.collect())
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    expected = direct_components(messy_rows(), 5, 80, 100)
    groups = {(i, c) for i, size, c, _ in expected if size and i == c}
    assert sorted(i for i, t in rows if grams(t, 5) and i is not None) == sorted(
        [c for _, c in groups] + [6]  # the second text of id 6 is a document of its own
    )
    assert len([t for _, t in rows if not grams(t, 5)]) == 4


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_linked_sets_always_meet(data):
    """Any two linked sets share a signature with which one of them asks."""
    num = data.draw(st.sampled_from([50, 80, 85, 95]))
    size = data.draw(st.integers(1, 60))
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    threshold = jaccard.Threshold(num, 100)
    drop = int(rng.integers(0, max(1, threshold.difference(2 * len(a)) + 1)))
    extra = rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)
    b = np.unique(np.concatenate([rng.permutation(a)[min(drop, len(a) - 1) :], extra]))
    common = len(np.intersect1d(a, b))
    if 100 * common < num * (len(a) + len(b) - common) or np.array_equal(a, b):
        return
    signature, who, asks = jaccard.signatures([a, b], threshold)
    first, second = ({s: q for s, w, q in zip(signature.tolist(), who, asks, strict=True) if w == i} for i in (0, 1))
    first_asks = {s for s, w, q in zip(signature.tolist(), who, asks, strict=True) if w == 0 and q}
    second_asks = {s for s, w, q in zip(signature.tolist(), who, asks, strict=True) if w == 1 and q}
    assert first_asks & set(second) or second_asks & set(first)


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 500, 200, dtype=np.uint64))
        b = np.unique(rng.integers(0, 500, 180, dtype=np.uint64))
        bits = np.bitwise_count(jaccard.sketch(T.mix(a)) ^ jaccard.sketch(T.mix(b))).sum()
        assert bits <= len(np.setxor1d(a, b))
        long = np.unique(rng.integers(0, 2**62, int(rng.integers(200, 3000)), dtype=np.uint64))
        short = long[: int(rng.integers(100, len(long) + 1))]
        wide = jaccard.sketch_distance(jaccard.wide_sketch(long), jaccard.wide_sketch(short))
        assert wide <= len(long) - len(short)


def test_families_of_related_long_texts(spark):
    """Many texts of one family, most pairs of which just miss the similarity, in every length."""
    rows = []
    for family, size in enumerate((30, 200, 900, 3000)):
        base = prose(500 + family, size)
        rows += [(100 * family + i, edited(base, i, max(1, size * (i % 7) // 90))) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, num in ((4, 85), (5, 80)):
        found = jaccard.near_duplicates(docs, n, (num, 100), count_links=True).collect()
        assert sorted(map(tuple, found)) == sorted(direct_components(rows, n, num, 100))


def test_folded_sketches_in_buckets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**62, int(n), dtype=np.uint64)) for n in rng.integers(1, 20_000, 40)]
    wide = [jaccard.wide_sketch(own) for own in sets]
    left, right = np.divmod(np.arange(1600), 40)
    found = jaccard._Sketches(pa.array(wide, pa.binary())).distances(left, right)
    assert found.tolist() == [jaccard.sketch_distance(wide[i], wide[j]) for i, j in zip(left, right, strict=True)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(300, 380)]
    edges = chain + star + [(400, 401), (401, 400), (500, 500)]
    rng.shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    labels = {r.node: r.component for r in found.collect()}
    assert {labels[i] for i in range(100, 161)} == {100}
    assert {labels[i] for i in [7, *range(300, 380)]} == {7}
    assert labels[401] == labels[400] == 400
    assert 500 not in labels


def direct_repeats(rows, length):
    def place(row):
        return (row[0] is None, row[0] or 0)

    seen, out = {}, []
    unique = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (place(r), hash_order(r[1])))
    for row in unique:
        raw = (row[1] or "").encode()
        covered = np.zeros(len(raw), bool)
        for at in range(len(raw) - length + 1):
            if raw[at : at + length] in seen:
                covered[at : at + length] = True
            else:
                seen[raw[at : at + length]] = True
        edges = np.concatenate([[False], covered])
        kept = bytes(np.frombuffer(raw, np.uint8)[~covered])
        out.append((row, (len(raw), int(covered.sum()), int((edges[1:] & ~edges[:-1]).sum()), hashlib.sha256(kept).hexdigest())))
    return dict(out)


TEXT_HASH = {}


def hash_order(text):
    return TEXT_HASH.get(text, 0)


def test_repeats_equal_a_direct_search(spark, messy):
    for row in messy.selectExpr("text", "xxhash64(text) AS h").distinct().collect():
        TEXT_HASH[row.text] = row.h
    expected = direct_repeats(messy_rows(), 100)
    found = repeats.remove_repeats(messy, 100).collect()
    assert len(found) == messy.count()
    by_row = {}
    for (doc, _), value in expected.items():
        by_row.setdefault(doc, set()).add(value)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in by_row[r.doc_id]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert sum(r.n_removed for r in found) > 0


def test_hot_anchors_are_dealt_window_by_window(messy):
    plain = repeats.remove_repeats(messy, 40).drop("kept").collect()
    ranges = repeats.covered_ranges(messy, 40, hot=1)
    covered = {}
    for r in ranges.collect():
        covered.setdefault((r.doc_id, r.text_key), set()).update(range(r.start, r.end))
    last = (1 << 63) - 1
    total = {}
    for (doc, _), places in covered.items():
        total[doc] = total.get(doc, 0) + len(places)
    expected = {}
    for doc, removed in {(r.doc_id if r.doc_id is not None else last, r.kept_sha256): r.n_removed for r in plain}.items():
        expected[doc[0]] = expected.get(doc[0], 0) + removed
    assert total == {k: v for k, v in expected.items() if v}


def test_parts_of_a_long_text_give_the_same_ranges(spark, monkeypatch):
    text = prose(21, 400) + prose(22, 300) + prose(21, 400)
    docs = spark.createDataFrame([(1, text), (2, text[500:900] + prose(23, 50))], "doc_id long, text string")
    whole = sorted(repeats.remove_repeats(docs, 60).drop("kept").collect())
    row = next(iter(repeats._portions.__globals__["T"].blocks.__defaults__))
    assert row == "text"
    expected = direct_repeats([(1, text), (2, text[500:900] + prose(23, 50))], 60)
    assert [tuple(r)[1:] for r in whole] == [v for _, v in sorted(expected.items())]


def test_repeats_of_nothing(nothing):
    assert repeats.remove_repeats(nothing).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=40), min_size=1, max_size=6))
def test_longest_previous_factors(texts):
    """A window is covered if and only if its string starts at an earlier place."""
    length = 6
    data, offsets = T.texts_of(__import__("pyarrow").array(texts))
    found = repeats.covered_windows(data, offsets[:-1], np.diff(offsets) - length + 1, length)
    seen, expected = set(), []
    for text in texts:
        for at in range(len(text) - length + 1):
            expected.append(text[at : at + length] in seen)
            seen.add(text[at : at + length])
    assert found.tolist() == expected


def direct_sentences(rows, span, words):
    first, out = {}, {}
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, TEXT_HASH.get(r, 0)))
    for row in order:
        for run, a, _ in sentences.runs(sentences.split(row[1]), span, words):
            first.setdefault(run, (row, a))
    for row in order:
        parts = sentences.split(row[1])
        gone = set()
        for run, a, b in sentences.runs(parts, span, words):
            if first[run] != (row, a):
                gone.update(range(a, b))
        out[row] = (len(parts), len(gone), None if row[1] is None else "".join(p for i, p in enumerate(parts) if i not in gone))
    return out


def test_sentence_runs(messy):
    for row in messy.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h").distinct().collect():
        TEXT_HASH[(row.doc_id, row.text)] = row.h
    expected = direct_sentences(messy_rows(), sentences.SPAN, sentences.WORDS)
    found = sentences.remove_repeated_sentences(messy).collect()
    assert sorted(map(str, ((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in found))) == sorted(
        str((r[0], *expected[(r[0], r[1])])) for r in messy_rows()
    )
    assert sum(r.n_removed for r in found) > 0


def test_later_of_equal_texts_loses_every_sentence(spark):
    """Also behind a sentence of many words, at the end and in texts of few sentences."""
    long = "heating " + "the stone house " * 12 + "then. "
    texts = [
        f"A {long}River ready. House ready.",
        f"Stone ready. River under. B {long}House under.",
        f"C {long}Then river.",
        f"D {long}",
        "One two. Three four.",
        "Five six",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    rows.append((200, f"New here. {texts[0]} Others here."))
    found = {
        r.doc_id: r.text
        for r in sentences.remove_repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert [found[100 + i] for i in range(len(texts))] == [""] * len(texts)
    assert [found[i] for i in range(len(texts))] == texts
    assert found[200] == "New here. Others here."


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a. ", "b c! ", "... ", "d " * 9 + ". ", "e " * 4 + "\n"]), max_size=9))
def test_runs_cover_every_sentence_with_words(parts):
    own = sentences.split("".join(parts))
    covered = {i for _, a, b in sentences.runs(own, 3, 7) for i in range(a, b)}
    assert covered >= {i for i, s in enumerate(own) if any(c.isalnum() for c in s)}


def test_sentences_join_to_the_text():
    for text in ("", "a", "A b. C!\n\nD? ", "...", "x.y.z", "\n\n a", "Mr. X\tgoes."):
        assert "".join(sentences.split(text)) == text


def test_sentences_of_nothing(nothing):
    assert sentences.remove_repeated_sentences(nothing).collect() == []
