"""Graph search against exact search, and preference formatting against a direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import chat, graph_search


def exact(vectors, asked, k):
    """Per query id the k best (score, id), ties to the smaller id."""
    out = {}
    for q, own in asked:
        scored = sorted((-float(np.dot(own, v)), i) for i, v in vectors if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def rows_of(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard", [700, 100_000])
def test_recall_and_scores(spark, shard):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 24))
    data = [(i, (centres[i % 10] + rng.normal(size=24)).tolist()) for i in range(2000)]
    vectors = graph_search.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    found = rows_of(graph_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, shard).collect())
    expected = exact([(i, np.array(v)) for i, v in data], [(i, np.array(v)) for i, v in data if i % 20 == 0], 20)
    assert found.keys() == expected.keys()
    hits = [len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 20 for q in expected]
    assert np.mean(hits) >= 0.9
    by_id = {i: np.array(v) for i, v in data}
    for q, answers in found.items():
        assert len(answers) == 20
        assert answers == sorted(answers, key=lambda a: (-a[1], a[0]))
        assert all(s == pytest.approx(by_id[q] @ by_id[i], abs=1e-12) for i, s in answers)


def test_messy_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5) + 1, 1.0, float(i)]) for i in range(12)]
    twins = [(i, [1.0, 2.0, 3.0]) for i in range(20, 60)]
    bad = [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [nan, 1.0, 1.0]), (105, [inf, 1.0, 1.0]), (106, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    data = good + twins + bad + good[:2]
    frame = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<double>, shard string, place int")
    vectors = graph_search.usable(frame)
    asked = vectors.where("vec_id % 20 = 0")
    found = rows_of(graph_search.nearest(vectors, asked, 20).collect())
    valid = [(i, np.array(v)) for i, v in good + twins]
    expected = exact(valid, [(i, v) for i, v in valid if i % 20 == 0], 20)
    assert found == {q: [(i, pytest.approx(s)) for i, s in a] for q, a in expected.items()}
    few = graph_search.usable(frame.where("vec_id < 4"))
    assert {q: len(a) for q, a in rows_of(graph_search.nearest(few, few, 20).collect()).items()} == dict.fromkeys(range(4), 3)
    none = graph_search.usable(frame.where("vec_id = 102"))
    assert graph_search.nearest(none, none, 20).collect() == []


def rendered(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def direct_pair(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def masked(turns):
        text, spans = "", []
        for role, t in turns:
            start = len(text) + len(role) + 5
            text += f"<|{role}|>\n{t}<|end|>\n"
            if role == "assistant":
                spans.append((start, start + len(t) + 7))
        return text, spans

    return (n, rendered(a[:n]), *masked(a[n:]), *masked(b[n:]))


def test_preference_pairs(spark):
    conversations = {
        0: [("system", "be brief"), ("user", "hi\U0001f600"), ("assistant", "hello")],
        1: [("system", "be brief"), ("user", "hi\U0001f600"), ("assistant", "go away"), ("user", "why?"), ("assistant", "")],
        2: [("user", "a")],
        3: [("user", "a"), ("assistant", "b")],
        4: [("user", "x"), ("assistant", "y")],
        5: [("user", "z")],
        6: [("user", "alone")],
        8: [(None, None), ("assistant", "k")],
        9: [(None, None), ("assistant", "k")],
    }
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "nobody"), (4, 1, "assistant", "y")]  # a turn stated twice counts twice
    conversations[4].append(("assistant", "y"))
    frame = spark.createDataFrame([(*r, "x") for r in rows[::-1]], "conv_id long, turn long, role string, text string, pair_id string").repartition(3)
    made = chat.preference_pairs(frame, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    found = {r.pair_id: r for r in made.collect()}
    plain = {c: [(r or "unknown", t or "") for r, t in turns] for c, turns in conversations.items()}
    assert found.keys() == {0, 1, 2, 4}
    for pair, r in found.items():
        n, prompt, chosen, chosen_mask, rejected, rejected_mask = direct_pair(plain[2 * pair], plain[2 * pair + 1])
        assert (r.chosen_id, r.rejected_id, r.n_prefix) == (2 * pair, 2 * pair + 1, n)
        assert (r.prompt, r.chosen, r.rejected) == (prompt, chosen, rejected)
        assert [tuple(s) for s in r.chosen_mask] == chosen_mask
        assert [tuple(s) for s in r.rejected_mask] == rejected_mask
        for text, spans in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(text[s.start : s.end].endswith("<|end|>") for s in spans)
    assert chat.preference_pairs(frame.limit(0), F.col("conv_id"), F.lit(True)).collect() == []
    texts = made.select(chat.mask_text(F.col("chosen_mask")).alias("m")).collect()
    assert all("," not in r.m or ":" in r.m for r in texts)


def test_rejected_sides_answer_with_the_next_conversations_reply(spark):
    conversations = {
        0: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")],
        1: [("user", "e"), ("assistant", "f")],
        2: [("user", "g")],
        3: [("assistant", "h"), ("assistant", "h")],
        5: [(None, None), ("assistant", None), ("user", "end")],
    }
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    rows += [(3, 1, "assistant", "h"), (7, None, "assistant", "x"), (None, 0, "user", "nobody")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, last string")
    found = sorted(map(str, map(tuple, chat.with_other_replies(frame).collect())))
    replies = {(0, 3): "f", (1, 1): "", (3, 1): "", (5, 1): "", (7, None): ""}
    expected = [
        (c, i, r or "unknown", replies.get((c, i), t or "") if r == "assistant" else t or "")
        for c, i, r, t in rows
        if c is not None
    ]
    assert found == sorted(map(str, expected))
    sides = frame.select("conv_id", "turn", "role", "text").withColumn("side", F.lit(True)).unionByName(
        chat.with_other_replies(frame).withColumn("side", F.lit(False))
    )
    pairs = {r.pair_id: r for r in chat.preference_pairs(sides, F.col("conv_id"), F.col("side")).collect()}
    assert {c: r.n_prefix for c, r in pairs.items()} == {0: 3, 1: 1, 2: 1, 3: 1, 5: 3, 7: 0}
    assert chat.with_other_replies(frame.limit(0)).collect() == []
