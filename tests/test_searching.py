import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from test_queries import needs_data

from dialoom.operators import searching
from dialoom.plans import reference


def brute(query, docs):
    terms = [Counter(re.findall("[a-z0-9]+", d)) for d in docs]
    sizes = [sum(t.values()) for t in terms]
    mean = max(sum(sizes) / len(docs), 1)

    def bm25(t, size):
        total = 0
        for w, m in Counter(re.findall("[a-z0-9]+", query)).items():
            df = sum(1 for x in terms if x[w])
            total += m * math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * t[w] * 2.2 / max(t[w] + 1.2 * (0.25 + 0.75 * size / mean), 1e-9)
        return total

    grams = lambda x: Counter([x[i : i + 3] for i in range(max(len(x) - 2, 1))] if x else [])
    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    q, each = grams(query), [grams(d) for d in docs]
    return [bm25(t, n) for t, n in zip(terms, sizes, strict=True)], [sum(q[g] * d[g] for g in q) / (norm(q) * norm(d)) if q and d else 0.0 for d in each]


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_scores_equal_brute_force(monkeypatch, limit):
    monkeypatch.setattr(searching, "CHARS", limit)
    monkeypatch.setattr(searching, "HITS", limit)
    draw = random.Random(1)
    text = lambda n: " ".join(draw.choice(["aa", "b", "cat", "élan", "the", "x1", "river", "𝒜𝒜𝒜𝒜"]) for _ in range(n))
    docs = [[text(draw.randint(0, 8)) for _ in range(draw.randint(1, 6))] for _ in range(5)]
    asked = [(g, draw.randint(0, len(docs[g])), text(draw.randint(0, 7))) for g in range(5) for _ in range(3)]
    own = [[text(3) for _ in range(draw.randint(1, 3))] for _ in asked]
    group = np.array([g for g, x in enumerate(docs + own) for _ in x])
    pos = np.array([p for x in docs + own for p in range(1, len(x) + 1)])
    both = [(np.array([a[0] for a in asked]), np.array([a[1] for a in asked])), (np.arange(len(asked)) + len(docs), np.array([len(x) for x in own]))]
    first, bm25, cosine = searching.scores([a[2] for a in asked], [d for x in docs + own for d in x], group, pos, both)
    for j, (g, upto, query) in enumerate(asked):
        wanted = brute(query, docs[g][:upto] + own[j])
        assert np.allclose(bm25[first[j] : first[j + 1]], wanted[0], atol=1e-9) and np.allclose(cosine[first[j] : first[j + 1]], wanted[1], atol=1e-9)


@needs_data
def test_local_search_shuffles_texts_only(spark):
    plan = reference.QUERIES["hybrid_top"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and "term#" not in plan


def test_windows_of_other_sessions_count_where_the_chosen_have_none():
    schema = pa.schema([("query_id", pa.int64()), ("pos", pa.int64()), ("dia_id", pa.string())])
    said = [(1, "red boat"), (1, "red lamp"), (1, "grey lamp"), (2, "green cat sleeps"), (3, "green cat"), (3, "green cat wakes")]
    turns = [{"session": s, "turn": i, "dia_id": f"D{i}", "text": x} for i, (s, x) in enumerate(said, 1)]
    batch = pa.RecordBatch.from_pylist([{"turns": turns, "asked": [{"query_id": 7, "upto": 5, "text": "green cat"}, {"query_id": 8, "upto": 3, "text": "grey"}], "chars": 90}])
    out = [r for b in searching.session_first(2, 1, 2, schema)(iter([batch])) for r in b.to_pylist()]
    # no window begins in sessions 2 and 3 before the fifth turn: of all five the one with the shortest rest is best; never a later turn
    assert [r["pos"] for r in out if r["query_id"] == 7] == [3, 4, 5] and {r["pos"] for r in out if r["query_id"] == 8} == {1, 2, 3}


@needs_data
def test_whole_history_is_searched_without_copies_of_it(spark):
    plan = reference.QUERIES["session_first_context"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and "text" not in plan.split("MapInArrow")[0]


@needs_data
def test_every_question_with_an_anchor_has_a_context(spark, duck):
    asked = {r.qa_key for r in reference.QUERIES["session_first_context"](spark, SMALL).select("qa_key").collect()}
    assert asked == {r[0] for r in duck.sql(reference.W_Q + "SELECT qa_key FROM anchored WHERE anchor_id IS NOT NULL").fetchall()}
    assert any(k % 100 for k in asked)


def first_by_brute_force(said, upto, query):
    """Places of the context of a query: two sessions, then four windows of two turns around a turn."""
    history = said[:upto]
    join = lambda lines: " ".join(x for x in lines if x)

    def top(docs, k):
        if not docs:
            return []
        total = [0.0] * len(docs)
        for x in brute(query, docs):
            low, high = min(x), max(x)
            total = [t + 0.5 * ((v - low) / (high - low) if high - low >= 1e-9 else float(high > 0)) for t, v in zip(total, x, strict=True)]
        return sorted(range(len(docs)), key=lambda i: (-math.floor(total[i] * 1e9 + 0.5), i))[:k]

    sessions = sorted({s for s, _, _ in history})
    best = {sessions[i] for i in top([join(x for s, _, x in history if s == n) for n in sessions], 2)}
    centers = [c for c in range(upto) if history[max(c - 2, 0)][0] in best] or list(range(upto))
    chosen = [centers[i] for i in top([join(x for _, _, x in history[max(c - 2, 0) : c + 3]) for c in centers], 4)]
    return sorted({p + 1 for c in chosen for p in range(max(c - 2, 0), min(c + 3, upto))})


@pytest.mark.parametrize(("long", "windows", "chars", "table", "places"), [(256, 4096, 1_000_000, 1 << 21, 2_000_000), (0, 4096, 50, 1 << 21, 7), (0, 2, 50, 0, 2_000_000)])
def test_session_first_equals_brute_force(monkeypatch, long, windows, chars, table, places):
    for name, value in (("LONG", long), ("WINDOWS", windows), ("CHARS", chars), ("TABLE", table), ("PLACES", places), ("DOCS", 3), ("MANY", 5), ("NEAR", 2), ("FEW", 2), ("LINES", 7)):
        monkeypatch.setattr(searching, name, value)
    schema = pa.schema([("query_id", pa.int64()), ("pos", pa.int64()), ("dia_id", pa.string())])
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice(["aa", "b", "cat", "élan", "the", "x1", "river", "𝒜𝒜", "河", "boat", "grey"]) for _ in range(n))
    for _ in range(20):
        said, session = [], 1
        for i in range(draw.randint(1, 60)):
            session += draw.random() < 0.3
            said.append((session, f"D{i}", text(draw.randint(0, 5))))
        asked = [(q, draw.randint(1, len(said)), text(draw.randint(0, 5))) for q in range(12)]
        packed = {"turns": [{"session": s, "turn": i, "dia_id": d, "text": x} for i, (s, d, x) in enumerate(said)], "asked": [{"query_id": q, "upto": u, "text": x} for q, u, x in asked], "chars": 1}
        got = [r for b in searching.session_first(2, 4, 2, schema)(iter([pa.RecordBatch.from_pylist([packed])])) for r in b.to_pylist()]
        for q, upto, query in asked:
            assert [r["pos"] for r in got if r["query_id"] == q] == first_by_brute_force(said, upto, query)
