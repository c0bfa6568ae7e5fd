import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, rows_of, same_as_sql

from dialoom.llm import catalog, neardup
from dialoom.llm.canonical import canonical_values
from dialoom.session import checkpoint

VOCAB = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ala", "ebo", "ino", "ost", "ulk", "ard", "irn", "ump")]


def words(q, a):
    return set(re.findall(r"[^\W_]+", f"{q or ''} {a or ''}".lower()))


def brute(rows):
    out = set()
    for i, (k, q, a) in enumerate(rows):
        for m, r, b in rows[i + 1 :]:
            x, y = words(q, a), words(r, b)
            if x | y and 5 * len(x & y) >= 3 * len(x | y):
                out.add((min(k, m), max(k, m)))
    return out


def edited(rng, text):
    ws = text.split()
    for _ in range(rng.randrange(0, 5)):
        i = rng.randrange(len(ws))
        ws[i] = rng.choice(VOCAB) if rng.random() < 0.6 else ws[i].upper() + "!"
    rng.shuffle(ws)
    return " ".join(ws)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows, key = [], 0
    for _ in range(60):
        q, a = " ".join(rng.choices(VOCAB, k=22)), " ".join(rng.choices(VOCAB, k=12))
        for _ in range(rng.randrange(1, 5)):
            key += 1
            rows.append((key, edited(rng, q), rng.choice([a, a, None])))
    rows += [(900, None, None), (901, "", " "), (902, "same text", None), (903, "SAME, text", None), (904, "same", "text"), (905, "x" * 20000, None), (906, "x" * 20000, "y")]
    df = spark.createDataFrame([(k, q, a, "w", 1) for k, q, a in rows], "qa_key long, question_text string, gold_answer string, words string, id int")
    got = {tuple(r) for r in neardup.like_pairs(df, "qa_key", ["question_text", "gold_answer"]).collect()}
    assert got == brute(rows)


def test_variants_of_a_hot_text_are_found(spark):
    """A third of the rows are copies of one text; edits hit words found nowhere else."""
    rng = random.Random(8)
    hot = rng.sample(VOCAB, 30)
    rows = [(i, " ".join(hot), None) for i in range(60)]
    for i in range(60, 120):
        n = rng.randrange(1, 8)
        rows.append((i, " ".join(hot[n:] + [f"rare{i}x{j}" for j in range(n)]), None))
    rows += [(i, " ".join(f"other{rng.randrange(2000)}" for _ in range(30)), None) for i in range(120, 180)]
    df = spark.createDataFrame(rows, "qa_key long, question_text string, gold_answer string")
    got = {tuple(r) for r in neardup.like_pairs(df, "qa_key", ["question_text", "gold_answer"]).collect()}
    assert got == brute(rows)


def test_no_side_that_grows_is_broadcast(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id", "concat('lamp stone river ', id % 50, ' door ', id % 7) as text")
    plans = []
    monkeypatch.setattr(neardup, "checkpoint", lambda df: plans.append(df) or checkpoint(df))
    plans += [neardup.like_pairs(rows, "id", ["text"]), neardup.groups(rows, "id", ["text"])]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_rows_no_pairs(spark):
    df = spark.createDataFrame([], "qa_key long, question_text string, gold_answer string")
    assert neardup.like_pairs(df, "qa_key", ["question_text", "gold_answer"]).count() == 0


def test_groups_follow_chains_and_copies(spark):
    base = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(base[3 * i : 3 * i + 20])) for i in range(6)] + [(50 + i, "one copied sentence of five") for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "qa_key long, question_text string")
    got = {r.id: (r.group_id, r.n_links) for r in neardup.groups(df, "qa_key", ["question_text"]).collect()}
    assert {got[i][0] for i in range(6)} == {0} and {got[50 + i] for i in range(30)} == {(50, 0)} and got[99] == (99, 0) and len(got) == len(rows)


def test_signatures_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(1)
    pool = rng.integers(-(2**62), 2**62, 4000)
    sets = []
    for i in range(200):
        own = pool[i * 10 : i * 10 + 10]
        sets += [np.sort(np.concatenate([own, pool[2000 + i * 5 : 2000 + i * 5 + 5]])), np.sort(np.concatenate([own, pool[3000 + i * 5 : 3000 + i * 5 + 5]]))]
    sizes = np.array([len(x) for x in sets])
    symbols, _ = neardup.signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    assert int(symbols.max()) < 1 << neardup.BITS
    keys = neardup.chunk_keys(symbols)
    allowed = neardup.POSITIONS // neardup.WIDTH * (neardup.ERRORS + 1) - 1
    close = [i for i in range(0, 400, 2) if (symbols[i] != symbols[i + 1]).sum() <= allowed]
    assert len(close) > 50 and all(set(keys[i]) & set(keys[i + 1]) for i in close)  # the guarantee of the chunks
    met = [len(set(keys[i]) & set(keys[i + 1])) > 0 for i in range(0, 400, 2)]
    apart = [len(set(keys[i]) & set(keys[i + 2])) > 0 for i in range(0, 398, 2)]
    assert np.mean(met) > 0.99 and np.mean(apart) < 0.01


def looked_at(monkeypatch, sets, limit=(3, 5)):
    """Pairs that may be alike by the kernel alone, and how many were looked at."""
    at, seen, order = neardup._Bucket.all_pairs, [0], np.zeros(neardup.ORDER, np.int64)
    flat = np.concatenate(sets)
    with np.errstate(over="ignore"):
        np.add.at(order, (neardup._mix(flat.view(np.uint64)) & np.uint64(neardup.ORDER - 1)).astype(np.int64), 1)

    def counted(self, level, row, pos, many, first):
        seen[0] += int(many.sum())
        at(self, level, row, pos, many, first)

    monkeypatch.setattr(neardup._Bucket, "all_pairs", counted)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets))), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))], ["rep", "words"])
    entries = pa.Table.from_batches(neardup._entries(order, limit)(iter([batch]))).sort_by("key").to_batches(max_chunksize=500)
    met = {(r["rep_a"], r["rep_b"]) for b in neardup._meet(limit)(iter(entries)) for r in b.to_pylist()}
    monkeypatch.setattr(neardup._Bucket, "all_pairs", at)
    return met, seen[0]


@pytest.mark.parametrize("limit", [(3, 5), (4, 5), (1, 3)])
def test_no_pair_is_missed_whatever_its_size(monkeypatch, limit):
    """Sets of one to four hundred words, with groups cut as often as can be and held in small parts."""
    for name, value in (("SMALL", 0), ("BUCKETS", 700), ("ENTRIES", 200), ("PAIRS", 50), ("LONG", 60)):
        monkeypatch.setattr(neardup, name, value)
    rng = np.random.default_rng(4)
    pool = rng.integers(-(2**62), 2**62, 500)
    sets = [np.unique(rng.choice(pool[:14], n)) for n in rng.integers(1, 9, 250)]
    for n in (8, 30, 50, 90, 400):
        base = rng.choice(pool, n, False)
        for _ in range(25):
            kept = base[rng.random(n) < rng.uniform(0.6, 1)]
            sets.append(np.unique(np.concatenate([kept, rng.choice(pool, rng.integers(1, 2 + n // 4))])))
    sets = [np.array(x) for x in {tuple(x) for x in sets}]
    whole = [set(x) for x in sets]
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if limit[1] * len(whole[i] & whole[j]) >= limit[0] * len(whole[i] | whole[j])}
    met, _ = looked_at(monkeypatch, sets, limit)
    assert len(true) > 50 and true <= met


def test_rows_of_one_template_do_not_meet_because_of_it(monkeypatch):
    """Half of the words are those of a template: of all pairs less than a tenth is looked at."""
    rng = np.random.default_rng(5)
    pool = rng.integers(-(2**62), 2**62, 3000)
    sets = [np.sort(np.concatenate([pool[:25], rng.choice(pool[25:], 25, False)])) for _ in range(3000)]
    sets += [np.sort(np.concatenate([x[:-4], pool[-4:]])) for x in sets[:50]]
    met, seen = looked_at(monkeypatch, sets)
    assert {(i, 3000 + i) for i in range(50)} <= met and seen < 3050 * 3049 / 2 / 10


def test_values_and_unmatched(spark):
    canon = spark.createDataFrame([("question_type", "judgment", ""), ("question_type", "retrieval", ""), ("content_type", "instant_emotion", ""), ("reasoning_structure", "multi-hop", ""), ("reasoning_structure", "single-hop", "")], "field_name string, canonical_value string, description string")
    rows = [(1, "MULTI－HOP ", "judgemnt", "ínstant_еmotion"), (2, "multi-hop", None, " "), (3, "2+ hops", "judgm.", "Inst. emotion"), (4, "snigle-hop", "weather", "type: instant_emotion"), (5, "l" * 9000, "retrieval (checked)", "???"), (5, "mluti hop", "Judgement", "instant_emotion - v2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "qa_key long, reasoning_structure string, question_type string, content_type string, field_name string")
    got = rows_of(canonical_values(spark, df, canon), "qa_key", "field_name", "canonical_value")
    assert got == sorted([
        (1, "reasoning_structure", "multi-hop"), (1, "question_type", "judgment"), (1, "content_type", "instant_emotion"), (3, "reasoning_structure", "multi-hop"), (3, "question_type", "judgment"),
        (3, "content_type", "instant_emotion"), (4, "reasoning_structure", "single-hop"), (4, "question_type", "unmatched"), (4, "content_type", "instant_emotion"), (5, "reasoning_structure", "unmatched"),
        (5, "question_type", "retrieval"), (5, "content_type", "unmatched"), (5, "reasoning_structure", "multi-hop"), (5, "question_type", "judgment"), (5, "content_type", "instant_emotion"),
    ], key=repr)
    assert {r[2] for r in rows_of(canonical_values(spark, df, canon.limit(0)), "qa_key", "field_name", "canonical_value")} == {"unmatched"}
    assert canonical_values(spark, df.limit(0), canon).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_groups", "p2_found", "p4_found", "p4_report"])
def test_query_equals_sql(spark, duck, name):
    mine, theirs = same_as_sql(spark, duck, catalog, name)
    assert mine == theirs and mine and SMALL
