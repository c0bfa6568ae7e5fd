import re
from collections import Counter
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from dialoom.llm import abuse, balanced, defects

CANON = [("content_type", "a_fact", ""), ("content_type", "b_feeling", "")]


@pytest.fixture(scope="module")
def canon(spark):
    return spark.createDataFrame(CANON, "field_name string, canonical_value string, description string")


def plans(spark, rows):
    return spark.createDataFrame(rows, "plan_id string, field_name string, sample_size int, category string, target_pct int, min_rows int")


def qa(spark, n):
    return spark.range(n).select(
        F.col("id").alias("qa_key"), F.when(F.col("id") % 10 == 0, "B_Feeling").when(F.col("id") % 97 == 1, None).otherwise("a_fact").alias("content_type"),
        F.lit(None).cast("string").alias("reasoning_structure"), F.lit("x").alias("question_type"),
        F.when(F.col("id") % 3 == 0, "Level 0").otherwise("Level 1").alias("memory_level"), F.lit("z").alias("category"),
    ).repartition(7)


def test_sample_keeps_the_mix_and_is_repeatable(spark, canon):
    p = plans(spark, [("m", "content_type", 100, "a_fact", 70, 5), ("m", "content_type", 100, "b_feeling", 30, 5), ("l", "memory_level", 60, "Level 0", 50, 1), ("l", "memory_level", 60, "Level 1", 50, 1)])
    sample, allocation, expected = balanced.balanced_sample(spark, qa(spark, 3000), canon, p)
    rows = rows_of(sample, "plan_id", "content_type", "memory_level", "qa_key")
    assert Counter((r[0], r[1] if r[0] == "m" else r[2]) for r in rows) == {("m", "a_fact"): 70, ("m", "b_feeling"): 30, ("l", "Level 0"): 30, ("l", "Level 1"): 30}
    assert len(set(rows)) == len(rows)
    other = balanced.balanced_sample(spark, qa(spark, 3000).orderBy(F.desc("qa_key")).repartition(7), canon, p)[0]
    assert len(rows) == other.count()
    assert rows == rows_of(balanced.balanced_sample(spark, qa(spark, 3000), canon, p)[0], "plan_id", "content_type", "memory_level", "qa_key")
    assert {(r.residual, r.missing) for r in balanced.balance_report(sample, allocation).collect()} == {(0, 0)}
    left = {(r.plan_id, r.field_name, r.category): r.residual for r in balanced.residuals(sample, expected).collect()}
    assert all(abs(v) < 2 for v in left.values())  # the other field is balanced too, up to the rounding of the landing
    assert all(v == 0 for (plan, f, _), v in left.items() if f == {"m": "content_type", "l": "memory_level"}[plan])


def test_shortages_and_too_few_rows(spark, canon):
    p = plans(spark, [("m", "content_type", 100, "a_fact", 50, 0), ("m", "content_type", 100, "b_feeling", 1, 10), ("u", "no_such_field", 9, "x", 100, 1)])
    few = qa(spark, 40)
    assert rows_of(balanced.shortages(spark, few, canon, p), "plan_id", "category") == [("m", "a_fact"), ("m", "b_feeling"), ("u", "x")]
    sample = balanced.balanced_sample(spark, few, canon, p)[0]
    assert Counter(r.content_type for r in sample.collect()) == {"a_fact": 36 - sum(i % 97 == 1 for i in range(40)), "b_feeling": 4}
    assert balanced.balanced_sample(spark, few.limit(0), canon, p)[0].count() == 0
    assert balanced.shortages(spark, few, canon, p.limit(0)).count() == 0


def joint(n, p, seed):
    rng = np.random.default_rng(seed)
    fields = {"content_type": rng.choice(list("abc"), n), "memory_level": rng.choice(["0", "1", None], n), "reasoning_structure": rng.choice(list("xyz"), n, p=[0.8, 0.15, 0.05]), "question_type": rng.choice(list("mn"), n)}
    return pd.DataFrame({"plan_id": "q", "qa_key": np.arange(n), "prob": p, "taken": None, **fields})


def test_every_row_has_its_chance():
    hits = np.zeros(40)
    for seed in range(600):
        rows = joint(40, 0.25, 1)
        hits += balanced.flown(rows, "content_type", seed, landing=True).taken.to_numpy(bool)
    assert abs(hits.mean() - 150) < 15 and all(100 < h < 200 for h in hits)


def test_flights_keep_the_totals_of_all_indicators():
    rows = joint(2000, 0.1, 2)
    after = balanced.flown(rows, "content_type", 3)
    variables = balanced.matrix(rows, list(balanced.BALANCED))
    assert np.allclose(variables.T @ rows.prob, variables.T @ after.prob.to_numpy(float))
    assert after.taken.isna().sum() <= variables.shape[1]  # across cells, where no two rows are alike
    landed = balanced.flown(rows, "content_type", 3, landing=True)
    assert not landed.taken.isna().any() and np.abs(variables.T @ (landed.taken.to_numpy(float) - rows.prob)).max() < 3
    assert balanced.null_direction(np.eye(3)) is None and abs(balanced.null_direction(np.ones((3, 1))).sum()) < 1e-9


def test_allocation_with_minimums_above_the_size():
    assert balanced.allocate(10, [50, 50], [8, 8], [100, 100]) == [8, 8]
    assert balanced.allocate(10, [90, 10], [0, 3], [4, 100]) == [4, 6]
    assert sum(balanced.allocate(200, [11, 31, 33, 12, 13], [24] * 5, [1000] * 5)) == 200


Q = "In the office on Stone Road, who first repaired the silver lamp, and how did Maren connect it to the wedding of the two neighbours?"
WHOLE = "Maren wants {} to notice the {} lamp without being asked, which is why the wedding is quietly moved and the mood stays {}"
CASES = [
    (None, "empty"), ("", "empty"), ("​", "empty"), ("N/A", "empty"), ("{}", "empty"), ('""', "empty"), ("...", "empty"),
    ("I'm sorry, but I can't help with that.", "refusal"), ("As an automated assistant, this is not something I can comment on at this time!", "refusal"), ("Je suis désolé, je ne peux pas répondre à cette demande.", "refusal"),
    ("Lo siento, no puedo ayudarte con eso.", "refusal"), ("[content withheld by policy]", "refusal"), ('"No comment, I cannot discuss this."', "refusal"),
    (Q, "copy"), ("Answer: " + Q.lower().replace("repaired", "repaired  teh"), "copy"), ("Who first repaired the silver lamp, and how did Maren connect it to the wedding of the two neighbours?", "copy"),
    ("Maren se siente más sereno que triste, porque la vela nueva importaba más y lo cambió todo.", "language"), ("不是生气，而是担心。", "language"), ("Era stata Maren a parlarne per prima, quindi non poteva sapere che cosa sarebbe successo alla fine.", "language"),
    (WHOLE.format("Ivo", "blue", "calm") + ".", None), ("Yes", None), ("Maren", None), ("At Stone Road", None), ("More calm than sad", None),
    ('"Sorry, I can\'t help you move the lamp," Ivo tells Maren, and that sad excuse covers the wedding.', None), ('Ivo refuses to discuss the lamp and says "I won\'t answer that", so guarded is the safest reading.', None),
    ("It cannot be determined from the talk: Ivo never says who moved it.", None), ('Maren moved it before the wedding, and that is why he says ("Schade", in his words).', None),
    (WHOLE.format("Ivo", "blue", "calm")[:60] + "…", "truncated"), ("Maren wants Ivo to notice the blue lamp without being asked, which is why the", "truncated"), ("Maren wants Ivo to notice (", "truncated"), (WHOLE.format("Ivo", "blue", "ca")[:-2].replace("stays ", "sta"), "truncated"),
]


def test_defects(spark):
    many = [(1000 + i, Q, WHOLE.format(n, c, m) + ".") for i, (n, c, m) in enumerate((n, c, m) for n in ("Ivo", "Osa", "Rik") for c in ("blue", "old", "red") for m in ("calm", "sad", "proud", "tender"))]
    rows = [(i, Q, a) for i, (a, _) in enumerate(CASES)] + many + [(5000, None, "Fine."), (5001, "", WHOLE.format("Ivo", "old", "sad")), (5002, Q, ("Maren moved the lamp. " * 900).strip())]
    df = spark.createDataFrame([(*r, "d") for r in rows], "qa_key long, question_text string, gold_answer string, defect string")
    got = {r.qa_key: r.defect for r in defects.defective_answers(df).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: d for i, (_, d) in enumerate(CASES)}
    assert not any(k >= 1000 for k in got)
    assert defects.defective_answers(df.limit(0)).count() == 0


def test_late_refusals_and_short_copies():
    restated = "You ask how Maren came to move the lamp before the wedding of the two neighbours. " * 12
    assert defects.judged(Q, restated + "I'm sorry, but I cannot help with that.")[0] == "refusal"
    assert defects.judged(Q, restated + 'Then Ivo says "I cannot help with that" and leaves.')[0] is None
    assert defects.judged(Q, restated)[0] is None
    assert defects.judged("Who moved it?", "who moved it")[0] == "copy" and defects.judged("Who moved it?", "Maren moved it")[0] is None


def test_short_answers_that_break_off(spark):
    rows = [(i, Q, f"Because of the {c} lamp, Maren stays {m}.") for i, (c, m) in enumerate((c, m) for c in ("blue", "old", "red", "tall") for m in ("calm", "sad", "proud"))]
    rows += [(100, Q, "Because of the"), (101, Q, "Because of"), (102, Q, "Old lamp"), (103, Q, "Maren"), (104, Q, "Because of the blue lamp")]
    df = spark.createDataFrame(rows, "qa_key long, question_text string, gold_answer string")
    got = {r.qa_key: r.defect for r in defects.defective_answers(df).collect()}
    assert {k: got.get(k) for k in range(100, 104)} == {100: "truncated", 101: "truncated", 102: None, 103: None} and not any(k < 100 for k in got)


@pytest.fixture(scope="module")
def model():
    return abuse.fitted([])


def test_disguises_are_taken_off():
    assert abuse.undisguised("You s c u m b a g, you b***h and idi​ot") == "you scumbag, you bitch and idiot"
    assert "vermin" in abuse.undisguised("All vеrmin") and "sex" in abuse.undisguised("have s-e-x") and "moron" in abuse.undisguised("m0r0n") and "idiot" in abuse.undisguised("IIIIIDIOT")


def test_held_out_sentences(model):
    """Sentences not among the labelled ones, with words and groups unseen there."""
    bad = ["Shut your stupid mouth, you worthless worm, nobody wants you here!", "every Drunesian is vermin and must be driven out of the valley", "send me nudes now, I want to see you naked", "I will smash your face in, you pathetic loser",
           "You are nothing but a filthy p-i-g and everyone knows it", "Du bist ein wertloser Idiot, halt die Fresse"]
    good = ["The Drunesian bakery near the harbour has the best bread.", "Could you kill the lights in the shed before you go?", "My feet are killing me after the parade.", "The clown in the sketch was a coward.", "The vermin in the barn were driven out with traps.",
            "He was so stupid to leave the bike in the rain, he said of himself.", "The sexual health lecture is on Monday.", "We met at the quarry and looked at the silver lamp."]
    assert [model.document(t) >= abuse.THRESHOLD for t in bad] == [True] * len(bad)
    assert sum(model.document(t) >= abuse.THRESHOLD for t in good) <= 1


def test_group_names_carry_no_weight(model):
    scores = [model.document(f"The {g} family sold bread at the fair and it was lovely.") for g in ("Morvish", "Mexican", "Drunesian", "Muslim", "Quorlish")]
    assert max(scores) < abuse.THRESHOLD and max(scores) - min(scores) < 0.25


def test_counterfactuals_differ_and_the_penalty_acts(model, monkeypatch):
    rows, pairs = abuse.labelled_sentences()
    words = [(abuse._words(a), abuse._words(b)) for a, b in pairs]
    assert pairs and all(sorted(abuse.features(a)) != sorted(abuse.features(b)) for a, b in words) and {a for a, _ in pairs} <= {t for t, _ in rows}
    terms = "|".join(sorted(abuse.seed.IDENTITY_TERMS, key=len, reverse=True))
    assert all(re.sub(terms, "", a) == re.sub(terms, "", b) for a, b in pairs)
    gap = lambda m: sum((m.score(a) - m.score(b)) ** 2 for a, b in pairs) / len(pairs)
    monkeypatch.setattr(abuse, "COUNTERFACTUAL_WEIGHT", 0.0)
    free = abuse.fitted([])
    assert 0 < gap(model) < 0.5 * gap(free)
    # neutral mentions of groups, some of them only named in abusive sentences before
    neutral = [f"{g} {rest}" for g in abuse.seed.IDENTITY_TERMS for rest in ("live here", "came by", "again", "in town", "?")]
    wrong = [sum(m.score(t) >= abuse.THRESHOLD for t in neutral) for m in (model, free)]
    assert wrong[0] <= wrong[1] and sum(model.score(t) for t in neutral) < sum(free.score(t) for t in neutral)


def test_wording_is_learnt_from_verdicts_on_documents():
    """Half of the verdicts' sentences are harmless, a tenth of the verdicts is wrong."""
    rng = np.random.default_rng(7)
    things = [f"thing{i}" for i in range(400)]
    harmless = ["we put the {} next to the {} in spring", "the {} was sold with a {} on top", "nobody saw the {} or the {} this week"]
    foul = ["may your {} rot under a {} forever", "only trash like you owns a {} and no {}"]
    text = lambda t: t.format(*rng.choice(things, 2))
    reviewed = []
    for i in range(400):
        parts = [text(harmless[int(k)]) for k in rng.integers(0, 3, 4)] + ([text(foul[i % 2])] if i % 4 == 0 else [])
        verdict = int(i % 4 == 0) if rng.random() > 0.1 else int(i % 4 != 0)
        reviewed.append((". ".join(parts[int(k)] for k in rng.permutation(len(parts))) + ".", verdict))
    taught = abuse.fitted(reviewed)
    assert all(taught.score(text(t)) >= 0.5 for t in foul * 20) and all(taught.score(text(t)) < 0.5 for t in harmless * 20)


def test_other_scripts_are_read(model):
    assert abuse.undisguised("Привет, аренда") == "привет, аренда" and abuse.undisguised("idıot").startswith("id") and abuse.undisguised("mо日rоn") == "moron"
    assert model.document("See you at noon. 我要杀了你") >= 0.5 and model.document("ну ты идиот, заткнись уже") >= 0.5
    assert model.document("今天天气很好") < 0.5 and model.document("спасибо за помощь") < 0.5


def test_scores_rates_and_odd_rows(spark, model):
    rows = [(1, "s", "You are a disgusting parasite."), (2, "s", None), (3, None, ""), (4, None, "fine " * 4000 + "\nI know where you live and I will kill you."), (4, None, "fine")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, source string, text string, score double")
    scored = abuse.scored_documents(df, model).cache()
    assert [r[1] >= 0.5 for r in rows_of(scored, "doc_id", "score")] == [True, False, False, False, True]
    assert rows_of(abuse.source_rates(scored), "source", "n_documents", "n_abusive") == [("s", 2, 1), ("unknown", 3, 1)]
    assert abuse.scored_documents(df.limit(0), model).count() == 0


def test_reviewed_sample_leaves_contradictions_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 1), (4, None)], "doc_id long, is_abusive int")
    assert abuse.reviewed_sample(docs, labels) == [("a", 1)] and datetime
