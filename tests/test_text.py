from pyspark.sql import functions as F

from dialoom.functions import text


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_enum_and_level_labels(spark):
    assert one(spark, lambda x: text.enum_token(x, "judgment", {"judgement": "judgment"}), " Judgement ") == "judgment"
    assert one(spark, lambda x: text.enum_token(x, "f"), "Long Term  Implicit-Emotion") == "long_term_implicit_emotion"
    assert one(spark, lambda x: text.enum_token(x, "f"), " ") == "f" and one(spark, lambda x: text.enum_token(x, "f"), None) == "f"
    assert one(spark, lambda x: text.level_label(x, "Level 0"), "level0") == "Level 0" and one(spark, lambda x: text.level_label(x, "?"), "Level 7") == "?"
    assert one(spark, text.reasoning, "Single-hop") == "single-hop" and one(spark, text.reasoning, "trajectory_based") == "trajectory-based" and one(spark, text.reasoning, "causal chain") == "multi-hop"


def test_damaged_characters(spark):
    assert one(spark, text.unmangled, "Itâ€™s been a long week.") == "It's been a long week."
    assert one(spark, lambda x: text.nfkc(x), "ｆｕｌｌ") == "full" and one(spark, lambda x: text.nfkc(x), None) is None


def test_leaks_and_rewording(spark):
    assert one(spark, text.leak_labels, "a bit Stressed, showing relief") == ["emotion_distress", "emotion_positive", "interpretive_verb"]
    assert one(spark, text.leak_labels, "steady pace") == [] and one(spark, text.leak_labels, None) == []
    df = spark.createDataFrame([("anxious , slight pause",), ("ashamed, feeling hurt",), ("Cautious relief",), ("flat tone",), (None,)], "v string")
    assert [r.v for r in text.with_voice_reworded(df, "v", ()).collect()] == ["slightly tight delivery, slightly pause", "quieter delivery, tighter delivery", "Cautious softer closing words", "flat tone", None]
    assert [r.v for r in text.with_voice_reworded(df, "v").collect()] == ["quicker pace, tighter delivery, slightly pause", "quieter delivery, clipped ending, tighter delivery", "Cautious small exhale", "flat tone", None]


def test_keys_and_names(spark):
    assert one(spark, text.answer_key, '```json\n{"answer": "A) The  Lamp"}\n```') == "the lamp"
    assert one(spark, text.answer_key, "b. x") == "b. x"  # option letters are upper case
    assert one(spark, text.slug, "Conv 1/ä!") == "conv-1" and one(spark, text.safe_name, "a b/é-_") == "a_b_é-_"
    assert one(spark, lambda x: text.short_hash(F.lit("a"), x), None) == one(spark, lambda x: text.short_hash(F.lit("a"), x), "")
    assert one(spark, lambda x: text.shortened(x, 10), "a  b" * 5) == "a ba ba..."
    assert one(spark, text.options_block, ["x", "y"], "array<string>") == "A. x\nB. y" and one(spark, text.options_block, [], "array<string>") == ""


def test_judge_scores(spark):
    got = one(spark, text.judge_scores, '{"final_score": 0.5, "verdict": "good", "key_point_coverage": "x"}')
    assert got.final_score == 0.5 and got.verdict == "good" and got.key_point_coverage == 0.0
    assert one(spark, text.judge_scores, "no json").verdict == "parse_error"
