"""Text made by a model: prompts, dialogues turn by turn, repair rounds, judged answers.

The model is injected as a factory of clients (``model_calls.stub`` in tests), called once where a task
runs; calls are retried as in ``model_calls``. Only what depends on earlier answers is sequential: the turns of one dialogue.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import items
from dialoom.operators.model_calls import Client, answers, call
from dialoom.session import checkpoint

Model = Callable[[], Client]
TURN = "scenario string, session int, turn int, dia_id string, turn_index_global int, speaker string, text string, error string"


def rendered(template: str, **values: Column) -> Column:
    """A prompt template with its {{name}} places filled by columns; null fills nothing."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompt_language(wanted: Column) -> Column:
    """Language of the prompts: zh for anything that begins so, else en."""
    return F.when(F.startswith(F.lower(F.trim(F.coalesce(wanted, F.lit("")))), F.lit("zh")), "zh").otherwise("en")


def checked(model: Model) -> None:
    """Raise unless the model answers at all."""
    if not call(model(), "Reply with OK.")[0]:
        raise RuntimeError("the model does not answer")


def regenerated(prompts: DataFrame, model: Model, is_valid: Column, attempts: int = 3) -> DataFrame:
    """(key, answer, attempt, valid): prompts(key, prompt) asked again while ``is_valid`` (over ``answer``) fails.

    Each round asks for what is still invalid only; the last answer is kept and marked.
    """
    waiting, done = prompts, None
    for attempt in range(1, attempts + 1):
        asked = waiting if attempt == 1 else waiting.withColumn("prompt", F.concat("prompt", F.lit(f"\n\nAttempt {attempt}: the last answer was not valid.")))
        got = checkpoint(answers(asked, model).select("key", "answer", F.lit(attempt).alias("attempt"), F.coalesce(is_valid, F.lit(False)).alias("valid")))
        final = got if attempt == attempts else got.where("valid")
        done = final if done is None else done.unionByName(final)
        waiting = prompts.join(got.where("not valid").select("key"), "key", "left_semi")
    return done


def dialogues(plans: DataFrame, model: Model, recent: int = 8) -> DataFrame:
    """Turns of each scenario, one after the other: plans(scenario, session, turn_count, first, second, goal).

    A prompt holds the goal, the side that speaks (the first on odd turns) and the last ``recent`` turns. A
    scenario's plan is a list of sessions, so a group is small; scenarios run side by side. A turn that fails
    stays with its error and ends its scenario.
    """

    def run(plan: pd.DataFrame) -> pd.DataFrame:
        client, rows = model(), []
        for s in plan.sort_values("session").itertuples():
            for turn in range(1, int(s.turn_count) + 1):
                speaker = s.first if turn % 2 else s.second
                history = "\n".join(f"{r[5]}: {r[6]}" for r in rows[-recent:])
                said, error = call(client, f"{s.goal}\n\n{history}\n\n{speaker}:")
                rows.append((s.scenario, int(s.session), turn, f"D{s.session}:{turn}", len(rows) + 1, speaker, said, error))
                if error:
                    return pd.DataFrame(rows, columns=[c.split()[0] for c in TURN.split(", ")])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TURN.split(", ")])

    return plans.groupBy("scenario").applyInPandas(run, TURN)


def evaluated(rows: DataFrame, judge: Model) -> DataFrame:
    """(key, metric, value, comment): exact match where a question has options, else the six scores of a judge.

    ``rows``: key, question_text, answer_options, said, gold_answer, acceptable_answers.
    """
    match = items.exact_match(F.col("said"), F.col("gold_answer"), F.col("acceptable_answers"), F.col("answer_options"))
    closed = rows.select("key", F.lit("exact_match").alias("metric"), match.alias("value"), text.answer_key(F.col("said")).alias("comment")).where("value is not null")
    prompt = F.to_json(F.struct("question_text", F.col("said").alias("model_answer"), "gold_answer", "acceptable_answers"))
    verdicts = answers(rows.where("coalesce(size(answer_options), 0) <= 0").select("key", prompt.alias("prompt")), judge).select("key", text.judge_scores(F.col("answer")).alias("s"))
    names = {"core_answer_correct": "judge_core_answer_correct", "key_point_coverage": "judge_key_point_coverage", "rationale_alignment": "judge_rationale_alignment",
             "unsupported_claims": "judge_unsupported_claims", "insufficiency_handling": "judge_insufficiency_handling", "final_score": "llm_judge_final"}
    scores = F.array(*[F.struct(F.lit(metric).alias("metric"), F.col("s")[field].alias("value")) for field, metric in names.items()])
    return closed.unionByName(verdicts.select("key", F.col("s.verdict").alias("comment"), F.explode(scores).alias("m")).select("key", "m.metric", "m.value", "comment"))
