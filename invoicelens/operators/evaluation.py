"""Scores for recorded answers, and transcript windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def answer_score(text: Column, tool_calls: Column, truth: Column) -> Column:
    """1 without a ground truth; else 1 less 0.5, 0.25 and 0.25 for what is wrong, 0 at least.

    Wrong are: the expected tool was not called, the expected phrase is missing, a forbidden
    word occurs. Empty expectations are not checked.
    """
    answer = F.coalesce(text, F.lit(""))
    tool, phrase, words = (truth[f] for f in ("should_call_tool", "expected_answer_contains", "forbidden_words"))
    # Cost of one check: ``failed`` counts only when it is true, never when unknown.
    def cost(failed: Column, weight: float) -> Column:
        return F.when(F.coalesce(failed, F.lit(False)), weight).otherwise(0.0)

    not_called = (tool != "") & ~F.coalesce(F.array_contains(tool_calls, tool), F.lit(False))
    not_said = (phrase != "") & ~F.contains(answer, phrase)
    forbidden = F.exists(words, lambda w: F.contains(answer, w))
    lost = cost(not_called, 0.5) + cost(not_said, 0.25) + cost(forbidden, 0.25)
    return F.when(truth.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - lost))


def score_runs(runs: DataFrame) -> DataFrame:
    score = answer_score(F.col("output_text"), F.col("tool_calls"), F.col("ground_truth"))
    return runs.withColumn("score", score)


def run_summary(runs: DataFrame, succeeded: str = "succeeded") -> DataFrame:
    total, good = F.count(F.lit(1)), F.count(F.when(F.col(succeeded), 1))
    return runs.agg(good.alias("exitosos"), (total - good).alias("fallidos"), total.alias("total"))


def last_messages(messages: DataFrame, last: int = 15) -> DataFrame:
    """The last turns of each conversation.

    The rank filter is applied before the shuffle too, so one long conversation sends at most
    ``last`` rows per task.
    """
    newest_first = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_rn", F.row_number().over(newest_first)).filter(F.col("_rn") <= last).drop("_rn")
