import pytest

from invoicelens.operators import evaluation
from invoicelens.schema import ground_truth_type

CASES = [
    ("texto", [], None, 1.0),
    ("No se registran movimientos", ["getProfitabilityAnalysis"],
     ("getProfitabilityAnalysis", "No se registran movimientos", ["$78.512", "69,8%"]), 1.0),
    ("Vendimos $78.512", [], ("getProfitabilityAnalysis", "No se registran movimientos", ["$78.512", "69,8%"]), 0.0),
    ("hola", ["otro"], ("getProfitabilityAnalysis", None, None), 0.5),
    (None, None, ("", "algo", []), 0.75),
    ("mal", ["t"], ("t", "", ["mal"]), 0.75),
    ("hola", None, ("t", None, [None]), 0.5),
]


@pytest.mark.parametrize("text, calls, truth, score", CASES)
def test_score(spark, text, calls, truth, score):
    schema = "output_text string, tool_calls array<string>, ground_truth " + ground_truth_type().simpleString()
    only = evaluation.score_runs(spark.createDataFrame([(text, calls, truth)], schema)).first()
    assert only["score"] == score


def test_summary(spark):
    runs = spark.createDataFrame([(True,), (False,), (None,)], "succeeded boolean")
    assert tuple(evaluation.run_summary(runs).first()) == (1, 2, 3)


def test_last_messages_of_a_long_conversation(spark):
    talk = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) conv_id", "id turn", "'user' role", "'x' text")
    kept = [r["turn"] for r in evaluation.last_messages(talk).filter("conv_id = 0").collect()]
    assert sorted(kept) == [999 - 3 * i for i in reversed(range(15))]
    plan = evaluation.last_messages(talk)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
