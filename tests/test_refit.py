"""Refits: a learner's history is weighed where it is, whatever its length."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import learner


def test_refit_makes_no_row_for_a_cell(spark):
    """Attempts are not multiplied by the cells of the grids, and few, null and absent learners keep what they had."""
    rows = [(1, k, k, 1.0 if k > 3 else 0.0) for k in range(30)] + [(2, k, 100 + k, 1.0) for k in range(4)] + [(None, 1, 200, 0.1), (3, 1, 300, None)]
    tries = spark.createDataFrame(rows, "user_id long, ts long, event_id long, score double")
    found = learner.refit(tries)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    got = {r["user_id"]: tuple(r)[1:] for r in found.collect()}
    assert got[2] == (4, 0.1, 0.2, 0.2, 0.1) and got[None] == (1, 0.1, 0.2, 0.2, 0.1) and got[3] == (1, 0.1, 0.2, 0.2, 0.1)
    assert got[1][0] == 30 and got[1][2] >= 0.05


def test_long_histories_are_summed_in_pieces(spark, monkeypatch):
    tries = spark.range(500).select(F.lit(1).alias("user_id"), F.col("id").alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 3 / 2.0).alias("score"))
    whole = [tuple(r) for r in learner.refit(tries).collect()]
    correct = [bool(r["score"] >= learner.CORRECT) for r in tries.orderBy("ts").collect()]
    monkeypatch.setattr(learner, "CELLS", 343 * 7)
    assert [tuple(r)[1:] for r in learner.refit(tries).collect()] == [r[1:] for r in whole]
    assert learner._fitted(learner.np.array(correct), 5) == whole[0][1:]
