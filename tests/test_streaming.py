"""Streams that go on where they stopped, and snapshots compared."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import learner
from tessera.operators.shared import shared_folder
from tessera.plans import streams
from tessera.plans.readiness import reconcile
from tessera.sources.adapters import attempts, attempts_of, table
from tessera.streaming import events
from tessera.streaming.learners import LearnerStates

SF = "/root/testdata/sf0.001"


def test_beliefs_go_on_after_a_stop(spark, tmp_path):
    source, rows = f"{tmp_path}/in", table(spark, SF, "events")
    cut = rows.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    for part in (F.col("ts") <= F.lit(cut), F.col("ts") > F.lit(cut)):
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
        changes = events.drained(events.beliefs(attempts_of(events.event_stream(spark, source))), "beliefs", f"{tmp_path}/out")
    got = {(r["user_id"], r["kc_id"]): (r["p_known"], r["obs_n"]) for r in events.newest_beliefs(changes).collect()}
    want = {(r["user_id"], r["kc_id"]): (r["p_known"], r["obs_n"]) for r in learner.bkt(attempts(spark, SF)).collect()}
    assert got.keys() == want.keys()
    for key, (p, n) in want.items():
        assert got[key] == (pytest.approx(p, abs=1e-9), n)


def test_reconcile(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "id long, hash string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (5, None)], "id long, hash string")
    assert {tuple(r) for r in reconcile(old, new, ["id"], "hash").collect()} == {(2, "updated"), (4, "removed"), (5, "added")}


def test_learner_states_go_on_after_stops_with_late_rows(spark, tmp_path):
    """Three runs; rows come up to 50 minutes after later ones, and are folded in their order all the same."""
    source, rows = f"{tmp_path}/in", table(spark, SF, "events")
    comes = F.col("ts").cast("timestamp").cast("double") + F.pmod(F.xxhash64("event_id"), F.lit(3000))
    cuts = rows.select(comes.alias("x")).agg(F.percentile_approx("x", [0.3, 0.7])).first()[0]
    states = LearnerStates(spark, f"{tmp_path}/out")
    for part in (comes <= cuts[0], (comes > cuts[0]) & (comes <= cuts[1]), comes > cuts[1]):
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
        states.run(attempts_of(events.event_stream(spark, source)))
    want = {tuple(r[:2]): r.asDict() for r in learner.recorded(attempts(spark, SF)).collect()}
    got = {tuple(r[:2]): r.asDict() for r in states.states().collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in row.items()}
    # each repetition that has come due is told once
    told = [tuple(r)[:3] for r in states.notices().collect()]
    assert len(told) == len(set(told)) > 0
    mark = max(r["mark"] for r in spark.read.parquet(f"{tmp_path}/out/mark/batch-2").collect())
    held = {(r["user_id"], r["kc_id"], r["due_us"]) for r in states.states(flush=False).collect()}
    assert {h for h in held if h[2] <= mark} <= set(told)
    # a batch that is done again leaves the same
    once = sorted(map(tuple, states.states().collect()))
    batch = attempts_of(rows.where(comes > cuts[1]).withColumn("ts", F.col("ts").cast("timestamp")))
    states.take(batch, 2)
    assert sorted(map(tuple, states.states().collect())) == once


def test_stream_of_beliefs_keeps_no_state_by_key_in_python(spark, tmp_path):
    """The query's state is a table: a key costs rows, not a call of Python. Components that are null are one of their own."""
    rows = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 37 % 100).cast("double").alias("value"), F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"k": '), (F.col("id") % 5).cast("string"), F.lit("}"))).alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    top = Path(shared_folder(spark).removeprefix("file:"))
    before = set(top.glob("*/progress/state"))
    got = {(r["user_id"], r["kc_id"]): r["obs_n"] for r in streams.stream_bkt(spark, str(tmp_path)).collect()}
    want = {(r["user_id"], r["kc_id"]): r["n"] for r in attempts(spark, str(tmp_path)).groupBy("user_id", "kc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and (0, None) in got
    assert set(top.glob("*/progress/state")) == before
