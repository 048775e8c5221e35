"""Queries that run as streams: closed sessions, beliefs and learners' whole state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import learners
from tessera.sources.adapters import attempts_of
from tessera.streaming import events
from tessera.streaming.learners import LearnerStates


def session_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps of 30 minutes that a watermark of one hour has closed."""
    return events.drained(events.closed_sessions(events.event_stream(spark, f"{sf_dir}/events.parquet")), "sessions")


def stream_bkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beliefs that the batch query folds, kept by a stream; its state is a table, as keyed state costs a call of Python for each belief."""
    states = LearnerStates(spark)
    states.run(attempts_of(events.event_stream(spark, f"{sf_dir}/events.parquet")))
    return states.states().select("user_id", "kc_id", F.round("p_known", 9).alias("p_known"), "obs_n")


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events of each user, each once, as a stream tells them."""
    stream = events.distinct_within(events.event_stream(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"])
    return events.drained(stream.select("user_id", "event_type"), "distinct")


def stream_learner_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, kc_id, p_known, obs_n, ease, interval_seconds, reps, last_quality, due): each learner's whole state, kept by a stream."""
    states = LearnerStates(spark)
    states.run(attempts_of(events.event_stream(spark, f"{sf_dir}/events.parquet")))
    rows = states.states()
    return rows.select("user_id", "kc_id", F.round("p_known", 9).alias("p_known"), "obs_n", F.round("ease", 6).alias("ease"), F.round("interval_seconds", 3).alias("interval_seconds"), "reps", "last_quality", F.round(F.col("last_us") / 1e6 + F.round("interval_seconds", 3), 3).alias("due"))


_RECORDED = f"""SELECT user_id, kc_id, p_known, obs_n, ease, interval_seconds, reps, last_quality, round(last / 1000000.0::DOUBLE + interval_seconds, 3) AS due
FROM ({learners.SQL['bkt_posterior']}) b JOIN ({learners.SQL['sm2_schedule']}) s USING (user_id, kc_id)
JOIN (SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 20 AS kc_id, epoch_us(max(ts)) AS last FROM events GROUP BY ALL) l USING (user_id, kc_id)"""

SQL = {
    "stream_learner_states": _RECORDED,
    "stream_distinct": "SELECT DISTINCT user_id, event_type FROM events",
    "session_window_events": """
WITH s AS (SELECT *, epoch_us(ts) AS us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000)::INT, 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT user_id, max(us) AS last_us, count(*) AS n_events, round(sum(value), 4) AS total FROM n GROUP BY user_id, session
HAVING max(us) + 1800000000 <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM s)""",
    "stream_bkt": learners.SQL["bkt_posterior"],
}
QUERIES = {f.__name__: f for f in (session_window_events, stream_bkt, stream_distinct, stream_learner_states)}
