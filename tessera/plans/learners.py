"""Queries over attempts and sessions: beliefs, repetitions, summaries, grading, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import learner
from tessera.sources.adapters import attempts, questions, table

_TRIES = """
a AS (SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 20 AS kc_id, least(value / 100, 1.0::DOUBLE) AS score, 1 + event_id % 5 AS confidence, event_id % 3 AS hint_ladder, ts, event_id FROM events),
t AS (SELECT *, score >= 0.7 AS correct, (CASE WHEN score < 0.3 THEN 0 WHEN score < 0.5 THEN 2 WHEN score < 0.7 THEN 3 WHEN score < 0.9 THEN greatest(3, 4 - least(2, hint_ladder)) ELSE greatest(4, 5 - least(2, hint_ladder)) END)::INT AS q,
  row_number() OVER (PARTITION BY user_id, kc_id ORDER BY ts, event_id) AS k FROM a)"""
_STEP = """CASE WHEN c THEN p * 0.9::DOUBLE / r + (1 - p * 0.9::DOUBLE / r) * 0.2::DOUBLE ELSE p * 0.1::DOUBLE / greatest(1e-9::DOUBLE, 1 - r) * 0.8::DOUBLE END"""
_BKT = f"""
WITH RECURSIVE {_TRIES}, f AS (
  SELECT user_id, kc_id, 0::BIGINT AS k, 0.1::DOUBLE AS p FROM t WHERE k = 1
  UNION ALL
  SELECT user_id, kc_id, k, {_STEP} FROM (SELECT t.user_id, t.kc_id, t.k, t.correct AS c, f.p, f.p * 0.9::DOUBLE + (1 - f.p) * 0.2::DOUBLE AS r FROM f JOIN t ON t.user_id = f.user_id AND t.kc_id = f.kc_id AND t.k = f.k + 1)
), b AS (SELECT user_id, kc_id, arg_max(p, k) AS p_known, max(k) AS obs_n FROM f GROUP BY user_id, kc_id)"""
SQL: dict[str, str] = {}


def _beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.bkt(attempts(spark, sf_dir))


def attempt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt's correctness, recall quality and calibration residual."""
    correct = F.col("score") >= learner.CORRECT
    residual = F.col("confidence") / 5.0 - correct.cast("double")
    return attempts(spark, sf_dir).select("event_id", "user_id", "kc_id", correct.alias("correct"), learner.quality(F.col("score"), F.col("hint_ladder")).alias("quality"), F.round(residual, 4).alias("residual"))


SQL["attempt_quality"] = f"WITH {_TRIES} SELECT event_id, user_id, kc_id, correct, q AS quality, round(confidence / 5.0::DOUBLE - correct::INT::DOUBLE, 4) AS residual FROM t"


def bkt_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beliefs(spark, sf_dir).withColumn("p_known", F.round("p_known", 9))


SQL["bkt_posterior"] = f"{_BKT} SELECT user_id, kc_id, round(p_known, 9) AS p_known, obs_n FROM b"


def sm2_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.sm2(attempts(spark, sf_dir)).withColumns({"ease": F.round("ease", 6), "interval_seconds": F.round("interval_seconds", 3)})


SQL["sm2_schedule"] = f"""
WITH RECURSIVE {_TRIES}, f AS (
  SELECT user_id, kc_id, 0::BIGINT AS k, 2.5::DOUBLE AS ease, 0.0::DOUBLE AS secs, 0 AS reps, 0 AS q FROM t WHERE k = 1
  UNION ALL
  SELECT user_id, kc_id, k, e, greatest(3600.0::DOUBLE, CASE WHEN q < 3 THEN 3600.0::DOUBLE WHEN n = 1 THEN 86400.0::DOUBLE WHEN n = 2 THEN 518400.0::DOUBLE WHEN n = 3 THEN least(greatest(secs, 1.0::DOUBLE) * e, 1209600.0::DOUBLE) ELSE greatest(secs, 1.0::DOUBLE) * e END), n, q
  FROM (SELECT t.user_id, t.kc_id, t.k, t.q, f.secs, greatest(1.3::DOUBLE, f.ease + (0.1::DOUBLE - (5 - t.q) * (0.08::DOUBLE + (5 - t.q) * 0.02::DOUBLE))) AS e, CASE WHEN t.q < 3 THEN 0 ELSE f.reps + 1 END AS n
    FROM f JOIN t ON t.user_id = f.user_id AND t.kc_id = f.kc_id AND t.k = f.k + 1)
)
SELECT user_id, kc_id, round(arg_max(ease, k), 6) AS ease, round(arg_max(secs, k), 3) AS interval_seconds, arg_max(reps, k) AS reps, arg_max(q, k) AS last_quality FROM f GROUP BY user_id, kc_id"""


def weak_kcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.ranked_components(_beliefs(spark, sf_dir).withColumn("p_known", F.round("p_known", 9)), True, 10)


def mastered_kcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.ranked_components(_beliefs(spark, sf_dir).withColumn("p_known", F.round("p_known", 9)), False, 20)


_RANKED = _BKT + """ SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(p_known, 9) {0}, kc_id)::INT AS rank, kc_id, round(p_known, 9) AS p_known FROM b WHERE round(p_known, 9) {1}) WHERE rank <= {2}"""
SQL["weak_kcs"] = _RANKED.replace("{0}", "").replace("{1}", "< 0.5").replace("{2}", "10")
SQL["mastered_kcs"] = _RANKED.replace("{0}", "DESC").replace("{1}", ">= 0.85").replace("{2}", "20")


def learner_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.learner_state(_beliefs(spark, sf_dir))


SQL["learner_state"] = f"{_BKT} SELECT user_id, round(avg(p_known), 4) AS p_known_avg, count(*) AS n_kcs_tracked, count(*) FILTER (p_known >= 0.85) AS n_kcs_mastered, sum(obs_n)::BIGINT AS n_attempts FROM b GROUP BY user_id"


def overconfidence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.overconfidence(attempts(spark, sf_dir))


SQL["overconfidence_gap"] = f"""
WITH {_TRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS m FROM t)
SELECT user_id, round(avg((confidence - 1) / 4.0::DOUBLE - correct::INT::DOUBLE), 4) AS gap FROM n WHERE m <= 200 GROUP BY user_id"""


def latest_by_key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type, as an append log is read like an upserted table."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e")).select("user_id", "event_type", "e.event_id", "e.value")


SQL["latest_by_key_upsert"] = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 500 events after a cursor."""
    return table(spark, sf_dir, "events").where("event_id > 100").orderBy("event_id").limit(500).select("event_id", "user_id", "event_type", "value")


SQL["event_replay"] = "SELECT event_id, user_id, event_type, value FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500"


def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 events."""
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type", "value")


SQL["event_tail"] = "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 50"


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with gaps of under 30 minutes."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    mine = Window.partitionBy("user_id").orderBy("at", "event_id")
    steps = events.select("user_id", "event_id", "value", at.alias("at")).withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(mine) >= 1_800_000_000).cast("int"), F.lit(1)))
    return steps.withColumn("session", F.sum("new").over(mine)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))


SQL["event_sessions"] = """
WITH s AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000)::INT, 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, (sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM s)
SELECT user_id, session, count(*) AS n_events, round(sum(value), 4) AS total FROM n GROUP BY user_id, session"""

_Q = "q AS (SELECT l_orderkey AS session_id, l_linenumber AS number, l_partkey AS part, least(l_discount * 10, 1.0::DOUBLE) AS score, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's questions, wrong ones (under half of the score) and total score."""
    return questions(spark, sf_dir).groupBy("session_id", "status", "day").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("score") < 0.5).alias("wrong_count"), F.round(F.sum("score"), 2).alias("score"))


SQL["session_summary"] = f"WITH {_Q} SELECT session_id, status, day, count(*) AS n_questions, count(*) FILTER (score < 0.5) AS wrong_count, round(sum(score), 2) AS score FROM q GROUP BY ALL"


def wrong_question_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by how many wrong questions they have."""
    return questions(spark, sf_dir).where("score < 0.5").groupBy("part").agg(F.count(F.lit(1)).alias("n_wrong"), F.min("score").alias("worst"))


SQL["wrong_question_groups"] = f"WITH {_Q} SELECT part, count(*) AS n_wrong, min(score) AS worst FROM q WHERE score < 0.5 GROUP BY part"


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 parts with fewest questions of those that were asked about."""
    return questions(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("n_questions")).orderBy("n_questions", "part").limit(30)


SQL["coverage_counts"] = f"WITH {_Q} SELECT part, count(*) AS n_questions FROM q GROUP BY part ORDER BY n_questions, part LIMIT 30"

QUERIES = {f.__name__: f for f in (attempt_quality, bkt_posterior, sm2_schedule, weak_kcs, mastered_kcs, learner_state, overconfidence_gap, latest_by_key_upsert, event_replay, event_tail, event_sessions, session_summary, wrong_question_groups, coverage_counts)}
