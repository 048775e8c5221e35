"""Queries that join beliefs with the prerequisite graph, the queue of repetitions, and changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import learner
from tessera.plans import graphs, learners
from tessera.sources import adapters
from tessera.sources.adapters import attempts, table

#: Beliefs of a mastered source and of a target still to be learned; windows for each learner.
FROM_LEAST, TO_MOST, WINDOWS = 0.85, 0.3, 10
_K = f"{graphs._E}, k AS (SELECT DISTINCT source % 20 AS source, target % 20 AS target FROM e WHERE source % 20 <> target % 20)"
_B = f"{learners._BKT}, {_K}, r AS (SELECT user_id, kc_id, round(p_known, 9) AS p FROM b)"
SQL: dict[str, str] = {}


def _beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.bkt(attempts(spark, sf_dir)).select("user_id", "kc_id", F.round("p_known", 9).alias("p"))


def _component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): edges between knowledge components, which parts are dealt to by their key."""
    edges = adapters.prerequisite_edges(spark, sf_dir).select((F.col("source") % 20).alias("source"), (F.col("target") % 20).alias("target"))
    return edges.where("source <> target").distinct()


def transfer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's mastered components beside begun but weak ones, whichever way an edge joins them; ten at most."""
    known, edges = _beliefs(spark, sf_dir), _component_edges(spark, sf_dir)
    both = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    strong = known.where(F.col("p") >= FROM_LEAST).select("user_id", F.col("kc_id").alias("source"), F.col("p").alias("p_source"))
    weak = known.where((F.col("p") > 0) & (F.col("p") < TO_MOST)).select("user_id", F.col("kc_id").alias("target"), F.col("p").alias("p_target"))
    found = strong.join(both, "source").join(weak, ["user_id", "target"])
    order = Window.partitionBy("user_id").orderBy(F.desc("p_source"), "p_target", "source", "target")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= WINDOWS).select("user_id", "rank", "source", "target", "p_source", "p_target")


SQL["transfer_windows"] = f"""{_B}, e2 AS (SELECT source, target FROM k UNION SELECT target, source FROM k)
SELECT * FROM (SELECT x.user_id, row_number() OVER (PARTITION BY x.user_id ORDER BY x.p DESC, y.p, source, target)::INT AS rank, source, target, x.p AS p_source, y.p AS p_target
  FROM r x JOIN e2 ON x.kc_id = source JOIN r y ON y.user_id = x.user_id AND y.kc_id = target WHERE x.p >= 0.85 AND y.p > 0 AND y.p < 0.3) WHERE rank <= 10"""


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, target, mean, ready) where a learner has tried a prerequisite of the target.

    The mean counts prerequisites not tried as 0; ready is 0 with any of those, else the least belief as a share of mastery.
    """
    edges = _component_edges(spark, sf_dir)
    needs = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    seen = _beliefs(spark, sf_dir).join(edges, F.col("kc_id") == F.col("source")).groupBy("user_id", "target").agg(F.count(F.lit(1)).alias("seen"), F.sum("p").alias("total"), F.min("p").alias("least"))
    ready = F.when(F.col("seen") < F.col("n"), 0.0).otherwise(F.least(F.lit(1.0), F.col("least") / learner.MASTERED))
    return seen.join(needs, "target").select("user_id", "target", F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round(ready, 6).alias("ready"))


SQL["readiness"] = f"""{_B}, n AS (SELECT target, count(*) AS n FROM k GROUP BY target)
SELECT user_id, k.target, round(sum(p) / any_value(n), 6) AS mean, round(CASE WHEN count(*) < any_value(n) THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, min(p) / 0.85::DOUBLE) END, 6) AS ready
FROM r JOIN k ON kc_id = source JOIN n ON n.target = k.target GROUP BY user_id, k.target"""


def sm2_due_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's 100 repetitions due first, within a day of the newest attempt of all."""
    tries = attempts(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    last = tries.groupBy("user_id", "kc_id").agg(F.max(at).alias("last"))
    now = tries.agg((F.max(at) + 86_400_000_000).alias("until"))  # one row, hence broadcast
    due = (F.col("last") / 1e6 + F.col("interval_seconds")).alias("due")
    queue = learner.sm2(tries).join(last, ["user_id", "kc_id"]).select("user_id", "kc_id", "reps", F.round(due, 3).alias("due"))
    first = Window.partitionBy("user_id").orderBy("due", "kc_id")
    near = queue.join(F.broadcast(now), F.col("due") <= F.col("until") / 1e6).drop("until")
    return near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= 100).drop("k")


SQL["sm2_due_queue"] = learners.SQL["sm2_schedule"].replace("SELECT user_id, kc_id, round(arg_max(ease, k), 6)", "SELECT * FROM (SELECT f.user_id, f.kc_id, arg_max(reps, k) AS reps, round(any_value(last) / 1000000.0::DOUBLE + arg_max(secs, k), 3) AS due FROM f JOIN (SELECT user_id, kc_id, max(epoch_us(ts)) AS last FROM a GROUP BY ALL) l ON l.user_id = f.user_id AND l.kc_id = f.kc_id GROUP BY f.user_id, f.kc_id) WHERE due <= (SELECT max(epoch_us(ts)) + 86400000000 FROM a) / 1000000.0::DOUBLE QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY due, kc_id) <= 100 --").split(" --")[0]


def cross_type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts of different types."""
    parts = table(spark, sf_dir, "part")
    ends = [parts.select(F.col("p_partkey").alias(c), F.col("p_type").alias(f"{c}_type")) for c in ("source", "target")]
    return adapters.prerequisite_edges(spark, sf_dir).join(ends[0], "source").join(ends[1], "target").where("source_type <> target_type").select("source", "target", "weight", "source_type", "target_type")


SQL["cross_type_edges"] = f"WITH {graphs._E} SELECT source, target, weight, x.p_type AS source_type, y.p_type AS target_type FROM e JOIN part x ON x.p_partkey = source JOIN part y ON y.p_partkey = target WHERE x.p_type <> y.p_type"


def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(community, member_count, internal, cohesion): brands as communities; linked pairs inside by all pairs possible."""
    parts = table(spark, sf_dir, "part")
    ends = [parts.select(F.col("p_partkey").alias(c), F.col("p_brand").alias(f"{c}_in")) for c in ("a", "b")]
    pairs = adapters.prerequisite_edges(spark, sf_dir).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inside = pairs.join(ends[0], "a").join(ends[1], "b").where("a_in = b_in").groupBy(F.col("a_in").alias("community")).agg(F.count(F.lit(1)).alias("internal"))
    members = parts.groupBy(F.col("p_brand").alias("community")).agg(F.count(F.lit(1)).alias("member_count"))
    linked, all_pairs = F.coalesce("internal", F.lit(0)).cast("long"), F.col("member_count") * (F.col("member_count") - 1) / 2
    return members.join(inside, "community", "left").select("community", "member_count", linked.alias("internal"), F.round(F.when(F.col("member_count") > 1, linked / all_pairs).otherwise(0.0), 6).alias("cohesion"))


SQL["cohesion"] = f"""WITH {graphs._E}, i AS (SELECT x.p_brand AS community, count(*) AS internal FROM u JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE a < b AND x.p_brand = y.p_brand GROUP BY 1)
SELECT p_brand AS community, count(*) AS member_count, coalesce(any_value(internal), 0) AS internal, round(CASE WHEN count(*) > 1 THEN coalesce(any_value(internal), 0) / (count(*) * (count(*) - 1) / 2.0::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS cohesion
FROM part LEFT JOIN i ON community = p_brand GROUP BY p_brand"""


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """(keys, change) where ``mark`` tells the versions apart: added, updated or removed."""
    both = old.select(*keys, F.col(mark).alias("was"), F.lit(True).alias("in_old")).join(new.select(*keys, F.col(mark).alias("now"), F.lit(True).alias("in_new")), keys, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "updated")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change")


def diff_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What purchases changed in each user's newest state: all events against those that are no purchases."""
    events = table(spark, sf_dir, "events")
    newest = lambda rows: rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return reconcile(newest(events.where("event_type <> 'purchase'")), newest(events), ["user_id"], "event_id")


SQL["diff_reconcile"] = """
WITH o AS (SELECT user_id, event_id FROM events WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, CASE WHEN o.event_id IS NULL THEN 'added' WHEN n.event_id IS NULL THEN 'removed' ELSE 'updated' END AS change FROM o FULL JOIN n USING (user_id) WHERE o.event_id IS DISTINCT FROM n.event_id"""

QUERIES = {f.__name__: f for f in (transfer_windows, readiness, sm2_due_queue, cross_type_edges, cohesion, diff_reconcile)}
