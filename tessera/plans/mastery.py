"""Queries over a learner's whole state: misconceptions, states of components, timelines, refits, the eight dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import errors
from tessera.operators import learner
from tessera.plans import learners, readiness
from tessera.sources import adapters
from tessera.sources.adapters import answers, attempts, table


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_HELD = lambda text, words: "(" + " + ".join(f"contains(lower({text}), '{w}')::INT" for w in words) + ")"
_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {_HELD('response', w)} > {_HELD('expected', w)} THEN '{t}' END" for t, w in errors.GROUPS.items()) + "], lambda t: t IS NOT NULL)"
_ANSWERS = f"""
w AS (SELECT event_id, user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 20 AS kc_id, ts,
  [{_quoted(adapters.RESPONSES)}][event_id % {len(adapters.RESPONSES)} + 1] AS response, [{_quoted(adapters.EXPECTED)}][event_id % {len(adapters.EXPECTED)} + 1] AS expected FROM events),
m AS (SELECT *, CASE WHEN response <> '' AND expected <> '' AND trim(response) <> trim(expected) THEN {_TAGS} ELSE [] END AS tags FROM w),
x AS (SELECT event_id, user_id, kc_id, substring(response, 1, 200) AS response, substring(expected, 1, 200) AS expected, unnest(tags) AS tag FROM m)"""
SQL: dict[str, str] = {}


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).withColumn("tags", errors.misconceptions(F.col("response"), F.col("expected")))


def misconception_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of each answer, joined by commas."""
    return _tagged(spark, sf_dir).select("event_id", F.array_join("tags", ",").alias("tags"))


SQL["misconception_tags"] = f"WITH {_ANSWERS} SELECT event_id, array_to_string(tags, ',') AS tags FROM m"


def misconception_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each tag of each answer, with the texts' first 200 characters."""
    cut = [F.substring(c, 1, 200).alias(c) for c in ("response", "expected")]
    return _tagged(spark, sf_dir).select("event_id", "user_id", "kc_id", *cut, F.explode("tags").alias("tag"))


SQL["misconception_traces"] = f"WITH {_ANSWERS} SELECT event_id, user_id, kc_id, response, expected, tag FROM x"


def misconception_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's ten most frequent tags; ties by tag."""
    counts = misconception_traces(spark, sf_dir).groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("user_id").orderBy(F.desc("n"), "tag")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 10).select("user_id", "rank", "tag", F.replace("tag", F.lit("_"), F.lit(" ")).alias("label"), "n")


SQL["misconception_clusters"] = f"""WITH {_ANSWERS}
SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, tag)::INT AS rank, tag, replace(tag, '_', ' ') AS label, count(*) AS n FROM x GROUP BY user_id, tag) WHERE rank <= 10"""


def misconception_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag stands, with its first three responses by event, 80 characters each.

    Each task keeps three rows of a tag before they meet.
    """
    traces = misconception_traces(spark, sf_dir)
    first = Window.partitionBy("tag").orderBy("event_id")
    examples = traces.withColumn("k", F.row_number().over(first)).where(F.col("k") <= 3).groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("k", F.substring("response", 1, 80).alias("r")))).alias("e"))
    return traces.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).join(examples, "tag").select("tag", "n", F.array_join(F.transform("e", lambda x: x["r"]), " | ").alias("examples"))


SQL["misconception_examples"] = f"""WITH {_ANSWERS}, k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY event_id) AS k FROM x)
SELECT tag, count(*) AS n, string_agg(substring(response, 1, 80), ' | ' ORDER BY event_id) FILTER (k <= 3) AS examples FROM k GROUP BY tag"""


def top_misconception(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's most frequent tag; of those even, the one met first."""
    counts = misconception_traces(spark, sf_dir).groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("since"))
    return counts.groupBy("user_id").agg(F.max_by("tag", F.struct("n", -F.col("since"), "tag")).alias("tag"))


SQL["top_misconception"] = f"WITH {_ANSWERS}, c AS (SELECT user_id, tag, count(*) AS n, min(event_id) AS since FROM x GROUP BY user_id, tag) SELECT user_id, tag FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, since, tag DESC) = 1"


def component_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine of each learner and component: views expose, all other events are attempts."""
    tries = attempts(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return learner.states(tries.where("event_type = 'view'"), tries.where("event_type <> 'view'"))


SQL["component_states"] = f"""WITH {learners._TRIES}, y AS (SELECT a.*, e.event_type = 'view' AS shown FROM a JOIN events e USING (event_id)),
g AS (SELECT user_id, kc_id, arg_max(score, (ts, event_id)) FILTER (NOT shown) AS score, epoch_us(max(ts)) AS last_seen FROM y GROUP BY user_id, kc_id)
SELECT user_id, kc_id, CASE WHEN score >= 0.85 THEN 'mastered' WHEN score >= 0.5 THEN 'partial' WHEN score IS NOT NULL THEN 'attempted' ELSE 'exposed' END AS state,
  coalesce(score, 0.0::DOUBLE) AS score, (score IS NOT NULL)::INT AS attempts, coalesce(score >= 0.7, false)::INT AS successes, last_seen FROM g"""


def bkt_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.timeline(attempts(spark, sf_dir)).withColumn("p_known", F.round("p_known", 9))


SQL["bkt_timeline"] = f"{learners._BKT} SELECT f.user_id, f.kc_id, t.event_id, f.k, round(f.p, 9) AS p_known FROM f JOIN t ON t.user_id = f.user_id AND t.kc_id = f.kc_id AND t.k = f.k"


def bkt_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.refit(attempts(spark, sf_dir))


_LL = "round(sum(ln(CASE WHEN c THEN (1 - (1 - {p}) * pow(1 - pt, k)) * (1 - ps) + (1 - {p}) * pow(1 - pt, k) * pg ELSE (1 - (1 - {p}) * pow(1 - pt, k)) * ps + (1 - {p}) * pow(1 - pt, k) * (1 - pg) END)), 9)"
_NEAR = "list_transform([-2, -1, 0, 1, 2], lambda d: round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, {c} + d * {r}::DOUBLE)), 4))"
_ROUND = """
c{n} AS (SELECT h.*, pt, pg, unnest({ps}) AS ps FROM (SELECT h.*, pt, unnest({pg}) AS pg {keep} FROM (SELECT h.*, unnest({pt}) AS pt {keep} FROM h {join}) h) h),
g{n} AS (SELECT user_id, pt, pg, ps, {ll} AS ll FROM c{n} GROUP BY user_id, pt, pg, ps),
t{n} AS (SELECT * FROM g{n} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ll DESC, pt, pg, ps) = 1)"""


def _refit_sql() -> str:
    grid = "[" + ", ".join(f"{x}::DOUBLE" for x in learner.GRID) + "]"
    ll = _LL.replace("{p}", "p")
    parts = [f"""{learners._TRIES}, z AS (SELECT user_id, correct AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM t),
u AS (SELECT user_id, count(*) AS observations, max(CASE WHEN k = 0 AND c THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END) AS p FROM z GROUP BY user_id),
h AS (SELECT z.*, u.p FROM z JOIN u USING (user_id) WHERE observations >= 5)"""]
    parts.append(_ROUND.format(n=0, pt=grid, pg=grid, ps=grid, keep="", join="", ll=ll) + ", b0 AS (SELECT * FROM t0)")
    for n, reach in enumerate(learner.REACH, 1):
        near = {c: _NEAR.format(c=f"{c}0", r=reach) for c in ("pt", "pg", "ps")}
        known = f"JOIN (SELECT user_id AS who, pt AS pt0, pg AS pg0, ps AS ps0 FROM b{n - 1}) o ON o.who = h.user_id"
        inner = _ROUND.format(n=n, ll=ll, keep="", join=known, **near).replace("SELECT h.*, unnest(list_transform([-2, -1, 0, 1, 2], lambda d: round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, pt0", "SELECT h.*, o.*, unnest(list_transform([-2, -1, 0, 1, 2], lambda d: round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, pt0")
        parts.append(inner + f", b{n} AS (SELECT t.user_id, unnest(CASE WHEN t.ll > b.ll THEN {{'pt': t.pt, 'pg': t.pg, 'ps': t.ps, 'll': t.ll}} ELSE {{'pt': b.pt, 'pg': b.pg, 'ps': b.ps, 'll': b.ll}} END) FROM t{n} t JOIN b{n - 1} b USING (user_id))")
    last = len(learner.REACH)
    first = ", ".join(f"{{'i': {i}, 'p0': {x}::DOUBLE}}" for i, x in enumerate(learner.FIRST))
    parts.append(f"""q AS (SELECT h.user_id, h.c, h.k, b.pt, b.pg, b.ps, unnest([{{'i': -1, 'p0': h.p}}, {first}]) AS s FROM h JOIN b{last} b USING (user_id)),
r AS (SELECT user_id, pt, pg, ps, s.i AS i, s.p0 AS p0, {_LL.replace("{p}", "s.p0")} AS ll FROM q GROUP BY user_id, pt, pg, ps, s),
w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ll DESC, i) = 1)""")
    clamp = "coalesce(round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, {0})), 4), {1}::DOUBLE) AS {2}"
    made = ", ".join(clamp.format(c, d, n) for n, c, d in (("p_known", "p0", 0.1), ("p_t", "pt", 0.2), ("p_g", "pg", 0.2), ("p_s", "ps", 0.1)))
    return f"WITH {', '.join(parts)} SELECT u.user_id, observations, {made} FROM u LEFT JOIN w USING (user_id)"


SQL["bkt_refit"] = _refit_sql()


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.sm2_due_queue(spark, sf_dir)


def decay_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, decay_risk): of a learner's queued repetitions with three or more behind them, the share due within two weeks."""
    now = attempts(spark, sf_dir).agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("now"))  # one row
    mature = _due(spark, sf_dir).where("reps >= 3").join(F.broadcast(now))
    return mature.groupBy("user_id").agg(F.round(F.count_if(F.col("due") <= F.col("now") + 14 * learner.DAY) / F.count(F.lit(1)), 4).alias("decay_risk"))


SQL["decay_risk"] = f"WITH d AS ({readiness.SQL['sm2_due_queue']}) SELECT user_id, round(count(*) FILTER (due <= (SELECT epoch_us(max(ts)) / 1000000.0::DOUBLE FROM events) + 1209600) / count(*)::DOUBLE, 4) AS decay_risk FROM d WHERE reps >= 3 GROUP BY user_id"


def readiness_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, readiness): the share of targets all of whose tried prerequisites are believed in, of those with any tried."""
    seen = readiness._beliefs(spark, sf_dir).join(readiness._component_edges(spark, sf_dir), F.col("kc_id") == F.col("source"))
    ready = seen.groupBy("user_id", "target").agg(F.min("p").alias("least"))
    return ready.groupBy("user_id").agg(F.round(F.avg((F.col("least") >= READY).cast("double")), 4).alias("readiness"))


#: Fixed value: prerequisites believed in from here on.
READY = 0.85
SQL["readiness_mean"] = f"{readiness._B}, y AS (SELECT user_id, target, min(p) AS least FROM r JOIN k ON kc_id = source GROUP BY user_id, target) SELECT user_id, round(avg((least >= {READY}::DOUBLE)::INT::DOUBLE), 4) AS readiness FROM y GROUP BY user_id"


def learner_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight dimensions of each learner's state in one row, lists as joined keys."""
    listed = lambda rows, name, key, order: rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(key).cast("string").alias("k")))), lambda x: x["k"]), ",").alias(name))
    base = learner.learner_state(learner.bkt(attempts(spark, sf_dir)))
    parts = [
        listed(learners.weak_kcs(spark, sf_dir), "weak", "kc_id", "rank"),
        listed(learners.mastered_kcs(spark, sf_dir), "mastered", "kc_id", "rank"),
        listed(misconception_clusters(spark, sf_dir), "misconceptions", "tag", "rank"),
        readiness.transfer_windows(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_windows")),
        learners.overconfidence_gap(spark, sf_dir),
        readiness_mean(spark, sf_dir),
        _due(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("sr_due_today")),
        decay_risk(spark, sf_dir),
    ]
    for part in parts:
        base = base.join(part, "user_id", "left")
    text, whole, real = ["weak", "mastered", "misconceptions"], ["n_windows", "sr_due_today"], ["gap", "readiness", "decay_risk"]
    return base.fillna("", text).fillna(0, whole).fillna(0.0, real)


SQL["learner_dimensions"] = f"""
WITH s AS ({learners.SQL['learner_state']}), w AS ({learners.SQL['weak_kcs']}), m AS ({learners.SQL['mastered_kcs']}), c AS ({SQL['misconception_clusters']}),
t AS ({readiness.SQL['transfer_windows']}), g AS ({learners.SQL['overconfidence_gap']}), r AS ({SQL['readiness_mean']}), d AS ({readiness.SQL['sm2_due_queue']}), k AS ({SQL['decay_risk']})
SELECT s.*, coalesce(weak, '') AS weak, coalesce(mastered, '') AS mastered, coalesce(misconceptions, '') AS misconceptions, coalesce(n_windows, 0) AS n_windows, coalesce(gap, 0.0::DOUBLE) AS gap,
  coalesce(readiness, 0.0::DOUBLE) AS readiness, coalesce(sr_due_today, 0) AS sr_due_today, coalesce(decay_risk, 0.0::DOUBLE) AS decay_risk
FROM s LEFT JOIN (SELECT user_id, string_agg(kc_id::VARCHAR, ',' ORDER BY rank) AS weak FROM w GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, string_agg(kc_id::VARCHAR, ',' ORDER BY rank) AS mastered FROM m GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, string_agg(tag, ',' ORDER BY rank) AS misconceptions FROM c GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n_windows FROM t GROUP BY user_id) USING (user_id) LEFT JOIN g USING (user_id) LEFT JOIN r USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS sr_due_today FROM d GROUP BY user_id) USING (user_id) LEFT JOIN k USING (user_id)"""


def recorded_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Belief, schedule and state of each learner and component from one pass over the attempts."""
    rows = learner.recorded(attempts(spark, sf_dir))
    return rows.select("user_id", "kc_id", F.round("p_known", 9).alias("p_known"), "obs_n", F.round("ease", 6).alias("ease"), F.round("interval_seconds", 3).alias("interval_seconds"), "reps", "last_quality", learner.attempt_state(F.col("score")).alias("state"))


SQL["recorded_attempts"] = f"""SELECT user_id, kc_id, p_known, obs_n, ease, interval_seconds, reps, last_quality, CASE WHEN score >= 0.85 THEN 'mastered' WHEN score >= 0.5 THEN 'partial' ELSE 'attempted' END AS state
FROM ({learners.SQL['bkt_posterior']}) b JOIN ({learners.SQL['sm2_schedule']}) s USING (user_id, kc_id) JOIN (WITH {learners._TRIES} SELECT user_id, kc_id, arg_max(score, (ts, event_id)) AS score FROM a GROUP BY ALL) l USING (user_id, kc_id)"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's 20 repetitions due first, with the component's name, or its key where it has none."""
    first = Window.partitionBy("user_id").orderBy("due", "kc_id")
    queue = _due(spark, sf_dir).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= 20)
    names = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("kc_id"), F.col("p_name").alias("name"))
    return queue.join(names, "kc_id", "left").select("user_id", "rank", "kc_id", "due", F.coalesce("name", F.col("kc_id").cast("string")).alias("title"))


SQL["review_queue"] = f"""WITH d AS ({readiness.SQL['sm2_due_queue']}), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due, kc_id)::INT AS rank FROM d)
SELECT user_id, rank, kc_id, due, coalesce(p_name, kc_id::VARCHAR) AS title FROM q LEFT JOIN part ON p_partkey = kc_id AND p_partkey % 3 > 0 WHERE rank <= 20"""


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, kc_id, retention): exp(-t / S) with the ease in days as stability, from the last attempt to the newest of all."""
    tries, at = attempts(spark, sf_dir), F.unix_micros(F.col("ts").cast("timestamp"))
    last = tries.groupBy("user_id", "kc_id").agg(F.max(at).alias("last"))
    now = tries.agg(F.max(at).alias("now"))  # one row
    gone = F.greatest(F.lit(0.0), (F.col("now") - F.col("last")) / 1e6)
    rows = learner.sm2(tries).join(last, ["user_id", "kc_id"]).join(F.broadcast(now))
    return rows.select("user_id", "kc_id", F.round(F.exp(-gone / (F.greatest(F.lit(1e-3), F.round("ease", 6)) * learner.DAY)), 6).alias("retention"))


SQL["retention"] = f"""WITH s AS ({learners.SQL['sm2_schedule']}), l AS (SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 20 AS kc_id, epoch_us(max(ts)) AS last FROM events GROUP BY ALL)
SELECT user_id, kc_id, round(exp(-greatest(0.0::DOUBLE, ((SELECT epoch_us(max(ts)) FROM events) - last) / 1000000.0::DOUBLE) / (greatest(0.001::DOUBLE, ease) * 86400)), 6) AS retention FROM s JOIN l USING (user_id, kc_id)"""


def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, source, n): how many rows of each kind a learner's removal would delete."""
    tries = attempts(spark, sf_dir)
    kinds = {"attempts": tries, "beliefs": tries.select("user_id", "kc_id").distinct(), "traces": misconception_traces(spark, sf_dir)}
    counts = [rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.lit(kind).alias("kind"), "n") for kind, rows in kinds.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


SQL["user_rows"] = f"""WITH {_ANSWERS} SELECT user_id, 'attempts' AS kind, count(*) AS n FROM w GROUP BY user_id UNION ALL SELECT user_id, 'beliefs', count(DISTINCT kc_id) FROM w GROUP BY user_id UNION ALL SELECT user_id, 'traces', count(*) FROM x GROUP BY user_id"""


def transfer_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, a, b, n, delta, t): pairs of a learner's components, the beliefs of the last ten attempts side by side.

    t is the paired statistic; a lift of 0.2 or more is kept. Rows are ten for each component at most.
    """
    line = learner.timeline(attempts(spark, sf_dir))
    newest = Window.partitionBy("user_id", "kc_id").orderBy(F.desc("k"))
    oldest = Window.partitionBy("user_id", "kc_id").orderBy("k")
    last = line.withColumn("m", F.row_number().over(newest)).where("m <= 10").withColumn("i", F.row_number().over(oldest)).select("user_id", "kc_id", "i", F.round("p_known", 9).alias("p"))
    pairs = last.select("user_id", "i", F.col("kc_id").alias("a"), F.col("p").alias("pa")).join(last.select("user_id", "i", F.col("kc_id").alias("b"), F.col("p").alias("pb")), ["user_id", "i"]).where("a < b")
    off = F.col("pb") - F.col("pa")
    found = pairs.groupBy("user_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("mean"), F.stddev_samp(off).alias("sd")).where("n >= 2")
    t = F.when(F.col("sd") > 1e-12, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return found.select("user_id", "a", "b", "n", F.round("mean", 4).alias("delta"), F.round(t, 4).alias("t")).where("delta >= 0.2")


SQL["transfer_lift"] = f"""WITH l AS ({SQL['bkt_timeline']}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, kc_id ORDER BY k DESC) AS m FROM l),
s AS (SELECT user_id, kc_id, row_number() OVER (PARTITION BY user_id, kc_id ORDER BY k) AS i, p_known AS p FROM n WHERE m <= 10),
f AS (SELECT x.user_id, x.kc_id AS a, y.kc_id AS b, count(*) AS n, avg(y.p - x.p) AS mean, stddev_samp(y.p - x.p) AS sd FROM s x JOIN s y ON x.user_id = y.user_id AND x.i = y.i AND x.kc_id < y.kc_id GROUP BY ALL HAVING count(*) >= 2)
SELECT user_id, a, b, n, round(mean, 4) AS delta, round(CASE WHEN sd > 1e-12 THEN mean / (sd / sqrt(n)) END, 4) AS t FROM f WHERE round(mean, 4) >= 0.2"""

QUERIES = {
    f.__name__: f
    for f in (misconception_tags, misconception_traces, misconception_clusters, misconception_examples, top_misconception, component_states, bkt_timeline, bkt_refit, decay_risk, readiness_mean, learner_dimensions, review_queue, recorded_attempts, retention, user_rows, transfer_lift)
}
