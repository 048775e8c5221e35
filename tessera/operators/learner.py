"""Learner models: folds over each learner's attempts on a knowledge component, and summaries.

A fold reads the attempts of one learner on one component in order and carries its state from one to
the next; learners are spread by both keys, so a busy learner's components are folded apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First belief, and chances to learn, guess and slip.
P0, LEARN, GUESS, SLIP = 0.1, 0.2, 0.2, 0.1
#: A score from here on is correct; beliefs from here on are mastery, below here weakness.
CORRECT, MASTERED, WEAK = 0.7, 0.85, 0.5
HOUR, DAY = 3600.0, 86400.0


def next_belief(p: float, correct: bool) -> float:
    """The belief after one answer; a wrong one is damped by the chance to learn."""
    right = p * (1 - SLIP) + (1 - p) * GUESS
    known = p * (1 - SLIP) / right
    return known + (1 - known) * LEARN if correct else p * SLIP / max(1e-9, 1 - right) * (1 - LEARN)


def next_repetition(state: tuple[float, float, int], q: int) -> tuple[float, float, int]:
    """(ease, seconds, reps) after a repetition of quality q."""
    ease = max(1.3, state[0] + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    reps = 0 if q < 3 else state[2] + 1
    grown = max(state[1], 1.0) * ease
    wait = HOUR if q < 3 else DAY if reps == 1 else 6 * DAY if reps == 2 else min(grown, 14 * DAY) if reps == 3 else grown
    return ease, max(wait, HOUR), reps


def quality(score: Column, hints: Column) -> Column:
    """Recall quality from 0 to 5 of a score out of 1; hints take off two at most."""
    off = F.least(F.lit(2), F.greatest(F.lit(0), hints.cast("int")))
    return F.when(score < 0.3, 0).when(score < 0.5, 2).when(score < 0.7, 3).when(score < 0.9, F.greatest(F.lit(3), 4 - off)).otherwise(F.greatest(F.lit(4), 5 - off)).cast("int")


def folded(attempts: DataFrame, start: tuple, step: Callable, schema: str) -> DataFrame:
    """(user_id, kc_id, event_id, k, the fields of ``schema``): a state after each attempt, k from 1 on.

    ``step`` makes the next state of the last one and an attempt's (correct, quality). Partitions are
    sorted by learner, component and time, and only the last state is carried from row to row, so no
    learner's history is held at once.
    """
    kinds, keys = dict(attempts.dtypes), ["user_id", "kc_id"]
    rows = attempts.select(*keys, "ts", "event_id", (F.col("score") >= CORRECT).alias("correct"), quality(F.col("score"), F.col("hint_ladder")).alias("q"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        last, k, state = None, 0, start
        for frame in frames:
            out = []
            for user, kc, correct, q in zip(frame["user_id"].tolist(), frame["kc_id"].tolist(), frame["correct"].tolist(), frame["q"].tolist(), strict=True):
                if (user, kc) != last:
                    last, k, state = (user, kc), 0, start
                state, k = step(state, correct, q), k + 1
                out.append((k, *state))
            yield pd.concat([frame[[*keys, "event_id"]], pd.DataFrame(out, columns=["k", *names], index=frame.index)], axis=1)

    return rows.mapInPandas(run, f"user_id {kinds['user_id']}, kc_id {kinds['kc_id']}, event_id {kinds['event_id']}, k long, {schema}")


def timeline(attempts: DataFrame) -> DataFrame:
    """(user_id, kc_id, event_id, k, p_known): the belief after each attempt."""
    return folded(attempts, (P0,), lambda s, correct, q: (next_belief(s[0], correct),), "p_known double")


def bkt(attempts: DataFrame) -> DataFrame:
    """(user_id, kc_id, p_known, obs_n): the belief after all attempts."""
    return timeline(attempts).groupBy("user_id", "kc_id").agg(F.max_by("p_known", "k").alias("p_known"), F.max("k").alias("obs_n"))


def sm2(attempts: DataFrame) -> DataFrame:
    """(user_id, kc_id, ease, interval_seconds, reps, last_quality) after all attempts."""
    line = folded(attempts, (2.5, 0.0, 0, 0), lambda s, correct, q: (*next_repetition(s[:3], q), q), "ease double, interval_seconds double, reps int, last_quality int")
    last = F.max_by(F.struct("ease", "interval_seconds", "reps", "last_quality"), "k").alias("s")
    return line.groupBy("user_id", "kc_id").agg(last).select("user_id", "kc_id", "s.*")


def after_attempt(state: tuple, correct: bool, q: int) -> tuple:
    """(p_known, ease, interval_seconds, reps, last_quality) after one attempt."""
    return next_belief(state[0], correct), *next_repetition(state[1:4], q), q


#: What is known of a component before any attempt.
NEW = (P0, 2.5, 0.0, 0, 0)
RECORD = "p_known double, ease double, interval_seconds double, reps int, last_quality int"


def recorded(attempts: DataFrame) -> DataFrame:
    """(user_id, kc_id, the fields of RECORD, obs_n, score, last_us, due_us): belief, schedule and last attempt of each component, in one pass."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    last = F.max_by(F.struct(*names), "k").alias("s")
    line = folded(attempts, NEW, after_attempt, RECORD).groupBy("user_id", "kc_id").agg(last, F.max("k").alias("obs_n")).select("user_id", "kc_id", "s.*", "obs_n")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    newest = attempts.groupBy("user_id", "kc_id").agg(F.max_by("score", F.struct("ts", "event_id")).alias("score"), F.max(at).alias("last_us"))
    return line.join(newest, ["user_id", "kc_id"]).withColumn("due_us", due(F.col("last_us"), F.col("interval_seconds")))


def due(last_us: Column, seconds: Column) -> Column:
    """When a repetition is due, in microseconds."""
    return last_us + F.rint(seconds * 1e6).cast("long")


def ranked_components(beliefs: DataFrame, weak: bool, limit: int) -> DataFrame:
    """Each learner's weakest or best mastered components, ``limit`` at most."""
    p = F.col("p_known")
    order = Window.partitionBy("user_id").orderBy(p if weak else p.desc(), "kc_id")
    found = beliefs.where(p < WEAK if weak else p >= MASTERED).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= limit).select("user_id", "rank", "kc_id", "p_known")


def overconfidence(attempts: DataFrame, last: int = 200) -> DataFrame:
    """(user_id, gap): mean of stated confidence less correctness over each learner's last attempts."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    daily = Window.partitionBy("user_id", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("event_id"))  # so no learner's whole history is ranked at once
    gap = (F.col("confidence") - 1) / 4.0 - (F.col("score") >= CORRECT).cast("double")
    return attempts.select("user_id", "ts", "event_id", gap.alias("gap")).withColumn("k", F.row_number().over(daily)).where(F.col("k") <= last).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= last).groupBy("user_id").agg(F.round(F.avg("gap"), 4).alias("gap"))


def learner_state(beliefs: DataFrame) -> DataFrame:
    """One row for each learner: mean belief, components tracked and mastered, attempts."""
    return beliefs.groupBy("user_id").agg(
        F.round(F.avg("p_known"), 4).alias("p_known_avg"), F.count(F.lit(1)).alias("n_kcs_tracked"), F.count_if(F.col("p_known") >= MASTERED).alias("n_kcs_mastered"), F.sum("obs_n").alias("n_attempts")
    )


def attempt_state(score: Column) -> Column:
    """What an attempt with a score out of 1 leaves a component in; correct ones are at least partial."""
    return F.when(score >= MASTERED, "mastered").when(score >= 0.5, "partial").otherwise("attempted")


def states(exposures: DataFrame, attempts: DataFrame) -> DataFrame:
    """(user_id, kc_id, state, score, attempts, successes, last_seen): the newest attempt of each component, else an exposure.

    As an upserted row would read: an attempt replaces all but the time, an exposure only the time once there is an attempt.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    tried = attempts.groupBy("user_id", "kc_id").agg(F.max_by("score", F.struct("ts", "event_id")).alias("score"), F.max(at).alias("last"))
    shown = exposures.groupBy("user_id", "kc_id").agg(F.max(at).alias("seen"))
    both = tried.join(shown, ["user_id", "kc_id"], "full")
    done = F.col("score").isNotNull()
    return both.select(
        "user_id",
        "kc_id",
        F.when(done, attempt_state(F.col("score"))).otherwise("exposed").alias("state"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(done, 1).otherwise(0).alias("attempts"),
        F.when(F.col("score") >= CORRECT, 1).otherwise(0).alias("successes"),
        F.greatest("last", "seen").alias("last_seen"),
    )


#: The grid that a refit starts from, how far the next ones reach, and first beliefs that it tries.
GRID, REACH, FIRST = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4), (0.025, 0.01), (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)


def refit(attempts: DataFrame, least: int = 5) -> DataFrame:
    """(user_id, observations, p_known, p_t, p_g, p_s): most likely parameters over each learner's history.

    The chance to know before attempt k is 1 - (1 - p) * (1 - p_t) ** (k - 1), whatever was answered, so a
    history counts by how often each place was right. A learner's attempts come sorted by time to one task,
    which holds a byte for each and sums a grid's likelihoods over CELLS of attempts and cells at once.
    Likelihoods are compared to nine digits, ties go to the first cell. Learners with fewer than ``least``
    attempts keep the default parameters.
    """
    kind = dict(attempts.dtypes)["user_id"]
    schema = f"user_id {kind}, observations long, p_known double, p_t double, p_g double, p_s double"
    right = F.coalesce(F.col("score") >= CORRECT, F.lit(False)).alias("correct")
    rows = attempts.where("user_id IS NOT NULL").select("user_id", "ts", "event_id", right).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "correct")

    def run(frames):
        user, parts = None, []
        for frame in frames:
            users, answers, out = frame["user_id"].to_numpy(), frame["correct"].to_numpy(dtype=bool), []
            cuts = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if parts and users[start] != user:
                    out.append((user, *_fitted(np.concatenate(parts), least)))
                    parts = []
                user = users[start]
                parts.append(answers[start:end].copy())
            yield pd.DataFrame(out, columns=["user_id", "observations", *PARAMETERS])
        if parts:
            yield pd.DataFrame([(user, *_fitted(np.concatenate(parts), least))], columns=["user_id", "observations", *PARAMETERS])

    # attempts of no learner are no history
    nobody = attempts.where("user_id IS NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("observations")).select("user_id", "observations", *[F.lit(x).alias(c) for c, x in PARAMETERS.items()])
    return rows.mapInPandas(run, schema).unionByName(nobody)


#: The parameters of a refit, and what they are without one.
PARAMETERS = {"p_known": P0, "p_t": LEARN, "p_g": GUESS, "p_s": SLIP}
#: Attempts times cells that a refit weighs at once: 8 MB for each step of the sum.
CELLS = 1 << 20


def _likelihoods(correct: np.ndarray, p: np.ndarray, pt: np.ndarray, pg: np.ndarray, ps: np.ndarray) -> np.ndarray:
    """Log likelihoods of a history, one for each of the cells p x pt x pg x ps."""
    shape = (len(p), len(pt), len(pg), len(ps))
    total, step = np.zeros(shape), max(1, CELLS // (shape[0] * shape[1] * shape[2] * shape[3]))
    for start in range(0, len(correct), step):
        is_right = correct[start : start + step]
        k = np.arange(start, start + len(is_right))
        know = 1 - (1 - p[:, None]) * np.power(1 - pt, k[:, None, None])  # k, p, pt
        know = know[:, :, :, None, None]
        right = know[is_right] * (1 - ps) + (1 - know[is_right]) * pg[:, None]
        wrong = know[~is_right] * ps + (1 - know[~is_right]) * (1 - pg[:, None])
        total += np.log(right).sum(axis=0) + np.log(wrong).sum(axis=0)
    return total


def _fitted(correct: np.ndarray, least: int) -> tuple:
    """(observations, p_known, p_t, p_g, p_s) of a learner whose attempts, in order, were right or not."""
    if len(correct) < least:
        return (len(correct), *PARAMETERS.values())
    p = np.array([0.5 if correct[0] else 0.1])
    best, cell = None, None
    for reach in (None, *REACH):
        grids = [np.array(GRID)] * 3 if reach is None else [np.round(np.clip(c + np.arange(-2, 3) * reach, 0.01, 0.99), 4) for c in cell]
        grids, times = zip(*(np.unique(grid, return_counts=True) for grid in grids), strict=True)
        # as in the SQL, equal cells of a grid (at a bound) are one, in which each attempt counts as often
        found = np.round(_likelihoods(correct, p, *grids) * times[0][:, None, None] * times[1][:, None] * times[2], 9)
        at = np.unravel_index(np.argmax(found), found.shape)
        if best is None or found[at] > best:
            best, cell = found[at], [grid[k] for grid, k in zip(grids, at[1:], strict=True)]
    starts = np.concatenate([p, FIRST])
    p0 = starts[np.argmax(np.round(_likelihoods(correct, starts, *[np.array([c]) for c in cell]), 9))]
    return (len(correct), *(float(np.round(np.clip(x, 0.01, 0.99), 4)) for x in (p0, *cell)))
