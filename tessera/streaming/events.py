"""Streams of events: sessions closed by a watermark, and beliefs kept in keyed state.

A run reads what is there (trigger available-now) and ends; with the same folder it goes on where it
stopped, and the file sink takes each batch once. Left running, the same plans serve a live stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.learner import CORRECT, P0, next_belief
from tessera.operators.shared import shared_folder


#: Files of a batch, which bounds what a key can have in it.
FILES = 64


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the Parquet files at ``path`` as they appear, their time as an instant; FILES of them at most in a batch."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """All that the stream gives by now, appended to ``folder`` (a new shared one by default) and read back."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def closed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, last_us, n_events, total) for each session that the watermark has passed; state holds only open ones."""
    told = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"), F.max(F.unix_micros("ts")).alias("last_us"))
    return told.select("user_id", "last_us", "n_events", F.round("total", 4).alias("total"))


def _observe(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    p, n = state.get if state.exists else (P0, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for correct in rows["score"] >= CORRECT:
        p = next_belief(p, correct)
    state.update((float(p), int(n + len(rows))))
    yield pd.DataFrame({"user_id": [key[0]], "kc_id": [key[1]], "p_known": [float(p)], "obs_n": [int(n + len(rows))]})


def beliefs(attempts: DataFrame) -> DataFrame:
    """A row (user_id, kc_id, p_known, obs_n) whenever a batch changes a belief; state is two numbers for each key.

    A key's rows of one batch are folded in order of time; rows that come in a later batch are folded
    then, whatever their time.
    """
    kinds = dict(attempts.dtypes)
    schema = f"user_id {kinds['user_id']}, kc_id {kinds['kc_id']}, p_known double, obs_n long"
    needed = attempts.select("user_id", "kc_id", "score", "ts", "event_id")
    return needed.groupBy("user_id", "kc_id").applyInPandasWithState(_observe, schema, "p_known double, obs_n long", "append", GroupStateTimeout.NoTimeout)


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each value of ``keys``; a value is forgotten once the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def newest_beliefs(changes: DataFrame) -> DataFrame:
    """The last change of each belief."""
    return changes.groupBy("user_id", "kc_id").agg(F.max_by("p_known", "obs_n").alias("p_known"), F.max("obs_n").alias("obs_n"))
