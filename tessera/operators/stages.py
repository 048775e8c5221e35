"""Learning stages of a graph's pages, and what each learner should look at next for each goal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ordering import positions
from tessera.operators.shared import small, written

#: Stages in order, the stages of each goal in order of preference, and types of pages in order within a stage.
STAGES = ["overview", "foundations", "core", "applications", "review"]
GOALS = {
    "practice": ["applications", "core", "foundations", "review", "overview"],
    "review": ["review", "core", "applications", "foundations", "overview"],
    "quick": ["overview", "foundations", "core", "applications", "review"],
    "learn": ["foundations", "core", "applications", "overview", "review"],
}
TYPE_ORDER = {"synthesis": 0, "source": 1, "concept": 2, "formula": 3, "principle": 4}
#: Why a page is where it is.
REASONS = {
    "source": "Use this to understand where the material came from.",
    "synthesis": "Use this synthesis as a map before details.",
    "gap": "This item has weak graph connections, so it is worth checking deliberately.",
    "needed": "Many later items depend on this, so learn it early.",
    "free": "This has few prerequisites and works as a foundation.",
    "applied": "Connect this with its prerequisite concepts before applying it.",
    "spine": "This is part of the main conceptual spine.",
}


def staged(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, gaps: DataFrame) -> DataFrame:
    """(node, title, stage, place, reason, prerequisites, score, is_bridge, is_gap): pages by stage, in order within it from 1 on.

    ``nodes`` (node, type, title); ``edges`` (source, target, edge_type), repeats count once; ``bridges`` and ``gaps`` (node): what
    insights name. A page with one neighbour or none is a gap too; an edge from a page to itself makes it its own neighbour.
    Order: type, score, title, node. No stage is put in order by a single task.
    """
    known = nodes.select("node")
    ways = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other")))
    degree = ways.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    firm = edges.where("edge_type = 'prerequisite'").select("source", "target").distinct()
    needs = firm.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("prerequisites"))
    serves = firm.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    rows = nodes.select("node", "type", "title")
    for more in (degree, needs, serves, bridges.select("node").distinct().withColumn("is_bridge", F.lit(True)), gaps.select("node").distinct().withColumn("named_gap", F.lit(True))):
        rows = rows.join(more, "node", "left")
    rows = rows.fillna(0, ["degree", "prerequisites", "dependents"]).fillna(False, ["is_bridge", "named_gap"])
    rows = rows.withColumn("is_gap", F.col("named_gap") | (F.col("degree") <= 1))
    score = F.col("degree") + F.col("dependents") * 2 + F.when(F.col("is_bridge"), 4).otherwise(0) - F.when(F.col("is_gap"), 1).otherwise(0)
    why = (
        F.when(F.col("type").isin("source", "synthesis"), F.col("type"))
        .when(F.col("is_gap"), "gap")
        .when(F.col("dependents") >= 2, "needed")
        .when(F.col("prerequisites") == 0, "free")
        .when(F.col("type").isin("formula", "principle"), "applied")
        .otherwise("spine")
    )
    where = {"source": 0, "synthesis": 0, "gap": 4, "needed": 1, "free": 1, "applied": 2, "spine": 2}
    mapped = lambda of, c: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[c]
    rows = rows.select("node", "title", mapped(where, why).alias("_stage"), mapped(REASONS, why).alias("reason"), "prerequisites", score.alias("score"), "is_bridge", "is_gap", F.coalesce(mapped(TYPE_ORDER, F.col("type")), F.lit(9)).alias("_type"))
    placed = positions(rows.withColumn("_loss", -F.col("score")), ["_stage", "_type", "_loss", "title", "node"])
    before = small(placed.groupBy("_stage").agg(F.min("position").alias("_first")), "stage-starts")  # five rows
    names = F.array(*map(F.lit, STAGES))
    return placed.join(before, "_stage").select("node", "title", F.get(names, F.col("_stage")).alias("stage"), (F.col("position") - F.col("_first") + 1).alias("place"), "reason", "prerequisites", "score", "is_bridge", "is_gap")


def next_items(items: DataFrame, learners: DataFrame, done: DataFrame) -> DataFrame:
    """(user_id, goal, node, stage): the first page of ``items`` (from ``staged``) that a learner hasn't done, by each goal's order of stages.

    ``learners`` (user_id); ``done`` (user_id, node). In each stage a learner's first open place is found from what is done there
    alone: where the places done, counted from 1 on, first leave a gap. A learner who has done everything has no row.
    """
    items = written(items.select("node", "stage", "place"), "staged")
    sizes = items.groupBy("stage").agg(F.count(F.lit(1)).alias("size"))
    had = done.select("user_id", "node").distinct().join(items, "node")
    counted = had.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "stage").orderBy("place")))
    gone = counted.groupBy("user_id", "stage").agg(F.coalesce(F.min(F.when(F.col("place") != F.col("k"), F.col("k"))), F.count(F.lit(1)) + 1).alias("open"))
    every = learners.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage")).join(small(sizes, "stage-sizes"), "stage")
    open_ = every.join(gone, ["user_id", "stage"], "left").withColumn("place", F.coalesce("open", F.lit(1)).cast("long")).where("place <= size")
    order = F.create_map(*[x for goal, stages in GOALS.items() for k, s in enumerate(stages) for x in (F.lit(f"{goal} {s}"), F.lit(k))])
    goals = open_.select("user_id", "stage", "place", F.explode(F.array(*map(F.lit, GOALS))).alias("goal"))
    best = goals.groupBy("user_id", "goal").agg(F.min_by(F.struct("stage", "place"), order[F.concat_ws(" ", "goal", "stage")]).alias("b"))
    return best.select("user_id", "goal", "b.stage", "b.place").join(items, ["stage", "place"]).select("user_id", "goal", "node", "stage")
