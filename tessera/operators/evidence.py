"""Pages that answer many questions at once: seeds first, then neighbours in the graph, within budgets of pages and characters.

Each question keeps a short list of pages. A round looks at what is next to them (the frontier), takes what a model
asked for, or the best neighbour where no model was asked, and reads it as far as the budget goes. Rounds are joins over all
questions; a page's size is all that the budget needs, so texts are read once before and once after.

Of each node only its NEIGHBOURS best edges are kept: a question has SEEDS + ROUNDS * EXPANSIONS pages at most, so what
stands further back in a node's order can't be among a frontier's first FRONTIER. A hub is one short row then, and
questions that share one meet it without a shuffle on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.shared import hot_keys, join_spread, observed, written

#: Rounds, pages a round adds, seeds, neighbours looked at, and the least weight of an edge.
ROUNDS, EXPANSIONS, SEEDS, FRONTIER, LEAST = 2, 4, 8, 36, 0.45
#: Types of edges, preferred ones first; others come after them.
PRIORITY = ["prerequisite", "teaches", "enables", "derives", "applies_to", "scaffolds", "related", "direct", "source"]
#: Fixed value: what ends a page that was cut.
CUT = "\n\n[...truncated...]"


@dataclass
class Evidence:
    """pages (question, place, node, origin, priority, score, chars, cut), relations (question, source, target, edge_type), status (question, rounds, used, sufficient, exhausted)."""

    pages: DataFrame
    relations: DataFrame
    status: DataFrame


def preferred(kind: Column) -> Column:
    """A type's place among the preferred ones."""
    return F.coalesce(F.create_map(*[x for i, t in enumerate(PRIORITY) for x in (F.lit(t), F.lit(i))])[kind], F.lit(len(PRIORITY)))


def neighbours(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node, near): up to ``most`` edges of each node, both ways, to other nodes, the best first; one for each neighbour."""
    kept = edges.where((F.col("weight") >= LEAST) & (F.col("source") != F.col("target"))).select("source", "target", "edge_type", "weight", preferred(F.col("edge_type")).alias("rank"))
    edge = F.struct("source", "target", "edge_type")
    there = kept.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight", "rank", edge.alias("edge"))
    ways = there.unionByName(kept.select(F.col("target").alias("node"), F.col("source").alias("other"), "weight", "rank", edge.alias("edge")))
    best = ways.groupBy("node", "other").agg(F.min(F.struct((-F.col("weight")).alias("loss"), "rank", "edge")).alias("e"))
    titled = best.join(nodes.select(F.col("node").alias("other"), "title"), "other")
    order = F.struct("e.loss", "e.rank", "title", "other")
    first = titled.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(order))).where(F.col("k") <= most)
    return first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("e.loss", "e.rank", "title", "other", "e.edge"))).alias("near"))


def _read(wanted: DataFrame, used: Column, pages: int, budget: int, most: int) -> DataFrame:
    """``wanted`` (question, items: array of struct beginning with size, and its own used) with what is read of it, in order.

    A page is cut to ``most`` characters or to what is left; it isn't read if it doesn't fit. It ends after ``pages`` pages or when nothing is left.
    """
    kind = wanted.schema["items"].dataType.elementType.simpleString()
    none = F.array().cast(f"array<struct<item:{kind},chars:bigint,cut:boolean>>")

    def step(s: Column, x: Column) -> Column:
        limit = F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), F.lit(budget) - s["used"]))
        cut = x["size"] > limit
        chars = F.when(cut, limit + len(CUT)).otherwise(x["size"])
        fits = (s["used"] < budget) & (F.size(s["read"]) < pages) & (x["size"] > 0) & (s["used"] + chars <= budget)
        more = F.struct(x.alias("item"), chars.alias("chars"), cut.alias("cut"))
        return F.struct(F.when(fits, s["used"] + chars).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["read"], F.array(more))).otherwise(s["read"]).alias("read"))

    out = F.aggregate("items", F.struct(used.cast("long").alias("used"), none.alias("read")), step)
    return wanted.withColumn("_out", out).select("question", F.col("_out.used").alias("used"), F.col("_out.read").alias("read"))


def collect_evidence(questions: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, decisions: DataFrame | None = None, page_budget: int = 20_000, max_page_size: int = 5_000, rounds: int = ROUNDS, expansions: int = EXPANSIONS) -> Evidence:
    """Pages and relations for every question (question), in the order they are read.

    ``seeds`` (question, node, title_match, score): pages a search found; matched titles first, then by score, then by
    node; eight of them at most. ``nodes`` (node, title, size): pages and the
    characters of their texts; empty ones are never read. ``edges`` (source, target, edge_type, weight). ``decisions``
    (question, round, node, sufficient): nodes that a model wants to be read in a round, or a row without a node if it wants
    none; they are read in the frontier's order. Where no model has said anything yet, the frontier's best node
    is read. A question ends with a round that adds nothing, wants nothing or leaves nothing of the budget, or without frontier.
    """
    nodes = nodes.where("node IS NOT NULL").select("node", "title", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    asked = questions.where("question IS NOT NULL").select("question").distinct()
    near = written(neighbours(nodes, edges, FRONTIER + SEEDS + rounds * expansions), "evidence-neighbours")

    order = F.struct((~F.coalesce("title_match", F.lit(False))).alias("later"), (-F.coalesce("score", F.lit(0.0))).alias("loss"), "node")
    given = seeds.where("node IS NOT NULL").join(asked, "question", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy(order)))
    # every seed counts towards the limit, repeated and unknown ones too
    given = given.where(F.col("k") <= SEEDS).join(nodes, "node", "left")
    item = F.struct("k", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "node", F.when(F.coalesce("title_match", F.lit(False)), 0).otherwise(1).alias("priority"), F.coalesce("score", F.lit(0.0)).alias("score"))
    items = given.groupBy("question", "node").agg(F.min(item).alias("i")).groupBy("question").agg(F.array_sort(F.collect_list("i")).alias("items"))
    read = _read(items, F.lit(0), SEEDS, page_budget, max_page_size)
    start = asked.join(read, "question", "left").select("question", F.coalesce("used", F.lit(0)).cast("long").alias("used"), "read")
    first = written(start, "evidence-seeds")
    pages = first.select("question", F.posexplode("read").alias("k", "r")).select("question", (F.col("k") + 1).cast("long").alias("place"), "r.item.node", F.lit("seed").alias("origin"), "r.item.priority", "r.item.score", "r.chars", "r.cut")
    pages = written(pages, "evidence-pages")
    state = first.select("question", "used", F.lit(0).alias("rounds"), F.lit(False).alias("asked"), F.lit(False).alias("sufficient"), F.lit(True).alias("open"))
    state, relations = written(state, "evidence-state"), None

    for round_ in range(1, rounds + 1):
        live = state.where("open")
        own = pages.join(live.select("question"), "question", "left_semi").select("question", "node")
        reach = join_spread(own, "node", near, hot_keys(own, "node")).select("question", F.explode("near").alias("n"))
        reach = reach.select("question", F.col("n.other").alias("node"), F.struct("n.loss", "n.rank", "n.title", "n.other", "n.edge").alias("n")).join(own, ["question", "node"], "left_anti")
        best = reach.groupBy("question", "node").agg(F.min(F.struct("n.loss", "n.rank", "n.edge", "n.title", "n.other")).alias("e"))
        place = F.row_number().over(Window.partitionBy("question").orderBy("e.loss", "e.rank", "e.title", "node"))
        frontier = written(best.withColumn("k", place).where(F.col("k") <= FRONTIER), "evidence-frontier")

        if decisions is None:
            wishes = frontier.where("k = 1").select("question", "node")
        else:
            here = decisions.where(F.col("round") == round_).join(nodes.select("node").withColumn("_known", F.lit(True)), "node", "left")
            said = written(here.groupBy("question").agg(F.lit(True).alias("said"), F.coalesce(F.max("sufficient"), F.lit(False)).alias("enough"), F.count(F.when(F.col("_known"), 1)).alias("wanted")), "evidence-said")
            mute = live.where("NOT asked").select("question").join(said.select("question"), "question", "left_anti")
            asked_for = here.where("_known").select("question", "node").distinct()
            wishes = frontier.join(asked_for, ["question", "node"], "left_semi").select("question", "node").unionByName(frontier.where("k = 1").join(mute, "question", "left_semi").select("question", "node"))
        items = frontier.join(wishes, ["question", "node"], "left_semi").join(nodes.select("node", "size"), "node")
        items = items.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("k", "size", "node", (-F.col("e.loss")).alias("score"), "e.edge"))).alias("items"))
        used = items.join(live.select("question", F.col("used").alias("_used")), "question")
        read = written(_read(used, F.col("_used"), expansions, page_budget, max_page_size), "evidence-read")
        have = pages.groupBy("question").agg(F.max("place").alias("held"))
        more = read.join(have, "question", "left").select("question", "held", F.posexplode("read").alias("k", "r"))
        grown = pages.unionByName(more.select("question", (F.coalesce("held", F.lit(0)) + F.col("k") + 1).cast("long").alias("place"), "r.item.node", F.lit("graph").alias("origin"), F.lit(2).alias("priority"), "r.item.score", "r.chars", "r.cut"))
        links = read.select("question", F.explode("read").alias("r")).select("question", "r.item.edge.*")
        relations = links if relations is None else relations.unionByName(links)
        heads = frontier.select("question").distinct().withColumn("_frontier", F.lit(True))
        if decisions is None:
            after = state.withColumn("said", F.lit(None).cast("boolean")).withColumn("enough", F.lit(None).cast("boolean")).withColumn("wanted", F.lit(None).cast("long"))
        else:
            after = state.join(said, "question", "left")
        after = after.join(read.select("question", F.col("used").alias("now"), F.size("read").alias("added")), "question", "left").join(heads, "question", "left")
        ran, said_now = F.col("open"), F.coalesce("said", F.lit(False)) & F.col("_frontier").isNotNull()
        after = after.select(
            "question",
            F.coalesce("now", "used").alias("used"),
            F.when(ran, round_).otherwise(F.col("rounds")).alias("rounds"),
            (F.col("asked") | (ran & said_now)).alias("asked"),
            F.when(ran & said_now, F.col("enough") & (F.col("wanted") == 0)).otherwise(F.col("sufficient")).alias("sufficient"),
            (ran & (F.coalesce("added", F.lit(0)) > 0) & (F.coalesce("now", "used") < page_budget)).alias("open"),
        )
        pages, state, observed_open = written(grown, "evidence-pages"), *observed(after, "evidence-state", n=F.count_if("open"))
        if not observed_open["n"]:
            break
    status = state.select("question", "rounds", "used", "sufficient", (F.col("used") >= page_budget).alias("exhausted"))
    return Evidence(pages, relations.distinct(), status)


def with_texts(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """``pages`` with content: the text (node, text) as far as it is read."""
    return pages.join(texts.select("node", "text"), "node").withColumn("content", F.when(F.col("cut"), F.concat(F.substring("text", F.lit(1), (F.col("chars") - len(CUT)).cast("int")), F.lit(CUT))).otherwise(F.col("text"))).drop("text")
