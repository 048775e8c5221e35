"""Communities of a weighted graph: Louvain's method and label propagation, in rounds of joins.

Both let nodes move at once, so a round lets only one half of them move, dealt by a hash of node and round:
two neighbours that would swap sides for ever are sooner or later in different halves. Node ids may be of any
type that has an order. Edges are undirected; parallel ones add up; an edge from a node to itself counts in
its weight. What a round makes is written, so a lost executor costs a read.

A hub's edges, and the rows that ask for the weight of a giant community, are joined apart (see
``join_spread``), and everything that is summed is summed where it is before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators.shared import FEW_ROWS, HOT_ROWS, dealt, discard, hot_keys, join_spread, observed, small, tasks_for, written

#: Rounds of one level, levels, and the gain of modularity in two rounds that is worth going on for.
ROUNDS, LEVELS, WORTH = 24, 12, 1e-4
#: Sweeps of label propagation. A fixed value.
SWEEPS = 20


def both_ends(edges: DataFrame, weight: str | None = "weight") -> DataFrame:
    """(a, b, w): the weight between two nodes, in both directions; a node's edges to itself once, at twice their weight.

    The weights of all rows of a node are then its strength. Without a weight every edge weighs 1.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    there = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), w.alias("w"))
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return there.unionByName(back).where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.sum("w").alias("w"))


def _turn(node: str, level: int, round_: int) -> Column:
    """Whether a node may move in this round: one half, and in the next round the other."""
    return F.pmod(F.xxhash64(F.lit(level), F.lit(round_ // 2), F.col(node)), F.lit(2)) == round_ % 2


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = "weight", resolution: float = 1.0) -> float:
    """Modularity of ``communities`` (node, community): the share of weight inside, less what strengths alone would put there."""
    pairs = both_ends(edges, weight)
    ends = [communities.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in ("a", "b")]
    known = pairs.join(ends[0], "a").join(ends[1], "b")
    by = known.groupBy("ca").agg(F.sum("w").alias("strength"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = by.agg(F.sum("inside").alias("inside"), F.sum(F.col("strength") * F.col("strength")).alias("squares"), F.sum("strength").alias("all")).first()
    return 0.0 if not row["all"] else row["inside"] / row["all"] - resolution * row["squares"] / row["all"] ** 2


def _settled(pairs: DataFrame, level: int, resolution: float, hubs: DataFrame | None, n_tasks: int) -> tuple[DataFrame, bool]:
    """(node, community) after local moves over ``pairs`` (a, b, w), dealt by b, and whether any node moved.

    A move goes to the neighbouring community with the greatest gain of modularity, ties to the least community,
    and only if it gains more than staying. The best state met is kept: moves made at once may lose in sum.
    A round moves the pairs once: each node tells its neighbours its community and how strong that is.
    """
    nodes, seen = observed(pairs.groupBy(F.col("b").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node")), "louvain-nodes", all=F.sum("k"))
    total = seen["all"]
    if not total:
        return nodes.select("node", "community"), False
    best, best_q, before, moved, moves_before = None, None, None, False, 1
    for round_ in range(ROUNDS + 1):
        strong = nodes.groupBy("community").agg(F.sum("k").alias("strength"), F.count(F.lit(1)).alias("n"))
        sums, told = observed(strong, "louvain-sums", squares=F.sum(F.col("strength") * F.col("strength")), giants=F.count_if(F.col("n") > HOT_ROWS))
        giants = sums.where(F.col("n") > HOT_ROWS).select("community") if told["giants"] else None
        giants = F.broadcast(giants) if told["giants"] and told["giants"] <= FEW_ROWS else giants
        known = join_spread(nodes, "community", sums.select("community", "strength"), giants)
        offers = join_spread(pairs, "b", known.select(F.col("node").alias("b"), F.col("community").alias("to"), "strength"), hubs)
        own = known.select(F.col("node").alias("a"), "k", F.col("community").alias("own"), F.col("strength").alias("held"))
        home = F.col("to") == F.col("own")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("strength") - F.when(home, F.col("k")).otherwise(0.0)) / total, 9)
        alone = F.round(-resolution * F.first("k") * (F.first("held") - F.first("k")) / total, 9)

        def choice(links: DataFrame, own: DataFrame) -> DataFrame:
            summed = links.groupBy("a", "to").agg(F.sum("w").alias("inside"), F.sum(F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0)).alias("w"), F.first("strength").alias("strength"))
            return summed.join(own, "a").groupBy("a").agg(  # noqa: B023
                F.first("k").alias("k"), F.first("own").alias("own"), F.coalesce(F.max(F.when(home, gain)), alone).alias("stay"), F.min(F.struct((-gain).alias("loss"), "to")).alias("best"), F.sum(F.when(home, F.col("inside")).otherwise(0.0)).alias("inside")  # noqa: B023
            )

        state = _by_node(offers, own, hubs, n_tasks, choice)
        go = _turn("a", level, round_) & (-F.col("best.loss") > F.col("stay"))
        state = state.select(F.col("a").alias("node"), "k", F.when(go, F.col("best.to")).otherwise(F.col("own")).alias("community"), go.alias("_go"), "inside")
        after, told2 = observed(state, "louvain-nodes", inside=F.sum("inside"), moves=F.count_if("_go"))
        q = told2["inside"] / total - resolution * told["squares"] / total**2
        discard(sums)
        better = best_q is None or q > best_q + 1e-12
        if best is not None and best is not nodes and better:
            discard(best)
        if better:
            best, best_q = nodes, q
        elif nodes is not best:
            discard(nodes)
        # two rounds give every node its turn
        idle = not told2["moves"] and not moves_before
        stale = round_ % 2 == 0 and before is not None and q - before < WORTH
        if round_ % 2 == 0:
            before = q
        moved = moved or bool(told2["moves"])
        moves_before = told2["moves"]
        if idle or stale or round_ == ROUNDS:
            discard(after)
            return best.select("node", "community"), moved
        nodes = after.select("node", "k", "community")
    raise AssertionError


def _by_node(links: DataFrame, own: DataFrame, hubs: DataFrame | None, n_tasks: int, choice: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``choice`` of ``links`` and ``own`` by their column a: those of a node meet in a task, those of hubs are summed where they are."""
    if hubs is None:
        return choice(links.repartition(n_tasks, "a"), own)
    hot = hubs.withColumnRenamed("b", "a")
    few = small(own.join(hot, "a", "left_semi"), "hub-rows")
    return choice(links.join(hot, "a", "left_anti").repartition(n_tasks, "a"), own).unionByName(choice(links.join(hot, "a", "left_semi"), few))


def _level(pairs: DataFrame, n_pairs: int, level: int, resolution: float) -> tuple[DataFrame, tuple[DataFrame, dict] | None]:
    """(node, community) after local moves over ``pairs``, and the pairs of communities with their number; None if no node moved.

    Where ids are numbers and no node has more pairs than a block, blocks of pairs stay where they are; if all fit a task, it makes all rounds.
    """
    by_block = dict(pairs.dtypes)["a"] == "bigint" and n_pairs and pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= blocks.BLOCK_PAIRS
    if by_block:
        kept, n = blocks.made(pairs, n_pairs)
        state, moved = _settled_blocks(kept, n, level, resolution, n == 1 and tasks_for(n_pairs) == 1)
        found = written(blocks.members(state), "louvain-nodes")
        smaller = blocks.contracted(kept, state) if moved else None
    else:
        n_tasks = tasks_for(n_pairs)
        kept = dealt(pairs, "b", n_tasks)
        hubs = hot_keys(kept, "b")
        found, moved = _settled(kept, level, resolution, hubs, n_tasks)
        ends = [found.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in ("a", "b")]
        if moved:
            inner = join_spread(join_spread(kept, "b", ends[1], hubs), "a", ends[0], hubs if hubs is None else hubs.withColumnRenamed("b", "a"))
            smaller = inner.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))
    told = observed(smaller, "louvain-pairs", n=F.count(F.lit(1))) if moved else None
    kept.unpersist()
    return found, told


def _settled_blocks(kept: DataFrame, n: int, level: int, resolution: float, one_task: bool) -> tuple[DataFrame, bool]:
    """As ``_settled``, over blocks: the best state met, and whether any node moved."""
    total = kept.agg(F.sum("strength")).first()[0]
    if not total:
        return blocks.alone(kept), False
    if one_task:
        state, told = observed(blocks.settled(kept, level, resolution, total, _best), "louvain-state", moved=F.max("_go"))
        return state, bool(told["moved"])

    def turn(state: DataFrame, round_: int) -> tuple[DataFrame, int, float, float]:
        after, told = observed(blocks.moved(kept, state, n, level, round_, resolution, total), "louvain-round", inside=F.sum("inside"), squares=F.sum("squares"), moves=F.sum("_go"))
        return after, told["moves"], told["inside"], told["squares"]

    return _best(blocks.alone(kept), turn, total, resolution)


def _best(state, turn: Callable, total: float, resolution: float):
    """The best state that rounds meet, from ``state`` on, and whether any node moved; ``turn`` gives the next one, moves, and what the last is worth."""
    best, best_q, before, moved, moves_before = state, None, None, False, 1
    for round_ in range(ROUNDS + 1):
        after, moves, inside, squares = turn(state, round_)
        q = inside / total - resolution * squares / total**2
        if best_q is None or q > best_q + 1e-12:
            best, best_q = state, q
        idle = not moves and not moves_before
        stale = round_ % 2 == 0 and before is not None and q - before < WORTH
        if round_ % 2 == 0:
            before = q
        moved, moves_before = moved or bool(moves), moves
        if idle or stale:
            break
        state = after
    return best, moved


def louvain(edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = "weight", resolution: float = 1.0) -> DataFrame:
    """(node, community): communities of greatest modularity found by local moves and contraction; a community is named by its least node.

    ``edges``: (source, target[, weight]), weights not negative. ``nodes`` (node): nodes without edges are communities of their own;
    edges to what is no node are left out. Same input, same result, whatever the partitions. An empty graph
    gives no rows.
    """
    if nodes is not None:
        known = nodes.select("node").where("node IS NOT NULL").distinct()
        edges = edges.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")
    pairs, seen = observed(both_ends(edges, weight), "louvain-pairs", n=F.count(F.lit(1)))
    members = None  # (node, community) of the nodes of the first level
    for level in range(LEVELS):
        found, smaller = _level(pairs, seen["n"], level, resolution)
        if members is None:
            members = found
        elif smaller is not None:
            # a community is a node of the next level; a giant one has many members
            held = members.withColumnRenamed("community", "up")
            up = join_spread(held, "up", found.select(F.col("node").alias("up"), "community"), hot_keys(held, "up"))
            members = written(up.select("node", "community"), "louvain-members")
            discard(held)
        if smaller is None:
            break
        discard(pairs)
        pairs, seen = smaller
    least = members.groupBy("community").agg(F.min("node").alias("least"))
    named = join_spread(members, "community", least, hot_keys(members, "community")).select("node", F.col("least").alias("community"))
    if nodes is not None:
        named = named.unionByName(known.join(named, "node", "left_anti").select("node", F.col("node").alias("community")))
    return named


def _most_voted(told: DataFrame, own: DataFrame) -> DataFrame:
    votes = told.groupBy("a", "label").agg(F.round(F.sum("w"), 9).alias("w")).join(own, "a")
    return votes.groupBy("a").agg(F.first("own").alias("own"), F.min(F.struct((-F.col("w")).alias("w"), (F.col("label") != F.col("own")).alias("other"), "label"))["label"].alias("label"))


def label_propagation(edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """(node, community): each node takes the label with most weight among its neighbours' until none changes, in ``sweeps`` sweeps at most.

    A sweep is two rounds, one for each half of the nodes, the second one seeing what the first did; ties go to the
    node's own label, then to the least. A node's edges to itself don't count. Named, and with ``nodes``, as ``louvain``.
    """
    if nodes is not None:
        known = nodes.select("node").where("node IS NOT NULL").distinct()
        edges = edges.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")
    table, seen = observed(both_ends(edges, weight).where("a <> b"), "label-pairs", n=F.count(F.lit(1)))
    n_tasks = tasks_for(seen["n"])
    pairs = dealt(table, "b", n_tasks)
    hubs = hot_keys(pairs, "b")
    labels = written(pairs.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    for sweep in range(sweeps):
        changed = 0
        for half in (0, 1):
            told = join_spread(pairs, "b", labels.select(F.col("node").alias("b"), "label"), hubs)
            best = _by_node(told, labels.select(F.col("node").alias("a"), F.col("label").alias("own")), hubs, n_tasks, _most_voted)
            go = _turn("a", 0, 2 * sweep + half) & (F.col("label") != F.col("own"))
            new, seen = observed(best.select(F.col("a").alias("node"), F.when(go, F.col("label")).otherwise(F.col("own")).alias("label"), go.alias("_go")), "labels", n=F.count_if("_go"))
            changed += seen["n"]
            discard(labels)
            labels = new.select("node", "label")
        if not changed:
            break
    pairs.unpersist()
    discard(table)
    least = labels.groupBy("label").agg(F.min("node").alias("community"))
    named = join_spread(labels, "label", least, hot_keys(labels, "label")).select("node", "community")
    if nodes is not None:
        named = named.unionByName(known.join(named, "node", "left_anti").select("node", F.col("node").alias("community")))
    return named


def described(members: DataFrame, edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(community, member_count, internal, cohesion, top_node) of ``members`` (node, community).

    internal: edges (rows) with both ends inside; cohesion: internal by the number of pairs, or by 1 if that is
    less, to three places; top_node: the member with the greatest ``sizes`` (node, size; 1 if absent), ties to the least.
    """
    ends = [members.select(F.col("node").alias(x), F.col("community").alias(f"in_{x}")) for x in ("source", "target")]
    inside = edges.select("source", "target").join(ends[0], "source").join(ends[1], "target").where("in_source = in_target").groupBy(F.col("in_source").alias("community")).agg(F.count(F.lit(1)).alias("internal"))
    sized = members.withColumn("size", F.lit(1).cast("long")) if sizes is None else members.join(sizes.select("node", F.col("size").cast("long").alias("size")), "node", "left").fillna(1, ["size"])
    found = sized.groupBy("community").agg(F.count(F.lit(1)).alias("member_count"), F.min(F.struct((-F.col("size")).alias("s"), "node"))["node"].alias("top_node"))
    n = F.col("member_count").cast("double")
    internal = F.coalesce("internal", F.lit(0)).cast("long")
    return found.join(inside, "community", "left").select("community", "member_count", internal.alias("internal"), F.round(internal / F.greatest(F.lit(1.0), n * (n - 1) / 2), 3).alias("cohesion"), "top_node")
