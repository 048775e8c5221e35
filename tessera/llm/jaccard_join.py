"""Exact Jaccard self-join of documents' n-gram sets, by prefix trees, down to components.

All sets follow one global order: the most frequent n-grams first, in order of frequency,
then all others by hash. Two sets that are similar enough share an n-gram among the last ones of
each (prefix filtering, at the rare end), so documents meet in lists by these. A prefix tree over
the sets of a list, from the frequent end, shares the overlaps that its documents have in common;
a search of it drops a subtree once what is left of either set can't reach the needed overlap.

Bitmaps of the sets tell, without a miss, which documents of a list can't be similar; only the sets of
the others are looked up. Lists are joined twice: first each document of a list with the list's most common one, which links
groups of copies without looking at their pairs; then, in lists that still hold several components,
documents of different components, in blocks. No link between different sets is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.common import stash, text_batches
from tessera.operators import shared
from tessera.operators.graph import connected_components

#: N-grams that the global order sorts by frequency: at most so many, which bounds the broadcast.
FREQUENT = 1 << 18
#: Rows of one n-gram's list that a task holds; a longer list leaves in portions, under one name.
PORTION = 1_000_000
#: Documents of a list that a task joins at once; longer lists are joined block by block.
BLOCK = 1024


def needed(x, y, percent: int):
    """The least overlap o of sets of sizes x and y with 100 * o >= percent * (x + y - o)."""
    return -(-(x + y) * percent // (100 + percent))


def signature(n, percent: int):
    """So many rare n-grams of a set of n suffice to meet every similar set."""
    return n - (-(-n * percent // 100)) + 1


def _sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The set of each text, sorted by hash: distinct windows of words, or all words if fewer."""
    hashes, at = hashing.words(texts, lower=True)
    every = hashing.shingles(hashes, width)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(hashing.mix(hashing.shingles(hashes[a:b], int(b - a)) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _key(found: np.ndarray) -> int:
    """64 bits that stand for a set; equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _ordered(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the global order: ranks of frequent n-grams, then the others' hashes, ascending."""
    at = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
    hit = frequent[at] == found if len(frequent) else np.zeros(len(found), bool)
    return np.concatenate([np.sort(rank[at[hit]]), np.sort(found[~hit] | np.uint64(1 << 63))])


def _sketch(found: np.ndarray) -> bytes:
    """A bitmap of a set: one bit for each n-gram's leading bits, two bits or more for each n-gram."""
    width = max(6, int(2 * len(found) - 1).bit_length()) if len(found) else 6
    bits = np.zeros(1 << width, bool)
    bits[(hashing.mix(found) >> np.uint64(64 - width)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """A sketch as if made with fewer bits."""
    bits = np.unpackbits(sketch)
    return np.packbits(bits.reshape(width, -1).any(axis=1))


def plausible(x: bytes, n: int, others: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which other sets may be similar to x: every bit of one that the other lacks is an n-gram that it lacks."""
    out = np.zeros(len(others), bool)
    for width in {len(o) for o in others}:
        at = np.array([k for k, o in enumerate(others) if len(o) == width])
        a, b = np.frombuffer(x, np.uint8), np.frombuffer(b"".join(others[k] for k in at), np.uint8).reshape(len(at), width)
        if len(a) > width:
            a = _folded(a, width * 8)
        elif len(a) < width:
            b = np.stack([_folded(r, len(a) * 8) for r in b])
        least = needed(n, sizes[at], percent)
        out[at] = (n - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64) >= least) & (sizes[at] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64) >= least)
    return out


class Trie:
    """A prefix tree of ordered sets; a node holds a run of elements that all sets below it share."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.root = [None, [], [], 0, 0]  # elements, rows that end here, children, least and largest size below
        todo = [(list(range(len(sets))), 0, self.root)] if sets else []
        while todo:
            rows, depth, node = todo.pop()
            sizes = [len(sets[k]) for k in rows]
            first, end = sets[rows[0]], min(sizes)
            for k in rows[1:]:
                if end <= depth:
                    break
                differ = np.flatnonzero(first[depth:end] != sets[k][depth:end])
                end = depth + int(differ[0]) if len(differ) else end
            node[0], node[3], node[4] = first[depth:end], min(sizes), max(sizes)
            groups: dict[int, list[int]] = {}
            for k, n in zip(rows, sizes, strict=True):
                if n == end:
                    node[1].append(k)
                else:
                    groups.setdefault(int(sets[k][end]), []).append(k)
            for found in groups.values():
                node[2].append(child := [None, [], [], 0, 0])
                todo.append((found, end, child))

    def search(self, probe: np.ndarray, percent: int):
        """Rows whose sets are similar to ``probe``."""
        n = len(probe)
        todo = [(self.root, 0, 0, 0)] if self.sets else []
        while todo:
            node, depth, at, overlap = todo.pop()
            run, ends, children, least, most = node
            if most * 100 < percent * n or least * percent > n * 100:
                continue
            if overlap + min(n - at, most - depth) < needed(n, max(least, -(-n * percent // 100)), percent):
                continue
            if len(run):
                stop = int(np.searchsorted(probe, run[-1], "right"))
                part = probe[at:stop]
                if len(part):
                    overlap += int((part[np.minimum(np.searchsorted(part, run), len(part) - 1)] == run).sum())
                at, depth = stop, depth + len(run)
            if ends and overlap >= needed(n, depth, percent):
                yield from ends
            todo.extend((child, depth, at, overlap) for child in children)


def frequent_grams(counts: DataFrame) -> np.ndarray:
    """The n-grams of (id, n) above the least count that leaves FREQUENT of them at most, most frequent first.

    The count is found by adding up how many n-grams have each binary logarithm of a count, in 64ths.
    """
    level = F.floor(F.log2("n") * 64).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True)  # some thousand levels at most
    upto = np.cumsum([m for _, m in sizes])
    fit = [lev for (lev, _), m in zip(sizes, upto, strict=True) if m <= FREQUENT]
    if not fit:
        return np.zeros(0, np.uint64)
    top = counts.where(level >= fit[-1]).toPandas().sort_values(["n", "id"], ascending=[False, True])
    return top["id"].to_numpy(np.int64).view(np.uint64)


def forest(links) -> dict[int, int]:
    """The smallest node that ``links`` (a, b) lead to, of each node of theirs."""
    up: dict[int, int] = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def components(links: DataFrame, n_links: int) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for all linked nodes.

    Tasks of TASK_ROWS links at most put a star in place of each tree of links, so rounds over all
    tasks' stars join only what several tasks have found; a single task's stars are the components.
    """
    n_tasks, most = shared.tasks_for(n_links), shared.TASK_ROWS

    def stars(frames):
        held, size = [], 0

        def out():
            found = forest(row for f in held for row in zip(f["a"].tolist(), f["b"].tolist(), strict=True))
            return pd.DataFrame({"node": list(found), "component": list(found.values())}, dtype="int64")

        for frame in frames:
            for part in (frame.iloc[k : k + most] for k in range(0, len(frame), most)):
                if held and size + len(part) > most:
                    yield out()
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield out()

    found = links.select("a", "b").coalesce(n_tasks).mapInPandas(stars, "node long, component long")
    if n_tasks == 1:
        return stash(found, "jaccard-components")
    return connected_components(found.select(F.col("node").alias("source"), F.col("component").alias("target")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, portion: int = PORTION) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (the smallest id reachable).

    Words are runs of anything but ASCII white space, A-Z in lower case. A set holds the distinct
    windows of ``width`` words, or the whole sequence if there are fewer words; a null text or one
    without words has an empty set, which is linked with nothing, not even its like. Sets are linked
    when 100 * intersection >= percent * union. Rows with equal sets are one node. Null ids keep
    their row; their component_id is the smallest id linked, or null. Repeated ids keep their rows. Ids may be
    of any type that has an order. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = both.schema["id"].dataType.simpleString()

    def survey(batches):
        """A row for each document, and n-grams that different sets of this task share, in bounded portions."""
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def made(kind, ids, grams, nodes, sizes, sketches):
            columns = [pa.array([kind] * len(ids), pa.int32()), ids, *(pa.array(x, pa.int64()) for x in (grams, nodes, sizes)), pa.array(sketches, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "id", "gram", "node", "n", "sketch"])

        def counted():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n > 1].view(np.int64), n[n > 1]
            return made(1, pa.nulls(len(n), batch.column(0).type), found, np.zeros(len(n), np.int64), n, [b""] * len(n))

        for batch in batches:
            for start, texts in text_batches(batch.column(1).to_pylist()):
                sets = _sets(texts, width)
                keys = [_key(x) for x in sets]
                yield made(0, batch.column(0).slice(start, len(texts)), [0] * len(texts), keys, [len(x) for x in sets], [_sketch(x) for x in sets])
                for key, found in zip(keys, sets, strict=True):
                    if len(found) and key not in seen:
                        seen.add(key)
                        held.append(found)
                        size += len(found)
                if size > 6_000_000:
                    yield counted()
                    held, size, seen = [], 0, set()
        if held:
            yield counted()

    seen = stash(both.mapInArrow(survey, f"kind int, id {id_type}, gram long, node long, n long, sketch binary"), "jaccard-survey")
    rows = seen.where("kind = 0").select("id", "node", F.col("n").alias("n_shingles"))
    counts = stash(seen.where("kind = 1").groupBy(F.col("gram").alias("id")).agg(F.sum("n").alias("n")), "jaccard-counts")
    grams = frequent_grams(counts)
    sort = np.argsort(grams)
    order = spark.sparkContext.broadcast((grams[sort], np.arange(len(grams), dtype=np.uint64)[sort]))

    def rare_grams(frames):
        """The rare n-grams of each set that is new to the task, with the set's size and number of unranked n-grams."""
        frequent, rank = order.value
        seen: set[int] = set()
        for frame in frames:
            for _, texts in text_batches(frame["text"]):
                out, about = [], []
                for found in _sets(texts, width):
                    if len(found) and (key := _key(found)) not in seen:
                        seen.add(key)
                        full = _ordered(found, frequent, rank)
                        out.append(full[-signature(len(full), percent) :])
                        about.append((key, len(full), int((full >> np.uint64(63)).sum())))
                if out:
                    many = np.repeat(np.array(about, np.int64), [len(g) for g in out], axis=0)
                    yield pd.DataFrame({"gram": np.concatenate(out).view(np.int64), "node": many[:, 0], "size": many[:, 1].astype(np.int32), "rare": many[:, 2].astype(np.int32)})
                if len(seen) > 1_000_000:
                    seen = set()

    def lists(frames):
        """Lists of at least two sets near enough in size, each list of members once in a task."""
        made: set[int] = set()
        rest = None
        split = None  # the n-gram whose list has left in part

        def parted(part):
            return pd.DataFrame({"list": hashing.mix(part["gram"].to_numpy().view(np.uint64)).view(np.int64)} | {k: part[k].to_numpy() for k in ("node", "size", "rare")})

        def out(part):
            gram, size = part["gram"].to_numpy(), part["size"].to_numpy(np.int64)
            apart = np.concatenate([[True], (gram[1:] != gram[:-1]) | (size[1:] * percent > size[:-1] * 100)])
            run = np.cumsum(apart) - 1
            begin = np.flatnonzero(apart)
            mixed = hashing.mix(part["node"].to_numpy(np.int64).view(np.uint64))
            name = hashing.mix(np.add.reduceat(mixed, begin)).view(np.int64)
            long = np.diff(np.append(begin, len(part))) > 1
            for k in np.flatnonzero(long):
                long[k] = int(name[k]) not in made
                made.add(int(name[k]))
            if len(made) > 1_000_000:
                made.clear()
            keep = long[run]
            return pd.DataFrame({"list": name[run[keep]], "node": part["node"].to_numpy()[keep], "size": part["size"].to_numpy()[keep], "rare": part["rare"].to_numpy()[keep]})

        for frame in frames:
            same = np.concatenate([[True], (np.diff(frame["gram"].to_numpy()) != 0) | (np.diff(frame["node"].to_numpy()) != 0)])
            frame = frame[same]
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if split is not None:  # what still comes of a list that left in part goes under the same name
                more = int(np.searchsorted(rest["gram"].to_numpy(), split, "right"))
                if more:
                    yield parted(rest.iloc[:more])
                    rest = rest.iloc[more:]
                if not len(rest):
                    continue
                split = None
            edge = int(np.searchsorted(rest["gram"].to_numpy(), rest["gram"].iloc[-1]))
            if edge:
                yield out(rest.iloc[:edge].drop_duplicates(["gram", "node"]))
                rest = rest.iloc[edge:]
            if len(rest) > portion:  # a list beyond what a task should hold leaves in portions under the name of its n-gram
                split = int(rest["gram"].iloc[-1])
                yield parted(rest)
                rest = rest.iloc[:0]
        if rest is not None and len(rest):
            yield out(rest.drop_duplicates(["gram", "node"]))

    entries = both.mapInPandas(rare_grams, "gram long, node long, size int, rare int").repartition("gram").sortWithinPartitions("gram", "size", "node")
    listed = entries.mapInPandas(lists, "list long, node long, size int, rare int").groupBy("list", "node").agg(F.first("size").alias("size"), F.first("rare").alias("rare"))
    listed = stash(listed, "jaccard-lists")

    def ordered_sets(frames):
        frequent, rank = order.value
        for frame in frames:
            for _, texts in text_batches(frame["text"]):
                sets = _sets(texts, width)
                yield pd.DataFrame({"node": [_key(x) for x in sets], "grams": [_ordered(x, frequent, rank).astype("<u8").tobytes() for x in sets]})

    met = listed.select("node").distinct()
    # copies of one text share a node, so they are put together before they meet
    sketches = seen.where("kind = 0").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.min("id").alias("id")).join(met, "node", "left_semi")
    sketches = stash(sketches, "jaccard-sketches")

    def whole_cells(frames):
        """The cells of a sorted partition, each in one frame."""
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            cell = rest["cell"].to_numpy()
            edge = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
            if edge:
                yield from (part for _, part in rest.iloc[:edge].groupby("cell", sort=False))
                rest = rest.iloc[edge:]
        if rest is not None and len(rest):
            yield from (part for _, part in rest.groupby("cell", sort=False))

    def hopeful(frames):
        """The rows of each cell that may be similar to a row of another component on the other side."""
        out = []
        for cell in whole_cells(frames):
            side, comp, n = cell["side"].to_numpy(), cell["comp"].to_numpy(), cell["n"].to_numpy()
            marks = cell["sketch"].tolist()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            keep = np.zeros(len(cell), bool)
            others = [marks[k] for k in right]
            for k in left:
                hit = plausible(marks[k], int(n[k]), others, n[right], percent) & (comp[right] != comp[k])
                keep[right[hit]] = True
                keep[k] |= hit.any()
            if keep.any():
                out.append(cell.loc[keep, ["cell", "side", "node", "comp"]])
            if len(out) > 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, grams in the global order), from one document of each node."""
        wanted = sketches.where("id is not null").join(nodes, "node", "left_semi").select("id")
        wanted = stash(wanted, "jaccard-wanted")  # written, so that its size decides how it is joined
        texts = both.join(wanted, "id", "left_semi").unionByName(both.where("id is null"))
        made = texts.mapInPandas(ordered_sets, "node long, grams binary").join(nodes, "node", "left_semi")
        return made.groupBy("node").agg(F.first("grams").alias("grams"))

    def found_links(frames):
        """Links between the two sides of each cell, at most one to each component for each row."""
        out: dict[tuple[int, int], None] = {}
        for cell in whole_cells(frames):
            left = cell[cell["side"] == 0]
            trie = Trie([np.frombuffer(g, "<u8") for g in left["grams"]])
            nodes, comps = left["node"].tolist(), left["comp"].tolist()
            right = cell[cell["side"] == 1]
            for node, comp, grams in zip(right["node"].tolist(), right["comp"].tolist(), right["grams"], strict=True):
                hits = {comps[k]: nodes[k] for k in trie.search(np.frombuffer(grams, "<u8"), percent) if comps[k] != comp}
                out.update({(min(node, x), max(node, x)): None for x in hits.values()})
            if len(out) > 10_000:
                yield pd.DataFrame(list(out), columns=["a", "b"])
                out = {}
        if out:
            yield pd.DataFrame(list(out), columns=["a", "b"])

    def links(cells):
        """Links of cells (cell, side, node, comp), over all pairs of side 0 and side 1."""
        order_of = ("cell", "side", "node")
        dealt = cells.join(sketches.select("node", "sketch", "n"), "node").repartition("cell").sortWithinPartitions(*order_of)
        left = stash(dealt.mapInPandas(hopeful, "cell long, side int, node long, comp long"), "jaccard-cells")
        sets = sets_of(left.select("node").distinct())
        whole = left.join(sets, "node").repartition("cell").sortWithinPartitions(*order_of)
        return whole.mapInPandas(found_links, "a long, b long").distinct()

    # first the most common set of each list against all others of its lists, in blocks
    hubs = listed.groupBy("list").agg(F.min(F.struct("rare", "node"))["node"].alias("hub"))
    pairs = listed.join(hubs, "list").where("hub <> node").select("hub", "node").distinct()
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    cells = pairs.join(blocks, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("node"), "blocks")).alias("cell"), F.lit(1).alias("side"), "node", F.col("node").alias("comp"))
    heads = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select(F.xxhash64("hub", "block").alias("cell"), F.lit(0).alias("side"), F.col("hub").alias("node"), F.col("hub").alias("comp"))
    first, seen_first = shared.observed(links(cells.unionByName(heads)), "jaccard-links", n=F.count(F.lit(1)))
    near = components(first, seen_first["n"])

    # then what still is apart: the sets outside a list's largest component against all of the list
    known = listed.join(near, "node", "left").select("list", "node", F.coalesce("component", "node").alias("comp"))
    sizes = known.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("list").agg(F.max(F.struct("n", "comp"))["comp"].alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1 and all > 2")
    apart = known.join(largest, "list").withColumn("outer", F.col("comp") != F.col("largest"))
    apart = apart.withColumns({"nr": F.ceil((F.col("all") - F.col("most")) / BLOCK), "ng": F.ceil(F.col("most") / BLOCK)})
    grid = apart.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("outer"), F.col("nr")).otherwise(F.col("ng"))))
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    left = grid.where("outer").select("list", "node", "comp", "own", F.explode(F.concat(F.transform(span(F.col("nr")), lambda k: F.struct(F.lit(1).alias("kind"), k.alias("other"))), F.transform(span(F.col("ng")), lambda k: F.struct(F.lit(0).alias("kind"), k.alias("other"))))).alias("to"))
    left = left.select(F.xxhash64("list", "own", "to.kind", "to.other").alias("cell"), F.lit(0).alias("side"), "node", "comp")
    right = grid.select("list", "node", "comp", "own", F.col("outer").cast("int").alias("kind"), F.explode(span(F.col("nr"))).alias("other"))
    right = right.select(F.xxhash64("list", "other", "kind", "own").alias("cell"), F.lit(1).alias("side"), "node", "comp")
    second = links(left.unionByName(right))
    second, seen_second = shared.observed(second, "jaccard-links", n=F.count(F.lit(1)))

    joined = components(first.unionByName(second), seen_first["n"] + seen_second["n"])
    named = rows.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least")).join(joined, "node", "left")
    named = named.select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("least_of_all"))
    named = named.join(smallest, "component").select("node", "least_of_all")
    out = rows.join(named, (rows["node"] == named["node"]) & (rows["n_shingles"] > 0), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least_of_all", "id").alias("component_id"))
