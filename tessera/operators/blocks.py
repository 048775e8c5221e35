"""Local moves of Louvain's method over blocks: the pairs of many nodes as arrays in one row, which stays where it is.

A round sends, from block to block, what nodes tell their neighbours: each node once to each block that holds one.
Which nodes these are is known to both blocks from their pairs, so only values are sent, in the order of the nodes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.shared import dealt, written

#: Pairs of a block, which a task holds as arrays.
BLOCK_PAIRS = 500_000

_STATE = "p int, nodes binary, k binary, community binary, _go long, inside double, squares double"
_LONG, _INT, _REAL = np.int64, np.int32, np.float64
_PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _read(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind)


def _mixed(h: np.ndarray, turn: int, by: int, add: np.uint64) -> np.ndarray:
    h = ((h << np.uint64(turn)) | (h >> np.uint64(64 - turn))) * _PRIMES[by] + add
    h = (h ^ (h >> np.uint64(33))) * _PRIMES[1]
    h = (h ^ (h >> np.uint64(29))) * _PRIMES[2]
    return h ^ (h >> np.uint64(32))


def hashed(first: int, second: int, nodes: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two ints and a long, as unsigned."""
    p1, p2, p3, p4, p5 = _PRIMES
    h = np.array([42], dtype=np.uint64)
    for x in (first, second):
        h = _mixed((h + p5 + np.uint64(4)) ^ (np.array([x], dtype=np.uint64) * p1), 23, 1, p3)
    x = nodes.astype(np.uint64) * p2
    return _mixed((h + p5 + np.uint64(8)) ^ (((x << np.uint64(31)) | (x >> np.uint64(33))) * p1), 27, 0, p4)


def made(pairs: DataFrame, n_pairs: int) -> tuple[DataFrame, int]:
    """``pairs`` (a, b, w) in both directions as blocks kept by the executors, and how many; unpersist() ends that."""
    n = max(1, -(-n_pairs // BLOCK_PAIRS))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, w, there = (frame[c].to_numpy() for c in ("a", "b", "w", "there"))
        order = np.lexsort((b, a))
        a, b, w, there = a[order], b[order], w[order], there[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        nodes, row = a[first], np.repeat(np.arange(len(first), dtype=_INT), np.diff(np.r_[first, len(a)]))
        # what comes in: the neighbours by block and node
        by = np.lexsort((b, there))
        new = np.r_[True, (b[by][1:] != b[by][:-1]) | (there[by][1:] != there[by][:-1])]
        at = np.empty(len(b), dtype=_INT)
        at[by] = np.cumsum(new) - 1
        # what goes out: to each block the nodes that have a neighbour there
        out = np.unique(there.astype(_LONG) * len(nodes) + row)
        ends = np.searchsorted(out, np.arange(n + 1, dtype=_LONG) * len(nodes))
        k = np.add.reduceat(w, first)
        arrays = (nodes, k, row, at, w, np.flatnonzero(a == b).astype(_INT), (out % len(nodes)).astype(_INT), ends.astype(_INT))
        return pd.DataFrame([(int(frame["p"].iloc[0]), float(k.sum()), *(x.tobytes() for x in arrays))], columns=names)

    names = ["p", "strength", "nodes", "k", "row", "at", "w", "loops", "out", "ends"]
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = pairs.select(of("a").alias("p"), "a", "b", "w", of("b").alias("there"))
    grouped = rows.repartition(n, "p").groupBy("p").applyInPandas(block, "p int, strength double, " + ", ".join(f"{c} binary" for c in names[2:]))
    return dealt(written(grouped, "louvain-blocks"), "p", n), n


def alone(kept: DataFrame) -> DataFrame:
    """The state of blocks whose nodes are communities of their own."""
    return kept.select("p", "nodes", "k", F.col("nodes").alias("community"))


def _strengths(state: DataFrame, n: int) -> DataFrame:
    """(block, src, x, y): to each block the communities it has nodes of and how strong they are, from the parts of all blocks."""

    def parts(frames):
        for frame in frames:
            for p, raw_k, raw in frame[["p", "k", "community"]].itertuples(index=False):
                names, at = np.unique(_read(raw, _LONG), return_inverse=True)
                sums = np.bincount(at, weights=_read(raw_k, _REAL), minlength=len(names))
                owner = (hashed(0, 0, names) % np.uint64(n)).astype(_INT)
                yield pd.DataFrame([(int(q), p, names[owner == q].tobytes(), sums[owner == q].tobytes()) for q in np.unique(owner)], columns=["owner", "p", "x", "y"])

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p")
        parts = [_read(x, _LONG) for x in frame["x"]]
        names, at = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([_read(y, _REAL) for y in frame["y"]]), minlength=len(names))
        ends = np.cumsum([0, *map(len, parts)])
        told = [(p, 0, frame["x"].iloc[j], sums[at[ends[j] : ends[j + 1]]].tobytes(), 0.0) for j, p in enumerate(frame["p"])]
        told[0] = (*told[0][:4], float((sums * sums).sum()))
        return pd.DataFrame(told, columns=["block", "src", "x", "y", "squares"])

    rows = state.mapInPandas(parts, "owner int, p int, x binary, y binary")
    return rows.groupBy("owner").applyInPandas(summed, "block int, src int, x binary, y binary, squares double")


def _told(kept: DataFrame, state: DataFrame, answers: DataFrame | None) -> DataFrame:
    """(a, src, x, y, squares): what a block tells block a of its nodes, their community (x) and how strong that is (y); to itself (src -1) of all."""

    def tell(block: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        p, out, ends = int(block["p"].iloc[0]), _read(block["out"].iloc[0], _INT), _read(block["ends"].iloc[0], _INT)
        own = heard["src"] == -1
        community, known = _read(heard["x"][own].iloc[0], _LONG), heard[~own]
        strength = np.zeros(len(community))
        if len(known):
            names, values = np.concatenate([_read(x, _LONG) for x in known["x"]]), np.concatenate([_read(y, _REAL) for y in known["y"]])
            order = np.argsort(names)
            strength = values[order][np.searchsorted(names[order], community)]
        rows = [(p, -1, community.tobytes(), strength.tobytes(), float(heard["squares"].sum()))]
        for q in np.flatnonzero(np.diff(ends)):
            some = out[ends[q] : ends[q + 1]]
            rows.append((int(q), p, community[some].tobytes(), strength[some].tobytes(), 0.0))
        return pd.DataFrame(rows, columns=["a", "src", "x", "y", "squares"])

    own = state.select(F.col("p").alias("block"), F.lit(-1).alias("src"), F.col("community").alias("x"), F.col("k").alias("y"), F.lit(0.0).alias("squares"))
    heard = own if answers is None else own.unionByName(answers)
    return kept.select("p", "out", "ends").groupBy("p").cogroup(heard.groupBy("block")).applyInPandas(tell, "a int, src int, x binary, y binary, squares double")


def _heard(heard: pd.DataFrame, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's own communities and strengths, and those of each pair's other end."""
    heard = heard.sort_values("src")
    x, y = [_read(v, _LONG) for v in heard["x"]], [_read(v, _REAL) for v in heard["y"]]
    return x[0], y[0], np.concatenate(x[1:])[at], np.concatenate(y[1:])[at]


def _round(nodes, k, row, w, loops, own, held, to, strength, level: int, round_: int, resolution: float, total: float) -> tuple[np.ndarray, int, float]:  # noqa: PLR0913
    """Where a block's nodes are after a round, how many of them moved, and the weight inside before it."""
    other = w.copy()
    other[loops] = 0.0
    order = np.lexsort((to, row))
    row, to = row[order], to[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (to[1:] != to[:-1])])
    inside, w = np.add.reduceat(w[order], first), np.add.reduceat(other[order], first)
    row, to, strength = row[first], to[first], strength[order][first]
    home = to == own[row]
    gain = np.round(w - resolution * k[row] * (strength - np.where(home, k[row], 0.0)) / total, 9)
    stay = np.round(-resolution * k * (held - k) / total, 9)
    stay[row[home]] = gain[home]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    most = np.maximum.reduceat(gain, start)
    top = np.flatnonzero(gain == most[row])  # the first of a node is the least community
    best = to[top[np.r_[True, row[top][1:] != row[top][:-1]]]]
    go = (hashed(level, round_ // 2, nodes) % np.uint64(2) == round_ % 2) & (most > stay)
    return np.where(go, best, own), int(go.sum()), float(inside[home].sum())


def moved(kept: DataFrame, state: DataFrame, n: int, level: int, round_: int, resolution: float, total: float) -> DataFrame:
    """The state after a round, with the moves in it, and the weight inside and squared strengths before it."""

    def move(block: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        nodes, k, row, w, loops = _read(b["nodes"], _LONG), _read(b["k"], _REAL), _read(b["row"], _INT), _read(b["w"], _REAL), _read(b["loops"], _INT)
        own, held, to, strength = _heard(heard, _read(b["at"], _INT))
        after, moves, inside = _round(nodes, k, row, w, loops, own, held, to, strength, level, round_, resolution, total)
        return pd.DataFrame([(int(b["p"]), b["nodes"], b["k"], after.tobytes(), moves, inside, float(heard["squares"].sum()))], columns=names)

    names = ["p", "nodes", "k", "community", "_go", "inside", "squares"]
    told = _told(kept, state, _strengths(state, n))
    return kept.drop("strength", "out", "ends").groupBy("p").cogroup(told.groupBy("a")).applyInPandas(move, _STATE)


def settled(kept: DataFrame, level: int, resolution: float, total: float, rule: Callable) -> DataFrame:
    """The best state that ``rule`` meets in the rounds of a single block, all of them in its task; _go says whether any node moved."""

    def run(frames):
        for frame in frames:
            for b in frame.to_dict("records"):
                nodes, k, row, at, w, loops = (_read(b[c], kind) for c, kind in (("nodes", _LONG), ("k", _REAL), ("row", _INT), ("at", _INT), ("w", _REAL), ("loops", _INT)))

                def turn(own, round_):
                    names, of = np.unique(own, return_inverse=True)  # noqa: B023
                    sums = np.bincount(of, weights=k, minlength=len(names))  # noqa: B023
                    held = sums[of]
                    after, moves, inside = _round(nodes, k, row, w, loops, own, held, own[at], held[at], level, round_, resolution, total)  # noqa: B023
                    return after, moves, inside, float((sums * sums).sum())

                best, moved = rule(nodes, turn, total, resolution)
                yield pd.DataFrame([(b["p"], b["nodes"], b["k"], best.tobytes(), int(moved), 0.0, 0.0)], columns=["p", "nodes", "k", "community", "_go", "inside", "squares"])

    return kept.mapInPandas(run, _STATE)


def contracted(kept: DataFrame, state: DataFrame) -> DataFrame:
    """(a, b, w): the weight between two communities, in both directions."""

    def sums(block: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        own, _, to, _ = _heard(heard, _read(b["at"], _INT))
        w, of = _read(b["w"], _REAL), own[_read(b["row"], _INT)]
        order = np.lexsort((to, of))
        of, to = of[order], to[order]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (to[1:] != to[:-1])])
        return pd.DataFrame({"a": of[first], "b": to[first], "w": np.add.reduceat(w[order], first)})

    told = _told(kept, state, None)
    return kept.select("p", "row", "at", "w").groupBy("p").cogroup(told.groupBy("a")).applyInPandas(sums, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))


def members(state: DataFrame) -> DataFrame:
    """(node, community) of a state."""

    def rows(frames):
        for frame in frames:
            for nodes, community in frame[["nodes", "community"]].itertuples(index=False):
                yield pd.DataFrame({"node": _read(nodes, _LONG), "community": _read(community, _LONG)})

    return state.select("nodes", "community").mapInPandas(rows, "node long, community long")
