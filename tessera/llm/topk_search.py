"""Exact top-k search by a three-phase uniform threshold.

Vectors are cut into lists of components; a score is the sum of a vector's entries in all lists.
Queries go in groups of bounded size, which are broadcast; candidates are never shuffled. Phase one
gathers, from each task, the best entries among one row in HEAD of each list and the true scores of
their vectors; the k-th best of these is a safe cutoff for the query. Phase two
broadcasts the cutoffs; each task scores each list once, keeps it and collects the vectors with an
entry of at least cutoff / lists in some list: no other can reach the cutoff. Phase three fills in
the missing entries of these from the kept lists, and drops a vector once the rest can't lift it to
the cutoff. What leaves a task is at most k rows for each query.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import shared_dir, stash

#: Lists that the components are dealt to; one row in HEAD of each is looked at for the cutoff.
LISTS, HEAD = 4, 8
#: Queries that are broadcast at once, queries and candidates that a task scores at once: all bound memory.
QUERIES, CHUNK, RUN = 8192, 256, 8192
LEAST, MOST = -(2**63), 2**63 - 1


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector whose components are all finite numbers."""
    ok = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False)))


def whole_numbers(column: pa.ListArray, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors as rows, short ones filled with zeros: doubles, or Python's own numbers from 2**53 on."""
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) >= 2.0**53:  # such doubles are whole, so they can be scaled as integers
        scaled = np.array([int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.tolist()], object)
    out = np.zeros((len(sizes), width), scaled.dtype)
    out[np.arange(width) < sizes[:, None]] = scaled
    return out


def _alike(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both over their common components, in doubles where twice LISTS times every score is exact in these."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    most = [int(np.abs(x).max(initial=0)) for x in (q, c)]
    if 2 * LISTS * width * most[0] * most[1] < 2**53:
        return q.astype(float), c.astype(float)
    as_int = np.frompyfunc(int, 1, 1)
    return as_int(q).astype(object), as_int(c).astype(object)


def _parts(width: int) -> list[slice]:
    edges = [width * k // LISTS for k in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row."""
    if k >= scores.shape[1]:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argsort(-scores, axis=1)[:, :k] if scores.dtype == object else np.argpartition(-scores, k - 1, axis=1)[:, :k]


def head_scores(q: np.ndarray, ids: np.ndarray, c: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, list]:
    """Phase one: (query's place, score) of at most k different candidates for each query."""
    q, c = _alike(q, c)
    head = np.arange(0, len(c), HEAD)
    lists = [c[head, part].T for part in _parts(q.shape[1])]
    at, out = [], []
    for start in range(0, len(q), CHUNK):
        mine = q[start : start + CHUNK]
        found = [head[_best(mine[:, part].dot(some), k + 1)] for some, part in zip(lists, _parts(q.shape[1]), strict=True)]
        rows = np.sort(np.concatenate(found, axis=1), axis=1)
        total = (mine[:, None] * c[rows]).sum(axis=2)
        free = others[rows] != ids[start : start + CHUNK, None]
        free[:, 1:] &= rows[:, 1:] != rows[:, :-1]
        i, j = np.nonzero(free)
        score = total[i, j]
        order = np.lexsort((-score, i)) if score.dtype != object else np.array(sorted(range(len(i)), key=lambda x: (i[x], -score[x])), int)
        i, score = i[order], score[order]
        near = _place(i) < k
        at.append(i[near] + start)
        out += score[near].tolist()
    return np.concatenate([*at, np.zeros(0, int)]), out


def _place(groups: np.ndarray) -> np.ndarray:
    """Each row's place within its run of equal values."""
    fresh = np.concatenate([[True], groups[1:] != groups[:-1]])[: len(groups)]
    return np.arange(len(groups)) - np.maximum.accumulate(np.where(fresh, np.arange(len(groups)), 0))


def resolved(q: np.ndarray, ids: np.ndarray, cutoffs: np.ndarray, c: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Phases two and three: (query's place, candidate, score) of at most k candidates for each query, none below its cutoff."""
    q, c = _alike(q, c)
    parts = _parts(q.shape[1])
    at, ends, out = [], [], []
    for start in range(0, len(q), CHUNK):
        mine, cutoff = q[start : start + CHUNK] * LISTS, cutoffs[start : start + CHUNK]  # so shares of a cutoff stay whole
        open_ = np.array([x is None for x in cutoff], bool)
        share = np.array([0 if x is None else x for x in cutoff], mine.dtype)[:, None]
        lists = [mine[:, part].dot(c[:, part].T) for part in parts]
        wanted = np.zeros(lists[0].shape, bool)
        for entries in lists:
            wanted |= (entries >= share).astype(bool)
        # an entry below its share was not collected and counts as just that much until it is filled in
        bound = lists[0] + lists[1]
        for entries in lists[2:]:
            bound = bound + np.maximum(entries, share)
        wanted &= (bound >= share * LISTS).astype(bool)
        wanted |= open_[:, None]
        wanted &= others[None] != ids[start : start + CHUNK, None]
        i, j = np.nonzero(wanted)
        total = sum((entries[i, j] for entries in lists[1:]), lists[0][i, j])
        stay = (total >= share[i, 0] * LISTS).astype(bool) | open_[i]
        i, j, total = i[stay], j[stay], total[stay] // LISTS
        order = np.lexsort((others[j], -total, i)) if total.dtype != object else np.array(sorted(range(len(i)), key=lambda x: (i[x], -total[x], others[j[x]])), int)
        i, j, total = i[order], j[order], total[order]
        near = _place(i) < k
        at.append(i[near] + start)
        ends.append(others[j[near]])
        out += total[near].tolist()
    return np.concatenate([*at, np.zeros(0, int)]), np.concatenate([*ends, np.zeros(0, np.int64)]), out


def _long(scores: list) -> pa.Array:
    return pa.array([max(LEAST, min(MOST, int(s))) for s in scores], pa.int64())


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to smaller id.

    Components x count as floor(scale * x). ``is_query`` is a condition on the column ``id``; the
    candidates are all rows but those with the query's own id. Rows with a null id, a null vector, or
    a null or non-finite component take no part. Short vectors are filled with zeros, so an empty
    one scores 0. Queries with a repeated id are searched once (the smallest vector); repeated
    candidates each count. Fewer than k candidates give fewer rows, an empty table none. Scores are
    exact whatever their size; those beyond a long stop at its ends. Other columns are not read. The
    table is read twice for each group of QUERIES queries.
    """
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vector_col)
    asked = stash(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "search-queries")
    n_groups = max(1, -(-asked.count() // QUERIES))
    path = f"{shared_dir(spark)}/search-found-{uuid.uuid4().hex}"
    for group in range(n_groups):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_groups)) == group).toArrow().combine_chunks()  # about QUERIES rows
        ids = mine.column("id").to_numpy()
        vectors = mine.column("v").combine_chunks() if len(ids) else pa.array([], pa.list_(pa.float64()))
        told = spark.sparkContext.broadcast((ids, whole_numbers(vectors, scale)))

        def runs(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, RUN):
                    part = batch.slice(start, RUN)
                    column = part.column(1)
                    yield part.column(0).to_numpy(), whole_numbers(pa.ListArray.from_arrays(pa.array(column.offsets.to_numpy() - column.offsets[0].as_py(), pa.int32()), column.flatten()), scale)

        def gather(batches, told=told):
            ids, q = told.value
            for others, c in runs(batches):
                at, scores = head_scores(q, ids, c, others, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), _long(scores)], names=["id", "score"])

        best = Window.partitionBy("id").orderBy(F.desc("score"))
        heads = rows.mapInArrow(gather, "id long, score long").withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
        known = {r["id"]: r["score"] for r in heads.collect()}  # a row for each query of the group at most
        cutoffs = spark.sparkContext.broadcast([c if (c := known.get(i, LEAST)) > LEAST else None for i in ids.tolist()])

        def resolve(batches, told=told, cutoffs=cutoffs):
            ids, q = told.value
            for others, c in runs(batches):
                at, ends, scores = resolved(q, ids, cutoffs.value, c, others, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(ends, pa.int64()), _long(scores)], names=["query_id", "vec_id", "score"])

        rows.mapInArrow(resolve, "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        told.unpersist()
        cutoffs.unpersist()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
