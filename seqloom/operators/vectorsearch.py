"""Vector search: a stated set of queries against all rows, and similarity to references.

The searched rows stay where they are: queries go to them in slabs of bounded size, each task
keeps the best k rows of every query over all its batches, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors sent to the tasks at a time, and queries multiplied with a batch at a time.
SLAB_BYTES, TILE = 64 << 20, 1024


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))


def _matrix(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(ids), np.asarray(vectors.flatten(), np.float64).reshape(len(ids), -1)


def slabs(df: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of df in slabs of at most about SLAB_BYTES."""
    rows = _vectors(df, key, vector)
    size = rows.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    n = -(-size // SLAB_BYTES)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i)
        table = part.toArrow().combine_chunks()
        if table.num_rows:
            yield _matrix(table["id"].combine_chunks(), table["v"].combine_chunks())


def scores(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """A row per query, a column per searched row; -inf where a vector of length zero has no cosine; l2 scores are negative distances."""
    if metric == "l2":
        return -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * q @ b.T))
    norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    return np.divide(q @ b.T, norms, out=np.full(norms.shape, -np.inf), where=norms > 0)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query; what agrees to nine places is a tie, by id."""
    order = np.lexsort((ids, -np.round(score, 9), query))
    sorted_ = query[order]
    start = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(order) else order
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]


def searcher(slab, k: int, metric: str, itself: bool):
    """A mapInArrow function from (id, v): the k best rows of the task for each query of the slab."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, qv = slab.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            bi, bv = _matrix(batch.column(0), batch.column(1))
            parts = [held]
            for at in range(0, len(qi), TILE):
                s = scores(qv[at : at + TILE], bv, metric)
                if not itself:
                    s[qi[at : at + TILE, None] == bi[None, :]] = -np.inf
                r = np.round(s, 9)
                # Rows under the k-th best of the batch cannot count.
                least = np.partition(r, -k, axis=1)[:, -k] if k < r.shape[1] else np.full(len(r), -np.inf)
                q, b = np.nonzero((r >= least[:, None]) & (s > -np.inf))
                parts.append((q + at, bi[b], s[q, b]))
            q, i, s = (np.concatenate(c) for c in zip(*parts, strict=True))
            kept = best_of(q, i, s, k)
            held = (q[kept], i[kept], s[kept])
        yield pa.RecordBatch.from_arrays([pa.array(qi[held[0]], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())], names=["query", "id", "score"])

    return search


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", itself: bool = False) -> DataFrame:
    """query, id, score, rank: the k best rows of base for each query, ties by id; l2 scores are negative distances.

    base is scanned in place once per slab of queries; k rows per query and task are shuffled.
    Null ids and vectors are left out, and vectors of length zero have no cosine; a query does not find
    itself unless told. Without queries or rows the result is empty.
    """
    spark = base.sparkSession
    rows = _vectors(base, key, vector)
    schema = "query long, id long, score double"
    found = None
    for slab in slabs(queries, key, vector):
        one = rows.mapInArrow(searcher(spark.sparkContext.broadcast(slab), k, metric, itself), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= k)


def closest_reference(rows: DataFrame, key: str, vector: str, refs: DataFrame) -> DataFrame:
    """key, sim, ref of every row: the largest cosine to any reference, at least 0, and the first reference that has it (null if none is above 0).

    refs: the same key and vector columns, of any number; they go to the rows in slabs. Up to one
    slab the rows are not shuffled at all.
    """
    spark = rows.sparkSession

    def against(slab):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ri, rv = slab.value
            order = np.argsort(ri, kind="stable")
            ri, rv = ri[order], rv[order]
            for batch in batches:
                has = np.asarray(batch.column(1).is_valid())
                sim, ref = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                if has.any():
                    s = scores(_matrix(batch.column(0).filter(pa.array(has)), batch.column(1).filter(pa.array(has)))[1], rv, "cosine")
                    best = np.round(s, 9).argmax(1)  # the first of equals
                    sim[has], ref[has] = np.maximum(s[np.arange(len(s)), best], 0), ri[best]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sim), pa.array(ref, mask=sim <= 0)], names=[key, "sim", "ref"])

        return run

    each = rows.select(F.col(key).cast("long").alias(key), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    found, n = None, 0
    for slab in slabs(refs, key, vector):
        one = each.mapInArrow(against(spark.sparkContext.broadcast(slab)), f"{key} long, sim double, ref long")
        found, n = (one if found is None else found.unionByName(one)), n + 1
    if found is None:
        return each.select(key, F.lit(0.0).alias("sim"), F.lit(None).cast("long").alias("ref"))
    if n == 1:
        return found
    best = F.max(F.struct(F.round("sim", 9).alias("r"), -F.coalesce("ref", F.lit(2**62)).alias("o"), "sim", "ref"))
    return found.groupBy(key).agg(best.alias("b")).select(key, "b.sim", "b.ref")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, dim, mean: the mean vector of each group, summed by dimension before the shuffle."""
    return df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
