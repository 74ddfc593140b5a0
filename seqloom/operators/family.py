"""Families of sequences: profiles, links by exact cosine, average linkage, numbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import vectors
from seqloom.operators.graph import components
from seqloom.runtime import broadcast_within, cut, written

DIM = 256
#: Vectors of a block, of which every two of a part meet in one task, and rows of a block multiplied at a time.
BLOCK, TILE = 8000, 250
#: Points of a component that one task clusters, and points of small components that it takes together.
LOCAL, TOGETHER = 20_000, 2000
#: Rows of a narrow table (keys and labels) that are sent to all tasks rather than shuffling the vectors.
NARROW = 300_000
#: Sequences shorter than this are not embedded.
LEAST = 50


def profiles(rows: DataFrame, key: str, seq: str, *also: str) -> DataFrame:
    """key, the columns `also` (as numbers), v: unit vectors of signed hashed 3-letter counts, the stand-in for a language model's mean-pooled embedding.

    Like that model it takes sequences from 50 letters on; counting has no limit of length, so
    every sequence is read whole (the 1000 letters of a model are those of providers.embedded).
    A null or shorter sequence has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column(b.num_columns - 1).to_pylist():
                c = np.frombuffer(s.encode(), np.uint8).astype(np.uint32)
                w = (c[:-2] * 676 + c[1:-1] * 26 + c[2:]) * np.uint32(2654435761)
                v = np.bincount(w >> 24, np.where((w >> 23) & 1, 1.0, -1.0), DIM)
                out.append(v / max(np.sqrt((v * v).sum()), 1e-12))
            flat = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(0, DIM * len(out) + 1, DIM, dtype=np.int32)), pa.array(flat))], names=[key, *also, "v"])

    kept = rows.where(F.length(seq) >= LEAST).select(*(F.col(c).cast("long") for c in (key, *also)), F.col(seq).alias("s"))
    return kept.mapInArrow(run, ", ".join(f"{c} long" for c in (key, *also)) + ", v array<double>")


def _compact(v: np.ndarray) -> tuple[bytes, float, float]:
    """A vector in two bytes per dimension, its step, and the length of what rounding changed."""
    step = float(np.abs(v).max()) / 32767 or 1.0
    q = np.rint(v / step).astype(np.int16)
    return q.tobytes(), step, float(np.sqrt(((v - q * step) ** 2).sum()))


def _near(threshold: float):
    """An applyInPandas function: pairs of two blocks whose cosine may reach the threshold, and whether it surely does, judged on compact vectors.

    x.y differs from the product of the rounded vectors by at most e + f + e * f = (1 + e) * (1 + f) - 1 for
    unit vectors that rounding changed by e and f, so no pair at the threshold is dropped. 1 + e is
    one more dimension, so that the product holds the bound.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])

        def side(block: int):
            rows = pdf[pdf["block"] == block]
            q = np.frombuffer(b"".join(rows["q"]), np.int16).reshape(len(rows), DIM)
            v = np.empty((len(rows), DIM + 1), np.float32)
            np.multiply(q, rows["step"].to_numpy(np.float32)[:, None], out=v[:, :DIM])
            v[:, DIM] = 1 + rows["err"].to_numpy()
            return rows["id"].to_numpy(np.int64), v

        (xi, x), (yi, y) = side(i), side(j)
        found: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(x), TILE):
            start = at if i == j else 0
            most = x[at : at + TILE] @ y[start:].T
            # 1e-4 is far above what the single-precision product is off.
            flat = np.flatnonzero(most >= threshold + 1 - 1e-4)
            p, q = np.divmod(flat, most.shape[1])
            off = 2 * (x[at + p, DIM].astype(float) * y[start + q, DIM] - 1)
            sure = most.ravel()[flat] - 1 - off >= threshold + 1e-4
            # Within a block the tile on the diagonal holds each pair twice.
            once = p < q if i == j else True
            p, q = xi[at + p], yi[start + q]
            kept = (p != q) & once
            for o, c in zip(found, (np.minimum(p, q), np.maximum(p, q), sure), strict=True):
                o.append(c[kept])
        return pd.DataFrame({o: np.concatenate(c) if c else np.zeros(0, kind) for o, c, kind in zip(("a", "b", "sure"), found, (np.int64, np.int64, bool), strict=True)})

    return meet


def similar(points: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a, b (a < b): all pairs within a part whose cosine is at least the threshold. points: id, part, v (unit vectors), read twice.

    Exact: the vectors have no sparse dimensions to index, so every two blocks of a part are
    multiplied on compact vectors, whose rounding is bounded; the few pairs that the bound leaves
    open are verified on the vectors. Equal vectors are one point (the smallest id) and are linked to it.
    A point without an id has no links.
    """

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_compact(v) for v in np.asarray(b.column(3).flatten(), np.float64).reshape(b.num_rows, DIM)]
            q, step, err = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(q, pa.binary()), pa.array(step, pa.float64()), pa.array(err, pa.float64())], names=["id", "part", "h", "q", "step", "err"])

    long = (F.col(c).cast("long").alias(c) for c in ("id", "part"))
    small = cut(points.where("id is not null").select(*long, F.xxhash64("v").alias("h"), "v").mapInArrow(compact, "id long, part long, h long, q binary, step double, err double"))
    first = small.groupBy("part", "h").agg(F.min("id").alias("rep"))
    copies = cut(small.select("id", "part", "h").join(first, ["part", "h"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    reps = small.drop("h").join(broadcast_within(copies.select(F.col("b").alias("id")), NARROW), "id", "left_anti")
    blocks = first.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = reps.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = other.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "q", "step", "err")
    met = cut(sides.groupBy("part", "i", "j").applyInPandas(_near(threshold), "a long, b long, sure boolean"))
    doubt = met.where("not sure")
    asked = doubt.select(F.col("a").alias("id")).union(doubt.select("b")).distinct()
    vectors_asked = cut(points.select(F.col("id").cast("long").alias("id"), "v").join(broadcast_within(asked, NARROW), "id", "left_semi"))
    va, vb = (vectors_asked.select(F.col("id").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    verified = doubt.join(va, "a").join(vb, "b").where(vectors.dot("va", "vb") >= threshold)
    return met.where("sure").select("a", "b").unionByName(verified.select("a", "b")).unionByName(copies)


def linkage_of(ids: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """The cluster (its smallest id) of each unit vector, by average linkage; ids ascending.

    A chain of best partners: each cluster on it is the best of the one before, and two that are
    each other's best merge, which for average linkage gives the same tree as always merging the best
    pair. Of equal means the pair of the smallest ids is best. A step looks once at all clusters left
    and there are at most about three steps a point, so neither the time nor the memory goes with the cube or the
    square of the points: products in single precision tell which partners may be best, and these are compared exactly.
    """
    n = len(ids)
    cluster, where = np.arange(n), {}
    for i in range(n):
        if round(float(v[i] @ v[i]), 12) >= threshold:
            cluster[i] = where.setdefault(v[i].tobytes(), i)
    # Sums of vectors and sizes by cluster; means in rows, so that those of merged clusters can be left out.
    sums, size = v.astype(np.float64), np.bincount(cluster, minlength=n).astype(float)
    sums *= np.maximum(size, 1)[:, None]
    rows = np.flatnonzero(size)
    place = np.zeros(n, np.int64)
    place[rows] = np.arange(len(rows))
    means = v[rows].astype(np.float32)
    dead, gone = np.zeros(len(rows), np.float32), 0
    chain: list[tuple[int, tuple]] = []
    waiting = iter(rows.tolist())

    def leave(c: int) -> None:
        nonlocal gone
        dead[place[c]] = -8
        gone += 1

    while True:
        if not chain:
            a = next((c for c in waiting if size[c]), None)
            if a is None:
                return ids[cluster]
            chain.append((a, (-9.0,)))
        a, key = chain[-1]
        near = means @ means[place[a]] + dead
        near[place[a]] = -8
        # 1e-4 is far above what single precision is off.
        may = rows[near >= max(float(near.max()), threshold - 1e-4) - 1e-4]
        mean = np.round(sums[may] @ sums[a] / (size[may] * size[a]), 12)
        best = max(((m, -min(a, c), -max(a, c)) for m, c in zip(mean.tolist(), may.tolist(), strict=True) if m >= mean.max()), default=(-9.0,))
        if len(chain) > 1 and best <= key:
            # The one before has a as its best and a has none better.
            b = chain[-2][0]
            to, away = min(a, b), max(a, b)
            del chain[-2:]
            sums[to] += sums[away]
            size[to] += size[away]
            size[away] = 0
            cluster[cluster == away] = to
            means[place[to]] = sums[to] / size[to]
            leave(away)
            if not chain:
                chain.append((to, (-9.0,)))
        elif best[0] < threshold:
            chain.pop()
            leave(a)
            size[a] = 0
        else:
            chain.append((-best[1] if -best[1] != a else -best[2], best))
        if gone > 64 and 2 * gone > len(rows):
            left = dead == 0
            rows, means, dead, gone = rows[left], means[left], dead[left], 0
            place[rows] = np.arange(len(rows))


def average_linkage(points: DataFrame, links: DataFrame, threshold: float, local: int = LOCAL) -> DataFrame:
    """id, cluster (its smallest id): average-linkage clusters of unit vectors, cut where the mean cosine falls under the threshold.

    Two clusters can only merge if some pair between them is linked, so clusters lie within
    connected components of the links. A component of at most `local` points is clustered in one
    task, together with other small ones; larger ones in rounds of joins, see in_rounds. points: id, v, read
    twice; links: a, b with cosines of at least the threshold.
    """
    part = cut(components(links.select("a", "b")))
    sizes = part.groupBy("label").agg(F.count("*").alias("n"))
    shares = sizes.agg(F.ceil(F.sum("n") / TOGETHER)).first()[0] or 1
    # Small components share a task by the hash of their labels; the larger ones have their own.
    shared = F.when(F.col("n") <= TOGETHER // 4, -1 - F.pmod(F.xxhash64("label"), F.lit(shares))).otherwise(F.col("label"))
    dealt = sizes.select("label", (F.col("n") <= local).alias("few"), shared.alias("share"))
    of_label = cut(part.join(dealt, "label").select(F.col("node").alias("id"), "label", "few", "share"))
    labelled = points.select("id", "v").join(broadcast_within(of_label, NARROW), "id")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["label", "id"])
        ids, labels = pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
        v = np.stack(pdf["v"].to_numpy())
        ends = [*np.flatnonzero(labels[1:] != labels[:-1]) + 1, len(ids)]
        for lo, hi in zip([0, *ends], ends):
            out.append(linkage_of(ids[lo:hi], v[lo:hi], threshold))
        return pd.DataFrame({"id": ids, "cluster": np.concatenate(out)})

    alone = points.select("id").join(broadcast_within(of_label.select("id"), NARROW), "id", "left_anti").select("id", F.col("id").alias("cluster"))
    small = labelled.where("few").select("share", "label", "id", "v").groupBy("share").applyInPandas(solve, "id long, cluster long")
    if not of_label.where("not few").limit(1).count():
        return alone.unionByName(small)
    large = labelled.where("not few")
    inside = links.join(of_label.where("not few").select(F.col("id").alias("a")), "a", "left_semi")
    return alone.unionByName(small).unionByName(in_rounds(large, inside, threshold))


def in_rounds(points: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """id, cluster: average linkage of components too large for one task.

    The mean cosine of two clusters is the dot product of their mean vectors. So each round
    joins the linked clusters with their vector sums and merges all pairs that are each other's
    best; for average linkage that gives the same tree as merging one pair after another. Ties
    go to the smallest ids. Equal vectors are one cluster from the start, as their ties would merge
    only one pair a round.
    """
    # Null vectors have a cosine of 0 even with themselves.
    same = F.xxhash64("v", F.when(~F.exists("v", lambda x: x != 0), F.col("id")))
    state = cut(points.select("id", "v", same.alias("h")), bare=True)
    reps = cut(state.groupBy("h").agg(F.min("id").alias("cluster"), F.any_value("v").alias("v"), F.count("*").alias("n")), bare=True)
    member = cut(state.select("id", "h").join(reps.select("h", "cluster"), "h").select("id", "cluster"), bare=True)
    sums = reps.select("cluster", F.transform("v", lambda x: x * F.col("n")).alias("v"), "n")
    ends = (member.select(F.col("id").alias(c), F.col("cluster").alias(f"t{c}")) for c in "ab")
    edges = links.select("a", "b").join(next(ends), "a").join(next(ends), "b").where("ta <> tb")
    edges = cut(edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), bare=True)
    while True:
        va, vb = (sums.select(F.col("cluster").alias(c), F.col("v").alias(f"v{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
        scored = edges.join(va, "a").join(vb, "b").withColumn("sim", F.round(vectors.dot("va", "vb") / (F.col("na") * F.col("nb")), 12)).where(F.col("sim") >= threshold)
        scored = cut(scored.select("a", "b", "sim"), bare=True)
        sides = scored.select("a", "b", "sim").unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        # One order for both ends, so that ties cannot run in a circle.
        best = sides.groupBy("a").agg(F.max_by("b", F.struct("sim", -F.least("a", "b"), -F.greatest("a", "b"))).alias("b"))
        merge = cut(best.alias("x").join(best.alias("y"), (F.col("x.b") == F.col("y.a")) & (F.col("y.b") == F.col("x.a"))).where("x.a < x.b").select(F.col("x.a").alias("to"), F.col("x.b").alias("from")), bare=True)
        if not merge.limit(1).count():
            return member
        renamed = merge.select(F.col("from").alias("cluster"), "to")
        member = cut(member.join(renamed, "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")), bare=True)
        sums = cut(
            sums.join(renamed, "cluster", "left").withColumn("cluster", F.coalesce("to", "cluster")).groupBy("cluster")
            .agg(F.collect_list("v").alias("vs"), F.sum("n").alias("n"))
            .select("cluster", F.aggregate(F.slice("vs", 2, 2), F.get("vs", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q)).alias("v"), "n"),
            bare=True,
        )
        fa, fb = (merge.select(F.col("from").alias(c), F.col("to").alias(f"t{c}")) for c in "ab")
        moved = edges.join(fa, "a", "left").join(fb, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        edges = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), bare=True)


def numbered(members: DataFrame, prefix: str = "SN") -> DataFrame:
    """rec, part, cluster, plus family_no, family_id, member_index and new_id: families by part, un-embedded ones first, then by their smallest record.

    members: rec, part, cluster, embedded. The number of a family is its place among all families,
    found by range-partitioned counts, not in one task.
    """
    families = members.groupBy("part", "cluster").agg(F.bool_or("embedded").alias("e"))
    ordered = cut(families.repartitionByRange("part", "e", "cluster").sortWithinPartitions("part", "e", "cluster").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    starts = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_i0")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    of_family = ordered.join(F.broadcast(starts), "_p").select("part", "cluster", (F.col("before") + F.col("_i") - F.col("_i0") + 1).alias("family_no"))
    rows = members.join(of_family, ["part", "cluster"])
    index = F.row_number().over(Window.partitionBy("family_no").orderBy("rec"))
    out = rows.withColumn("member_index", index).withColumn("family_id", F.format_string(f"{prefix}%02d", "family_no"))
    return out.withColumn("new_id", F.format_string("%s_%03d", "family_id", "member_index")).select("rec", "part", "cluster", "family_no", "family_id", "member_index", "new_id")


def families(rows: DataFrame, threshold: float = 0.7, prefix: str = "SN") -> DataFrame:
    """Families of records by motif count and profile: see numbered. rows: rec, part (motif count), seq.

    Records without a profile are families of their own.
    """
    points = written(profiles(rows, "rec", "seq", "part").withColumnRenamed("rec", "id"), "profiles")
    links = cut(similar(points, threshold))
    in_cluster = average_linkage(points, links, threshold)
    members = rows.select("rec", "part").join(in_cluster.withColumnRenamed("id", "rec"), "rec", "left").select("rec", "part", F.coalesce("cluster", "rec").alias("cluster"), F.col("cluster").isNotNull().alias("embedded"))
    return numbered(cut(members), prefix)


