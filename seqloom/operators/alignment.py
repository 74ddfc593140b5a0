"""Identity of protein pairs by global alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: BLOSUM62, lower triangle. Fixed values.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
#: Score of a letter outside the twenty against any other.
OTHER = -1


def scores() -> np.ndarray:
    m = np.full((26, 26), OTHER, np.int32)
    at = [ord(r) - 65 for r in RESIDUES]
    for i, line in enumerate(BLOSUM62.split("\n")[1:-1]):
        for j, s in enumerate(line.split()):
            m[at[i], at[j]] = m[at[j], at[i]] = int(s)
    return m


SCORES = scores()


def identity(a: str, b: str, gap: int = 0) -> float:
    """Equal columns of one best global alignment, by all its columns; 0 if either text is empty.

    gap: cost of each gap letter. Of several best alignments the one is taken that, from the end,
    prefers a pair to a gap in b, and that to a gap in a.
    """
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(s.encode(), np.uint8).astype(np.int64) - 65 for s in (a, b))
    steps = np.arange(len(y) + 1) * gap
    above = -steps.astype(np.int32)
    against = np.ascontiguousarray(SCORES[:, y])
    # Where the best score of a place comes over a pair, and where over a gap in b: a bit each, so two texts of 35,000 letters take 300 MB.
    pair, gap_b = [], []
    for c in x.tolist():
        over = above[:-1] + against[c]
        row = above - gap
        np.maximum(row[1:], over, out=row[1:])
        # A run of gaps in a costs gap per letter: a running maximum once that slope is taken out.
        row = np.maximum.accumulate(row + steps) - steps if gap else np.maximum.accumulate(row)
        pair.append(np.packbits(row[1:] == over))
        gap_b.append(np.packbits(row[1:] == above[1:] - gap))
        above = row
    x, y = x.tolist(), y.tolist()
    i, j, same, columns = len(x), len(y), 0, 0
    while i and j:
        columns += 1
        at, bit = (j - 1) >> 3, 7 - ((j - 1) & 7)
        if pair[i - 1][at] >> bit & 1:
            same += x[i - 1] == y[j - 1]
            i, j = i - 1, j - 1
        elif gap_b[i - 1][at] >> bit & 1:
            i -= 1
        else:
            j -= 1
    return float(same) / (columns + i + j)


def with_identity(pairs: DataFrame, a: str, b: str, gap: int = 0) -> DataFrame:
    """Adds identity of the two sequence columns (letters A to Z); null if either is null. Rows keep their other columns.

    A pair takes thousands of times as long to align as to move, so pairs are dealt out evenly.
    """
    spark = pairs.sparkSession
    pairs = pairs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    @F.pandas_udf("double")
    def of(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else identity(s, t, gap) for s, t in zip(p, q, strict=True)], dtype="float64")

    return pairs.withColumn("identity", of(a, b))


def closest(pairs: DataFrame, key: str, ref: str, ref_ord: str) -> DataFrame:
    """key, max_identity, closest: the most alike reference of each key, the first by ref_ord if several; '' and 0 if none is above 0."""
    best = pairs.groupBy(key).agg(F.max("identity").alias("_m"), F.max_by(ref, F.struct("identity", -F.col(ref_ord))).alias("_r"))
    return best.select(key, F.coalesce("_m", F.lit(0.0)).alias("max_identity"), F.when(F.col("_m") > 0, F.col("_r")).otherwise("").alias("closest"))


