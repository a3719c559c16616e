"""What the two vector searches share: reading vectors, blocks of work and the best rows of a query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Vectors of one block of candidates, and queries compared with a block at once in one group.
BLOCK, QUERIES = 8192, 4096
#: Stands for a null vec_id within the searches, where columns of numbers may hold no nulls.
NO_ID = (1 << 63) - 1


def numbered(df: DataFrame, vector: str, vec_id: str, zero_too: bool, is_query: Column) -> DataFrame:
    """rid, vec_id, vector (doubles) and is_query of the rows that take part. rid tells repeated rows apart; a null vec_id is NO_ID."""
    rows = df.select(F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("vector").isNotNull()).filter(_fine(zero_too))
    return stash(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "vector", "is_query"))


def _fine(zero_too: bool) -> Column:
    v = F.col("vector")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return fine if zero_too else fine & F.exists(v, lambda x: x != 0)


def named(found: DataFrame) -> DataFrame:
    """With null ids again."""
    return found.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("query_id", "vec_id")})


def apart(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, to be grouped together with another table of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: highest score, then least vec_id. ``found``: qid, query_id, rid, vec_id, score."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id", "rid")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "qid", "rid")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties at the end to the least id; -1 where there are too few."""
    n = scores.shape[1]
    if n > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    else:
        kth = np.full(len(scores), -np.inf)
    out = np.full((len(scores), k), -1)
    for i in range(len(scores)):
        c = np.flatnonzero((scores[i] >= kth[i]) & (scores[i] > -np.inf))
        c = c[np.lexsort((ids[c], -scores[i, c]))][:k]
        out[i, : len(c)] = c
    return out
