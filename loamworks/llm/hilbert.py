"""Operator 5: approximate nearest neighbours along shifted space-filling curves.

Vectors are projected to a few random orthogonal directions, shifted by a random offset and ordered along a Hilbert curve, several
times with other directions and offsets. Spark ranges the keys and ranks all rows on each curve. A query is compared with the rows
within a window on each curve; the best of all windows are reranked by their exact inner products.

Nearness is the inner product, so vectors get one more component that makes all norms equal, sqrt(M^2 - |x|^2) with M the largest
norm, and queries are stretched to M with 0 in it: then the nearest in space are those of the largest inner product.

The window is a part of all rows, because for vectors without clusters the share of neighbours that a window holds follows its
share of the rows. Work is cut into blocks of bounded size: a block of candidates of one curve meets a bounded slice of the queries
whose windows touch it.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; shorter vectors count as ending in
zeros; repeated rows are rows of their own; equal scores go to the smaller vec_id, a null one is the last; a query of a null vec_id
is searched like any other; fewer candidates than asked for give all; tables without queries or vectors give no rows; other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table
from .vectors import BLOCK, QUERIES, apart, best, matrix, named, numbered, top_rows

CURVES, DIMS, BITS = 8, 6, 10
#: Rows on each side of a query on each curve, as a part of all rows.
WINDOW = 0.11
SEED = 5


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with whole coordinates below 2**bits."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            hit, low = (x[i] & q) != 0, q - 1
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ flip) >> b & 1)
    return key


def curve_rows(rows: DataFrame, width: int, norm: float, spread: float) -> DataFrame:
    """For each row and curve: curve, key, rid and whether it stands for a query; a query has a row of either sort."""
    rng = np.random.default_rng(SEED)
    frames = [np.linalg.qr(rng.normal(size=(width + 1, min(DIMS, width + 1))))[0] for _ in range(CURVES)]
    shifts = [rng.random(f.shape[1]) for f in frames]

    def keys(v: np.ndarray) -> Iterator[np.ndarray]:
        for frame, shift in zip(frames, shifts):
            cells = (v @ frame / spread + 4 + shift) / 9 * (1 << BITS)
            yield hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            v = matrix(pdf["vector"], width)
            length = np.sqrt((v * v).sum(axis=1))
            q = pdf["is_query"].to_numpy(bool)
            there = np.column_stack([v, np.sqrt(np.maximum(norm**2 - length**2, 0))])
            asked = np.column_stack([v[q] * (norm / length[q])[:, None], np.zeros(q.sum())])
            for points, ids, flag in ((there, pdf["rid"].to_numpy(), False), (asked, pdf["rid"].to_numpy()[q], True)):
                for c, key in enumerate(keys(points)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(key), pa.array(ids), pa.array(np.full(len(ids), flag))], names=["curve", "key", "rid", "asked"])

    return rows.select("rid", "vector", "is_query").mapInArrow(run, "curve int, key long, rid long, asked boolean")


def ranked(keyed: DataFrame) -> DataFrame:
    """With the place of each row on its curve: ranged by key, numbered within partitions, the partitions' sizes summed up."""
    n = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = ["curve", "key", "rid", "asked"]
    rows = stash(keyed.repartitionByRange(int(n), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("curve", "part", "first", before.alias("before"))  # one row a partition and curve
    return rows.join(sizes, ["curve", "part"]).select("curve", "rid", "asked", (F.col("at") - F.col("first") + F.col("before")).alias("place"))


def neighbours(df: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id", window: float = WINDOW) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of the largest inner product that the curves find for each query."""
    rows = numbered(df, vector, vec_id, zero_too=False, is_query=is_query)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(square).alias("most"), F.avg(square).alias("mean"), F.count_if("is_query").alias("q")).first()
    n, width = facts["n"], facts["width"] or 1
    spread = float(np.sqrt((facts["mean"] or 1.0) / width)) or 1.0
    places = ranked(curve_rows(rows, width, float(np.sqrt(facts["most"] or 0.0)), spread))
    reach = max(2 * k, int(np.ceil(window * (n + facts["q"]))))
    block = max(1, min(BLOCK, reach))
    slices = max(1, int(np.ceil(facts["q"] * min(1.0, (2 * reach + block) / max(1, n)) / QUERIES)))
    first = F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / block)
    last = F.floor(F.least(F.col("place") + reach, F.lit(n + facts["q"])) / block)
    vectors = rows.select("rid", "vec_id", "vector")
    asked = places.filter("asked").withColumn("block", F.explode(F.sequence(first, last))).withColumn("slice", F.pmod(F.xxhash64("rid"), F.lit(slices)).cast("int")).join(vectors, "rid")
    there = places.filter("NOT asked").withColumn("block", F.floor(F.col("place") / block)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).join(vectors, "rid")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            cand, place, rid, vid = matrix(c["vector"], width), c["place"].to_numpy(), c["rid"].to_numpy(), c["vec_id"].to_numpy()
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                scores = matrix(part["vector"], width) @ cand.T
                far = np.abs(place[None, :] - part["place"].to_numpy()[:, None]) > reach
                scores[far | (rid[None, :] == part["rid"].to_numpy()[:, None])] = -np.inf
                top = top_rows(scores, vid, k)
                i, j = np.nonzero(top >= 0)
                cols = top[i, j]
                out.append(pd.DataFrame({"qid": part["rid"].to_numpy()[i], "query_id": part["vec_id"].to_numpy()[i], "rid": rid[cols], "vec_id": vid[cols], "score": scores[i, cols]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "query_id": [], "rid": [], "vec_id": [], "score": []})

    by = ["curve", "block", "slice"]
    found = apart(asked).groupBy(*by).cogroup(apart(there).groupBy(*by)).applyInPandas(compare, "qid long, query_id long, rid long, vec_id long, score double")
    # the same pair may come from several curves
    return named(best(found.groupBy("qid", "query_id", "rid", "vec_id").agg(F.max("score").alias("score")), k))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")
