"""Operator 9: exact top-k search by inner product with KD-trees, one in each shard.

Rows are cut into regions of space by median splits of a bounded sample, and regions into shards of bounded size by a hash. Every
region's tight bounding box is kept; there are at most REGIONS of them. For a query, a box bounds the inner product: per component
the larger of the products with its two sides. A query is first searched in the region of its highest bound; then only in regions
whose bound reaches the kth score found there. In a shard, a tree splits at the median of the widest dimension down to leaves and
keeps tight boxes; the traversal is best-first: nodes in order of their bound, until no bound reaches the query's kth score so far.

Components become floor(1024 * x), so scores are whole numbers. They are summed as doubles where these are exact, else as 64-bit
integers; vectors whose scores could leave 64 bits are an error.

Defined cases: vectors that are null or hold null or non-finite components take no part, zero vectors do; shorter vectors count as
ending in zeros; repeated rows are rows of their own; equal scores go to the smaller vec_id, a null one is the last; a query of a
null vec_id is searched like any other; fewer candidates than asked for give all; tables without queries or vectors give no rows;
other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table
from .vectors import BLOCK, QUERIES, apart, best, matrix, named, numbered

SCALE = 1024
LEAF = 128
NONE = -(1 << 62)
#: Most regions of space, and most rows that their splits are made from.
REGIONS, SAMPLE = 512, 16_384


class Tree:
    """Median splits with tight boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.low, self.high, self.rows, self.below = [], [], [], []
        self._split(np.arange(len(points)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, rows: np.ndarray, leaf: int) -> int:
        here, p = len(self.rows), self.points[rows]
        self.low.append(p.min(axis=0))
        self.high.append(p.max(axis=0))
        self.rows.append(rows)
        self.below.append(())
        wide = int(np.argmax(self.high[here] - self.low[here]))
        if len(rows) > leaf and self.high[here][wide] > self.low[here][wide]:
            half = np.argpartition(p[:, wide], len(rows) // 2)
            cut = len(rows) // 2
            self.below[here] = (self._split(rows[half[:cut]], leaf), self._split(rows[half[cut:]], leaf))
        elif len(rows) > leaf:  # all points are equal
            cut = len(rows) // 2
            self.below[here] = (self._split(rows[:cut], leaf), self._split(rows[cut:], leaf))
        return here

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return box_bounds(queries, self.low, self.high)

    def search(self, query: np.ndarray, bound: np.ndarray, k: int, ids: np.ndarray, own: int, kth: float) -> tuple[list[tuple[int, int, int]], int]:
        """The k best (score, id, row) without row ``own``, as far as they reach ``kth``; and the leaves that were read."""
        top: list[tuple[int, int, int]] = []
        heap, leaves = [(-bound[0], 0)], 0
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if self.below[node]:
                for b in self.below[node]:
                    if bound[b] >= kth:
                        heapq.heappush(heap, (-bound[b], b))
                continue
            rows = self.rows[node]
            leaves += 1
            scores = self.points[rows] @ query
            for j in np.flatnonzero(scores >= kth):
                if rows[j] != own:
                    top.append((scores[j], ids[rows[j]], rows[j]))
            if len(top) > k:
                top = sorted(top, key=lambda t: (-t[0], t[1]))[:k]
            if len(top) == k:
                kth = max(kth, min(t[0] for t in top))
        return sorted(top, key=lambda t: (-t[0], t[1])), leaves


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box, a bound of the inner product with any point in the box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


# -- regions of space


def median_cuts(points: np.ndarray, regions: int) -> list[tuple[int, float, int, int]]:
    """Splits (dimension, value, next below, next above) by medians of the widest dimension; a next one below zero is region
    -1 - next. Equal values stay together, so there may be fewer regions."""
    cuts: list[tuple[int, float, int, int]] = []
    made = [0]

    def split(p: np.ndarray, into: int) -> int:
        if into > 1 and len(p) > 1:
            wide = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            x = np.sort(p[:, wide])
            value = x[len(x) // 2]
            if x[0] < value:
                here = len(cuts)
                cuts.append((wide, float(value), 0, 0))
                below = p[:, wide] < value
                sides = split(p[below], into // 2), split(p[~below], into - into // 2)
                cuts[here] = (wide, float(value), *sides)
                return here
        made[0] += 1
        return -made[0]

    split(points, regions)
    return cuts


def region_of(points: np.ndarray, cuts: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(np.arange(len(points)), 0)] if cuts else []
    while todo:
        rows, at = todo.pop()
        wide, value, below, above = cuts[at]
        side = points[rows, wide] < value
        for some, to in ((rows[side], below), (rows[~side], above)):
            if to < 0:
                out[some] = -1 - to
            elif len(some):
                todo.append((some, to))
    return out


def boxes(rows: DataFrame, width: int, whole) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions that have rows, and the low and high sides of their boxes: at most REGIONS rows come to the driver."""

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            v, region = whole(pdf["vector"]), pdf["region"].to_numpy()
            for r in np.unique(region):
                low, high = v[region == r].min(axis=0), v[region == r].max(axis=0)
                old = found.get(int(r), (low, high))
                found[int(r)] = np.minimum(low, old[0]), np.maximum(high, old[1])
        if found:
            yield pd.DataFrame({"region": list(found), "side": [np.concatenate([-a, b]).astype(float) for a, b in found.values()]})

    part = rows.select("region", "vector").mapInPandas(sides, "region long, side array<double>")
    each = part.select("region", F.posexplode("side").alias("at", "x")).groupBy("region", "at").agg(F.max("x").alias("x"))
    got = each.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("side")).collect()
    side = np.array([[x["x"] for x in r["side"]] for r in got]).reshape(len(got), 2 * width)
    return np.array([r["region"] for r in got], np.int64), -side[:, :width], side[:, width:]


def exact_top(df: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id", block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the largest whole-number inner product for each query."""
    block = block or BLOCK
    rows = numbered(df, vector, vec_id, zero_too=True, is_query=is_query)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.count_if("is_query").alias("q"), F.max(largest).alias("most")).first()
    n, width = facts["n"], max(1, facts["width"] or 1)
    most = float(facts["most"] or 0.0) * SCALE + 1
    if width * most * most >= float(1 << 62):
        raise ArithmeticError("scores of these vectors do not fit into 64 bits")
    kind = np.float64 if width * most * most < float(1 << 53) else np.int64
    whole = lambda column: np.floor(matrix(column, width) * SCALE).astype(kind)

    regions = min(REGIONS, max(1, -(-n // block)))
    drawn = rows.filter(F.pmod(F.xxhash64("rid", F.lit(9)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 20))).select("vector").limit(2 * SAMPLE)
    sample = drawn.toPandas()["vector"] if regions > 1 else pd.Series([], dtype=object)
    cuts = median_cuts(whole(sample), regions) if len(sample) else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole(batch.column("vector").to_pandas())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region_of(v, cuts), pa.int64())], names=[*batch.schema.names, "region"])

    rows = stash(rows.mapInArrow(place, "rid long, vec_id long, vector array<double>, is_query boolean, region long"))
    held, low, high = boxes(rows, width, whole)
    shards = rows.groupBy("region").agg(F.ceil(F.count("*") / block).alias("shards"))  # a region each
    sizes = {r["region"]: int(r["shards"]) for r in shards.collect()}
    slices = max(1, -(-facts["q"] // QUERIES))
    into = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]) if sizes else F.create_map(F.lit(0).cast("long"), F.lit(1))
    of_region = F.element_at(into, F.col("region"))
    asked = rows.filter("is_query").select("rid", "vec_id", "vector").withColumn("slice", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(slices)).cast("int"))
    there = rows.select("region", F.pmod(F.xxhash64("rid"), of_region).cast("int").alias("shard"), "rid", "vec_id", "vector").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def route(first: bool):
        """The regions where a query has to be searched: first that of its highest bound, then all others that reach its kth score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rid, kth = batch.column("rid").to_numpy(), batch.column("kth").to_numpy()
                q = whole(batch.column("vector").to_pandas())
                for at in range(0, len(rid), 1024):
                    bound = box_bounds(q[at : at + 1024], low, high)
                    top = bound.argmax(axis=1)
                    if first:
                        i, j = np.arange(len(top)), top
                    else:
                        reach = bound >= kth[at : at + 1024, None]
                        reach[np.arange(len(top)), top] = False
                        i, j = np.nonzero(reach)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[at : at + 1024][i]), pa.array(held[j], pa.int64())], names=["rid", "region"])

        return run

    def sent(queries: DataFrame, first: bool) -> DataFrame:
        where = queries.select("rid", "kth", "vector").mapInArrow(route(first), "rid long, region long")
        return queries.join(where, "rid").withColumn("shard", F.explode(F.sequence(F.lit(0), of_region - 1)))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            tree, vid, rid = Tree(whole(c["vector"])), c["vec_id"].to_numpy(), c["rid"].to_numpy()
            at = {r: i for i, r in enumerate(rid)}
            for start in range(0, len(q), 512):
                part = q.iloc[start : start + 512]
                points = whole(part["vector"])
                bounds = tree.bounds(points)
                for i, (qid, query_id, kth) in enumerate(zip(part["rid"], part["vec_id"], part["kth"])):
                    top, _ = tree.search(points[i], bounds[i], k, vid, at.get(qid, -1), int(kth))
                    out += [(qid, query_id, rid[r], v, int(s)) for s, v, r in top]
        return pd.DataFrame(out, columns=["qid", "query_id", "rid", "vec_id", "score"])

    schema = "qid long, query_id long, rid long, vec_id long, score long"
    by = ["region", "shard", "slice"]

    def round_of(queries: DataFrame) -> DataFrame:
        return apart(queries).groupBy(*by).cogroup(apart(there).groupBy(*by)).applyInPandas(compare, schema)

    first = stash(round_of(sent(asked.withColumn("kth", F.lit(NONE)), True)))
    ranked = best(first, k).groupBy(F.col("qid").alias("rid")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = asked.join(ranked, "rid", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(NONE))).drop("least", "n")
    return named(best(first.unionByName(round_of(sent(stash(known), False))), k))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


#: The rows in DuckDB, by comparing with all.
ORACLE_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) x WHERE place <= 10"""
