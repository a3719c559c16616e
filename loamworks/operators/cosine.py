"""Nearest rows by cosine. Every row is a query and meets every other row: rows are packed into blocks, each pair of blocks meets in a
task, which keeps the best rows of its queries, and a window picks the best over all tasks.

Blocks are written once and dealt out once. What they meet is read again and again from the table of blocks, a part of it at a time, so
disk grows with the rows and not with their pairs. In a task, products of 32-bit floats tell which rows can be among the best of a query;
only those are compared in 64 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Numbers that a block's vectors have together, at most; blocks there are at least, but for small ones.
BLOCK_NUMBERS, SPREAD, LEAST_ROWS = 1 << 18, 24, 256
#: Queries and rows that are compared at once, and queries in 64 bits; a query with more rows that may be its best is compared with all.
QUERIES, OTHERS, DENSE, FEW = 1024, 4096, 128, 64
BLOCK = "ids binary, widths binary, numbers binary, block string"


class _Block:
    """Ids in order, vectors filled up with zeros, their lengths, how many numbers each has, and which are not for 32-bit floats."""

    def __init__(self, ids: np.ndarray, width: np.ndarray, numbers: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.width = ids[order].astype(np.int64), width[order].astype(np.int64)
        at, place = np.repeat(np.arange(len(ids)), width), np.arange(len(numbers)) - np.repeat(np.cumsum(width) - width, width)
        rows = np.zeros((len(ids), int(width.max())))
        rows[at, place] = numbers
        self.rows = rows[order]
        with np.errstate(all="ignore"):
            self.long = np.sqrt((self.rows * self.rows).sum(axis=1))
            self.odd = ~np.isfinite(self.long) | ((self.long > 0) & (self.long < 1e-140))
            self.itself = int(np.unique(self.ids, return_counts=True)[1].max())  # rows that one id may have
            self.unit = np.divide(self.rows, self.long[:, None], out=np.zeros_like(self.rows), where=~self.odd[:, None] & (self.long[:, None] > 0)).astype(np.float32)

    def wide(self, n: int) -> None:
        more = n - self.rows.shape[1]
        if more:
            self.rows, self.unit = (np.pad(x, ((0, 0), (0, more))) for x in (self.rows, self.unit))


def _dense(x: _Block, y: _Block, q: np.ndarray, c: slice, k: int) -> tuple[np.ndarray, ...]:
    """Of each query the best of some rows, all compared: query, row, similarity, and the key that it is ordered by."""
    long = x.long[q][:, None] * y.long[c][None]
    fits = x.width[q][:, None] == y.width[c][None]
    sims = np.divide(x.rows[q] @ y.rows[c].T, long, out=np.zeros_like(long), where=fits & (long != 0))
    keys = np.round(sims, 9)
    keys[np.isnan(keys)] = np.inf  # as the engines order it
    keys[x.ids[q][:, None] == y.ids[c][None]] = -np.inf
    k = min(k, keys.shape[1])
    last = np.partition(keys, -k, axis=1)[:, -k, None]
    more, same = keys > last, (keys == last) & (keys > -np.inf)
    near, to = np.nonzero(more | (same & (np.cumsum(same, axis=1) <= k - more.sum(axis=1, keepdims=True))))
    return q[near], to + c.start, sims[near, to], keys[near, to]


class _Search:
    """The ``k`` best rows of each query of a block, over the blocks that it met."""

    def __init__(self, x: _Block, k: int) -> None:
        self.x, self.k = x, k
        self.least = np.full(len(x.ids), -np.inf)
        self.found = [[np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64)] for _ in range(0, len(x.ids), QUERIES)]

    def meet(self, y: _Block) -> None:
        x, k = self.x, self.k
        wide = max(x.rows.shape[1], y.rows.shape[1])
        x.wide(wide)
        y.wide(wide)
        margin = 1e-9 + (wide + 8) * 2.0**-23  # of keys, and of products of 32-bit floats
        alike = x.width.min() == x.width.max() == y.width.min() == y.width.max()
        for nth_part, first in enumerate(range(0, len(x.ids), QUERIES)):
            q = np.arange(first, min(first + QUERIES, len(x.ids)))
            for start in range(0, len(y.ids), OTHERS):
                c = slice(start, min(start + OTHERS, len(y.ids)))
                least = self.least[first : first + QUERIES]
                if alike and not y.odd[c].any():
                    near = x.unit[q] @ y.unit[c].T
                    if near.shape[1] > k + y.itself and (new := np.isinf(least)).any():
                        # no bound yet: so many products, without those of the query itself, are at least this
                        least[new] = np.partition(near[new], -k - y.itself, axis=1)[:, -k - y.itself] - margin
                    may = near >= least[:, None].astype(np.float32)
                    many = (may.sum(axis=1) > FEW) | x.odd[q]
                    may[many] = False
                else:
                    may, many = np.zeros((len(q), 0), bool), np.ones(len(q), bool)
                near, to = np.divmod(np.flatnonzero(may), max(1, may.shape[1]))
                at = q[near], to + start
                long = x.long[at[0]] * y.long[at[1]]
                sims = np.divide(np.einsum("ij,ij->i", x.rows[at[0]], y.rows[at[1]]), long, out=np.zeros_like(long), where=long != 0)
                own = x.ids[at[0]] != y.ids[at[1]]
                new = [(at[0][own], at[1][own], sims[own], np.round(sims[own], 9))]
                new += [_dense(x, y, q[many][i : i + DENSE], c, k) for i in range(0, int(many.sum()), DENSE)]
                if not sum(len(n[0]) for n in new):
                    continue
                new = [(n[0], y.ids[n[1]], *n[2:]) for n in new]
                found = [np.concatenate(columns) for columns in zip(self.found[nth_part], *new)]
                order = np.lexsort((found[1], -found[3], found[0]))
                found = [f[order] for f in found]
                nth = np.arange(len(order)) - np.searchsorted(found[0], found[0])
                self.found[nth_part] = [f[nth < k] for f in found]
                full = found[0][nth == k - 1] - first
                least[full] = np.maximum(least[full], found[3][nth == k - 1] - margin)

    def best(self) -> list[np.ndarray]:
        """Ids of queries and rows, and their similarities."""
        queries, to, sims, _ = (np.concatenate(columns) for columns in zip(*self.found))
        return [self.x.ids[queries], to, sims]


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of some rows each. Columns: vec_id, embedding."""
    number = np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64
    schema = pa.schema([*((n, pa.binary()) for n in ("ids", "widths", "numbers")), ("block", pa.string())])

    def cut(table: pa.Table) -> pa.RecordBatch:
        lists = pa.concat_arrays(table.column(1).chunks)
        block = table.column(0).to_numpy().astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(number)
        return pa.RecordBatch.from_arrays([*(pa.array([b.tobytes()], pa.binary()) for b in block), pa.array([uuid.uuid4().hex])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block_rows:
                table = pa.Table.from_batches(held)
                whole = table.num_rows - table.num_rows % block_rows
                for at in range(0, whole, block_rows):
                    yield cut(table.slice(at, block_rows))
                held = table.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield cut(pa.Table.from_batches(held))

    return rows.mapInArrow(run, BLOCK)


def rows_for(rows: int, width: int) -> int:
    """How many a block has, of so many in all and vectors that are so wide."""
    return max(1, min(BLOCK_NUMBERS // max(1, width), max(LEAST_ROWS, -(-rows // SPREAD))))


def cosine_top(df: DataFrame, k: int = 5, block_rows: int | None = None) -> DataFrame:
    """query_id, vec_id, rk and similarity of the ``k`` most similar other rows of each row: equal ones by id. A vector of zeros has
    similarity 0, and so have vectors that differ in how many numbers they have; null and empty vectors are no rows, nor are those
    without an id. Columns: vec_id, embedding."""
    kind = "array<float>" if dict(df.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).filter("size(embedding) > 0 AND vec_id IS NOT NULL")
    number = np.float32 if kind == "array<float>" else np.float64
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("wide")).first()
    blocks = written(packed(rows, block_rows or rows_for(sizes["n"], sizes["wide"] or 1)))
    tasks = max(1, min(blocks.count(), 4 * df.sparkSession.sparkContext.defaultParallelism))
    others = blocks.select(*[F.col(c).alias(f"to_{c}") for c in ("ids", "widths", "numbers")])
    pairs = blocks.repartition(tasks).crossJoin(others.hint("shuffle_replicate_nl"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, search = None, None
        block = lambda ids, widths, numbers: _Block(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(widths.as_buffer(), np.int32), np.frombuffer(numbers.as_buffer(), number))
        with np.errstate(all="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    pair = [column[i] for column in batch.columns]
                    if pair[3].as_py() != name:
                        if search is not None:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in search.best()], schema=schema)
                        name, search = pair[3].as_py(), _Search(block(*pair[:3]), k)
                    search.meet(block(*pair[4:]))
            if search is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in search.best()], schema=schema)

    near = pairs.mapInArrow(run, "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "vec_id")
    return near.withColumn("rk", F.row_number().over(w).cast("long")).filter(F.col("rk") <= k).select("query_id", "vec_id", "rk", F.round("similarity", 5).alias("similarity"))
