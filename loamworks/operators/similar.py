"""Blocks of similar rows: rows in different blocks are not similar, so that order-dependent work can go on in each by itself.

Rows are similar if one of some measures of token sets says so: Jaccard of at least (or more than) its threshold, two empty sets being
equal. By the prefix filter, two sets that are similar share one of their rarest tokens, so rows meet in lists of these tokens. A
list's rows are compared in one task, up to connectivity; long lists are cut into parts, and each pair of parts is a task of its own.
Components of what was found are the blocks. Nothing is compared by way of a group of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import components

#: Rows of a part of a list.
PART = 4_000
TOKENS = "([a-z0-9]{2,}|[一-鿿]+)"


@dataclass(frozen=True)
class Measure:
    """A column of texts and from where on two of them are similar; ``above``: only beyond that."""

    column: str
    at: float
    above: bool = False

    def holds(self, shared: int, union: int) -> bool:
        return (shared / union > self.at if self.above else shared / union >= self.at) if union else True


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS), F.lit(1)))


def _prefixes(rows: DataFrame, m: Measure, nth: int) -> DataFrame:
    """(id, measure, group, token, tokens): the rarest tokens of each set, as many as the threshold asks for."""
    least = Fraction(str(m.at))
    sets = rows.select("id", "group", token_set(F.col(f"`{m.column}`")).alias("tokens"))
    each = sets.select("id", "group", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rare = each.groupBy("group", "token").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "token")))
    ranked = each.join(rare, ["group", "token"]).groupBy("id").agg(F.max("n").alias("n"), order.alias("order"))
    keep = F.col("n") - F.ceil(F.col("n") * least.numerator / least.denominator - 1e-9) + 1
    first = ranked.select("id", F.explode(F.slice("order", F.lit(1), keep.cast("int"))).alias("o")).select("id", F.col("o.token").alias("token"))
    return first.join(sets, "id").select("id", F.lit(nth).alias("measure"), "group", "token", "tokens")


def _linked(measures: tuple[Measure, ...]):
    """Rows (measure, group, token, a, b, part, id, tokens), sorted by the first five, to links (u, v), up to connectivity."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        m = measures[rows[0][0]]
        a, b = rows[0][3], rows[0][4]
        items = sorted(((frozenset(r[7]), r[6], r[5]) for r in rows), key=lambda x: (len(x[0]), x[1]))
        up = list(range(len(items)))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        out = []
        for i, (x, u, side) in enumerate(items):
            for j in range(i + 1, len(items)):
                y, v, other = items[j]
                if len(x) < m.at * len(y) - 1e-9:
                    break  # all further sets are too large
                if (a != b and side == other) or u == v or find(i) == find(j):
                    continue
                shared = len(x & y)
                if m.holds(shared, len(x) + len(y) - shared):
                    up[find(i)] = find(j)
                    out.append((u, v))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            found = links(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            held.extend(zip(*[c.to_pylist() for c in batch.columns]))
            lo = 0
            for i in range(1, len(held)):
                if held[i][:5] != held[lo][:5]:
                    if i - lo > 1:
                        yield settle(held[lo:i])
                    lo = i
            held = held[lo:]
        if held:
            yield settle(held)

    return run


def blocks(df: DataFrame, measures: tuple[Measure, ...], by: tuple[str, ...] = (), key: str = "seq") -> DataFrame:
    """(key, block) of the rows that are similar to another one with equal ``by``; ``key`` is a whole number and unique. A row that is
    not here is a block of its own."""
    group = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(by)], F.lit(0).alias("z")))
    rows = written(df.select(F.col(f"`{key}`").cast("long").alias("id"), group.alias("group"), *[F.col(f"`{m.column}`") for m in measures]))
    lists, empty = None, None
    for nth, m in enumerate(measures):
        one = _prefixes(rows, m, nth)
        lists = one if lists is None else lists.unionByName(one)
        # sets without tokens are equal: all hang on the least
        bare = rows.filter(F.size(token_set(F.col(f"`{m.column}`"))) == 0).select("id", "group")
        stars = bare.join(bare.groupBy("group").agg(F.min("id").alias("v")), "group").select(F.col("id").alias("u"), "v")
        empty = stars if empty is None else empty.unionByName(stars)
    lists = written(lists)
    where = ["measure", "group", "token"]
    sizes = lists.groupBy(*where).agg(F.count("*").alias("k")).filter("k > 1").select(*where, F.ceil(F.col("k") / PART).cast("int").alias("parts"))
    met = lists.join(sizes, where).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(*where, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "id", "tokens")
    met = met.repartition(*where, "a", "b").sortWithinPartitions(*where, "a", "b")
    found = met.mapInArrow(_linked(measures), "u long, v long").unionByName(empty).filter("u != v")
    return components(found).select(F.col("node").alias(key), F.col("component").alias("block"))
