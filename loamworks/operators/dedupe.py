"""Greedy removal of similar candidates. The order decides, and similarity is not transitive. A row is only ever compared with rows
that are similar to it, so the work falls into blocks (``similar``), the components of similarity: each runs by itself, in order, and
rows similar to no other stay without being looked at. Exact copies go first."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .similar import Measure, blocks

TOKEN = re.compile(r"[a-z0-9]{2,}|[一-鿿]+")


def tokens(text: str | None) -> frozenset[str]:
    return frozenset(TOKEN.findall((text or "").lower()))


def jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


class Kept:
    """Kept rows, found by shared tokens. Replacing a row in place keeps its position."""

    def __init__(self):
        self.rows: list[tuple[int, frozenset[str], frozenset[str]]] = []
        self.at: dict[str, set[int]] = {}
        self.bare: set[int] = set()

    def put(self, position: int, row: tuple[int, frozenset[str], frozenset[str]]) -> None:
        if position == len(self.rows):
            self.rows.append(row)
        else:
            for t in self.rows[position][1] | self.rows[position][2]:
                self.at[t].discard(position)
            self.rows[position] = row
        for t in row[1] | row[2]:
            self.at.setdefault(t, set()).add(position)
        (self.bare.discard if row[1] and row[2] else self.bare.add)(position)

    def near(self, body: frozenset[str], title: frozenset[str]) -> list[int]:
        """Positions that share a token, or that lack tokens as this row may."""
        found = set().union(*(self.at.get(t, set()) for t in body | title))
        return sorted(found | (self.bare if not body or not title else set()))


def first_of_each(df: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Of rows with one key the first: a minimum, summed up in each task before rows meet."""
    rest = [c for c in df.columns if c != order]
    return df.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min(F.struct(order, *rest)).alias("m")).select("m.*").select(*df.columns)


def in_blocks(df: DataFrame, measures: tuple[Measure, ...], by: tuple[str, ...], run) -> DataFrame:
    """``run`` over the rows of each block of similar rows; a block's rows are equal in ``by``. Other rows go through."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()))
    marked = rows.join(blocks(rows, measures, by, "_row"), "_row", "left").drop("_row")
    alone = marked.filter("block IS NULL").drop("block")
    return alone.unionByName(marked.filter("block IS NOT NULL").groupBy("block").applyInPandas(lambda pdf: run(pdf.drop(columns="block")), df.schema))


def greedy_dedupe(df: DataFrame, by: tuple[str, ...] = ("kind", "scope"), body_at: float = 0.5, title_at: float = 0.8) -> DataFrame:
    """Rows that stay. In order of ``seq`` (unique), a row that is similar to an earlier kept one (body or title) takes the place of the
    first such if it ranks higher (has a template, has a reason, then confidence), else goes. Columns: seq, key, title, body, template,
    reason, confidence and ``by``; ``reason`` may be missing."""
    given = "reason" in df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        reasons = pdf["reason"] if given else [None] * len(pdf)
        rank = [(int(t is not None), int(r is not None), round((0.0 if c is None or c != c else c) * 1000)) for t, r, c in zip(pdf["template"], reasons, pdf["confidence"])]
        kept = Kept()
        for i, (body, title) in enumerate(zip(map(tokens, pdf["body"]), map(tokens, pdf["title"]))):
            same = next((p for p in kept.near(body, title) if jaccard(kept.rows[p][1], body) >= body_at or jaccard(kept.rows[p][2], title) >= title_at), None)
            if same is None:
                kept.put(len(kept.rows), (i, body, title))
            elif rank[i] > rank[kept.rows[same][0]]:
                kept.put(same, (i, body, title))
        return pdf.iloc[sorted(r[0] for r in kept.rows)]

    return in_blocks(first_of_each(df), (Measure("body", body_at), Measure("title", title_at)), by, run)


def batch_dedupe(df: DataFrame, group: str = "run", above: float = 0.65) -> DataFrame:
    """Keeps, in order of ``seq`` within a group, each row whose body is not more similar than ``above`` to a kept one. Rows with
    a true ``noise``, if there is such a column, go."""
    rows = df.filter(~F.coalesce("noise", F.lit(False))) if "noise" in df.columns else df

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        kept = Kept()
        for i, body in enumerate(map(tokens, pdf["body"])):
            if not any(jaccard(kept.rows[p][1], body) > above for p in kept.near(body, body)):
                kept.put(len(kept.rows), (i, body, body))
        return pdf.iloc[[r[0] for r in kept.rows]]

    return in_blocks(rows, (Measure("body", above, above=True),), (group,), run)
