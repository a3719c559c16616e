"""Splitting statements at connectors. Each part may split again, so this is a pandas UDF over Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markers import CONNECTORS, EXCEPTION_FREE, EXCEPTIONS

EDGES = "，, 。."
#: UTF-8 bytes that a part must have.
LEAST = 8
PATTERNS = tuple((c, re.compile(rf"(?<![a-z0-9]){re.escape(c)}(?![a-z0-9])" if c.isascii() else re.escape(c), re.I | re.A)) for c in CONNECTORS)


def _clause(part: str, connector: str) -> str:
    low = part.lower()
    alone = connector not in EXCEPTIONS or any(w in low for w in EXCEPTION_FREE)
    return part if alone else f"保留例外：{part}"


def split_atomic(statement: str | None) -> list[str]:
    """The parts of a statement. The first connector in order of precedence with two long enough sides splits it; the left side
    is done, the right one goes on. A null or empty statement has no parts."""
    parts: list[str] = []
    rest = (statement or "").strip()
    while rest:
        for connector, pattern in PATTERNS:
            if m := pattern.search(rest):
                left, right = (x.strip(EDGES).strip() for x in (rest[: m.start()], rest[m.end() :]))
                if min(len(left.encode()), len(right.encode())) >= LEAST:
                    parts.append(_clause(left, connector))
                    rest = _clause(right, connector).strip()
                    break
        else:
            parts.append(rest)
            rest = ""
    return parts


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(column: pd.Series) -> pd.Series:
    return column.map(split_atomic)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _split_each(column: pd.Series) -> pd.Series:
    return column.map(lambda statements: [split_atomic(s) for s in (statements if statements is not None else ())])


#: Statements without any of these are their own only part.
ANY_CONNECTOR = "(?i)" + "|".join(rf"(?<![a-zA-Z0-9])\Q{c}\E(?![a-zA-Z0-9])" if c.isascii() else rf"\Q{c}\E" for c in CONNECTORS)


def atomic_parts(statement: Column) -> Column:
    return _split(statement)


def with_atomic_parts(df: DataFrame, statements: str) -> DataFrame:
    """The table with the parts of all statements of an array column, in order, in place of it. Only statements with a connector go to
    Python. The parts that come back stand behind a generator step, as they are looked up again and again."""
    given = F.coalesce(F.col(statements), F.array().cast("array<string>"))
    joined = F.array_distinct(F.filter(given, lambda s: s.rlike(ANY_CONNECTOR)))
    rows = df.withColumn("_joined", joined).withColumn("_split", _split_each("_joined"))
    rows = rows.withColumn("_split", F.explode(F.array(F.map_from_arrays("_joined", "_split"))))
    parts = F.flatten(F.transform(given, lambda s: F.coalesce(F.try_element_at("_split", s), F.array(s))))
    return rows.withColumn(statements, parts).drop("_joined", "_split")
