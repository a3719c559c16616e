"""One query text for two engines.

Queries are written once as SQL over ``<table>`` marks. ``Spark`` and ``Duck`` fill in what the engines spell differently; the
expressions stay built-in functions, so Spark compiles them into its stages.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    explode, size, sort, distinct, join, intersect, bytes_of = "explode", "size", "array_sort", "array_distinct", "array_join", "array_intersect", "octet_length"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\x01", "\\u0001") + "'"

    @staticmethod
    def replaced(x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {Spark.text(pattern)}, {Spark.text(by)})"

    @staticmethod
    def all_of(x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {Spark.text(pattern)}, {group})"

    @staticmethod
    def matches(x: str, pattern: str) -> str:
        return f"({x} RLIKE {Spark.text(pattern)})"

    @staticmethod
    def pieces(x: str, pattern: str) -> str:
        return f"split({x}, {Spark.text(pattern)}, -1)"

    @staticmethod
    def sha(x: str) -> str:
        return f"sha2({x}, 256)"

    @staticmethod
    def array(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def kept(x: str, test: str) -> str:
        return f"filter({x}, e -> {test})"

    @staticmethod
    def each(x: str, made: str) -> str:
        return f"transform({x}, e -> {made})"

    @staticmethod
    def first_of(x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    @staticmethod
    def real(x: str) -> str:
        """A quotient of 32-bit floats as one: Spark divides in 64 bits."""
        return f"CAST({x} AS FLOAT)"

    @staticmethod
    def placed(x: str) -> str:
        """Columns ``place`` (from 0) and ``e`` of an array's elements."""
        return f"posexplode({x}) AS (place, e)"

    @staticmethod
    def listed(x: str, by: str, between: str = "\n") -> str:
        """x of a group as a string, of lines if nothing else is named, in the order of ``by``."""
        return f"array_join(transform(array_sort(collect_list(struct({by}, {x} AS listed))), e -> e.listed), {Spark.text(between)})"


class Duck:
    explode, size, sort, distinct, join, intersect, bytes_of = "unnest", "len", "list_sort", "list_distinct", "array_to_string", "list_intersect", "strlen"

    @staticmethod
    def text(s: str) -> str:
        return " || chr(1) || ".join(" || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in q.split("\n")) for q in s.split("\x01"))

    @staticmethod
    def replaced(x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {Duck.text(pattern)}, {Duck.text(by)}, 'g')"

    @staticmethod
    def all_of(x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {Duck.text(pattern)}, {group})"

    @staticmethod
    def matches(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {Duck.text(pattern)})"

    @staticmethod
    def pieces(x: str, pattern: str) -> str:
        return f"regexp_split_to_array({x}, {Duck.text(pattern)})"

    @staticmethod
    def sha(x: str) -> str:
        return f"sha256({x})"

    @staticmethod
    def array(*items: str) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def kept(x: str, test: str) -> str:
        return f"list_filter({x}, lambda e: {test})"

    @staticmethod
    def each(x: str, made: str) -> str:
        return f"list_transform({x}, lambda e: {made})"

    @staticmethod
    def first_of(x: str, n: int) -> str:
        return f"{x}[1:{n}]"

    @staticmethod
    def real(x: str) -> str:
        return f"CAST({x} AS FLOAT)"

    @staticmethod
    def placed(x: str) -> str:
        return f"unnest(range(len({x}))) AS place, unnest({x}) AS e"

    @staticmethod
    def listed(x: str, by: str, between: str = "\n") -> str:
        return f"string_agg({x}, {Duck.text(between)} ORDER BY {by})"


def run(spark: SparkSession, sf_dir: str, made, **more: DataFrame) -> DataFrame:
    """The query over the tables of a folder and ``more`` tables; no views are left behind."""
    text = made(Spark)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"<{t}>" in text} | more
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"<{t}>", "{" + t + "}")
    df = spark.sql(text, **used)
    # whole numbers are 64 bits wide in results, whatever a function returns
    return df.withColumns({c: df[c].cast("bigint") for c, kind in df.dtypes if kind == "int"})


def oracle(made) -> str:
    return re.sub(r"<(\w+)>", lambda m: m[1] if m[1] in TABLES else m[0], made(Duck))


def json_text(d, x: str, path: str) -> str:
    """A member of a JSON text as text."""
    return f"get_json_object({x}, '{path}')" if d is Spark else f"json_extract_string({x}, '{path}')"


def found(d, x: str, pattern: str, group: int = 1) -> str:
    """A group of the first match, or an empty text."""
    return f"regexp_extract({x}, {d.text(pattern)}, {group})"
