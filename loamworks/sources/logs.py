"""Conversation logs: JSON lines to messages, and reading only what is new."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markers as M


def _texts(node: object) -> list[str]:
    """Text of a content node: a string, blocks, or an object with either."""
    if isinstance(node, str):
        return [node]
    if isinstance(node, list):
        return [t for x in node for t in _texts(x)]
    if not isinstance(node, dict) or node.get("type") in M.BLOCK_OTHER:
        return []
    if isinstance(node.get("text"), str):
        return [node["text"]]
    return [] if node.get("type") in M.BLOCK_TEXT else _texts(node.get("content"))


def _authored(node: object) -> list[str]:
    """What users wrote, in the order of the line."""
    if isinstance(node, list):
        return [t for x in node for t in _authored(x)]
    if not isinstance(node, dict):
        return []
    wanted = []
    if node.get("role") == "user":
        wanted += ["content", "text"]
    if node.get("type") == "user":
        wanted += ["message", "content"]
    if node.get("type") == "user_message":
        wanted += ["content"]
    return [t for k in wanted for t in _texts(node.get(k))] + _authored(node.get("message")) + _authored(node.get("payload"))


def line_texts(line: str | None) -> list[str]:
    """Texts of one JSON line; none for lines that are no JSON, meta or of other sorts."""
    try:
        node = json.loads(line or "")
    except ValueError:
        return []
    if isinstance(node, dict) and (node.get("isMeta") is True or node.get("type") in M.LOG_TYPES):
        return []
    low = json.dumps(node, ensure_ascii=False).lower()
    return [] if any(w in low for w in M.LOG_NOISE) else _authored(node)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _line_texts(lines: pd.Series) -> pd.Series:
    return lines.map(line_texts)


def is_blob(text: Column) -> Column:
    """Texts that tools put into conversations: session rules, dispatched briefs, continued summaries, controllers' and file briefs."""
    low = F.lower(text)
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    some = lambda words: count(words) > 0
    both = lambda pairs: count_of_pairs(low, pairs) > 0
    brief = (some(M.BLOB_ROLES) & some(M.BLOB_TASKS)) | both(M.BLOB_BRIEFS)
    return (count(M.BLOB_SESSION) >= 2) | (count(M.BLOB_CONTROLLER) >= 2) | both(M.BLOB_SUMMARIES) | brief | (some(M.FILE_SCOPE) & some(M.FILE_ACTION))


def count_of_pairs(low: Column, pairs) -> Column:
    return sum(((low.contains(a) & low.contains(b)).cast("int") for a, b in pairs), F.lit(0))


NUMBERED = re.compile("[0-9]{2,}")


def sanitize(text: str | None) -> str:
    """Without filtered blocks and noisy lines; runs of empty lines become one."""
    out: list[str] = []
    inside = False
    for line in (text or "").split("\n"):
        line = line.strip()
        if line and (line in M.OPEN_BLOCKS or line.startswith(M.OPEN_FILES)):
            inside = True
        elif inside and line:
            inside = line not in M.CLOSE_BLOCKS
        elif not line:
            out += [""] if not out or out[-1] else []
        elif not (line.lower().startswith(M.DROP_STARTS) or any(w in line.lower() for w in M.DROP_ANYWHERE) or line.startswith("1\t") or ("\t" in line and NUMBERED.match(line))):
            out.append(line)
    return "\n".join(out).strip()


@F.pandas_udf(T.StringType())
def _sanitize(texts: pd.Series) -> pd.Series:
    return texts.map(sanitize)


def messages(lines: DataFrame) -> DataFrame:
    """One row for each path: body, the cleaned user texts in line order. ``lines``: path, line_no, line."""
    rows = lines.select("path", "line_no", F.posexplode(_line_texts("line")).alias("part", "text"))
    rows = rows.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter((F.col("text") != "") & ~is_blob(F.col("text")))
    before = F.lag("text").over(Window.partitionBy("path").orderBy("line_no", "part"))
    rows = rows.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("text")))
    whole = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return whole.withColumn("body", _sanitize("body")).filter("body != ''")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """path, line_no and line of all JSONL files below a folder, without those below ``subagents``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").format("binaryFile").load(folder)
    files = files.filter(~F.lower("path").contains("/subagents/")).select("path", F.decode("content", "UTF-8").alias("text"))
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def read_new(spark: SparkSession, folder: str, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New lines of the files below a folder, and the new offsets (path, processed_bytes, size, modified). A file of the same
    size and time is skipped, a grown one is read from its offset, another from its start; reading ends at the last line feed, so
    a line that is still being written waits for the next call."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").format("binaryFile").load(folder)
    old = offsets.select("path", F.col("processed_bytes").alias("done"), F.col("size").alias("old_size"), F.col("modified").alias("old_time"))
    files = files.join(old, "path", "left").filter(F.col("done").isNull() | (F.col("old_size") != F.col("length")) | (F.col("old_time") != F.col("modificationTime")))
    start = F.when(F.col("length") > F.col("old_size"), F.col("done")).otherwise(F.lit(0)).cast("int")
    files = files.withColumn("start", F.coalesce(start, F.lit(0))).withColumn("new", F.decode(F.expr("substring(content, start + 1)"), "UTF-8"))
    files = files.withColumn("new", F.regexp_extract("new", r"(?s)^(.*\n)?", 1))
    lines = files.select("path", "start", F.posexplode(F.split("new", "\n")).alias("line_no", "line")).filter("line != ''")
    done = files.select("path", (F.col("start") + F.octet_length("new")).cast("long").alias("processed_bytes"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return lines, offsets.join(done, "path", "left_anti").unionByName(done)
