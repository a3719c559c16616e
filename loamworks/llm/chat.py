"""Operator 3: chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role merge into a block by array aggregation,
and blocks are concatenated:

    ### role: text<+>text of the next turn of the same role</turn>\\n

Roles and texts are escaped, reversibly: \\ # < : become \\b \\h \\l \\c (the colon in roles only). So no text can hold a mark of
the template, which all have # or <. ``read_back`` splits at the marks and unescapes. The loss mask covers the texts of assistant
turns in the output, as spans of code points.

Defined cases: null texts and roles count as empty; turns of equal number are ordered by role and then text, null numbers first;
repeated rows are turns of their own; a null conv_id is a conversation; columns beyond the four do not matter; an empty table gives
no conversations; texts of any length are kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD, JOINT, END = "### ", "<+>", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"
BLOCKS = "array<struct<role:string,texts:array<string>>>"
SPANS = "array<struct<start:int,end:int>>"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
LEARNT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in (*ESCAPES, *(((":", "\\c"),) if role else ())):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((":", "\\c"), *reversed(ESCAPES)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _merged(turns: Column) -> Column:
    """Blocks of adjacent turns of one role."""

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == t["role"])
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        new = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)).cast(BLOCKS)).otherwise(F.concat(acc, F.array(new)).cast(BLOCKS))

    return F.aggregate(turns, F.array().cast(BLOCKS), step)


def format_chats(df: DataFrame) -> DataFrame:
    """One row for each conv_id: formatted, and loss_spans (start and end of each assistant text in it, code points)."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select("conv_id", F.struct("turn", whole("role").alias("role"), whole("text").alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chats = chats.withColumn("blocks", _merged(F.transform("turns", lambda t: F.struct(escape(t["role"], role=True).alias("role"), escape(t["text"]).alias("text")))))
    block = lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(": "), F.array_join(b["texts"], JOINT), F.lit(END))

    def place(acc: Column, b: Column) -> Column:
        """Adds the block's assistant texts; each text is followed by a joint or the end."""
        start = acc["at"] + F.length(b["role"]) + len(HEAD) + 2

        def text(inner: Column, t: Column) -> Column:
            end = inner["at"] + F.length(t)
            one = F.array(F.struct(inner["at"].alias("start"), end.alias("end")))
            return F.struct((end + len(JOINT)).alias("at"), F.when(b["role"] == LEARNT, F.concat(inner["out"], one)).otherwise(inner["out"]).cast(SPANS).alias("out"))

        done = F.aggregate(b["texts"], F.struct(start.alias("at"), acc["out"].alias("out")), text)
        return F.struct((done["at"] - len(JOINT) + len(END)).alias("at"), done["out"].alias("out"))

    spans = F.aggregate("blocks", F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), place, lambda a: a["out"])
    return chats.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(df: DataFrame) -> DataFrame:
    """Formatted chats with turns (role and text of each turn) and loss_text (all that the loss mask covers), both unescaped."""
    ends = F.split("formatted", "</turn>\n", -1)
    blocks = F.slice(ends, 1, F.size(ends) - 1)

    def turns(b: Column) -> Column:
        colon = F.instr(b, ": ")
        role = b.substr(F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
        texts = F.split(b.substr(colon + 2, F.length(b)), "<\\+>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"])))
    return df.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": F.array_join(loss, "")})


def digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold the template's own marks.
HARD = ((-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD, "conv_id long, turn long, role string, text string")
    return digests(read_back(format_chats(rows.unionByName(hard))))


def _duck(x: str, role: bool = False) -> str:
    for plain, code in (*ESCAPES, *(((":", "\\c"),) if role else ())):
        x = f"replace({x}, '{plain}', '{code}')"
    return x


#: The rows in DuckDB: a block's head and end count once, a joint for each further turn in it.
ORACLE_SQL = f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES {', '.join(f"({h[0]}, {h[1]}, '{h[2]}', '{h[3]}')" for h in HARD)}) AS h),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNT}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{LEARNT}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length({_duck('text')}) + CASE WHEN before = role THEN {len(JOINT)} ELSE length({_duck('role', True)}) + {len(HEAD) + 2 + len(END)} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
