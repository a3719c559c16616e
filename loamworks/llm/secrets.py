"""Operator 2: secret scans. DataFrame operations only.

Three kinds of secrets have a fixed form: an assignment to a telling name, an access key id and a long hexadecimal string.
Matches of each kind are the leftmost ones that do not overlap; those that fail the kind's length are dropped.

The entropy scan adds to them. Its candidates are long runs of key characters. A window slides over each candidate with a count for
each character; a step changes the counts of the entering and of the leaving one, which give the window's Shannon entropy from the
one before. Windows at or above the limit of
the candidate's character class (hexadecimal, alphanumeric or base64) make a span, from the first such window to the end of the
last. Candidates of the allow-list are passed over: those of one kind of letters without digits, UUIDs, and those that hold an
alphabet or a placeholder. Spans within one of the fixed forms add nothing and are left out.

A place is found by cutting the text at the matches and summing up lengths, so it is in code points, the end exclusive.

Defined cases: null and empty texts have no spans; repeated rows give repeated results; columns named like an output are
replaced, all others are kept whatever their names; an empty table gives an empty table; texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, table, without

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The characters of candidates, in the order of their counts.
KEY_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_VALUE = 12
#: Window and least entropy in bits for each character class of candidates.
CLASSES = (("entropy_hex", r"^[0-9a-fA-F]+$", 16, 2.8), ("entropy_alnum", r"^[0-9A-Za-z]+$", 20, 3.6), ("entropy_base64", r"", 20, 3.7))
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
#: Placeholders that make a candidate harmless.
ALLOWED = ("example", "placeholder", "changeme", "xxxxxxxx", "abcdefghijkl", "0123456789", "00000000")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SPAN = "array<struct<start:int,rank:int,end:int>>"
PLACED = "array<struct<start:int,end:int,word:string>>"


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """Start, end and match for each match: the gaps between matches and the matches, summed up."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"))
    none = F.array().cast(PLACED)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("word")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def _spans(placed: Column, kind: str) -> Column:
    return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"))).cast(SPAN)


def _weight(n: Column, most: int) -> Column:
    """n log2 n for 0 <= n <= most."""
    return F.element_at(F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(most + 1)]), (n + 1).cast("int"))


def entropy_span(word: Column, window: int, least: float) -> Column:
    """First and end (exclusive) of the windows of a candidate whose entropy reaches the limit; first is -1 if none does."""
    signs = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(KEY_SIGNS), c))

    def step(acc: Column, i: Column) -> Column:
        full = i >= window
        come = F.element_at(acc["signs"], i + 1)
        leave = F.when(full, F.element_at(acc["signs"], i + 1 - window)).otherwise(F.lit(0))
        there = F.element_at(acc["counts"], come)
        left = F.when(full, F.element_at(acc["counts"], F.greatest(leave, F.lit(1)))).otherwise(F.lit(1))
        change = _weight(there + 1, window) - _weight(there, window) + F.when(full, _weight(left - 1, window) - _weight(left, window)).otherwise(F.lit(0.0))
        total = acc["total"] + F.when(come == leave, F.lit(0.0)).otherwise(change)
        counts = F.transform(acc["counts"], lambda n, k: n + (k + 1 == come).cast("int") - (k + 1 == leave).cast("int"))
        high = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= least)
        return F.struct(
            acc["signs"].alias("signs"),
            counts.alias("counts"),
            total.alias("total"),
            F.when(high & (acc["first"] < 0), i - window + 1).otherwise(acc["first"]).alias("first"),
            F.when(high, i + 1).otherwise(acc["end"]).alias("end"),
        )

    none = F.array_repeat(F.lit(0), len(KEY_SIGNS))
    start = F.struct(signs.alias("signs"), none.alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("end"))
    return F.aggregate(F.sequence(F.lit(0), F.length(word) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["end"].alias("end")))


def allowed(word: Column) -> Column:
    """Whether the allow-list passes a candidate over."""
    low = F.lower(word)
    kinds = sum((word.rlike(p).cast("int") for p in ("[0-9]", "[a-z]", "[A-Z]")), F.lit(0))
    harmless = word.rlike(UUID) | (kinds < 2)
    for x in ALLOWED:
        harmless = harmless | low.contains(x)
    return harmless


def _shifted(start: Column, rank: int):
    """A span from a place in a word; without one, an empty span."""

    def shift(s: Column) -> Column:
        return F.struct((start + s["first"]).alias("start"), F.lit(rank).alias("rank"), (start + s["end"]).alias("end"))

    return shift


def _entropy_spans(placed: Column) -> Column:
    """Spans of all classes in the candidates."""

    def one(x: Column) -> Column:
        out, rest = F.array().cast(SPAN), F.lit(True)
        for kind, pattern, window, least in CLASSES:
            here = rest & x["word"].rlike(pattern) if pattern else rest
            found = entropy_span(x["word"], window, least)
            made = F.filter(F.transform(F.array(found), _shifted(x["start"], KINDS.index(kind))), lambda s: s["end"] > s["start"]).cast(SPAN)
            out = F.when(here, made).otherwise(out)
            if pattern:
                rest = rest & ~x["word"].rlike(pattern)
        return out

    kept = F.filter(placed, lambda x: ~allowed(x["word"]))
    return F.flatten(F.transform(kept, one))


def find_secrets(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "secret_spans") -> DataFrame:
    """The table with two arrays of structs (start, rank, end) in order: spans of fixed forms, and all spans. ``rank`` is the
    place in KINDS."""
    df = without(df, base, spans)
    kept = df.columns
    whole_, assign_, value_, access_, hex_, candidate_ = free_names(df, "whole", "assign", "value", "access", "hex", "candidate")
    df = df.withColumn(whole_, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    every = lambda p, g: F.regexp_extract_all(F.col(whole_), F.lit(p), F.lit(g))
    df = df.withColumns({assign_: every(ASSIGN, 0), value_: every(ASSIGN, 2), access_: every(ACCESS, 0), hex_: every(HEX, 0), candidate_: every(CANDIDATE, 0)})
    place = lambda col, p: _placed(F.col(whole_), F.col(col), p)
    named = F.arrays_zip(place(assign_, ASSIGN).alias("p"), F.col(value_).alias("v"))
    named = F.transform(F.filter(named, lambda x: F.length(x["v"]) >= MIN_VALUE), lambda x: x["p"])
    fixed = F.concat(_spans(named, "assign"), _spans(place(access_, ACCESS), "access"), _spans(place(hex_, HEX), "hex"))
    df = df.withColumn(base, F.array_sort(fixed))
    added = F.filter(_entropy_spans(place(candidate_, CANDIDATE)), lambda s: ~F.exists(F.col(f"`{base}`"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    df = df.withColumn(spans, F.when(F.size(candidate_) > 0, F.array_sort(F.concat(F.col(f"`{base}`"), added))).otherwise(F.col(f"`{base}`")))
    return df.select(*[F.col(f"`{c}`") for c in [*kept, base, spans]])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The table with the mark in place of each run of characters that spans cover."""
    base_, spans_ = free_names(df, "base", "spans")
    found = find_secrets(df, text, base_, spans_)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.col(f"`{text}`").substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        piece = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    whole = F.col(f"`{text}`")
    clean = F.aggregate(F.col(spans_), start, step, lambda acc: F.concat(acc["out"], whole.substr(acc["at"] + 1, F.length(whole))))
    return found.withColumn(text, F.when(F.size(spans_) > 0, clean).otherwise(whole)).select(*[F.col(f"`{c}`") for c in df.columns])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"))
