"""Operator 7: SimHash near-duplicates found by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the document's word
shingles. Fingerprints that differ in at most four bits link; the result is the components of these links.

How links are found, over distinct fingerprints: the 64 bits are cut into segments of 22, 21 and 21. Four errors leave either one
segment without error, or (1, 1, 1) or (2, 1, 1) in some order, so two segments with one error each. The first case is a join on
the segment. For the second, each 23-bit word (a segment with zeros in front) has one nearest word of the perfect Golay code, and
words one bit apart share such an index if one side gives its own and the other those of its neighbours, which are 1 or 6 indices.
For a pair of segments, one side spreads the first and the other the second, so a fingerprint gives at most 11 keys a pair of
segments, all in 24 bits. This finds every link; candidates are verified on the 64 bits.

A key with up to three rows is settled by aggregates: their least, greatest and exclusive-or give all fingerprints. Groups of
many close fingerprints make no pairs either: within each larger key, all are first compared with its least and its greatest
fingerprint only, components are made of what links, and then only fingerprints of different components meet, those outside the
component of the key's least fingerprint with the others.

Defined cases: null and empty texts and those without words have fingerprint zero and link like any other; fewer words than the
shingle length make one shingle; repeated rows and repeated or null ids are kept row for row, a component's id is the least id
that is not null; columns named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, stash, table, without
from .components import components

SEGMENTS = (22, 21, 21)
MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Shingle hashes that are counted at once.
BLOCK = 1 << 16


# -- fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for at in range(0, len(first), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(first)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """The table with each text's fingerprint as a signed 64-bit number, and without the texts."""
    rest = without(df, out)
    schema = T.StructType([*[f for f in rest.schema.fields if f.name != text], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], np.uint64).view(np.int64)
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps)], names=[f.name for f in schema.fields])

    return rest.mapInArrow(run, schema)


# -- the code: 23 bits, 12 of them data, any word within 3 bits of just one code word


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 over GF(2)."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (0xC75 << bit - 11), rest)
    return rest


def _leaders() -> np.ndarray:
    """For each remainder, the error of at most three bits that has it."""
    ones = [1 << b for b in range(23)]
    errors = [0, *ones] + [a | b for a in ones for b in ones if a < b] + [a | b | c for a in ones for b in ones if a < b for c in ones if b < c]
    table = np.zeros(2048, np.int64)
    table[_syndromes(np.array(errors))] = errors
    return table


_LEADERS: list[np.ndarray] = []


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the code word nearest to each 23-bit word: its upper 12 bits."""
    if not _LEADERS:
        _LEADERS.append(_leaders())
    return (words ^ _LEADERS[0][_syndromes(words)]) >> 11


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and indices: for each word the distinct indices of itself and of all words one bit away."""
    around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23))[None, :]], axis=1)
    found = np.sort(nearest(around), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    rows, cols = np.nonzero(new)
    return rows, found[rows, cols]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, keys and sides. Sides 1 and 2 of a key may link; 3 stands on both."""
    u, rows, out, side = fps.view(np.uint64), [], [], []
    parts, shift = [], 0
    for n in SEGMENTS:
        parts.append(((u >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64))
        shift += n
    each = np.arange(len(fps))
    for s, part in enumerate(parts):
        rows.append(each)
        out.append(s << 32 | part)
        side.append(np.full(len(each), 3))
    own, near = [nearest(p) for p in parts], [neighbours(p) for p in parts]
    for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)), 3):
        # the key of both own indices stands on either side, once
        rows.append(each)
        out.append(kind << 32 | own[a] << 12 | own[b])
        side.append(np.full(len(each), 3))
        r, k = near[a]
        r, k = r[k != own[a][r]], k[k != own[a][r]]
        rows.append(r)
        out.append(kind << 32 | k << 12 | own[b][r])
        side.append(np.full(len(r), 1))
        r, k = near[b]
        r, k = r[k != own[b][r]], k[k != own[b][r]]
        rows.append(r)
        out.append(kind << 32 | own[a][r] << 12 | k)
        side.append(np.full(len(r), 2))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(side)


def keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                r, k, s = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r]), pa.array(s.astype(np.int8))], names=["key", "fp", "side"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, side byte")


# -- links and components


def _differ(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _met(df: DataFrame) -> DataFrame:
    """A side of a join that both sides are shuffled for. Spark sizes keys by the fingerprints that they are made of, some thirty times too
    low, and tables by their packed files: it would collect and send either side as long as that looks small."""
    return df.hint("merge")


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Per distinct fingerprint that links to another: fp and component, a fingerprint of its component."""
    if max_bits > 4:
        raise ValueError("the segments find links of up to four bits")
    rows = keyed(fps)
    ends = rows.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n"), F.bit_xor("fp").alias("all")).filter("low < high")
    # of up to three rows, the sums tell all fingerprints: no rows need to meet
    ends = ends.withColumn("middle", F.when(F.col("n") == 3, F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))).otherwise(F.col("low"))).drop("all")
    pairs = (("low", "high"), ("low", "middle"), ("middle", "high"))
    near = [(F.col(x) != F.col(y)) & (_differ(x, y) <= max_bits) for x, y in pairs]
    ends = stash(ends.filter((F.col("n") > 3) | near[0] | near[1] | near[2]))
    few = [ends.filter((F.col("n") <= 3) & c).select(F.col(x).alias("u"), F.col(y).alias("v")) for c, (x, y) in zip(near, pairs)]
    rows = stash(rows.join(_met(ends.filter("n > 3").select("key", "low", "high")), "key"))
    first = [rows.filter((F.col("fp") != F.col(p)) & (_differ("fp", p) <= max_bits)).select(F.col("fp").alias("u"), F.col(p).alias("v")) for p in ("low", "high")]
    links = stash(first[0].unionByName(first[1]).unionByName(few[0]).unionByName(few[1]).unionByName(few[2]).distinct())
    comps = stash(components(links))
    rows = rows.join(_met(comps.withColumnRenamed("node", "fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    rows = stash(rows.select("key", "fp", "side", "component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min_by("component", "fp").alias("main")).filter("a < b").select("key", "main")
    rows = stash(rows.join(_met(mixed), "key"))
    x = rows.filter("component != main").select("key", F.col("fp").alias("fx"), F.col("side").alias("sx"), F.col("component").alias("cx"))
    y = rows.select("key", F.col("fp").alias("fy"), F.col("side").alias("sy"), F.col("component").alias("cy"))
    across = x.join(_met(y), (x["key"] == y["key"]) & (F.col("cx") != F.col("cy")) & ((F.col("sx") != F.col("sy")) | (F.col("sx") == 3)) & (_differ("fx", "fy") <= max_bits))
    more = stash(across.select(F.col("cx").alias("u"), F.col("cy").alias("v")).distinct())
    top = stash(components(more))
    # labels: a fingerprint's first component, and that one's component
    nodes = comps.unionByName(top.join(_met(comps), "node", "left_anti").select("node", F.col("node").alias("component")))
    return nodes.join(_met(top.select(F.col("node").alias("component"), F.col("component").alias("top"))), "component", "left").select(F.col("node").alias("fp"), F.coalesce("top", "component").alias("component"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of the table: doc_id, fp (signed) and component_id, the least id of its component."""
    rows = stash(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle))
    fps = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = fingerprint_components(fps, max_bits)
    named = fps.join(_met(comps), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stash(named)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(_met(named.join(_met(ids), "component").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The table with one row of each component: the least by doc_id (null last), then by a hash of the text. Rows that repeat each
    other in both are one; columns of any name stay as they are."""
    mark_, name_ = free_names(df, "mark", "name")
    content = F.col(f"`{text}`")
    mark = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(content, F.lit(""))).alias("h"))
    marked = df.withColumn(mark_, mark)
    found = near_duplicates(marked.select(mark_, content.alias("text")), "text", mark_)
    keep = found.filter(F.col("doc_id") == F.col("component_id")).select(F.to_json("doc_id").alias(name_)).distinct()
    rows = marked.withColumn(name_, F.to_json(mark_)).join(keep, name_, "left_semi")
    return rows.dropDuplicates([name_]).select(*[F.col(f"`{c}`") for c in df.columns])
