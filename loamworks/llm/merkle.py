"""Operator 13: a Merkle manifest of a dataset, built level by level with DataFrames.

A leaf is the hash of a row's fields; per language the leaves ascend by doc_id, and every ``fanout`` consecutive nodes become their
hash until one is left, the subroot. Subroots, ordered by language, make the root in the same way. H is sha256 in lowercase hex, of
its inputs concatenated, digests as hex text.

Upwards, each level groups nodes by their index divided by the fanout and keeps the sorted children of each parent (``grow``).
Downwards, each level joins children to their parents, which hold the siblings and the path from there on (``paths``): a node's path
is the siblings before and after it, then its parent's path, so rows shrink with the height instead of being joined once a level
for each leaf. Folding a leaf with its path gives the root again.

Indices come without one task a language (``numbered``): rows are range-partitioned by language and order, ranked within a partition,
and partitions add what stands before them. The driver sees two values: the rows of the largest language and the root.

Defined cases: any field may be null ('-' in the hash; a null language is one, the first); null doc_ids stand first in their language
and are never tampered with; rows with one doc_id are ordered by their leaf, and equal leaves are interchangeable; n_chars that is
null stays null when tampered with; texts of any length; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
TAMPERED = 7
#: Subroots of at most so many languages are sent to all tasks; more are joined by a shuffle.
SMALL = 10_000
#: Levels that are joined in one job on the way down.
AT_ONCE = 4
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", counter: str = "n_chars") -> DataFrame:
    """One row a document: group key ``g`` that orders as languages do, doc_id, leaf, and the leaf after tampering."""
    at = {c: F.col(f"`{c}`") for c in fields}
    more = at | {counter: at[counter].cast("decimal(38,0)") + 1}
    hit = F.crc32(at[order].cast("string")) % TAMPERED == 0
    # changed texts are hashed only where they are changed
    return docs.select(
        F.when(at[group].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), at[group])).alias("g"),
        at[order].alias("doc_id"),
        digest(*[field(at[c]) for c in fields]).alias("leaf"),
        F.when(hit & at[counter].isNotNull(), digest(*[field(more[c]) for c in fields])).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``i``, their place from 0 within their g, and ``total``, the rows of that g."""
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("g", *order, "row")
    ranged = stash(ranged.withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    counts = stash(counts.select("g", "part", before.alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total")))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order, "row")) - 1
    return ranged.withColumn("place", place).join(counts, ["g", "part"]).withColumn("i", F.col("before") + F.col("place")).drop("row", "part", "place", "before")


def grow(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Levels from the leaves (g, i, digest, total) upwards; a level's rows also hold their children, and a g ends where total is 1."""
    if fanout < 2:
        raise ValueError("a run needs two nodes or more")
    levels = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        runs = levels[-1].filter("total > 1").groupBy("g", F.expr(f"i div {fanout}").alias("i"))
        runs = runs.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]).alias("kids"), F.first("total").alias("below"))
        up = runs.select("g", "i", F.sha2(F.array_join("kids", ""), 256).alias("digest"), F.expr(f"(below + {fanout - 1}) div {fanout}").alias("total"), "kids")
        levels.append(stash(up))
        most = -(-most // fanout)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """Per g the digest that remains."""
    found = [x.filter("total = 1").select("g", "digest") for x in levels]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def paths(levels: list[DataFrame], fanout: int) -> DataFrame:
    """The leaves' table with ``path``: for each level up to the subroot the siblings before and after, concatenated."""
    none = F.array().cast(PATH)
    upper = levels[-1].withColumn("path", none)
    for height in range(len(levels) - 2, -1, -1):
        parents = upper.select(F.col("g").alias("pg"), F.col("i").alias("pi"), F.col("kids").alias("pkids"), F.col("path").alias("ppath"))
        lower = levels[height]
        joined = lower.join(parents, (F.col("g") == F.col("pg")) & (F.expr(f"i div {fanout}") == F.col("pi")) & (F.col("total") > 1), "left")
        nth = (F.col("i") % fanout).cast("int")
        step = F.struct(F.array_join(F.slice("pkids", F.lit(1), nth), "").alias("before"), F.array_join(F.slice("pkids", nth + 2, F.lit(fanout)), "").alias("after"))
        upper = joined.withColumn("path", F.when(F.col("total") > 1, F.concat(F.array(step), "ppath")).otherwise(none)).drop("pg", "pi", "pkids", "ppath")
        if height and height % AT_ONCE == 0:
            upper = stash(upper)
    return upper


def siblings(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path and the tampered leaf, null where nothing was changed."""
    rows = stash(numbered(stash(leaves(docs)), ["doc_id", "leaf"]))
    levels = grow(rows.select("g", "i", F.col("leaf").alias("digest"), "total"), fanout)
    subroots = stash(tops(levels))
    # languages in their order are the leaves of the upper tree
    langs = stash(numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("digest")), ["lang"]))
    upper = grow(langs, fanout)
    root = tops(upper).first()  # one digest, or none of an empty table
    top = paths([langs, *upper[1:]], fanout).select(F.col("lang").alias("tg"), F.col("digest").alias("subroot"), F.col("path").alias("rest"))
    top = stash(top.withColumn("root", F.lit(root["digest"] if root else None).cast("string")))
    levels[0] = rows.select("g", "i", "total", "doc_id", "leaf", "tampered")
    found = paths(levels, fanout)
    found = found.join(F.broadcast(top) if top.count() <= SMALL else top, F.col("g") == F.col("tg"))
    return found.select("doc_id", "leaf", "tampered", "subroot", "root", F.concat("path", "rest").alias("path"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents").select(*FIELDS))
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE_SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, n_chars, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda k: ascii(substr(doc_id::VARCHAR, (k + 1)::BIGINT, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, g, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered
  FROM hashed),
rows AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS total FROM leaf),
tree AS (
  SELECT 0 AS height, g, list(leaf ORDER BY i) AS nodes FROM rows GROUP BY g
  UNION ALL
  SELECT height + 1, g, list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM tree WHERE len(nodes) = 1),
crown AS (
  SELECT 0 AS height, list(subroot ORDER BY i) AS nodes FROM subroots
  UNION ALL
  SELECT height + 1, list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM crown WHERE len(nodes) > 1),
steps AS (
  SELECT r.g, r.i, t.height, nodes[(xor(r.i >> t.height, 1) + 1)::BIGINT] AS sibling, (r.i >> t.height) % 2 AS side FROM rows r JOIN tree t ON t.g = r.g WHERE len(nodes) > 1
  UNION ALL
  SELECT r.g, r.i, 1000 + c.height, nodes[(xor(s.i >> c.height, 1) + 1)::BIGINT], (s.i >> c.height) % 2 FROM rows r JOIN subroots s ON s.g = r.g, crown c WHERE len(nodes) > 1),
proofs AS (
  SELECT g, i, list(coalesce(sibling, '') ORDER BY height) AS others, list(CASE WHEN side = 1 THEN coalesce(sibling, '') ELSE '' END || '|' || CASE WHEN side = 0 THEN coalesce(sibling, '') ELSE '' END ORDER BY height) AS path
  FROM steps GROUP BY g, i),
given AS (
  SELECT r.doc_id, r.leaf, s.subroot, c.nodes[1] AS root, sha256(coalesce(array_to_string(p.others, ''), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(r.tampered, r.leaf), coalesce(p.path, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM rows r JOIN subroots s ON s.g = r.g LEFT JOIN proofs p ON p.g = r.g AND p.i = r.i, crown c WHERE len(c.nodes) = 1)
SELECT *, folded_root = root AS verified FROM given
"""
