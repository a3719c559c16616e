"""Operator 11: an exact Jaccard join of documents by their word shingles, with signature trees.

A document's set holds its distinct 4-word shingles. Two sets link when 100 * shared >= 85 * union; the result is the components of
these links. Texts with the same words are one set from the start. Then:

1. ``describe``: each set's size, its signature (``sigtree``) and its prefix: by the prefix filter two sets that link share one of
   their first n - ceil(0.85 n) + 1 tokens in any common order. Tokens that a sample of the texts holds often come last, the others by
   hash; the order changes the work, never the result.
2. ``candidates``: sets that share a prefix token meet in that token's list. Each list is joined by dual traversal of signature trees;
   pairs whose greatest possible overlap suffices are edges, up to connectivity. Long lists are cut into parts by a hash of the set,
   and each pair of parts is a block of its own.
3. Components of these edges are blocks in which the texts themselves meet: again signature trees, with wider signatures, and each
   pair that remains is verified on its shingles (``verify``). A large component is cut into parts. First each part is joined within
   itself, then with one set of the main component of every other part, and at last the sets that are then still outside the
   component's main part meet all others; sets in one component never meet again.

No link is lost: every pair that links is an edge of step 2 or connected by edges, and in step 3 each pair of a block is compared,
cut off by a bound, or in one component.

Defined cases: null and empty texts and those without words have no shingles and link with nothing; fewer words than a shingle make
one, the whole sequence; repeated rows and repeated or null ids are kept row for row, a component's id is the least id that is not
null, or null if there is none; equal sizes and hashes are no matter; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sigtree
from .common import stash, table
from .components import components

SHINGLE = 4
RULE = (85, 100)
SEED = 11
#: Texts from which frequent tokens are learnt, about; and how many tokens are kept as frequent at most. Both only order tokens.
SAMPLE = 20_000
FREQUENT = 200_000
#: Rows of a part of a list, and shingles of a part of a component.
PART = 50_000
SHINGLES = 1_000_000
#: Places of the filter that tells which texts are not needed again.
PLACES = 1 << 22
#: Signatures of texts are so many times wider than those of lists.
WIDER = 8


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only


def shingles(joined: bytes, k: int = SHINGLE) -> set[bytes]:
    """Distinct shingles of words that are joined by one space."""
    if not joined:
        return set()
    a = np.frombuffer(joined, np.uint8)
    cuts = np.flatnonzero(a == 0x20)
    if len(cuts) < k:
        return {joined}
    starts = np.concatenate([[0], cuts + 1])[: len(cuts) + 2 - k].tolist()
    ends = np.concatenate([cuts, [len(a)]])[k - 1 :].tolist()
    return {joined[i:j] for i, j in zip(starts, ends)}


def hashes(found: set[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in found], np.uint64)


def digest_of(joined: bytes) -> bytes:
    return hashlib.blake2b(joined, digest_size=16).digest()


# -- 1. sets, signatures, prefixes


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all shingles."""
    for batch in batches:
        for x in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(hashes(shingles(b" ".join(words(x.as_py())))).view(np.int64))], names=["token"])


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that at least two sampled texts hold, in ascending order, and how many do."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.withColumn("mark", F.xxhash64("text")).filter(F.pmod("mark", F.lit(every)) == 0).dropDuplicates(["mark"]).select("text")
    found = sample.mapInArrow(tokens, "token long").groupBy("token").count().filter("count > 1").orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    token, n = found.column("token").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefix_of(h: np.ndarray, often: tuple[np.ndarray, np.ndarray], rule: sigtree.Threshold) -> np.ndarray:
    rank = np.zeros(len(h), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], h), len(often[0]) - 1)
        rank = np.where(often[0][at] == h, often[1][at], 0)
    h = h[np.lexsort((h, rank))]
    n = rule.prefix(len(h))
    while 0 < n < len(h) and h[n] == h[n - 1]:  # shingles of one hash are all in or out
        n += 1
    return h[:n]


def describe(often: tuple[np.ndarray, np.ndarray], rule: sigtree.Threshold):
    """(doc_id, text) to (doc_id, digest, n, tokens, bits); a text that the task has just had goes without tokens and bits."""
    names = ["doc_id", "digest", "n", "tokens", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out: list[list] = [[], [], [], []]
                for x in part.column(1):
                    joined = b" ".join(words(x.as_py()))
                    digest = digest_of(joined)
                    n, first, bits = seen.get(digest), None, None
                    if n is None:
                        h = hashes(shingles(joined))
                        n = len(h)
                        first, bits = prefix_of(h, often, rule).view(np.int64), sigtree.signature(h, sigtree.width(n))
                        if len(seen) > 100_000:
                            seen.clear()
                        seen[digest] = n
                    for column, value in zip(out, (digest, n, first, bits)):
                        column.append(value)
                kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=names)

    return run


# -- 2. candidate edges from lists


def shared(rule: sigtree.Threshold):
    """Rows (token, id, n, pos), sorted by token and n, that have a neighbour in their token's list whose size fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether it is wanted already
        for batch in batches:
            if not batch.num_rows:
                continue
            table_ = pa.Table.from_batches([batch])
            before = False
            if held is not None:
                table_, before = pa.concat_tables([held[0], table_]), held[1]
            rows = table_.combine_chunks().to_batches()[0]
            token, n = rows.column("token").to_numpy(), rows.column("n").to_numpy()
            fits = (token[1:] == token[:-1]) & (rule.den * n[:-1] >= rule.num * n[1:])
            wanted = np.append(before, fits) | np.append(fits, False)
            held = pa.Table.from_batches([rows.slice(rows.num_rows - 1)]), bool(wanted[-1])
            out = rows.slice(0, rows.num_rows - 1).filter(pa.array(wanted[:-1]))
            if out.num_rows:
                yield out
        if held is not None and held[1]:
            yield from held[0].to_batches()

    return run


def candidates(rule: sigtree.Threshold):
    """Rows (token, a, b, part, id, n, pos, bits), sorted by the first three, to edges (u, v) of sets that may link. A block a = b
    compares all its rows, another one those of part a with those of part b."""

    def edges(ids: list, n: list, pos: list, part: list, bits: list, across: tuple[int, int] | None) -> list[tuple[int, int]]:
        items = [(size, int.from_bytes(x, "little"), len(x) * 8) for size, x in zip(n, bits)]

        def link(i: int, j: int) -> bool:
            # if this token is the first that both hold, no more than what follows it can be shared
            return ids[i] != ids[j] and rule.links(min(n[i] - pos[i], n[j] - pos[j]), n[i] + n[j])

        sides = (None, None) if across is None else tuple([i for i, p in enumerate(part) if p == side] for side in across)
        return [(ids[i], ids[j]) for i, j in sigtree.join(items, *sides, rule, sigtree.Sets(len(ids)), link)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("token", "a", "b", "part", "id", "n", "pos", "bits")
        held: list[list] = [[] for _ in columns]
        known: set[tuple[int, int]] = set()

        def settle(lo: int, hi: int) -> None:
            token, a, b, part, ids, n, pos, bits = (c[lo:hi] for c in held)
            for u, v in edges(ids, n, pos, part, bits, None if a[0] == b[0] else (a[0], b[0])):
                known.add((min(u, v), max(u, v)))

        def out() -> pa.RecordBatch:
            pairs = np.array(sorted(known), np.int64).reshape(-1, 2)
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            for c, name in zip(held, columns):
                c.extend(batch.column(name).to_pylist())
            lo = 0
            for i in range(1, len(held[0])):
                if held[0][i] != held[0][lo] or held[1][i] != held[1][lo] or held[2][i] != held[2][lo]:
                    if i - lo > 1:
                        settle(lo, i)
                    lo = i
            held = [c[lo:] for c in held]
            if len(known) > 200_000:
                yield out()
        if len(held[0]) > 1:
            settle(0, len(held[0]))
        yield out()

    return run


def candidate_edges(sets: DataFrame, rule: sigtree.Threshold) -> DataFrame:
    first = sets.filter("n > 0").select("id", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    lists = first.repartition("token").sortWithinPartitions("token", "n").select("token", "id", "n", "pos")
    lists = stash(lists.mapInArrow(shared(rule), "token long, id long, n int, pos int"))
    # a set stands once in a list, where it stands first
    long_ = lists.groupBy("token").count().filter(F.col("count") > PART).select("token", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    lists = lists.join(long_, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    lists = lists.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = lists.join(sets.select("id", "bits"), "id")
    rows = rows.select("token", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "id", "n", "pos", "bits")
    rows = rows.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b")
    return rows.mapInArrow(candidates(rule), "u long, v long").distinct()


# -- 3. verified links


def needed(places: np.ndarray):
    """(text) to (digest, words) of texts whose digest may be among those wanted; a task gives each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                keep: list[tuple[bytes, bytes]] = []
                for x in batch.column(0).slice(start, 512):
                    joined = b" ".join(words(x.as_py()))
                    digest = digest_of(joined)
                    if places[int.from_bytes(digest[:8], "little") % len(places)] and digest not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(digest)
                        keep.append((digest, joined))
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.binary()) for i in (0, 1)], names=["digest", "words"])

    return run


def place_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted({int.from_bytes(x.as_py()[:8], "little") % PLACES for x in batch.column(0)}), pa.int64())], names=["place"])


def verify(rule: sigtree.Threshold):
    """Rows (block, part, turn, side, id, label, words), sorted by the first three, to links (u, v). Side 0 is compared with all of its
    block, else side 1 with side 2; sets with one label are known to be in one component."""

    def links(ids: list, side: list, label: list, texts: list[bytes]) -> list[tuple[int, int]]:
        h = [hashes(shingles(x)) for x in texts]
        n = [len(x) for x in h]
        wide = [sigtree.width(k, WIDER) for k in n]
        items = [(k, int.from_bytes(sigtree.signature(x, w), "little"), w) for k, x, w in zip(n, h, wide)]
        sets = sigtree.Sets(len(ids))
        first: dict = {}
        for at, x in enumerate(label):
            sets.union(first.setdefault(x, at), at)
        as_set: dict[int, frozenset] = {}

        def of(i: int) -> frozenset:
            if i not in as_set:
                as_set[i] = frozenset(h[i].tolist())
            return as_set[i]

        def link(i: int, j: int) -> bool:
            x, y = of(i), of(j)
            if len(x) == n[i] and len(y) == n[j] and not rule.links(len(x & y), n[i] + n[j]):
                return False
            return rule.links(len(shingles(texts[i]) & shingles(texts[j])), n[i] + n[j])

        sides = (None, None) if not any(side) else tuple([i for i, s in enumerate(side) if s == want] for want in (1, 2))
        return [(ids[i], ids[j]) for i, j in sigtree.join(items, *sides, rule, sets, link)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("block", "part", "turn", "side", "id", "label", "words")
        held: list[list] = [[] for _ in columns]

        def settle(rows: list[list]) -> pa.RecordBatch:
            found = np.array(links(*rows[4:5], rows[3], rows[5], rows[6]), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        for batch in batches:
            for c, name in zip(held, columns):
                c.extend(batch.column(name).to_pylist())
            lo = 0
            for i in range(1, len(held[0])):
                if any(c[i] != c[lo] for c in held[:3]):
                    if i - lo > 1:
                        yield settle([c[lo:i] for c in held])
                    lo = i
            held = [c[lo:] for c in held]
        if len(held[0]) > 1:
            yield settle(held)

    return run


def _verified(rows: DataFrame, rule: sigtree.Threshold) -> DataFrame:
    rows = rows.select("block", F.col("part").cast("int").alias("part"), F.col("turn").cast("int").alias("turn"), F.col("side").cast("int").alias("side"), "id", "label", "words")
    return stash(rows.repartition("block", "part", "turn").sortWithinPartitions("block", "part", "turn").mapInArrow(verify(rule), "u long, v long"))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("id"), F.col("component").alias("found"))
    return rows.drop("label").join(found, "id", "left").withColumn("label", F.coalesce("found", "id")).drop("found")


def _main(rows: DataFrame, *by: str) -> DataFrame:
    """Per block (and part): the label that most of its rows have, and the least id of these."""
    each = rows.groupBy(*by, "label").agg(F.count("*").alias("k"), F.min("id").alias("one"))
    return each.groupBy(*by).agg(F.max(F.struct("k", "label", "one")).alias("m")).select(*by, F.col("m.label").alias("main"), F.col("m.one").alias("one"))


def links_of_blocks(texts: DataFrame, rule: sigtree.Threshold) -> DataFrame:
    """Verified links, up to connectivity, of sets (id, block, parts, part, n, words)."""
    rows = texts.withColumn("label", F.col("id"))
    links = _verified(rows.withColumns({"turn": F.lit(0), "side": F.lit(0)}), rule)
    cut = rows.filter("parts > 1")
    if cut.isEmpty():
        return links
    # one set of each part's main component meets the other parts
    cut = stash(_labelled(cut, links))
    one = _main(cut, "block", "part").select("one")
    pivots = cut.join(one, F.col("id") == F.col("one"), "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other != part")
    met = cut.select("block", "part", F.lit(2).alias("side"), "id", "label", "words").unionByName(pivots.select("block", F.col("other").alias("part"), F.lit(1).alias("side"), "id", "label", "words"))
    links = stash(links.unionByName(_verified(met.withColumn("turn", F.lit(0)), rule)))
    # what is outside the main component then meets all
    cut = stash(_labelled(cut, links))
    main = _main(cut, "block").select("block", "main")
    outside = stash(cut.join(main, "block").filter("label != main").drop("main"))
    turns = outside.groupBy("block").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("turns"))
    outside = outside.join(turns, "block").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(SEED)), "turns"))
    left = outside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
    right = cut.join(turns, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("side", F.lit(2))
    columns = ["block", "part", "turn", "side", "id", "label", "words"]
    return links.unionByName(_verified(left.select(*columns).unionByName(right.select(*columns)), rule))


# -- the whole


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", num: int = RULE[0], den: int = RULE[1]) -> DataFrame:
    """One row per row of the table: doc_id, n_shingles and component_id."""
    if not 0 < num <= den or 2 * num <= den:
        raise ValueError("the threshold has to be over one half, and one at most")
    rule = sigtree.Threshold(num, den)
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    often = frequent(docs.select("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stash(docs.mapInArrow(describe(often, rule), f"doc_id {kind}, digest binary, n long, tokens array<long>, bits binary"))
    sets = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.first("tokens", ignorenulls=True).alias("tokens"), F.first("bits", ignorenulls=True).alias("bits"))
    sets = stash(sets.withColumn("id", F.monotonically_increasing_id()))
    blocks = stash(components(candidate_edges(sets, rule)).select(F.col("node").alias("id"), F.col("component").alias("block")))
    wanted = sets.select("id", "digest", "n").join(blocks, "id")
    parts = wanted.groupBy("block").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("parts"))
    wanted = stash(wanted.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")))
    places = np.zeros(PLACES, bool)
    places[wanted.select("digest").mapInArrow(place_of, "place long").distinct().toArrow().column(0).to_numpy()] = True
    texts = docs.select("text").mapInArrow(needed(places), "digest binary, words binary")
    texts = stash(texts.join(wanted, "digest").dropDuplicates(["id"]).drop("digest"))
    final = components(links_of_blocks(texts, rule)).select(F.col("node").alias("id"), "component")
    named = sets.select("id", "digest", "least").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = stash(named.select("digest", "least", "component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("digest", "component_id")
    found = rows.select("doc_id", "digest", F.col("n").alias("n_shingles")).join(named, "digest")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
