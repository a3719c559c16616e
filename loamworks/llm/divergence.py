"""Operator 12: how far the sources of a language differ in their words, by sort-based streaming.

Texts are counted per language, source and term within each task (``partial_counts``: documents that hold the term, occurrences,
least document). These rows are repartitioned by (lang, term, source) and sorted by (lang, term, source, document); a scan over runs
sums them (``run_lengths``). Terms held by at least three documents of their language are kept. A second sort-based scan reads all
sources of a term as one run (``run_scores``) and emits a task's partial sums for pairs of sources and its best terms of each group.

A group without a term still gives it the share p0 = 1 + floor(10^9 / (N + V)). With f(p, q) = floor((p-q)^2 / q), a pair's sum over
all V kept terms is

    V f(p0, q0) + sum over terms of s [f(p, q0) - f(p0, q0)] + sum over terms of the other [f(p0, q) - f(p0, q0)]
                + sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

so that only sources that hold a term meet in the scan; the one-sided sums come from a histogram of the shares of each group. All
sums are of whole numbers and exact up to 9 * 10^13 occurrences a language.

Rows of one term and source are as many as the tasks that counted them, not as the documents; a source or a language that holds a
third of all rows is spread over its terms.

Defined cases: null text, language or source is ''; texts without terms still make their group; a language without kept terms gives
its pairs value 0 and no terms; repeated rows are documents of their own; ids, null ones too, only order the runs and never change
the result; ties rank by the item's UTF-8 bytes; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

LEAST_DOCUMENTS = 3
TOP = 200
UNIT = 1_000_000_000
#: Entries that a counting task holds before it hands them on.
HELD = 1_000_000
#: Groups of at most so many rows are sent to all tasks; more are joined by a shuffle.
SMALL = 10_000

_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters A-Z, lower-cased, and of anything beyond ASCII."""
    return (text or "").encode().translate(_TERMS).split()


# -- counting


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, doc, text) to (lang, term, source, document, df, n), one row a group and term of what the task holds."""
    held: dict = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        while held:
            (lang, source), (least, again, n) = held.popitem()
            names = list(n)
            for at in range(0, len(names), 10_000):
                part = names[at : at + 10_000]
                k = len(part)
                count = np.array([n[t] for t in part], np.int64)
                df = count - np.array([again[t] for t in part], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([source] * k, pa.string()), pa.array(np.full(k, least)), pa.array(df), pa.array(count)],
                    names=["lang", "term", "source", "document", "df", "n"],
                )

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for lang, source, doc, text in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns]):
                found = terms(text)
                if not found:
                    continue
                one = held.setdefault((lang, source), [doc, Counter(), Counter()])
                one[0] = min(one[0], doc)
                before = len(one[2])
                one[2].update(found)
                # a document counts once: what else it has of a term is kept apart, and is not much
                own = Counter(found)
                if len(own) < len(found):
                    for t, more in own.items():
                        if more > 1:
                            one[1][t] += more - 1
                size += len(one[2]) - before
                if size > HELD:
                    yield from hand_on()
                    size = 0
    yield from hand_on()


def _new(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for name in columns:
        c = batch.column(name)
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial counts to one row a run of (lang, term, source): documents and occurrences."""
    key, open_run = ["lang", "term", "source"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(_new(batch, key))
        names = pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(starts)) for c in key], names=key)
        sums = [np.add.reduceat(batch.column(c).to_numpy(), starts) for c in ("df", "n")]
        first = tuple(c[0].as_py() for c in names.columns)
        if open_run is not None:
            if open_run[0] == first:
                for s, more in zip(sums, open_run[1]):
                    s[0] += more
            else:
                yield _run(*open_run)
        last = len(starts) - 1
        open_run = tuple(c[last].as_py() for c in names.columns), [int(s[last]) for s in sums]
        if last:
            yield pa.RecordBatch.from_arrays([*[c[:last] for c in names.columns], *[pa.array(s[:last]) for s in sums]], names=[*key, "df", "n"])
    if open_run is not None:
        yield _run(*open_run)


def _run(names: tuple, sums: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([x], pa.string()) for x in names], *[pa.array([x], pa.int64()) for x in sums]], names=["lang", "term", "source", "df", "n"])


# -- shares


def share(count: Column, of: Column) -> Column:
    """1 + floor(10^9 (count + 1) / of), in two steps of long division: 64 bits hold both."""
    head = (count + 1) * 100_000
    rest = F.pmod(head, of) * 10_000
    return F.lit(1) + _div(head, of) * 10_000 + _div(rest, of)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


# -- scores of runs


class Best:
    """The first TOP terms of each group, by value and then by their bytes; holds little more than these."""

    def __init__(self, top: int) -> None:
        self.top, self.held = top, None

    def add(self, rows: pa.Table) -> None:
        self.held = rows if self.held is None else pa.concat_tables([self.held, rows])
        if self.held.num_rows > 200_000:
            self.cut()

    def cut(self) -> None:
        rows = self.held.sort_by([("lang", "ascending"), ("source", "ascending"), ("value", "descending"), ("item", "ascending")]).combine_chunks()
        batch = rows.to_batches()[0] if rows.num_rows else None
        if batch is not None:
            starts = np.flatnonzero(_new(batch, ["lang", "source"]))
            at = np.arange(batch.num_rows)
            rank = at - starts[np.searchsorted(starts, at, side="right") - 1]
            rows = rows.filter(pa.array(rank < self.top))
        self.held = rows


def run_scores(top: int):
    """Sorted (lang, term, source, p, p0, q) to partial rows (lang, source, part, item, value): what pairs of sources that both hold
    a term add to their one-sided sums, and the best terms of each group."""

    def out(lang: list, source: list, part: str, item: list, value: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([part] * len(value), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        sums: dict = {}
        best = Best(top)

        def pairs() -> pa.RecordBatch:
            names = list(codes)
            keys = list(sums)
            return out([names[a][0] for a, _ in keys], [names[a][1] for a, _ in keys], "pair", [names[b][1] for _, b in keys], list(sums.values()))

        def score(rows: pa.Table) -> None:
            batch = rows.combine_chunks().to_batches()[0]
            p, p0, q = (batch.column(c).to_numpy() for c in ("p", "p0", "q"))
            better = p > q
            if better.any():
                mask = pa.array(better)
                best.add(pa.table({"lang": batch.column("lang").filter(mask), "source": batch.column("source").filter(mask), "item": batch.column("term").filter(mask), "value": pa.array(_gap(p[better], q[better]))}))
            code = np.array([codes.setdefault(k, len(codes)) for k in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())])
            starts = np.flatnonzero(_new(batch, ["lang", "term"]))
            sizes = np.diff(np.append(starts, batch.num_rows))
            for m in np.unique(sizes[sizes > 1]):
                at = starts[sizes == m]
                for i in range(m):
                    for j in range(0, m, 512):  # one source with some others, over all runs of this length
                        x = at[:, None] + i
                        y = at[:, None] + np.arange(j, min(m, j + 512))[None, :]
                        more = _gap(p[x], p[y]) - _gap(p[x], p0[y]) - _gap(p0[x], p[y]) + _gap(p0[x], p0[y])
                        key = (code[x] * len(codes) + code[y]).ravel()
                        order = np.argsort(key, kind="stable")
                        cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                        for k, v in zip(key[order][cut].tolist(), np.add.reduceat(more.ravel()[order], cut).tolist()):
                            pair = divmod(k, len(codes))
                            if pair[0] != pair[1]:
                                sums[pair] = sums.get(pair, 0) + v

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            last = int(np.flatnonzero(_new(rows.to_batches()[0], ["lang", "term"]))[-1])  # the last term may go on
            if last:
                score(rows.slice(0, last))
            held = rows.slice(last).combine_chunks()
            if len(sums) > 1_000_000:
                yield pairs()
                sums.clear()
        if held is not None:
            score(held)
        yield pairs()
        if best.held is not None:
            best.cut()
            for b in best.held.to_batches():
                yield out(b.column("lang"), b.column("source"), "term", b.column("item"), b.column("value"))

    return run


# -- the whole


def _joined(rows: DataFrame, groups: DataFrame, on: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, on)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Per (lang, source): its gaps to every other source of the language (part pair) and its most typical terms (part term)."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0)).alias("doc"), "text")
    counts = rows.mapInArrow(partial_counts, "lang string, term string, source string, document long, df long, n long")
    sorted_ = counts.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source", "document")
    runs = stash(sorted_.mapInArrow(run_lengths, "lang string, term string, source string, df long, n long"))
    whole = Window.partitionBy("lang", "term")
    kept = runs.withColumns({"total": F.sum("n").over(whole), "held": F.sum("df").over(whole), "leads": F.min("source").over(whole) == F.col("source")})
    kept = stash(kept.filter(F.col("held") >= least).select("lang", "term", "source", "n", "total", "leads"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum(F.col("leads").cast("long")).alias("v"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "all_n", "v"])
    of, of_all = F.col("n") + F.col("v"), F.col("all_n") + F.col("v")
    groups = stash(groups.select("lang", "source", "v", of.alias("of"), of_all.alias("of_all"), F.when(F.col("v") > 0, share(F.lit(0), of)).otherwise(F.lit(1)).cast("long").alias("p0")))
    few = groups.count() <= SMALL
    # a share for each kept term that a group holds
    held = _joined(kept.drop("leads"), groups, ["lang", "source"], few)
    held = held.select("lang", "term", "source", share(F.col("n"), F.col("of")).alias("p"), "p0", share(F.col("total"), F.col("of_all")).alias("q"))
    scored = held.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    scored = stash(scored.mapInArrow(run_scores(top), "lang string, source string, part string, item string, value long"))
    # sums of one side, from how many terms of a group have a share
    shares = held.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("h"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "v")
    met = _joined(shares, others, ["lang"], few).filter("source != item")
    both = gap(F.col("p0"), F.col("q0"))
    ahead = met.select("lang", "source", "item", (F.col("h") * (gap(F.col("p"), F.col("q0")) - both)).alias("value"))
    behind = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("h") * (gap(F.col("q0"), F.col("p")) - gap(F.col("q0"), F.col("p0")))).alias("value"))
    base = _joined(groups.select("lang", "source", "p0"), others, ["lang"], few).filter("source != item").select("lang", "source", "item", (F.col("v") * both).alias("value"))
    parts = base.unionByName(ahead).unionByName(behind).unionByName(scored.filter("part = 'pair'").select("lang", "source", "item", "value"))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumns({"rank": rank, "part": F.lit("pair")}).select(*columns)
    typical = scored.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top).select(*columns)
    return pairs.unionByName(typical)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
words AS (SELECT lang, source, doc, unnest(found) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
langs AS (SELECT lang, sum(total)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, source),
grps AS (
  SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS all_n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source LEFT JOIN langs l ON l.lang = g.lang),
given AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (g.all_n + g.v) AS q
  FROM grps g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM grps a JOIN grps b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN given x ON x.lang = a.lang AND x.source = a.source LEFT JOIN given y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
typical AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term) AS rank
  FROM given WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, rank::INTEGER FROM typical WHERE rank <= 200
"""
