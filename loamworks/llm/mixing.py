"""Operator 4: mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Each source gets a target in words: its share by weight of all words, at most ``max_repeats`` times its own words; what the limit
cuts off goes to the others by weight. Within a source a document is expected e = min(max_repeats, c ln(2 + words)) times, longer
ones more often; c is such that the expected words come to the target. floor(e) copies are certain, and the rest of e is the
document's inclusion probability p for one copy more. Those copies are a sample: documents are ranked by u/(1-u) over p/(1-p), u
being a uniform number made from a hash of the row, and taken in that order while the words missing from the target hold them. What
is left then is filled in rounds from documents that fit, in the same order, until less than ``near`` of the target is missing or
nothing fits. At last one more document, the one nearest to the words still missing, is taken if that brings the sum nearer.

No source is gathered in one task: ranks are found through histograms of the ranking key, twice 1,024 buckets for each source,
so that only the rows of one bucket in a million are ever sorted.

Defined cases: a null text has no words; a null source is a source, the last one; a null or repeated doc_id is no obstacle; rows
that repeat each other in full share one draw and are taken or left together; columns named like an output are replaced, all others
are kept whatever their names; an empty table gives an empty table; sources without words have target 0 and are taken 0 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, stash, table, without

BUCKETS = 1024
#: Repeated rows of at most so many kinds are sent to all tasks; more are joined by a shuffle, texts and all.
FEW = 50_000
SEED = 4
#: Part of a target that may be missing when the rounds end.
NEAR = 0.001
OUT = ("size", "source_size", "target", "copies", "taken")
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
ROUNDS = "array<struct<most:double,key:double,draw:bigint>>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """A left join by source where null equals null."""
    per = per.withColumnRenamed("source", "source_")
    return rows.join(per, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def draw_of(*columns: str) -> Column:
    """A row's draw. A hash passes over nulls, so it also reads which values are null."""
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(SEED), *values, *[v.isNull() for v in values])


# -- targets


def targets(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source (source, source_size): its target in words."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    sums = stash(sums.withColumn("weight", weight))
    most = F.col("source_size") * float(max_repeats)
    total = sums.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    # the level: words for each unit of weight where no source is at its limit
    level = 0.0
    while True:
        at_limit = F.col("weight") * F.lit(level) >= most
        r = sums.agg(F.sum(F.when(at_limit, most)).alias("full"), F.sum(F.when(~at_limit, F.col("weight"))).alias("open")).first() if level else sums.agg(F.lit(0.0).alias("full"), F.sum("weight").alias("open")).first()
        if not r["open"]:
            break
        new = (total - (r["full"] or 0.0)) / r["open"]
        if new <= level:
            break
        level = new
    return sums.withColumn("target", F.least(F.col("weight") * F.lit(level), most)).drop("weight")


def scales(units: DataFrame, per: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The sources with c, at which the expected words of their documents come to the target; null if every document is at its limit."""
    sizes = stash(units.groupBy("source", "size").agg(F.sum("words").alias("words")))
    weight, most = F.log(F.col("size") + 2.0), float(max_repeats)
    per = per.withColumn("c", F.lit(0.0))
    while True:
        full = F.col("c").isNull() | (F.col("c") * weight >= most)
        sums = with_source(sizes, per.select("source", "c")).groupBy("source").agg(
            F.coalesce(F.sum(F.when(full, F.col("words") * most)), F.lit(0.0)).alias("full"),
            F.sum(F.when(~full & (F.col("words") > 0), F.col("words") * weight)).alias("open"),
        )
        new = F.when(F.col("target") > F.col("full"), (F.col("target") - F.col("full")) / F.col("open")).otherwise(F.when(F.col("open").isNotNull(), F.col("c")))
        after = stash(with_source(per, sums).withColumn("new", new))
        # c only grows until the same documents are at their limit as before
        moved = after.filter(~F.col("new").eqNullSafe(F.col("c")) & (F.col("new").isNull() | (F.col("new") > F.col("c") * (1 + 1e-12)))).isEmpty()
        per = after.withColumn("c", F.col("new")).select(*per.columns)
        if moved:
            return per


def expected(size: Column, c: Column, max_repeats: int = MAX_REPEATS) -> Column:
    """How many copies of a document are expected; c is null where all are at the limit."""
    return F.least(F.lit(float(max_repeats)), F.coalesce(c * F.log(size + 2.0), F.lit(float(max_repeats))))


# -- the sample


def rank_key(draw: Column, p: Column) -> Column:
    """q/(1+q) of the Pareto rank q = (u/(1-u)) / (p/(1-p)): the same order within 0 and 1, about 1/2 where the sample ends."""
    u = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / float(1 << 53)
    a, b = u * (1 - p), (1 - u) * p
    return F.when(p > 0, a / (a + b)).otherwise(F.lit(1.0))


def picked(rounds: Column, amount: Column, key: Column, draw: Column) -> Column:
    """Whether a round takes the unit: it fits what was missing, and its rank is not beyond the round's last one."""
    return F.coalesce(F.exists(rounds, lambda r: (amount <= r["most"]) & ((key < r["key"]) | ((key == r["key"]) & (draw <= r["draw"])))), F.lit(False))


def _bucket(key: Column, of: int) -> Column:
    return F.least(F.floor(key * float(of)), F.lit(of - 1)).cast("long")


def last_ranks(pool: DataFrame) -> DataFrame:
    """Per source the last rank (key, draw) up to which its units, in the order of their ranks, fit into the gap, and their words.
    ``pool`` has source, words, key, draw and gap; a unit alone fits."""
    found = []
    edges = None
    for depth in (1, 2):
        inside = pool.withColumn("b", _bucket(F.col("key"), BUCKETS**depth))
        if edges is None:
            inside = inside.withColumn("before", F.lit(0).cast("long"))
        else:
            inside = with_source(inside, edges.select("source", "edge", "before")).filter(_bucket(F.col("key"), BUCKETS) == F.col("edge"))
        rank = F.struct("key", "draw")
        hist = inside.groupBy("source", "b").agg(F.sum("words").alias("n"), F.first("gap").alias("gap"), F.first("before").alias("before"), F.max(rank).alias("rank"))
        hist = hist.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("b")))
        fits = F.col("upto") <= F.col("gap")
        edges = stash(
            hist.groupBy("source").agg(
                F.min(F.when(~fits, F.col("b"))).alias("edge"),
                F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before")).alias("before"),
                F.max(F.when(fits, F.struct("b", "rank")))["rank"].alias("rank"),
            )
        )
        found.append(edges.filter("rank IS NOT NULL").select("source", "rank", F.col("before").alias("upto")))
    inside = with_source(pool, edges.select("source", "edge", "before")).filter(_bucket(F.col("key"), BUCKETS**2) == F.col("edge"))
    w = Window.partitionBy("source").orderBy("key", "draw").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(w)).filter(F.col("upto") <= F.col("gap"))
    found.append(inside.select("source", F.struct("key", "draw").alias("rank"), "upto"))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("source").agg(F.max("rank").alias("rank"), F.max("upto").alias("upto"))


def plan(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, near: float = NEAR) -> DataFrame:
    """One row for each source: all that is needed to decide about a row by itself."""
    per = targets(units.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    per = scales(units, per, max_repeats)
    copies = expected(F.col("size"), F.col("c"), max_repeats)
    marked = with_source(units, per.select("source", "c")).withColumn("whole", F.floor(copies)).withColumn("p", copies - F.col("whole"))
    certain = marked.groupBy("source").agg(F.sum(F.col("whole") * F.col("words")).alias("certain"))
    pool = marked.filter("p > 0 AND words > 0").withColumn("key", rank_key(F.col("draw"), F.col("p"))).select("source", "words", "key", "draw")
    state = with_source(per, certain).withColumn("gap", F.col("target") - F.col("certain")).withColumn("rounds", F.array().cast(ROUNDS))
    state = stash(state.select("source", "source_size", "target", "c", "gap", "rounds"))

    def left() -> DataFrame:
        rows = with_source(pool, state.select("source", "target", "gap", "rounds"))
        return rows.filter(~picked(F.col("rounds"), F.col("words"), F.col("key"), F.col("draw")))

    while True:
        ranks = stash(last_ranks(left().filter((F.col("words") <= F.col("gap")) & (F.col("gap") > F.col("target") * near)).select("source", "words", "key", "draw", "gap")))
        if ranks.isEmpty():
            break
        one = F.array(F.struct(F.col("gap").alias("most"), F.col("rank.key").alias("key"), F.col("rank.draw").alias("draw")))
        state = with_source(state, ranks).withColumn("rounds", F.when(F.col("rank").isNotNull(), F.concat("rounds", one)).otherwise(F.col("rounds")))
        state = stash(state.withColumn("gap", F.col("gap") - F.coalesce("upto", F.lit(0))).drop("rank", "upto"))
    off = F.abs(F.col("words") - F.col("gap"))
    close = left().filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "draw"))["draw"].alias("closing"))
    return stash(with_source(state, close))


# -- the whole


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, near: float = NEAR, text: str = "text", source: str = "source", key: tuple[str, ...] = ("doc_id", "source", "text"), keep: list[str] | None = None) -> DataFrame:
    """The documents, each with size, source_size, target, copies and taken. With ``keep`` only these columns stay, and texts are
    read but once."""
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    draw_, source_, plan_, n_, multi_, from_, long_ = free_names(docs, "draw", "source", "plan", "n", "multi", "from", "long")
    rows = without(docs, *[c for c in OUT if c not in key]).withColumns({"size": words(F.col(f"`{text}`")), draw_: draw_of(*key), source_: F.col(f"`{source}`")})
    rows = rows.select(*[F.col(f"`{c}`") for c in columns], "size", draw_, source_)
    if keep is not None:
        rows = stash(rows)
    # rows that repeat each other are one unit
    units = stash(rows.groupBy(F.col(source_).alias("source"), "size", F.col(draw_).alias("draw")).agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.col("size")))
    decided = plan(units, weights, max_repeats, near)
    whole = F.struct("source_size", "target", "c", "rounds", "closing").alias(plan_)
    decided = decided.select(F.col("source").alias(f"{source_}_"), whole)
    # a unit is a source, a size and a draw: a row meets its own unit only
    repeated = units.filter("n > 1").select(F.col("source").alias(from_), F.col("size").alias(long_), F.col("draw").alias(multi_), F.col("n").alias(n_))
    rows = rows.join(decided, F.col(source_).eqNullSafe(F.col(f"{source_}_")), "left")
    found = repeated.count()
    if found:
        same = (F.col(draw_) == F.col(multi_)) & F.col(source_).eqNullSafe(F.col(from_)) & (F.col("size") == F.col(long_))
        rows = rows.join(F.broadcast(repeated) if found <= FEW else repeated, same, "left")
    else:
        rows = rows.withColumn(n_, F.lit(None).cast("long"))
    it, draw = F.col(plan_), F.col(draw_)
    copies = expected(F.col("size"), it["c"], max_repeats)
    p = copies - F.floor(copies)
    sampled = picked(it["rounds"], F.col("size") * F.coalesce(n_, F.lit(1)), rank_key(draw, p), draw) | F.coalesce(draw == it["closing"], F.lit(False))
    times = F.when(it["target"] > 0, F.floor(copies) + ((p > 0) & (F.col("size") > 0) & sampled).cast("long")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("copies", times)
    return rows.select(*[F.col(f"`{c}`") for c in columns], "size", it["source_size"].alias("source_size"), it["target"].alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
