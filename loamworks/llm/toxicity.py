"""Operator 10: toxicity of texts restored through a noisy channel.

Writers hide words by look-alike signs (1d10t), spacing (i d i o t, i.d.i.o.t) and repetition (iiidiot). Each suspect word spans a
lattice: at each sign the letters it may stand for, at each separator nothing or the end of a word, at each run of one letter one or two of them, all at
a cost. Viterbi decoding finds the best path under a character language model: trigrams of letters counted over all documents. The
restored text is then scored.

The score adds up evidence of the distinct restored words. Features of a word are itself and its first four, five and six letters;
a feature's evidence is the log-odds of the toxic label among training texts that hold it, smoothed towards the overall odds, as
far as it is above even odds; a word has the evidence of its strongest feature. Words come first; beginnings are counted without the words that are
evidence by themselves, so that the start of one toxic word does not speak against others. A logistic curve of that sum, fitted on the
training texts, gives the score. Training takes at most TRAIN_ROWS labelled texts, chosen by a hash of doc_id, of those whose
crc32(doc_id) mod 5 is not 0; all else covers every document and whole texts.

Defined cases: null and empty texts score as texts without evidence; without labels every text scores 0; repeated labels of a
document count once, as toxic if any is; a null doc_id counts as held out and takes no label; repeated rows give repeated results;
columns named like an output are replaced; an empty table gives an empty table. Words and spaced runs of any
length are restored; a spaced or dotted run may be read as several words, each with its own evidence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, table, without

#: Most labelled texts that the evidence is learnt from.
TRAIN_ROWS = 12_000
#: Weight of the overall odds in a feature's odds, and the least toxic texts that hold it.
PRIOR, LEAST = 6.0, 3
CACHE_WORDS = 600_000
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
EDGE, OTHER = 0, len(LETTERS) + 1
SIZE = len(LETTERS) + 2
NUMBER = {" ": EDGE} | {c: i for i, c in enumerate(LETTERS, 1)}
#: What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
SEPARATORS = ".-_·'"
LETTER_SET, LOOK_SET = frozenset(LETTERS), frozenset(LOOKS)
COST_LOOK, COST_KEPT, COST_GONE, COST_RUN = 0.5, 6.0, 0.3, 0.5
EDGES = ".,;:!?\"'()[]{}<>«»„“”…|-–"
SPACED = re.compile(r"(?<!\S)[^\s.,;:](?:[ \t][^\s.,;:]){2,}(?![^\s.,;:])")
DOTTED = re.compile(r"^\S(?:[.\-_·']\S){2,}$")
PAIR = re.compile(r"(.)\1", re.DOTALL)
#: Code points that are counted at once.
COUNTED = 1 << 18


# -- the character language model


def _codes() -> np.ndarray:
    """A letter's number for each code point up to U+017F, 0 where a word ends; the last entry is for all code points beyond."""
    out = np.full(0x181, EDGE, np.int32)
    out[0x180] = OTHER
    for i, c in enumerate(LETTERS, 1):
        out[ord(c)] = i
        if len(c.upper()) == 1 and ord(c.upper()) < 0x180:
            out[ord(c.upper())] = i
    return out


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts, word edges included. The table has SIZE^3 numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of, total = _codes(), np.zeros(SIZE**3, np.int64)

        def add(texts: list[str]) -> None:
            """Counts texts that stand one after the other: two trigrams of edges across each border are none of theirs."""
            raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            for at in range(0, len(raw), COUNTED):
                c = table_of[np.minimum(raw[at : at + COUNTED + 2], 0x180)]
                np.add(total, np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3), out=total)
            total[0] -= 2 * (len(texts) - 1)

        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                text = f"  {x.as_py() or ''}  "
                if held and size + len(text) > COUNTED:
                    add(held)
                    held, size = [], 0
                held.append(text)
                size += len(text)
        if held:
            add(held)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3, np.int64)
    counts[[r["gram"] for r in rows]] = [r["n"] for r in rows]
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative log probabilities) of a letter after two, mixed with those after one and none."""
    tri = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    tri[:, EDGE, EDGE] = 0  # between words there is no text
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1)) + 1
    p1 = uni / uni.sum()
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 2 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 2)
    return -np.log(p3)


# -- restoring


def lattice(word: str) -> list[list[tuple[int, str, float]]]:
    """For each place its arcs: where they lead, what they say and what they cost."""
    arcs: list[list[tuple[int, str, float]]] = []
    runs = [1] * len(word)
    for i in range(len(word) - 2, -1, -1):
        runs[i] = runs[i + 1] + 1 if word[i] == word[i + 1] else 1
    for i, (c, run) in enumerate(zip(word, runs)):
        here = []
        if c in LETTERS:
            here.append((i + 1, c, 0.0))
            if run > 1:
                here.append((i + run, c, COST_RUN))
                here.append((i + run, c + c, COST_RUN))
        elif c in LOOKS:
            for letter in LOOKS[c]:
                here.append((i + run, letter, COST_LOOK + math.log(len(LOOKS[c]))))
                here.append((i + 1, letter, COST_LOOK + math.log(len(LOOKS[c]))))
            here.append((i + 1, c, COST_KEPT))
        elif c in SEPARATORS or c == " ":
            here.append((i + 1, "", COST_GONE))
            here.append((i + 1, " ", COST_GONE))
            if c != " ":
                here.append((i + 1, c, COST_KEPT))
        else:
            here.append((i + 1, c, COST_KEPT))
        arcs.append(here)
    return arcs


def restore(word: str, costs: np.ndarray | list[float]) -> str:
    """The best reading of a suspect word or run; words of a run come with spaces between them. Costs are an array or its flat list,
    which is read faster number by number."""
    flat: list[float] = costs if isinstance(costs, list) else costs.ravel().tolist()
    square = SIZE * SIZE
    # a state is the last two letters, a * SIZE + b; what was said is a chain of its parts, so that time grows with the length only
    best: list[dict[int, tuple[float, tuple]]] = [{} for _ in range(len(word) + 1)]
    best[0] = {EDGE * SIZE + EDGE: (0.0, ())}
    for i, here in enumerate(lattice(word)):
        arcs = [(best[to], text, more, [NUMBER.get(c, OTHER) for c in text]) for to, text, more in here]
        for state, (cost, said) in best[i].items():
            for there, text, more, codes in arcs:
                at, total = state, cost + more
                for code in codes:
                    gram = at * SIZE + code
                    total += flat[gram]
                    at = gram % square
                old = there.get(at)
                if old is None or total < old[0]:
                    there[at] = (total, (said, text))
        best[i] = {}
    said, parts = min(((cost + flat[at * SIZE + EDGE], said) for at, (cost, said) in best[-1].items()), key=lambda x: x[0])[1], []
    while said:
        said, text = said
        parts.append(text)
    return "".join(reversed(parts))


def suspect(word: str) -> bool:
    """Whether a lower-case word may be in disguise."""
    if LOOK_SET.isdisjoint(word) and not (word[1:2] in SEPARATORS and DOTTED.match(word)):
        if not PAIR.search(word):
            return False
        runs = [a for a, b in zip(word, word[1:]) if a == b]
        if len(runs) < 3 and not any(a == b == c for a, b, c in zip(word, word[1:], word[2:])):
            return False
    return not LETTER_SET.isdisjoint(word)


class Reader:
    """Evidence of texts under a model; without weights, their features only: words (no ``whole``), or all, where words of
    ``whole`` stand for themselves alone."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float] | None = None, whole: frozenset[str] | None = None):
        self.costs, self.weights, self.whole = costs.ravel().tolist(), weights, whole
        #: Beginnings of three letters without which a word has no evidence.
        self.starts = frozenset(f[:3] for f in weights or ())
        #: Words that were read, and what was found in those that hold anything.
        self.seen: set[str] = set()
        self.known: dict[str, list] = {}

    def plain(self, word: str) -> str:
        low = word.lower().strip(EDGES)
        return restore(low, self.costs) if suspect(low) else low

    def words(self, text: str) -> set[str]:
        """Distinct words as written, and runs of single signs, marked."""
        found = set(text.split())
        for m in SPACED.finditer(text):
            found.add("\0" + m[0])
        return found

    def read(self, word: str) -> list:
        """Features, or pairs of a word and its evidence, of each word that the word or run is read as."""
        spaced = word[:1] == "\0"
        plain = restore(word[1:].lower().replace("\t", " "), self.costs) if spaced else self.plain(word)
        out: list = []
        for one in plain.split():
            if self.weights is None:
                features = features_of(one)
                out += features if self.whole is not None and one not in self.whole else features[:1]
            elif one[:3] in self.starts and (best := max((self.weights.get(f, 0.0) for f in features_of(one)), default=0.0)) > 0:
                out.append((one, best))
        return out

    def each(self, text: str | None) -> list:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
            self.known.clear()
        found = self.words(text or "")
        new = found - self.seen
        self.seen |= new
        for w in new:
            if x := self.read(w):
                self.known[w] = x
        return [x for w in found & self.known.keys() for x in self.known[w]]

    def features(self, text: str | None) -> set[str]:
        return set(self.each(text))

    def evidence(self, text: str | None) -> float:
        return math.fsum(dict(self.each(text)).values())  # whatever the order


def features_of(word: str) -> tuple[str, ...]:
    """A word, and its beginnings marked with a star. Words of fewer than three letters have none."""
    if len(word) < 3 or not word[:3].isalpha():
        return ()
    return (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) >= k))


# -- learning and scoring


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def training_rows(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and toxic of at most about ``most`` labelled documents that are not held out, chosen by hash."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = rows.count()
    part = min(1.0, most / max(1, n))
    return rows.filter(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))


def learn(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> tuple[dict[str, float], float, float]:
    """Evidence by feature, and offset and slope of the logistic curve."""
    train = docs.select("doc_id", "text").join(F.broadcast(training_rows(labels)), "doc_id")  # TRAIN_ROWS pairs of numbers at most

    rows = stash(train.select("doc_id", "text", "toxic"))  # texts are read over and over while learning
    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, n = totals["t"] or 0, totals["n"]
    if not 0 < t < n:
        return {}, (-20.0 if not t else 20.0), 0.0
    rate = t / n

    def strong(whole: frozenset[str] | None) -> dict[str, float]:
        """Features whose evidence is beyond chance, with their log-odds."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(costs, whole=whole)
            for batch in batches:
                toxic, every = Counter(), Counter()
                for text, y in zip(batch.column(1), batch.column(2)):
                    f = reader.features(text.as_py())
                    every.update(f)
                    if y.as_py():
                        toxic.update(f)
                keys = list(every)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([every[k] for k in keys], pa.int64())], names=["feature", "toxic", "n"])

        sums = rows.mapInArrow(count, "feature string, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        odds = (F.col("toxic") + PRIOR * rate) / (F.col("n") - F.col("toxic") + PRIOR * (1 - rate))
        seen = stash(sums.filter(F.col("toxic") >= LEAST))
        # chance alone should not make one of all these features look so toxic: Chernoff's bound on its texts' labels
        share = F.col("toxic") / F.col("n")
        surprise = F.col("toxic") * F.log(share / rate) + (F.col("n") - F.col("toxic")) * F.when(share < 1, F.log((1 - share) / (1 - rate))).otherwise(F.lit(0.0))
        kept = seen.filter(surprise > math.log(max(1, seen.count()))).withColumn("weight", F.log(odds)).filter("weight > 0")
        return {r["feature"]: r["weight"] for r in kept.select("feature", "weight").collect()}  # of a bounded number of texts

    # beginnings of words count without the words that are evidence by themselves
    whole = strong(None)
    weights = strong(frozenset(whole)) | whole

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(costs, weights)
        for batch in batches:
            s = [reader.evidence(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), batch.column(2)], names=["evidence", "toxic"])

    seen = rows.mapInArrow(weigh, "evidence double, toxic int").groupBy(F.round("evidence", 2).alias("evidence")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    x, hits, all_n = (np.array([float(r[c]) for r in seen]) for c in ("evidence", "t", "n"))
    a, b = fit_curve(x, hits, all_n)
    return weights, a, b


def fit_curve(x: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Offset and slope (not negative) by Newton steps, with a small penalty so that separable data stay finite."""
    w = np.zeros(2)
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (hits - n * p) - 0.01 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def score(df: DataFrame, corpus: DataFrame, labels: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """The table with each text's score. The language model is counted over ``corpus``, evidence is learnt from its labelled texts."""
    costs = language_model(count_trigrams(corpus))
    weights, a, b = learn(corpus, labels, costs)
    rest = without(df, out)
    at = rest.columns.index(text)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(costs, weights)
        for batch in batches:
            s = [1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * reader.evidence(x.as_py()))))) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc_held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
