"""Operator 6: removal of repeated passages by hash-compared suffix sorting.

A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller id. All strings are judged on the
input. Texts are UTF-8 bytes; strings never cross documents.

Comparing all suffixes of a corpus in one place is impossible, so equal strings are brought together by their anchors: the anchor of
a string is its piece of K bytes with the least hash. Neighbouring strings mostly share an anchor; such a run (a stretch) is one
entry of 16 bytes: anchor, hash of the stretch, place. Prefix polynomial hashes give the hash of any piece of text at once.

1. Each batch of documents makes its stretches. Of equal ones within the batch, compared byte by byte, only those of the least
   document stay.
2. Entries meet by anchor. Again, equal stretches leave only the least document's; where an anchor has different stretches from
   different documents, these are mixed and go on.
3. The texts of mixed stretches meet by anchor and all their strings are suffix-sorted: a merge sort whose comparisons find the
   common extension of two suffixes by binary search over prefix hashes. Neighbours that agree on the whole length are compared
   byte by byte, so a collision removes nothing. An anchor with very many stretches is dealt out by the strings themselves; of
   equal strings that a task reads out of texts, only the least document's go on, so few rows of a very common string meet.
4. The bytes found are cut out of the texts.

Step 2 sees entries, not texts: there two stretches are equal if their 64-bit hashes and those of their anchors (what 64 bits leave
beside the place, 31 at least for texts up to 2**28 bytes, and the bucket's number on top) are. With 10**13 entries some 117 bits are
compared, so that one wrong pair in all is to be expected once in 10**9 such corpora; steps 1 and 3 compare bytes.

Defined cases: a null text counts as empty; texts shorter than the length stay whole; documents of equal id do not remove from
each other; a null doc_id counts as the greatest; repeated rows give repeated results; columns named like an output are replaced,
all others are kept whatever their names; an empty table gives an empty table. The place and the number of strings of a stretch
share 48 bits; longer texts with longer strings are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, shuffles_freed, stash, table, without

LENGTH, K = 50, 24
#: Bytes of text in a batch, and bytes of text for each bucket of entries.
BATCH, BUCKET = 3_000_000, 16_000_000
#: Least number of buckets, so that small inputs are spread out like large ones.
BUCKETS = 32
#: Entries of one anchor beyond which its strings are dealt out one by one.
MANY = 4096
#: Stretches whose suffixes are sorted together.
SORTED = 20_000
#: Strings to remove that a task holds before it writes them out.
FOUND_AT_ONCE = 1_500_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Prefix polynomial hashes of bytes modulo 2^64: the hash of any piece from two of them."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _byte = _mix(np.arange(1, 257, dtype=np.uint64))

    def __init__(self, text: np.ndarray):
        n = len(text) + 1
        cls = Prefixes
        if len(cls._power) < n:
            size, back = max(n, BATCH + BATCH // 4), pow(int(BASE), -1, 1 << 64)
            for name, b in (("_power", BASE), ("_inverse", np.uint64(back))):
                powers = np.full(size, b, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(cls._byte[text] * cls._power[: n - 1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Prefixes._inverse[start]


def stretches(text: np.ndarray, doc_of: np.ndarray, prefixes: Prefixes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of strings with one anchor: first string, number of strings, hash of the anchor, hash of the whole stretch."""
    n = len(text) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    k = min(K, length)
    at = np.arange(len(text) - k + 1)
    grams = _mix(prefixes.of(at, at + k))
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    reach, size = length - k + 1, 1
    while size * 2 <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
    anchor = (least[:n] & low).astype(np.int64)
    fine = doc_of[:n] == doc_of[length - 1 :]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~fine[:-1]
    first = np.flatnonzero(new & fine)
    stop = np.flatnonzero(np.append(new | ~fine, True)[1:] & fine) + 1 if len(first) else none
    count = stop - first
    return first, count, grams[anchor[first]], _mix(prefixes.of(first, first + count + length - 1))


def keep_least(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries are of the least document among those with equal anchor and stretch."""
    order = np.lexsort((doc, whole, anchor))
    a, w, d = anchor[order], whole[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(d) else d
    keep = np.empty(len(order), bool)
    keep[order] = d == least
    return keep


def equal_bytes(text: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether pieces of the given sizes that start at x and at y are equal, byte by byte."""
    out = np.ones(len(x), bool)
    for n in np.unique(size):
        mine = np.flatnonzero(size == n)
        for at in range(0, len(mine), 1 << 14):
            some, span = mine[at : at + (1 << 14)], np.arange(n)
            out[some] = (text[x[some][:, None] + span] == text[y[some][:, None] + span]).all(axis=1)
    return out


def apart_where_unequal(text: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The hashes of stretches, changed where a stretch has another one's hash and not its bytes: it is compared in full later."""
    order = np.lexsort((doc, whole, anchor))
    if len(order) < 2:
        return whole
    a, w = anchor[order], whole[order]
    new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    same = count[first] == count[order]
    todo = np.flatnonzero(same & (first != order))
    same[todo] = equal_bytes(text, start[first[todo]], start[order[todo]], count[order[todo]] + length - 1)
    whole = whole.copy()
    odd = order[~same]
    whole[odd] = _mix(whole[odd] ^ _mix(np.arange(1, len(odd) + 1, dtype=np.uint64) ^ start[odd].astype(np.uint64)))
    return whole


# -- 1: entries of batches

ENTRY = "bucket int, batch long, a binary, b binary, n binary, d binary, h binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in ("a", "b", "n", "d", "h")]])


def _batches(df_batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Documents (id, text hash, bytes) in batches of bounded size, each but once in a batch; a longer text is one by itself."""
    rows, size, seen = [], 0, set()
    for batch in df_batches:
        for d, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (d, h) in seen:
                continue
            raw = (t.as_py() or "").encode()
            if rows and (size + len(raw) > most or len(rows) >= 1 << 20):
                yield rows
                rows, size, seen = [], 0, set()
            rows.append((d, h, raw))
            seen.add((d, h))
            size += len(raw)
    if rows:
        yield rows


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of bytes, the document of each byte, and where documents start."""
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.uint8), np.repeat(np.arange(len(rows)), sizes), np.concatenate([[0], np.cumsum(sizes)])


def _pieces(raws: list[bytes], ids: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of the documents: document, first string within it, count, anchor, whole. Texts longer than a batch are taken
    in parts that overlap by one string less a byte."""
    if len(raws) == 1 and len(raws[0]) > 2 * most:
        for at in range(0, len(raws[0]) - length + 1, most):
            text = np.frombuffer(raws[0][at : at + most + length - 1], np.uint8)
            first, count, anchor, whole = stretches(text, np.zeros(len(text), np.int64), Prefixes(text), length)
            yield np.zeros(len(first), np.int64), first + at, count, anchor, whole
        return
    text, doc_of, starts = _joined(raws)
    first, count, anchor, whole = stretches(text, doc_of, Prefixes(text), length)
    doc = doc_of[first] if len(first) else first
    whole = apart_where_unequal(text, first, count, anchor, whole, ids[doc], length)
    yield doc, first - starts[doc], count, anchor, whole


class Packing:
    """How an entry's first word is shared out: anchor, first string and number of strings."""

    def __init__(self, longest: int, length: int):
        self.count = (length - min(K, length) + 1).bit_length()
        self.place = max(1, longest).bit_length()
        self.low = self.count + self.place
        if self.low > 48:
            raise ValueError(f"texts of {longest} bytes are too long for strings of {length} bytes")

    def pack(self, anchor: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (_mix(anchor) >> np.uint64(self.low) << np.uint64(self.low)) | (first << self.count | count).astype(np.uint64)

    def unpack(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest = (a & np.uint64((1 << self.low) - 1)).astype(np.int64)
        return a >> np.uint64(self.low), rest >> self.count, rest & ((1 << self.count) - 1)


def _by_document(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of ascending entries, and how many entries each has."""
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else doc
    return doc[start], np.diff(np.append(start, len(doc)))


def entries(docs: DataFrame, buckets: int, packing: Packing, length: int = LENGTH, most: int = BATCH) -> DataFrame:
    """Packed rows, each with entries in the order of their documents, whose ids, text hashes and numbers of entries stand beside.
    bucket >= 0: entries (a: anchor and place, b: hash). -1: strings that the batch itself removes (a: first strings, b: counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for rows in _batches(batches, most):
            ids, hashes = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            out: list[tuple] = []

            def add(bucket: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> None:
                used, n = _by_document(doc)
                out.append((bucket, number, a.tobytes(), b.tobytes(), n.astype(np.int32).tobytes(), ids[used].tobytes(), hashes[used].tobytes()))  # noqa: B023

            for doc, first, count, anchor, whole in _pieces([r[2] for r in rows], ids, length, most):
                keep = keep_least(anchor, whole, ids[doc])
                if not keep.all():
                    add(-1, first[~keep].astype(np.int32), count[~keep].astype(np.int32), doc[~keep])
                doc, first, count, anchor, whole = (x[keep] for x in (doc, first, count, anchor, whole))
                bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                a = packing.pack(anchor, first, count)
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    mine = order[edges[k] : edges[k + 1]]
                    add(int(k), a[mine], whole[mine], doc[mine])
            number += 1
            for at in range(0, len(out), 512):
                columns = list(zip(*out[at : at + 512]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    return docs.select("d", "h", "text").mapInArrow(run, ENTRY)


# -- 2: entries meet

FOUND = "kind int, d long, h long, first binary, n binary, key binary, many binary"


def pack(kind: int, d: np.ndarray, h: np.ndarray, first: np.ndarray, n: np.ndarray, key: np.ndarray | None = None, many: np.ndarray | None = None) -> pd.DataFrame:
    """One row for each document with its strings as bytes, each string but once."""
    order = np.lexsort((first, h, d))
    d, h, first, n = d[order], h[order], first[order], n[order]
    other = np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])) if len(order) else order.astype(bool)
    once = other | np.append(True, (first[1:] != first[:-1]) | (n[1:] != n[:-1]))[: len(other)]
    order, d, h, other = order[once], d[once], h[once], other[once]
    start = np.flatnonzero(other)
    edges = np.append(start, len(order)).tolist()

    def cut(x: np.ndarray | None, kind: type) -> list[bytes]:
        if x is None:
            return [b""] * len(start)
        raw, size = x.astype(kind).tobytes(), np.dtype(kind).itemsize
        return [raw[i * size : j * size] for i, j in zip(edges, edges[1:])]

    at = lambda x: None if x is None else x[order]
    return pd.DataFrame({"kind": kind, "d": d[start], "h": h[start], "first": cut(first[once], np.int32), "n": cut(n[once], np.int32), "key": cut(at(key), np.int64), "many": cut(at(many), np.int8)})


def unpack(rows: list[dict], *kinds: type) -> list[np.ndarray]:
    """The strings of packed rows: first, n, and key and many if asked for."""
    names = ("first", "n", "key", "many")
    return [np.concatenate([np.frombuffer(r[name], kind) for r in rows]).astype(np.int64) for name, kind in zip(names, kinds)]


def _whole(pdf: pd.DataFrame, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in pdf[name]])


def meet(pdf: pd.DataFrame, packing: Packing, many: int = MANY) -> pd.DataFrame:
    """Entries of one bucket: kind 0, strings to remove; kind 1, mixed stretches."""
    n_of = _whole(pdf, "n", np.int32)
    d, h = (np.repeat(_whole(pdf, c, np.int64), n_of) for c in ("d", "h"))
    whole = _whole(pdf, "b", np.uint64)
    anchor, first, n = packing.unpack(_whole(pdf, "a", np.uint64))
    keep = keep_least(anchor, whole, d)
    # of what stays, anchors with different stretches from different documents
    left = np.flatnonzero(keep)
    order = left[np.argsort(anchor[left], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = anchor[order][1:] != anchor[order][:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    differ = np.zeros(len(start), bool)
    if len(order):
        differ = np.maximum.reduceat(d[order], start) > np.minimum.reduceat(d[order], start)
    group = np.cumsum(new) - 1
    mixed = order[differ[group]] if len(order) else order
    sizes = size[group][differ[group]] if len(order) else order
    gone = np.flatnonzero(~keep)
    # anchors of different buckets may share what is left of them
    key = _mix(anchor[mixed] ^ _mix(np.full(len(mixed), pdf["bucket"].iloc[0], np.uint64))).view(np.int64)
    return pd.concat([pack(0, d[gone], h[gone], first[gone], n[gone]), pack(1, d[mixed], h[mixed], first[mixed], n[mixed], key, sizes > many)])


# -- 3: mixed stretches are sorted


def common(prefixes: Prefixes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Common extension of suffixes, at most ``length``, by binary search over hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), length)
    while (todo := low < high).any():
        middle = (low + high + 1) >> 1
        same = prefixes.of(x, x + middle) == prefixes.of(y, y + middle)
        low, high = np.where(todo & same, middle, low), np.where(todo & ~same, middle - 1, high)
    return low


def before(text: np.ndarray, prefixes: Prefixes, x: np.ndarray, y: np.ndarray, length: int, or_equal: np.ndarray) -> np.ndarray:
    """Whether suffix x comes before suffix y within the length; equal ones as told."""
    same = common(prefixes, x, y, length)
    last = np.minimum(same, length - 1)
    return np.where(same == length, or_equal, text[x + last] < text[y + last])


def suffix_sort(text: np.ndarray, prefixes: Prefixes, suffixes: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Sorts suffixes within their groups (which stand together) by their first ``length`` bytes: bottom-up merging, where the
    place of each suffix in the other run is found by binary search."""
    order = suffixes.copy()
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begin, len(group)))
    first, end = np.repeat(begin, size), np.repeat(begin + size, size)
    width, longest = 1, int(size.max(initial=0))
    while width < longest:
        act = np.flatnonzero(end - first > width)
        run = (act - first[act]) // width
        mine = first[act] + run * width
        other = first[act] + (run ^ 1) * width
        low = np.minimum(other, end[act])
        start, high = low.copy(), np.minimum(other + width, end[act])
        right = (run & 1).astype(bool)
        x = order[act]
        while (todo := np.flatnonzero(low < high)).size:
            middle = (low[todo] + high[todo]) >> 1
            # how many of the other run come first: all less ones, and for the right run equal ones too
            less = before(text, prefixes, order[middle], x[todo], length, right[todo])
            low[todo], high[todo] = np.where(less, middle + 1, low[todo]), np.where(less, high[todo], middle)
        merged = order.copy()
        merged[np.minimum(mine, other) + (act - mine) + (low - start)] = x
        order, width = merged, width * 2
    return order


def anchors(prefixes: Prefixes, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors in stretches: the least piece of those that all strings of a stretch hold."""
    k = min(K, length)
    if not len(starts):
        return starts
    low, high = starts + counts - 1, starts + length - k + 1
    size = high - low
    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    packed = (_mix(prefixes.of(at, at + k)) & ~np.uint64((1 << 24) - 1)) | (at - np.repeat(starts, size)).astype(np.uint64)
    return (np.minimum.reduceat(packed, np.cumsum(size) - size) & np.uint64((1 << 24) - 1)).astype(np.int64)


def sort_mixed(keys: np.ndarray, docs: np.ndarray, counts: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretch and place of all strings which a smaller document has too. Stretches of one key meet."""
    by = np.argsort(keys, kind="stable")
    text, _, starts = _joined([texts[i] for i in by])
    n = counts[by]
    prefixes = Prefixes(text)
    each = np.repeat(np.arange(len(by)), n)
    place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    # equal strings have their anchor at the same place, so only those meet
    rel = anchors(prefixes, starts[:-1], n, length)[each] - place
    sorted_by = np.lexsort((rel, keys[by][each]))
    each, place, rel = each[sorted_by], place[sorted_by], rel[sorted_by]
    key = keys[by][each]
    group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (rel[1:] != rel[:-1]))[: len(key)])
    suffixes = starts[each] + place
    order = suffix_sort(text, prefixes, suffixes, group, length)
    inverse = np.full(len(text) + 1, -1)
    inverse[suffixes] = np.arange(len(suffixes))
    row = inverse[order]
    equal = np.zeros(len(order), bool)
    near = np.flatnonzero(group[1:] == group[:-1])
    near = near[common(prefixes, order[near], order[near + 1], length) == length]
    for at in range(0, len(near), 1 << 16):  # byte by byte
        some = near[at : at + (1 << 16)]
        span = np.arange(length)
        equal[some + 1] = (text[order[some][:, None] + span] == text[order[some + 1][:, None] + span]).all(axis=1)
    if not len(order):
        return row, row
    begin = np.flatnonzero(~equal)
    d = docs[by][each[row]]
    least = np.minimum.reduceat(d, begin)[np.cumsum(~equal) - 1]
    gone = row[d > least]
    return by[each[gone]], place[gone]


# -- the whole

PIECES = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("piece", pa.binary()), ("firsts", pa.binary()), ("ns", pa.binary())])
PIECE = "key long, d long, h long, first long, n int, piece binary, firsts binary, ns binary"
CUTS = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("first", pa.binary()), ("n", pa.binary())])
CUT = "d long, h long, first binary, n binary"
#: Strings dealt out one by one that a task holds to compare them with each other.
STRINGS = 200_000


def _all(col: str) -> Column:
    return F.collect_list(F.struct("first", "n", *(["key", "many"] if col == "mixed" else []))).alias(col)


def _columns(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def extract(length: int, text: int, d: int, h: int, mixed: int):
    """Texts of mixed stretches out of documents, whose columns are told by place. Where strings are dealt out one by one, those
    that a smaller document read here has too are found at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def strings() -> Iterator[pa.RecordBatch]:
            string, d_of, h_of, first, piece = (np.concatenate(x) for x in zip(*held))
            held.clear()
            _, which, count = np.unique(string, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[which] > 1)
            on = np.ones(len(string), bool)
            if len(again):
                gone, _ = sort_mixed(string[again].view(np.int64), d_of[again], np.ones(len(again), np.int64), [x.tobytes() for x in piece[again]], length)
                on[again[gone]] = False
                out = pack(0, d_of[~on], h_of[~on], first[~on], np.ones((~on).sum(), np.int64))
                yield _columns(PIECES, len(out), key=out["d"], d=out["d"], h=out["h"], firsts=out["first"], ns=out["n"])
            for at in range(0, int(on.sum()), 1 << 14):
                some = np.flatnonzero(on)[at : at + (1 << 14)]
                yield _columns(PIECES, len(some), key=string[some].view(np.int64), d=d_of[some], h=h_of[some], first=first[some], n=np.ones(len(some), np.int32), piece=[x.tobytes() for x in piece[some]])

        for batch in batches:
            out: list[tuple] = []
            for t, d_, h_, rows in zip(batch.column(text), batch.column(d).to_pylist(), batch.column(h).to_pylist(), batch.column(mixed)):
                raw = (t.as_py() or "").encode()
                for first, n, key, lots in zip(*(x.tolist() for x in unpack(rows.as_py(), np.int32, np.int32, np.int64, np.int8))):
                    piece = raw[first : first + n + length - 1]
                    if lots:
                        letters, at = np.frombuffer(piece, np.uint8), np.arange(n)
                        string = _mix(Prefixes(letters).of(at, at + length))
                        held.append((string, np.full(n, d_), np.full(n, h_), first + at, np.lib.stride_tricks.sliding_window_view(letters, length)))
                    else:
                        out.append((key, d_, h_, first, n, piece))
            for at in range(0, len(out), 1 << 14):
                some = out[at : at + (1 << 14)]
                yield _columns(PIECES, len(some), **dict(zip(("key", "d", "h", "first", "n", "piece"), zip(*some))))
            if sum(len(x[0]) for x in held) > STRINGS:
                yield from strings()
        if held:
            yield from strings()

    return run


def sort_run(length: int, together: int):
    """Rows come sorted by key; whole keys are sorted together, many at a time. Out come strings to remove, packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held: list[pa.RecordBatch] = []

        def sort() -> None:
            rows = pa.Table.from_batches(held).select(["key", "d", "h", "first", "n", "piece"]).to_pandas()
            held.clear()
            which, place = sort_mixed(rows["key"].to_numpy(), rows["d"].to_numpy(), rows["n"].to_numpy().astype(np.int64), rows["piece"].tolist(), length)
            found.append((rows["d"].to_numpy()[which], rows["h"].to_numpy()[which], rows["first"].to_numpy()[which] + place))

        def packed() -> Iterator[pa.RecordBatch]:
            if found:
                d, h, first = (np.concatenate(x) for x in zip(*found))
                out = pack(0, d, h, first, np.ones(len(d), np.int64))
                yield _columns(CUTS, len(out), d=out["d"], h=out["h"], first=out["first"], n=out["n"])
                found.clear()

        size = 0
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column("firsts")))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(c) for c in ("d", "h", "firsts", "ns")], schema=CUTS)
            batch = batch.filter(pc.is_valid(batch.column("piece")))
            if not batch.num_rows:
                continue
            # the last key of a batch may go on in the next one
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                held.append(batch.slice(0, cut))
                size += cut
            if held and size >= together and (cut or held[-1].column("key")[-1].as_py() != keys[-1]):
                sort()
                size = 0
            held.append(batch.slice(cut))
            size += batch.num_rows - cut
            if sum(len(x[0]) for x in found) > FOUND_AT_ONCE:
                yield from packed()
        if held:
            sort()
        yield from packed()

    return run


def dedup_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, cut: str = "kept", batch_bytes: int = BATCH, many: int = MANY, together: int = SORTED) -> DataFrame:
    """The table with n_bytes, n_removed, n_spans and the remaining bytes (binary)."""
    rest = without(df, "n_bytes", "n_removed", "n_spans", cut)
    d_, h_, cuts_ = free_names(rest, "d", "h", "cuts")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = rest.withColumns({d_: F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)), h_: F.xxhash64(whole)})
    slim = docs.select(F.col(d_).alias("d"), F.col(h_).alias("h"), whole.alias("text"))
    with shuffles_freed(df.sparkSession):
        facts = slim.agg(F.sum(F.octet_length("text")).alias("n"), F.max(F.octet_length("text")).alias("longest")).first()
    buckets, packing = max(BUCKETS, -(-(facts["n"] or 0) // BUCKET)), Packing(facts["longest"] or 0, length)
    packed = entries(slim, buckets, packing, length, batch_bytes)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] >= 0:
            return meet(pdf, packing, many)
        n = _whole(pdf, "n", np.int32)
        d, h = (np.repeat(_whole(pdf, c, np.int64), n) for c in ("d", "h"))
        return pack(0, d, h, _whole(pdf, "a", np.int32), _whole(pdf, "b", np.int32))

    # strings that batches remove themselves are dealt out by batch; the entries, larger than the texts, are off the disks before texts move
    spread = packed.withColumn("spread", F.when(F.col("bucket") < 0, F.col("batch")).otherwise(F.lit(0)))
    with shuffles_freed(df.sparkSession):
        found = stash(spread.groupBy("bucket", "spread").applyInPandas(lambda pdf: gather(pdf.drop(columns="spread")), FOUND))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def with_rows(rows: DataFrame, how: str) -> DataFrame:
        """Documents and an array of their rows; both joins read one exchange of the documents."""
        rows = rows.select(F.col("d").alias(f"{d_}_"), F.col("h").alias(f"{h_}_"), F.col(rows.columns[-1]).alias(cuts_))
        return docs.join(rows, (F.col(d_) == F.col(f"{d_}_")) & (F.col(h_) == F.col(f"{h_}_")), how).select(*columns, cuts_)

    place = [docs.columns.index(c) for c in (text, d_, h_)]
    pieces = with_rows(found.filter("kind = 1").groupBy("d", "h").agg(_all("mixed")), "inner").mapInArrow(extract(length, *place, len(columns)), PIECE)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    late = pieces.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sort_run(length, together), CUT)
    early = found.filter("kind = 0").select("d", "h", "first", "n")
    joined = with_rows(early.unionByName(late).groupBy("d", "h").agg(_all("cuts")), "left")
    schema = T.StructType([*rest.schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField(cut, T.BinaryType())])
    at, width = rest.columns.index(text), len(rest.columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            out: list[list] = [[], [], [], []]
            for t, cuts_here in zip(batch.column(at), held):
                raw = np.frombuffer((t.as_py() or "").encode(), np.uint8)
                mask = np.zeros(len(raw) + 1, np.int64)
                if cuts_here.is_valid:
                    first, n = unpack(cuts_here.as_py(), np.int32, np.int32)
                    np.add.at(mask, first, 1)
                    np.add.at(mask, first + n + length - 1, -1)
                gone = np.cumsum(mask)[:-1] > 0
                out[0].append(len(raw))
                out[1].append(int(gone.sum()))
                out[2].append(int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0)))
                out[3].append(raw[~gone].tobytes())
            cols = [pa.array(o, pa.binary() if i == 3 else pa.int64()) for i, o in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *cols], names=schema.names)

    return joined.mapInArrow(apply, schema)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
