"""Operator 1: SentencePiece BPE encoding and decoding over a prefix table.

For every prefix of a text, the encoding has one last token. So the encoder keeps one token per prefix: an automaton lists the
pieces that end at a position, and the one which is compatible with the token kept at its start is the token of the longer
prefix. The ids are then read off backwards from the end.

Two tokens are compatible if encoding their joined text gives just these two. That is decided from the merge history of both at
the border: the parts that touch there grow in order of their merges, and no merge across the border may come first.

Texts are cut only where no piece of the model could span the cut, so the parts encode independently and repeated parts are
looked up in a table of bounded size.

Defined cases: a null text counts as empty; an empty text encodes to the end id alone and decodes to the empty string; columns
named like an output are replaced; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, without

SPACE = "▁"
#: Parts of texts kept for lookup by one worker, and the ids they may hold, before the table starts anew.
CACHE_PARTS, CACHE_IDS = 600_000, 4_000_000
#: Code points of text that are encoded at once in a worker.
SLICE_CHARS = 500_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PrefixTable:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be BPE with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("the model must keep texts as they are, with a space put in front")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.piece = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.eos = next(i for i, p in enumerate(proto.pieces) if p.type == CONTROL and p.piece == "</s>")
        # the two parts of each piece's last merge; pieces that merging never reaches are left out
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.steady: dict[int, bool] = {}
        for text, i in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            ids, last = self.merged(text)
            if ids == [i]:
                self.parts[i] = last
        for i, last in self.parts.items():
            self.steady[i] = last is None or all(self.score[x] > self.score[i] or len(self.piece[x]) == 1 for x in last)
        self.build_automaton()
        chars = set("".join(self.id_of))
        within = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        apart = "" if "\n" in chars else "\n"
        self.cut = None if within else re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|{apart}" if apart else ""))
        self.plain = self.cut is not None and bool(apart)
        self.forget()

    # -- merging as defined: best score first, then leftmost

    def merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """The ids after merging pairs until none is left, and the parts of the last merge. Characters must be pieces."""
        ids: list[int | None] = [self.id_of.get(c) for c in text]
        if None in ids:
            return [], None
        n, last = len(ids), None
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (m := self.id_of.get(self.piece[ids[a]] + self.piece[ids[b]])) is not None:
                heapq.heappush(heap, (-self.score[m], a, m, ids[a], ids[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, m, x, y = heapq.heappop(heap)
            b = right[a] if ids[a] is not None else n
            if b >= n or ids[a] != x or ids[b] != y:
                continue
            ids[a], ids[b], last = m, None, (x, y)
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [i for i in ids if i is not None], last

    def spine(self, i: int, side: int) -> list[int]:
        """The tokens that stand at one edge of a token while it is merged, the smallest first."""
        out = [i]
        while (p := self.parts[out[-1]]) is not None:
            out.append(p[side])
        return out[::-1]

    def build_automaton(self) -> None:
        """States are beginnings of pieces. ``found`` has, for each state, all pieces that end there, the longest first:
        length, id and the tokens that were seen to fit before it or not."""
        self.step: list[dict[str, int]] = [{}]
        self.found: list[tuple] = [()]
        self.seen: list[dict[int, bool]] = []
        own: dict[int, tuple] = {}
        for i in self.parts:
            at = 0
            for c in self.piece[i]:
                to = self.step[at].get(c)
                if to is None:
                    to = self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.found.append(())
                at = to
            self.seen.append({})
            own[at] = (len(self.piece[i]), i, self.seen[-1])
        self.fall = [0] * len(self.step)
        level = [(0, c, to) for c, to in self.step[0].items()]
        while level:
            below = []
            for at, c, to in level:
                self.fall[to] = self.next_state(self.fall[at], c) if at else 0
                self.found[to] = ((own[to],) if to in own else ()) + self.found[self.fall[to]]
                below += [(to, d, x) for d, x in self.step[to].items()]
            level = below
        self.alphabet = set(self.step[0])

    def next_state(self, at: int, c: str) -> int:
        while (to := self.step[at].get(c)) is None and at:
            at = self.fall[at]
        return to or 0

    def fits(self, x: int, y: int) -> bool:
        """Whether the joined text of two tokens encodes to these two."""
        a, b = self.spine(x, 1), self.spine(y, 0)
        if not all(self.steady[i] for i in (*a, *b)):
            return self.merged(self.piece[x] + self.piece[y])[0] == [x, y]
        i = j = 0
        worst = -float("inf")
        while True:
            m = self.id_of.get(self.piece[a[i]] + self.piece[b[j]])
            across = self.score[m] if m is not None else worst
            grow_a = self.score[a[i + 1]] if i + 1 < len(a) else worst
            grow_b = self.score[b[j + 1]] if j + 1 < len(b) else worst
            if m is not None and across > grow_a and across >= grow_b:
                return False
            if grow_a == worst and grow_b == worst:
                return m is None
            if grow_a >= grow_b:
                i += 1
            else:
                j += 1

    # -- encoding by prefixes

    def encode_parts(self, keys: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all parts in one list, and where each part's ids end. In sorted order, prefixes that a part shares with
        the one before keep their tokens."""
        fits, step, found, alphabet = self.fits, self.step, self.found, self.alphabet
        last, size, states = [-1], [1], [0]
        out: list[int] = []
        ends: list[int] = []
        before = ""
        for key in keys:
            part = key[1:] if key[0] == SPACE else key if key[0] == "\n" else SPACE + key
            n, done = len(part), 0
            for a, b in zip(part, before):
                if a != b:
                    break
                done += 1
            del last[done + 1 :], size[done + 1 :], states[done + 1 :]
            state = states[done]
            for end in range(done + 1, n + 1):
                c = part[end - 1]
                to = step[state].get(c)
                if to is None:
                    to = self.next_state(state, c)
                    if c in alphabet and len(step[state]) < 256:
                        step[state][c] = to
                state = to
                token, length = -1, 1
                for k, i, known in found[state]:
                    x = last[end - k]
                    # what follows the beginning or a character without a piece always fits
                    if x >= 0:
                        ok = known.get(x)
                        if ok is None:
                            ok = known[x] = fits(x, i)
                        if not ok:
                            continue
                    token, length = i, k
                    break
                last.append(token)
                size.append(length)
                states.append(state)
            at = n
            mine = []
            while at > 0:
                i = last[at]
                if i >= 0:
                    mine.append(i)
                else:
                    mine.extend([self.byte_id[b] for b in reversed(part[at - 1].encode())])
                at -= size[at]
            mine.reverse()
            out += mine
            ends.append(len(out))
            before = part
        return out, ends

    def parts_of(self, text: str) -> list[str]:
        """Keys of the parts between safe cuts. A key with the space mark is that mark and the part; one with a line feed in
        front is the part; before any other the part has the space mark."""
        if not text:
            return []
        if self.plain and SPACE not in text:
            spaced = text.replace("\n", " \n")
            if "  " not in spaced and spaced[0] != " " and spaced[-1] != " ":
                return spaced.split(" ")
        text = SPACE + text.replace(" ", SPACE)
        return [SPACE + p for p in self.cut.findall(text)] if self.cut else [SPACE + text]

    def encode(self, text: str) -> list[int]:
        return [*self.encode_parts(self.parts_of(text))[0], self.eos]

    def joined(self, ids: Iterable[int]) -> str:
        """The text of ids, with spaces for the mark; runs of byte ids are read as UTF-8, each wrong byte as U+FFFD."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + k].decode())
                        at += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        if not isinstance(ids, list):
            ids = list(ids)
        kinds = self.kind
        if all([kinds[i] == NORMAL for i in ids]):
            return "".join([self.piece[i] for i in ids]).replace(SPACE, " ")
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            flush()
            if self.kind[i] == NORMAL:
                out.append(self.piece[i].replace(SPACE, " "))
            elif self.kind[i] == UNKNOWN:
                out.append(f" {chr(0x2047)} ")
        flush()
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        text = self.joined(ids)
        return text[1:] if text.startswith(" ") else text

    # -- whole batches, with a bounded table of parts

    def forget(self) -> None:
        """Drop all that was learnt from texts."""
        for known in self.seen:
            known.clear()
        # entry 0 is the end id
        self.known: dict[str, int] = {}
        self.ids = np.full(1 << 16, self.eos, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.starts[1] = self.n_known = 1

    def learn(self, parts: list[str]) -> None:
        ids, ends = self.encode_parts(parts)
        n, start = self.n_known, int(self.starts[self.n_known])
        while start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(parts) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
        self.ids[start : start + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(parts)] = np.array(ends, np.int64) + start
        self.known.update(zip(parts, range(n, n + len(parts))))
        self.n_known += len(parts)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, each with the end id."""
        if self.n_known > CACHE_PARTS or self.starts[self.n_known] > CACHE_IDS:
            self.forget()
        parts, counts = [], []
        for text in texts:
            if text:
                parts += self.parts_of(text)
            parts.append("")
            counts.append(len(parts))
        self.known[""] = 0
        keys = list(map(self.known.get, parts))
        if None in keys:
            new = [k for k, v in enumerate(keys) if v is None]
            self.learn(sorted({parts[k] for k in new}))
            for k in new:
                keys[k] = self.known[parts[k]]
        key = np.array(keys, np.int64)
        first = self.starts[key]
        size = self.starts[key + 1] - first
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return total[np.concatenate([[0], counts])], flat

    def decode_batch(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and UTF-8 bytes of the texts of id lists that encoding made."""
        if not hasattr(self, "piece_bytes"):
            each = [p.replace(SPACE, " ").encode() if k == NORMAL else bytes([self.byte_of[i]]) if k == BYTE else b"" for i, (p, k) in enumerate(zip(self.piece, self.kind))]
            self.piece_bytes = np.frombuffer(b"".join(each), np.uint8)
            self.piece_starts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        first = self.piece_starts[ids]
        size = self.piece_starts[ids + 1] - first
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.piece_bytes[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        bounds = total[offsets]
        # the space put in front of a text goes
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        heads = heads[flat[heads] == 32]
        gone = np.zeros(len(flat) + 1, np.int64)
        gone[heads + 1] = 1
        return bounds - np.cumsum(gone)[bounds], np.delete(flat, heads)


_TABLES: dict[bytes, PrefixTable] = {}


def prefix_table(model: bytes) -> PrefixTable:
    """The model's table; a worker builds it once."""
    if model not in _TABLES:
        _TABLES.clear()
        _TABLES[model] = PrefixTable(model)
    return _TABLES[model]


def model_bytes(path: str | None = None) -> bytes:
    """A model file's bytes; they go to executors with the task, so only the driver needs the file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The table with the ids of each whole text, the end id last, and the text decoded from them."""
    rest = without(df, ids, decoded)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    at = df.columns.index(text)
    if text not in rest.columns:
        raise ValueError("the outputs must not replace the text column")
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = prefix_table(model)
        try:
            for batch in batches:
                texts, start = batch.column(at), 0
                while start < batch.num_rows:
                    chunk, chars = [], 0
                    while start + len(chunk) < batch.num_rows and chars < SLICE_CHARS and len(chunk) < 4096:
                        chunk.append(texts[start + len(chunk)].as_py())
                        chars += len(chunk[-1] or "")
                    offsets, flat = tokens.encode_batch(chunk)
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                    bounds, raw = tokens.decode_batch(offsets, flat)
                    back = pa.StringArray.from_buffers(len(chunk), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw))
                    cols = [c.slice(start, len(chunk)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*cols, lists, back], names=[*batch.schema.names, ids, decoded])
                    start += len(chunk)
        finally:
            tokens.forget()  # Spark uses the worker again, for other operators too

    return rest.mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, model_bytes()))
