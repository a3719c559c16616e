import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

spm = pytest.importorskip("sentencepiece")
from loamworks.llm import sentencepieces as S  # noqa: E402

MODEL = S.model_bytes()
LIB = spm.SentencePieceProcessor(model_proto=MODEL)


def cases():
    rnd = random.Random(5)
    letters = "ab c▁  \n\t\ré漢字🎉xyzthe ing<s></s>0123\0"
    out = ["", " ", "  ", "a", " a", "\n", "\nfoo", "a \nb", "▁▁x", "x ", "<s> </s>", "héllo wörld. The end", "a" * 70]
    out += [" " * k + w for k in range(40) for w in ("", "a", "hello", "\n", "é")]
    return out + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]


def test_equals_library():
    t = S.PrefixTable(MODEL)
    texts = cases()
    offsets, ids = t.encode_batch(texts)
    bounds, raw = t.decode_batch(offsets, ids)
    for k, x in enumerate(texts):
        want = LIB.encode(x, add_eos=True)
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want == t.encode(x), x
        assert raw[bounds[k] : bounds[k + 1]].tobytes().decode() == LIB.decode(want) == t.decode(want), x


def test_small_table_of_parts(monkeypatch):
    monkeypatch.setattr(S, "CACHE_PARTS", 10)
    t = S.PrefixTable(MODEL)
    for x in ("one two three " * 9, "four five six seven eight nine ten eleven", "one two") * 2:
        assert t.encode_batch([x])[1].tolist() == LIB.encode(x, add_eos=True)


def test_wrong_bytes_decode():
    t = S.PrefixTable(MODEL)
    ids = [t.byte_id[0xE6], t.byte_id[0x41], t.byte_id[0xFF], *LIB.encode("x")]
    assert t.decode(ids) == LIB.decode(ids)


def test_operator(spark):
    texts = cases()[:80] + [None, "same", "same", "word " * 30_000]
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(texts)], "doc_id long, text string, IDS string").repartition(3)
    coded = S.encode_decode(df, MODEL)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    got = {r.doc_id: r for r in S.digests(coded).collect()}
    for i, x in enumerate(texts):
        ids = LIB.encode(x or "", add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert S.encode_decode(df.filter("false"), MODEL).count() == 0
    assert S.encode_decode(df.limit(0).withColumn("text", F.lit(None).cast("string")), MODEL).count() == 0


def test_workers_keep_nothing_of_texts(spark):
    """Workers outlive a task and serve other operators: what was learnt from texts goes when a task ends."""
    docs = spark.createDataFrame([(i, f"some words of document number {i} and more") for i in range(400)], "doc_id long, text string").repartition(8)

    def held(batches):
        for _ in batches:
            pass
        for t in S._TABLES.values():
            pairs = {id(known): len(known) for found in t.found for _, _, known in found}
            yield pa.RecordBatch.from_arrays([pa.array([len(t.known)]), pa.array([sum(pairs.values())])], names=["parts", "pairs"])

    assert S.encode_decode(docs, MODEL).filter("size(ids) > 0").count() == 400
    left = spark.range(0, 64, 1, 8).mapInArrow(held, "parts long, pairs long").collect()
    assert left and all(r.parts == r.pairs == 0 for r in left)
