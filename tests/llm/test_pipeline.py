import hashlib
import random
from collections import Counter

import corpus_pipeline as P
import sentencepiece as spm
from loamworks.llm import sentencepieces
from loamworks.llm.common import stash
from pyspark.sql import functions as F


def documents(n=240):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["an", "ther", "on", "ing", "es", "ti", "ou", "re"]) for _ in range(rnd.randint(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(60)]
        if i % 5 == 0:
            w.insert(9, "idiot")
        if i % 7 == 1:
            w.insert(9, "password=b7db7aa4a5fcc78305")
        out.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    out += [(1000 + i, out[i + 1][1], "en", "s1", 0) for i in range(4)]
    out += [(3000, None, "en", "s0", None), (3001, "", "fr", None, 0), (3002, "long " * 50_000, "en", "s2", 0), out[3], out[3]]
    return out


def test_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents(), schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stash(stage(spark, docs, str(tmp_path)))
        seen.append((name, docs.collect(), docs.columns))
    clean, single, masked, mixed, coded = (s[1] for s in seen)
    assert all(s[2] == columns for s in seen[:-1])
    assert {r.doc_id for r in clean} >= {i for i in range(240) if i % 5} and not {r.doc_id for r in clean} & {i for i in range(240) if i % 5 == 0}
    ids = Counter(r.doc_id for r in single)
    assert set(ids.values()) == {1}
    # copies and the empty one of two empty texts are gone; all else stays
    assert set(ids) == {r.doc_id for r in clean} - {1000, 1001, 1002, 1003, 3001}
    assert len(masked) == len(single)
    assert not any("b7db7aa4" in (r.text or "") for r in masked) and any("[SECRET]" in (r.text or "") for r in masked)
    assert all(r.n_chars == len(r.text or "") for r in masked)
    texts = {r.doc_id: r.text for r in masked}
    assert all(r.text == texts[r.doc_id] for r in mixed) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    lib = spm.SentencePieceProcessor(model_proto=sentencepieces.model_bytes())
    assert len(coded) == len(mixed)
    for r in coded:
        ids_of = lib.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids_of)).encode()).hexdigest()
    assert sorted(map(str, P.run(spark, str(tmp_path)).collect())) == sorted(map(str, coded))


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name(spark, tmp_path):
    """Columns named like those that operators use inside go through all stages but the last."""
    own = ("_score", "_mark", "_name", "_copy", "p", "key", "draw", "whole", "edge", "size", "target", "copies", "taken", "source_size", "_whole", "_spans", "base_spans", "score", "fp", "_own_draw")
    rows = [(i, f"some words of document number {i} " * 9, "en", "s", 0) for i in range(30)] + [(None, None, None, None, None)] * 2
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *[F.lit(f"mine {c}").alias(c) for c in own])
    spark.createDataFrame([*[(i, 1, int(i == 2)) for i in range(20)], (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stash(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        got = docs.collect()
        assert got and all(r[c] == f"mine {c}" for r in got for c in own), name
