"""The pipeline: what each stage keeps and changes, against brute force on a small corpus."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P

from lithoframe.llm import packing

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_stages_and_run(spark, tmp_path):
    passage = prose(110)
    texts = {i: prose(150) for i in range(60)}
    texts[60] = texts[0]  # an exact copy
    texts[61] = prose(60) + " " + passage + " " + prose(60)
    texts[62] = prose(50) + " " + passage + " " + prose(70)
    texts[63] = "too short"
    texts[64] = prose(80) + ' token = "0123456789abcdefXYZ" ' + prose(20)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(70, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "secret scans", "packing"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({r.doc_id: r for r in docs.collect()} if k < 4 else docs)
    assert all(list(s[0].asDict()) == df.columns for s in seen[:4])
    assert set(seen[0]) == set(texts) - {63} and set(seen[1]) == set(texts) - {63, 60} == set(seen[2]) == set(seen[3])
    assert passage not in seen[2][61].text and passage not in seen[2][62].text and seen[2][5].text == texts[5]
    assert "[SECRET]" in seen[3][64].text and "0123456789abcdef" not in seen[3][64].text and seen[3][5].text == texts[5]
    t = packing.tokens(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = {i: len(t.encode(r.text)) + 1 for i, r in seen[3].items()}
    got = {r.doc_id: r["sum(length)"] for r in seen[4].groupBy("doc_id").sum("length").collect()}
    assert got == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    same = lambda d: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert np.sum([r[2] for r in same(whole)]) == sum(want.values()) and {r[0] for r in same(whole)} == set(want)
