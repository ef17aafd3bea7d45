"""Extra columns with the operators' own names, very long texts, ties: every operator and stage gives its defined result."""

import random

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import bpe, licenses, packing, quality, repeats, secrets, sharding, simhash, tiff, token_counts

rng = random.Random(3)
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
CLASH = ["fp", "component_id", "id", "sig", "h", "sha", "raw", "spans", "kept", "n", "b", "size", "shard", "slot", "blob", "rule", "start", "end", "page", "limits", "measure", "bin", "k", "c", "a", "place", "hits", "n_tokens", "node", "root", "u", "v", "m", "i", "path"]
PATTERN = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(120_000))
    rows = [(1, "a short text"), (2, None), (3, long), (4, long[:300_000] + "x"), (5, "z" * 200_000), (5, "z" * 200_000), (None, "same"), (7, "same")]
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH})


OPERATORS = {
    "licenses": lambda d: licenses.own_licenses(d), "repeats": lambda d: repeats.repeats_table(d), "simhash": lambda d: simhash.fingerprint_table(d), "tiff": lambda d: tiff.store_texts(d), "quality": lambda d: quality.quality_table(d),
    "bpe": lambda d: bpe.digest_texts(d, MULTI, P.PATTERN), "sharding": lambda d: sharding.shard_by_bytes(d), "secrets": lambda d: secrets.secrets_table(d), "similar": lambda d: simhash.similar_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(docs, name):
    out = OPERATORS[name](docs)
    assert sorted(map(str, (r.doc_id for r in out.select("doc_id").collect()))) == sorted(map(str, (1, 2, 3, 4, 5, 5, None, 7)))


def test_totals(docs):
    n = sum(r.n_docs for r in token_counts.count_table(docs, MULTI, P.PATTERN).collect())
    assert n == 8
    out = packing.pack_documents(docs, *PATTERN)
    per = out.groupBy("doc_id").agg(F.sum("length").alias("s"), F.max("doc_tokens").alias("d"), F.count_if(F.col("start") == 0).alias("copies")).collect()
    assert len(per) == 7 and all(r.s == r.d * r.copies for r in per)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, docs, k):
    out = corpus_pipeline.STAGES[k][1](spark, docs, "")
    assert out.columns == docs.columns
    rows = out.select("doc_id", "component_id", "text").collect()
    assert all(r.component_id == "clash component_id" for r in rows)
    ids = [r.doc_id for r in rows]
    if k in (2, 3):
        assert sorted(map(str, ids)) == sorted(map(str, (1, 2, 3, 4, 5, 5, None, 7)))
    if k == 1:
        # the two runs of z are one document, and a text without an id stays beside its copy
        assert ids.count(5) == 1 and None in ids
    if k == 0:
        assert 3 in ids and 1 not in ids


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, docs, k):
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), "").count() == 0
