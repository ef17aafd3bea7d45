"""Texts that hold an added token of the vocabulary file get its id."""

import public_tokenizers as P
from tokenizers import Tokenizer

from lithoframe.llm import packing


def test_added_tokens_get_their_ids(spark):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y ", "<|endoftext |> plain", "é. <|endoftext|>"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    for t in (packing.tokens(path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), packing.tokens(path, None, None)):
        assert [t.encode(x) for x in texts] == want and not t.ends[50256]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = packing.pack_documents(df, path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).groupBy("doc_id").agg({"doc_tokens": "max"}).collect()
    assert {r[0]: r[1] for r in out} == {i: len(w) + 1 for i, w in enumerate(want)}
