import base64

import pytest

from corpusloom.llm import tokens

VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = ["", None, " ", "Hello, world's 1234 end ", "naïve café – 日本語 🔥\x00\u2028", "\r\n\t  a\n\n  b", "<|endoftext|> is text", "x" * 20000, "a" * 3 + " " * 50 + "\n", "'ll 've 's I'd 're", "\u00ad\u200b\ufeff"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_match_and_decode_is_inverse(spark, reference):
    rows = spark.createDataFrame([(n, t, "other") for n, t in enumerate(TEXTS)] * 2, "doc_id long, text string, ids string")
    encoded = tokens.encode_corpus(rows)
    got = encoded.collect()
    assert len(got) == 2 * len(TEXTS) and encoded.columns == ["doc_id", "ids"]
    assert all(r.ids == reference(TEXTS[r.doc_id] or "") for r in got)
    assert {r.doc_id: r.text for r in tokens.decode_corpus(encoded).collect()} == {n: t or "" for n, t in enumerate(TEXTS)}


def test_whole_corpus_matches(spark, sf, reference):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.ids == reference(text[r.doc_id] or "") for r in tokens.encode_corpus(documents).collect())


def test_empty_table_and_null_id(spark):
    schema = "doc_id long, text string"
    assert tokens.encode_corpus(spark.createDataFrame([], schema)).collect() == []
    assert tokens.encode_corpus(spark.createDataFrame([(None, "a")], schema)).first().ids
