import random

import pytest
from pyspark.sql import functions as F

from ionloom.llm.tokenizer import BYTE_BPE_50K, MATRIX_BYTES, PATTERN, BytePairEncoder, TextEncoder, bpe_ids, read_ranks

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = read_ranks(BYTE_BPE_50K)
    reference = tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return TextEncoder(BytePairEncoder(ranks)), reference


def test_against_reference(both):
    own, reference = both
    rng = random.Random(6)
    texts = ["<|endoftext|> is text", "a" * 3000, "ab" * (MATRIX_BYTES // 2 + 40), "�…  \n\t x", "中文" * 700, "don't we'll I'd", "🙂🙃" * 9]
    texts += ["".join(rng.choice("abcdefghij  éß中🙂\n\t.,'s1234") for _ in range(rng.choice([1, 7, 60, 900]))) for _ in range(200)]
    got = own.encode(texts).to_pylist()
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert all(reference.decode(ids) == t for ids, t in zip(got, texts))
    assert own.encode(texts[::-1]).to_pylist() == got[::-1]  # from memory


def test_column(spark, both):
    df = spark.createDataFrame([(1, "Note the doublet"), (2, ""), (3, None), (4, " "), (5, "x" * 200_000), (1, "Note the doublet")], "doc_id bigint, text string")
    rows = df.select("doc_id", bpe_ids(spark, F.col("text")).alias("ids")).collect()
    ids = {r.doc_id: r.ids for r in rows}
    assert len(rows) == 6 and ids[2] == [] and ids[3] == [] and ids[4] == both[1].encode_ordinary(" ")
    assert both[1].decode(ids[5]) == "x" * 200_000 and ids[1] == both[1].encode_ordinary("Note the doublet")
    assert df.limit(0).select(bpe_ids(spark, F.col("text"))).collect() == []
