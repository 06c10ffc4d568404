import public_tokenizers as P
import pytest

from kinweave.llm.byte_bpe import ByteBPE, encode_decode

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE.from_file(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def public(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_equals_the_public_library(bpe, public, texts):
    for text, got in zip(texts, bpe.encode_batch(texts), strict=True):
        assert ids(got) == public.encode_ordinary(text)
        assert bpe.decode(got) == text.encode()


def test_rows(spark, bpe):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "", "y"), (3, None, None)]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in got) == [(-1, b""), (1, b"a b"), (1, b"a b"), (3, b"")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(empty, PATH, P.PATTERN).count() == 0
