import random

import pytest


@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def texts(documents):
    rng = random.Random(7)
    odd = ["", " ", "\n\n  x", "it's we'll 'S", "a" * 3000, "ab" * 700 + "!" * 500, "\x1c\x1d a\x85b　c", "日本語 テキスト 123 ́e", "é ÀÉ İ ß Σας", "<|endoftext|> x<|startoftext|>y", "\0\1\2", "🙂🙃 zz"]
    odd += ["".join(rng.choice("aeé \n'1!ß日") for _ in range(rng.randrange(200))) for _ in range(100)]
    return odd + [d["text"] for d in documents]
