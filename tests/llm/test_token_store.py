import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinweave.llm.common import Scratch
from kinweave.llm.token_store import Chunked, pack, read_store, unpack, write_store

PATH = P.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_round_trip(values):
    control, data = pack(np.array(values, np.uint64))
    assert len(control) == -(-len(values) // 4)
    assert unpack(control, data, len(values)).tolist() == values


def test_chunks_equal_the_library(texts):
    c = Chunked(PATH)
    texts = [*texts, "The, THE... don't Don't's it's. 'S x'S a<|endoftext|> Ärger! ÀÉ×÷ ǅ ŒŸ ÿ,ß; É́ o'clock! the's' A_b a1b2.", "e\u0301, x\u00a0y. z\u3000w! \x1ca,"]
    for text, got in zip(texts, c.encode(texts, 2, "<u2"), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == [*c.tokenizer.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("size", [0, 1, 500])
def test_store(spark, texts, size):
    rows = [(None if i == 3 else (i * 7919) % 601, None if i == 5 else t, 1) for i, t in enumerate(texts[:size])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = read_store(*write_store(spark, docs, PATH, 2, Scratch(spark, "t"))).collect()
    tokenizer, at = Chunked(PATH).tokenizer, 0
    want = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in want]
    for r, w in zip(got, want, strict=True):
        ids = [*tokenizer.encode(w[1] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)


def test_files_are_in_order_and_stand_alone(spark):
    """A hot id over several shards, null ids, and the files read in order by another session."""
    import pyarrow.parquet as pq

    from kinweave.llm.token_store import open_store

    rows = [(7, f"hot text {i} of one id") for i in range(300)] + [(None, f"no id {i}") for i in range(60)] + [(i * 3, f"word {i} " * (i % 9)) for i in range(200)]
    scratch = Scratch(spark, "t")
    write_store(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7), PATH, 2, scratch)
    got = read_store(*open_store(spark.newSession(), f"{scratch.root}/store")).collect()
    assert len(got) == len(rows)
    tokenizer, texts = Chunked(PATH).tokenizer, {}
    for d, t in rows:
        texts.setdefault(d, []).append([*tokenizer.encode(t, add_special_tokens=False).ids, 2])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        texts[r.doc_id].remove(np.frombuffer(r.ids, "<u4").tolist())
        assert r.start == at
        at += r.n_tokens
    folder = f"{scratch.root}/store/blocks".removeprefix("file://")
    import pathlib

    ids, shards = [], []
    for f in sorted(pathlib.Path(folder).glob("part-*")):
        for b in pq.read_table(f).to_pylist():
            ids += [-1 if d is None else d for d in b["doc_ids"]]
            shards.append(b["shard"])
    assert ids == sorted(-1 if d is None else d for d, _ in rows) and shards == sorted(shards) and len(set(shards)) == 4


def test_shards_share_out_a_hot_id():
    from kinweave.llm.token_store import shard_of

    bounds, rng = np.array([5, 7, 7, 7, 9]), np.random.default_rng(0)
    ties = rng.integers(-(1 << 63), 1 << 63, 30_000)
    ids = rng.choice([1, 5, 6, 7, 8, 9, 10], 30_000)
    shard = shard_of(bounds, ids, ties)
    order = np.lexsort((ties, ids))
    assert (np.diff(shard[order]) >= 0).all() and set(shard[ids == 7]) == {2, 3, 4} and set(shard[ids == 6]) == {1} and set(shard[ids == 10]) == {5}
