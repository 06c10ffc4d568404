import hashlib

import corpus_pipeline
import public_tokenizers as P
from test_decontamination import brute as contaminated
from test_near_dups import brute as near
from test_paragraphs import brute as repeated

from kinweave.llm.byte_bpe import ByteBPE

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs, columns = spark.read.parquet(f"{tmp_path}/{i}"), docs.columns
        if name != "byte-level BPE":
            assert docs.columns == columns
            got = {r.doc_id: r for r in docs.collect()}
            assert len(got) == docs.count()
        if i == 0:
            assert 0.75 * len(rows) < len(got) < len(rows)
        elif name == "MinHash near-dedup":
            assert set(got) == {x[0] for x in near(rows, 5, 80, 100) if x[3]}
        elif name == "substring dedup":
            assert {k: r.text for k, r in got.items()} == {x[0] - 1: x[4] for x in repeated([(d + 1, t) for d, t in rows])}
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "benchmark decontamination":
            assert set(got) == {d for d, t in rows if not contaminated([(d + 1, t)], items)[0][5]}
        else:
            bpe = ByteBPE.from_file(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
            texts = dict(rows)
            for r in docs.collect():
                assert bytes(r.ids) == bpe.encode_batch([texts[r.doc_id]])[0] and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
            assert docs.count() == len(rows)
            break
        rows = [(k, r.text) for k, r in got.items()]


def test_odd_rows(spark):
    rows = [(1, "a b c " * 30, "x"), (1, "a b c " * 30, "x"), (None, "q w e " * 30, "x"), (None, None, None), (5, "", "y"), (None, "other words here " * 9, "x")]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, sh string")
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
        assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept.collect()) == ([(0, ""), (0, "o"), (0, "q"), (1, "a"), (5, "")] if rows else [])
        assert corpus_pipeline.drop_repeated_paragraphs(spark, kept, SF).count() == (5 if rows else 0)
        assert corpus_pipeline.drop_contaminated(spark, docs, SF).count() == len(rows)


def test_other_columns_come_back(spark):
    """Columns with the names of results and of internal columns."""
    names = ["rk", "score", "n_hit", "predicted", "held_out", "n_removed", "n_words", "items", "n_items", "contaminated", "gone", "sh", "th", "key", "root", "__rk", "__gone", "__rest", "_x", "a.b"]
    rows = [(i, f"alpha {i} beta gamma delta " * 8, "en", *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert tuple(r)[2:] == rows[r.doc_id][2:], name
