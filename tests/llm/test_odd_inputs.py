"""Every operator over nulls, empty and very long texts, repeated rows, ties, no rows, and columns with the names of results and of internal columns."""

import public_tokenizers as P
import pytest

from kinweave.llm import byte_bpe, decontamination, licenses, media, near_dups, paragraphs, quality, substrings, token_store
from kinweave.llm.common import Scratch

NAMES = ["rk", "sh", "n", "h", "mark", "key", "root", "ids", "start", "stop", "tie", "shard", "media", "payload", "label", "w", "len", "fp", "removed", "kept", "score", "n_hit", "n_words", "n_removed", "gone", "part", "seg"]
LONG = "Licensed under the Apache License, Version 2.0 " * 3 + " ".join(f"w{i % 977}x{i % 13}" for i in range(150_000))
ROWS = [(1, "a b c d e f " * 30), (1, "a b c d e f " * 30), (1, "another text of the same id " * 12), (None, "q w e " * 40), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, LONG), (9, "x" * 3000)]


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (None, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "w5x5 w6x6 w7x7 w8x8", "z"), (2, None, "z"), (None, "e q w", "z"), (3, " ".join(LONG.split()[1000:1040]), "z")], "item_id long, text string, rk string")
    bpe, words = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
    return {
        "suffixes": lambda d: substrings.remove_repeats(d, Scratch(spark, "a")).select("doc_id", "n_bytes"),
        "quality": lambda d: quality.score_quality(d, labels).select("doc_id", "score"),
        "media": lambda d: media.read_back(media.sniff_media(media.text_media(d), ["doc_id", "n_bytes", "media"])).select("doc_id", "feature"),
        "store": lambda d: token_store.read_store(*token_store.write_store(spark, d, words, 2, Scratch(spark, "b"))).select("doc_id", "n_tokens"),
        "near": lambda d: near_dups.near_duplicates(d, Scratch(spark, "c"), 3, (85, 100)).select("doc_id", "component_id"),
        "contamination": lambda d: decontamination.contamination(d, items, Scratch(spark, "d")).select("doc_id", "n_hit"),
        "bpe": lambda d: byte_bpe.encode_decode(d, bpe, P.PATTERN).select("doc_id", "decoded"),
        "licenses": lambda d: licenses.scan_licenses(d).select("doc_id", "score"),
        "paragraphs": lambda d: paragraphs.dedup_paragraphs(d, Scratch(spark, "e")).select("doc_id", "n_removed"),
    }


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string" + "".join(f", `{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *NAMES) for r in ROWS], schema)


@pytest.mark.parametrize("name", ["suffixes", "quality", "media", "store", "near", "contamination", "bpe", "licenses", "paragraphs"])
def test_odd(spark, docs, name):
    run, key = operators(spark)[name], lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    got = sorted(map(tuple, run(docs).collect()), key=key)
    plain = sorted(map(tuple, run(docs.select("doc_id", "text")).collect()), key=key)
    assert got == plain and sorted((r[0] is None, r[0] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    by = {r[0]: r[1] for r in got}
    assert {
        "suffixes": lambda: by[7] == len(LONG) and by[5] == 0,
        "quality": lambda: by[7] == by[8],
        "media": lambda: by[7] == by[8] and by[5] == by[4],
        "store": lambda: by[5] == by[4] == by[6] == 1 and by[7] == by[8] > 150_000,
        "near": lambda: by[8] == by[7] == 7 and by[4] == 4,
        "contamination": lambda: by[7] == by[8] > 40 and by[5] == 0,
        "bpe": lambda: bytes(by[7]).decode() == LONG and bytes(by[5]) == b"",
        "licenses": lambda: by[7] == 0.9 and by[5] == 0,
        "paragraphs": lambda: by[8] == len(LONG.split()) and by[7] < by[8] and by[5] == 0,
    }[name]()
    assert run(docs.limit(0)).count() == 0
