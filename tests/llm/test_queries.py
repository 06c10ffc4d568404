"""The queries opN_ without SQL against plain versions of what they return, on whole tables."""

import hashlib
import io
import math
import re
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from kinweave.llm import quality, queries
from kinweave.llm.licenses import PHRASES, templates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: (r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def rows(spark, name):
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == len({r.doc_id for r in got})
    return {r.doc_id: r for r in got}


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, texts):
    data = {d: t.encode() for d, t in texts.items()}
    times = Counter(x[i : i + 200] for x in data.values() for i in range(len(x) - 199))
    got = rows(spark, "op1_suffix_dedup")
    for d, x in data.items():
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 199):
            if times[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert tuple(got[d])[1:5] == (len(x), int(gone.sum()), spans, digest(bytes(b for b, g in zip(x, gone) if not g)))


def test_op2(spark, texts):
    """Trees walked one node at a time."""
    forest = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = rows(spark, "op2_quality")
    for d, t in texts.items():
        x, total = quality.statistics([t])[0], forest.start
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        score = 1 / (1 + math.exp(-total))
        assert math.isclose(got[d].score, score, abs_tol=1e-12) and got[d].predicted == (score >= 0.3) and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_op4(spark, texts):
    got = rows(spark, "op4_media")
    for d, t in texts.items():
        payload = t.encode().ljust(max(64, -(-len(t.encode()) // 64) * 64), b"\0")
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(1)
            f.setframerate(8000)
            f.writeframes(payload)
        mean = sum(payload) / len(payload)
        std = math.sqrt(sum((b - mean) ** 2 for b in payload) / len(payload))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(payload), digest(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), digest(out.getvalue()))
        kind, n, *found = r.feature.split(";")
        numbers = [float(x.split("=")[1]) for x in found[:2]]
        assert (kind, n) == ("audio/wav", f"samples={len(payload)}") and np.allclose(numbers, (mean, std), atol=1e-4)


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, at, got = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, rows(spark, "op5_token_store")
    for d in sorted(texts):
        ids = [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 2]
        assert tuple(got[d])[1:4] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op8(spark, texts):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = rows(spark, "op8_byte_bpe")
    for d, t in texts.items():
        ids = library.encode_ordinary(t)
        assert tuple(got[d])[1:4] == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.encode()))


def test_op9(spark, texts):
    got = rows(spark, "op9_licenses")
    kinds = {"text": 1.0, "notice": 0.9}
    for d, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        base = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        coded = [w.encode() for w in words]
        found = [(x.label, x.kind) for x in templates() for i in range(len(words)) if words[i] == x.anchor[0] and x.accepts(coded, i) is not None]
        starts = [i for i, _ in base]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and r.labels == ",".join(sorted({x for _, x in base} | {x for x, _ in found}))
        assert r.score == max([0.0, *(kinds[k] for _, k in found), *(0.6 for _ in base)])
