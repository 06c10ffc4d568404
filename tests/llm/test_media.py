import gzip
import io
import struct
import zipfile
import zlib

import pytest

from kinweave.llm.media import UNKNOWN, read_back, sniff, sniff_media, text_media, wave


def png():
    def chunk(name, data):
        return len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0" + bytes(6) + b"\x2c" + bytes(8) + b"\0\2\2\x44\1\0\x3b"
GOOD = {"image/png": png(), "application/zip": zipped(), "application/gzip": gzip.compress(b"x"), "image/gif": GIF, "audio/wav": wave(b"ab"), "application/pdf": b"%PDF-1.4 x startxref 0 %%EOF", "image/bmp": b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)}


@pytest.mark.parametrize("kind", GOOD)
def test_types(kind):
    data = GOOD[kind]
    assert sniff(data + b"tail", "text/plain") == (kind, len(data), True, [])
    assert sniff(data, kind)[2] is False
    assert (5, len(data), kind) in sniff(b"abcde" + data + b"zz", None)[3]
    assert sniff(data[:-1], None)[0] == UNKNOWN  # cut short


def test_embedded_and_damaged():
    assert sniff(wave(png() + b"\0"), None)[3] == [(44, len(png()), "image/png")]
    bad = bytearray(png())
    bad[20] ^= 1
    assert sniff(bytes(bad), None)[0] == UNKNOWN
    assert sniff(b"", None) == (UNKNOWN, 0, False, [])


def test_round_trip(spark, texts):
    rows = [(i, None if i == 4 else t, "x") for i, t in enumerate(texts)] + [(None, "q", "x"), (1, texts[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = read_back(sniff_media(text_media(docs), ["doc_id", "n_bytes", "media"])).collect()
    want = {r[0]: (r[1] or "").encode() for r in rows}
    assert len(got) == len(rows)
    for r in got:
        data = want[r.doc_id]
        assert r.n_bytes == len(data) and r.payload.rstrip(b"\0") == data.rstrip(b"\0") and r.payload.startswith(data)
        assert len(r.payload) % 64 == 0 and 64 <= len(r.payload) < len(data) + 65 and r.corrected and r.type == "audio/wav"
    assert read_back(sniff_media(text_media(docs.limit(0)), ["doc_id", "media"])).count() == 0


def jpeg():
    part = lambda mark, data: b"\xff" + bytes([mark]) + (len(data) + 2).to_bytes(2, "big") + data
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, bytes(65)) + part(0xDA, b"\1\1\0\0\x3f\0") + b"ab\xff\0cd\xff\xd0ef\xff\xd9"


def form(kind, body):
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + kind + body


def test_more_formats():
    """JPEG with stuffed bytes and restart marks, WebP, AVI and the older GIF, whole and cut short."""
    webp = form(b"WEBP", b"VP8 " + (10).to_bytes(4, "little") + bytes(10))
    avi = form(b"AVI ", b"LIST" + (4).to_bytes(4, "little") + b"hdrl")
    for data, kind in ((jpeg(), "image/jpeg"), (webp, "image/webp"), (avi, "video/x-msvideo"), (GIF.replace(b"89a", b"87a"), "image/gif")):
        got = sniff(data + b"zz", None)
        assert got[1] == len(data) and got[0].split("/")[0] == kind.split("/")[0], (got, kind)
        assert sniff(data[:-1], None)[0] == UNKNOWN, kind
        assert (3, len(data)) in [x[:2] for x in sniff(b"abc" + data, None)[3]]


def test_long_texts_full_of_marks():
    """No format searches to the end anew from each of its marks."""
    import time

    began = time.time()
    for mark in (b"%PDF-1.4 ", b"PK\x03\x04", b"GIF89a", b"\xff\xd8\xff\xe0\0\4ab", b"RIFF\xff\0\0\0WAVE"):
        sniff(mark * 40_000, None)
        sniff(mark * 40_000 + b"startxref %%EOF", None)
    assert time.time() - began < 60


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    stored = sniff_media(text_media(docs), ["doc_id", "media"])
    with pytest.raises(ValueError):
        read_back(stored.withColumn("payload", stored.media))
