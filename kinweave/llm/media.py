"""Media columns: what bytes are, whatever they are declared to be.

An Aho-Corasick automaton finds every magic number in one pass. A validator of the format then follows the structure from
there (chunk lengths, checksums, trailers) and says how long the item is, or that it is none. The item at the start gives the
true type, which corrects the declared one; valid items further in, within or behind it, are embedded media and are carved.
"""

from __future__ import annotations

import binascii
import re
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

UNKNOWN = "application/octet-stream"
UNIT = 64
CARVED = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
SNIFFED = "type string, length long, corrected boolean, carved array<struct<offset: bigint, length: bigint, type: string>>"


def riff(data: bytes, at: int) -> tuple[str, int] | None:
    kind, size = data[at + 8 : at + 12], int.from_bytes(data[at + 4 : at + 8], "little") + 8
    kinds = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
    if kind not in kinds or at + size > len(data):
        return None
    place, end, names = at + 12, at + size, []
    while place + 8 <= end:
        names.append(data[place : place + 4])
        length = int.from_bytes(data[place + 4 : place + 8], "little")
        if place + 8 + length > end:
            return None
        place += 8 + length + length % 2
    if kind == b"WAVE" and not (names[:1] == [b"fmt "] and b"data" in names):
        return None
    return (kinds[kind], size) if names else None


def png(data: bytes, at: int) -> tuple[str, int] | None:
    place, first = at + 8, True
    while place + 12 <= len(data):
        length, name = int.from_bytes(data[place : place + 4], "big"), data[place + 4 : place + 8]
        end = place + 12 + length
        if end > len(data) or first and (name != b"IHDR" or length != 13) or binascii.crc32(data[place + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if name == b"IEND":
            return "image/png", end - at
        place, first = end, False
    return None


def gif(data: bytes, at: int) -> tuple[str, int] | None:
    def blocks(place: int) -> int:
        while place < len(data) and data[place]:
            place += data[place] + 1
        return place + 1

    if at + 13 > len(data):
        return None
    flags, place = data[at + 10], at + 13
    place += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    while place < len(data):
        mark = data[place]
        if mark == 0x3B:
            return "image/gif", place + 1 - at
        if mark == 0x21:
            place = blocks(place + 2)
        elif mark == 0x2C and place + 10 <= len(data):
            flags = data[place + 9]
            place = blocks(place + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return None
    return None


def jpeg(data: bytes, at: int) -> tuple[str, int] | None:
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        mark, length = data[place + 1], int.from_bytes(data[place + 2 : place + 4], "big")
        if mark < 0xC0 or length < 2:
            return None
        place += 2 + length
        if mark == 0xDA:
            while (place := data.find(b"\xff", place)) >= 0 and place + 1 < len(data):
                if data[place + 1] == 0xD9:
                    return "image/jpeg", place + 2 - at
                if data[place + 1] and not 0xD0 <= data[place + 1] <= 0xD7:
                    break
                place += 2
            if place < 0:
                return None
    return None


def bmp(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 26 > len(data):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", data, at + 2)
    good = zero == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= start <= size <= len(data) - at
    return ("image/bmp", size) if good else None


@lru_cache(maxsize=3)
def places_of(data: bytes, mark: bytes) -> list[int]:
    """All places of a mark, found once for all headers of the data."""
    return [m.start() for m in re.finditer(re.escape(mark), data)]


def pdf(data: bytes, at: int) -> tuple[str, int] | None:
    """Up to the last end mark with a startxref of its own before the next header: each update adds one."""
    if not (data[at + 5 : at + 6].isdigit() and data[at + 6 : at + 7] == b"."):
        return None
    headers, ends, tables = (places_of(data, x) for x in (b"%PDF-", b"%%EOF", b"startxref"))
    following = bisect_right(headers, at)
    header = headers[following] if following < len(headers) else len(data)
    last, stop = at, -1
    for k in range(bisect_right(ends, at), len(ends)):
        if last != at and ends[k] > header:  # the first one counts even behind a further header, of an embedded file
            break
        own = bisect_right(tables, ends[k] - 9) - 1
        if own >= 0 and tables[own] >= last:
            stop = ends[k] + 5
        last = ends[k] + 5
    return ("application/pdf", stop - at) if stop > 0 else None


@lru_cache(maxsize=1)
def archives(data: bytes) -> dict[int, int]:
    """Start and end of each archive whose end record's offsets fit; a stored archive within another has its own."""
    found, end = {}, data.find(b"PK\x05\x06")
    while 0 <= end <= len(data) - 22:
        size, start, note = struct.unpack_from("<IIH", data, end + 12)
        at = end - size - start
        if at >= 0 and data[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(data):
            found.setdefault(at, end + 22 + note)
        end = data.find(b"PK\x05\x06", end + 1)
    return found


def zipped(data: bytes, at: int) -> tuple[str, int] | None:
    end = archives(data).get(at)
    return ("application/zip", end - at) if end else None


def gzipped(data: bytes, at: int) -> tuple[str, int] | None:
    import zlib

    stream = zlib.decompressobj(31)
    try:
        rest = data[at:]
        while rest and not stream.eof:
            stream.decompress(rest, 1 << 20)
            rest = stream.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", len(data) - at - len(stream.unused_data)) if stream.eof else None


#: Magic numbers and the validators of their formats.
FORMATS: dict[bytes, Callable[[bytes, int], tuple[str, int] | None]] = {
    b"RIFF": riff,
    b"\x89PNG\r\n\x1a\n": png,
    b"GIF87a": gif,
    b"GIF89a": gif,
    b"\xff\xd8\xff": jpeg,
    b"BM": bmp,
    b"%PDF-": pdf,
    b"PK\x03\x04": zipped,
    b"\x1f\x8b\x08": gzipped,
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in FORMATS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def items(data: bytes) -> list[tuple[int, int, str]]:
    """Offset, length and type of all valid items."""
    found = []
    for last, magic in automaton().iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if got := FORMATS[magic](data, at):
            found.append((at, got[1], got[0]))
    return found


def sniff(data: bytes, declared: str | None) -> tuple[str, int, bool, list[tuple[int, int, str]]]:
    """Type, length of the item at the start, whether that corrects the declared type, and embedded items."""
    found = items(data)
    top = next((x for x in found if x[0] == 0), None)
    kind, length = (top[2], top[1]) if top else (UNKNOWN, len(data))
    return kind, length, kind != (declared or UNKNOWN), [x for x in found if x[0] > 0]


def sniff_media(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns named by keep, then type, length, corrected and carved, for rows(media binary, declared string).

    An empty table gives an empty one, repeated rows give repeated rows, and other columns are not looked at. Very long items are
    sniffed whole. Null or empty bytes are of unknown type with length 0; an unknown declared type may be null. A column kept under one of
    the four names is an error.
    """
    fields = [f for f in rows.schema.fields if f.name in keep]
    if {f.name for f in fields} & {"type", "length", "corrected", "carved"}:
        raise ValueError("a kept column has the name of a result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sniff(m or b"", d) for m, d in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True)]
            carved = [[{"offset": o, "length": n, "type": t} for o, n, t in x[3]] for x in got]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.bool_()), pa.array(carved, CARVED)],
                names=[*(f.name for f in fields), "type", "length", "corrected", "carved"],
            )

    needed = list(dict.fromkeys([*(f.name for f in fields), "media", "declared"]))
    return rows.select(*needed).mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SNIFFED]))


def wave(payload: bytes, rate: int = 8000) -> bytes:
    """Payload as 8-bit samples of one channel; its length must be even."""
    form = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s4sI", b"RIFF", 4 + 8 + len(form) + 8 + len(payload), b"WAVE", b"fmt ", len(form)) + form + struct.pack("<4sI", b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a wave file, by its chunk lengths."""
    place = 12
    while place + 8 <= len(media):
        name, length = media[place : place + 4], int.from_bytes(media[place + 4 : place + 8], "little")
        if name == b"data":
            return media[place + 8 : place + 8 + length]
        place += 8 + length + length % 2
    return b""


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary), declared of docs(doc_id, text): UTF-8 bytes, zeros up to a positive multiple of 64, as samples.

    A null text is empty. The type is declared as unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                data = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = [wave(x.ljust(max(UNIT, -(-len(x) // UNIT) * UNIT), b"\0")) for x in data]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(data))], names=["doc_id", "n_bytes", "media", "declared"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, media binary, declared string")


def read_back(rows: DataFrame) -> DataFrame:
    """All columns of rows(media, type, carved, ...) and payload (binary), feature (string: type, samples, mean and standard deviation of samples, embedded items).

    Columns named payload or feature are an error. Media that are null or no wave file have an empty payload.
    """
    schema = rows.schema
    if {"payload", "feature"} & set(schema.names):
        raise ValueError("a column has the name of a result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, features = [], []
            for media, kind, carved in zip(*(batch.column(c).to_pylist() for c in ("media", "type", "carved")), strict=True):
                payload = samples(media or b"") if kind == "audio/wav" else b""
                v = np.frombuffer(payload or b"\0", np.uint8).astype(np.float64)
                payloads.append(payload)
                features.append(f"{kind};samples={len(payload)};mean={v.mean():.4f};std={v.std():.4f};embedded={len(carved)}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*schema.names, "payload", "feature"])

    return rows.mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), "payload binary, feature string"]))
