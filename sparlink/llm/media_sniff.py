"""Operator 5: media columns by signature sniffing.

An Aho-Corasick automaton finds every known magic number in a column of bytes in one pass; a validator for the format
then confirms structure and length. What is confirmed corrects the declared type and is carved as embedded media.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, trimmed, utf8

#: Samples a second of stored payloads.
RATE = 8000


def _le(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n], "little")


def _be(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n], "big")


# Each validator gets the bytes and the place of the format's start; it gives (type, length) or None.
def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    kinds = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
    kind, end = kinds.get(b[at + 8 : at + 12]), at + 8 + _le(b, at + 4, 4)
    if not kind or end > len(b):
        return None
    chunk, seen = at + 12, []
    while chunk + 8 <= end:
        seen.append(b[chunk : chunk + 4])
        size = _le(b, chunk + 4, 4)
        if chunk + 8 + size > end:
            return None
        chunk += 8 + size + (size & 1)
    if chunk not in (end, end + 1) or kind == "audio/wav" and not (seen[:1] == [b"fmt "] and b"data" in seen):
        return None
    return kind, end - at


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    p = at + 8
    while p + 12 <= len(b):
        size, kind = _be(b, p, 4), b[p + 4 : p + 8]
        if p + 12 + size > len(b) or zlib.crc32(b[p + 4 : p + 8 + size]) != _be(b, p + 8 + size, 4) or p == at + 8 and kind != b"IHDR":
            return None
        p += 12 + size
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if len(b) < at + 13:
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    p = at + 13 + table(b[at + 10])
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return "image/gif", p + 1 - at
        if kind == 0x2C and p + 10 < len(b):
            p += 11 + table(b[p + 9])
        elif kind == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return "image/jpeg", p + 2 - at
        if kind == 0xFF or 0xD0 <= kind <= 0xD7:
            p += 1 if kind == 0xFF else 2
            continue
        size = _be(b, p + 2, 2)
        if size < 2:
            return None
        p += 2 + size
        if kind == 0xDA:  # entropy-coded data: up to a marker that is neither stuffing nor a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
    return ("image/jpeg", p + 2 - at) if b[p : p + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    size, start, head = _le(b, at + 2, 4), _le(b, at + 10, 4), _le(b, at + 14, 4)
    ok = len(b) >= at + 26 and at + size <= len(b) and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= size and _le(b, at + 6, 4) == 0
    return ("image/bmp", size) if ok else None


def _pdf(b: bytes, at: int) -> tuple[str, int] | None:
    nxt = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, nxt if nxt >= 0 else len(b))
    ok = end > 0 and b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"." and b.find(b"startxref", at, end) > 0
    return ("application/pdf", end + 5 - at) if ok else None


@lru_cache(maxsize=1)
def _directories(b: bytes) -> dict[int, int]:
    """By a ZIP's start the place of its end record: every end record tells one start, so all are found in one pass."""
    ends: dict[int, int] = {}
    p = b.find(b"PK\x05\x06")
    while p >= 0:
        start = _le(b, p + 16, 4)
        at = p - _le(b, p + 12, 4) - start
        if at >= 0 and len(b) >= p + 22 and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            ends.setdefault(at, p)
        p = b.find(b"PK\x05\x06", p + 1)
    return ends


def _zip(b: bytes, at: int) -> tuple[str, int] | None:
    p = _directories(b).get(at)
    if p is None:
        return None
    end = p + 22 + _le(b, p + 20, 2)
    return ("application/zip", end - at) if end <= len(b) else None


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    d, p, rest = zlib.decompressobj(31), at, b""
    try:
        while not d.eof and (rest or p < len(b)):
            if not rest:
                rest, p = b[p : p + 65536], p + 65536
            d.decompress(rest, 1 << 20)  # what a few bytes unfold to is not held at once
            rest = d.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - len(d.unused_data) - at) if d.eof else None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 4, True
    while p + 4 <= len(b):
        kind, size = b[p], _be(b, p + 1, 3)
        if first and (kind & 0x7F or size != 34):
            return None
        first, p = False, p + 4 + size
        if kind & 0x80:  # frames follow; their lengths are not written, so they reach to the end
            return ("audio/flac", len(b) - at) if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else None
    return None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    p, pages = at, 0
    while b[p : p + 5] == b"OggS\x00" and len(b) >= p + 27:
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b) or not pages and not b[p + 5] & 2:
            return None
        last, p, pages = b[p + 5] & 4, end, pages + 1
        if last:
            return "application/ogg", p - at
    return None


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    p, kinds = at, []
    while p + 8 <= len(b):
        size, kind = _be(b, p, 4), b[p + 4 : p + 8]
        size = _be(b, p + 8, 8) if size == 1 else size or len(b) - p  # 0: to the end
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"sidx", b"uuid", b"meta") or size < 8:
            break
        if p + size > len(b):  # cut short
            return None
        kinds.append(kind)
        p += size
    return ("video/mp4", p - at) if kinds[:1] == [b"ftyp"] and {b"moov", b"meta"} & {*kinds} else None


def _au(b: bytes, at: int) -> tuple[str, int] | None:
    start, size = _be(b, at + 4, 4), _be(b, at + 8, 4)
    ok = len(b) >= at + 24 and start >= 24 and _be(b, at + 12, 4) in range(1, 28) and size != 0xFFFFFFFF and at + start + size <= len(b)
    return ("audio/basic", start + size) if ok else None


#: Magic bytes, the distance of the format's start before them, and the validator.
SIGNATURES: list[tuple[bytes, int, Callable]] = [
    (b"RIFF", 0, _riff), (b"\x89PNG\r\n\x1a\n", 0, _png), (b"GIF87a", 0, _gif), (b"GIF89a", 0, _gif), (b"\xff\xd8\xff", 0, _jpeg), (b"BM", 0, _bmp),
    (b"%PDF-", 0, _pdf), (b"PK\x03\x04", 0, _zip), (b"\x1f\x8b\x08", 0, _gzip), (b"fLaC", 0, _flac), (b"OggS", 0, _ogg), (b"ftyp", 4, _mp4), (b".snd", 0, _au),
]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, before, _) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), (i, len(magic) - 1 + before))
    a.make_automaton()
    return a


def found_media(b: bytes, a) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all confirmed media by offset. Within the one that fills the value from its start,
    the outermost others; elsewhere the outermost."""
    out: list[tuple[int, int, str]] = []
    inside = 0
    for end, (i, back) in a.iter(b.decode("latin-1")):
        at = end - back
        if at < inside or at < 0:
            continue
        if got := SIGNATURES[i][2](b, at):
            out.append((at, got[1], got[0]))
            if not (at == 0 and got[1] == len(b)):
                inside = at + got[1]
    return out


def wav_samples(b: bytes, offset: int, length: int) -> tuple[bytes, int, int] | None:
    """The data, sample rate and bits of a confirmed WAV."""
    p, rate, bits = offset + 12, 0, 0
    while p + 8 <= offset + length:
        kind, size = b[p : p + 4], _le(b, p + 4, 4)
        if kind == b"fmt ":
            rate, bits = _le(b, p + 12, 4), _le(b, p + 22, 2)
        if kind == b"data":
            return b[p + 8 : p + 8 + size], rate, bits
        p += 8 + size + (size & 1)
    return None


def sniffed(df: DataFrame, media_col: str, declared_col: str) -> DataFrame:
    """df's columns as they are, as the struct `row`, with media_type, corrected, parts and samples.

    media_type is that of the media that fills the value from its start, or starts it; else the declared type. corrected:
    whether it differs from the declared type. parts: array of (offset, length, type, sha256) of the media carved from
    inside. samples: a WAV's data, read from the stored bytes, else null. A null value has the declared type, no parts and
    no samples; an empty one likewise. Repeated rows give rows each; an empty table none. A map over the scan, no shuffle.
    """
    whole = bounded_batches(df).select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != media_col)).alias("row"), F.col(declared_col).cast("string").alias("declared"), F.col(media_col).cast("binary").alias("media"))
    kind = whole.schema["row"].dataType.simpleString()
    part = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        a = automaton()
        for batch in batches:
            for b in slices(batch):
                types, corrected, parts, samples = [], [], [], []
                for said, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    got = found_media(m, a) if m else []
                    own = got[0] if got and got[0][0] == 0 else None
                    types.append(own[2] if own else said)
                    corrected.append(bool(own) and own[2] != said)
                    parts.append([{"offset": o, "length": n, "type": t, "sha256": hashlib.sha256(m[o : o + n]).hexdigest()} for o, n, t in got if own is None or o])
                    wav = wav_samples(m, 0, own[1]) if own and own[2] == "audio/wav" else None
                    samples.append(wav[0] if wav else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(types, pa.string()), pa.array(corrected, pa.bool_()), pa.array(parts, part), pa.array(samples, pa.binary())],
                                                 names=["row", "media_type", "corrected", "parts", "samples"])

    return whole.mapInArrow(lambda x: trimmed(run(x)), f"row {kind}, media_type string, corrected boolean, parts array<struct<offset:long,length:long,type:string,sha256:string>>, samples binary")


def _le32(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def wav_of(payload: Column, rate: int = RATE) -> Column:
    """A mono WAV of 8-bit samples whose data is the payload (an even number of bytes below 4 GB)."""
    n = F.octet_length(payload)
    head = "".join(x.hex() for x in (b"WAVE", b"fmt ", (16).to_bytes(4, "little"), (1).to_bytes(2, "little"), (1).to_bytes(2, "little"), rate.to_bytes(4, "little"), rate.to_bytes(4, "little"), (1).to_bytes(2, "little"), (8).to_bytes(2, "little"), b"data"))
    return F.concat(F.lit(b"RIFF"), _le32(n + 36), F.unhex(F.lit(head)), _le32(n), payload)


def text_payload(text: Column, unit: int = 64) -> Column:
    """The text's UTF-8 with bytes 0 up to a positive multiple of unit."""
    b = utf8(text)
    n = F.octet_length(b)
    zeros = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    return F.concat(b, F.unhex(F.repeat(F.lit("00"), zeros)))
