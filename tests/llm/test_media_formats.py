"""A file of each format is found with its length, alone, inside other bytes and inside a stored WAV; a cut one is not."""
import gzip
import io
import os
import struct
import time
import zipfile

import pytest

from sparlink.llm.media_sniff import automaton, found_media


def chunk(kind, data):
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def riff(kind, *chunks):
    body = kind + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind, data):
    return struct.pack(">I", 8 + len(data)) + kind + data


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "some text " * 50)
        z.writestr("b/c.txt", "")
    return out.getvalue()


def ogg_page(flags, data):
    return b"OggS\0" + bytes([flags]) + b"\0" * 20 + bytes([1, len(data)]) + data


WAV_HEAD = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8))
FILES = {
    "image/bmp": b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0",
    "application/pdf": b"%PDF-1.4\n1 0 obj<<>>endobj\nxref\n0 1\ntrailer<<>>\nstartxref\n9\n%%EOF",
    "application/zip": zipped(),
    "application/gzip": gzip.compress(os.urandom(200_000) + b"x" * 3_000_000, mtime=0),
    "application/ogg": ogg_page(2, b"first") + ogg_page(0, b"more") + ogg_page(4, b"last"),
    "video/mp4": box(b"ftyp", b"isom\0\0\2\0isom") + box(b"moov", b"\0" * 20) + box(b"mdat", b"frames"),
    "audio/basic": b".snd" + struct.pack(">IIIII", 24, 6, 1, 8000, 1) + b"sample",
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x44\1\0" + b"\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\1" * 9 + b"\xff\xda" + struct.pack(">H", 8) + b"\1" * 6 + b"coded\xff\0data" + b"\xff\xd9",
    "image/webp": riff(b"WEBP", chunk(b"VP8 ", b"\1" * 11)),
    "video/x-msvideo": riff(b"AVI ", chunk(b"LIST", b"hdrl")),
    "audio/wav": riff(b"WAVE", WAV_HEAD, chunk(b"data", b"\x80" * 9)),
}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_format(kind):
    a, file = automaton(), FILES[kind]
    assert found_media(file, a) == [(0, len(file), kind)]
    assert found_media(b"some bytes " + file + b" and more", a) == [(11, len(file), kind)]
    assert found_media(file[: len(file) - (2 if kind == "audio/wav" else 1)], a) == []


def test_flac_reaches_to_the_end():
    file = b"fLaC\x80" + (34).to_bytes(3, "big") + b"\0" * 34 + b"\xff\xf8frames"
    assert found_media(b"x" + file, automaton()) == [(1, len(file), "audio/flac")]
    assert found_media(file[:30], automaton()) == []


def test_carved_from_inside_a_wav():
    a, inner = automaton(), [FILES["application/pdf"], FILES["application/zip"], FILES["audio/basic"]]
    payload = b"..".join(inner)
    wav = riff(b"WAVE", WAV_HEAD, chunk(b"data", payload + b"\0" * (-len(payload) % 64)))
    at = 44
    want = [(0, len(wav), "audio/wav")]
    for file, kind in zip(inner, ("application/pdf", "application/zip", "audio/basic")):
        want.append((at, len(file), kind))
        at += len(file) + 2
    assert found_media(wav, a) == want


def test_many_false_starts_take_linear_time():
    a = automaton()
    blob = b"PK\x03\x04..PK\x05\x06.................." * 60_000 + b"%PDF-1.4 " * 60_000
    began = time.time()
    assert found_media(blob, a) == []
    assert time.time() - began < 20
