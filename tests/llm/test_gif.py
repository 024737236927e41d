import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrain.llm.gif import decode, frames, histogram, lzw_decode, lzw_encode, palette332, store, text_media


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3_000))
def test_codes_round_trip(data):
    assert lzw_decode(lzw_encode(data), 8, len(data)) == data


@pytest.mark.parametrize("data", [b"a" * 400_000, random.Random(1).randbytes(60_000), bytes(range(256)) * 300])
def test_long_codes(data):
    assert lzw_decode(lzw_encode(data), 8, len(data)) == data


def bits(codes):
    """Codes of given widths as bytes, least bit first."""
    value = at = 0
    for code, width in codes:
        value |= code << at
        at += width
    return value.to_bytes((at + 7) // 8, "little")


def test_known_stream():
    # the classic ten by ten example's first codes: clear, then runs of colours 1 and 2
    codes = [(4, 3), (1, 3), (6, 3), (6, 3), (2, 4), (9, 4), (9, 4), (5, 4)]
    assert lzw_decode(bits(codes), 2, 99) == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2])


def gif(parts, width=2, height=2, flags=0x80, palette=b"\0\0\0\xff\0\0"):
    return b"GIF89a" + struct.pack("<HHBBB", width, height, flags, 0, 0) + palette + b"".join(parts) + b";"


def frame(pixels, left=0, top=0, width=2, height=2, disposal=0, transparent=None, delay=5, interlaced=False, local=b""):
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
    data = bits([(4, 3), *(c for p in pixels for c in ((p, 3), (4, 3))), (5, 3)])
    flags = (0x40 if interlaced else 0) | (0x80 if local else 0)
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, width, height, flags) + local + b"\x02" + bytes([len(data)]) + data + b"\0"


def test_disposal_and_transparency():
    full, dot = [1, 1, 1, 1], lambda **o: frame([0], 1, 1, 1, 1, **o)
    shown = decode(gif([frame(full), dot(disposal=2), dot(disposal=3, transparent=0), dot(), frame([0, 0, 1, 1], transparent=0)]))
    red, black, clear = [255, 0, 0, 255], [0, 0, 0, 255], [0, 0, 0, 0]
    corner = [f.canvas[1, 1].tolist() for f in shown]
    assert corner == [red, black, clear, black, red]
    assert [f.delay_ms for f in shown] == [50] * 5
    assert histogram(shown[2].canvas).sum() == 3


def test_interlacing_and_local_palette():
    rows = decode(gif([frame([k % 2 for k in range(9)], width=1, height=9, interlaced=True, local=b"\1\2\3\4\5\6")], 1, 9))[0]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    assert [rows.indices[r] for r in order] == [k % 2 for k in range(9)]
    assert rows.canvas[8, 0].tolist() == [4, 5, 6, 255]


@pytest.mark.parametrize("n", [192, 192 * 128, 192 * 129, 192 * 1_000])
def test_store(n):
    data = random.Random(n).randbytes(n)
    assert b"".join(f.indices for f in decode(store(data))) == data and store(data) == store(data)
    assert len(palette332()) == 768 and len(set(zip(*[iter(palette332())] * 3, strict=True))) == 256


def test_texts(spark):
    texts = [None, "", "x" * 192, "x" * 193, "é" * 50_000, "same", "same"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "n", "clash")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in text_media(df).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(store(payload)), hashlib.sha256(store(payload)).hexdigest())
    assert got[5][1:] == got[6][1:] and got[None].n_bytes == 1
    assert text_media(df.limit(0)).collect() == []


def test_frames(spark):
    df = spark.createDataFrame([(1, gif([frame([0, 1, 1, 1]), frame([1, 1, 1, 1], delay=0)])), (2, b"no"), (3, None), (4, gif([]))], "id long, media binary")
    rows = frames(df, "id", "media").collect()
    assert [(r.id, r.frame, r.delay_ms) for r in rows] == [(1, 0, 50), (1, 1, 0), (2, None, None), (3, None, None)]
    assert rows[0].histogram[48] == 3 and rows[0].histogram[0] == 1 and rows[2].error
    assert np.array(rows[1].histogram).sum() == 4


def test_hostile_sizes(spark):
    huge = gif([frame([1, 1, 1, 1])], 20_000, 20_000)
    tall = gif([frame([0, 1, 1, 1]), frame([1], width=65_535, height=65_535)])
    df = spark.createDataFrame([(1, huge), (2, tall), (2, tall), (3, gif([frame([1])] * 3, 9, 9))], "id long, media binary")
    rows = sorted(((r.id, r.frame, r.error) for r in frames(df, "id", "media").collect()), key=repr)
    assert rows[0] == (1, None, "the screen is too large")
    assert rows[1:5] == [(2, 0, None), (2, 0, None), (2, None, "a frame is too large"), (2, None, "a frame is too large")]
    assert [r[:2] for r in rows[5:]] == [(3, 0), (3, 1), (3, 2)]
    assert [r.error for r in frames(df.where("id = 3"), "id", "media", max_pixels=80).collect()] == ["the screen is too large"]


def test_repeated_identifiers(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert sorted(r.payload_sha256 for r in text_media(df).collect()) == sorted(hashlib.sha256(t.ljust(192).encode()).hexdigest() for t in "abb")
