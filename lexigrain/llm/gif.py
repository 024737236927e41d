"""GIF columns: timed frames with colour histograms, and a lossless store for bytes.

``decode`` reads a whole file: code streams (LZW with clear codes, growing widths and a table that may
stay full), global and local palettes, interlacing, transparency and the disposal of each frame.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import id_and_text, keep

FULL = 4096


@functools.cache
def width_plan(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, and the sums up to and with each: more codes than fill the table."""
    reached = (1 << depth) + 1 + np.arange(2 * FULL)
    reached[0] -= 1
    plan = np.clip(np.floor(np.log2(reached)).astype(np.int64) + 1, depth + 1, 12)
    return plan, np.cumsum(plan)


def lzw_encode(data: bytes) -> bytes:
    """An 8-bit code stream; a clear code whenever the table is full."""
    codes, widths, segment, table, code = [np.array([256])], [np.array([9])], [], {}, 258

    def close(end: int) -> None:
        codes.append(np.array([*segment, end]))
        widths.append(width_plan(8)[0][: len(segment) + 1])

    if data:
        append, get = segment.append, table.get
        high = (np.frombuffer(data, np.uint8).astype(np.int64) << 12).tolist()  # a key is a byte above a code
        last = data[0]
        for byte in high[1:]:
            key = byte | last
            if (known := get(key)) is not None:
                last = known
                continue
            append(last)
            table[key] = code
            code += 1
            last = byte >> 12
            if code == FULL:
                close(256)
                segment.clear()
                table.clear()
                code = 258
        append(last)
    close(257)
    value, bits = np.concatenate(codes), np.concatenate(widths)
    at = np.cumsum(bits) - bits
    out = np.zeros((int(at[-1] + bits[-1]) + 7) // 8 + 3, np.uint8)
    value = value << (at & 7)
    for k in range(3):
        np.bitwise_or.at(out, (at >> 3) + k, ((value >> 8 * k) & 255).astype(np.uint8))
    return out[: (int(at[-1] + bits[-1]) + 7) // 8].tobytes()


def lzw_decode(stream: bytes, depth: int, most: int) -> bytes:
    """The first ``most`` samples of a code stream of any depth; a stream that breaks off ends early."""
    clear, end = 1 << depth, (1 << depth) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    n_bits, at, out, got = len(stream) * 8, 0, [], 0
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    plan, ends = width_plan(depth)
    table, last, reached = list(base), b"", 0
    put = out.append
    while at < n_bits and got < most:
        room = (n_bits - at) // (depth + 1) + 1
        if reached:
            bits, offsets = np.full(min(room, FULL), 12, np.int64), at + 12 * np.arange(min(room, FULL))
        else:
            bits, offsets = plan[:room], at + ends[:room] - plan[:room]
        fits = int(np.searchsorted(offsets + bits, n_bits, "right"))
        if not fits:
            break
        offsets, bits = offsets[:fits], bits[:fits]
        byte = offsets >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offsets & 7)) & ((1 << bits) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else fits
        todo = codes[:stop].tolist()
        if todo and not last:
            if todo[0] >= clear:
                raise ValueError("a code before its entry")
            last = table[todo[0]]
            put(last)
            got += 1
            del todo[0]
        growing, add = FULL - len(table), table.append
        for code in todo[:growing]:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("a code before its entry")
            add(last + entry[:1])
            put(entry)
            last = entry
        for code in todo[growing:]:
            last = table[code]
            put(last)
        got += sum(map(len, out[-len(todo) :])) if todo else 0
        if not len(stops):
            if fits < len(plan) and not reached:
                break
            at, reached = int(offsets[-1] + bits[-1]), 1
            continue
        at = int(offsets[stop] + bits[stop])
        if codes[stop] == end:
            break
        table, last, reached = list(base), b"", 0
    return b"".join(out)[:most]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: bytes
    canvas: np.ndarray  #: height x width x 4, what the viewer sees while the frame shows


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Joined sub-blocks, and the place after their end."""
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def palette_of(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n


def opaque(colours: np.ndarray) -> np.ndarray:
    return np.column_stack([colours, np.full(len(colours), 255, np.uint8)])


#: Pixels of the largest screen or frame that is decoded: a header of a few bytes can name 65,535 x 65,535.
MAX_PIXELS = 1 << 25


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> list[Frame]:
    """All frames in order, see ``frames_of``."""
    return list(frames_of(data, max_pixels))


def frames_of(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """The frames one by one, so that an animation takes the memory of a few. ValueError, IndexError or
    struct.error if it isn't a GIF, ValueError if the screen or a frame has over ``max_pixels`` pixels."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    wide, high, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    shared, at = palette_of(data, 13, flags)
    if wide * high > max_pixels:
        raise ValueError("the screen is too large")
    canvas, control = np.zeros((high, wide, 4), np.uint8), (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label, (body, at) = data[at + 1], blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8), body[3] if body[0] & 1 else None)
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, width, height, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        if width * height > max_pixels:
            raise ValueError("a frame is too large")
        own, at = palette_of(data, at + 10, flags)
        depth, (stream, at) = data[at], blocks(data, at + 1)
        indices = lzw_decode(stream, depth, width * height)
        grid = np.frombuffer(indices.ljust(width * height, b"\0"), np.uint8).reshape(height, width)
        if flags & 0x40:
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, height, step)]
            straight = np.empty_like(grid)
            straight[order] = grid
            grid = straight
        disposal, delay, transparent = control
        colours = own if own is not None else shared
        if colours is None:
            colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        before = canvas.copy() if disposal == 3 else None
        place = canvas[top : top + height, left : left + width]
        seen = grid[: place.shape[0], : place.shape[1]]
        drawn = opaque(colours)[np.minimum(seen, len(colours) - 1)]
        if transparent is None:
            place[:] = drawn
        else:
            np.copyto(place, drawn, where=(seen != transparent)[..., None])
        yield Frame(left, top, width, height, delay, disposal, transparent, grid.tobytes(), canvas.copy())
        if disposal == 2:
            place[:] = 0
        elif disposal == 3:
            canvas = before
        control = (0, 0, None)


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels by two bits of red, green and blue each: 64 counts."""
    seen, alpha = canvas.reshape(-1, 4) >> 6, canvas[..., 3].ravel()
    high = seen[:, 0] << 4 | seen[:, 1] << 2 | seen[:, 2]
    return np.bincount(high if alpha.all() else high[alpha > 0], minlength=64)


@functools.cache
def palette332() -> bytes:
    """256 colours by rule: three bits of red, three of green, two of blue."""
    return bytes(x for k in range(256) for x in ((k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 255 // 3))


def store(payload: bytes, width: int = 192, frame_rows: int = 128, delay: int = 10) -> bytes:
    """Bytes, a positive multiple of ``width``, as the samples of an animation; the same bytes give the same file."""
    step = width * frame_rows
    parts = [payload[k : k + step] for k in range(0, len(payload), step)]
    out = [b"GIF89a", struct.pack("<HHBBB", width, len(parts[0]) // width, 0xF7, 0, 0), palette332()]
    for part in parts:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        stream = lzw_encode(part)
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


FRAMES = "id long, frame long, left long, top long, width long, height long, delay_ms long, disposal long, transparent long, histogram array<long>, error string"


def frames(df: DataFrame, id_col: str, media_col: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row per frame of the GIFs in ``media_col``, with its time and the 64 counts of its colours.

    A null, empty or broken file gives one row with ``error`` and nulls after the frames before the fault,
    as does one with a screen or frame of over ``max_pixels`` pixels; a file without frames, none. Rows
    repeated with one identifier give their frames each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FRAMES.split(", ")]
        for batch in batches:
            rows = []
            for ident, media in zip(batch.column("id").to_pylist(), batch.column("media"), strict=True):
                try:
                    for k, f in enumerate(frames_of(media.as_py() or b"", max_pixels)):
                        rows.append((ident, k, f.left, f.top, f.width, f.height, f.delay_ms, f.disposal, f.transparent, histogram(f.canvas).tolist(), None))
                except (ValueError, IndexError, struct.error) as problem:
                    rows.append((ident, *[None] * 9, str(problem)))
            types = [*[pa.int64()] * 9, pa.list_(pa.int64()), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, FRAMES)


def padded(text: bytes, unit: int = 192) -> bytes:
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b" ")


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
        made: dict[bytes, bytes] = {}
        for t in texts:
            if t not in made:
                made[t] = store(padded(t))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([made[t] for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, known = [], {}
        for ident, n, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            media = media.as_py()
            digest = hashlib.sha256(media).hexdigest()
            if digest not in known:
                shown = [(f.indices, f.delay_ms, histogram(f.canvas)) for f in frames_of(media)]
                payload = b"".join(samples for samples, _, _ in shown)
                counts = sum((colours for _, _, colours in shown), np.zeros(64, np.int64))
                feature = f"frames={len(shown)} ms={sum(ms for _, ms, _ in shown)} colours=" + ",".join(f"{k}:{n}" for k, n in enumerate(counts.tolist()) if n)
                known[digest] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), digest, feature)
            rows.append((ident, n, *known[digest]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in READ.split(", ")])


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a GIF in the shared folder, reads the table back and describes it.

    Null texts count as empty (192 spaces); a null identifier is kept; rows repeated with one identifier
    give a row each; an empty table gives no rows; long texts become animations of as many frames as they
    need.
    """
    media = keep(id_and_text(df, id_col, text_col).mapInArrow(stored, "doc_id long, n_bytes long, media binary"))
    return media.mapInArrow(read_back, READ)
