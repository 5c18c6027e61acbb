"""GIF as a media column: code streams decoded, palettes, disposal and transparency applied, frames stored with their times and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches, spread

#: Codes have at most so many bits.
MAX_BITS = 12
#: Codes of a full table that are read ahead at once.
GO_ON = 1 << 14
#: Payload frames: samples in a row, and rows of a frame at most.
WIDTH, ROWS = 64, 1024
#: Bins of a colour histogram for each channel.
BINS = 4
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


class GifError(ValueError):
    """The bytes are no readable GIF."""


@dataclass
class Frame:
    """An image of the file: its place, samples (indices) and what to do with it."""

    left: int
    top: int
    width: int
    height: int
    samples: bytes
    palette: np.ndarray
    delay_ms: int = 0
    disposal: int = 0
    transparent: int = -1


@cache
def _widths(depth: int) -> np.ndarray:
    """Bits of the m-th code after a clear code (m from 0), until the table is full; then it stays."""
    m = np.arange(1, (1 << MAX_BITS) + 2)
    return np.minimum(np.ceil(np.log2((1 << depth) + m + 1)).astype(np.int64), MAX_BITS)


def lzw_encode(samples: bytes, depth: int = 8) -> bytes:
    """The code stream of samples below 2 ** depth; it starts with a clear code, and a full table is cleared."""
    clear, full = 1 << depth, 1 << MAX_BITS
    parts: list[np.ndarray] = [np.array([clear])]
    sizes: list[np.ndarray] = [np.array([depth + 1])]
    widths = _widths(depth)

    def flush(codes: list[int], end: int) -> None:
        codes.append(end)
        parts.append(np.array(codes))
        sizes.append(widths[: len(codes)])

    table: dict[int, int] = {}
    get, codes, free = table.get, [], clear + 2
    emit = codes.append
    stream = iter(samples)
    prefix = next(stream, None)
    for b in stream:
        key = prefix << 8 | b
        known = get(key)
        if known is not None:
            prefix = known
            continue
        emit(prefix)
        prefix = b
        table[key] = free
        free += 1
        if free == full:
            flush(codes, clear)
            table.clear()
            codes, free = [], clear + 2
            emit = codes.append
    if prefix is not None:
        emit(prefix)
    flush(codes, clear + 1)
    values, bits = np.concatenate(parts).astype(np.uint16), np.concatenate(sizes)
    places = np.arange(MAX_BITS, dtype=np.uint16)
    grid = (values[:, None] >> places & 1).astype(np.uint8)
    return np.packbits(grid[places < bits[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, depth: int, wanted: int) -> bytes:
    """The first wanted samples of a code stream; an early end or a code that can't be is a GifError."""
    if not 1 <= depth <= 8:
        raise GifError(f"code size {depth}")
    clear, full = 1 << depth, 1 << MAX_BITS
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at, out, have = 8 * len(stream), 0, [], 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    widths = _widths(depth)
    ends = np.cumsum(widths)
    while have < wanted:
        # Bit places are known up to the next clear code: read ahead, and stop at it.
        starts = at + np.concatenate([[0], ends[:-1]])
        sizes = widths
        fits = int(np.searchsorted(at + ends, total, "right"))
        starts, sizes = starts[:fits], sizes[:fits]
        byte = starts >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (starts & 7).astype(np.uint32)) & ((1 << sizes) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        last = int(stop[0]) if len(stop) else fits
        table = roots.copy()
        add = table.append
        prev = b""
        size = clear + 2
        run = codes[:last].tolist()
        if run:
            if run[0] >= clear:
                raise GifError("the first code is no sample")
            prev = table[run[0]]
            out.append(prev)
            have += len(prev)
            for c in run[1:]:
                if c < size:
                    word = table[c]
                elif c == size and size < full:
                    word = prev + prev[:1]
                else:
                    raise GifError(f"code {c} of {size}")
                if size < full:
                    add(prev + word[:1])
                    size += 1
                out.append(word)
                have += len(word)
                prev = word
        if not len(stop) and fits == len(widths):
            # A full table that isn't cleared: the codes go on with the same table, to a clear code if one comes later.
            at, more, cleared = _go_on(data, int(at + ends[-1]), total, table, out, clear, wanted - have)
            have += more
            if cleared:
                continue
            break
        if not len(stop) or codes[last] == clear + 1:
            break
        at = int(at + ends[last])
    if have < wanted:
        raise GifError("the code stream ends early")
    return b"".join(out)[:wanted]


def _go_on(data: np.ndarray, at: int, total: int, table: list[bytes], out: list[bytes], clear: int, wanted: int) -> tuple[int, int, bool]:
    """Decodes codes of a full table up to a clear or end code, or to wanted samples: the next bit place, the number of samples, whether a clear code came."""
    have = 0
    while have < wanted:
        starts = np.arange(at, min(total - MAX_BITS + 1, at + GO_ON * MAX_BITS), MAX_BITS)
        byte = starts >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (starts & 7).astype(np.uint32)) & 0xFFF
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        last = int(stop[0]) if len(stop) else len(codes)
        words = [table[c] for c in codes[:last].tolist()]
        out += words
        have += sum(map(len, words))
        if len(stop):
            return at + (last + 1) * MAX_BITS, have, int(codes[last]) == clear
        if not len(codes):
            break
        at += len(codes) * MAX_BITS
    return at, have, False


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(width: int, height: int, palette: np.ndarray, frames: list[Frame]) -> bytes:
    """A GIF89a with one palette of 2, 4, ... 256 colours (n, 3: uint8) and the frames' samples."""
    depth = max(1, (len(palette) - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | depth - 1, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent >= 0), f.delay_ms // 10, max(0, f.transparent)) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0) + bytes([max(2, depth)]) + _blocks(lzw_encode(f.samples, max(2, depth))))
    return b"".join([*out, b"\x3b"])


#: Pixels of a canvas or a frame from which a file is an error: its size is a claim of a few bytes, the memory for it isn't.
MOST_PIXELS = 1 << 25


def read_gif(data: bytes, most: int = MOST_PIXELS) -> tuple[int, int, list[Frame]]:
    """Width, height and frames; a file that breaks off, isn't a GIF or has more than most pixels in an image is a GifError."""
    width, height, frames = open_gif(data, most)
    return width, height, list(frames)


def open_gif(data: bytes, most: int = MOST_PIXELS) -> tuple[int, int, Iterator[Frame]]:
    """As read_gif, but each frame is decoded when it is asked for."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF")
    if len(data) < 13:
        raise GifError("the file breaks off")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most:
        raise GifError(f"{width} x {height} are more than {most} pixels")

    def frames() -> Iterator[Frame]:
        try:
            yield from _frames(data, flags, most)
        except (IndexError, struct.error) as e:
            raise GifError("the file breaks off") from e

    return width, height, frames()


def _frames(data: bytes, flags: int, most: int) -> Iterator[Frame]:
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 * (2 << (flags & 7))
        if at + n > len(data):
            raise GifError("the file breaks off")
        at += n
        return np.frombuffer(data[at - n : at], np.uint8).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        got = []
        while n := data[at]:
            got.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(got)

    common = palette(flags) if flags & 0x80 else np.zeros((0, 3), np.uint8)
    delay, disposal, transparent = 0, 0, -1
    while data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            ext = blocks()
            if label == 0xF9 and len(ext) >= 4:
                bits, hundredths, index = struct.unpack_from("<BHB", ext)
                delay, disposal, transparent = 10 * hundredths, bits >> 2 & 7, index if bits & 1 else -1
        elif kind == 0x2C:
            x, y, w, h, bits = struct.unpack_from("<HHHHB", data, at)
            at += 9
            if w * h > most:
                raise GifError(f"a frame of {w} x {h} has more than {most} pixels")
            own = palette(bits) if bits & 0x80 else common
            depth, at = data[at], at + 1
            samples = lzw_decode(blocks(), depth, w * h)
            if bits & 0x40:
                rows = np.frombuffer(samples, np.uint8).reshape(h, w)
                order = np.concatenate([np.arange(a, h, s) for a, s in PASSES])
                straight = np.empty_like(rows)
                straight[order] = rows
                samples = straight.tobytes()
            yield Frame(x, y, w, h, samples, own, delay, disposal, transparent)
            delay, disposal, transparent = 0, 0, -1
        else:
            raise GifError(f"block {kind:#x}")


def composed(width: int, height: int, frames: Iterable[Frame]) -> Iterator[np.ndarray]:
    """The canvas as each frame shows it."""
    return (canvas for _, canvas in played(width, height, frames))


def played(width: int, height: int, frames: Iterable[Frame]) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with the canvas (height, width, 4: uint8) as it shows it; disposal 2 clears the frame's place, 3 brings back what was before."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        place = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        index = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)[: place.shape[0], : place.shape[1]]
        table = np.zeros((256, 4), np.uint8)
        table[: len(f.palette), :3] = f.palette
        table[:, 3] = 255
        if f.transparent >= 0:
            shown = index != f.transparent
            place[shown] = table[index[shown]]
        else:
            place[...] = table[index]
        yield f, canvas
        if f.disposal == 2:
            place[...] = 0
        elif before is not None:
            canvas = before


def colour_histogram(canvas: np.ndarray) -> list[int]:
    """Counts of the visible pixels by BINS bins of red, green and blue, red slowest."""
    q = canvas[..., :3] >> 6
    cell = (q[..., 0].astype(np.int64) * BINS + q[..., 1]) * BINS + q[..., 2]
    return np.bincount(cell[canvas[..., 3] > 0], minlength=BINS**3).tolist()


FRAMES_DDL = "frame int, start_ms long, delay_ms long, width int, height int, rgba binary, histogram array<long>, error string"


def decode_column(df: DataFrame, id_col: str, media_col: str, most: int = MOST_PIXELS) -> DataFrame:
    """A row for each frame of each GIF: id_col, frame (from 0), start_ms, delay_ms, width, height, rgba, histogram, error.

    Null media gives no row; bytes that can't be read, and images of more than most pixels, give one row with frame -1 and the error; a GIF without images gives
    none. Repeated rows are decoded each. Frames are decoded one by one, once to see that all can be and once to be shown, so a long GIF needs one canvas and one frame of memory.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[id_col].dataType)
    schema = pa.schema([pa.field(id_col, kind), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])

    def rows(key: object, media: bytes) -> Iterator[tuple]:
        try:
            for _ in open_gif(media, most)[2]:  # a faulty file has no frames, and none is kept to find that out
                pass
        except Exception as e:  # a file's fault is its own, whatever it is
            yield key, -1, None, None, None, None, None, None, str(e) or type(e).__name__
            return
        start = 0
        width, height, frames = open_gif(media, most)
        for k, (f, canvas) in enumerate(played(width, height, frames)):
            yield key, k, start, f.delay_ms, width, height, canvas.tobytes(), colour_histogram(canvas), None
            start += f.delay_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for key, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in rows(key, media) if media is not None else ():
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    small_batches(df.sparkSession)
    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, {FRAMES_DDL}")


@cache
def _grey() -> np.ndarray:
    return np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def pack(payload: bytes) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as grey samples of timed frames."""
    frames = []
    for a in range(0, len(payload), WIDTH * ROWS):
        part = payload[a : a + WIDTH * ROWS]
        frames.append(Frame(0, 0, WIDTH, len(part) // WIDTH, part, _grey(), delay_ms=100))
    return write_gif(WIDTH, min(ROWS, len(payload) // WIDTH), _grey(), frames)


def unpack(media: bytes) -> tuple[bytes, str]:
    """The payload again, from the palette's colours of the frames, and a feature: size, frames, time and the colour histogram of all frames as shown."""
    width, height, frames = read_gif(media)
    payload, total = [], np.zeros(BINS**3, np.int64)
    for f, canvas in played(width, height, frames):
        payload.append(canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
        total += np.array(colour_histogram(canvas))
    greys = total.reshape(BINS, BINS, BINS)[tuple([np.arange(BINS)] * 3)]
    return b"".join(payload), f"{width}x{height} frames={len(frames)} ms={sum(f.delay_ms for f in frames)} grey={','.join(map(str, greys))}"


def stored_texts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each text of docs (id_col, text) stored as a GIF and read back; the columns are those of STORED.

    A null text counts as empty and is stored as 64 zero samples; equal texts have equal values; repeated rows
    are stored each; an empty table gives an empty one. A text of any length is stored whole, in as many frames as it takes. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([pa.field(id_col, to_arrow_type(docs.schema[id_col].dataType)), *STORED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column(1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                media = pack(raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH))
                back, feature = unpack(media)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STORED, strict=True)] if rows else [pa.array([], f.type) for f in STORED]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema=schema)

    return spread(docs.select(id_col, "text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


STORED = [pa.field("n_bytes", pa.int64()), pa.field("payload_bytes", pa.int64()), pa.field("payload_sha256", pa.string()), pa.field("tail_crc32", pa.int64()), pa.field("media_bytes", pa.int64()), pa.field("media_sha256", pa.string()), pa.field("feature", pa.string())]
