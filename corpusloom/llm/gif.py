"""GIF as a media column: LZW code streams, palettes, disposal and transparency, timed frames.

``decode`` reads any GIF87a/89a stream through the LZW dictionary and composites
every frame: indices through the local or global palette, transparent indices
left out, the canvas then kept, cleared or restored as the frame's disposal
says. ``frames`` stores what is seen as timed frames with a colour-histogram
column.

Payloads are stored losslessly as 8-bit samples in grey: 64 columns, pages of up
to ``ROWS`` rows, one frame a page. Sample 0 is the transparent index and each
frame is cleared after it is shown (disposal 2), so the canvas under it is blank
and a transparent pixel reads as 0; a page that wasn't cleared would shine
through the next. Samples are read back from the composited canvases.

Null text is the empty payload, padded to 64 zero bytes. Long texts take several
frames. Repeated rows each get a row; an empty table gives an empty result; other
columns are ignored. In ``frames`` a null GIF has no frames, and a broken or cut
off one has a row with its whole frames before the fault, then one with ``error``.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import common

WIDTH, ROWS, DELAY = 64, 1024, 10
#: Entries of a full LZW dictionary, the widest code.
ENTRIES, WIDEST = 4096, 12
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3)


@dataclass
class Frame:
    """One composited frame."""

    delay_cs: int
    box: tuple[int, int, int, int]  # left, top, width, height
    indices: np.ndarray  # of its own image, before compositing
    canvas: np.ndarray  # height x width x RGBA, after compositing


@dataclass
class Animation:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)
    loops: int | None = None


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes with their terminator."""
    full = len(data) // 255
    out = np.empty((full, 256), dtype=np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, dtype=np.uint8, count=255 * full).reshape(full, 255)
    rest = data[255 * full :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _widths(count: int, bits: int) -> np.ndarray:
    """Bits of each of ``count`` codes after a reset: every code but the first adds an entry, and codes widen when the entries need it."""
    entries = np.minimum((1 << bits) + 1 + np.arange(count), ENTRIES - 1)
    return np.floor(np.log2(entries)).astype(np.int64) + 1


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths, low bits first."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) - np.repeat(ends - widths, widths)
    return np.packbits((np.repeat(codes, widths) >> place & 1).astype(np.uint8), bitorder="little").tobytes()


def lzw_encode(samples: bytes, bits: int) -> bytes:
    """An LZW stream: the dictionary grows to ENTRIES and is then reset."""
    clear, out = 1 << bits, []
    runs: list[int] = []  # codes between resets
    table: dict[int, int] = {}
    entry, run = clear + 2, -1
    for s in samples:
        if run < 0:
            run = s
            continue
        key = run << 8 | s
        if (longer := table.get(key)) is not None:
            run = longer
            continue
        out.append(run)
        run = s
        if entry < ENTRIES:
            table[key] = entry
            entry += 1
        else:
            runs.append(len(out))
            table, entry = {}, clear + 2
    if run >= 0:
        out.append(run)
    codes, at, flat, widths = np.array(out, dtype=np.int64), 0, [], []
    for stop in [*runs, len(out)]:
        n = stop - at
        own = _widths(n + 1, bits)  # the last is that of the code that follows: a reset or the end
        flat += [codes[at:stop], [clear]]
        widths += [own]
        at = stop
    flat[-1] = [clear + 1]
    return _packed(np.concatenate([[clear], *flat]).astype(np.int64), np.concatenate([[bits + 1], *widths]))


def _codes(data: bytes, at: int, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole codes that stand from bit ``at`` on, with the bits that each ends after."""
    ends = np.cumsum(widths)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=at >> 3, count=min(len(data) - (at >> 3), int(ends[-1] >> 3) + 2)), bitorder="little")[at & 7 :].astype(np.int64)
    ends = ends[: np.searchsorted(ends, len(bits), side="right")]
    if not len(ends):
        return ends, ends
    starts = ends - widths[: len(ends)]
    place = np.arange(int(ends[-1])) - np.repeat(starts, widths[: len(ends)])
    return np.add.reduceat(bits[: int(ends[-1])] << place, starts), ends


def lzw_decode(data: bytes, bits: int, expected: int) -> np.ndarray:
    """The samples of an LZW stream with a minimum code size of ``bits``; ValueError if it is broken or ends before ``expected`` samples.

    The width of a code only depends on how many stand between it and the last
    reset, so they are unpacked side by side; each is then looked up in the
    dictionary, which grows by an entry a code. A full one stays until a reset.
    """
    if not 2 <= bits <= 8:
        raise ValueError("broken LZW stream")
    clear, stop = 1 << bits, (1 << bits) + 1
    fresh = [bytes([i]) for i in range(clear)] + [b"", b""]
    schedule, widest = _widths(ENTRIES, bits), np.full(ENTRIES, WIDEST)
    out, total, at, known = [], 0, 0, 0
    table, last = list(fresh), b""
    while total < expected:
        codes, ends = _codes(data, at, schedule if known == 0 else widest)
        halt = np.flatnonzero((codes == clear) | (codes == stop))
        used = int(halt[0]) if len(halt) else len(codes)
        for code in codes[:used].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("broken LZW stream")
            out.append(entry)
            total += len(entry)
            if last and len(table) < ENTRIES:
                table.append(last + entry[:1])
            last = entry
        if len(halt):
            if codes[used] == stop:
                break
            at, known, table, last = at + int(ends[used]), 0, list(fresh), b""
        elif len(codes) == ENTRIES:
            at, known = at + int(ends[-1]), known + ENTRIES
        else:
            break
    if total < expected:
        raise ValueError("cut off LZW stream")
    return np.frombuffer(b"".join(out)[:expected], dtype=np.uint8)


def encode_payload(payload: bytes) -> bytes:
    """A GIF whose frames hold the payload, whose length is a positive multiple of 64."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY.tobytes()]
    for at in range(0, rows, ROWS):
        height = min(ROWS, rows - at)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2 | 1, DELAY, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, height, 0) + b"\x08")
        out.append(_blocks(lzw_encode(samples[at * WIDTH : (at + height) * WIDTH].tobytes(), 8)))
    out.append(b"\x3b")
    return b"".join(out)


def _unblocked(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) != 0:
        if at + n + 1 >= len(data):
            raise ValueError("cut off GIF")
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    """A colour table as opaque RGBA pixels; indices beyond it are black."""
    n = 2 << (flags & 7)
    out = np.zeros((256, 4), dtype=np.uint8)
    out[:n, :3] = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
    out[:, 3] = 255
    return out.view("<u4").ravel(), at + 3 * n


def decoded(data: bytes, out: Animation) -> Iterator[Frame]:
    """Frames in order, each composited under the disposal of the one before and its own transparency; ValueError at a fault. Size and loops go to ``out``."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        out.width, out.height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
        at = 13
        palette = None
        if flags & 0x80:
            palette, at = _palette(data, at, flags)
        canvas = np.zeros((out.height, out.width), dtype="<u4")
        delay, disposal, clear = 0, 0, None
        while data[at] != 0x3B:
            if data[at] == 0x21:
                kind = data[at + 1]
                body, at = _unblocked(data, at + 2)
                if kind == 0xF9:
                    bits, delay, index = struct.unpack_from("<BHB", body)
                    disposal, clear = bits >> 2 & 7, index if bits & 1 else None
                elif kind == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                    out.loops = struct.unpack_from("<H", body, 12)[0]
                continue
            if data[at] != 0x2C:
                raise ValueError("broken GIF block")
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = palette
            if bits & 0x80:
                colours, at = _palette(data, at, bits)
            if colours is None:
                raise ValueError("a frame without colours")
            size = data[at]
            stream, at = _unblocked(data, at + 1)
            indices = lzw_decode(stream, size, w * h).reshape(h, w)
            if bits & 0x40:  # interlaced: four passes over the rows
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                plain = np.empty_like(indices)
                plain[order] = indices
                indices = plain
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            seen = indices[: part.shape[0], : part.shape[1]]
            part[:] = colours[seen] if clear is None else np.where(seen == clear, part, colours[seen])
            yield Frame(delay, (left, top, w, h), indices, canvas.copy().view(np.uint8).reshape(*canvas.shape, 4))
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("cut off GIF") from e


def decode(data: bytes) -> Animation:
    """All frames of a whole GIF."""
    out = Animation(0, 0)
    out.frames = list(decoded(data, out))
    return out


def colours(frame: Frame) -> np.ndarray:
    """Counts of the colours seen on the frame's canvas, at 4 levels a channel; transparent pixels don't count."""
    seen = np.ascontiguousarray(frame.canvas).view("<u4").ravel()
    seen = seen[seen >> 24 > 0].astype(np.int64)
    return np.bincount((seen >> 6 & 3) << 4 | (seen >> 14 & 3) << 2 | seen >> 22 & 3, minlength=64)


def payload_of(data: bytes) -> tuple[bytes, str]:
    """The stored samples read back from the composited canvases, and the features of the frames: number, time and summed colour histogram as colour:count."""
    parts, total, time, n = [], np.zeros(64, dtype=np.int64), 0, 0
    for f in decoded(data, Animation(0, 0)):
        left, top, w, h = f.box
        parts.append(f.canvas[top : top + h, left : left + w, 0].tobytes())
        total, time, n = total + colours(f), time + f.delay_cs, n + 1
    return b"".join(parts), f"frames={n};cs={time};colours=" + ",".join(f"{k}:{total[k]}" for k in np.flatnonzero(total))


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: ``doc_id``, n_bytes and ``gif``, the stored form of its text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [padded(t.as_py()) for t in b.column("text")]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([encode_payload(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "gif"])

    kept = common.text_of(docs, docs[id_col].alias("doc_id"), text_col=text_col)
    return common.map_rows(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, gif binary")


def frames(gifs: DataFrame, id_col: str = "doc_id", gif_col: str = "gif") -> DataFrame:
    """One row per frame of a GIF column: id, frame, delay_cs, left, top, width, height, the composited RGBA canvas, the colour histogram (4 levels a channel) and ``error``, null but for a row of its own where a GIF is broken."""
    kept = gifs.select(gifs[id_col].alias("id"), gifs[gif_col].alias("gif"))
    names = ["frame", "delay_cs", "left", "top", "width", "height"]
    kind = kept.schema["id"].dataType.simpleString()

    def rows(i: object, g: bytes | None) -> Iterator[tuple]:
        k = 0
        try:
            for f in decoded(g, Animation(0, 0)) if g is not None else ():
                yield i, k, f.delay_cs, *f.box, f.canvas.tobytes(), colours(f).tolist(), None
                k += 1
        except ValueError as e:
            yield i, k, *[None] * 7, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [b.column("id").type, *[pa.int32()] * 6, pa.binary(), pa.list_(pa.int64()), pa.string()]
            found = (r for i, g in zip(b.column("id").to_pylist(), b.column("gif"), strict=True) for r in rows(i, g.as_py()))
            while part := list(itertools.islice(found, 64)):  # canvases are large: few at a time
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], ["id", *names, "canvas", "histogram", "error"])

    return kept.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} int" for n in names) + ", canvas binary, histogram array<long>, error string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a GIF, reads the samples back from it and reports digests of both, in one pass over bounded batches."""
    kept = common.text_of(docs, docs[id_col].alias("doc_id"), text_col=text_col)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column("text"):
            payload, n = padded(t.as_py())
            stored = encode_payload(payload)
            back, feature = payload_of(stored)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.map_rows(kept, run, schema)
