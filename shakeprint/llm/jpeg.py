"""Baseline JPEG: bytes stored as DC-only luminance images, and a decoder that steps through many scans at once."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_chars, rows

#: Samples a row: each becomes a block of 8 x 8 equal pixels. A side has 65,535 pixels at most, so longer payloads take
#: several images, one after another.
WIDTH, MAX_ROWS = 64, 65_535 // 8
BATCH_CHARS = 1_000_000
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xD0
#: Bits of the code of each category of DC difference (0 to 8); text has many differences of 4 and 7 bits.
DC_LENGTHS = {4: 2, 7: 2, 2: 3, 3: 3, 0: 4, 1: 4, 5: 4, 6: 5, 8: 6}
_LANES_LEFT = 0.5


def huffman_segment(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    body = bytes([kind, *counts, *order])
    return struct.pack(">BBH", 0xFF, DHT, 2 + len(body)) + body


def codes(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """(code, bits) of each symbol, in the standard's canonical order."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(counts: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """Of each 16 bits: the bits of the code they begin with, times 256, plus its symbol; 0 if there is none."""
    out = np.zeros(1 << 16, np.int64)
    for s, (code, bits) in codes(list(counts), symbols).items():
        out[code << 16 - bits : code + 1 << 16 - bits] = bits << 8 | s
    return out


@lru_cache
def _dc_symbols() -> tuple[np.ndarray, np.ndarray]:
    """The bits of a whole block (category, difference, end of block) and their number, by difference + 255."""
    order = sorted(DC_LENGTHS, key=lambda s: (DC_LENGTHS[s], s))
    table = codes([sum(n == k for n in DC_LENGTHS.values()) for k in range(1, 17)], bytes(order))
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = table[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255], size[d + 255] = (code << category | extra) << 1, n + category + 1
    return bits, size


@lru_cache
def _fixed_segments() -> bytes:
    return struct.pack(">BBHB", 0xFF, DQT, 67, 0) + bytes([8] * 64) + huffman_segment(0x00, DC_LENGTHS) + huffman_segment(0x10, {0: 1}) + struct.pack(">BBHH", 0xFF, DRI, 4, WIDTH)


def _header(rows: int) -> bytes:
    frame = struct.pack(">BBHBHHBBBB", 0xFF, SOF0, 11, 8, 8 * rows, 8 * WIDTH, 1, 1, 0x11, 0)
    return bytes([0xFF, SOI]) + _fixed_segments() + frame + struct.pack(">BBHBBBBBB", 0xFF, SOS, 8, 1, 1, 0, 0, 63, 0)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as one JPEG, or several joined. Every row of 64 blocks is a
    restart interval, so rows are coded, and later decoded, side by side."""
    if any(not p or len(p) % WIDTH for p in payloads):
        raise ValueError(f"payloads have a positive multiple of {WIDTH} bytes")
    rows = np.array([len(p) // WIDTH for p in payloads], np.int64)
    if not len(rows):
        return []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH).astype(np.int64) - 128
    diffs = np.diff(samples, axis=1, prepend=0)
    bits, size = _dc_symbols()
    value, length = bits[diffs + 255].T, size[diffs + 255].T
    n = len(samples)
    out, at, lane = np.zeros((n, 16 * WIDTH // 8 + 4), np.uint8), np.zeros(n, np.int64), np.arange(n)
    for v, k in zip(np.ascontiguousarray(value), np.ascontiguousarray(length), strict=True):
        window, byte = v << 24 - (at & 7) - k, at >> 3
        out[lane, byte] |= (window >> 16).astype(np.uint8)
        out[lane, byte + 1] |= (window >> 8 & 255).astype(np.uint8)
        out[lane, byte + 2] |= (window & 255).astype(np.uint8)
        at += k
    used = -(-at // 8)
    out[lane, used - 1] |= ((1 << 8 * used - at) - 1).astype(np.uint8)
    # A zero follows each byte 255; a marker follows each row: the next restart, or the image's end.
    flat = out[np.arange(out.shape[1]) < used[:, None]]
    row = np.repeat(lane, used)
    full = flat == 255
    ends = used + np.bincount(row[full], minlength=n)
    repeats = 1 + full
    stuffed, stuffed_row = np.repeat(flat, repeats), np.repeat(row, repeats)
    stuffed[np.cumsum(repeats)[full] - 1] = 0
    joined = np.empty(len(stuffed) + 2 * n, np.uint8)
    joined[np.arange(len(stuffed)) + 2 * stuffed_row] = stuffed
    stop = np.cumsum(ends + 2)
    of_payload = np.arange(n) - np.repeat(np.cumsum(rows) - rows, rows)
    in_image = of_payload % MAX_ROWS
    last = (in_image == MAX_ROWS - 1) | (of_payload == np.repeat(rows, rows) - 1)
    joined[stop - 2], joined[stop - 1] = 255, np.where(last, EOI, RST0 + (in_image & 7))
    data, start = joined.tobytes(), [0, *stop.tolist()]
    images, at_row = [], 0
    for r in rows.tolist():
        parts = []
        for a in range(0, r, MAX_ROWS):
            b = min(r, a + MAX_ROWS)
            parts += [_header(b - a), data[start[at_row + a] : start[at_row + b]]]
        images.append(b"".join(parts))
        at_row += r
    return images


@dataclass
class Component:
    ident: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    """What the markers of one image say, and its scan's bytes as restart intervals."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple[tuple[int, ...], bytes]] = field(default_factory=dict)
    interval: int = 0
    intervals: list[bytes] = field(default_factory=list)

    def layout(self) -> tuple[int, int, list[int]]:
        """MCUs across and down, and the component of each block of one."""
        one = len(self.components) == 1
        across, down = (1, 1) if one else (max(c.across for c in self.components), max(c.down for c in self.components))
        pattern = [0] if one else [k for k, c in enumerate(self.components) for _ in range(c.across * c.down)]
        return -(-self.width // (8 * across)), -(-self.height // (8 * down)), pattern


def parse(data: bytes) -> list[Frame]:
    """The images of baseline JPEGs that stand one after another; ValueError for anything else."""
    frames, at, f = [], 0, None
    while at < len(data):
        if data[at] != 0xFF or at + 2 > len(data):
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == SOI:
            f = Frame()
            continue
        if f is None:
            raise ValueError("no image starts here")
        if marker == EOI:
            frames.append(f)
            f = None
            continue
        if at + 2 > len(data):
            raise ValueError("truncated segment")
        (size,) = struct.unpack_from(">H", data, at)
        body = data[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("truncated segment")
        at += size
        if marker == DQT:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                f.quant[k] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                f.tables[body[0]] = (tuple(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == DRI:
            (f.interval,) = struct.unpack(">H", body)
        elif marker == SOF0:
            depth, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not f.height or not f.width:
                raise ValueError("only 8-bit samples of a stated size")
            f.components = [Component(a, b >> 4, b & 15, q) for a, b, q in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline image")
        elif marker == SOS:
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            if set(chosen) != {c.ident for c in f.components}:
                raise ValueError("only interleaved scans")
            for c in f.components:
                c.dc, c.ac = chosen[c.ident] >> 4, 16 | chosen[c.ident] & 15
            scan = np.frombuffer(data, np.uint8, offset=at)
            marks = np.flatnonzero(scan[:-1] == 255)
            after = scan[marks + 1]
            stops = marks[(after != 0) & ((after < RST0) | (after > RST0 + 7))]
            end = int(stops[0]) if len(stops) else len(scan)
            cuts = marks[(after >= RST0) & (after <= RST0 + 7)]
            cuts = cuts[cuts < end].tolist()
            raw = scan[:end].tobytes()
            f.intervals = [raw[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip([0, *(c + 2 for c in cuts)], [*cuts, end], strict=True)]
            at += end
    if f is not None:
        raise ValueError("the image doesn't end")
    return frames


def decode_scans(frames: list[Frame]) -> list[np.ndarray]:
    """The DC coefficients of every block, in the order of the scan. All restart intervals of all frames are Huffman-
    decoded together: each numpy step takes one symbol of every interval, AC symbols included."""
    lanes, tables, table_at = [], [], {}
    for k, f in enumerate(frames):
        across, down, pattern = f.layout()
        total, per = across * down, f.interval or across * down
        if len(f.intervals) != -(-total // per):
            raise ValueError("missing restart intervals")
        lanes += [(k, min(per, total - per * j) * len(pattern), data) for j, data in enumerate(f.intervals)]
        for c in f.components:
            for t in (c.dc, c.ac):
                if (key := f.tables[t]) not in table_at:
                    table_at[key] = len(tables)
                    tables.append(lookup(*key))
    table = np.concatenate(tables)
    # The frames' block patterns, and the tables of each block, one after another.
    start, dc_of, ac_of, comp_of = {}, [], [], []
    for k, f in enumerate(frames):
        start[k] = len(dc_of)
        for c in f.layout()[2]:
            comp_of.append(c)
            dc_of.append(table_at[f.tables[f.components[c].dc]] << 16)
            ac_of.append(table_at[f.tables[f.components[c].ac]] << 16)
    dc_of, ac_of, comp_of = (np.array(x, np.int64) for x in (dc_of, ac_of, comp_of))
    frame = np.array([k for k, _, _ in lanes], np.int64)
    base = np.array([start[k] for k in range(len(frames))], np.int64)[frame]
    period = np.array([len(f.layout()[2]) for f in frames], np.int64)[frame]
    blocks = np.array([n for _, n, _ in lanes], np.int64)
    size = np.array([len(d) for _, _, d in lanes], np.int64)
    data = np.frombuffer(b"".join(d for _, _, d in lanes) + b"\xff" * 8, np.uint8).astype(np.int64)
    words = data[:-7] << 32 | data[1:-6] << 24 | data[2:-5] << 16 | data[3:-4] << 8 | data[4:-3]  # 40 bits from each byte
    stop = np.cumsum(size) * 8
    bit = stop - size * 8
    first = np.cumsum(blocks) - blocks
    out = np.zeros(int(blocks.sum()), np.int64)
    most = int(comp_of.max()) + 1
    last = np.zeros((len(lanes), most), np.int64)
    lane, done, place = np.arange(len(lanes)), np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    single = most == 1 and int(period.max()) == 1
    while len(lane):
        unit = base if single else base + done % period
        is_dc = place == 0
        window = words[bit >> 3] >> 24 - (bit & 7)
        hit = table[np.where(is_dc, dc_of[unit], ac_of[unit]) + (window & 0xFFFF)]
        n, symbol = hit >> 8, hit & 255
        extra = np.where(is_dc, symbol, symbol & 15)
        value = words[bit + n >> 3] >> 40 - (bit + n & 7) - extra & (1 << extra) - 1
        bit = bit + n + extra
        if (n == 0).any() or (bit > stop).any():
            raise ValueError("the scan is damaged")
        value = np.where((value << 1 >> extra) == 0, value - (1 << extra) + 1, value)
        at = np.flatnonzero(is_dc)
        c = comp_of[unit[at]]
        level = last[at, c] + np.where(extra[at] == 0, 0, value[at])
        last[at, c] = level
        out[first[at] + done[at]] = level
        run = np.where(symbol == 0, 64, (symbol >> 4) + 1)  # the end of the block, or zeros and a coefficient
        place = np.where(is_dc, 1, place + run)
        over = place >= 64
        done = done + over
        place[over] = 0
        alive = done < blocks
        if not alive.all():
            lane, done, place, bit, stop, first, blocks, base, period = (x[alive] for x in (lane, done, place, bit, stop, first, blocks, base, period))
            last = last[alive]
    total = np.bincount(frame, np.array([n for _, n, _ in lanes]), len(frames)).astype(np.int64)
    ends = np.cumsum(total)
    return [out[a:b] for a, b in zip((ends - total).tolist(), ends.tolist(), strict=True)]


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """One luminance sample a block of each image: its mean, from the DC coefficient alone."""
    out = []
    for f, levels in zip(frames, decode_scans(frames) if frames else [], strict=True):
        across, down, pattern = f.layout()
        c = f.components[0]
        h, v = (1, 1) if len(f.components) == 1 else (c.across, c.down)
        luma = levels.reshape(down, across, len(pattern))[:, :, : h * v].reshape(down, across, v, h)
        grid = luma.transpose(0, 2, 1, 3).reshape(down * v, across * h)
        top = -(-f.height * v // (8 * (1 if len(f.components) == 1 else max(x.down for x in f.components))))
        wide = -(-f.width * h // (8 * (1 if len(f.components) == 1 else max(x.across for x in f.components))))
        out.append(np.clip((grid[:top, :wide] * f.quant[c.quant] + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 mean cells is brighter than its right neighbour."""
    rows, cols = (np.linspace(0, n, k + 1).astype(np.int64) for n, k in zip(image.shape, (8, 9), strict=True))
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    sums[1:, 1:] = image.astype(float).cumsum(0).cumsum(1)
    a, b, c, d = rows[:-1], np.maximum(rows[1:], np.minimum(rows[:-1] + 1, image.shape[0])), cols[:-1], np.maximum(cols[1:], np.minimum(cols[:-1] + 1, image.shape[1]))
    a, c = np.minimum(a, image.shape[0] - 1), np.minimum(c, image.shape[1] - 1)
    total = sums[b][:, d] - sums[a][:, d] - sums[b][:, c] + sums[a][:, c]
    mean = total / ((b - a)[:, None] * (d - c))
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each row's text as JPEG, reads it back and describes it: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature (width x height : hash of the thumbnail), with keep_media `media`.

    The payload is the text's UTF-8 bytes with zeros up to a positive multiple of 64. Null text counts as empty, which
    is 64 zeros. Equal texts give equal values; repeated rows and null ids are kept; an empty table gives no rows.
    Partitions stream their own rows; nothing is shuffled. Other columns are not read.
    """
    columns = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    columns += [("media", T.BinaryType())] * keep_media
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, t) for n, t in columns)])
    types = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}

    def run(batches):
        for batch in batches:
            for some in by_chars(rows(batch), BATCH_CHARS):
                told = describe([t for _, t in some], keep_media)
                arrays = [pa.array([i for i, _ in some], batch.schema.field(0).type)]
                arrays += [pa.array(list(c), types[t]) for c, (_, t) in zip(zip(*told, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def describe(texts: list[str | None], keep_media: bool = False) -> list[tuple]:
    stored = encode([padded(t) for t in texts])
    parsed = [parse(x) for x in stored]
    seen = iter(thumbnails([f for fs in parsed for f in fs]))
    out = []
    for text, image, frames in zip(texts, stored, parsed, strict=True):
        parts = [next(seen) for _ in frames]
        payload = b"".join(p.tobytes() for p in parts)
        whole = np.concatenate(parts)
        feature = f"{frames[0].width}x{sum(f.height for f in frames)}:{difference_hash(whole)}"
        n = len((text or "").encode())
        out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature, *([image] * keep_media)))
    return out
