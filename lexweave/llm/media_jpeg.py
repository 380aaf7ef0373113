"""Media columns: baseline JPEG written and read with numpy.

``encode_payloads`` stores bytes losslessly as quantised coefficients (the format's unit): every byte is a coefficient
from +-1 to +-128, frequent bytes of text near zero, 192 to a unit of three 8x8 blocks, a restart marker behind each.
``decode_scans`` reads any baseline JPEG: it parses the markers, splits the scan at its restart markers and
Huffman-decodes all intervals of a batch of images in lockstep, one numpy step for a symbol of each.  Scans without
restart markers are one interval and decode right, but slowly.  ``dc_thumbnail`` builds the luminance thumbnail from
the DC coefficients alone, one pixel for each block.

Of files with a scan for each component, the luminance scan is read.

Defined results: a null text is the empty text, whose payload is 192 spaces; equal texts have equal media and
features; an empty table gives an empty result; other columns are not read, whatever their names.  A media value that
this module did not write has dimensions and a thumbnail hash but no payload; one that is no baseline JPEG has neither,
and the reason stands in ``error``; a null value has nulls throughout.  No row ends the job: the functions that take
single files raise ``JpegError``, the DataFrame ones do not.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import bounded_batches, new_folder, quoted, text_bytes

UNIT = 192
SIDE = 65535 // 8
#: Bytes of text by falling frequency; all others follow in ascending order.
_FREQUENT = b" etnahsoirdlu,.c\xc3fm|p\xa9\nwgb%#*&$vyTI\xa8zEqj"
_RANKED = np.frombuffer(bytes([*_FREQUENT, *sorted(set(range(256)) - set(_FREQUENT))]), np.uint8)
#: Lengths of the codes for sizes 1 to 8 of a coefficient, as for run 0 in the AC table.
_CODE_LENGTHS = (2, 2, 2, 3, 4, 5, 6, 7)


class JpegError(ValueError):
    pass


def canonical_codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a DHT segment's counts and symbols."""
    out, code, i = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[i], code, length))
            code += 1
            i += 1
        code <<= 1
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    counts = [_CODE_LENGTHS.count(i) for i in range(1, 17)]
    codes = {s: (c, n) for s, c, n in canonical_codes(counts, list(range(1, 9)))}
    value, bits, length = np.zeros(256, np.int16), np.zeros(256, np.int64), np.zeros(256, np.int64)
    for rank, byte in enumerate(_RANKED):
        magnitude, negative = rank // 2 + 1, rank % 2
        size = magnitude.bit_length()
        code, n = codes[size]
        value[byte] = -magnitude if negative else magnitude
        bits[byte] = code << size | (((1 << size) - 1) ^ magnitude if negative else magnitude)
        length[byte] = n + size
    back = np.zeros(257, np.uint8)
    back[value + 128] = np.arange(256)
    dht = bytes(counts) + bytes(range(1, 9))
    return value, bits, length, back, dht


_VALUE, _BITS, _LENGTH, _BACK, _DHT = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def padded(data: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload, whose length must be a positive multiple of 192."""
    if not payloads:
        return []
    shapes, filled = [], []
    for p in payloads:
        units = len(p) // UNIT
        if units * UNIT != len(p) or not units:
            raise ValueError("a payload must be a positive multiple of 192 bytes")
        high = -(-units // SIDE)
        wide = -(-units // high)
        if high > SIDE:
            raise ValueError("the payload is larger than a JPEG can hold")
        shapes.append((wide, high))
        filled.append(p + b" " * (UNIT * (wide * high - units)))
    data = np.frombuffer(b"".join(filled), np.uint8).reshape(-1, UNIT)
    lengths = _LENGTH[data]
    ends = np.cumsum(lengths, axis=1)
    size = (ends[:, -1] + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    at = (ends - lengths + start[:-1, None] * 8).ravel()
    word = (_BITS[data] << (24 - lengths)).ravel() >> (at & 7)
    at >>= 3
    total = int(start[-1])
    scan = np.bincount(at, word >> 16, total + 2) + np.bincount(at + 1, word >> 8 & 255, total + 2) + np.bincount(at + 2, word & 255, total + 2)
    scan = scan[:total].astype(np.uint8)
    scan[start[1:] - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)  # the rest of a unit's last byte is ones
    full = scan == 255
    unit_of = np.repeat(np.arange(len(size)), size)
    target = np.arange(total) + np.cumsum(full) - full + 2 * unit_of
    out = np.zeros(total + int(full.sum()) + 2 * len(size), np.uint8)
    out[target] = scan
    stuffed = np.add.reduceat(full.astype(np.int64), start[:-1])
    unit_end = np.cumsum(size + stuffed + 2)
    counts = np.array([w * h for w, h in shapes])
    first = np.concatenate([[0], np.cumsum(counts)])
    in_image = np.arange(len(size)) - np.repeat(first[:-1], counts)
    out[unit_end - 2] = 255
    out[unit_end - 1] = 0xD0 + in_image % 8
    files, begin = [], 0
    for k, (p, (wide, high)) in enumerate(zip(payloads, shapes, strict=True)):
        end = int(unit_end[first[k + 1] - 1])
        head = b"".join([
            b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(p)), _segment(0xDB, b"\0" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + b"\x01\x11\0\x02\x11\0\x03\x11\0"),
            _segment(0xC4, b"\0" + _DHT + b"\x10" + _DHT), _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0"),
        ])
        files.append(head + out[begin : end - 2].tobytes() + b"\xff\xd9")
        begin = end
    return files


@dataclass
class Image:
    """What the markers of a file say; ``scan`` is its entropy-coded part."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantisation table
    quant: dict[int, np.ndarray]
    huffman: dict[tuple[int, int], bytes]  # (class, id) -> counts and symbols
    selectors: list[tuple[int, int]]
    restart: int
    comment: bytes
    scan: bytes

    @property
    def units(self) -> tuple[int, int]:
        if len(self.components) == 1:  # its blocks are not interleaved, whatever its sampling
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def layout(self) -> tuple[int, ...]:
        """The component of each block of a unit."""
        if len(self.components) == 1:
            return (0,)
        return tuple(i for i, c in enumerate(self.components) for _ in range(c[1] * c[2]))


def _scan_end(data: bytes, at: int) -> int:
    """Where the next marker that is neither a stuffed byte nor a restart begins."""
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and data[at + 1] not in (0, 0xFF) and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 1
    return len(data)


def parse_markers(data: bytes) -> Image:
    """What the markers say; whatever is wrong with them is a ``JpegError``."""
    try:
        return _parse(data)
    except (struct.error, IndexError, KeyError, ValueError) as e:
        raise e if isinstance(e, JpegError) else JpegError(f"broken markers ({type(e).__name__})") from None


def _parse(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, quant, huffman, restart, comment, frame = 2, {}, {}, 0, b"", None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide, i = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                quant[i] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise JpegError("samples must have 8 bits")
            frame = (wide, high, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise JpegError("not a baseline image")
        elif marker == 0xD9:
            break
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if not frame or not frame[2]:
                raise JpegError("a scan without a frame")
            wide, high, components = frame
            chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            end = _scan_end(data, at + 2 + size)
            if len(chosen) < len(components) and set(chosen) == {components[0][0]}:  # luminance alone
                _, h, v, _ = components[0]
                wide, high = -(-wide * h // max(c[1] for c in components)), -(-high * v // max(c[2] for c in components))
                components = components[:1]
            if set(chosen) == {c[0] for c in components}:
                return Image(wide, high, components, quant, huffman, [chosen[c[0]] for c in components], restart, comment, data[at + 2 + size : end])
            at = end
            continue
        at += 2 + size
    raise JpegError("no scan")


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code * 256 + symbol; 0 where there is no code."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, code, n in canonical_codes(list(table[:16]), list(table[16:])):
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return out


def decode_scans(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients of each image: int16 of (units, blocks of a unit, 64 in zigzag order), DC made absolute."""
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        key = (x.layout, tuple((x.huffman[0, d], x.huffman[1, a]) for d, a in x.selectors))
        groups.setdefault(key, []).append(i)
    out: list = [None] * len(images)
    for (layout, tables), own in groups.items():
        for i, coefficients in zip(own, _decode_group([images[i] for i in own], layout, tables), strict=True):
            out[i] = coefficients
    return out


def _decode_group(images: list[Image], layout: tuple[int, ...], tables: tuple) -> Iterator[np.ndarray]:
    parts, starts, counts, firsts, base, units_before = [], [], [], [], 0, 0
    totals = []
    for x in images:
        raw = np.frombuffer(x.scan, np.uint8)
        mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 255)) if len(raw) else np.array([], np.int64)
        kind = raw[mark + 1]
        restarts = mark[(kind >= 0xD0) & (kind <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[mark[kind == 0] + 1] = False
        keep[restarts] = keep[restarts + 1] = False
        before = np.cumsum(keep) - keep
        begins = np.concatenate([[0], before[restarts + 1]])
        units = x.units[0] * x.units[1]
        step = x.restart or units
        lanes = -(-units // step)
        if len(begins) < lanes:
            raise JpegError("restart markers are missing")
        starts.append(begins[:lanes] + base)
        first = np.arange(lanes) * step
        firsts.append(first + units_before)
        counts.append(np.minimum(step, units - first))
        parts += [raw[keep], np.zeros(8, np.uint8)]
        base += int(keep.sum()) + 8
        totals.append(units)
        units_before += units
    data = np.concatenate(parts).astype(np.uint64)
    window = np.zeros(len(data), np.uint64)  # 5 bytes from each place on
    for i in range(5):
        window[: len(data) - i] |= data[i:] << np.uint64(32 - 8 * i)
    window = window.view(np.int64)
    lut = np.concatenate([_lookup(t) for pair in tables for t in pair])
    per_unit = len(layout)
    table_of = np.array([[2 * c, 2 * c + 1] for c in layout]).ravel() << 16
    flat = np.zeros(units_before * per_unit * 64, np.int16)
    pos = np.concatenate(starts).astype(np.int64) * 8
    base_at = np.concatenate(firsts).astype(np.int64) * per_unit * 64
    end_at = base_at + np.concatenate(counts) * per_unit * 64
    unit_first = base_at.copy()
    at, k = base_at, np.zeros(len(pos), np.int64)
    limit = len(window) * 8
    while len(pos):
        if pos.max() >= limit:
            raise JpegError("the scan ends early")
        w, bit = window[pos >> 3], pos & 7
        block = (at >> 6) % per_unit
        entry = lut[table_of[2 * block + (k > 0)] + (w >> (24 - bit) & 0xFFFF)]
        n, size, run = entry >> 8, entry & 15, entry >> 4 & 15
        if not n.all():
            raise JpegError("no such code")
        extra = w >> (40 - bit - n - size) & ((1 << size) - 1)
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        ac = k > 0
        k = k + np.where(ac, run, 0)
        ends = ac & (size == 0)
        k = np.where(ends & (run < 15), 64, k)
        put = k < 64
        flat[(at + k)[put]] = np.where(size == 0, 0, value)[put]
        k += 1
        pos = pos + n + size
        over = k >= 64
        at = at + np.where(over, 64, 0)
        k[over] = 0
        going = at < end_at
        if not going.all():
            pos, at, k, end_at = pos[going], at[going], k[going], end_at[going]
    coefficients = flat.reshape(-1, per_unit, 64)
    # DC is a difference to the block before it of the same component, within an interval
    lane_start = np.zeros(units_before, bool)
    lane_start[unit_first // (per_unit * 64)] = True
    for component in set(layout):
        own = [i for i, c in enumerate(layout) if c == component]
        dc = coefficients[:, own, 0].astype(np.int64).ravel()
        summed = np.cumsum(dc)
        heads = np.flatnonzero(lane_start) * len(own)
        before = np.where(heads > 0, summed[heads - 1], 0)
        spans = np.diff(np.append(heads, len(dc)))
        coefficients[:, own, 0] = (summed - np.repeat(before, spans)).reshape(-1, len(own))
    done = 0
    for units in totals:
        yield coefficients[done : done + units]
        done += units


def dc_thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance, one pixel for each 8x8 block of the first component, from DC alone."""
    wide, high = image.units
    _, h, v, q = image.components[0]
    if len(image.components) == 1:
        h = v = 1
    dc = coefficients[:, : h * v, 0].astype(np.int64) * int(image.quant[q][0])
    pixels = np.clip(dc // 8 + 128, 0, 255).astype(np.uint8)
    return pixels.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: is the mean of each of 64 equal stretches of the pixels, in raster order, over the mean of all."""
    flat = pixels.ravel().astype(np.int64)
    edges = np.arange(65) * len(flat) // 64
    low, high = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    summed = np.concatenate([[0], np.cumsum(flat)])
    bits = (summed[high] - summed[low]) * len(flat) > summed[-1] * (high - low)
    return np.packbits(bits).tobytes().hex()


def payload_of(image: Image, coefficients: np.ndarray) -> bytes | None:
    """The stored bytes; None if the file holds none."""
    if not image.comment.startswith(b"payload=") or not image.comment[8:].isdigit():
        return None
    return _BACK[np.clip(coefficients, -128, 128).ravel() + 128].tobytes()[: int(image.comment[8:])]


def read_images(files: list[bytes]) -> list[tuple[Image, np.ndarray] | JpegError]:
    """Parsed image and coefficients of each file, or why it cannot be read.  All are decoded in lockstep; only if one is broken, each by itself."""
    out: list = []
    for f in files:
        try:
            out.append(parse_markers(f))
        except JpegError as e:
            out.append(e)
    good = [i for i, x in enumerate(out) if isinstance(x, Image)]
    try:
        decoded = decode_scans([out[i] for i in good])
    except (JpegError, KeyError, IndexError, ValueError):
        decoded = []
        for i in good:
            try:
                decoded += decode_scans([out[i]])
            except (JpegError, KeyError, IndexError, ValueError) as e:
                decoded.append(JpegError(str(e) or type(e).__name__))
    for i, c in zip(good, decoded, strict=True):
        out[i] = c if isinstance(c, JpegError) else (out[i], c)
    return out


def read_payloads(files: list[bytes]) -> list[tuple[Image, np.ndarray, bytes]]:
    """Parsed image, coefficients and stored bytes of each file that ``encode_payloads`` wrote."""
    out = []
    for found in read_images(files):
        if isinstance(found, JpegError):
            raise found
        payload = payload_of(*found)
        if payload is None:
            raise JpegError("the file holds no payload")
        out.append((*found, payload))
    return out


def _feature_row(data: bytes | None, found) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width, height, feature, error."""
    if data is None:
        return (None,) * 9
    own = (len(data), hashlib.sha256(data).hexdigest())
    if isinstance(found, JpegError):
        return (None, None, None, *own, None, None, None, str(found))
    image, coefficients = found
    payload = payload_of(image, coefficients)
    said = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    try:
        feature, error = f"{image.width}x{image.height}:{thumbnail_hash(dc_thumbnail(image, coefficients))}", None
    except (KeyError, ValueError) as e:  # no quantisation table
        feature, error = None, f"no thumbnail ({type(e).__name__})"
    return (*said, *own, image.width, image.height, feature, error)


def _slices(values: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of about ``most`` bytes, so that memory does not follow the batch."""
    begin = total = 0
    for i, v in enumerate(values):
        size = len(v) if v is not None else 0
        if total and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(values):
        yield begin, len(values)


def write_media(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_bytes`` and the ``media`` column, written as a table in the shared folder and read from there."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = text_bytes(batch.column(n).to_pylist())
            for a, b in _slices(values):
                files = encode_payloads([padded(v) for v in values[a:b]])
                columns = [c.slice(a, b - a) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(v) for v in values[a:b]], pa.int64()), pa.array(files, pa.binary())], schema.names)

    path = new_folder(df.sparkSession, "media")
    bounded_batches(df).select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col))).mapInArrow(run, schema).write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def media_features(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Features from the stored bytes alone: dimensions, thumbnail hash, digests of the payload and of the file, and what was wrong."""
    kinds = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "width": T.IntegerType(), "height": T.IntegerType(), "feature": T.StringType(), "error": T.StringType()}
    schema = T.StructType([media.schema[c] for c in keep] + [T.StructField(k, v) for k, v in kinds.items()])
    arrow = [pa.string() if v == T.StringType() else pa.int32() if v == T.IntegerType() else pa.int64() for v in kinds.values()]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [v.as_py() for v in batch.column(n)]
            for a, b in _slices(files, 2_500_000):
                some = [f for f in files[a:b] if f is not None]
                found = iter(read_images(some))
                rows = [_feature_row(f, None if f is None else next(found)) for f in files[a:b]]
                columns = [c.slice(a, b - a) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema.names)

    return media.select(*[F.col(quoted(c)) for c in keep], media["media"]).mapInArrow(run, schema)
