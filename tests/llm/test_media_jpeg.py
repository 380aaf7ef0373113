import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lexweave.llm import media_jpeg as M
from tests.llm.conftest import EDGE


def bits_of(data, at, n):
    return sum((data[(at + i) >> 3] >> (7 - (at + i) % 8) & 1) << (n - 1 - i) for i in range(n))


def plain_decode(image):
    """One symbol at a time, straight from the format's description."""
    tables = {}
    for key, t in image.huffman.items():
        tables[key] = {(n, code): s for s, code, n in M.canonical_codes(list(t[:16]), list(t[16:]))}
    pieces, piece, i, scan = [], bytearray(), 0, image.scan
    while i < len(scan):
        if scan[i] == 255 and i + 1 < len(scan) and scan[i + 1] != 255:
            if scan[i + 1] == 0:
                piece.append(255)
            elif 0xD0 <= scan[i + 1] <= 0xD7:
                pieces.append(bytes(piece) + b"\0" * 8)
                piece = bytearray()
            i += 2
        else:
            piece.append(scan[i])
            i += 1
    pieces.append(bytes(piece) + b"\0" * 8)
    units = image.units[0] * image.units[1]
    out = np.zeros((units, len(image.layout), 64), np.int64)
    unit = 0
    for data in pieces:
        at, last = 0, {}
        for _ in range(min(image.restart or units, units - unit)):
            for b, c in enumerate(image.layout):
                k = 0
                while k < 64:
                    table = tables[(1 if k else 0), image.selectors[c][1 if k else 0]]
                    n = next(n for n in range(1, 17) if (n, bits_of(data, at, n)) in table)
                    symbol = table[n, bits_of(data, at, n)]
                    at += n
                    size, run = symbol & 15, symbol >> 4
                    value = bits_of(data, at, size) if size else 0
                    at += size
                    if size and value < 1 << (size - 1):
                        value -= (1 << size) - 1
                    if k == 0:
                        last[c] = out[unit, b, 0] = last.get(c, 0) + value
                        k = 1
                    elif size == 0:
                        k = k + 16 if run == 15 else 64
                    else:
                        k += run
                        out[unit, b, k] = value
                        k += 1
            unit += 1
    return out


def other_jpeg(restart):
    """A file that our writer never makes: two samplings, runs, zeros, 16-bit codes, differences of DC."""
    r = random.Random(restart)
    dc, ac = [0, 1, 2, 3, 4, 5], [0x00, 0x01, 0x02, 0x11, 0x22, 0xF0, 0x05]
    counts = [0] * 16
    for n in (2, 2, 3, 4, 5, 16):
        counts[n - 1] += 1
    counts_ac = [0] * 16
    for n in (2, 2, 3, 4, 5, 6, 16):
        counts_ac[n - 1] += 1
    codes = [{s: (c, n) for s, c, n in M.canonical_codes(counts, dc)}, {s: (c, n) for s, c, n in M.canonical_codes(counts_ac, ac)}]
    wide, high = 3, 2
    scan, bits = b"", ""

    def close():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        bits = ""
        return out.replace(b"\xff", b"\xff\0")

    def put(kind, symbol, extra=0, size=0):
        nonlocal bits
        code, n = codes[kind][symbol]
        bits += f"{code:0{n}b}" + (f"{extra:0{size}b}" if size else "")

    for unit in range(wide * high):
        if restart and unit and unit % restart == 0:
            scan += close() + bytes([255, 0xD0 + (unit // restart - 1) % 8])
        for _ in range(6):
            size = r.choice(dc)
            put(0, size, r.randrange(1 << size) if size else 0, size)
            k = 1
            while k < 64:
                symbol = r.choice(ac if k < 40 else [0x00, 0x01])
                run, size = symbol >> 4, symbol & 15
                put(1, symbol, r.randrange(1 << size) if size else 0, size)
                if symbol == 0:
                    break
                k += run + 1
    scan += close()
    seg = M._segment
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([16] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + b"\x01\x22\0\x02\x11\0\x03\x11\0") + seg(0xC4, b"\0" + bytes(counts) + bytes(dc)) + seg(0xC4, b"\x10" + bytes(counts_ac) + bytes(ac)) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 2, 5])
def test_decoder_reads_other_files(restart):
    image = M.parse_markers(other_jpeg(restart))
    got = M.decode_scans([image, image])
    want = plain_decode(image)
    assert (got[0] == want).all() and (got[1] == want).all()
    thumb = M.dc_thumbnail(image, got[0])
    assert thumb.shape == (4, 6)
    assert thumb[0, 0] == np.clip(want[0, 0, 0] * 16 // 8 + 128, 0, 255) and thumb[1, 0] == np.clip(want[0, 2, 0] * 16 // 8 + 128, 0, 255)


def test_sampling_of_a_single_component_does_not_count():
    seg = lambda marker, body: bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    tables = b"\0" + bytes([0, 2] + [0] * 14) + b"\0\3" + b"\x10" + bytes([1] + [0] * 15) + b"\0"
    for factors in (0x11, 0x22, 0x41):
        head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 24, 1, 1, factors, 0])) + seg(0xC4, tables) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
        bits = "011000" * 6 + "1111"  # six blocks, the DC of each four over that before
        image = M.parse_markers(head + int(bits, 2).to_bytes(5, "big") + b"\xff\xd9")
        assert M.dc_thumbnail(image, M.decode_scans([image])[0]).tolist() == [[132, 136, 140], [144, 148, 152]], factors


def test_payloads_round_trip():
    r = random.Random(1)
    values = [b"", b"a", b"x" * 192, bytes(range(256)), r.randbytes(5000), b"\xff" * 1000, r.randbytes(192 * 8200)]
    files = M.encode_payloads([M.padded(v) for v in values])
    read = M.read_payloads(files)
    assert [p for _, _, p in read] == [M.padded(v) for v in values]
    assert all(len(p) % 192 == 0 and p for _, _, p in read)
    small, c, _ = read[3]
    assert (M.decode_scans([small])[0] == plain_decode(small)).all()
    assert read[-1][0].height == 16


def test_refuses_what_it_cannot_read():
    good = M.encode_payloads([M.padded(b"abc")])[0]
    for bad in (b"", b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2", 1), good[:60]):
        with pytest.raises(M.JpegError):
            M.parse_markers(bad)
    with pytest.raises(M.JpegError):
        M.read_payloads([other_jpeg(1)])
    with pytest.raises(ValueError):
        M.encode_payloads([b"abc"])


def test_rows(spark, docs):
    got = M.media_features(M.write_media(docs(EDGE))).collect()
    assert len(got) == len(EDGE)
    for r in got:
        text = next((t or "") for i, t in EDGE if i == r.doc_id)
        data = text.encode()
        whole = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1
    assert M.media_features(M.write_media(docs([]))).count() == 0


def test_foreign_broken_and_null_media_end_no_job(spark, docs):
    own = M.encode_payloads([M.padded(b"some text")])[0]
    foreign = own.replace(M._segment(0xFE, b"payload=192"), M._segment(0xFE, b"someone else's"))
    rows = [(1, own), (2, None), (3, foreign), (4, b""), (5, own[:200]), (6, b"\x89PNG"), (7, own), (8, own[: len(own) // 2] + b"\xff\xd9")]
    got = {r.doc_id: r for r in M.media_features(spark.createDataFrame(rows, "doc_id long, media binary"), keep=("doc_id",)).collect()}
    assert got[1].payload_bytes == got[7].payload_bytes == 192 and got[1].error is None
    assert got[3].payload_bytes is None and got[3].feature == got[1].feature and got[3].error is None
    assert got[2].media_bytes is None and got[2].error is None
    assert all(got[i].error and got[i].feature is None and got[i].media_bytes == len(rows[i - 1][1]) for i in (4, 5, 6, 8))


def test_a_scan_for_each_component():
    """Luminance in a scan of its own, the other components in others."""
    own = M.encode_payloads([M.padded(bytes(range(192)))])[0]
    image = M.parse_markers(own)
    grey = M.Image(image.width, image.height, image.components[:1], image.quant, image.huffman, image.selectors[:1], image.restart, b"", image.scan)
    head = own[: own.index(b"\xff\xda")]
    one = b"\xff\xda" + bytes([0, 8, 1, 1, 0, 0, 63, 0])
    split = head + b"\xff\xda" + bytes([0, 8, 1, 2, 0, 0, 63, 0]) + image.scan + one + image.scan + b"\xff\xd9"
    found = M.parse_markers(split)
    assert (found.components, found.scan, found.units) == (grey.components, image.scan, grey.units)
    assert (M.decode_scans([found])[0] == M.decode_scans([grey])[0]).all()
