import hashlib
import random
import struct
import zlib

import pytest

from tempora.llm import jpeg


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def bytes(self):
        t = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(t[i : i + 8], 2) for i in range(0, len(t), 8)).replace(b"\xff", b"\xff\x00")


# A complete code for the symbols that the test writes.
DC_BITS, DC_VALUES = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7), bytes(range(12))
AC_BITS, AC_VALUES = bytes([0, 2, 1, 2, 1] + [0] * 11), bytes([0x01, 0x00, 0x02, 0x11, 0xF0, 0x23])


def codes(bits, values):
    out, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(bits[n - 1]):
            out[values[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def number(v):
    c = abs(v).bit_length()
    return c, (v if v > 0 else v + (1 << c) - 1)


def picture(rng, comps, wide, high, restart, quant):
    """A JPEG of random coefficients; gives the stream and the luminance thumbnail."""
    dc, ac = codes(DC_BITS, DC_VALUES), codes(AC_BITS, AC_VALUES)
    hmax, vmax = (1, 1) if len(comps) == 1 else (max(h for h, _ in comps), max(v for _, v in comps))
    mw, mh = -(-wide // (8 * hmax)), -(-high // (8 * vmax))
    thumb, chunks, bits, pred = {}, [], Bits(), [0] * len(comps)
    for m in range(mw * mh):
        if restart and m and m % restart == 0:
            chunks.append(bits.bytes())
            bits, pred = Bits(), [0] * len(comps)
        for c, (h, v) in enumerate(comps):
            for k in range(1 if len(comps) == 1 else h * v):
                value = rng.randint(-100, 100)
                n, extra = number(value - pred[c])
                pred[c] = value
                bits.put(*dc[n])
                bits.put(extra, n)
                at = 1
                while at < 64 and rng.random() < 0.6:
                    sym = rng.choice([0x01, 0x02, 0x11, 0x23, 0xF0])
                    run, size = sym >> 4, sym & 15
                    if at + run + (size > 0) > 64 or sym == 0xF0 and at + 16 >= 64:
                        break
                    bits.put(*ac[sym])
                    bits.put(rng.getrandbits(size) if size else 0, size)
                    at += 16 if sym == 0xF0 else run + 1
                if at < 64:
                    bits.put(*ac[0])
                if c == 0:
                    hh, vv = (1, 1) if len(comps) == 1 else (h, v)
                    thumb[m // mw * vv + k // hh, m % mw * hh + k % hh] = min(max(value * quant // 8 + 128, 0), 255)
    chunks.append(bits.bytes())
    seg = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    sof = struct.pack(">BHHB", 8, high, wide, len(comps)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(comps))
    sos = bytes([len(comps)]) + b"".join(bytes([i + 1, 0]) for i in range(len(comps))) + bytes([0, 63, 0])
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [quant] * 64)) + seg(0xC0, sof) + seg(0xC4, b"\0" + DC_BITS + DC_VALUES + b"\x10" + AC_BITS + AC_VALUES)
    head += (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, sos)
    body = b"".join(x + (bytes([0xFF, 0xD0 + i % 8]) if i < len(chunks) - 1 else b"") for i, x in enumerate(chunks))
    rows, cols = max(r for r, _ in thumb) + 1, max(c for _, c in thumb) + 1
    return head + body + b"\xff\xd9", [[thumb[r, c] for c in range(cols)] for r in range(rows)]


def test_decodes_any_baseline_frame():
    rng = random.Random(1)
    kinds = [([(1, 1)], 40, 24, 0, 8), ([(1, 1)], 100, 17, 3, 3), ([(2, 2), (1, 1), (1, 1)], 50, 33, 0, 5), ([(2, 1), (1, 1), (1, 1)], 64, 16, 2, 16), ([(1, 1)] * 3, 9, 9, 1, 1)]
    made = [picture(rng, *k) for k in kinds for _ in range(3)]
    got = jpeg.thumbnails([jpeg.parse_frame(x) for x, _ in made])
    assert [t.tolist() for t in got] == [t for _, t in made]


def test_payloads_round_trip(monkeypatch):
    rng = random.Random(2)
    texts = [b"", b"a", b"\xff" * 500, bytes(range(256)) * 9, rng.randbytes(70_000), b"x" * 64]
    payloads = [jpeg.padded(t) for t in texts]
    assert all(len(p) % 64 == 0 and p for p in payloads)
    assert [x[0] for x in jpeg.read(jpeg.store(payloads))] == payloads
    monkeypatch.setattr(jpeg, "FRAME_BYTES", 6400)
    assert [x[0] for x in jpeg.read(jpeg.store(payloads))] == payloads
    monkeypatch.setattr(jpeg, "MAX_SIDE_BLOCKS", 3)
    assert [x[0] for x in jpeg.read(jpeg.store(payloads))] == payloads


def test_damage_is_named():
    media = jpeg.store([jpeg.padded(b"some text")])[0]
    for bad in (b"", media[:30], media[:-2], b"\x00" + media, media[:-20] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.thumbnails([jpeg.parse_frame(bad)])


def test_query(spark, odd, nothing):
    text = {(r.doc_id, r.text): None for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r.doc_id, r.payload_sha256, r.n_bytes, r.payload_bytes, r.tail_crc32) for r in jpeg.op2_media(spark, odd).collect()}
    want = set()
    for i, t in text:
        p = (t or "").encode()
        q = p + b"\0" * (64 if not p else -len(p) % 64)
        want.add((i, hashlib.sha256(q).hexdigest(), len(p), len(q), zlib.crc32(q[-64:])))
    assert got == want
    assert jpeg.op2_media(spark, nothing).count() == 0
