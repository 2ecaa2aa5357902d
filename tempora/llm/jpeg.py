"""Baseline JPEG media columns: markers, Huffman scans and DC-only luminance thumbnails in numpy.

The decoder takes any baseline, Huffman-coded, sequential JPEG with one interleaved scan.
It parses the markers, undoes byte stuffing, and decodes the entropy-coded data of all
restart intervals of a batch in lockstep, one symbol of each per step. AC coefficients
are decoded to find the next block and dropped; the luminance DC coefficients give one
sample per 8x8 block, which is the thumbnail.

To hold a payload without loss, the encoder writes one flat grey 8x8 block per byte: with
a DC quantiser of 8 the block's samples equal the byte, so the unit of the stored form is
the block and its thumbnail is the payload. Its Huffman table gives each DC category
c a code of 9 - c bits, so every block takes 10 bits; restart intervals of 64 blocks
are 80 bytes. Payloads beyond one frame's 65,535 pixels a side take several frames in a row.

Null text: empty. Empty text: 64 zero bytes. Very long texts: as many frames as they need, all of which
the feature names by size and hash. Repeated rows: equal values. Empty table: no rows. Extra columns,
whatever their names, are not read. There are no ties. Damaged media: a ValueError that names the cause.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tempora.llm.common import Bounded, documents, small_batches

INTERVAL = 64
MAX_SIDE_BLOCKS = 8191
FRAME_BYTES = 64 * 127 * MAX_SIDE_BLOCKS
#: Payload bytes, or coded bytes, that are worked on at a time.
CHUNK = 1 << 19


# ---- encoder

def _code_table() -> np.ndarray:
    """10-bit code of each DC difference from -255 to 255: category, its extra bits, end of block."""
    out = np.zeros(511, dtype=np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        ones = (1 << (8 - c)) - 1
        extra = d if d > 0 else d + (1 << c) - 1
        out[d + 255] = (((ones << 1) << c) | extra) << 1
    return out


_CODES = _code_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(n_bytes: int, n_blocks: int) -> bytes:
    wide = INTERVAL * -(-n_blocks // (INTERVAL * MAX_SIDE_BLOCKS))
    high = -(-n_blocks // wide)
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, b"bytes=%d" % n_bytes),
        _segment(0xDB, b"\x00" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))),
        _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
        _segment(0xDD, struct.pack(">H", INTERVAL)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One JPEG stream for each payload, whose length is a multiple of 64 within one frame's bound."""
    padded = []
    for p in payloads:
        n = len(p)
        wide = INTERVAL * -(-n // (INTERVAL * MAX_SIDE_BLOCKS))
        padded.append(p + b"\0" * (-n % wide))
    v = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.int16).reshape(-1, INTERVAL)
    d = np.empty_like(v)
    d[:, 0] = v[:, 0] - 128
    d[:, 1:] = v[:, 1:] - v[:, :-1]
    c = _CODES[d + 255].reshape(-1, 4)
    word = (c[:, 0] << 30) | (c[:, 1] << 20) | (c[:, 2] << 10) | c[:, 3]
    coded = np.empty((len(v), 82), dtype=np.uint8)
    coded[:, :80] = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1, 80)
    stuffed = np.zeros((len(v), 82), dtype=bool)
    stuffed[:, :80] = coded[:, :80] == 0xFF
    lengths = np.array([len(p) // INTERVAL for p in padded])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    coded[:, 80] = 0xFF
    coded[:, 81] = 0xD0 + (np.arange(len(v)) - np.repeat(first, lengths)) % 8
    coded[first + lengths - 1, 81] = 0xD9  # the last marker of a stream ends it
    mask = stuffed.ravel()
    flat = np.repeat(coded.ravel(), 1 + mask)
    flat[np.flatnonzero(mask) + np.arange(1, mask.sum() + 1)] = 0
    ends = (82 * np.cumsum(lengths) + np.concatenate([[0], np.cumsum(mask)])[82 * np.cumsum(lengths)]).tolist()
    raw, at, out = flat.tobytes(), 0, []
    for p, q, end in zip(payloads, padded, ends):
        out.append(_header(len(p), len(q)) + raw[at:end])
        at = end
    return out


# ---- decoder

_HUFFMAN: dict[bytes, np.ndarray] = {}


def huffman_table(bits: bytes, values: bytes) -> np.ndarray:
    """For each 16 next bits, the code's length << 8 | its symbol; 0 where no code fits."""
    key = bits + values
    if (t := _HUFFMAN.get(key)) is None:
        t = np.zeros(1 << 16, dtype=np.int32)
        code, k = 0, 0
        for length in range(1, 17):
            for _ in range(bits[length - 1]):
                lo, hi = code << (16 - length), (code + 1) << (16 - length)
                if hi > 1 << 16:
                    raise ValueError("Huffman table has too many codes")
                t[lo:hi] = length << 8 | values[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_HUFFMAN) > 256:
            _HUFFMAN.clear()
        _HUFFMAN[key] = t
    return t


class Frame:
    """One parsed frame: its size, tables, the order of blocks in an MCU, and its coded intervals."""

    __slots__ = ("width", "height", "comps", "quant", "slots", "restart", "start", "comment", "intervals", "end", "mcus_wide", "mcus_high")


_MARK = re.compile(rb"\xff+[^\x00\xff]", re.S)


def parse_frame(data: bytes, at: int = 0) -> Frame:
    f = Frame()
    f.comment, f.restart, f.comps = b"", 0, []
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, np.ndarray] = {}
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        if len(body) != n - 2:
            raise ValueError("segment is cut short")
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            precision, f.height, f.width, count = struct.unpack_from(">BHHB", body)
            if precision != 8 or not f.width or not f.height:
                raise ValueError("not an 8-bit frame of known size")
            f.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = huffman_table(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            (f.restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            f.comment = body
        elif marker == 0xDA:
            break
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline sequential frame")
    if not f.comps or body[0] != len(f.comps):
        raise ValueError("one interleaved scan is expected")
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    f.quant = quant[f.comps[0][3]]
    one = len(f.comps) == 1
    f.slots = []
    for c, (ident, h, v, _) in enumerate(f.comps):
        for k in range(1 if one else h * v):
            f.slots.append((c, k, tables[chosen[ident] >> 4], tables[0x10 | chosen[ident] & 15]))
    hmax, vmax = (1, 1) if one else (max(c[1] for c in f.comps), max(c[2] for c in f.comps))
    f.mcus_wide, f.mcus_high = -(-f.width // (8 * hmax)), -(-f.height // (8 * vmax))
    f.intervals, f.start, begin = [], at, at
    for m in _MARK.finditer(data, at):
        stop, end = m.span()
        f.intervals.append(data[begin:stop].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= data[end - 1] <= 0xD7:
            f.end = end
            if data[end - 1] != 0xD9:
                raise ValueError("one scan is expected")
            break
        begin = end
    else:
        raise ValueError("no end of image")
    return f


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """For each frame, the mean sample of each luminance block, rows by columns, as int64."""
    tables: dict[int, int] = {}
    stack: list[np.ndarray] = []

    def number(t: np.ndarray) -> int:
        if id(t) not in tables:
            tables[id(t)] = len(stack)
            stack.append(t)
        return tables[id(t)]

    slots_of, first_slot, n_slots, out_at = [], [], [], []
    raw, lane_frame, lane_mcu, lane_left = [], [], [], []
    total = 0
    for k, f in enumerate(frames):
        first_slot.append(len(slots_of))
        n_slots.append(len(f.slots))
        per_mcu = sum(c == 0 for c, *_ in f.slots)
        slots_of += [(c, j, number(dc), number(ac)) for c, j, dc, ac in f.slots]
        out_at.append(total)
        mcus = f.mcus_wide * f.mcus_high
        total += mcus * per_mcu
        step = f.restart or mcus
        if len(f.intervals) != -(-mcus // step):
            raise ValueError("number of restart intervals is wrong")
        count = len(f.intervals)
        raw += f.intervals
        lane_frame += [k] * count
        lane_mcu += range(0, mcus, step)
        lane_left += [step] * (count - 1) + [mcus - (count - 1) * step]
    lengths = np.array([len(x) for x in raw], dtype=np.int64)
    buf = np.frombuffer(b"".join(raw) + b"\xff" * 16, dtype=np.uint8).astype(np.uint64)
    n = len(buf) - 8
    window = np.zeros(n, dtype=np.uint64)  # the 5 bytes from each byte on
    for i in range(5):
        window |= buf[i : n + i] << np.uint64(8 * (4 - i))
    window = window.view(np.int64)
    lut = np.concatenate(stack)
    s_comp, s_index, s_dc, s_ac = np.array(slots_of, dtype=np.int64).reshape(-1, 4).T
    s_dc, s_ac = s_dc << 16, s_ac << 16
    plain = len(slots_of) == len(frames) and len(stack) == 2  # grey frames that share their tables
    frame = np.array(lane_frame, dtype=np.int64)
    base, count = np.array(first_slot, dtype=np.int64)[frame], np.array(n_slots, dtype=np.int64)[frame]
    luma = np.array([sum(c == 0 for c, *_ in f.slots) for f in frames], dtype=np.int64)[frame]
    left = np.array(lane_left, dtype=np.int64) * count
    order = np.argsort(-left, kind="stable")  # lanes that still run are always the first ones
    end = np.cumsum(lengths) * 8
    bit = (end - lengths * 8)[order]
    end, left, base, count, luma = end[order], left[order], base[order], count[order], luma[order]
    to = np.array(out_at, dtype=np.int64)[frame[order]] + np.array(lane_mcu, dtype=np.int64)[order] * luma
    at = np.zeros(len(raw), dtype=np.int64)  # slot within the MCU
    pred = np.zeros((len(raw), 4), dtype=np.int64)
    out = np.zeros(total, dtype=np.int64)
    power = 1 << np.arange(32)
    half = power >> 1

    def symbol(b: np.ndarray, tab: np.ndarray | int) -> tuple[np.ndarray, ...]:
        w, off = window[b >> 3], b & 7
        entry = lut[((w >> (24 - off)) & 0xFFFF) + tab]
        return w, off, entry & 255, entry >> 8

    alive = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for block, m in enumerate(alive):
        b = bit[:m]
        s = None if plain else base[:m] + at[:m]
        w, off, size, length = symbol(b, s_dc[0] if plain else s_dc[s])
        used = length + size
        extra = (w >> (40 - off - used)) & (power[size] - 1)
        diff = np.where(extra < half[size], extra - power[size] + 1, extra)
        ok = length.min() > 0
        b += used
        if plain:
            y = pred[:m, 0]
            y += diff
            out[to[:m] + block] = y
        else:
            lanes = np.arange(m)
            pred[lanes, s_comp[s]] += diff
            y = np.flatnonzero(s_comp[s] == 0)
            out[to[y] + s_index[s[y]]] = pred[y, 0]
        w, off, sym, length = symbol(b, s_ac[0] if plain else s_ac[s])
        ok &= length.min() > 0
        b += length + (sym & 15)
        k = np.where(sym == 0, 64, np.where(sym == 0xF0, 17, (sym >> 4) + 2))
        rest = np.flatnonzero(k < 64)
        while len(rest) and ok:
            w, off, sym, length = symbol(b[rest], s_ac[0] if plain else s_ac[s[rest]])
            ok &= length.min() > 0
            b[rest] += length + (sym & 15)
            k[rest] = np.where(sym == 0, 64, k[rest] + np.where(sym == 0xF0, 16, (sym >> 4) + 1))
            rest = rest[k[rest] < 64]
        if not ok:
            raise ValueError("bits that are no code")
        if (b > end[:m]).any():
            raise ValueError("coded data is cut short")
        if not plain:
            at[:m] += 1
            turn = np.flatnonzero(at[:m] == count[:m])
            at[turn] = 0
            to[turn] += luma[turn]
    thumbs = []
    for f, lo in zip(frames, out_at):
        _, h, v, _ = f.comps[0]
        h, v = (1, 1) if len(f.comps) == 1 else (h, v)
        x = out[lo : lo + f.mcus_wide * f.mcus_high * h * v].reshape(f.mcus_high, f.mcus_wide, v, h)
        x = x.transpose(0, 2, 1, 3).reshape(f.mcus_high * v, f.mcus_wide * h)
        thumbs.append(np.clip(x * f.quant[0] // 8 + 128, 0, 255))
    return thumbs


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits, whether each of 8x8 cells of the thumbnail is above their mean, as hex."""
    for axis in (0, 1):
        n = thumb.shape[axis]
        first = np.arange(9) * n // 8
        if n < 8:  # a row or column may fill several cells
            thumb = thumb.take(first[:8], axis=axis)
        else:
            thumb = np.add.reduceat(thumb, first[:8], axis=axis) / (first[1:] - first[:-1]).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.packbits(thumb > thumb.sum() / 64).tobytes().hex()


# ---- payloads

def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or (64 if not text else 0))


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: one frame, or several in a row."""
    out: list[list[bytes]] = [[] for _ in payloads]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        for (i, _), x in zip(held, encode_payloads([p for _, p in held])):
            out[i].append(x)
        held.clear()

    for i, p in enumerate(payloads):
        for at in range(0, len(p), FRAME_BYTES):
            held.append((i, p[at : at + FRAME_BYTES]))
            size += len(held[-1][1])
            if size >= CHUNK:
                flush()
                size = 0
    if held:
        flush()
    return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def read(media: list[bytes]) -> list[tuple[bytes, int, int, str]]:
    """For each stored form: its payload, the first frame's width and height, and every frame's size and thumbnail hash."""
    parts: list[list[tuple[bytes, int, int, str]]] = [[] for _ in media]
    held: list[tuple[int, Frame]] = []
    size = 0

    def flush() -> None:
        for (i, f), t in zip(held, thumbnails([f for _, f in held])):
            m = re.fullmatch(rb"bytes=(\d+)", f.comment)
            flat = t.astype(np.uint8).tobytes()
            parts[i].append((flat[: int(m[1])] if m else flat, f.width, f.height, thumbnail_hash(t)))
        held.clear()

    for i, data in enumerate(media):
        at = 0
        while at < len(data):
            f = parse_frame(data, at)
            held.append((i, f))
            size += f.end - at
            at = f.end
            if size >= CHUNK:
                flush()
                size = 0
    if held:
        flush()
    return [(b"".join(x[0] for x in p), p[0][1], p[0][2], ".".join(f"{w}x{h}:{t}" for _, w, h, t in p)) for p in parts]


_DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int"


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = store([padded(t or b"") for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in b.column(1).to_pylist()], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = b.column(2).to_pylist()
        found = read(media)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        cols = [
            b.column(0), b.column(1),
            pa.array([len(p) for p, *_ in found], pa.int64()),
            pa.array([sha(p) for p, *_ in found], pa.string()),
            pa.array([zlib.crc32(p[-64:]) for p, *_ in found], pa.int64()),
            pa.array([len(m) for m in media], pa.int64()),
            pa.array([sha(m) for m in media], pa.string()),
            pa.array([f for *_, f in found], pa.string()),
            pa.array([w for _, w, _, _ in found], pa.int32()),
            pa.array([h for _, _, h, _ in found], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(x.split()[0] for x in _DIGEST.split(", "))])


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a JPEG stream."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(Bounded(_encode_batches), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash and digests of each row's media, with what its thumbnail holds."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(Bounded(_digest_batches), f"doc_id {dict(media.dtypes)['doc_id']}, {_DIGEST}")


def op2_media(spark, sf_dir: str) -> DataFrame:
    return media_features(encode_documents(documents(spark, sf_dir)))
