"""Media columns as FLAC: bytes stored as 8-bit samples, written and read back by numpy over many frames at a time."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import give_back, slices, utf8_of

BLOCK = 1024
RATE = 8000
UNIT = 64
#: Samples encoded, and bytes decoded, at a time: a long stream passes in parts.
CHUNK = 1 << 19
#: The linear predictor that competes with the fixed ones: its order, and its coefficients' bits and shift.
LPC_ORDER, PRECISION, SHIFT = 4, 12, 9
MAGIC = b"fLaC"
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 31
#: The fixed predictors of the format, newest sample first.
FIXED_COEFFICIENTS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


CRC8 = crc_table(0x07, 8)
CRC16 = crc_table(0x8005, 16)


def _zeros_behind(crc: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        crc = ((crc << 8) & 0xFFFF) ^ CRC16[crc >> 8]
    return crc


#: CRC16 of a byte with 7, 6, ... 0 zero bytes behind it; and what 8 zero bytes make of either half of a CRC.
AHEAD = [_zeros_behind(CRC16, 7 - j) for j in range(8)]
HIGH8, LOW8 = _zeros_behind(np.arange(256) << 8, 8), _zeros_behind(np.arange(256), 8)


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC16 of many byte ranges. The CRC starts at 0, so zeros before a range change nothing: ranges are set flush right."""
    out = np.zeros(len(start), np.int64)
    blocks = -(-size // 8)
    grades = np.frexp(blocks)[1]
    for grade in np.unique(grades):
        rows = np.flatnonzero(grades == grade)
        width = int(blocks[rows].max()) * 8
        at = start[rows, None] + size[rows, None] + np.arange(-width, 0)[None, :]
        cells = np.where(at >= start[rows, None], data[np.maximum(at, 0)], 0).reshape(len(rows), -1, 8)
        part = AHEAD[0][cells[:, :, 0]]
        for j in range(1, 8):
            part ^= AHEAD[j][cells[:, :, j]]
        crc = np.zeros(len(rows), np.int64)
        for k in range(width // 8):
            crc = HIGH8[crc >> 8] ^ LOW8[crc & 255] ^ part[:, k]
        out[rows] = crc
    return out


def numbered(n: int) -> bytes:
    """A frame number in the UTF-8-like code of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail: list[int] = []
    room = 6
    while n >= 1 << room:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        room = 5 if len(tail) == 1 else room - 1
    return bytes([(0xFF << (room + 1)) & 0xFF | n, *tail[::-1]])


@functools.lru_cache(maxsize=1 << 14)
def frame_header(number: int, n: int) -> bytes:
    body = b"\xff\xf8" + (bytes([0xA0, 0x02]) + numbered(number) if n == BLOCK else bytes([0x70, 0x02]) + numbered(number) + (n - 1).to_bytes(2, "big"))
    crc = 0
    for b in body:
        crc = int(CRC8[crc ^ b])
    return body + bytes([crc])


def put(words: np.ndarray, start: np.ndarray, length: np.ndarray, value: np.ndarray) -> None:
    """Write bit strings of at most 64 bits at rising, disjoint bit positions of zeroed big-endian words."""
    if not len(start):
        return
    word, shift = start >> 6, 64 - (start & 63) - length
    v = value.astype(np.uint64)
    over = shift < 0
    high = np.where(over, v >> np.minimum(np.maximum(-shift, 0), 63).astype(np.uint64), v << np.maximum(shift, 0).astype(np.uint64))
    edges = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[edges]] |= np.bitwise_or.reduceat(high, edges)
    words[word[over] + 1] |= v[over] << (64 + shift[over]).astype(np.uint64)


def linear_predictors(x: np.ndarray, first: np.ndarray, n: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Quantised coefficients (order x frames, newest sample first) by Levinson and Durbin's recursion, all frames at once."""
    r = []
    for lag in range(LPC_ORDER + 1):
        product = x * np.append(np.zeros(lag, x.dtype), x[: len(x) - lag])
        product[inside < lag] = 0
        r.append(np.add.reduceat(product, first).astype(float))
    error = r[0] * (1 + 1e-6) + 1e-6
    a: list[np.ndarray] = []
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / error
        a = [*(a[j] - k * a[i - 1 - j] for j in range(i)), k]
        error = np.maximum(error * (1 - k * k), 1e-6)
    return np.clip(np.rint(np.array(a) * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)


def encode_frames(x: np.ndarray, n: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of n samples each: constant, or Rice-coded behind the predictor that costs least, or verbatim if nothing costs less."""
    first = np.cumsum(n) - n
    inside = (np.arange(len(x)) - np.repeat(first, n)).astype(np.int32)
    best, kind, order, rice = 8 * n, np.full(len(n), VERBATIM), np.zeros(len(n), np.int64), np.zeros(len(n), np.int32)
    folded = np.zeros(len(x), np.int32)

    def compete(residual: np.ndarray, o: int, code: int, extra: int) -> None:
        z = (residual << 1) ^ (residual >> 31)
        z[inside < o] = 0
        mean = np.add.reduceat(z, first, dtype=np.int64) / np.maximum(n - o, 1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int32)
        cost = np.add.reduceat(z >> np.repeat(k, n), first, dtype=np.int64) + (n - o) * (k + 1) + 8 * o + extra + 10
        fits = (cost < best) & (n > o) & (np.maximum.reduceat(z, first) >> k < 32)
        best[fits], kind[fits], order[fits], rice[fits] = cost[fits], code, o, k[fits]
        pick = np.repeat(fits, n)
        folded[pick] = z[pick]

    residual = x
    for o in range(len(FIXED_COEFFICIENTS)):
        if o:
            residual = np.append(residual[:1], residual[1:] - residual[:-1])
        compete(residual, o, FIXED + o, 0)
    q = linear_predictors(x, first, n, inside)
    guess = np.zeros(len(x), np.int32)
    for j in range(LPC_ORDER):
        guess[j + 1 :] += np.repeat(q[j], n)[j + 1 :] * x[: len(x) - j - 1]
    compete(x - (guess >> SHIFT), LPC_ORDER, LPC + LPC_ORDER, 9 + PRECISION * LPC_ORDER)
    del residual, guess
    flat = np.maximum.reduceat(x, first) == np.minimum.reduceat(x, first)
    kind[flat], order[flat] = CONSTANT, 0
    head = [frame_header(a, b) for a, b in zip(number.tolist(), n.tolist(), strict=True)]
    head_len = np.array([len(h) for h in head])
    total = head_len + 3 + np.where(flat, 1, -(-best // 8))
    base = np.append(0, np.cumsum(-(-total // 8) * 8 + 8)[:-1])
    words = np.zeros(int(base[-1] + total[-1]) // 8 + 4, np.uint64)
    coded, lpc = kind >= FIXED, kind == LPC + LPC_ORDER
    lead = (base + head_len + 1 + order) * 8
    coefficients = np.zeros(int(lpc.sum()), np.int64)
    for row in q[:, lpc]:
        coefficients = coefficients << PRECISION | row & ((1 << PRECISION) - 1)
    put(words, lead[lpc], np.full(len(coefficients), 9), np.full(len(coefficients), (PRECISION - 1) << 5 | SHIFT))
    put(words, lead[lpc] + 9, np.full(len(coefficients), PRECISION * LPC_ORDER), coefficients)
    lead[lpc] += 9 + PRECISION * LPC_ORDER
    put(words, lead[coded], np.full(int(coded.sum()), 10), rice[coded])  # method 0, one partition, its parameter
    real = np.repeat(coded, n) & (inside >= np.repeat(order, n))
    k, z = np.repeat(rice, n)[real], folded[real]
    length = ((z >> k) + 1 + k).astype(np.int64)
    so_far = np.append(0, np.cumsum(length))
    left = np.where(coded, n - order, 0)
    start = so_far[:-1] + np.repeat(lead + 10 - so_far[np.cumsum(left) - left], left)
    put(words, start, length, (np.int32(1) << k) | (z & ((np.int32(1) << k) - 1)))
    data = words.astype(">u8").view(np.uint8)
    for j in range(int(head_len.max())):
        has = head_len > j
        data[base[has] + j] = [h[j] for h in head if len(h) > j]
    data[base + head_len] = kind << 1
    raw = x.astype(np.int8).view(np.uint8)
    data[base[flat] + head_len[flat] + 1] = raw[first[flat]]
    for j in range(int(order.max())):
        has = order > j
        data[base[has] + head_len[has] + 1 + j] = raw[first[has] + j]
    for f in np.flatnonzero(kind == VERBATIM).tolist():
        data[base[f] + head_len[f] + 1 : base[f] + head_len[f] + 1 + n[f]] = raw[first[f] : first[f] + n[f]]
    crc = crc16(data, base, total - 2)
    data[base + total - 2], data[base + total - 1] = crc >> 8, crc & 255
    whole = data.tobytes()
    return [whole[b : b + s] for b, s in zip(base.tolist(), total.tolist(), strict=True)]


def spans(sizes: Iterable[int]) -> Iterator[list[tuple[int, int, int]]]:
    """(stream, first sample, end) in groups of at most CHUNK samples, cut at multiples of BLOCK."""
    held: list[tuple[int, int, int]] = []
    room = CHUNK
    for i, n in enumerate(sizes):
        for at in range(0, n, CHUNK):
            end = min(n, at + CHUNK)
            if held and room < end - at:
                yield held
                held, room = [], CHUNK
            held.append((i, at, end))
            room -= end - at
    if held:
        yield held


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (one byte a sample, 128 is silence), with a seek point for every frame."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    for group in spans(map(len, payloads)):
        x = np.frombuffer(b"".join(payloads[i][a:b] for i, a, b in group), np.uint8).astype(np.int32) - 128
        numbers = [np.arange(a // BLOCK, -(-b // BLOCK)) for _, a, b in group]
        n = np.concatenate([np.minimum(BLOCK, b - k * BLOCK) for k, (_, _, b) in zip(numbers, group, strict=True)])
        made, at = encode_frames(x, n, np.concatenate(numbers)), 0
        for k, (i, _, _) in zip(numbers, group, strict=True):
            frames[i] += made[at : at + len(k)]
            at += len(k)
    return [_stream(p, f) for p, f in zip(payloads, frames, strict=True)]


POINT = np.dtype([("first", ">u8"), ("offset", ">u8"), ("n", ">u2")])


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = np.array([len(f) for f in frames], np.int64)
    points = np.zeros(len(frames), POINT)
    points["first"] = np.arange(len(frames)) * BLOCK
    points["offset"] = np.cumsum(sizes) - sizes
    points["n"] = np.minimum(BLOCK, len(payload) - points["first"].astype(np.int64))
    table = points[: ((1 << 24) - 1) // POINT.itemsize].tobytes()
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min(initial=0)).to_bytes(3, "big") + int(sizes.max(initial=0)).to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big")
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
    return b"".join([MAGIC, b"\x00", (34).to_bytes(3, "big"), info, md5, b"\x83", len(table).to_bytes(3, "big"), table, *frames])


def header_size(m: bytes, at: int) -> int:
    """Bytes of the frame header at this place, its CRC8 included; 0 if there is none."""
    if len(m) < at + 6 or m[at] != 0xFF or m[at + 1] & 0xFE != 0xF8:
        return 0
    size, rate = m[at + 2] >> 4, m[at + 2] & 15
    end = at + 4 + max(1, next((k for k in range(8) if not m[at + 4] << k & 0x80), 8)) + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(m) or not size or rate == 15:
        return 0
    crc = 0
    for b in m[at:end]:
        crc = int(CRC8[crc ^ b])
    return end + 1 - at if crc == m[end] else 0


def found_frames(m: bytes, at: int) -> list[int]:
    """Where frames begin, for streams without a full seek table: at headers whose CRC8 is right and where the frame before ends by its CRC16."""
    likely = [p.start() for p in re.finditer(rb"(?s)\xff(?=[\xf8\xf9])", m) if p.start() >= at and header_size(m, p.start())]
    if likely[:1] != [at]:
        raise ValueError("no frame behind the metadata")
    data, out = np.frombuffer(m, np.uint8), [at]
    for end in [*likely[1:], len(m)]:
        size = end - out[-1]
        if size > 4 and int(crc16(data, np.array([out[-1]]), np.array([size - 2]))[0]) == int.from_bytes(m[end - 2 : end], "big"):
            out.append(end)
    if out[-1] != len(m):
        raise ValueError("a frame's CRC16 is wrong")
    return out[:-1]


def layout(m: bytes) -> tuple[int, bytes, int, np.ndarray]:
    """(samples or 0 if not stated, MD5, samples of a full block, byte offsets of the frames) of a mono stream of 8-bit samples."""
    if m[:4] != MAGIC:
        raise ValueError("not a FLAC stream")
    at, last, samples, md5, block, points = 4, 0, 0, bytes(16), 0, np.zeros(0, POINT)
    while not last:
        last, kind, size = m[at] >> 7, m[at] & 127, int.from_bytes(m[at + 1 : at + 4], "big")
        body = m[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise ValueError("only one channel of 8-bit samples is read")
            samples, md5, block = packed & ((1 << 36) - 1), body[18:34], int.from_bytes(body[2:4], "big")
        elif kind == 3:
            points = np.frombuffer(body[: size // POINT.itemsize * POINT.itemsize], POINT)
        at += 4 + size
    n = points["n"].astype(np.int64)
    if samples and int(n.sum()) == samples and (points["first"].astype(np.int64) == np.cumsum(n) - n).all():
        return samples, md5, block, at + points["offset"].astype(np.int64)
    return samples, md5, block, np.array(found_frames(m, at) if len(m) > at else [], np.int64)


#: Bytes of a frame number by its first byte; samples of a block by its code (6 and 7: as the header says).
NUMBER_BYTES = np.array([max(1, next((k for k in range(8) if not b << k & 0x80), 8)) for b in range(256)])
BLOCK_SIZES = np.array([0, 192, *(576 << k for k in range(4)), 0, 0, *(256 << k for k in range(8))])


class Bits:
    """Reads bit fields at many places of a byte array at once."""

    def __init__(self, data: np.ndarray):
        self.wide = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(">u8").ravel().astype(np.uint64)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 57 bits or more from each bit position on, flush left."""
        return self.wide[at >> 3] << (at & 7).view(np.uint64)

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned fields of at most 57 bits; no width, no bits: 0."""
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        return (self.window(at) >> np.uint64(1) >> (63 - width).view(np.uint64)).view(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        v = self.read(at, width)
        return v - ((v >> np.maximum(width - 1, 0) & 1) << width)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """How many zero bits stand before the next one bit."""
        out, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(open_):
            found = 53 - np.frexp((self.window(at[open_] + out[open_]) >> np.uint64(11)).astype(np.float64))[1]
            out[open_] += found
            open_ = open_[found == 53]
            if len(open_) and int((at[open_] + out[open_]).max()) >> 3 >= len(self.wide):
                raise ValueError("a frame ends inside a code")
        return out


def decode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(samples as signed bytes, samples a frame, frame number, is it a sample number) of frames at byte ranges of data; 16 bytes follow the last.

    Header CRC8 and frame CRC16 are checked. Subframes may be constant, verbatim, fixed or linear predictors of any order,
    with wasted bits; residuals may be Rice-coded by either method, in any number of partitions, escaped ones included.
    """
    if (crc16(data, start, size - 2) != ((data[start + size - 2].astype(np.int64) << 8) | data[start + size - 1])).any():
        raise ValueError("a frame's CRC16 is wrong")
    b = data[start[:, None] + np.arange(16)].astype(np.int64)
    row = np.arange(len(start))
    digits = NUMBER_BYTES[b[:, 4]]
    number = np.where(digits == 1, b[:, 4], b[:, 4] & (0x7F >> digits))
    for j in range(1, int(digits.max(initial=1))):
        number = np.where(j < digits, number << 6 | b[row, np.minimum(4 + j, 15)] & 0x3F, number)
    code, rate, at = b[:, 2] >> 4, b[:, 2] & 15, 4 + digits
    n = np.where(code == 6, b[row, at] + 1, np.where(code == 7, (b[row, at] << 8 | b[row, at + 1]) + 1, BLOCK_SIZES[code]))
    head = at + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    crc = np.zeros(len(start), np.int64)
    for j in range(int(head.max(initial=0))):
        crc = np.where(j < head, CRC8[crc ^ b[:, min(j, 15)]], crc)
    if (crc != b[row, np.minimum(head, 15)]).any() or (b[:, 0] != 0xFF).any() or (b[:, 1] & 0xFE != 0xF8).any() or (n == 0).any():
        raise ValueError("a frame's header is wrong")
    if (b[:, 3] >> 4).any() or (b[:, 3] >> 1 & 7 > 1).any():
        raise ValueError("only one channel of 8-bit samples is read")
    bits = Bits(data)
    p = (start + head + 1) * 8
    kind, spoiled = bits.read(p + 1, 6), bits.read(p + 7, 1) == 1
    p += 8
    wasted = np.zeros(len(p), np.int64)
    wasted[spoiled] = bits.zeros(p[spoiled]) + 1
    p += wasted
    width = 8 - wasted
    known = (kind <= VERBATIM) | (kind >= FIXED) & (kind < FIXED + len(FIXED_COEFFICIENTS)) | (kind > LPC)
    if not known.all() or (width < 1).any():
        raise ValueError("a subframe is of no known kind")
    out_at = np.cumsum(n) - n
    x = np.empty(int(n.sum()), np.int8)
    for f in np.flatnonzero(kind <= VERBATIM).tolist():
        if kind[f] == VERBATIM and not wasted[f]:
            byte = int(p[f]) >> 3
            x[out_at[f] : out_at[f] + n[f]] = data[byte : byte + n[f]].view(np.int8)
        else:
            at = p[f] + (np.arange(n[f]) * width[f] if kind[f] == VERBATIM else np.zeros(1, np.int64))
            x[out_at[f] : out_at[f] + n[f]] = bits.signed(at, int(width[f])) << wasted[f]
    order = np.where(kind > LPC, kind - LPC, kind - FIXED)
    coded = np.flatnonzero(kind >= FIXED)
    grade = np.frexp(np.maximum(n - order, 1))[1] // 2  # frames of about one length make a grid that is mostly full
    for g in np.unique(grade[coded]):
        lanes = coded[grade[coded] == g]
        lanes = lanes[np.argsort(order[lanes] - n[lanes], kind="stable")]
        _predicted(bits, x, lanes, p[lanes], kind[lanes], order[lanes], n[lanes], width[lanes], wasted[lanes], out_at[lanes])
    return x, n, number, b[:, 1] & 1 == 1


def _predicted(bits: Bits, x: np.ndarray, lanes, p, kind, order, n, width, wasted, out_at) -> None:
    """Decode predicted subframes, one lane each, longest first: residuals step by step, then the predictors' sums."""
    most = int(order.max())
    rows = most + int((n - order).max())
    grid = np.zeros((rows, len(lanes)), np.int64)  # a lane's warm-up samples end at row `most`
    newest_last, shift = np.zeros((most, len(lanes)), np.int64), np.zeros(len(lanes), np.int64)
    for j in range(most):
        has = np.flatnonzero(order > j)
        grid[most - order[has] + j, has] = bits.signed(p[has] + j * width[has], width[has])
    p = p + order * width
    lpc = np.flatnonzero(kind > LPC)
    precision = bits.read(p[lpc], 4) + 1
    shift[lpc] = np.maximum(bits.signed(p[lpc] + 4, 5), 0)
    for j in range(most):
        has = order[lpc] > j
        newest_last[most - 1 - j, lpc[has]] = bits.signed(p[lpc[has]] + 9 + j * precision[has], precision[has])
    p[lpc] += 9 + order[lpc] * precision
    for o, coefficients in enumerate(FIXED_COEFFICIENTS):
        own = np.flatnonzero(kind == FIXED + o)
        for j, c in enumerate(coefficients if len(own) else ()):
            newest_last[most - 1 - j, own] = c
    method, parts = bits.read(p, 2), bits.read(p + 2, 4)
    if (method > 1).any():
        raise ValueError("a residual is coded in no known way")
    p = p + 6
    left = n - order
    # Where each lane's partitions begin, counted in residuals: the first lacks the warm-up samples.
    begins: dict[int, dict[int, list[int]]] = {}
    for lane in np.flatnonzero(parts > 0).tolist():
        for part in range(1, 1 << int(parts[lane])):
            at = part * (int(n[lane]) >> int(parts[lane])) - int(order[lane])
            if at < left[lane]:
                begins.setdefault(at, {}).setdefault(part, []).append(lane)
    rice, raw = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1, np.int64)

    def parameters(own: np.ndarray) -> None:
        k = bits.read(p[own], 4 + method[own])
        escaped = k == np.where(method[own] == 1, 31, 15)
        p[own] += 4 + method[own]
        rice[own] = np.where(escaped, 0, k)
        raw[own] = np.where(escaped, bits.read(p[own], 5), -1)
        p[own] += np.where(escaped, 5, 0)

    parameters(np.arange(len(lanes)))
    active = np.searchsorted(-left, -np.arange(rows - most), side="left")
    most_rice, any_raw = int(rice.max()), bool((raw >= 0).any())
    wide, one, eleven = bits.wide, np.uint64(1), np.uint64(11)
    down = (63 - rice).view(np.uint64)
    for i in range(rows - most):
        if i in begins:
            for part in sorted(begins[i]):
                parameters(np.array(begins[i][part]))
            most_rice, any_raw, down = int(rice.max()), bool((raw >= 0).any()), (63 - rice).view(np.uint64)
        m = active[i]
        q, k = p[:m], rice[:m]
        w = wide[q >> 3] << (q & 7).view(np.uint64)
        zeros = 53 - np.frexp((w >> eleven).astype(np.float64))[1].astype(np.int64)
        if any_raw or int(zeros.max()) + most_rice > 48:
            plain = raw[:m] < 0
            zeros = np.zeros(m, np.int64)
            zeros[plain] = bits.zeros(q[plain])
            z = zeros << k | bits.read(q + zeros + 1, k)
            signed = bits.signed(q, np.maximum(raw[:m], 0))
            z = np.where(plain, z, signed << 1 ^ signed >> 63)
            p[:m] = q + np.where(plain, zeros + 1 + k, raw[:m])
        else:
            z = zeros << k | (((w << zeros.view(np.uint64)) << one) >> one >> down[:m]).view(np.int64)
            p[:m] = q + zeros + (1 + k)
        grid[most + i, :m] = z
    np.bitwise_xor(grid[most:] >> 1, -(grid[most:] & 1), out=grid[most:])
    if most:
        for i in range(rows - most):
            m = active[i]
            grid[most + i, :m] += (grid[i : most + i, :m] * newest_last[:, :m]).sum(axis=0) >> shift[:m]
    done = (grid << wasted).astype(np.int8).T
    place = np.arange(rows) - (most - order)[:, None]
    held = (place >= 0) & (place < n[:, None])
    x[np.repeat(out_at, n) + place[held]] = done[held]


def decode(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """Each stream's PCM blocks (first sample, a byte a sample) in order. ValueError if a checksum, number or MD5 is wrong."""
    plans = [layout(m) for m in media]
    out: list[list[tuple[int, bytes]]] = [[] for _ in media]
    sums, ends = [hashlib.md5() for _ in media], [0] * len(media)
    frames = [(i, int(a), int(b)) for i, (m, plan) in enumerate(zip(media, plans, strict=True)) for a, b in zip(plan[3], np.append(plan[3][1:], len(m)), strict=False)]
    at = 0
    while at < len(frames):
        stop, room = at, CHUNK
        while stop < len(frames) and (stop == at or room >= frames[stop][2] - frames[stop][1]):
            room -= frames[stop][2] - frames[stop][1]
            stop += 1
        group = frames[at:stop]
        size = np.array([b - a for _, a, b in group])
        data = np.frombuffer(b"".join([*(media[i][a:b] for i, a, b in group), bytes(16)]), np.uint8)
        x, n, number, by_sample = decode_frames(data, np.cumsum(size) - size, size)
        signed, plain, first = x.tobytes(), (x.view(np.uint8) ^ 128).tobytes(), 0
        for (i, _, _), count, own, free in zip(group, n.tolist(), number.tolist(), by_sample.tolist(), strict=True):
            if own != (ends[i] if free else len(out[i])):
                raise ValueError("a frame's number is wrong")
            sums[i].update(signed[first : first + count])
            out[i].append((ends[i], plain[first : first + count]))
            ends[i] += count
            first += count
        at = stop
    for (samples, md5, _, _), end, own in zip(plans, ends, sums, strict=True):
        if samples and samples != end or any(md5) and md5 != own.digest():
            raise ValueError("a stream's length or MD5 is wrong")
    return out


def padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % UNIT if b else UNIT)


def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        out: list[bytes] = []
        for _, held in slices(utf8_of(texts), CHUNK):
            out += encode([padded(b) for b in held])
        yield pa.array(out, pa.binary())
        give_back()


def flac_column(text: Column) -> Column:
    """Binary column: the text's UTF-8 bytes (null: none), zero-padded to a positive multiple of UNIT, as FLAC."""
    return F.arrow_udf(_encode, "binary")(text)


BLOCKS = "array<struct<block_no:long,first_sample:long,n_samples:long,pcm:binary>>"


def _blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("block_no", pa.int64()), ("first_sample", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())]))
    for media in batches:
        out: list = []
        for k in range(0, len(media), 64):
            held = media.slice(k, 64).to_pylist()
            read = iter(decode([m for m in held if m is not None]))
            out += [None if m is None else [{"block_no": j, "first_sample": a, "n_samples": len(pcm), "pcm": pcm} for j, (a, pcm) in enumerate(next(read))] for m in held]
        yield pa.array(out, kind)
        give_back()


def pcm_blocks(df: DataFrame, media_col: str, *keys: str) -> DataFrame:
    """One row per frame of each stream: keys, block_no, first_sample, n_samples, pcm (a byte a sample); nulls have none.

    first_sample is where a reader seeks to: blocks sorted by it are the samples. Streams are mono with 8-bit samples; one
    that is broken fails the job.
    """
    return df.select(*keys, F.explode(F.arrow_udf(_blocks, BLOCKS)(F.col(media_col))).alias("b")).select(*keys, "b.*")


def feature_of(blocks: list[tuple[int, bytes]]) -> str:
    """Number, peak, power and zero crossings of the samples of PCM blocks, as text."""
    n = peak = power = crossings = 0
    sign = None
    for at in range(0, len(blocks), 256):
        x = np.frombuffer(b"".join(pcm for _, pcm in blocks[at : at + 256]), np.uint8).astype(np.int32) - 128
        below = x < 0
        n, peak, power = n + len(x), max(peak, int(np.abs(x).max())), power + int((x * x).sum(dtype=np.int64))
        crossings += int((below[1:] != below[:-1]).sum()) + (sign is not None and sign != below[0])
        sign = below[-1]
    return f"samples={n};peak={peak};power={power};crossings={crossings}"


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"


def _stored_and_read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in READ.split(", ")]
    for texts in batches:
        columns: list[list] = [[] for _ in names]
        for _, held in slices(utf8_of(texts), CHUNK):
            media = encode([padded(b) for b in held])
            for m, blocks in zip(media, decode(media), strict=True):
                payload = b"".join(pcm for _, pcm in blocks)
                for c, v in zip(columns, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(blocks), len(blocks)), strict=True):
                    c.append(v)
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        give_back()


def media_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload and media digests, feature, n_blocks) of every row: each text is stored as FLAC, and the
    stored bytes are read back into PCM blocks in the same task, so no stream leaves it. Null and empty texts have a
    payload of UNIT zero bytes; equal texts have equal values; no row is dropped.
    """
    read = F.arrow_udf(_stored_and_read, READ)
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), read(F.col("text")).alias("r"))
    return stored.select("doc_id", "n_bytes", "r.*")
