"""FLAC against a plain reader and writer of the format that share nothing with the operator."""

import hashlib
import random
import zlib

import pytest

from captionloom.llm import flac
from tests.llm.test_documents import ROWS, docs, empty, same, sha  # noqa: F401  fixtures


def crc(data, poly, bits):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
    return c


class Reader:
    def __init__(self, data, at=0):
        self.data, self.at = data, at

    def bits(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def signed(self, n):
        v = self.bits(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        n = 0
        while not self.bits(1):
            n += 1
        return n


def plain_decode(m):
    """Samples of a stream as the encoder under test writes it (one partition, no wasted bits), a frame at a time."""
    r, last, total = Reader(m, 32), 0, 0
    while not last:
        last, kind, size = r.bits(1), r.bits(7), r.bits(24)
        body = m[r.at // 8 : r.at // 8 + size]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34]
        r.at += 8 * size
    out = []
    while r.at < 8 * len(m):
        begin = r.at // 8
        assert r.bits(15) == 0x7FFC and r.bits(1) == 0
        code = r.bits(4)
        r.bits(12)
        lead = r.bits(8)
        while lead >= 0xC0:
            r.bits(8)
            lead = lead << 1 & 0xFF if lead << 1 & 0x80 and lead << 1 & 0x40 else 0
        n = r.bits(16) + 1 if code == 7 else 1024
        assert r.bits(8) == crc(m[begin : r.at // 8 - 1], 7, 8)
        kind = r.bits(8) >> 1
        if kind == 0:
            x = [r.signed(8)] * n
        elif kind == 1:
            x = [r.signed(8) for _ in range(n)]
        else:
            o = kind - 8 if kind < 32 else kind - 31
            x = [r.signed(8) for _ in range(o)]
            c, shift = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[o], 0
            if kind >= 32:
                precision, shift = r.bits(4) + 1, r.signed(5)
                c = [r.signed(precision) for _ in range(o)]
            assert r.bits(6) == 0
            k = r.bits(4)
            for _ in range(n - o):
                z = r.unary() << k | r.bits(k)
                x.append((z >> 1 ^ -(z & 1)) + (sum(a * b for a, b in zip(c, reversed(x), strict=False)) >> shift))
        r.at = -(-r.at // 8) * 8
        assert r.bits(16) == crc(m[begin : r.at // 8 - 2], 0x8005, 16)
        out += x
    assert len(out) == total and hashlib.md5(bytes(v & 255 for v in out)).digest() == md5
    return bytes(v + 128 for v in out)


class Writer:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def data(self):
        return bytes(int(self.s[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(self.s), 8))


def predicted(w, x, kind, coefficients, shift, partitions, method, wasted, escapes, r):
    """A subframe's bits: `partitions` is the partition order, `escapes` the partitions whose residuals are plain."""
    o, y = len(coefficients), [v >> wasted for v in x]
    w.put(kind << 1 | (wasted > 0), 8)
    if wasted:
        w.put(1, wasted)
    for v in y[:o]:
        w.put(v, 8 - wasted)
    if kind >= 32:
        w.put(11, 4)
        w.put(shift, 5)
        for c in coefficients:
            w.put(c, 12)
    e = [y[i] - (sum(c * y[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(o, len(y))]
    w.put(method, 2)
    w.put(partitions, 4)
    size, at = len(y) >> partitions, 0
    for p in range(1 << partitions):
        part = e[at : at + size - (o if p == 0 else 0)]
        at += len(part)
        if p in escapes:
            w.put(31 if method else 15, 5 if method else 4)
            n = max([0, *(v.bit_length() + 1 for v in part)])
            w.put(n, 5)
            for v in part:
                w.put(v, n)
            continue
        k = r.randrange(0, 6)
        w.put(k, 5 if method else 4)
        for v in part:
            z = 2 * v if v >= 0 else -2 * v - 1
            w.put(1, (z >> k) + 1)
            w.put(z, k)


def foreign(r, frames=9, by_sample=False):
    """A stream as another encoder may write it: no seek table, odd block sizes, every kind of subframe."""
    samples, body = [], b""
    for f in range(frames):
        n = r.choice([192, 576, 256, 100, 1000])
        kind = r.choice([0, 1, 8, 9, 10, 11, 12, 32, 33, 35, 39, 63])
        wasted = r.choice([0, 0, 1, 3])
        x = [max(-128, min(127, int(60 * r.random() + 50 * ((i // 13) % 2)) - 60)) >> wasted << wasted for i in range(n)] if kind else [r.randrange(-128, 128) >> wasted << wasted] * n
        code = {192: 1, 576: 2, 256: 8}.get(n, 6 if n <= 256 else 7)
        number = flac.numbered(len(samples) if by_sample else f)
        head = bytes([0xFF, 0xF8 | by_sample, code << 4 | r.choice([0, 12, 13]), r.choice([0, 2])])
        head += number + ((n - 1).to_bytes(code - 5, "big") if code in (6, 7) else b"") + {12: b"\x08", 13: b"\x1f\x40"}.get(head[2] & 15, b"")
        w = Writer()
        if kind <= 1:
            w.put(kind << 1 | (wasted > 0), 8)
            if wasted:
                w.put(1, wasted)
            for v in x if kind else x[:1]:
                w.put(v >> wasted, 8 - wasted)
        else:
            o = kind - 8 if kind < 32 else kind - 31
            c = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[o] if kind < 32 else [r.randrange(-900 // o, 1200 // o) for _ in range(o)]
            order = r.choice([0, 1, 2]) if n % 4 == 0 and n >> 2 > o else 0
            predicted(w, x, kind, c, 0 if kind < 32 else r.randrange(6, 12), order, r.randrange(2), wasted, {p for p in range(1 << order) if r.random() < 0.3}, r)
        frame = head + bytes([crc(head, 7, 8)]) + w.data()
        body += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
        samples += x
    info = (192).to_bytes(2, "big") + (1000).to_bytes(2, "big") + bytes(6) + ((8000 << 44) | (7 << 36) | len(samples)).to_bytes(8, "big") + hashlib.md5(bytes(v & 255 for v in samples)).digest()
    return b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x84\x00\x00\x08" + bytes(8) + body, bytes(v + 128 for v in samples)


def payload(blocks):
    return b"".join(pcm for _, pcm in blocks)


def test_streams_of_other_encoders():
    r = random.Random(5)
    made = [foreign(r, by_sample=k % 2) for k in range(40)]
    read = flac.decode([m for m, _ in made])
    assert [payload(b) for b in read] == [p for _, p in made]
    assert all([a for a, _ in b] == [sum(len(pcm) for _, pcm in b[:k]) for k in range(len(b))] for b in read)


def test_frames():
    r = random.Random(2)
    media = [bytes(64), b"a" * 9000, bytes(r.randrange(256) for _ in range(4100)), bytes((i * i // 50) % 256 for i in range(1024 * 130)), bytes(i // 9 % 256 for i in range(5000)), b"\xff" * 64 + b"\x00" * 64, ("Some words of text, and more of them. " * 90).encode(), b""]
    streams = flac.encode(media)
    assert [payload(b) for b in flac.decode(streams)] == media
    assert [plain_decode(m) for k, m in enumerate(streams) if k not in (3, 7)] == [m for k, m in enumerate(media) if k not in (3, 7)]
    bare = [m[:4] + b"\x80" + m[5:42] + m[46 + int.from_bytes(m[43:46], "big") :] for m in streams]
    assert [payload(b) for b in flac.decode(bare)] == media  # frames found by their headers
    for at in (9, 60, -1, -40):
        broken = bytearray(streams[3])
        broken[at if at < 0 else len(broken) // 2 + at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    swapped = bytearray(streams[1])
    swapped[26] ^= 1  # the MD5
    for bad in (bytes(swapped), b"RIFF" + streams[0][4:], streams[3][:-900]):
        with pytest.raises(ValueError):
            flac.decode([bad])


def test_long_streams_pass_in_parts(monkeypatch):
    monkeypatch.setattr(flac, "CHUNK", 4096)
    media = [bytes(i * 7 % 251 for i in range(n)) for n in (64, 30_000, 4096, 9_984, 64)]
    assert [payload(b) for b in flac.decode(flac.encode(media))] == media


def test_media_report(docs, empty):  # noqa: F811
    rows = flac.media_report(docs).collect()
    stored = {t: bytes(m) for t, m in docs.select("text", flac.flac_column(docs["text"])).collect()}
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        x = [v - 128 for v in p]
        feature = f"samples={len(x)};peak={max(map(abs, x))};power={sum(v * v for v in x)};crossings={sum((a < 0) != (c < 0) for a, c in zip(x, x[1:], strict=False))}"
        want.append((i, len(b), len(p), sha(p), zlib.crc32(p[-64:]), len(stored[t]), sha(stored[t]), feature, -(-len(p) // 1024)))
    same(map(tuple, rows), want)
    assert all(plain_decode(stored[t]).rstrip(b"\x00") == (t or "").encode().rstrip(b"\x00") for _, t in ROWS[:60])
    assert flac.media_report(empty).count() == 0


def test_blocks(spark, docs):  # noqa: F811
    stored = docs.where("doc_id = 104 OR doc_id = 0").select("doc_id", "k_id", flac.flac_column(docs["text"]).alias("media"))
    stored = stored.unionByName(spark.createDataFrame([(7, 1, None)], stored.schema))
    blocks = flac.pcm_blocks(stored, "media", "doc_id", "k_id").orderBy("doc_id", "first_sample").collect()
    text = dict(ROWS)[104].encode()
    mine = [b for b in blocks if b.doc_id == 104]
    assert b"".join(bytes(b.pcm) for b in mine)[: len(text)] == text and [(b.first_sample, b.block_no) for b in mine] == [(1024 * k, k) for k in range(len(mine))]
    assert [bytes(b.pcm) for b in blocks if b.doc_id == 0] == [bytes(64)] and not [b for b in blocks if b.doc_id == 7]
