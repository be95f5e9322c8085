"""FLAC media columns: byte payloads as 8-bit mono FLAC, and FLAC back to seekable PCM blocks.

`encode_flac` adds a FLAC stream (fixed predictors 0-4, a quantised linear predictor, constant and
verbatim subframes; Rice-coded residuals; a SEEKTABLE) to each row; `decode_flac` reads any
8-bit mono stream of the format - every predictor order up to 32, Rice partitions with both
parameter widths, escaped partitions, wasted bits - checks each frame's CRC-8 and CRC-16 and the
stream's MD5, and returns PCM blocks with their sample offsets.

All frames of a batch are decoded side by side: a lane is a run of frames between two seek points,
and one numpy step decodes one sample of every lane, so that Python's cost is spread over lanes.
Work is per row and batches are cut into slices of SLICE bytes, so memory does not grow with a
partition.  A null payload gives a null stream; a null stream gives null blocks and a null error; a
damaged stream gives null blocks and the reason in `error`, and leaves the streams beside it alone; empty payloads give streams
without frames.  A long payload is only more frames (a cell holds 2 GB at most, and no stream may claim more); repeated rows are
coded each; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import wide_rows

BLOCK = 256  # samples in a frame
SEEK_FRAMES = 8  # frames between seek points
SLICE = 4 << 20  # bytes of samples handled at once
MOST_SAMPLES = (1 << 31) - 1  # bytes that a cell of a table can hold
LPC_ORDER = 4
LPC_PRECISION = 8

# Fixed values of the format: the fixed predictors' coefficients, newest sample first.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    v = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        v = np.where(v >> (bits - 1) & 1, v << 1 ^ poly, v << 1) & ((1 << bits) - 1)
    return v


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
LEADING_ZEROS_16 = np.array([16 - int(x).bit_length() for x in range(1 << 16)], dtype=np.int64)


def crc_ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[start:start + length] for many ranges, one byte of every range at a step."""
    table, out = (CRC8, np.zeros(len(start), np.uint32)) if bits == 8 else (CRC16, np.zeros(len(start), np.uint32))
    if not len(start):
        return out
    order = np.argsort(-length, kind="stable")  # ranges that go on stay in front
    start, length = start[order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    acc = np.zeros(len(start), np.uint32)
    for i, n in enumerate(live):
        a = acc[:n]
        acc[:n] = (a << 8 & 0xFF00 if bits == 16 else 0) ^ table[(a >> (bits - 8) ^ data[start[:n] + i]) & 0xFF]
    out[order] = acc
    return out


# ---------------------------------------------------------------- encoding


def _lpc(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised predictors of LPC_ORDER for each frame (coefficients, shift) and their residuals."""
    x = s.astype(np.int32)
    r = [np.einsum("ij,ij->i", x[:, : x.shape[1] - j], x[:, j:]).astype(np.float64) for j in range(LPC_ORDER + 1)]
    err, a = r[0] + 1e-9, np.zeros((LPC_ORDER, len(s)))
    for i in range(LPC_ORDER):  # Levinson-Durbin for all frames at once
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / err
        old = a.copy()
        a[i] = k
        for j in range(i):
            a[j] = old[j] - k * old[i - 1 - j]
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.abs(a).max(0)
    shift = np.clip(LPC_PRECISION - 1 - np.ceil(np.log2(np.maximum(top, 1e-9))).astype(np.int64) - 1, 0, 14)
    c = np.clip(np.rint(a * (1 << shift)), -(1 << LPC_PRECISION - 1), (1 << LPC_PRECISION - 1) - 1).astype(np.int64)
    p = np.zeros_like(x)
    for j in range(LPC_ORDER):
        p[:, j + 1 :] += c[j][:, None].astype(np.int32) * x[:, : -j - 1]
    return c, shift, x - (p >> shift[:, None].astype(np.int32))


def encode_frames(raw: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of up to BLOCK unsigned bytes (rows of raw, n of them used): a buffer, starts, lengths."""
    count, width = raw.shape
    at = np.arange(width)
    valid = at < n[:, None]
    s = raw.astype(np.int16) - 128
    s[~valid] = 0
    # predictor: the one with the least sum of absolute residuals
    residual, costs, d = [s], [], s
    for _ in range(4):
        d = np.diff(d, axis=1, prepend=np.int16(0))
        residual.append(d)
    c, shift, lpc = _lpc(s)
    residual.append(lpc)
    orders = np.array([0, 1, 2, 3, 4, LPC_ORDER])
    partial = ~valid.all(1)
    for k, res in zip(orders, residual, strict=True):
        mag = np.abs(res)
        if partial.any():
            mag[partial] *= valid[partial]
        costs.append(mag[:, k:].sum(1, dtype=np.int32).astype(np.int64) + 8 * k + (24 if len(costs) == 5 else 0))
    short = n <= 2 * LPC_ORDER
    costs[5][short] = costs[5].max(initial=0) + 1
    best = np.argmin(np.stack(costs), axis=0)
    best[short] = 0
    order = orders[best]
    res = np.empty((count, width), np.int32)
    for j, own in enumerate(residual):
        on = best == j
        res[on] = own[on]
    used = valid & (at >= order[:, None])
    zig = np.where(used, res << 1 ^ res >> 31, 0)
    left = used.sum(1)
    mean = zig.sum(1) / np.maximum(left, 1)
    near = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int64), 0, 13)
    tries = [(zig >> (near + j)[:, None]).sum(1) + (near + j + 1) * left for j in (0, 1)]
    rice = near + (tries[1] < tries[0])
    least = np.minimum(*tries)
    is_lpc = best == 5
    constant = (s == s[:, :1]).all(1, where=valid)
    verbatim = ~constant & (least + 8 * order + 10 + np.where(is_lpc, 9 + LPC_PRECISION * LPC_ORDER, 0) >= 8 * n)
    # symbols: type | warm-up | LPC head | coefficients | residual head | samples
    head = 1 + 4 + 1 + LPC_ORDER + 1
    w, v, z = (np.zeros((count, head + width), np.int32) for _ in range(3))  # bits written, value, zeros before
    plain = ~constant & ~verbatim
    w[:, 0] = 8
    v[:, 0] = np.select([constant, verbatim, is_lpc], [0, 2, (32 + LPC_ORDER - 1) << 1], (8 + order) << 1)
    for j in range(4):
        on = plain & (order > j) | constant & (j == 0)
        w[on, 1 + j], v[on, 1 + j] = 8, s[on, j] & 255
    on = plain & is_lpc
    w[on, 5], v[on, 5] = 9, (LPC_PRECISION - 1) << 5 | shift[on]
    for j in range(LPC_ORDER):
        w[on, 6 + j], v[on, 6 + j] = LPC_PRECISION, c[j][on] & 255
    w[plain, head - 1], v[plain, head - 1] = 10, rice[plain]
    k = rice[:, None].astype(np.int32)
    live = used & plain[:, None]
    w[:, head:] = np.where(live, k + 1, np.where(verbatim[:, None] & valid, 8, 0))
    v[:, head:] = np.where(live, 1 << k | zig & (1 << k) - 1, np.where(verbatim[:, None], s & 255, 0))
    z[:, head:] = np.where(live, zig >> k, 0)
    ends = np.cumsum(w + z, axis=1, dtype=np.int64)
    body = (ends[:, -1] + 7) // 8
    # frame heads, byte by byte
    full = n == 256
    cells = np.zeros((count, 16), np.uint8)
    cells[:, 0], cells[:, 1], cells[:, 2], cells[:, 3] = 0xFF, 0xF8, np.where(full, 0x80, 0x60), 0x02
    size = np.full(count, 4)
    more = np.select([number < 0x80, number < 0x800, number < 0x10000, number < 0x200000, number < 0x4000000], [0, 1, 2, 3, 4], 5)
    rows = np.arange(count)
    lead = np.where(more == 0, 0, 0xFF00 >> (more + 1) & 0xFF)
    cells[rows, size] = lead | number >> 6 * more
    size += 1
    for j in range(5):
        on = more > j
        cells[rows[on], size[on]] = 0x80 | number[on] >> 6 * (more[on] - 1 - j) & 0x3F
        size[on] += 1
    on = ~full
    cells[rows[on], size[on]] = n[on] - 1
    size[on] += 1
    cells[rows, size] = crc_ranges(cells.ravel(), rows * 16, size, 8)
    size += 1
    length = size + body + 2
    start = np.cumsum(length) - length
    e = ends + ((start + size) * 8)[:, None]
    on = w > 0
    e, val = e[on] - 1, v[on]
    b, val = e >> 3, val << 7 - (e & 7)
    total = int(length.sum())
    buf = np.bincount(b, val & 255, total)
    for j in (1, 2):
        up = val >> 8 * j & 255
        nz = up > 0
        buf += np.bincount(b[nz] - j, up[nz], total)
    buf = buf.astype(np.uint8)
    for j in range(16):
        on = size > j
        buf[start[on] + j] = cells[on, j]
    crc = crc_ranges(buf, start, length - 2, 16)
    buf[start + length - 2], buf[start + length - 1] = crc >> 8, crc & 255
    return buf, start, length


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    frames = [-(-len(p) // BLOCK) for p in payloads]
    owner = np.repeat(np.arange(len(payloads)), frames)
    first = np.cumsum(frames) - frames if payloads else np.zeros(0, int)
    number = np.arange(len(owner)) - (first[owner] if len(owner) else 0)
    flat = np.frombuffer(b"".join(p + bytes(-len(p) % BLOCK) for p in payloads), np.uint8).reshape(-1, BLOCK)
    lengths = np.array([len(p) for p in payloads], np.int64)
    n = np.minimum(BLOCK, lengths[owner] - number * BLOCK) if len(owner) else np.zeros(0, int)
    parts, sizes = [], []
    for a in range(0, len(flat), SLICE // 4 // BLOCK):
        cut = slice(a, a + SLICE // 4 // BLOCK)
        buf, _, size = encode_frames(flat[cut], n[cut], number[cut])
        parts.append(buf.tobytes())
        sizes.append(size)
    coded = b"".join(parts)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    out = []
    for i, p in enumerate(payloads):
        a, b = int(first[i]), int(first[i]) + frames[i]
        base = int(ends[a - 1]) if a else 0
        stop = int(ends[b - 1]) if b else 0
        points = b"".join(struct.pack(">QQH", (f - a) * BLOCK, (int(ends[f - 1]) if f else 0) - base, int(n[f])) for f in range(a, b, SEEK_FRAMES))
        digest = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        packed = 8000 << 44 | 0 << 41 | 7 << 36 | len(p)
        info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + packed.to_bytes(8, "big") + digest
        last = not points
        out.append(b"fLaC" + bytes([0x80 * last, 0, 0, 34]) + info + (b"" if last else b"\x83" + len(points).to_bytes(3, "big") + points) + coded[base:stop])
    return out


# ---------------------------------------------------------------- decoding


def _stream_head(data: bytes) -> tuple[int, bytes, int, list[tuple[int, int]]]:
    """Samples, MD5, start of the frames, seek points (sample, byte) of a stream."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, total, md5, points, seen = 4, 0, b"", [], False
    while True:
        if at + 4 > len(data):
            raise ValueError("metadata is cut short")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if len(block) < size:
            raise ValueError("metadata is cut short")
        if kind & 127 == 0:
            packed = int.from_bytes(block[10:18], "big")
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise ValueError("not 8-bit mono")
            total, md5, seen = packed & (1 << 36) - 1, block[18:34], True
            longest = int.from_bytes(block[2:4], "big") or 65535
        elif kind & 127 == 3:
            points = [p[:2] for p in struct.iter_unpack(">QQH", block) if p[0] != (1 << 64) - 1]
        at += 4 + size
        if kind & 128:
            break
    if not seen:
        raise ValueError("no STREAMINFO")
    # each frame begins with a sync code and holds a block of samples at most, so the bytes bound what a stream may claim
    body = np.frombuffer(data, np.uint8, offset=at)
    syncs = int(np.count_nonzero((body[:-1] == 0xFF) & (body[1:] & 0xFE == 0xF8))) if len(body) > 1 else 0
    if total > min(syncs * longest, MOST_SAMPLES):
        raise ValueError("claims more samples than it can hold")
    return total, md5, at, points


class _Bits:
    """Big-endian bit reads at many positions at once."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint32)
        self.data, self.limit = d, (len(data) + 8) * 8
        self.word = (d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]).astype(np.int64)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """32 bits of which the first 25 are sure."""
        pos = np.minimum(pos, self.limit)
        return self.word[pos >> 3] << (pos & 7) & 0xFFFFFFFF

    def read(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Up to 25 bits, unsigned."""
        return self.peek(pos) >> 32 - n

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        zeros = LEADING_ZEROS_16[self.peek(pos) >> 16]
        while (more := (zeros % 16 == 0) & (zeros > 0) & (pos + zeros < self.limit)).any():
            step = LEADING_ZEROS_16[self.peek(pos[more] + zeros[more]) >> 16]
            if not step.any():
                break
            zeros[more] += step
            if (step < 16).all():
                break
        return zeros


def _signed(v: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return v - ((v >> n - 1 & 1) << n)


def _rice(bits: _Bits, p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals with parameters k, and the bits that they take."""
    word = bits.peek(p)
    zeros = LEADING_ZEROS_16[word >> 16]
    width = zeros + 1 + k
    far = (zeros >= 16) | (width > 25)
    low = (word << zeros + 1 & 0xFFFFFFFF) >> 32 - k
    if far.any():
        zeros[far] = bits.unary(p[far])
        low[far] = bits.peek(p[far] + zeros[far] + 1) >> 32 - k[far]
        width[far] = zeros[far] + 1 + k[far]
    u = zeros << k | low
    return u >> 1 ^ -(u & 1), width


def decode_wave(bits: _Bits, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The frames that start at the bytes pos: samples (sample, frame), sizes, next bytes, faults."""
    d, lanes = bits.data, len(pos)
    bad = np.zeros(lanes, np.int64)  # 1 not a frame, 2 head checksum, 3 frame checksum, 4 reserved code
    safe = lambda p: np.minimum(p, len(d) - 1)
    byte = lambda p: d[safe(p)].astype(np.int64)
    b2, b3 = byte(pos + 2), byte(pos + 3)
    bad[(byte(pos) != 0xFF) | (byte(pos + 1) & 0xFE != 0xF8) | (b3 >> 4 != 0) | ~np.isin(b3 >> 1 & 7, (0, 1))] = 1
    lead = byte(pos + 4)
    extra = np.clip(np.where(lead < 0x80, 0, LEADING_ZEROS_16[(lead ^ 0xFF) << 8] - 1), 0, 6)
    q = pos + 5 + extra
    code, rate = b2 >> 4, b2 & 15
    size = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.clip(code - 2, 0, 3), byte(q) + 1, (byte(q) << 8 | byte(q + 1)) + 1, 256 << np.clip(code - 8, 0, 7)], 0)
    bad[(size == 0) & (bad == 0)] = 4
    q = q + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    bad[(crc_ranges(d, pos, np.minimum(q, len(d) - 1) - pos, 8) != byte(q)) & (bad == 0)] = 2
    at = (q + 1) * 8
    kind = bits.read(at, 8)
    at += 8
    wasted = np.zeros(lanes, np.int64)
    if (on := (kind & 1) > 0).any():
        wasted[on] = bits.unary(at[on]) + 1
        at[on] += wasted[on]
    kind = kind >> 1
    depth = np.maximum(8 - wasted, 1)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    bad[~((kind < 2) | fixed | lpc) & (bad == 0)] = 4
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    size[bad > 0] = 0
    order = np.minimum(order, size)
    deep = int(order.max(initial=0))
    most = int(size.max(initial=0))
    x = np.zeros((deep + most, lanes), np.int64)
    coef, shift = np.zeros((deep, lanes), np.int64), np.zeros(lanes, np.int64)
    for k in range(1, 5):
        for j, c in enumerate(FIXED[k]):
            if deep > j:
                coef[deep - 1 - j, fixed & (order == k)] = c
    if (on := (kind == 0) & (size > 0)).any():  # constant
        x[deep:, on] = _signed(bits.read(at[on], depth[on]), depth[on])
        at[on] += depth[on]
    if (on := np.nonzero((kind == 1) & (size > 0))[0]).size:  # verbatim
        for i in range(int(size[on].max())):
            own = on[size[on] > i]
            x[deep + i, own] = _signed(bits.read(at[own], depth[own]), depth[own])
            at[own] += depth[own]
    coded = np.nonzero((kind > 1) & (size > 0))[0]
    coded = coded[np.argsort(-size[coded], kind="stable")]  # lanes that go on stay in front: slices, not gathers
    p, n_of, o_of, width, by_lpc = at[coded], size[coded], order[coded], depth[coded], lpc[coded]
    c_of, s_of, y = coef[:, coded], shift[coded], np.zeros((deep + most, len(coded)), np.int64)
    faults = np.zeros(len(coded), np.int64)
    k = np.zeros(len(coded), np.int64)  # Rice parameter, or width of an escaped partition
    escaped, wide = np.zeros(len(coded), bool), np.zeros(len(coded), np.int64)
    until, span = np.full(len(coded), 1 << 30), np.zeros(len(coded), np.int64)
    heads = set(o_of.tolist())
    turn = set(heads)  # samples at which some lane starts a partition
    last_head = max(heads, default=0)
    fronts = np.searchsorted(-n_of, -np.arange(most), side="left")
    for i in range(most):
        m = int(fronts[i])
        if not m:
            break
        if i in heads:
            on = np.nonzero(o_of == i)[0]
            if (own := on[by_lpc[on]]).size:
                precision = bits.read(p[own], 4) + 1
                s_of[own] = _signed(bits.read(p[own] + 4, 5), 5)
                p[own] += 9
                faults[own[(s_of[own] < 0) | (precision > 15)]] = 4
                s_of[own] = np.maximum(s_of[own], 0)
                for j in range(int(o_of[own].max())):
                    has = o_of[own] > j
                    c_of[deep - 1 - j, own[has]] = _signed(bits.read(p[own[has]], precision[has]), precision[has])
                    p[own[has]] += precision[has]
            method = bits.read(p[on], 2)
            faults[on[method > 1]] = 4
            wide[on] = 4 + (method == 1)
            parts = bits.read(p[on] + 2, 4)
            span[on] = n_of[on] >> parts
            faults[on[(span[on] < o_of[on]) | (span[on] << parts != n_of[on])]] = 4
            span[on] = np.maximum(span[on], 1)
            p[on] += 6
            until[on] = i
            for a, b in {*zip(span[on].tolist(), n_of[on].tolist(), strict=True)}:
                turn.update(range(a, b, a))
        if i in turn and (on := np.nonzero(until[:m] <= i)[0]).size:
            value = bits.read(p[on], wide[on])
            p[on] += wide[on]
            escaped[on] = value == (1 << wide[on]) - 1
            k[on] = value
            raw = on[escaped[on]]
            k[raw] = bits.read(p[raw], 5)
            p[raw] += 5
            until[on] = (i // span[on] + 1) * span[on]
            any_escaped = escaped.any()
        if i < last_head or any_escaped:  # some lanes read plain numbers
            plain = o_of[:m] > i
            flat = np.nonzero(plain | escaped[:m])[0]
            rest = np.nonzero(~(plain | escaped[:m]))[0]
            r, step = np.zeros(m, np.int64), np.zeros(m, np.int64)
            n = np.where(plain, width[:m], k[:m])[flat]
            step[flat] = n
            n1 = np.maximum(n, 1)
            r[flat] = np.where(n > 0, _signed(bits.read(p[flat], n1), n1), 0)
            r[rest], step[rest] = _rice(bits, p[rest], k[rest])
            p[:m] += step
            if deep:
                r += np.where(plain, 0, (c_of[:, :m] * y[i : i + deep, :m]).sum(0) >> s_of[:m])
        else:
            r, step = _rice(bits, p[:m], k[:m])
            p[:m] += step
            if deep:
                r += np.einsum("ij,ij->j", c_of[:, :m], y[i : i + deep, :m]) >> s_of[:m]
        y[deep + i, :m] = r
    x[:, coded], at[coded] = y, p
    bad[coded[faults > 0]] = faults[faults > 0]
    end = at + 7 >> 3
    good = np.nonzero(bad == 0)[0]
    over = end[good] + 2 > len(d) - 16
    bad[good[over]] = 3
    good = good[~over]
    crc = crc_ranges(d, pos[good], end[good] - pos[good], 16)
    bad[good[crc != (byte(end[good]) << 8 | byte(end[good] + 1))]] = 3
    return x[deep:] << wasted, size, end + 2, bad


FAULTS = {1: "no frame where one is due", 2: "wrong frame head checksum", 3: "wrong frame checksum", 4: "reserved code"}


def decode_streams(streams: list[bytes | None]) -> list[tuple[bytes | None, str | None]]:
    """PCM (unsigned 8-bit) or the fault of each stream; a faulty stream harms no other one."""
    out: list[tuple[bytes | None, str | None]] = [(None, None)] * len(streams)
    run, size = {}, 0
    for i, data in enumerate(streams):
        if data is None:
            continue
        try:
            head = _stream_head(data)
        except (ValueError, struct.error) as e:
            out[i] = (None, str(e))
            continue
        if run and size + head[0] > 2 * SLICE:  # what streams claim is held for a few of them at a time
            _decode_run(streams, run, out)
            run, size = {}, 0
        run[i], size = head, size + head[0]
    _decode_run(streams, run, out)
    return out


def _decode_run(streams: list[bytes | None], heads: dict, out: list[tuple[bytes | None, str | None]]) -> None:
    """Decodes the streams of heads side by side into out."""
    lanes, place, base, offset = [], {}, 0, 0
    for i, (total, _, first, points) in heads.items():
        size = len(streams[i])
        points = sorted({(0, 0), *((s, b) for s, b in points if s < total and b < size - first)}) if total else []
        place[i] = offset
        for (s, b), (stop, _) in zip(points, [*points[1:], (total, 0)], strict=False):
            lanes.append((i, base + first + b, offset + s, offset + stop))
        base, offset = base + size, offset + total
    fault: dict[int, str] = {}
    pcm = np.zeros(offset, np.uint8)  # pages that no frame reaches are never touched
    if lanes:
        bits = _Bits(np.frombuffer(b"".join(streams[i] for i in heads), np.uint8))
        who, pos, sample, stop = (np.array(c, np.int64) for c in zip(*lanes, strict=True))
        while len(who):
            x, size, after, bad = decode_wave(bits, pos)
            over = (sample + size > stop) & (bad == 0)
            bad[over] = 1
            for lane in np.nonzero(bad)[0]:
                fault.setdefault(int(who[lane]), FAULTS[int(bad[lane])])
            for n in np.unique(size[bad == 0]):
                on = np.nonzero((bad == 0) & (size == n))[0]
                pcm[sample[on][:, None] + np.arange(n)] = (x[:n, on].T + 128 & 255).astype(np.uint8)
            sample, pos = sample + size, after
            on = (bad == 0) & (sample < stop)
            who, pos, sample, stop = who[on], pos[on], sample[on], stop[on]
    for i, (total, md5, _, _) in heads.items():
        if i not in fault:
            mine = pcm[place[i] : place[i] + total]
            if md5 != bytes(16) and hashlib.md5((mine ^ 0x80).tobytes()).digest() != md5:
                fault[i] = "wrong MD5 of the samples"
        out[i] = (None, fault[i]) if i in fault else (mine.tobytes(), None)


# ---------------------------------------------------------------- Spark columns


def _slices(sizes: list[int]) -> Iterator[slice]:
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE:
            yield slice(at, i)
            at, total = i, 0
        total += n
    yield slice(at, len(sizes))


@F.pandas_udf(T.BinaryType())
def flac_stream(payload: pd.Series) -> pd.Series:
    """A FLAC stream that holds each binary payload as unsigned bytes turned to 8-bit samples."""
    values, out = payload.tolist(), []
    for part in _slices([len(v or b"") for v in values]):
        done = iter(encode_streams([bytes(v) for v in values[part] if v is not None]))
        out += [None if v is None else next(done) for v in values[part]]
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StructType().add("pcm", T.BinaryType()).add("error", T.StringType()))
def flac_samples(media: pd.Series) -> pd.DataFrame:
    values, out = media.tolist(), []
    for part in _slices([len(v or b"") for v in values]):
        out += decode_streams([None if v is None else bytes(v) for v in values[part]])
    return pd.DataFrame({"pcm": pd.Series([a for a, _ in out], dtype=object), "error": pd.Series([b for _, b in out], dtype=object)})


@F.pandas_udf(T.StructType().add("media", T.BinaryType()).add("pcm", T.BinaryType()).add("error", T.StringType()))
def flac_stored_and_read(payload: pd.Series) -> pd.DataFrame:
    """The stream of each payload, and what is read back from the stream's bytes.  As two columns Spark would write each
    stream twice, once for the column and once inside the read."""
    values, media, read = payload.tolist(), [], []
    for part in _slices([len(v or b"") for v in values]):
        done = iter(encode_streams([bytes(v) for v in values[part] if v is not None]))
        own = [None if v is None else next(done) for v in values[part]]
        media += own
        read += decode_streams(own)
    column = lambda x: pd.Series(x, dtype=object)
    return pd.DataFrame({"media": column(media), "pcm": column([a for a, _ in read]), "error": column([b for _, b in read])})


def pcm_blocks(pcm: Column, block_samples: int = 4096) -> Column:
    """PCM cut into blocks: array<struct<sample_offset, n_samples, pcm>>; null for null."""
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length(pcm) / block_samples).cast("int")), lambda i: i.cast("long") * block_samples)
    starts = F.filter(starts, lambda i: i < F.octet_length(pcm))

    def block(i: Column) -> Column:
        part = F.substring(pcm, (i + 1).cast("int"), F.lit(block_samples))
        return F.struct(i.alias("sample_offset"), F.octet_length(part).alias("n_samples"), part.alias("pcm"))

    return F.when(pcm.isNotNull(), F.transform(starts, block))


def encode_flac(df: DataFrame, payload_col: str, out_col: str = "media") -> DataFrame:
    """df with a FLAC stream of each binary payload in out_col (a column of that name is replaced)."""
    wide_rows(df.sparkSession)
    return df.withColumn(out_col, flac_stream(F.col(payload_col)))


def decode_flac(df: DataFrame, media_col: str, id_cols: list[str], block_samples: int = 4096) -> DataFrame:
    """PCM blocks of each stream: id_cols, error, blocks array<struct<sample_offset, n_samples, pcm>>,
    in order of sample_offset.  Other columns of df are left out, so that their names cannot clash."""
    wide_rows(df.sparkSession)
    out = df.select(*(F.col(c) for c in id_cols), flac_samples(F.col(media_col)).alias("__decoded"))
    return out.select(*id_cols, F.col("__decoded.error").alias("error"), pcm_blocks(F.col("__decoded.pcm"), block_samples).alias("blocks"))


def store_and_read(df: DataFrame, payload_col: str, id_cols: list[str], block_samples: int = 4096) -> DataFrame:
    """id_cols, media, error, pcm (what was read back, whole), blocks (the same, cut): encode_flac and decode_flac in one pass."""
    wide_rows(df.sparkSession)
    out = df.select(*(F.col(c) for c in id_cols), flac_stored_and_read(F.col(payload_col)).alias("__both"))
    return out.select(*id_cols, F.col("__both.media").alias("media"), F.col("__both.error").alias("error"), F.col("__both.pcm").alias("pcm"), pcm_blocks(F.col("__both.pcm"), block_samples).alias("blocks"))


def pcm_range(decoded: DataFrame, start: int, n: int) -> DataFrame:
    """The samples [start, start + n) of each decoded stream, found by block offsets: column pcm."""
    hit = F.filter("blocks", lambda b: (b["sample_offset"] < start + n) & (b["sample_offset"] + b["n_samples"] > start))
    part = F.transform(hit, lambda b: F.substring(b["pcm"], F.greatest(F.lit(0), F.lit(start) - b["sample_offset"]).cast("int") + 1, F.least(F.lit(start + n) - F.greatest(b["sample_offset"], F.lit(start)), b["n_samples"].cast("long")).cast("int")))
    joined = F.aggregate(part, F.lit(b""), lambda a, b: F.concat(a, b))
    return decoded.withColumn("pcm", joined).drop("blocks")
