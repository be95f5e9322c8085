import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import flac

from .cases import edge_docs, no_docs

FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


class Bits:
    def __init__(self, data, at=0):
        self.v, self.n, self.at = int.from_bytes(data, "big"), len(data) * 8, at * 8

    def u(self, n):
        self.at += n
        return self.v >> (self.n - self.at) & ((1 << n) - 1)

    def s(self, n):
        x = self.u(n) if n else 0
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self):
        n = 0
        while not self.u(1):
            n += 1
        return n


def plain_decode(data):
    """A frame at a time, a bit at a time."""
    assert data[:4] == b"fLaC"
    at = 4
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 127 == 0:
            total = int.from_bytes(data[at + 14 : at + 22], "big") & (1 << 36) - 1
        at += 4 + size
        if kind & 128:
            break
    out = []
    while len(out) < total:
        b = Bits(data, at)
        assert b.u(14) == 0x3FFE and b.u(2) == 0
        code, _, _, _, _ = b.u(4), b.u(4), b.u(4), b.u(3), b.u(1)
        lead = b.u(8)
        for _ in range(0 if lead < 128 else 7 - (lead ^ 255).bit_length()):
            b.u(8)
        n = {1: 192, 8: 256}.get(code) or (b.u(8) + 1 if code == 6 else b.u(16) + 1)
        b.u(8)
        b.u(1)
        kind = b.u(6)
        wasted = b.unary() + 1 if b.u(1) else 0
        depth = 8 - wasted
        if kind == 0:
            x = [b.s(depth)] * n
        elif kind == 1:
            x = [b.s(depth) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [b.s(depth) for _ in range(order)]
            coef, shift = FIXED.get(order, []), 0
            if kind >= 32:
                p, shift = b.u(4) + 1, b.s(5)
                coef = [b.s(p) for _ in range(order)]
            wide, parts = 4 + b.u(2), b.u(4)
            for part in range(1 << parts):
                k = b.u(wide)
                raw = b.u(5) if k == (1 << wide) - 1 else None
                for _ in range((n >> parts) - (order if part == 0 else 0)):
                    if raw is None:
                        u = b.unary() << k
                        u |= b.u(k) if k else 0
                        r = u >> 1 ^ -(u & 1)
                    else:
                        r = b.s(raw)
                    x.append(r + (sum(c * v for c, v in zip(coef, reversed(x[len(x) - order :]), strict=False)) >> shift if order else 0))
        out += [v << wasted for v in x]
        at = (b.at + 7) // 8 + 2
    return bytes(v + 128 for v in out)


def payloads():
    rng = np.random.default_rng(3)
    text = ("Ein Text mit Umlauten: äöü. " * 40).encode()
    wave = (np.sin(np.arange(9000) / 17) * 100 + 128).astype(np.uint8).tobytes()
    return [b"", b"x", bytes(64), b"\x80" * 700, text, wave, rng.integers(0, 256, 3000, dtype=np.uint8).tobytes(), rng.integers(120, 136, 40_000, dtype=np.uint8).tobytes(), bytes(range(256)) * 2]


def test_streams_decode_the_same_by_both_decoders():
    made = flac.encode_streams(payloads())
    for p, s, (got, fault) in zip(payloads(), made, flac.decode_streams(made), strict=True):
        assert fault is None and got == p == plain_decode(s)
    kinds = {Bits(s, 0) and k for s in made for k in subframes(s)}
    assert {"constant", "fixed", "lpc", "verbatim"} <= kinds


def subframes(stream):
    total, _, at, points = flac._stream_head(stream)
    for _, offset in points:
        p = at + offset
        lead = stream[p + 4]
        q = p + 5 + (0 if lead < 128 else 7 - (lead ^ 255).bit_length()) + (1 if stream[p + 2] >> 4 == 6 else 0)
        kind = stream[q + 1] >> 1 & 63
        yield {0: "constant", 1: "verbatim"}.get(kind) or ("lpc" if kind >= 32 else "fixed")


def hand_made(sub_bits, n, total=None):
    """A stream of one frame of n samples with the given subframe bits."""
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0, n - 1])
    head += bytes([int(flac.crc_ranges(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), 8)[0])])
    bits = sub_bits + "0" * (-len(sub_bits) % 8)
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac.crc_ranges(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), 16)[0])
    info = struct.pack(">HH", 16, 256) + bytes(6) + (8000 << 44 | 7 << 36 | (total or n)).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + frame + crc.to_bytes(2, "big")


def b(value, n):
    return format(value & (1 << n) - 1, f"0{n}b") if n else ""


def rice(r, k):
    u = r << 1 if r >= 0 else (-r << 1) - 1
    return "0" * (u >> k) + "1" + b(u, k)


def test_partitions_escapes_wasted_bits_and_long_residuals():
    rng = np.random.default_rng(5)
    res = [int(x) for x in rng.integers(-3, 4, 64)]
    # order 1, four partitions: Rice, escape of 3 bits, escape of 0 bits (zeros), Rice with a wide parameter code
    res[32:48] = [0] * 16
    method0 = "0" + b(9, 6) + "0" + b(5, 8) + "00" + b(2, 4)
    method0 += b(1, 4) + "".join(rice(r, 1) for r in res[1:16])
    method0 += b(15, 4) + b(3, 5) + "".join(b(r, 3) for r in res[16:32])
    method0 += b(15, 4) + b(0, 5)
    method0 += b(0, 4) + "".join(rice(r, 0) for r in res[48:])
    first = hand_made(method0, 64)
    # wasted bits: samples are multiples of 4; order 0, five-bit parameters
    method1 = "0" + b(8, 6) + "1" + "01" + "01" + b(0, 4) + b(2, 5) + "".join(rice(r, 2) for r in res)
    second = hand_made(method1, 64)
    # a residual whose unary part is longer than a word's sure bits
    far = [100, -100, 60, 0] * 4
    third = hand_made("0" + b(8, 6) + "0" + "00" + b(0, 4) + b(0, 4) + "".join(rice(r, 0) for r in far), 16)
    for s in (first, second, third):
        got, fault = flac.decode_streams([s])[0]
        assert fault is None and got == plain_decode(s)


def test_damage_is_found_and_named():
    whole = flac.encode_streams([payloads()[4]])[0]
    at = len(whole) - 40
    hurt = whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]
    cases = [hurt, whole[:-3], b"junk", b"", None, whole]
    got = flac.decode_streams(cases)
    assert [g is None for g, _ in got] == [True, True, True, True, True, False]
    assert "checksum" in got[0][1] and all(f for _, f in got[1:4]) and got[4] == (None, None)


def forged(stream, total):
    """The stream with another number of samples in its STREAMINFO."""
    packed = int.from_bytes(stream[18:26], "big")
    return stream[:18] + (packed >> 36 << 36 | total).to_bytes(8, "big") + stream[26:]


def test_a_forged_count_harms_only_its_own_stream(spark):
    body = bytes(range(256)) * 8
    good = flac.encode_streams([body])[0]
    for claim in (len(body) * 2, 1 << 30, (1 << 36) - 1):
        df = spark.createDataFrame([(1, good), (2, forged(good, claim)), (3, good)], "id int, media binary").coalesce(1)
        rows = {r["id"]: r for r in flac.decode_flac(df, "media", ["id"]).collect()}
        assert rows[2]["blocks"] is None and "more samples" in rows[2]["error"]
        assert all(b"".join(bytes(x["pcm"]) for x in rows[i]["blocks"]) == body and rows[i]["error"] is None for i in (1, 3))
    # fewer samples than there are, and a count that the frames could hold by their sync codes but don't
    (short, why), (whole, _) = flac.decode_streams([forged(good, len(body) - 1), good])
    assert short is None and why and whole == body
    padded = forged(good + b"\xff\xf8" * 5000, 1_000_000)
    (none, why), (whole, _) = flac.decode_streams([padded, good])
    assert none is None and why and whole == body


def test_blocks_are_seekable(spark):
    body = bytes(range(256)) * 50
    df = spark.createDataFrame([(1, body), (2, b""), (3, None), (4, b"abc")], "id int, payload binary")
    read = flac.decode_flac(flac.encode_flac(df, "payload"), "media", ["id"], block_samples=1000)
    rows = {r["id"]: r for r in read.collect()}
    assert [x["sample_offset"] for x in rows[1]["blocks"]] == list(range(0, len(body), 1000))
    assert b"".join(bytes(x["pcm"]) for x in rows[1]["blocks"]) == body
    assert rows[2]["blocks"] == [] and rows[3]["blocks"] is None and rows[3]["error"] is None
    part = {r["id"]: r["pcm"] for r in flac.pcm_range(read, 2990, 30).collect()}
    assert bytes(part[1]) == body[2990:3020] and bytes(part[4]) == b""


def test_query_on_edge_rows(spark, tmp_path):
    from lattica.llm.queries import op1_flac

    for name, df in (("rows", edge_docs(spark)), ("none", no_docs(spark))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = op1_flac(spark, f"{tmp_path}/{name}").collect()
        want = edge_docs(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect() if name == "rows" else []
        assert len(got) == len(want)
        digest = lambda t: hashlib.sha256(t + bytes(-len(t) % 64 if t else 64)).hexdigest()
        assert sorted(r["payload_sha256"] for r in got) == sorted(digest(r["t"].encode()) for r in want)
        assert all(r["error"] is None for r in got)


@pytest.mark.parametrize("bits,poly", [(8, 0x07), (16, 0x8005)])
def test_crc(bits, poly):
    data, want = b"123456789", 0
    for byte in data:
        want ^= byte << (bits - 8)
        for _ in range(8):
            want = (want << 1 ^ poly if want >> (bits - 1) else want << 1) & (1 << bits) - 1
    assert flac.crc_ranges(np.frombuffer(data, np.uint8), np.array([0]), np.array([9]), bits)[0] == want
