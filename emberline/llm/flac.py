"""The FLAC stream format in numpy: many frames are coded or decoded at once, one sample of each at a time.

Frames are independent and short, so the loop over the samples of a frame runs once for thousands of frames. Decoding
covers constant, verbatim, fixed and LPC subframes, Rice partitions of both parameter widths with escapes, wasted bits,
several channels with stereo decorrelation, and any block size; it checks the CRC-8 of every header and the CRC-16 of
every frame, and the MD5 of the stream. Encoding writes mono 8-bit frames of BLOCK samples with fixed or linear predictors.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict

import numpy as np

BLOCK = 192
RATE = 8000
SEEK_EVERY = 64  # frames between seek points
CHUNK = 8192  # frames coded at once
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SIZES = {0: 0, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
WINDOW = 2_000_000  # bytes that a frame is looked for in, where its stream does not say how long frames are


class FlacError(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        crc = np.where(crc >> (bits - 1) & 1, crc << 1 ^ polynomial, crc << 1) & ((1 << bits) - 1)
    return crc.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _ends_with(buf: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A column for each range that ends at `ends`, aligned at the end, with zeros before: those leave a checksum at 0."""
    width = int(lengths.max(initial=0))
    back = np.arange(width, 0, -1)[:, None]
    at = ends[None, :] - back
    return np.where(back <= lengths[None, :], buf[np.maximum(at, 0)], 0).astype(np.uint8)


def crc8(buf: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(ends), np.uint16)
    for row in _ends_with(buf, ends, lengths):
        crc = _CRC8[crc ^ row]
    return crc


def crc16(buf: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(ends), np.uint16)
    for row in _ends_with(buf, ends, lengths):
        crc = (crc << 8) ^ _CRC16[(crc >> 8) ^ row]
    return crc


# --- encoding ---------------------------------------------------------------------------------------------------------


def _number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's extended UTF-8: (n x 6 bytes, lengths)."""
    length = 1 + sum((numbers >= t).astype(np.int64) for t in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((len(numbers), 6), np.uint8)
    for n in np.unique(length):
        rows = length == n
        v = numbers[rows]
        if n == 1:
            out[rows, 0] = v
            continue
        out[rows, 0] = ((0xFF << (8 - n)) & 0xFF) | (v >> (6 * (n - 1)))
        for k in range(1, n):
            out[rows, k] = 0x80 | (v >> (6 * (n - 1 - k)) & 0x3F)
    return out, length


def _predictors(s: np.ndarray) -> np.ndarray:
    """Coefficients (in eighths, five bits) of the linear predictor of order 2 of each frame, by its autocorrelation."""
    x = s.astype(np.float64)
    r0, r1, r2 = (x * x).sum(1), (x[:, 1:] * x[:, :-1]).sum(1), (x[:, 2:] * x[:, :-2]).sum(1)
    den = np.where(r0 * r0 - r1 * r1 > 0, r0 * r0 - r1 * r1, 1)
    both = np.stack([r1 * (r0 - r2) / den, (r0 * r2 - r1 * r1) / den], 1)
    return np.clip(np.rint(8 * both), -16, 15).astype(np.int32)


def encode_frames(samples: np.ndarray, numbers: np.ndarray, as_lpc: bool = False) -> tuple[bytes, np.ndarray]:
    """Mono 8-bit frames: samples (frames x BLOCK, signed), frame numbers. Returns the bytes of all and each one's length.

    A frame takes what is shortest of fixed predictors of orders 0 to 2, a linear predictor of order 2, and plain samples.
    as_lpc writes the fixed predictors as LPC subframes with explicit coefficients (for tests of decoding).
    """
    frames, n = samples.shape
    s = samples.astype(np.int32)
    rows = np.arange(frames)
    best = np.full(frames, 8 * n + 1, np.int64)  # verbatim beats a tie
    order, param = np.full(frames, -1), np.zeros(frames, np.int64)
    lpc, shift, weights = np.zeros(frames, bool), np.zeros(frames, np.int64), np.zeros((frames, 2), np.int64)
    folded = np.zeros((frames, n), np.int32)

    def consider(residual: np.ndarray, o: int, linear: bool, by: int, coefficients: np.ndarray) -> None:
        u = (residual << 1) ^ (residual >> 31)
        mean = u.sum(1) / max(1, u.shape[1])
        guess = np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64)
        for k in (np.maximum(guess - 1, 0), guess):
            bits = (u >> k[:, None]).sum(1) + (k + 1) * u.shape[1] + 8 * o + 10 + (9 + 5 * o) * linear
            better = bits < best
            best[better], order[better], param[better] = bits[better], o, k[better]
            lpc[better], shift[better] = linear, by
            weights[better] = coefficients[better] if coefficients.ndim == 2 else coefficients
            folded[better, o:] = u[better]

    residual = s
    for o in range(3):
        if o:
            residual = residual[:, 1:] - residual[:, :-1]
        if o or not as_lpc:
            consider(residual, o, as_lpc, 0, np.array((*FIXED[o], 0, 0)[:2]))
    if not as_lpc:
        c = _predictors(s)
        consider(s[:, 2:] - (c[:, :1] * s[:, 1:-1] + c[:, 1:] * s[:, :-2] >> 3), 2, True, 3, c)
    constant = (s == s[:, :1]).all(1)
    rice = (order >= 0) & ~constant
    number, width = _number_bytes(numbers)
    body_bits = 8 + np.where(constant, 8, np.where(rice, best, 8 * n))
    header = 4 + width + 1
    lengths = header + (body_bits + 7) // 8 + 2
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    bits = np.zeros(8 * total, np.uint8)
    if rice.any():
        r = rows[rice]
        o, k = order[r], param[r]
        linear = lpc[r]
        at = 8 * (starts[r] + header[r]) + 8 + 8 * o + 10 + (9 + 5 * o) * linear
        shape = np.arange(n)[None, :] >= o[:, None]
        u = folded[r].astype(np.int64)
        q = u >> k[:, None]
        code = np.where(shape, q + 1 + k[:, None], 0)
        one = at[:, None] + np.cumsum(code, 1) - code + q
        bits[one[shape]] = 1
        for j in range(int(k.max(initial=0))):
            use = shape & (k[:, None] > j)
            bits[(one + 1 + j)[use]] = (u >> np.maximum(k[:, None] - 1 - j, 0) & 1)[use]
        small = 8 * (starts[r] + header[r])

        def put(at: np.ndarray, value: np.ndarray, count: int) -> None:
            for j in range(count):
                bits[at + j] = value >> (count - 1 - j) & 1

        put(small, np.where(linear, 0x40 | np.maximum(o - 1, 0) << 1, (8 | o) << 1), 8)
        for w in range(int(o.max(initial=0))):
            has = o > w
            put(small[has] + 8 + 8 * w, s[r[has], w] & 0xFF, 8)
        if linear.any():  # precision 5, shift, coefficients
            put((small + 8 + 8 * o)[linear], 4 << 5 | shift[r][linear], 9)
            for w in range(int(o.max(initial=0))):
                has = linear & (o > w)
                put(small[has] + 8 + 8 * o[has] + 9 + 5 * w, weights[r][has, w] & 31, 5)
        put(at - 10, k, 10)
    out = np.packbits(bits)
    out[starts], out[starts + 1], out[starts + 2], out[starts + 3] = 0xFF, 0xF8, 0x10 if n == BLOCK else 0x70, 0x02
    if n != BLOCK:
        raise ValueError("frames have BLOCK samples")
    for j in range(6):
        has = width > j
        out[starts[has] + 4 + j] = number[has, j]
    out[starts + header - 1] = crc8(out, starts + header - 1, header - 1)
    first = starts + header
    if constant.any():
        out[first[constant]] = 0
        out[first[constant] + 1] = s[constant, 0] & 0xFF
    plain = ~constant & ~rice
    if plain.any():
        out[first[plain]] = 2
        out[first[plain][:, None] + 1 + np.arange(n)] = s[plain] & 0xFF
    crc = crc16(out, starts + lengths - 2, lengths - 2)
    out[starts + lengths - 2], out[starts + lengths - 1] = crc >> 8, crc & 0xFF
    return out.tobytes(), lengths


def encode_many(payloads: list[bytes], as_lpc: bool = False) -> list[bytes]:
    """A stream for each payload of unsigned 8-bit samples, each a positive multiple of BLOCK long."""
    counts = [len(p) // BLOCK for p in payloads]
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    parts, sizes = [], []
    for at in range(0, len(flat), CHUNK):
        data, lengths = encode_frames(flat[at : at + CHUNK].astype(np.int16) - 128, numbers[at : at + CHUNK], as_lpc)
        parts.append(data)
        sizes.append(lengths)
    data = b"".join(parts)
    lengths = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    out, frame, byte = [], 0, 0
    for payload, count in zip(payloads, counts, strict=True):
        own = lengths[frame : frame + count]
        offsets = np.cumsum(own) - own
        points = np.arange(0, count, SEEK_EVERY)
        table = b"".join(struct.pack(">QQH", int(f) * BLOCK, int(offsets[f]), BLOCK) for f in points)
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        head = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
        end = byte + int(own.sum())
        out.append(head + data[byte:end])
        frame, byte = frame + count, end
    return out


# --- decoding ---------------------------------------------------------------------------------------------------------


class Info:
    """What a stream's metadata says, and where its frames begin."""

    def __init__(self, stream: bytes):
        if stream[:4] != b"fLaC":
            raise FlacError("no FLAC marker")
        at, last, self.seek, self.largest = 4, False, [], 0
        while not last:
            if at + 4 > len(stream):
                raise FlacError("metadata is cut off")
            kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
            body = stream[at + 4 : at + 4 + size]
            last, at = kind >= 128, at + 4 + size
            if kind & 127 == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block, self.rate = struct.unpack(">H", body[2:4])[0], packed >> 44
                self.channels, self.bits, self.samples = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
                self.md5, self.largest = body[18:34], int.from_bytes(body[7:10], "big")
            elif kind & 127 == 3:
                self.seek = [struct.unpack_from(">QQH", body, k) for k in range(0, size - 17, 18)]
        self.first = at


class _Bits:
    """Vectorised reading from a byte buffer at many bit positions."""

    def __init__(self, buf: np.ndarray):
        b = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(np.uint64)
        self.words = b[:-7] << np.uint64(32) | b[1:-6] << np.uint64(24) | b[2:-5] << np.uint64(16) | b[3:-4] << np.uint64(8) | b[4:-3]
        bits = np.unpackbits(buf)
        self.end = len(bits)
        at = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
        self.next_one = np.append(np.minimum.accumulate(at[::-1])[::-1], np.full(65, len(bits), np.int32)).astype(np.int32)

    def read(self, at: np.ndarray, count) -> np.ndarray:
        """Up to 32 bits, unsigned."""
        at = np.minimum(at, self.end)
        word = self.words[at >> 3] << (at & 7).astype(np.uint64) & np.uint64(0xFFFFFFFFFF)
        return (word >> (40 - np.asarray(count)).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, count) -> np.ndarray:
        count = np.asarray(count)
        v = self.read(at, count)
        return np.where(count > 0, v - ((v >> np.maximum(count - 1, 0) & 1) << count), 0)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """How many 0 bits stand before the next 1 bit."""
        at = np.minimum(at, self.end)
        return (self.next_one[at] - at).astype(np.int64)


def headers(buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The fields of the frame headers at the byte positions `at`; ok is false where there is no valid header."""
    b = np.concatenate([buf, np.zeros(20, np.uint8)]).astype(np.int64)
    lead = b[at + 4]
    width = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 0, 2, 3, 4, 5, 6], 7)
    number = np.where(width == 1, lead, lead & (0x7F >> np.minimum(width, 7)))
    for k in range(1, 7):
        number = np.where(width > k, number << 6 | b[at + 4 + k] & 0x3F, number)
    size_code, rate_code = b[at + 2] >> 4, b[at + 2] & 15
    tail = at + 4 + width
    extra = np.where(size_code == 6, 1, np.where(size_code == 7, 2, 0))
    block = np.select(
        [size_code == 1, (size_code >= 2) & (size_code <= 5), size_code == 6, size_code == 7, size_code >= 8],
        [192, 576 << np.maximum(size_code - 2, 0), b[tail] + 1, (b[tail] << 8 | b[tail + 1]) + 1, 256 << np.maximum(size_code - 8, 0)],
        0,
    )
    length = 4 + width + extra + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [1, 2], 0) + 1
    code = b[at + 3] >> 1 & 7
    ok = (b[at] == 0xFF) & (b[at + 1] >> 1 == 0x7C) & (width > 0) & (block > 0) & (rate_code != 15) & (b[at + 3] >> 4 <= 10) & (b[at + 3] & 1 == 0) & (code != 3) & (code != 7)
    ok &= crc8(b.astype(np.uint8), at + length - 1, length - 1) == b[at + length - 1]
    return {"ok": ok, "block": block, "number": number, "length": length, "channel": b[at + 3] >> 4, "size": code, "variable": b[at + 1] & 1}


def _subframe(bits: _Bits, at: np.ndarray, n: int, bps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One channel of every frame: (samples, frames x n; bit position after it)."""
    frames = len(at)
    head = bits.read(at, 8)
    if (head >> 7).any():
        raise FlacError("a subframe's first bit is set")
    kind = head >> 1 & 63
    at = at + 8
    wasted = np.where(head & 1, bits.unary(at) + 1, 0)
    at, bps = at + wasted, bps - wasted
    out = np.zeros((n, frames), np.int64)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise FlacError("a reserved subframe type")
    constant, verbatim = kind == 0, kind == 1
    if constant.any():
        out[:, constant] = bits.signed(at[constant], bps[constant])
        at = np.where(constant, at + bps, at)
    if verbatim.any():
        for i in range(n):
            out[i, verbatim] = bits.signed(at[verbatim] + i * bps[verbatim], bps[verbatim])
        at = np.where(verbatim, at + n * bps, at)
    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        out[:, coded], at[coded] = _predicted(bits, at[coded], n, bps[coded], kind[coded])
    return (out << wasted[None, :]).T, at


def _predicted(bits: _Bits, at: np.ndarray, n: int, bps: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed and LPC subframes: warm-up samples, coefficients, Rice residuals, then the recursion."""
    frames = len(at)
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, kind - 8)
    most = int(order.max())
    if most > n:
        raise FlacError("an order above the block size")
    out = np.zeros((n, frames), np.int64)
    for i in range(most):
        out[i] = np.where(i < order, bits.signed(at + i * bps, bps), 0)
    at = at + order * bps
    weights, shift = np.zeros((most, frames), np.int64), np.zeros(frames, np.int64)
    for o in range(1, 5):
        for k, w in enumerate(FIXED[o][:most]):
            weights[k] = np.where(~lpc & (order == o), w, weights[k])
    if lpc.any():
        precision = np.where(lpc, bits.read(at, 4) + 1, 0)
        shift = np.where(lpc, bits.signed(at + 4, 5), 0)
        if (precision == 16).any() or (shift < 0).any():
            raise FlacError("an invalid LPC precision or shift")
        at = at + 9 * lpc
        for k in range(most):
            has = lpc & (k < order)
            weights[k] = np.where(has, bits.signed(at, precision), weights[k])
            at = at + precision * has
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any() or (n % (1 << parts) != 0).any():
        raise FlacError("an invalid residual header")
    at = at + 6
    wide = 4 + method
    each = n >> parts
    param = bits.read(at, wide)
    at = at + wide
    raw = np.zeros(frames, np.int64)
    escape = param == (1 << wide) - 1
    if escape.any():
        raw = np.where(escape, bits.read(at, 5), 0)
        at = at + 5 * escape
    split = bool((parts > 0).any())
    plain = not escape.any()
    for i in range(n):
        if split and i:
            new = i % each == 0
            if new.any():
                param = np.where(new, bits.read(at, wide), param)
                at = at + wide * new
                escape = param == (1 << wide) - 1
                raw = np.where(new & escape, bits.read(at, 5), raw)
                at = at + 5 * (new & escape)
                plain = not escape.any()
        zeros = bits.unary(at)
        low = at + zeros + 1
        u = zeros << param | bits.read(low, param)
        value, after = u >> 1 ^ -(u & 1), low + param
        if not plain:
            value, after = np.where(escape, bits.signed(at, raw), value), np.where(escape, at + raw, after)
        if i < most:
            has = i >= order
            out[i], at = np.where(has, value, out[i]), np.where(has, after, at)
        else:
            out[i], at = value, after
    if (at > bits.end).any():
        raise FlacError("a frame is cut off")
    for i in range(n):
        if most:
            total = sum(weights[k] * out[i - 1 - k] for k in range(min(most, i)))
            out[i] += np.where(i >= order, total >> shift, 0) if i < most else total >> shift
    return out, at


def decode_frames(buf: np.ndarray, at: np.ndarray, default_bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Frames at byte positions `at`: their samples (block x channels each) and end positions. Raises on a bad checksum."""
    h = headers(buf, at)
    if not h["ok"].all():
        raise FlacError("a frame header fails its checksum")
    bits = _Bits(buf)
    out: list = [None] * len(at)
    ends = np.zeros(len(at), np.int64)
    code = np.array([SIZES.get(c, 0) for c in range(8)])[h["size"]]
    depth = np.where(code > 0, code, default_bits)
    for n, channel in set(zip(h["block"].tolist(), h["channel"].tolist(), strict=True)):
        rows = np.flatnonzero((h["block"] == n) & (h["channel"] == channel))
        position = 8 * (at[rows] + h["length"][rows])
        side = {8: 1, 9: 0, 10: 1}.get(channel)
        planes = []
        for c in range(2 if channel >= 8 else channel + 1):
            plane, position = _subframe(bits, position, n, depth[rows] + (c == side))
            planes.append(plane)
        if channel == 8:
            planes[1] = planes[0] - planes[1]
        elif channel == 9:
            planes[0] = planes[0] + planes[1]
        elif channel == 10:
            mid = planes[0] << 1 | planes[1] & 1
            planes = [mid + planes[1] >> 1, mid - planes[1] >> 1]
        ends[rows] = (position + 7 >> 3) + 2
        block = np.stack(planes, 2)
        for k, row in enumerate(rows):
            out[row] = block[k]
    if (ends > len(buf)).any() or (crc16(buf, ends - 2, ends - 2 - at) != (buf[ends - 2].astype(np.uint16) << 8 | buf[ends - 1])).any():
        raise FlacError("a frame fails its checksum")
    return out, ends


def find_frames(buf: np.ndarray, first: np.ndarray, last: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
    """The positions of all frames of fixed-size streams at once, by sync code, header checksum and running number.

    Stream k takes buf[first[k]:last[k]] and has counts[k] frames. Coded data that look like a header are told apart (`_chain`). None
    if a stream is broken: the caller then decodes one frame after the other.
    """
    at = np.flatnonzero((buf[:-1] == 0xFF) & (buf[1:] >> 1 == 0x7C))
    stream = np.searchsorted(first, at, "right") - 1
    inside = (stream >= 0) & (at < last[np.maximum(stream, 0)] - 5)
    at, stream = at[inside], stream[inside]
    if not len(at):
        return None
    h = headers(buf, at)
    good = h["ok"] & (h["variable"] == 0)
    at, stream, number = at[good], stream[good], h["number"][good]
    ends = np.cumsum(np.bincount(stream, minlength=len(counts)))
    parts: list[np.ndarray] = []
    for k, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        begin = int(ends[k - 1]) if k else 0
        own = at[begin:end]
        if end - begin != count or (number[begin:end] != np.arange(count)).any():
            own = _chain(buf, own, number[begin:end], int(first[k]), int(last[k]), count)
            if own is None:
                return None
        parts.append(own)
    return np.concatenate(parts)


def _chain(buf: np.ndarray, at: np.ndarray, number: np.ndarray, first: int, last: int, count: int) -> np.ndarray | None:
    """The frames of one stream among the places `at` that look like headers, as coded data may by chance. Each frame has the next number;
    where several places have it, the frame is where the one before it ends."""
    places = defaultdict(list)
    for a, n in zip(at.tolist(), number.tolist(), strict=True):
        places[n].append(a)
    out = [first]
    for want in range(1, count):
        found = [a for a in places[want] if a > out[-1]]
        if len(found) > 1:
            try:
                end = out[-1] + int(decode_frames(buf[out[-1] : min(last, out[-1] + 4 * BLOCK)], np.array([0]), np.array([8]))[1][0])
            except FlacError:
                return None
            found = [a for a in found if a == end]
        if len(found) != 1:
            return None
        out.append(found[0])
    return np.array(out) if count and first in places[0] else None


def _frame(buf: np.ndarray, at: int, info: Info) -> tuple[np.ndarray, int]:
    """(samples, end) of the frame at a place. No more is looked at than the stream's largest frame has, if that is said and is so."""
    bits = np.array([info.bits])
    if 0 < info.largest < WINDOW:
        try:
            block, ends = decode_frames(buf[at : at + info.largest], np.array([0]), bits)
            return block[0], at + int(ends[0])
        except FlacError:
            pass
    block, ends = decode_frames(buf[at : at + WINDOW], np.array([0]), bits)
    return block[0], at + int(ends[0])


def decode(stream: bytes) -> tuple[Info, np.ndarray]:
    """One stream of any kind, frame after frame: (info, samples x channels)."""
    info = Info(stream)
    buf = np.frombuffer(stream, np.uint8)
    at, parts, got = info.first, [], 0
    while at < len(stream) and (not info.samples or got < info.samples):
        block, at = _frame(buf, at, info)
        parts.append(block)
        got += len(block)
    samples = np.concatenate(parts) if parts else np.zeros((0, info.channels), np.int64)
    if info.samples and got < info.samples:
        raise FlacError("frames are missing")
    raw = samples.astype("<i8").view(np.uint8).reshape(*samples.shape, 8)[:, :, : (info.bits + 7) // 8].tobytes()
    if any(info.md5) and hashlib.md5(raw).digest() != info.md5:
        raise FlacError("the stream fails its MD5")
    return info, samples


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payloads (unsigned 8-bit) of streams that encode_many wrote, decoded together; all checksums are verified."""
    if not streams:
        return []
    infos = [Info(s) for s in streams]
    if any(i.bits != 8 or i.channels != 1 or i.block != BLOCK for i in infos):
        return [(decode(s)[1][:, 0] + 128).astype(np.uint8).tobytes() for s in streams]
    counts = np.array([-(-i.samples // BLOCK) for i in infos])
    sizes = np.array([len(s) for s in streams])
    buf = np.frombuffer(b"".join(streams), np.uint8)
    last = np.cumsum(sizes)
    first = last - sizes + np.array([i.first for i in infos])
    at = find_frames(buf, first, last, counts)
    if at is None:
        return [(decode(s)[1][:, 0] + 128).astype(np.uint8).tobytes() for s in streams]
    flat = np.empty((len(at), BLOCK), np.uint8)
    stops = np.append(at[1:], len(buf))
    begins = np.cumsum(counts) - counts
    stops[begins[1:] - 1] = last[:-1]
    for k in range(0, len(at), CHUNK):
        own, low = at[k : k + CHUNK], int(at[k])
        part = buf[low : int(stops[min(k + CHUNK, len(at)) - 1])]
        blocks, ends = decode_frames(part, own - low, np.full(len(own), 8))
        if (ends + low != stops[k : k + CHUNK]).any():
            raise FlacError("a frame does not end where the next one begins")
        flat[k : k + CHUNK] = np.stack([b[:, 0] for b in blocks]) + 128
    data = flat.tobytes()
    out = [data[b * BLOCK : (b + c) * BLOCK] for b, c in zip(begins.tolist(), counts.tolist(), strict=True)]
    for info, payload in zip(infos, out, strict=True):
        if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != info.md5:
            raise FlacError("a stream fails its MD5")
    return out


def read_at(stream: bytes, sample: int, count: int) -> np.ndarray:
    """Samples [sample, sample + count) without decoding what stands before the nearest seek point."""
    info = Info(stream)
    start, offset, _ = max((p for p in info.seek if p[0] <= sample), default=(0, 0, 0))
    buf = np.frombuffer(stream, np.uint8)
    at, got, parts = info.first + offset, start, []
    while got < sample + count and at < len(stream):
        block, ends = decode_frames(buf[at : at + 100_000], np.array([0]), np.array([info.bits]))
        parts.append(block[0])
        got, at = got + len(block[0]), at + int(ends[0])
    whole = np.concatenate(parts) if parts else np.zeros((0, info.channels), np.int64)
    return whole[sample - start : sample - start + count]
