"""FLAC (RFC 9639) for one channel of 8-bit samples, many frames at once: linear prediction, Rice residuals, checksums, seek table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 4096
#: Samples of the frames that are coded or decoded at once.
GROUP = 3 << 19
RATE = 8000
_LPC_ORDER, _LPC_BITS = 4, 9
_SIGN = bytes(b ^ 0x80 for b in range(256))
#: The fixed predictors of orders 0 to 4, as linear predictors.
_FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out.append(c & ((1 << bits) - 1))
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), np.array(_crc_table(0x8005, 16), np.uint16)
#: _AWAY[d][b]: what a byte b with d bytes after it adds to a CRC-16. Grows as needed.
_AWAY = np.array([_CRC16], np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for many ranges: the sum (xor) of what each byte adds at its distance from the end."""
    global _AWAY
    sizes = ends - starts
    if len(_AWAY) < sizes.max():
        rows = [_AWAY]
        last = _AWAY[-1]
        for _ in range(int(sizes.max()) - len(_AWAY)):
            last = (last << np.uint16(8)) ^ _CRC16[last >> np.uint16(8)]
            rows.append(last[None])
        _AWAY = np.concatenate(rows)
    at = np.cumsum(sizes) - sizes
    within = np.arange(sizes.sum()) - np.repeat(at, sizes)
    added = _AWAY[np.repeat(sizes, sizes) - 1 - within, data[np.repeat(starts, sizes) + within]]
    return np.bitwise_xor.reduceat(added, at)


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    parts = []
    while n >= 1 << (6 - len(parts)):
        parts.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (7 - len(parts))) & 0xFF | n, *reversed(parts)])


def _lpc(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of each frame and their shifts, from autocorrelations by the Levinson recursion."""
    within = np.arange(len(x)) - np.repeat(starts, sizes)
    f = x.astype(np.float64)
    r = [np.add.reduceat(f * f, starts)]
    for lag in range(1, _LPC_ORDER + 1):
        product = np.zeros(len(x))
        product[lag:] = f[lag:] * f[:-lag]
        product[within < lag] = 0
        r.append(np.add.reduceat(product, starts))
    a = np.zeros((len(starts), _LPC_ORDER))
    error = r[0] + 1e-9
    for k in range(_LPC_ORDER):
        reflect = (r[k + 1] - sum((a[:, j] * r[k - j] for j in range(k)), np.zeros(len(starts)))) / error
        new = a.copy()
        new[:, k] = reflect
        for j in range(k):
            new[:, j] = a[:, j] - reflect * a[:, k - 1 - j]
        a, error = new, np.maximum(error * (1 - reflect**2), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(_LPC_BITS - 1 - np.ceil(np.log2(top)).astype(np.int64) - 1, 0, 15)
    limit = 1 << (_LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int32), shift.astype(np.int32)


def _residuals(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: int, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x minus its prediction; the first `order` of each frame are kept as 0."""
    guess = np.zeros(len(x), np.int32)
    for j in range(order):
        guess[j + 1 :] += np.repeat(coefficients[:, j], sizes)[j + 1 :] * x[: -j - 1]
    out = x - (guess >> np.repeat(shift, sizes)) if order else x.copy()
    for j in range(order):
        out[(starts + j)[sizes > j]] = 0
    return out


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of frames of about GROUP samples, which are worked on at once."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + GROUP, "right")))
        yield first, last
        first = last


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; byte b is the sample b - 128. A payload has at least one byte.

    Frames do not depend on each other: they are coded group by group, so the memory at work does not grow with a payload.
    """
    sizes_of = np.array([len(p) for p in payloads])
    frames_of = -(-sizes_of // BLOCK)
    sizes = np.full(frames_of.sum(), BLOCK)
    sizes[np.cumsum(frames_of) - 1] = sizes_of - (frames_of - 1) * BLOCK
    owner = np.repeat(np.arange(len(payloads)), frames_of)
    number = np.arange(len(sizes)) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    parts: list[list[bytes]] = [[] for _ in payloads]
    total = np.zeros(len(sizes), np.int64)
    for first, last in _groups(sizes):
        x = b"".join(payloads[o][BLOCK * n : BLOCK * n + z] for o, n, z in zip(owner[first:last].tolist(), number[first:last].tolist(), sizes[first:last].tolist(), strict=True))
        data, total[first:last] = _coded(np.frombuffer(x, np.uint8), sizes[first:last], number[first:last])
        ends = np.cumsum(total[first:last])
        for o in np.unique(owner[first:last]).tolist():
            a, b = np.searchsorted(owner[first:last], (o, o + 1))
            parts[o].append(data[int(ends[a - 1]) if a else 0 : int(ends[b - 1])].tobytes())
    out, f = [], 0
    for k, (p, many) in enumerate(zip(payloads, frames_of.tolist(), strict=True)):
        rate = RATE << 44 | 7 << 36 | len(p)
        md5 = hashlib.md5()
        for at in range(0, len(p), GROUP):
            md5.update(p[at : at + GROUP].translate(_SIGN))
        info = BLOCK.to_bytes(2, "big") * 2 + int(total[f : f + many].min()).to_bytes(3, "big") + int(total[f : f + many].max()).to_bytes(3, "big") + rate.to_bytes(8, "big") + md5.digest()
        offsets = (np.cumsum(total[f : f + many]) - total[f : f + many]).tolist()
        table = b"".join((BLOCK * j).to_bytes(8, "big") + offset.to_bytes(8, "big") + size.to_bytes(2, "big") for j, (offset, size) in enumerate(zip(offsets, sizes[f : f + many].tolist(), strict=True)))
        out.append(b"".join([b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table, *parts[k]]))
        parts[k] = []
        f += many
    return out


def _coded(samples: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each) of the frames of some sizes and numbers, whose samples follow each other as unsigned bytes."""
    starts = np.cumsum(sizes) - sizes
    x = samples.astype(np.int32) - 128

    # a predictor for each frame: what leaves the smallest residuals
    none = np.zeros(len(sizes), np.int32)
    coefficients, shift = _lpc(x, starts, sizes)
    tried = []
    for order in (0, 1, 2):
        tried.append((order, False, _residuals(x, starts, sizes, order, np.broadcast_to(_FIXED[order].astype(np.int32), (len(sizes), 4)), none)))
    tried.append((_LPC_ORDER, True, _residuals(x, starts, sizes, _LPC_ORDER, coefficients, shift)))
    cost = np.array([np.add.reduceat(np.abs(e), starts) + 8 * order for order, _, e in tried])
    cost[:, sizes <= 2 * _LPC_ORDER] = [[0], [1], [1], [1]]
    best = cost.argmin(0)
    e = np.choose(np.repeat(best, sizes), [t[2] for t in tried])
    order = np.array([t[0] for t in tried])[best]
    u = (e << 1) ^ (e >> 31)
    within = np.arange(len(x)) - np.repeat(starts, sizes)
    coded = within >= np.repeat(order, sizes)

    # the Rice parameter that gives the fewest bits, near the logarithm of the mean
    mean = np.maximum(np.add.reduceat(u, starts) / sizes, 0.5)
    near = np.clip(np.floor(np.log2(mean)).astype(np.int64), 0, 13)
    bits = []
    for k in (near - 1, near, near + 1):
        k = np.clip(k, 0, 14).astype(np.int32)
        bits.append(np.add.reduceat(u >> np.repeat(k, sizes), starts) + (sizes - order) * (1 + k))
    pick = np.argmin(bits, 0)
    k, bits = np.clip(near - 1 + pick, 0, 14).astype(np.int32), np.choose(pick, bits)
    constant = np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts)
    extra = np.where(best == 3, 9 + _LPC_ORDER * _LPC_BITS, 0)
    verbatim = ~constant & (8 * order + extra + 10 + bits >= 8 * sizes)
    coded &= ~np.repeat(constant | verbatim, sizes)

    # what stands before the codewords
    heads = []
    for f, (size, n) in enumerate(zip(sizes.tolist(), number.tolist(), strict=True)):
        head = bytes([0xFF, 0xF8, 0xC0 if size == BLOCK else 0x70, 0x02]) + _number(n) + (b"" if size == BLOCK else (size - 1).to_bytes(2, "big"))
        head += bytes([crc8(head)])
        at = int(starts[f])
        if constant[f]:
            head += bytes([0, int(x[at]) & 0xFF])
            length = 0
        elif verbatim[f]:
            head += b"\x02" + (x[at : at + size] & 0xFF).astype(np.uint8).tobytes()
            length = 0
        else:
            warm = (x[at : at + order[f]] & 0xFF).astype(np.uint8).tobytes()
            if best[f] == 3:
                head += bytes([(0x20 | _LPC_ORDER - 1) << 1]) + warm
                tail, length = (_LPC_BITS - 1) << 5 | int(shift[f]), 9
                for c in coefficients[f].tolist():
                    tail, length = tail << _LPC_BITS | c & ((1 << _LPC_BITS) - 1), length + _LPC_BITS
            else:
                head += bytes([(0x08 | int(order[f])) << 1]) + warm
                tail = length = 0
            tail, length = tail << 10 | int(k[f]), length + 10
            head += (tail << (-length % 8)).to_bytes(-(-length // 8), "big")
        heads.append((head, 8 * len(head) - (-length % 8)))
    head_bits = np.array([h[1] for h in heads])
    total = -(-(head_bits + np.where(constant | verbatim, 0, bits)) // 8) + 2
    frame_at = np.cumsum(total) - total

    # the codewords: zeros, a one, and k low bits
    frame = np.repeat(np.arange(len(sizes)), sizes)[coded]
    u, k_of = u[coded], k[frame]
    q = u >> k_of
    width = q + 1 + k_of
    end = np.cumsum(width, dtype=np.int64)
    base = np.zeros(len(sizes), np.int64)
    if len(u):
        first = np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))
        base[frame[first]] = end[first] - width[first]
    stop = end - k_of - 1 + (8 * frame_at + head_bits - base)[frame]
    bit = np.zeros(8 * int(total.sum()), np.uint8)
    bit[stop] = 1
    for j in range(int(k_of.max()) if len(u) else 0):
        some = (u >> j) & 1 == 1
        some &= k_of > j
        bit[(stop + k_of - j)[some]] = 1
    data = np.packbits(bit)
    for at, (head, _) in zip(frame_at.tolist(), heads, strict=True):
        data[at : at + len(head)] |= np.frombuffer(head, np.uint8)
    crc = crc16(data, frame_at, frame_at + total - 2)
    data[frame_at + total - 2], data[frame_at + total - 1] = (crc >> 8).astype(np.uint8), (crc & 0xFF).astype(np.uint8)
    return data, total


@dataclass
class Block:
    """A decoded block: its first sample, its number of samples, and where its frame lies after the metadata."""

    first_sample: int
    samples: int
    frame_offset: int


class _Bits:
    """Reads of a few bits at many places of a buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
        self.window = (padded[:-3] << np.uint64(24)) | (padded[1:-2] << np.uint64(16)) | (padded[2:-1] << np.uint64(8)) | padded[3:]

    def read(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits (at most 25) at each place, as numbers without sign."""
        w = self.window[at >> 3]
        return ((w << (at & 7).astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> (np.uint64(32) - n.astype(np.uint64))).astype(np.int64)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        count = np.zeros(len(at), np.int64)
        live = None
        while True:
            here = at if live is None else (at + count)[live]
            w = self.window[here >> 3] << (here & 7).astype(np.uint64) & np.uint64(0xFFFFFFFF)
            found = np.where(w > 0, 32 - np.frexp(w.astype(np.float64))[1], 32 - (here & 7))
            if live is None:
                count += found
                live = np.flatnonzero(w == 0)
            else:
                count[live] += found
                live = live[w == 0]
            if not len(live):
                return count


def _frame_head(data: bytes, at: int, bps: int) -> tuple[int, int, int]:
    """(block size, frame number, bytes of the header) of the frame at `at`; its CRC-8 must hold."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] >> 4:
        raise ValueError("no mono FLAC frame here")
    code, rate, width = data[at + 2] >> 4, data[at + 2] & 15, (data[at + 3] >> 1) & 7
    if width not in (0, 1) or bps != 8:
        raise ValueError("samples of other than 8 bits")
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    number = lead if not more else lead & ((1 << (6 - more)) - 1)
    for b in data[at + 5 : at + 5 + more]:
        number = number << 6 | b & 0x3F
    p = at + 5 + more
    if code == 6:
        size, p = data[p] + 1, p + 1
    elif code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise ValueError("frame header fails its CRC-8")
    return size, number, p + 1 - at


def _frames(data: bytes, at: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """Samples and ends of the frames at these places, decoded side by side, one sample of each frame at a time."""
    raw = np.frombuffer(data, np.uint8)
    bits = _Bits(raw)
    heads = [_frame_head(data, a, 8) for a in at]
    by = sorted(range(len(at)), key=lambda f: -heads[f][0])
    size = np.array([heads[f][0] for f in by])
    pos = np.array([8 * (at[f] + heads[f][2]) for f in by])
    kind = raw[pos >> 3].astype(np.int64)
    if (kind & 1).any():
        raise ValueError("wasted bits are not used here")
    kind, pos = kind >> 1, pos + 8
    lpc, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    if (~lpc & ~fixed & (kind > 1)).any():
        raise ValueError("unknown kind of subframe")
    order = np.where(lpc, (kind & 31) + 1, np.where(fixed, kind & 7, 0))
    most = max(4, int(order.max()))
    samples = np.zeros((most + int(size[0]), len(by)), np.int64)
    signed = lambda v: (v ^ 0x80) - 0x80
    for f in np.flatnonzero(kind == 0):
        samples[most:, f] = signed(int(raw[pos[f] >> 3]))
        pos[f] += 8
    for f in np.flatnonzero(kind == 1):
        b = int(pos[f] >> 3)
        samples[most : most + size[f], f] = signed(raw[b : b + size[f]].astype(np.int64))
        pos[f] += 8 * size[f]
    for j in range(int(order.max())):
        some = np.flatnonzero(order > j)
        samples[most + j, some] = signed(bits.read(pos[some], np.full(len(some), 8)))
        pos[some] += 8
    weights, shift = np.zeros((most, len(by)), np.int64), np.zeros(len(by), np.int64)
    for o in range(1, 5):
        weights[most - o :, fixed & (order == o)] = _FIXED[o][:o][::-1, None]
    some = np.flatnonzero(lpc)
    if len(some):
        precision = bits.read(pos[some], np.full(len(some), 4)) + 1
        shift[some] = bits.read(pos[some] + 4, np.full(len(some), 5))
        pos[some] += 9
        for j in range(int(order.max())):
            has = order[some] > j
            s, p = some[has], precision[has]
            c = bits.read(pos[s], p)
            weights[most - 1 - j, s] = np.where(c >> (p - 1) & 1, c - (1 << p), c)
            pos[s] += p
    coded = np.flatnonzero(lpc | fixed)
    method = bits.read(pos[coded], np.full(len(coded), 2))
    parts = bits.read(pos[coded] + 2, np.full(len(coded), 4))
    pos[coded] += 6
    width = 4 + method
    # coded frames stay sorted by size, so those still running are the first ones
    p, k, raw_bits = pos[coded], np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
    n, o = size[coded], order[coded]
    each, turn = n >> parts, o.copy()
    s, w, sh = np.ascontiguousarray(samples[:, coded]), np.ascontiguousarray(weights[:, coded]), shift[coded]
    escaped = False
    deepest = int(o.max()) if len(o) else 0
    for i in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -i))  # frames of more than i samples
        idx = slice(0, live) if i >= deepest else np.flatnonzero(o[:live] <= i)
        at_ = p[idx]
        new = turn[idx] == i
        if new.any():
            g = np.arange(len(n))[idx][new]
            k[g] = bits.read(p[g], width[g])
            p[g] += width[g]
            raw_bits[g] = -1
            out = g[k[g] == (1 << width[g]) - 1]
            if len(out):
                raw_bits[out] = bits.read(p[out], np.full(len(out), 5))
                p[out] += 5
                escaped = True
            turn[g] = np.where(i < each[g], each[g], i + each[g])
            at_ = p[idx]
        q = bits.zeros(at_)
        ki = k[idx]
        at_ = at_ + q + 1
        low = bits.read(at_, ki)
        u = (q << ki) | low
        e = (u >> 1) ^ -(u & 1)
        at_ += ki
        if escaped:
            r = raw_bits[idx]
            esc = r >= 0
            v = bits.read(p[idx], np.maximum(r, 1))
            v = np.where(r > 0, np.where(v >> np.maximum(r - 1, 0) & 1, v - (1 << np.maximum(r, 0)), v), 0)
            e, at_ = np.where(esc, v, e), np.where(esc, p[idx] + np.maximum(r, 0), at_)
        guess = (w[:, idx] * s[i : i + most, idx]).sum(0) >> sh[idx]
        s[i + most, idx] = e + guess
        p[idx] = at_
    samples[:, coded], pos[coded] = s, p
    end = (pos + 7) // 8 + 2
    starts = np.array([at[f] for f in by])
    crc = crc16(raw, starts, end - 2)
    if (crc != (raw[end - 2].astype(np.uint16) << 8 | raw[end - 1])).any():
        raise ValueError("frame fails its CRC-16")
    out: list = [None] * len(by)
    ends = [0] * len(by)
    for place, f in enumerate(by):
        out[f], ends[f] = samples[most : most + size[place], place], int(end[place])
    return out, ends


def _metadata(stream: bytes) -> tuple[int, int, bytes, int, list[tuple[int, int, int]]]:
    """(where the frames begin, samples, MD5, the largest frame's bytes or 0, seek points: sample, offset and samples of a frame)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, points = 4, False, []
    while not last:
        last, what, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if what == 0:
            rate = int.from_bytes(body[10:18], "big")
            if rate >> 41 & 7 or (rate >> 36 & 31) != 7:
                raise ValueError("only one channel of 8 bits is read")
            total, md5, largest = rate & (1 << 36) - 1, body[18:34], int.from_bytes(body[7:10], "big")
        elif what == 3:
            points = [(int.from_bytes(body[j : j + 8], "big"), int.from_bytes(body[j + 8 : j + 16], "big"), int.from_bytes(body[j + 16 : j + 18], "big")) for j in range(0, size, 18)]
        at += 4 + size
    points = [x for x in points if x[0] != (1 << 64) - 1]
    full = points and points[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(points, points[1:], strict=False)) and points[-1][0] + points[-1][2] == total
    return at, total, md5, largest, points if full else []


def _unsigned(x: np.ndarray) -> bytes:
    return (x + 128).astype(np.uint8).tobytes()


def decode(streams: list[bytes]) -> list[tuple[bytes, list[Block]]]:
    """(payload, blocks) of each stream. Frame checksums and the MD5 of all samples must hold.

    Frames whose places the seek table gives are decoded side by side, group by group; a stream without a full table goes
    frame by frame.
    """
    known = [_metadata(s) for s in streams]
    got: list[list[bytes]] = [[] for _ in streams]
    places: list[list[int]] = [[] for _ in streams]
    frames = []
    for k, (begin, total, _, largest, points) in enumerate(known):
        ends = [x[1] for x in points[1:]] + [len(streams[k]) - begin]
        frames += [(k, begin + x[1], begin + e, x[2]) for x, e in zip(points, ends, strict=True)] if points else []
        at, done = begin, 0
        while not points and done < total:
            (x,), (end,) = _frames(streams[k][at : at + largest] if largest else streams[k][at:], [0])
            got[k].append(_unsigned(x))
            places[k].append(at - begin)
            at, done = at + end, done + len(x)
    for first, last in _groups(np.array([f[3] for f in frames], np.int64)):
        some = frames[first:last]
        sizes = np.array([b - a for _, a, b, _ in some])
        data = b"".join(streams[k][a:b] for k, a, b, _ in some)
        for (k, a, _, _), x in zip(some, _frames(data, (np.cumsum(sizes) - sizes).tolist())[0], strict=True):
            got[k].append(_unsigned(x))
            places[k].append(a - known[k][0])
    out = []
    for k, (_, total, md5, _, _) in enumerate(known):
        sizes, payload = [len(x) for x in got[k]], b"".join(got[k])[:total]
        got[k] = []
        check = hashlib.md5()
        for at in range(0, len(payload), GROUP):
            check.update(payload[at : at + GROUP].translate(_SIGN))
        if len(payload) < total or check.digest() != md5:
            raise ValueError("samples fail their MD5")
        out.append((payload, [Block(a, n, p) for a, n, p in zip(np.cumsum([0, *sizes]).tolist(), sizes, places[k], strict=False)]))
    return out
