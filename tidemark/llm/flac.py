"""FLAC as a media column: 8-bit mono samples in blocks of 576.

Encoding predicts every block (constant, verbatim, fixed order 0 to 2 or four linear
coefficients), writes the residuals as Rice codes in four partitions, and adds frame
checksums, the digest of the samples and a seek point for every frame. Decoding
checks headers (CRC-8), frames (CRC-16), the lengths of frames and the digest, and gives PCM
blocks with the sample and byte offsets at which each can be read alone.

Frames of many files are worked on together, one sample position of all of them at a
time, in slices of ``SLICE`` frames; memory depends on the slice, not on the file.

Defined results: a null text is empty; an empty payload is one block of filler; equal texts
give equal files; repeated rows are coded one by one; an empty table gives no rows; a damaged
file raises ``DamagedMedia``; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 576
RATE = 8000
PARTITIONS = 2  # as a power of two
COEFFICIENTS, PRECISION, SHIFT = 4, 12, 8
SLICE = 2048
SEEK_POINTS = 900_000
TAIL = 32

# Fixed values of the format: binomial predictors and block sizes by code.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {8 + i: 256 << i for i in range(8)}


class DamagedMedia(ValueError):
    """A file that is not what was written."""


def _crc_table(polynomial: int, width: int, bits: int) -> np.ndarray:
    """What ``bits`` more zero bits make of each value of the register's top bits."""
    top, full = 1 << (width - 1), (1 << width) - 1
    reg = np.arange(1 << bits, dtype=np.int64) << (width - bits)
    for _ in range(bits):
        reg = np.where(reg & top, (reg << 1) ^ polynomial, reg << 1) & full
    return reg


CRC8 = _crc_table(0x07, 8, 8).tolist()
CRC16 = _crc_table(0x8005, 16, 16)
CRC16_BYTE = _crc_table(0x8005, 16, 8)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def _crc16(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of many byte ranges, two bytes of all of them at a time."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.zeros(len(at), np.int64)
    pairs = left // 2
    for j in range(int(pairs[0]) if len(pairs) else 0):
        m = int(np.searchsorted(-pairs, -j, side="left"))
        p = at[:m] + 2 * j
        crc[:m] = CRC16[crc[:m] ^ (buffer[p].astype(np.int64) << 8 | buffer[p + 1])]
    odd = np.flatnonzero(left % 2)
    crc[odd] = (crc[odd] << 8 & 0xFFFF) ^ CRC16_BYTE[(crc[odd] >> 8) ^ buffer[at[odd] + left[odd] - 1]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(maxsize=1 << 16)
def _header(number: int) -> bytes:
    """Frame header: fixed block size 576, rate as in the stream, mono, 8 bits."""
    head = b"\xff\xf8\x20\x02" + _coded(number)
    return head + bytes([_crc8(head)])


def _coded(number: int) -> bytes:
    if number < 0x80:
        return bytes([number])
    n = 1
    while number >= 1 << (5 * n + 6):
        n += 1
    tail = [0x80 | number >> 6 * i & 0x3F for i in reversed(range(n))]
    return bytes([(0xFF00 >> (n + 1)) & 0xFF | number >> 6 * n, *tail])


def payload_of(text: bytes) -> bytes:
    blocks = max(1, -(-len(text) // BLOCK))
    return text + b"\xff" * (blocks * BLOCK - len(text))


# ---- encoding


def _coefficients(x: np.ndarray) -> np.ndarray:
    """Quantised linear predictors of each row by the recursion on its autocorrelation."""
    f = x.astype(np.float32)
    auto = np.stack([(f[:, k:] * f[:, :BLOCK - k]).sum(axis=1, dtype=np.float64) for k in range(COEFFICIENTS + 1)], axis=1)
    error, a = auto[:, 0] + 1.0, np.zeros((len(x), COEFFICIENTS))
    for i in range(COEFFICIENTS):
        back = auto[:, 1:i + 1][:, ::-1]
        k = (auto[:, i + 1] - (a[:, :i] * back).sum(axis=1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error *= np.maximum(1 - k * k, 1e-9)
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -most, most - 1).astype(np.int32)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray | int, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """The frames of blocks x (rows of signed samples)."""
    n, rows = len(x), np.arange(len(x))
    q = _coefficients(x)
    guess = np.zeros_like(x)
    for j in range(COEFFICIENTS):
        guess[:, COEFFICIENTS:] += q[:, j:j + 1] * x[:, COEFFICIENTS - 1 - j:BLOCK - 1 - j]
    residuals, orders = [x], (0, 1, 2, COEFFICIENTS)
    for o in (1, 2):
        r = residuals[-1].copy()
        r[:, o:] -= residuals[-1][:, o - 1:-1]
        residuals.append(r)
    residuals.append(x - (guess >> SHIFT))
    weight = np.stack([np.abs(r[:, o:]).sum(axis=1) for r, o in zip(residuals, orders)])
    choice = weight.argmin(axis=0)
    order = np.array(orders)[choice]
    e = np.choose(choice[:, None], residuals)
    u = (e << 1) ^ (e >> 31)
    coded = np.arange(BLOCK) >= order[:, None]
    u[~coded] = 0
    parts, each = 1 << PARTITIONS, BLOCK >> PARTITIONS
    count = coded.reshape(n, parts, each).sum(axis=2)
    split = u.reshape(n, parts, each)
    mean = split.sum(axis=2) / count
    k = np.maximum(np.log2(np.maximum(mean, 1)).astype(np.int32), 0)
    lower = np.maximum(k - 1, 0)
    costs = [(split >> c[:, :, None]).sum(axis=2) + count * (1 + c) for c in (k, lower)]
    k = np.where(costs[1] < costs[0], lower, k)
    steady = (x == x[:, :1]).all(axis=1)
    linear = choice == 3
    fields = 8 * order + np.where(linear, 9 + COEFFICIENTS * PRECISION, 0) + 6
    body = fields + np.minimum(*costs).sum(axis=1) + 4 * parts
    plain = body >= 8 * BLOCK
    kind = np.where(steady, 0, np.where(plain, 1, np.where(linear, 31 + COEFFICIENTS, 8 + order)))
    body = np.where(steady, 8, np.where(plain, 8 * BLOCK, body)) + 8
    heads = [_header(int(i)) for i in numbers]
    head = np.array([len(h) for h in heads])
    size = head + (body + 7) // 8
    begin = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(8 * begin[-1], np.uint8)
    at = 8 * (begin[:-1] + head)
    _put(bits, at, kind << 1, 8)
    at = at + 8
    r = rows[steady]
    _put(bits, at[r], x[r, 0], 8)
    r = rows[(kind == 1)]
    _put(bits, at[r][:, None] + 8 * np.arange(BLOCK), x[r], 8)
    r = rows[kind > 1]
    for j in range(COEFFICIENTS):
        s = r[order[r] > j]
        _put(bits, at[s] + 8 * j, x[s, j], 8)
    at = at + 8 * order
    s = r[linear[r]]
    _put(bits, at[s], PRECISION - 1, 4)
    _put(bits, at[s] + 4, SHIFT, 5)
    for j in range(COEFFICIENTS):
        _put(bits, at[s] + 9 + j * PRECISION, q[s, j], PRECISION)
    at = at + np.where(linear, 9 + COEFFICIENTS * PRECISION, 0)
    _put(bits, at[r] + 2, PARTITIONS, 4)
    _put_codes(bits, at[r] + 6, u[r], k[r], coded[r])
    raw = np.packbits(bits)
    for i, h in enumerate(heads):
        raw[begin[i]:begin[i] + len(h)] = np.frombuffer(h, np.uint8)
    crc = _crc16(raw, begin[:-1], size)
    return [raw[begin[i]:begin[i + 1]].tobytes() + struct.pack(">H", crc[i]) for i in range(n)]


def _put_codes(bits: np.ndarray, at: np.ndarray, u: np.ndarray, k: np.ndarray, coded: np.ndarray) -> None:
    """Rice codes of the rows: the parameter before each partition, then its samples."""
    each = BLOCK >> PARTITIONS
    wide = np.repeat(k, each, axis=1)
    high = u >> wide
    length = np.where(coded, high + 1 + wide, 0)
    run = length.copy()
    run[:, ::each] += 4
    place = at[:, None] + np.cumsum(run, axis=1) - length
    _put(bits, place[:, ::each] - 4, k, 4)
    bits[(place + high)[coded]] = 1
    for j in range(int(k.max()) if k.size else 0):
        m = coded & (wide > j)
        bits[(place + length - 1 - j)[m]] = (u[m] >> j) & 1


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC file per payload (each a positive multiple of 576 bytes)."""
    counts = [len(p) // BLOCK for p in payloads]
    frames: list[list[bytes]] = [[] for _ in payloads]
    for part in _slices(counts):
        data = b"".join(payloads[i][a * BLOCK:b * BLOCK] for i, a, b in part)
        x = (np.frombuffer(data, np.uint8).astype(np.int32) - 128).reshape(-1, BLOCK)
        made = iter(_encode_frames(x, np.concatenate([np.arange(a, b) for _, a, b in part])))
        for i, a, b in part:
            frames[i].extend(next(made) for _ in range(b - a))
    return [_file(p, f) for p, f in zip(payloads, frames)]


def _slices(counts: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (file, first frame, end) of at most SLICE frames together."""
    part, room = [], SLICE
    for i, n in enumerate(counts):
        a = 0
        while a < n:
            b = min(n, a + room)
            part.append((i, a, b))
            room -= b - a
            a = b
            if not room:
                yield part
                part, room = [], SLICE
    if part:
        yield part


def _file(payload: bytes, frames: list[bytes]) -> bytes:
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    info = struct.pack(">HH6sQ", BLOCK, BLOCK, b"\0" * 6, RATE << 44 | 7 << 36 | len(payload)) + md5
    stride = -(-len(frames) // SEEK_POINTS)
    sizes = np.array([len(f) for f in frames], np.int64)
    points = np.zeros(len(frames), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
    points["sample"], points["n"] = np.arange(len(frames)) * BLOCK, BLOCK
    points["byte"][1:] = np.cumsum(sizes)[:-1]
    seek = points[::stride].tobytes()
    meta = b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek
    return meta + b"".join(frames)


# ---- decoding


def read_meta(data: bytes) -> tuple[int, int, bytes, np.ndarray, int]:
    """(bits per sample, samples, digest, byte offsets of the frames or empty, where frames begin)."""
    if data[:4] != b"fLaC":
        raise DamagedMedia("no FLAC marker")
    at, last, points, info = 4, False, np.zeros(0, np.int64), b""
    while not last:
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1:at + 4])
        last, body = bool(data[at] & 0x80), data[at + 4:at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            found = np.frombuffer(body, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
            each = (found["sample"] == np.arange(len(found)) * BLOCK).all() and (found["n"] == BLOCK).all()
            points = found["byte"].astype(np.int64) if each else points  # else frames are read in turn
        at += 4 + size
        if at >= len(data) or kind == 0 and size != 34:
            raise DamagedMedia("metadata of a wrong length")
    packed = struct.unpack(">Q", info[10:18])[0]
    if packed >> 41 & 7:
        raise DamagedMedia("one channel is expected")
    return (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34], points, at


def _read_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(frame number, samples, bytes of the header)."""
    if data[at:at + 2] != b"\xff\xf8":
        raise DamagedMedia("no frame where one should begin")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    lead, end = data[at + 4], at + 5
    number = lead
    if lead >= 0x80:
        n = 7 - (lead ^ 0xFF).bit_length()
        number = lead & (1 << (6 - n)) - 1 if n < 7 else 0
        for b in data[end:end + n]:
            number = number << 6 | b & 0x3F
        end += n
    extra = {6: 1, 7: 2}.get(code, 0)
    samples = int.from_bytes(data[end:end + extra]) + 1 if extra else BLOCK_CODES[code]
    end += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if _crc8(data[at:end]) != data[end]:
        raise DamagedMedia("a frame header has a wrong checksum")
    return number, samples, end + 1 - at


class _Bits:
    """Bit positions of many frames in one buffer."""

    def __init__(self, buffer: np.ndarray, at: np.ndarray):
        self.words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
        self.at = at

    def peek(self, rows=slice(None)) -> np.ndarray:
        at = self.at[rows]
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, width: int, rows=slice(None), signed: bool = False) -> np.ndarray:
        if not width:
            return np.zeros(len(self.at[rows]), np.int64)
        value = (self.peek(rows) >> np.uint64(64 - width)).astype(np.int64)
        self.at[rows] += width
        return (value ^ (1 << (width - 1))) - (1 << (width - 1)) if signed else value

    def rice(self, k: np.ndarray, rows=slice(None)) -> np.ndarray:
        w = self.peek(rows)
        high = (w >> np.uint64(32)).astype(np.int64)
        if not high.all():
            return self._long_rice(k, rows)
        zeros = 1054 - (high.astype(np.float64).view(np.int64) >> 52)
        rest = (w << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)
        self.at[rows] += zeros + 1 + k
        return zeros << k | rest.astype(np.int64)

    def _long_rice(self, k: np.ndarray, rows) -> np.ndarray:
        """Codes of which some have 32 zeros or more."""
        all_rows = np.arange(len(self.at))[rows]
        zeros, open_ = np.zeros(len(all_rows), np.int64), np.arange(len(all_rows))
        while len(open_):
            high = (self.peek(all_rows[open_]) >> np.uint64(32)).astype(np.int64)
            found = np.where(high > 0, 1054 - (np.maximum(high, 1).astype(np.float64).view(np.int64) >> 52), 32)
            zeros[open_] += found
            self.at[all_rows[open_]] += found
            if (self.at[all_rows[open_]] >> 3 >= len(self.words) - 1).any():
                raise DamagedMedia("a code runs past the end")
            open_ = open_[high == 0]
        w = self.peek(all_rows)
        rest = (w << np.uint64(1)) >> np.uint64(1) >> (63 - k).astype(np.uint64)
        self.at[all_rows] += 1 + k
        return zeros << k | rest.astype(np.int64)


def _decode_frames(buffer: np.ndarray, at: np.ndarray, samples: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples, ends in bytes) of frames whose bodies begin at the bytes ``at``; all of one block size."""
    n = len(at)
    bits = _Bits(buffer, at * 8)
    kind = bits.take(8)
    if (kind & 0x81).any():
        raise DamagedMedia("a subframe with unused bits")
    kind >>= 1
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise DamagedMedia("an unknown kind of subframe")
    past = int(order.max())
    s = np.zeros((past + samples, n), np.int64)
    r = np.flatnonzero(kind == 0)
    s[past:, r] = bits.take(depth, r, signed=True)
    r = np.flatnonzero(kind == 1)
    for i in range(samples if len(r) else 0):
        s[past + i, r] = bits.take(depth, r, signed=True)
    for i in range(past):
        r = np.flatnonzero(order > i)
        s[past + i, r] = bits.take(depth, r, signed=True)
    coef, shift = np.zeros((past, n), np.int64), np.zeros(n, np.int64)
    for o in range(1, 5):
        r = np.flatnonzero(kind == 8 + o)
        for j in range(o if len(r) else 0):
            coef[j, r] = FIXED[o][j]
    r = np.flatnonzero(kind >= 32)
    if len(r):
        width = bits.take(4, r) + 1
        shift[r] = bits.take(5, r)
        for w in np.unique(width):
            for j in range(past):
                m = r[(width == w) & (order[r] > j)]
                coef[j, m] = bits.take(int(w), m, signed=True)
    rows = np.flatnonzero(kind > 1)
    if len(rows):
        _residuals(bits, s, rows, order[rows], coef[:, rows], shift[rows], samples, past)
    return s[past:].T, (bits.at + 7) >> 3


def _residuals(bits: _Bits, s: np.ndarray, rows: np.ndarray, order, coef, shift, samples: int, past: int) -> None:
    """Add the Rice coded residuals to the predictions, one sample position of all rows at a time."""
    method, part = bits.take(2, rows), bits.take(4, rows)
    if (method > 1).any():
        raise DamagedMedia("an unknown residual code")
    each, k, raw = samples >> part, np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    width = np.where(method == 1, 5, 4)
    held = bits.at[rows]
    own = _Bits.__new__(_Bits)
    own.words, own.at = bits.words, held
    line = np.ascontiguousarray(s[:, rows])
    whole = slice(None)
    for i in range(samples):
        fresh = np.flatnonzero(i % each == 0) if (i % int(each.min()) == 0) else ()
        if len(fresh):
            for w in (4, 5):
                m = fresh[width[fresh] == w]
                if len(m):
                    k[m] = own.take(w, m)
                    raw[m] = k[m] == (1 << w) - 1
                    for j in m[raw[m]]:
                        k[j] = own.take(5, np.array([j]))[0]
        active = whole if i >= past and not raw.any() else np.flatnonzero((order <= i) & ~raw)
        u = own.rice(k[active], active)
        e = (u >> 1) ^ -(u & 1)
        guess = coef[0, active] * line[past + i - 1, active] if past else np.zeros(len(u), np.int64)
        for j in range(1, past):
            guess = guess + coef[j, active] * line[past + i - 1 - j, active]
        line[past + i, active] = e + (guess >> shift[active])
        for j in np.flatnonzero((order <= i) & raw) if raw.any() else ():
            one = np.array([j])
            guess = sum(int(coef[c, j]) * int(line[past + i - 1 - c, j]) for c in range(past))
            line[past + i, j] = int(own.take(int(k[j]), one, signed=True)[0]) + (guess >> int(shift[j]))
    s[:, rows] = line
    bits.at[rows] = own.at


def decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(samples as unsigned bytes, (sample offset, samples, byte offset, bytes) of every frame) of each file."""
    try:
        return _decode(files)
    except (IndexError, KeyError, OverflowError, struct.error) as e:  # lengths and codes that lead out of the file
        raise DamagedMedia("the file leads out of itself") from e


def _decode(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    metas = [read_meta(f) for f in files]
    for data, (_, _, _, points, begin) in zip(files, metas):
        if len(points) and (points[0] or (np.diff(points) <= 0).any() or points[-1] >= len(data) - begin):
            raise DamagedMedia("the seek table is out of order")
    out: list[list] = [[] for _ in files]
    tables: list[list] = [[] for _ in files]
    seekable = [i for i, m in enumerate(metas) if len(m[3]) and m[0] == 8 and len(m[3]) * BLOCK == m[1]]
    for part in _slices([len(metas[i][3]) for i in seekable]):
        _decode_slice(files, metas, [(seekable[i], a, b) for i, a, b in part], out, tables)
    for i in set(range(len(files))) - set(seekable):
        _decode_in_turn(files[i], metas[i], out[i], tables[i])
    done = []
    for data, meta, pieces, table in zip(files, metas, out, tables):
        pcm = b"".join(pieces)
        if meta[0] != 8 or len(pcm) != meta[1] or hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()).digest() != meta[2]:
            raise DamagedMedia("the samples do not have the stored digest")
        done.append((pcm, np.concatenate(table)))
    return done


def _decode_slice(files, metas, part, out, tables) -> None:
    chunks, starts, ends, base = [], [], [], 0
    for i, a, b in part:
        points, begin = metas[i][3], metas[i][4]
        bounds = np.append(points, len(files[i]) - begin)[a:b + 1]
        chunks.append(files[i][begin + int(bounds[0]):begin + int(bounds[-1])])
        starts.append(base + bounds[:-1] - bounds[0])
        ends.append(base + bounds[1:] - bounds[0])
        base += int(bounds[-1] - bounds[0])
    data = b"".join(chunks) + b"\0" * 16
    buffer = np.frombuffer(data, np.uint8)
    start, end = np.concatenate(starts), np.concatenate(ends)
    if _crc16(buffer, start, end - start).any():
        raise DamagedMedia("a frame has a wrong checksum")
    heads = [_read_header(data, int(p)) for p in start]
    numbers = np.concatenate([np.arange(a, b) for _, a, b in part])
    if any(h[0] != n or h[1] != BLOCK for h, n in zip(heads, numbers)):
        raise DamagedMedia("frames out of order")
    x, stop = _decode_frames(buffer, start + np.array([h[2] for h in heads]), BLOCK, 8)
    if (stop + 2 != end).any():
        raise DamagedMedia("a frame ends elsewhere than the seek table says")
    pcm = (x + 128).astype(np.uint8)
    row = 0
    for i, a, b in part:
        out[i].append(pcm[row:row + b - a].tobytes())
        points = np.append(metas[i][3], len(files[i]) - metas[i][4])
        tables[i].append(np.stack([np.arange(a, b) * BLOCK, np.full(b - a, BLOCK), metas[i][4] + points[a:b], np.diff(points)[a:b]], axis=1))
        row += b - a


def _decode_in_turn(data: bytes, meta, out: list, table: list) -> None:
    """A file without a seek point for every frame: the next frame begins where the last one ended."""
    at, sample = meta[4], 0
    buffer = np.frombuffer(data + b"\0" * 16, np.uint8)
    while at < len(data):
        _, samples, head = _read_header(data, at)
        x, stop = _decode_frames(buffer, np.array([at + head]), samples, meta[0])
        end = int(stop[0]) + 2
        if _crc16(buffer, np.array([at]), np.array([end - at])).any():
            raise DamagedMedia("a frame has a wrong checksum")
        out.append((x + 128).astype(np.uint8).tobytes())
        table.append(np.array([[sample, samples, at, end - at]]))
        at, sample = end, sample + samples


def features(pcm: bytes) -> str:
    """Whole-number statistics of the samples: level, power, crossings of the middle, largest step."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
    steps = np.abs(np.diff(x))
    return (f"blocks={len(x) // BLOCK};sum={int(x.sum())};power={int((x * x).sum(dtype=np.int64))};"
            f"crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};step={int(steps.max())};peak={int(np.abs(x).max())}")


# ---- columns


@F.arrow_udf(T.BinaryType())
def encoded(texts: pa.Array) -> pa.Array:
    """The FLAC file of every text."""
    data = texts.cast(pa.binary())
    return pa.array(encode([payload_of(t.as_py() or b"") for t in data]), pa.binary())


_TEXT, _LONG = T.StringType(), T.LongType()
DIGEST = T.StructType([T.StructField(n, t) for n, t in (
    ("payload_bytes", _LONG), ("payload_sha256", _TEXT), ("tail_crc32", _LONG), ("media_bytes", _LONG), ("media_sha256", _TEXT), ("feature", _TEXT))])
BLOCKS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (
    ("block", _LONG), ("sample_offset", _LONG), ("n_samples", _LONG), ("byte_offset", _LONG), ("n_bytes", _LONG), ("pcm", T.BinaryType()))]))


@F.arrow_udf(DIGEST)
def digested(media: pa.Array) -> pa.Array:
    """What the stored files say when they are read back."""
    rows = []
    for start in range(0, len(media), 256):
        files = media[start:start + 256].to_pylist()
        for data, (pcm, _) in zip(files, decode(files)):
            rows.append({
                "payload_bytes": len(pcm), "payload_sha256": hashlib.sha256(pcm).hexdigest(), "tail_crc32": zlib.crc32(pcm[-TAIL:]),
                "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": features(pcm)})
    return pa.array(rows, to_arrow_type(DIGEST))


@F.arrow_udf(BLOCKS)
def blocks_of(media: pa.Array) -> pa.Array:
    rows = []
    for pcm, table in decode(media.to_pylist()):
        rows.append([{
            "block": k, "sample_offset": int(s), "n_samples": int(n), "byte_offset": int(b), "n_bytes": int(m), "pcm": pcm[s:s + n]}
            for k, (s, n, b, m) in enumerate(table)])
    return pa.array(rows, to_arrow_type(BLOCKS))


def with_media(df: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    return df.withColumn(into, encoded(F.col(text)))


def pcm_blocks(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per block: the other columns, sample and byte offsets and the samples."""
    others = [c for c in df.columns if c != media]
    return df.select(*others, F.explode(blocks_of(F.col(media))).alias("_b")).select(*others, "_b.*")


def media_table(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    back = docs.select("doc_id", n.alias("n_bytes"), digested(encoded(F.col("text"))).alias("d"))
    return back.select("doc_id", "n_bytes", "d.*")
