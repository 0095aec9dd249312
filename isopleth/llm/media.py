"""Media columns: byte payloads stored as progressive JPEG, read back as coefficients and as full-resolution RGB.

A payload byte b is the coefficient b (from 128 on) or b - 255 (below): the
values whose eight magnitude bits are b, so 64 bytes are one block and nothing
is lost. Blocks fill the Y, Cb and Cr planes of a 4:2:0 image. Each plane has
a DC scan, two bands of AC scans without the lowest bit (spectral selection),
and a DC and an AC scan that add that bit (successive approximation).

The decoder accumulates any such scans into coefficient arrays. Restart
intervals are independent, so all intervals of a batch of images are decoded
in step, a symbol of each at a time, with numpy. The inverse transform uses
integers in doubles, which makes pixels the same in whatever batch.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of a restart interval; payload bytes of an image; bytes that a task encodes or decodes at a time.
INTERVAL, TILE, BATCH_BYTES = 16, 1 << 20, 4 << 20
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Integer basis of the inverse transform, in units of 2**-12.
BASIS = np.rint(np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)]) * 4096)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text and its payload: those and zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def geometry(blocks: int) -> tuple[int, int]:
    """Width and height in blocks of a nearly square 4:2:0 image whose planes hold so many blocks."""
    held = lambda w, h: w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2)
    w = max(1, int(np.ceil(np.sqrt(blocks / 1.5))))
    h = max(1, int(blocks / (1.5 * w)) - 2)
    while held(w, h) < blocks:
        h += 1
    if max(w, h) > 8191:
        raise ValueError("a payload of over 6 GB doesn't fit one image")
    return w, h


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, at: int, lengths: dict[int, int]) -> bytes:
    """DHT of symbols with their code lengths, in order."""
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | at]) + counts + bytes(lengths))


#: Code lengths: DC categories 0 to 11; AC bands hold (no run, 7 bits) alone; the last scan holds runs of ended blocks alone.
DC_CODES = dict.fromkeys(range(12), 4)
BAND_CODES = {0x07: 1}
END_CODES = {r << 4: 3 for r in range(6)}


class _Intervals:
    """The restart intervals of many planes that lie one after the other; sizes: each plane's number of blocks."""

    def __init__(self, sizes: np.ndarray):
        many = -(-sizes // INTERVAL)
        self.turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.blocks = np.minimum(INTERVAL, np.repeat(sizes, many) - INTERVAL * self.turn)
        self.starts = np.cumsum(self.blocks) - self.blocks
        self.inner = np.ones(len(self.turn), bool)
        self.inner[np.cumsum(many) - 1] = False  # a plane's last interval has no marker behind it

    def joined(self, data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """For each plane its entropy-coded bytes, 0xFF stuffed and restart markers between its intervals; sizes: bytes of each interval."""
        ends = np.cumsum(sizes)
        full, marked = np.flatnonzero(data == 0xFF) + 1, ends[self.inner]
        marks = np.stack([np.full(len(marked), 0xFF), 0xD0 + self.turn[self.inner] % 8], axis=1).ravel().astype(np.uint8)
        out = np.insert(data, np.concatenate([full, np.repeat(marked, 2)]), np.concatenate([np.zeros(len(full), np.uint8), marks])).tobytes()
        last = ends[~self.inner]
        stops = (last + np.searchsorted(full, last, "right") + 2 * np.searchsorted(marked, last, "right")).tolist()
        return [out[a:b] for a, b in zip([0, *stops], stops)]

    def uniform(self, data: np.ndarray) -> list[bytes]:
        """Bytes below 0x80, a row for each block."""
        return self.joined(data.ravel(), self.blocks * data.shape[1])

    def coded(self, values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """A code of sizes[k] bits for each block, each interval filled up to a byte with ones."""
        bits = np.add.reduceat(sizes, self.starts)
        stops = self.starts + self.blocks
        sizes, values = np.insert(sizes, stops, -bits % 8), np.insert(values, stops, 255)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        spread = np.repeat(values, sizes) >> (np.repeat(sizes, sizes) - 1 - at) & 1
        return self.joined(np.packbits(spread.astype(np.uint8)), -(-bits // 8))

    def bits(self, rows: np.ndarray, ended: bool) -> list[bytes]:
        """Bits, a row for each block; with ``ended`` behind the code of a run of as many ended blocks."""
        n, log = rows.shape[1], np.frexp(self.blocks.astype(float))[1] - 1
        head = 3 + log if ended else np.zeros(len(log), np.int64)
        sizes = -(-(head + n * self.blocks) // 8)
        first = 8 * (np.cumsum(sizes) - sizes)
        out = np.ones(8 * int(sizes.sum()), np.uint8)
        if ended:
            code = (log << log) | (self.blocks - (1 << log))
            for k in range(int(head.max())):
                some = head > k
                out[first[some] + k] = code[some] >> (head[some] - 1 - k) & 1
        place = np.repeat(first + head - n * self.starts, self.blocks) + n * np.arange(len(rows))
        out[place[:, None] + np.arange(n)] = rows
        return self.joined(np.packbits(out), sizes)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEGs whose coefficients hold the payloads (positive multiples of 64 bytes), all coded together."""
    shapes = [geometry(len(p) // 64) for p in payloads]
    planes = np.array([n for w, h in shapes for n in (w * h, *[((w + 1) // 2) * ((h + 1) // 2)] * 2)])
    room = planes.reshape(-1, 3).sum(axis=1) * 64
    data = np.frombuffer(b"".join(p.ljust(n, b"\0") for p, n in zip(payloads, room.tolist())), np.uint8).reshape(-1, 64)
    of = _Intervals(planes)
    lowest = (data ^ (data < 128)) & 1
    value = np.where(data[:, 0] >= 128, data[:, 0].astype(np.int64), data[:, 0].astype(np.int64) - 255) >> 1
    diff = np.diff(value, prepend=0)
    diff[of.starts] = value[of.starts]
    size = np.frexp(np.abs(diff).astype(float))[1].astype(np.int64)
    code = size << size | np.where(diff < 0, diff + (1 << size) - 1, diff)
    bodies = [
        (0, 0, 0, 0x01, of.coded(code, size + 4)),
        *[(0, first, last, 0x01, of.uniform(data[:, first : last + 1] >> 1)) for first, last in ((1, 5), (6, 63))],
        (0, 0, 0, 0x10, of.bits(lowest[:, :1], False)),
        (1, 1, 63, 0x10, of.bits(lowest[:, 1:], True)),
    ]
    tables = _huffman(0, 0, DC_CODES) + _huffman(1, 0, BAND_CODES) + _huffman(1, 1, END_CODES) + _segment(0xDD, struct.pack(">H", INTERVAL))
    out = []
    for k, (raw, (w, h)) in enumerate(zip(payloads, shapes)):
        parts = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(raw)), _segment(0xDB, b"\0" + b"\1" * 64)]
        parts += [_segment(0xC2, struct.pack(">BHHB", 8, 8 * h, 8 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), tables]
        for table, first, last, bits, body in bodies:
            for c in range(3):
                parts += [_segment(0xDA, bytes([1, c + 1, table, first, last, bits])), body[3 * k + c]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


class Image:
    """A parsed progressive JPEG: its planes and, for each scan, its parameters and the bytes of its restart intervals."""

    def __init__(self, raw: bytes):
        self.payload, self.interval, self.scans, self.orders, quant, tables = None, 0, [], {}, {}, {}
        at = 2
        while at < len(raw):
            marker, at = raw[at + 1], at + 2
            if marker == 0xD9:
                break
            n = struct.unpack_from(">H", raw, at)[0]
            body, at = raw[at + 2 : at + n], at + n
            if marker == 0xFE and body.startswith(b"payload "):
                self.payload = int(body[8:])
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    total = sum(body[1:17])
                    tables[body[0]] = body[1 : 17 + total]
                    body = body[17 + total :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
                mw, mh = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                self.mcus = (mw, mh)
                self.rows = [(mw * p[1], mh * p[2]) for p in self.parts]  # stored blocks, those that only pad included
                self.real = [(-(-self.width * p[1] // (8 * self.hmax)), -(-self.height * p[2] // (8 * self.vmax))) for p in self.parts]
                self.first = np.concatenate([[0], np.cumsum([a * b for a, b in self.rows])])
            elif marker == 0xDA:
                of = [([p[0] for p in self.parts].index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
                start, end, bits = body[-3:]
                stop = _SCAN_END.search(raw, at).start()
                codes = tuple(tables.get(t >> 4 if not start else 0x10 | t & 15, b"") for _, t in of)
                self.scans.append((start, end, bits >> 4, bits & 15, codes, *self._order(tuple(c for c, _ in of)), raw[at:stop]))
                at = stop
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("only progressive JPEG with Huffman codes is read")
        self.quant = [quant[p[3]] for p in self.parts]

    def _order(self, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
        """Blocks of a scan in order, a row per MCU, the place of the component of each of its columns, and the components."""
        if parts not in self.orders:
            self.orders[parts] = (*self._ordered(parts), parts)
        return self.orders[parts]

    def _ordered(self, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            (w, h), (full, _) = self.real[parts[0]], self.rows[parts[0]]
            return (self.first[parts[0]] + np.arange(h)[:, None] * full + np.arange(w)).reshape(-1, 1), np.zeros(1, int)
        mw, mh = self.mcus
        columns, owner = [], []
        for k, c in enumerate(parts):
            _, hs, vs, _ = self.parts[c]
            for v in range(vs):
                for u in range(hs):
                    columns.append((self.first[c] + (np.arange(mh)[:, None] * vs + v) * self.rows[c][0] + np.arange(mw) * hs + u).ravel())
                    owner.append(k)
        return np.stack(columns, axis=1), np.array(owner)


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come: code length << 8 | symbol."""
    out, code, at = np.full(1 << 16, 16 << 8, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1] if table else 0):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Stream:
    """Entropy-coded bytes of all intervals together, without stuffing and markers; ``start`` is each interval's first bit."""

    def __init__(self, bodies: list[bytes]):
        raw = np.frombuffer(b"".join(bodies) + b"\0", np.uint8)
        mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
        drop = np.zeros(len(raw), bool)
        drop[mark] = drop[mark + 1] = True
        drop[np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1] = True
        drop[-1] = True
        first = np.concatenate([np.cumsum([0, *map(len, bodies)])[:-1], mark + 2])
        first.sort()
        kept = np.concatenate([[0], np.cumsum(~drop)])
        self.start = kept[first].astype(np.int64) * 8
        data = np.concatenate([raw[~drop], np.zeros(8, np.uint8)]).astype(np.uint32)
        self.word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 16 bits from each place on."""
        at = np.minimum(at, 8 * len(self.word) - 1)
        return (self.word[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n (up to 16) bits from each place on, as a number."""
        return (self.peek(at) >> (16 - n).astype(np.uint32)).astype(np.int64)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def _dc(s: _Stream, blocks: list[np.ndarray], owner: np.ndarray, looks: list[np.ndarray], high: int, low: int, coef: np.ndarray) -> None:
    size = np.array([len(b) for b in blocks])
    grid = _grid(blocks, size)
    at, pred = s.start.copy(), np.zeros((len(blocks), len(looks)), np.int64)
    for j in range(grid.shape[1]):
        lane = np.flatnonzero(size > j)
        block, c = grid[lane, j], owner[j % len(owner)]
        if high:
            coef[block, 0] |= (s.peek(at[lane]) >> np.uint32(15)).astype(coef.dtype) << low
            at[lane] += 1
            continue
        found = looks[c][s.peek(at[lane])]
        n, bits = found >> 8, (found & 255).astype(np.int64)
        pred[lane, c] += _extend(s.take(at[lane] + n, bits), bits)
        coef[block, 0] = pred[lane, c] << low
        at[lane] += n + bits


def _grid(blocks: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    grid = np.zeros((len(blocks), size.max()), np.int64)
    grid[np.arange(size.max()) < size[:, None]] = np.concatenate(blocks)
    return grid


def _ac_first(s: _Stream, blocks: list[np.ndarray], look: np.ndarray, first: int, last: int, low: int, coef: np.ndarray) -> None:
    size = np.array([len(b) for b in blocks])
    grid, flat = _grid(blocks, size), coef.reshape(-1)
    width = grid.shape[1]
    lane, at, i, k = np.arange(len(blocks)), s.start.copy(), np.zeros(len(blocks), np.int64), np.full(len(blocks), first, np.int64)
    cell = grid.reshape(-1)
    while len(lane):
        found = look[s.peek(at)]
        at += found >> 8
        run, n = (found & 255) >> 4, (found & 15).astype(np.int64)
        ends = (n == 0) & (run < 15)
        if ends.any():
            r = run[ends].astype(np.int64)
            i[ends] += (1 << r) + s.take(at[ends], r)
            at[ends] += r
            k[ends] = first
            go = ~ends
            k[go] += run[go]
            put = np.flatnonzero(n > 0)
            flat[cell[lane[put] * width + i[put]] * 64 + k[put]] = _extend(s.take(at[put], n[put]), n[put]) << low
            k[go] += 1
        else:
            k += run
            value = _extend(s.take(at, n), n) << low
            put = n > 0
            if put.all():
                flat[cell[lane * width + i] * 64 + k] = value
            else:
                flat[cell[lane[put] * width + i[put]] * 64 + k[put]] = value[put]
            k += 1
        at += n
        over = k > last
        ended = ends.any()
        if ended or over.any():
            i += over
            k[over] = first
            more = i < size[lane]
            if not more.all():
                lane, at, i, k = lane[more], at[more], i[more], k[more]


def _ac_refine(s: _Stream, blocks: list[np.ndarray], look: np.ndarray, first: int, last: int, low: int, coef: np.ndarray) -> None:
    size = np.array([len(b) for b in blocks])
    grid, n = _grid(blocks, size), last - first + 1
    lane, at, i, k, ended = np.arange(len(blocks)), s.start.copy(), *(np.zeros(len(blocks), np.int64) for _ in range(3))
    place, step = np.arange(n), 1 << low
    while len(lane):
        asks = np.flatnonzero(ended == 0)
        run, one, sign = (np.zeros(len(lane), np.int64) for _ in range(3))
        if len(asks):
            found = look[s.peek(at[asks])]
            at[asks] += found >> 8
            run[asks], one[asks] = (found & 255) >> 4, found & 15
            ends = asks[(one[asks] == 0) & (run[asks] < 15)]
            ended[ends] = (1 << run[ends]) + s.take(at[ends], run[ends])
            at[ends] += run[ends]
            new = asks[one[asks] > 0]
            sign[new] = s.take(at[new], np.ones(len(new), np.int64))
            at[new] += 1
        block = grid[lane, i]
        rows = coef[block, first : last + 1]
        held = rows != 0
        if (ended > 0).all() and not k.any() and held.all():  # the bits of a whole block lie together
            stop = np.full(len(lane), n)
            where = at[:, None] + place
            bit = (s.word[where >> 3] >> (31 - (where & 7)).astype(np.uint32)).astype(coef.dtype) & 1
            rows += np.where(rows > 0, bit, -bit) << low
            at += n
        else:
            ahead = place >= k[:, None]
            zeros = np.cumsum(~held & ahead, axis=1)
            over = zeros > run[:, None]
            stop = np.where((ended > 0) | ~over.any(axis=1), n, over.argmax(axis=1))
            fix = held & ahead & (place < stop[:, None])
            after = np.cumsum(fix, axis=1)
            lanes, columns = np.nonzero(fix)
            where = at[lanes] + after[lanes, columns] - 1
            bit = (s.word[where >> 3] >> (31 - (where & 7)).astype(np.uint32)) & np.uint32(1)
            old = rows[lanes, columns]
            rows[lanes, columns] = old + np.where(old > 0, step, -step) * bit.astype(coef.dtype)
            at += after[:, -1]
        new = np.flatnonzero((one > 0) & (stop < n))
        rows[new, stop[new]] = np.where(sign[new] > 0, step, -step)
        coef[block, first : last + 1] = rows
        k = stop + 1
        k[ended > 0] = n
        ended -= ended > 0
        over = k >= n
        i += over
        k[over] = 0
        more = i < size[lane]
        if not more.all():
            lane, at, i, k, ended = (x[more] for x in (lane, at, i, k, ended))


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Accumulates every scan of every image: an array (blocks, 64) of each, in zigzag order.

    A scan waits for the scans before it that hold the same coefficients; those that wait alike are decoded together.
    """
    counts = [int(x.first[-1]) for x in images]
    base = np.concatenate([[0], np.cumsum(counts)])
    coef = np.zeros((int(base[-1]), 64), np.int32)
    waits = defaultdict(lambda: defaultdict(list))
    for x, b in zip(images, base):
        turns = np.zeros((len(x.parts), 64), int)
        for first, last, high, low, codes, order, owner, parts, body in x.scans:
            turn = turns[list(parts), first : last + 1].max()
            turns[list(parts), first : last + 1] = turn + 1
            every = x.interval or len(order)
            lanes = [(order[k : k + every] + b).ravel() for k in range(0, len(order), every)]
            waits[turn][first, last, high, low, codes, owner.tobytes()].append((lanes, body, owner))
    for _, alike in sorted(waits.items()):
        for (first, last, high, low, codes, _), group in alike.items():
            stream, blocks = _Stream([body for _, body, _ in group]), [lane for lanes, _, _ in group for lane in lanes]
            if not first:
                _dc(stream, blocks, group[0][2], [_lookup(c) for c in codes], high, low, coef)
            elif not high:
                _ac_first(stream, blocks, _lookup(codes[0]), first, last, low, coef)
            else:
                _ac_refine(stream, blocks, _lookup(codes[0]), first, last, low, coef)
    return [coef[a:b] for a, b in zip(base, base[1:])]


def rgb(image: Image, coef: np.ndarray) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of bytes: inverse transform, chroma upsampled by repetition, then colours."""
    planes = []
    for c, (_, hs, vs, _) in enumerate(image.parts):
        w, h = image.rows[c]
        f = np.zeros((w * h, 64))
        f[:, ZIGZAG] = coef[image.first[c] : image.first[c + 1]] * image.quant[c]
        x = (f.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
        x = (np.ascontiguousarray(x).reshape(-1, 8) @ BASIS).reshape(h, w, 8, 8)
        x = np.floor(x * 2.0**-24 + 128.5).clip(0, 255).transpose(0, 3, 1, 2).reshape(h * 8, w * 8)
        x = x.repeat(image.vmax // vs, axis=0).repeat(image.hmax // hs, axis=1)
        planes.append(x[: image.height, : image.width])
    if len(planes) == 1:
        planes *= 3
        return np.stack(planes, axis=-1).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def payload(image: Image, coef: np.ndarray) -> bytes | None:
    """The payload that encode() stored; None for an image from elsewhere."""
    if image.payload is None:
        return None
    order = np.concatenate([np.concatenate([image.first[c] + np.arange(h)[:, None] * image.rows[c][0] + np.arange(w)]).ravel() for c, (w, h) in enumerate(image.real)])
    v = coef[order[: image.payload // 64]]
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


def images(media: bytes) -> list[bytes]:
    """The JPEGs of a stored form, one after another: an end marker with a start marker behind it lies only between two of them."""
    out, at = [], 0
    while (end := media.find(b"\xff\xd9\xff\xd8", at)) >= 0:
        out.append(media[at : end + 2])
        at = end + 2
    return [*out, media[at:]]


class _Row:
    """What is read back of a row, an image at a time."""

    def __init__(self, doc_id, n_bytes, media: bytes | None, keep_rgb: bool):
        self.doc_id, self.n_bytes, self.keep_rgb = doc_id, n_bytes, keep_rgb
        self.media = media if media is None else (len(media), hashlib.sha256(media).hexdigest())
        self.left = images(media)[::-1] if media is not None else []
        self.waiting, self.sha, self.size, self.tail, self.whole = len(self.left), hashlib.sha256(), 0, b"", True
        self.sums, self.greens, self.pixels, self.shape, self.tensors = np.zeros(3, np.int64), np.zeros(8, np.int64), 0, None, []

    def add(self, image: Image, coef: np.ndarray) -> None:
        body, tensor = payload(image, coef), rgb(image, coef)
        if body is None:
            self.whole = False
        else:
            self.sha.update(body)
            self.size, self.tail = self.size + len(body), (self.tail + body)[-64:]
        h, w, _ = tensor.shape
        self.shape = self.shape or (w, h)
        self.pixels += h * w
        self.sums += tensor.sum(axis=(0, 1), dtype=np.int64)
        self.greens += np.bincount((tensor[:, :, 1] >> 5).ravel(), minlength=8)
        if self.keep_rgb:
            self.tensors.append({"height": h, "width": w, "rgb": tensor.tobytes()})
        self.waiting -= 1

    def result(self) -> tuple:
        if self.media is None:
            return (self.doc_id, self.n_bytes, *[None] * 6, None)
        held = (self.size, self.sha.hexdigest(), zlib.crc32(self.tail)) if self.whole else (None, None, None)
        return (self.doc_id, self.n_bytes, *held, *self.media, feature(self.shape, self.pixels, self.sums, self.greens), self.tensors)


def feature(shape: tuple[int, int], pixels: int, sums: np.ndarray, greens: np.ndarray) -> str:
    """Size of the (first) image, mean of each channel and the counts of eight ranges of green over all its images' pixels."""
    means = ",".join(f"{x / pixels:.3f}" for x in sums.tolist())
    return f"{shape[0]}x{shape[1]};{means};" + "-".join(map(str, greens.tolist()))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a progressive JPEG. Null and empty texts are one block of zeros.

    A payload of over ``TILE`` bytes is several images, one after another, so
    that no task ever works on more than ``BATCH_BYTES`` of a very long text
    at a time. Equal texts have equal media. Null ids and repeated rows are
    stored like others, other columns are ignored, whatever their names, and
    an empty table gives an empty result.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: deque[tuple] = deque()  # (doc_id, n_bytes, number of images, images)
        tiles: list[tuple[tuple, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for (row, _), image in zip(tiles, encode([t for _, t in tiles])):
                row[3].append(image)
            tiles.clear()
            done = []
            while rows and len(rows[0][3]) == rows[0][2]:
                done.append(rows.popleft())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([b"".join(r[3]) for r in done], pa.binary())], ["doc_id", "n_bytes", "media"])

        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                n, body = padded(text.as_py())
                row = (doc_id, n, -(-len(body) // TILE), [])
                rows.append(row)
                for at in range(0, len(body), TILE):
                    tiles.append((row, body[at : at + TILE]))
                    size += len(tiles[-1][1])
                    if size >= BATCH_BYTES:
                        yield from flush()
                        size = 0
        if tiles:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


#: Columns that read() returns, and the tensors that it adds: one of each image, full-resolution RGB by row, column and channel.
READ = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
TENSORS = "array<struct<height: int, width: int, rgb: binary>>"


def read(media: DataFrame, keep_rgb: bool = False) -> DataFrame:
    """Reads store()'s column back: payload size, digests and feature of each row, with keep_rgb its RGB ``tensors`` too.

    A null media has nulls but for the id and n_bytes. JPEGs from elsewhere,
    without a payload, have no payload columns but a feature. Null ids and
    repeated rows are returned like others, other columns are ignored, and an
    empty table gives an empty result. Very long media are decoded an image
    at a time.
    """
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = ", ".join(f"{c} {t}" for c, t in READ.items()) + (f", tensors {TENSORS}" if keep_rgb else "")
    tensors = pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: deque[_Row] = deque()
        group: list[tuple[_Row, Image]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for (row, image), coef in zip(group, coefficients([i for _, i in group]) if group else []):
                row.add(image, coef)
            group.clear()
            done = []
            while rows and not rows[0].waiting:
                done.append(rows.popleft().result())
            if done:
                arrays = [pa.array([r[k] for r in done], kinds[t]) for k, t in enumerate(READ.values())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array([r[8] for r in done], tensors)] if keep_rgb else []), [*READ, *(["tensors"] if keep_rgb else [])])

        size = 0
        for b in batches:
            for doc_id, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                row = _Row(doc_id, n, raw.as_py(), keep_rgb)
                rows.append(row)
                while row.left:
                    part = row.left.pop()
                    group.append((row, Image(part)))
                    size += len(part)
                    if size >= BATCH_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decoded, schema)
