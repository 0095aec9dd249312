import hashlib
import zlib

import numpy as np

from isopleth.llm import media


class _Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - k) & 1 for k in range(n)]

    def done(self):
        raw = np.packbits(np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)).tobytes()
        self.bits = []
        return raw.replace(b"\xff", b"\xff\x00")


def _magnitude(v):
    n = abs(int(v)).bit_length()
    return n, int(v) if v > 0 else int(v) + (1 << n) - 1


def slow_stream(coef, interval):
    """A plain progressive encoder of one plane (h, w, 64 in zigzag order): runs, ended runs, two refinements, restarts. All codes have 8 bits."""
    h, w, _ = coef.shape
    blocks = coef.reshape(-1, 64)
    code = lambda bits, symbol: bits.put(symbol, 8)  # noqa: E731  canonical codes of one length are the symbols in order
    table = media._huffman(0, 0, dict.fromkeys(range(255), 8)) + media._huffman(1, 0, dict.fromkeys(range(255), 8))
    out = [b"\xff\xd8", media._segment(0xDB, b"\0" + bytes(range(1, 65))), media._segment(0xC2, bytes([8, 0, 8 * h, 0, 8 * w, 1, 1, 0x11, 0])), table, media._segment(0xDD, bytes([0, interval]))]

    def scan(first, last, high, low, f):
        parts = []
        for at in range(0, len(blocks), interval):
            bits = _Bits()
            f(bits, blocks[at : at + interval], first, last, low)
            parts.append(bits.done() + bytes([0xFF, 0xD0 + at // interval % 8]))
        out.extend([media._segment(0xDA, bytes([1, 1, 0, first, last, high << 4 | low])), b"".join(parts)[:-2]])

    def dc(bits, some, first, last, low):
        pred = 0
        for b in some:
            v = int(b[0]) >> low
            n, m = _magnitude(v - pred) if v != pred else (0, 0)
            code(bits, n)
            bits.put(m, n)
            pred = v

    def ac(bits, some, first, last, low):
        run = 0

        def flush():
            nonlocal run
            while run:
                r = min(14, run.bit_length() - 1)
                n = min(run, (2 << r) - 1)
                code(bits, r << 4)
                bits.put(n - (1 << r), r)
                run -= n

        for b in some:
            v = [int(np.sign(x)) * (abs(int(x)) >> low) for x in b[first : last + 1]]
            zeros = 0
            for x in v:
                if not x:
                    zeros += 1
                    continue
                flush()
                while zeros > 15:
                    code(bits, 0xF0)
                    zeros -= 16
                n, m = _magnitude(x)
                code(bits, zeros << 4 | n)
                bits.put(m, n)
                zeros = 0
            if zeros:
                run += 1
        flush()

    def refine(bits, some, first, last, low):
        for b in some:
            v = [abs(int(x)) >> low for x in b[first : last + 1]]
            k, end = 0, max([i for i, x in enumerate(v) if x == 1], default=-1) + 1
            while k < end:
                zeros, fixes, j = 0, [], k
                while v[j] != 1:
                    if v[j] > 1:
                        fixes.append(v[j] & 1)
                    else:
                        zeros += 1
                        if zeros == 16:
                            break
                    j += 1
                if zeros == 16:
                    code(bits, 0xF0)
                else:
                    code(bits, zeros << 4 | 1)
                    bits.put(int(b[first + j] > 0), 1)
                for f in fixes:
                    bits.put(f, 1)
                k = j + 1
            if k <= last - first:
                code(bits, 0)
                for x in v[k:]:
                    if x > 1:
                        bits.put(x & 1, 1)

    scan(0, 0, 0, 1, dc)
    scan(1, 5, 0, 2, ac)
    scan(6, 63, 0, 2, ac)
    scan(1, 63, 2, 1, refine)
    scan(0, 0, 1, 0, lambda bits, some, *_: [bits.put(int(b[0]) & 1, 1) for b in some])
    scan(1, 63, 1, 0, refine)
    return b"".join([*out, b"\xff\xd9"])


def test_general_progressive_streams():
    rng = np.random.default_rng(1)
    images, want = [], []
    for k, (h, w) in enumerate([(3, 4), (1, 1), (5, 7)]):
        c = rng.integers(-40, 41, (h, w, 64)) * (rng.random((h, w, 64)) < (0.05, 0.5, 0.2)[k])
        c[0, 0, 1:] = 0
        images.append(media.Image(slow_stream(c, 3)))
        want.append(c.reshape(-1, 64))
    for got, c in zip(media.coefficients(images), want):
        assert np.array_equal(got, c)
    x = media.rgb(images[0], want[0])
    assert x.shape == (24, 32, 3)
    grid = np.array([[np.sqrt(1 / 8) if u == 0 else 0.5 * np.cos((2 * i + 1) * u * np.pi / 16) for i in range(8)] for u in range(8)])
    f = np.zeros(64)
    f[media.ZIGZAG] = want[0][5] * np.arange(1, 65)
    plain = np.clip(np.floor(grid.T @ f.reshape(8, 8) @ grid + 128.5), 0, 255)
    assert np.abs(x[8:16, 8:16, 0].astype(int) - plain).max() <= 1


def test_zigzag():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG.tolist()) == list(range(64))


def test_chroma_is_upsampled():
    c = np.zeros((6, 64), np.int32)
    image = media.Image(media.encode([bytes(64 * 6)])[0])
    c[4, 0] = 400
    x = media.rgb(image, c)
    assert x.shape == (16, 16, 3) and len(np.unique(x.reshape(-1, 3), axis=0)) == 1 and x[0, 0, 2] > 128


class _Reader:
    """Bits of one restart interval."""

    def __init__(self, raw):
        self.bits, self.at = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0

    def take(self, n):
        v = 0
        for _ in range(n):
            v, self.at = v << 1 | self.bits[self.at], self.at + 1
        return v

    def symbol(self, table):
        code = n = 0
        while (n, code) not in table or not n:
            code, n = code << 1 | self.take(1), n + 1
        return table[n, code]

    def signed(self, n):
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def slow_tensor(raw):
    """A plain progressive decoder of three-component 4:2:0 images: a scan, an interval, a block and a coefficient at a time."""
    tables, interval, coef, at, grids = {}, 0, None, 2, []
    while raw[at + 1] != 0xD9:
        marker, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for length, c in enumerate(counts, 1):
                    for _ in range(c):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], body = table, body[k:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            w, h = width // 8, height // 8
            grids = [(w, h), ((w + 1) // 2, (h + 1) // 2), ((w + 1) // 2, (h + 1) // 2)]
            coef = [np.zeros((gw * gh, 64), int) for gw, gh in grids]
        elif marker == 0xDA:
            assert body[0] == 1
            plane, (start, end, bits) = coef[body[1] - 1], body[-3:]
            high, low = bits >> 4, bits & 15
            dc, ac = tables.get(body[2] >> 4), tables.get(0x10 | body[2] & 15)
            stop = at
            while not (raw[stop] == 0xFF and raw[stop + 1] != 0 and not 0xD0 <= raw[stop + 1] <= 0xD7):
                stop += 1
            parts, last, k = [], at, at
            while k < stop:
                if raw[k] == 0xFF and 0xD0 <= raw[k + 1] <= 0xD7:
                    parts.append(raw[last:k])
                    last = k = k + 2
                else:
                    k += 1
            parts.append(raw[last:stop])
            for i, part in enumerate(parts):
                r, pred, run = _Reader(part), 0, 0
                for b in plane[i * interval : (i + 1) * interval]:
                    if not start:
                        if high:
                            b[0] |= r.take(1) << low
                        else:
                            pred += r.signed(r.symbol(dc))
                            b[0] = pred << low
                        continue
                    k = start
                    while k <= end and not run:
                        zeros, size = divmod(r.symbol(ac), 16)
                        if not size and zeros < 15:
                            run = (1 << zeros) + r.take(zeros)
                            break
                        value = (1 if r.take(1) else -1) if high and size else r.signed(size)
                        while k <= end:
                            if high and b[k]:
                                b[k] += np.sign(b[k]) * (r.take(1) << low)
                            elif not zeros:
                                break
                            else:
                                zeros -= 1
                            k += 1
                        if size:
                            b[k] = value * (1 << low)
                        k += 1
                    if run:
                        while high and k <= end:
                            if b[k]:
                                b[k] += np.sign(b[k]) * (r.take(1) << low)
                            k += 1
                        run -= 1
            at = stop
    basis = np.array([[np.sqrt(1 / 8) if u == 0 else 0.5 * np.cos((2 * i + 1) * u * np.pi / 16) for i in range(8)] for u in range(8)])
    planes = []
    for c, (gw, gh) in enumerate(grids):
        x = np.zeros((gh * 8, gw * 8))
        for k in range(gw * gh):
            f = np.zeros(64)
            f[media.ZIGZAG] = coef[c][k]
            x[k // gw * 8 :, k % gw * 8 :][:8, :8] = np.clip(np.floor(basis.T @ f.reshape(8, 8) @ basis + 128.5), 0, 255)
        planes.append((x if c == 0 else x.repeat(2, axis=0).repeat(2, axis=1))[:height, :width])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.floor(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1) + 0.5), 0, 255).astype(np.uint8), coef


def test_stored_images_by_a_plain_decoder(docs):
    """Bytes, digests, tensors and features of short texts against a decoder and statistics of this file's own."""
    frame = docs.where("length(text) < 2500").orderBy("doc_id").limit(12)
    stored = {r.doc_id: bytes(r.media) for r in media.store(frame).collect()}
    rows = media.read(media.store(frame), keep_rgb=True).collect()
    assert len(rows) == 12
    for r in rows:
        raw = stored[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        want, coef = slow_tensor(raw)
        flat = np.concatenate(coef)[: r.payload_bytes // 64]
        assert hashlib.sha256(np.where(flat > 0, flat, flat + 255).astype(np.uint8).tobytes()).hexdigest() == r.payload_sha256
        (t,) = r.tensors
        got = np.frombuffer(bytes(t.rgb), np.uint8).reshape(t.height, t.width, 3)
        assert got.shape == want.shape and np.abs(got.astype(int) - want).max() <= 4 and np.abs(got.astype(int) - want).mean() < 0.2  # the basis is in units of 2**-12
        size, means, greens = r.feature.split(";")
        assert size == f"{t.width}x{t.height}" and means == ",".join(f"{got[:, :, c].mean():.3f}" for c in range(3))
        assert greens == "-".join(str(((got[:, :, 1] >= 32 * k) & (got[:, :, 1] < 32 * k + 32)).sum()) for k in range(8))


def check(frame):
    rows = {r.doc_id: r for r in media.read(media.store(frame)).collect()}
    for r in frame.select("doc_id", "text").collect():
        n, body = media.padded(r.text)
        got = rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))


def test_documents(docs):
    check(docs)


def test_equal_texts_equal_values(spark, docs):
    twice = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")).repartition(3)
    got = media.read(media.store(twice)).selectExpr("doc_id % 100000 AS k", "media_sha256", "feature").distinct()
    assert got.count() == docs.count()


def test_odd_rows(spark, odd, empty):
    check(odd)
    assert media.read(media.store(empty)).count() == 0
    kept = media.read(media.store(odd), keep_rgb=True).select("tensors").collect()
    assert all(len(t.rgb) == 3 * t.height * t.width for r in kept for t in r.tensors)
    assert {"media_sha256", "feature"} <= set(media.read(media.store(odd)).columns)
    frame = spark.createDataFrame([(1, 5, None), (None, None, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.doc_id, r.n_bytes, r.feature, r.media_bytes) for r in media.read(frame).collect()] == [(1, 5, None, None), (None, None, None, None)]


def test_an_image_from_elsewhere_has_no_payload(spark):
    raw = slow_stream(np.zeros((2, 2, 64), int), 2)
    r = media.read(spark.createDataFrame([(1, 5, bytearray(raw))], "doc_id long, n_bytes long, media binary")).first()
    assert r.payload_bytes is None and r.payload_sha256 is None and r.media_bytes == len(raw) and r.feature.startswith("16x16;")


def test_very_long_texts_are_several_images(spark):
    """A text over the size of an image, between two short ones: read back whole, in order, equal for equal texts."""
    long = "".join(chr(33 + (i * i + i // 7) % 90) for i in range(2 * media.TILE + 1000))
    frame = spark.createDataFrame([(1, "short"), (2, long), (3, None), (4, long)], "doc_id long, text string").coalesce(1)
    check(frame)
    rows = {r.doc_id: r for r in media.read(media.store(frame), keep_rgb=True).collect()}
    assert [len(rows[k].tensors) for k in (1, 2, 3)] == [1, 3, 1] and rows[2].media_sha256 == rows[4].media_sha256
    pixels = np.concatenate([np.frombuffer(bytes(t.rgb), np.uint8).reshape(-1, 3) for t in rows[2].tensors])
    assert rows[2].feature.split(";")[1] == ",".join(f"{x:.3f}" for x in pixels.mean(axis=0, dtype=float))
