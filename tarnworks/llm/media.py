"""Media columns: byte payloads in baseline JPEG, read back as DC-only luminance thumbnails.

The writer makes grey baseline JPEG images of 64 blocks a row, one payload byte a block: the quantised DC coefficient is
the byte less 128, all AC coefficients are 0. A restart interval is one row of blocks. The reader parses the markers,
undoes byte stuffing, and decodes the Huffman codes of all restart intervals of a batch side by side, one symbol a
step; each block's DC coefficient gives one pixel of the thumbnail, which is the payload. Features are the dimensions and two
hashes of the thumbnail.

A payload of more than 8191 rows is stored as several images one after another. Null and empty texts have a payload of 64
zero bytes. Only grey baseline images are read; others raise an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.features import slices, small_batches, text_slices, trim

#: Texts and images are handled in slices of about this size.
SLICE_CHARS, SLICE_BYTES = 1_000_000, 1_000_000
ROW = 64
MOST_ROWS = 8191
#: DC categories by length of code, and the one AC symbol, end of block.
DC_CODES = {2: [5, 4], 3: [3, 7], 4: [2], 5: [1, 6, 0], 6: [8]}
AC_CODES = {1: [0]}


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, codes: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind, *[len(codes.get(n, [])) for n in range(1, 17)], *[s for n in sorted(codes) for s in codes[n]]]))


def _header(rows: int) -> bytes:
    size = (rows * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big")
    return b"\xff\xd8" + _segment(0xDB, bytes([0, 8, *[1] * 63])) + _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00") + _dht(0x00, DC_CODES) + _dht(0x10, AC_CODES) + _segment(0xDD, ROW.to_bytes(2, "big")) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


@lru_cache(1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference + 255: the bits of code, amplitude and end of block, and their number."""
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    code, of = 0, {}
    for n in range(1, 17):
        for s in DC_CODES.get(n, []):
            of[s] = (code, n)
            code += 1
        code <<= 1
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = of[size]
        value[d + 255] = (c << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = n + size + 1
    return value, length


def write_images(payloads: list[np.ndarray]) -> list[bytes]:
    """Each payload, whose length is a positive multiple of 64, as one JPEG image or several."""
    rows = np.fromiter((len(p) // ROW for p in payloads), np.int64, len(payloads))
    dc = np.concatenate(payloads).astype(np.int64).reshape(-1, ROW) - 128
    value, length = _symbols()
    diff = np.diff(dc, axis=1, prepend=0) + 255
    v, n = value[diff], length[diff]
    bits = n.sum(1)
    size = (bits + 7) // 8
    start = np.cumsum(size) - size
    at = (start * 8)[:, None] + np.cumsum(n, axis=1) - n
    w = v << (24 - (at & 7) - n)
    total = int(size.sum())
    out = np.zeros(total + 3)
    for k in range(3):
        out += np.bincount(((at >> 3) + k).ravel(), ((w >> (16 - 8 * k)) & 255).ravel(), minlength=total + 3)
    out[start + size - 1] += (1 << (-bits % 8)) - 1
    out = out[:total].astype(np.uint8)
    # byte stuffing, and after each row a restart marker or the end of its image
    stuffed = out == 255
    row_of = np.repeat(np.arange(len(size)), size)
    to = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * row_of
    scan = np.zeros(total + int(stuffed.sum()) + 2 * len(size), np.uint8)
    scan[to] = out
    mark = to[start + size - 1] + 1 + stuffed[start + size - 1]
    scan[mark] = 255
    in_text = np.arange(len(size)) - np.repeat(np.cumsum(rows) - rows, rows)
    in_image = in_text % MOST_ROWS
    last = (in_text + 1 == np.repeat(rows, rows)) | (in_image + 1 == MOST_ROWS)
    scan[mark + 1] = np.where(last, 0xD9, 0xD0 + in_image % 8)
    images, begin, row = [], 0, 0
    for r in rows.tolist():
        parts = []
        while r:
            k = min(r, MOST_ROWS)
            row += k
            end = int(mark[row - 1]) + 2
            parts += [_header(k), scan[begin:end].tobytes()]
            begin, r = end, r - k
        images.append(b"".join(parts))
    return images


@lru_cache(64)
def _lookup(tables: bytes, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol and length of its code, from a DHT segment's body; length 0 where there is none."""
    symbol, length = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    i = 0
    while i < len(tables):
        counts, own = tables[i + 1 : i + 17], tables[i] == kind
        i, code = i + 17, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                if own:
                    a = code << (16 - n)
                    symbol[a : a + (1 << (16 - n))], length[a : a + (1 << (16 - n))] = tables[i], n
                i, code = i + 1, code + 1
            code <<= 1
    return symbol, length


def parse(image: bytes, at: int = 0) -> dict:
    """Markers of one image from `at` on: dimensions, quantiser, tables, restart interval and where its scan begins."""
    if image[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    found: dict = {"tables": b"", "restart": 0, "quant": {}}
    i = at + 2
    while True:
        if image[i] != 0xFF:
            raise ValueError("no marker")
        marker, size = image[i + 1], int.from_bytes(image[i + 2 : i + 4], "big")
        body = image[i + 4 : i + 2 + size]
        i += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                found["quant"][body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 65 + 64 * wide
        elif marker == 0xC0:
            if body[5] != 1 or body[0] != 8:
                raise ValueError("only grey images of 8 bits are read")
            found |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "table": body[8]}
        elif marker == 0xC4:
            found["tables"] += body
        elif marker == 0xDD:
            found["restart"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            return found | {"dc": body[2] >> 4, "ac": 16 + (body[2] & 15), "scan": i}
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline images are read")


def thumbnails(images: list[bytes]) -> list[tuple[np.ndarray, int, int]]:
    """(pixels, width, height) of the DC-only thumbnails of each entry's images, put one below the other."""
    heads, scans, owner = [], [], []
    for k, image in enumerate(images):
        at = 0
        while at < len(image):
            head = parse(image, at)
            end = image.find(b"\xff\xd9", head["scan"])  # no stuffed byte or restart marker reads so
            heads.append(head)
            scans.append(image[head["scan"] : end] + b"\xff\xd9")
            owner.append(k)
            at = end + 2
    data = np.frombuffer(b"".join(scans), np.uint8)
    size = np.fromiter(map(len, scans), np.int64, len(scans))
    after = np.concatenate([[0], data[:-1]])
    stuffing = (data == 0) & (after == 255)
    marker = (data != 0) & (data != 255) & (after == 255)
    clean = data[~stuffing]
    place = np.cumsum(~stuffing) - 1
    ends = place[np.flatnonzero(marker)] + 1  # intervals begin here, or at 0
    begins = np.concatenate([[0], ends[:-1]])
    scan_of = np.searchsorted(np.cumsum(size), np.flatnonzero(marker))
    blocks = np.array([-(-h["width"] // 8) * -(-h["height"] // 8) for h in heads], np.int64)
    restart = np.array([h["restart"] for h in heads], np.int64)
    nth = np.arange(len(scan_of)) - np.searchsorted(scan_of, scan_of)
    step = np.where(restart > 0, restart, blocks)[scan_of]
    count = np.minimum(step, blocks[scan_of] - nth * step)
    padded = np.concatenate([clean, np.full(8, 255, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(clean), np.uint64)
    for i in range(8):
        window |= padded[i : i + len(clean)] << np.uint64(56 - 8 * i)
    first = np.cumsum(blocks) - blocks
    pixels = np.zeros(int(blocks.sum()), np.int64)
    base = first[scan_of] + nth * step
    kinds = {(h["tables"], h["dc"], h["ac"]) for h in heads}
    for tables, dc, ac in kinds:
        own = np.array([(h["tables"], h["dc"], h["ac"]) == (tables, dc, ac) for h in heads])[scan_of] & (count > 0)
        _decode(window, begins[own] * 8, count[own], base[own], pixels, _lookup(tables, dc), _lookup(tables, ac))
    quant = np.repeat(np.array([h["quant"][h["table"]] for h in heads], np.int64), blocks)
    grey = np.clip((pixels * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
    out: list[list] = [[] for _ in images]
    for k, h, a, n in zip(owner, heads, first.tolist(), blocks.tolist(), strict=True):
        out[k].append((grey[a : a + n].reshape(-(-h["height"] // 8), -1), h))
    return [(np.concatenate([x for x, _ in parts]), parts[0][1]["width"], sum(h["height"] for _, h in parts)) for parts in out]


def _decode(window: np.ndarray, at: np.ndarray, left: np.ndarray, base: np.ndarray, pixels: np.ndarray, dc: tuple, ac: tuple) -> None:
    """Decodes intervals side by side: at, bits where they begin; left, their blocks; base, where their pixels go."""
    at, left, base = at.copy(), left.copy(), base.copy()
    before = np.zeros(len(at), np.int64)
    while len(at):
        x = window[at >> 3] << (at & 7).astype(np.uint64)
        code = (x >> np.uint64(48)).astype(np.int64)
        size, n = dc[0][code], dc[1][code]
        if not n.all():
            raise ValueError("damaged scan")
        amplitude = ((x << n.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) >> (16 - size)
        before += np.where(amplitude < (1 << size) >> 1, amplitude - (1 << size) + 1, amplitude)
        pixels[base] = before
        at += n + size
        # AC symbols are passed over
        todo, k = np.arange(len(at)), np.ones(len(at), np.int64)
        while len(todo):
            x = window[at[todo] >> 3] << (at[todo] & 7).astype(np.uint64)
            code = (x >> np.uint64(48)).astype(np.int64)
            symbol, n = ac[0][code], ac[1][code]
            if not n.all():
                raise ValueError("damaged scan")
            at[todo] += n + (symbol & 15)
            k[todo] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
            todo = todo[k[todo] < 64]
        base += 1
        left -= 1
        if not left.all():
            on = left > 0
            at, left, base, before = at[on], left[on], base[on], before[on]


def thumbnail_hashes(pixels: np.ndarray) -> str:
    """Average hash and difference hash of the thumbnail, shrunk to 8 x 8 means."""
    rows = np.linspace(0, len(pixels), 9).astype(int)
    columns = np.linspace(0, pixels.shape[1], 9).astype(int)
    total = np.zeros((len(pixels) + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)
    lo, hi = np.minimum(rows[:-1], len(pixels) - 1), np.maximum(rows[1:], np.minimum(rows[:-1], len(pixels) - 1) + 1)
    cut = total[hi][:, columns] - total[lo][:, columns]
    cells = np.diff(cut, axis=1) / ((hi - lo)[:, None] * np.maximum(np.diff(columns), 1))
    average, difference = cells > cells.mean(), cells > np.roll(cells, 1, 1)
    return np.packbits(average).tobytes().hex() + "-" + np.packbits(difference).tobytes().hex()


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the text's payload as a JPEG column in the text's place, and n_bytes, the text's bytes."""
    small_batches(docs)
    out = [c for c in docs.columns if c not in (text, media, "n_bytes")]
    given = docs.select(*[F.col(f"`{c}`") for c in out], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "__text", SLICE_CHARS):
            raw = [t.encode() for t in texts]
            images = write_images([np.frombuffer(r.ljust(max(ROW, -(-len(r) // ROW) * ROW), b"\0"), np.uint8) for r in raw])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array([len(r) for r in raw], pa.int64()), pa.array(images, pa.binary())], names=[*out, "n_bytes", media])

    return given.mapInArrow(run, given.drop("__text").schema.add("n_bytes", "long").add(media, "binary"))


def describe(stored: DataFrame, media: str = "media") -> DataFrame:
    """stored with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature in the media's place."""
    small_batches(stored)
    own = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    out = [c for c in stored.columns if c not in (media, *own)]
    given = stored.select(*[F.col(f"`{c}`") for c in out], media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored_images = batch.column(media).to_pylist()
            for a, b in slices(stored_images, SLICE_BYTES):
                images = stored_images[a:b]
                thumbs = thumbnails(images)
                payloads = [p.tobytes() for p, _, _ in thumbs]
                columns = [
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(x) for x in images], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in images]),
                    pa.array([f"{w}x{h} {thumbnail_hashes(p)}" for p, w, h in thumbs]),
                ]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in out], *columns], names=[*out, *own])
        trim()

    schema = given.drop(media).schema
    for name, kind in zip(own, ("long", "string", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    return given.mapInArrow(run, schema)
