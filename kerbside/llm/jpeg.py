"""Media columns as baseline JPEG.

Every payload byte is the DC coefficient of one 8x8 luminance block: with a DC quantiser of 8 the mean of the
block is the byte itself, so the DC-only luminance thumbnail of the file is the payload, without loss. A file is
one image, or several one after another where the payload exceeds the largest size of one. Reading parses the
markers, decodes the Huffman-coded scan, rebuilds the thumbnail from the DC coefficients alone (AC coefficients
are skipped) and hashes it.

The scans of many images are decoded together: each restart interval is a lane, and one numpy step decodes one
block of every lane. Files that this step can't take (several components, codes too long for its table) go
through a plain decoder.

Defined cases: a null text is empty; an empty text has a payload of 576 bytes 255; equal texts get equal values;
each input row gives one row, repeated ones too; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbside.llm.common import map_arrow

UNIT = 576
#: Blocks to a row: of small payloads, and of those whose rows would be too many.
NARROW, WIDE = 24, 576
MOST_ROWS = 8191
#: Images are encoded and decoded in groups of about so many blocks.
GROUP = 1 << 19
#: Code lengths of the DC size categories 0 to 8; AC has one code, end of block, of one bit.
DC_LENGTHS = (5, 3, 3, 2, 2, 6, 6, 3, 6)


def _canonical(lengths: Iterable[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), for (symbol, length) pairs, in the order of a DHT segment."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths, key=lambda x: x[1]):
        code <<= n - last
        out[symbol], code, last = (code, n), code + 1, n
    return out


_DC = _canonical(enumerate(DC_LENGTHS))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _dht(kind: int, lengths: Iterable[tuple[int, int]]) -> bytes:
    lengths = sorted(lengths, key=lambda x: x[1])
    counts = bytes(sum(n == k for _, n in lengths) for k in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(s for s, _ in lengths))


def _head(rows: int, cols: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, bytes([0, 8, *[1] * 63]))
        + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, cols * 8, 1, 1, 0x11, 0))
        + _dht(0x00, enumerate(DC_LENGTHS))
        + _dht(0x10, [(0, 1)])
        + _segment(0xDD, struct.pack(">H", cols))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def frames(payload: bytes) -> Iterator[tuple[bytes, int]]:
    """The payload as images: their bytes and blocks to a row."""
    most = WIDE * MOST_ROWS
    for at in range(0, len(payload), most):
        part = payload[at : at + most]
        yield part, NARROW if len(part) <= NARROW * MOST_ROWS else WIDE


def encode_group(group: list[tuple[bytes, int]]) -> list[bytes]:
    """A baseline JPEG file for each (payload, blocks to a row)."""
    value = np.frombuffer(b"".join(p for p, _ in group), np.uint8).astype(np.int32) - 128
    per_row = np.concatenate([np.full(len(p) // c, c) for p, c in group])
    row_end = np.cumsum(per_row)
    first = row_end - per_row
    diff = np.diff(value, prepend=0)
    diff[first] = value[first]
    size = np.zeros(256, np.int32)
    size[1:] = np.floor(np.log2(np.arange(1, 256))) + 1
    size = size[np.abs(diff)]
    code = np.array([_DC[k][0] for k in range(9)], np.int32)[size]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits = np.array(DC_LENGTHS, np.int32)[size] + size + 1
    word = ((code << size) | extra) << 1  # the last bit is the end of block
    # rows begin at whole bytes; their last byte is filled up with ones
    total = np.add.reduceat(bits.astype(np.int64), first)
    row_bytes = (total + 7) // 8
    row_start = np.cumsum(row_bytes) - row_bytes
    ends = np.cumsum(bits, dtype=np.int64)
    at = ends - bits - np.repeat(ends[first] - bits[first], per_row) + np.repeat(row_start * 8, per_row)
    fill = (row_bytes * 8 - total).astype(np.int32)
    at, bits, word = (np.concatenate(x) for x in ((at, row_start * 8 + total), (bits, fill), (word, (1 << fill) - 1)))
    word = word.astype(np.int64) << (24 - bits - (at & 7))
    n = int(row_bytes.sum())
    data = np.zeros(n + 3)
    for k in range(3):
        data += np.bincount((at >> 3) + k, (word >> (16 - 8 * k)) & 255, n + 3)
    data = data[:n].astype(np.uint8)
    # a zero follows each byte 255, a restart marker each row but the last of an image
    rows_of = [len(p) // c for p, c in group]
    number = np.concatenate([np.arange(k) for k in rows_of])
    last = np.zeros(len(number), bool)
    last[np.cumsum(rows_of) - 1] = True
    room = 1 + (data == 255).astype(np.int64)
    row_last = row_start + row_bytes - 1
    room[row_last[~last]] += 2
    to = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[to] = data
    mark = (to + room)[row_last[~last]] - 2
    out[mark], out[mark + 1] = 255, 0xD0 + number[~last] % 8
    cut = np.concatenate([[0], (to + room)[row_last[last]]])
    raw = out.tobytes()
    return [_head(k, c) + raw[cut[i] : cut[i + 1]] + b"\xff\xd9" for i, (k, (_, c)) in enumerate(zip(rows_of, group))]


class Image:
    """What the markers of one image say; ``parse`` also gives the place where the image ends."""

    __slots__ = ("components", "dht", "end", "height", "interval", "quant", "scan", "width")


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def parse(data: bytes, at: int = 0) -> Image:
    image, at = Image(), at + 2
    image.interval, image.quant, image.dht = 0, {}, {}
    while True:
        while data[at + 1] == 255:
            at += 1
        marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                image.quant[k] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [[*struct.unpack_from("3B", body, 6 + 3 * k)] for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"not a baseline image: marker {marker:x}")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.dht[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            image.interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            for c in image.components:
                c.append(tables[c[0]])
            image.end = _SCAN_END.search(data, at).start()
            image.scan = data[at : image.end]
            image.end += 2
            return image


@lru_cache(64)
def _codes(dht: bytes) -> dict[tuple[int, int], int]:
    """(length, code): symbol."""
    lengths = [k + 1 for k in range(16) for _ in range(dht[k])]
    return {(n, code): s for s, (code, n) in _canonical_of(dht[16:], lengths)}


def _canonical_of(symbols: bytes, lengths: list[int]) -> list[tuple[int, tuple[int, int]]]:
    out, code, last = [], 0, 0
    for s, n in zip(symbols, lengths):
        code <<= n - last
        out.append((s, (code, n)))
        code, last = code + 1, n
    return out


@lru_cache(64)
def _fast(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that a block may begin with: its DC difference, and its bits if an end of block follows, else 0."""
    diff, bits = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    eob = next((x for x, s in _codes(ac).items() if s == 0), None)
    for (n, code), size in _codes(dc).items():
        if eob is None or n + size + eob[0] > 16:
            continue
        extra = np.arange(1 << size)
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra) if size else extra
        whole, free = n + size + eob[0], 16 - n - size - eob[0]
        start = ((code << size | extra) << eob[0] | eob[1]) << free
        at = (start[:, None] + np.arange(1 << free)).ravel()
        diff[at], bits[at] = np.repeat(value, 1 << free), whole
    return diff, bits


def _unstuffed(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the scans without stuffing and restart markers; where their intervals start."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    full = np.flatnonzero(data[:-1] == 255)
    after = data[full + 1]
    keep = np.ones(len(data), bool)
    keep[full[after == 0] + 1] = False
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    starts = np.concatenate([np.cumsum([0, *map(len, scans[:-1])]), marks + 2])
    starts.sort()
    return data[keep], place[starts]


def _thumbnail(dc: np.ndarray, quant: int) -> np.ndarray:
    return np.clip((dc * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)


def decode_group(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance thumbnails."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        one = x.components[0]
        if len(x.components) == 1:
            groups.setdefault((x.dht[one[3] >> 4], x.dht[16 + (one[3] & 15)]), []).append(i)
        else:
            out[i] = decode_plain(x)
    for (dc, ac), own in groups.items():
        diff, bits = _fast(dc, ac)
        data, start = _unstuffed([images[i].scan for i in own])
        shape = [((images[i].height + 7) // 8, (images[i].width + 7) // 8) for i in own]
        step = [images[i].interval or r * c for i, (r, c) in zip(own, shape)]
        n = np.concatenate([np.diff([*range(0, r * c, s), r * c]) for (r, c), s in zip(shape, step)])
        word = np.zeros(len(data) + 8, np.uint32)
        padded = np.concatenate([data, np.full(11, 255, np.uint8)]).astype(np.uint32)
        for k in range(4):
            word |= padded[k : k + len(word)] << np.uint32(24 - 8 * k)
        order = np.argsort(-n, kind="stable")
        at, dc_now, left = start[order] * 8, np.zeros(len(n), np.int32), n[order]
        to = (np.cumsum(n) - n)[order]
        value = np.zeros(int(n.sum()), np.int32)
        active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
        good = np.ones(len(n), bool)
        for k, m in enumerate(active):
            p = at[:m]
            peek = (word[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(16)
            b = bits[peek]
            good[:m] &= b > 0
            dc_now[:m] += diff[peek]
            value[to[:m] + k] = dc_now[:m]
            at[:m] += b
        lane_of = np.repeat(np.arange(len(own)), [len(range(0, r * c, s)) for (r, c), s in zip(shape, step)])
        bad = set(lane_of[order][~good].tolist())
        ends = np.cumsum([r * c for r, c in shape])
        for k, (i, (r, c)) in enumerate(zip(own, shape)):
            quant = images[i].quant[images[i].components[0][2]]
            part = value[ends[k] - r * c : ends[k]].reshape(r, c)
            out[i] = decode_plain(images[i]) if k in bad else _thumbnail(part, quant)
    return out


def decode_plain(image: Image) -> np.ndarray:
    """The same for any baseline image: components interleaved and sampled as they may be, AC coefficients skipped."""
    data, starts = _unstuffed([image.scan])
    tall, wide = max(c[1] & 15 for c in image.components), max(c[1] >> 4 for c in image.components)
    if len(image.components) == 1:
        tall = wide = 1
        image.components[0][1] = 0x11
    rows, cols = -(-image.height // (8 * tall)), -(-image.width // (8 * wide))
    head = image.components[0]
    grid = np.zeros((rows * (head[1] & 15), cols * (head[1] >> 4)), np.int32)
    raw = np.unpackbits(data).tolist() + [1] * 64
    step, at, held = image.interval or rows * cols, 0, {}

    def symbol(dht: bytes) -> int:
        nonlocal at
        codes, code = _codes(dht), 0
        for n in range(1, 17):
            code, at = code << 1 | raw[at], at + 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    for unit in range(rows * cols):
        if unit % step == 0:
            at, held = int(starts[unit // step]) * 8, {}
        for c in image.components:
            down, across = c[1] & 15, c[1] >> 4
            for k in range(down * across):
                size = symbol(image.dht[c[3] >> 4])
                extra = int("".join(map(str, raw[at : at + size])) or "0", 2)
                at += size
                held[c[0]] = held.get(c[0], 0) + (extra if not size or extra >> (size - 1) else extra - (1 << size) + 1)
                if c is head:
                    grid[unit // cols * down + k // across, unit % cols * across + k % across] = held[c[0]]
                place = 1
                while place < 64 and (s := symbol(image.dht[16 + (c[3] & 15)])):
                    place += 1 + (s >> 4)
                    at += s & 15
    grid = grid[: -(-image.height * (head[1] & 15) // (8 * tall)), : -(-image.width * (head[1] >> 4) // (8 * wide))]
    return _thumbnail(grid, image.quant[head[2]])


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 areas lighter than the one to its right?"""
    r, c = (np.arange(k) * s // k for k, s in zip((8, 9), thumb.shape))
    area = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), r, 0), c, 1)
    size = np.outer(np.diff([*r, thumb.shape[0]]).clip(1), np.diff([*c, thumb.shape[1]]).clip(1))
    mean = area / size
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def _grouped(parts: Iterable, size) -> Iterator[list]:
    held, n = [], 0
    for x in parts:
        if held and n + size(x) > GROUP:
            yield held
            held, n = [], 0
        held.append(x)
        n += size(x)
    if held:
        yield held


def _encode(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
    padded = [x + b"\xff" * (-len(x) % UNIT if x else UNIT) for x in raw]
    files: list[list[bytes]] = [[] for _ in raw]
    owners, parts = [], []
    for i, p in enumerate(padded):
        for f in frames(p):
            owners.append(i)
            parts.append(f)
    coded = (x for g in _grouped(parts, lambda f: len(f[0])) for x in encode_group(g))
    for i, x in zip(owners, coded):
        files[i].append(x)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([b"".join(x) for x in files], pa.binary())],
        ["doc_id", "n_bytes", "media"],
    )


def _decode(batch: pa.RecordBatch) -> pa.RecordBatch:
    media = batch.column("media").to_pylist()
    owners, images = [], []
    for i, data in enumerate(media):
        at = 0
        while at < len(data):
            images.append(parse(data, at))
            owners.append(i)
            at = images[-1].end
    thumbs: list[list[np.ndarray]] = [[] for _ in media]
    decoded = (t for g in _grouped(images, lambda x: len(x.scan)) for t in decode_group(g))
    for i, t in zip(owners, decoded):
        thumbs[i].append(t)
    rows = []
    for data, own in zip(media, thumbs):
        payload = b"".join(t.tobytes() for t in own)
        sides = "+".join(f"{t.shape[1] * 8}x{t.shape[0] * 8}:{thumbnail_hash(t)}" for t in own)
        rows.append((
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
            hashlib.sha256(data).hexdigest(), sides,
        ))
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: the text of each document as a baseline JPEG file."""
    return map_arrow(docs.select("doc_id", "text"), "text", "doc_id long, n_bytes long, media binary", _encode)


def decode(media: DataFrame) -> DataFrame:
    """Reads ``media`` back: sizes, digests and the feature, image sides in pixels with the thumbnail's hash."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
        " media_bytes long, media_sha256 string, feature string"
    )
    return map_arrow(media.select("doc_id", "n_bytes", "media"), "media", schema, _decode)
