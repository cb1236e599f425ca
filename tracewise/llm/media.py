"""Op 9. Media columns as baseline JPEG.

A payload byte is one 8x8 luminance block: with DC step 8 its quantised DC value is the byte
less 128, and every AC value is zero. 64 blocks make a row, a row is a restart interval, and
a frame holds at most 8191 rows, so a longer payload is several frames one after the other.
The frame's own Huffman tables give each block 16 bits (code lengths fall as magnitudes
grow), which also keeps 0xFF out of the scan.

Reading back doesn't rely on that: it parses the markers, removes stuffing, Huffman-decodes
the scans of any baseline frame (components together or a scan each, sampling factors, restart
intervals, tables that change between scans), and reconstructs the luminance thumbnail from DC values only. Restart intervals of frames
with the same tables are decoded in step as numpy arrays.

Cases: null text is the empty text, whose payload is 64 zero bytes. Equal texts give equal
values. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 64
ROWS = 8191


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(maxsize=1)
def _words() -> np.ndarray:
    """Huffman code, magnitude and end-of-block code of each difference from -255 to 255, as one 16-bit word."""
    code, out = 0, np.zeros(511, ">u2")
    for size in range(8, -1, -1):
        length = 12 - size
        for d in [0] if size == 0 else [*range(-(2**size) + 1, -(2 ** (size - 1)) + 1), *range(2 ** (size - 1), 2**size)]:
            bits = d if d > 0 else d + 2**size - 1 if size else 0
            out[d + 255] = ((code << size) | bits) << (16 - length - size)
        code = (code + 1) << 1
    return out


@lru_cache(maxsize=1)
def _tables() -> bytes:
    dqt = _segment(0xDB, bytes([0, 8] + [1] * 63))
    dc = _segment(0xC4, bytes([0x00, 0, 0, 0, *[1] * 9, 0, 0, 0, 0, *range(8, -1, -1)]))
    ac = _segment(0xC4, bytes([0x10, 0, 0, 0, 1, *[0] * 12, 0]))
    return dqt + dc + ac + _segment(0xDD, BLOCKS.to_bytes(2, "big"))


def encode_payload(payload: bytes) -> bytes:
    """Frames whose thumbnails are the payload, in order. Its length is a multiple of 64."""
    out = []
    values = np.frombuffer(payload, np.uint8).reshape(-1, BLOCKS)
    for at in range(0, len(values), ROWS):
        rows = values[at : at + ROWS].astype(np.int16)
        rows[:, 1:] -= rows[:, :-1].copy()
        rows[:, 0] -= 128
        scan = np.empty((len(rows), 2 * BLOCKS + 2), np.uint8)
        scan[:, : 2 * BLOCKS] = _words()[rows + 255].view(np.uint8)
        scan[:, -2] = 0xFF
        scan[:, -1] = 0xD0 + np.arange(len(rows)) % 8
        frame = _segment(0xC0, b"\x08" + (8 * len(rows)).to_bytes(2, "big") + (8 * BLOCKS).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        out.append(b"\xff\xd8" + _tables() + frame + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan.tobytes()[:-2] + b"\xff\xd9")
    return b"".join(out)


def huffman_table(counts: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits to come: code length * 256 + value; 0 where no code fits."""
    table, code, k = np.zeros(65536, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for v in values[k : k + n]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + v
            code += 1
        k += n
        code <<= 1
    return table


_huffman = lru_cache(maxsize=64)(huffman_table)


@dataclass
class Scan:
    """A scan with the tables that held when it began."""

    parts: list[tuple[int, int, int]]  # component index, DC table, AC table
    huffman: dict[int, tuple[bytes, bytes]]
    quant: dict[int, int]
    interval: int
    data: bytes


class Frame:
    """One parsed baseline frame: sizes, and its scans, each with one or more components."""

    def __init__(self):
        self.quant: dict[int, int] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.interval = 0
        self.width = self.height = 0
        self.parts: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical, quantiser
        self.scans: list[Scan] = []

    @property
    def luma(self) -> Scan:
        """The scan that holds the first component."""
        found = [s for s in self.scans if any(c == 0 for c, _, _ in s.parts)]
        if not found:
            raise ValueError("no scan of the first component")
        return found[0]

    @property
    def most(self) -> tuple[int, int]:
        return max(h for _, h, _, _ in self.parts), max(v for _, _, v, _ in self.parts)

    @property
    def samples(self) -> tuple[int, int]:
        """Samples of the first component across and down."""
        (_, h, v, _), most = self.parts[0], self.most
        return -(-self.width * h // most[0]), -(-self.height * v // most[1])

    @property
    def units(self) -> tuple[int, int]:
        """Minimum coded units of the first component's scan across and down: blocks, where it is alone in it."""
        if len(self.luma.parts) == 1:
            wide, high = self.samples
            return -(-wide // 8), -(-high // 8)
        h, v = self.most
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(media: bytes) -> list[Frame]:
    """Frames of concatenated baseline files. ValueError for anything else."""
    frames, at, frame = [], 0, None
    while at < len(media):
        if media[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = media[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == 0xD8:
            frame = Frame()
            continue
        if marker == 0xD9:
            frames.append(frame)
            continue
        size = int.from_bytes(media[at : at + 2], "big")
        body = media[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                frame.quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                frame.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            frame.interval = int.from_bytes(body, "big")
        elif marker in (0xC0, 0xC1):
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            ids = [p[0] for p in frame.parts]
            parts = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            end = at
            while (end := media.index(b"\xff", end)) >= 0 and (media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7):
                end += 2
            frame.scans.append(Scan(parts, dict(frame.huffman), dict(frame.quant), frame.interval, media[at:end]))
            at = end
    return frames


def split_intervals(data: bytes) -> list[bytes]:
    """The scan's restart intervals without stuffing."""
    raw = np.frombuffer(data, np.uint8)
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) else raw
    edges = [0, *(x for m in mark.tolist() for x in (m, m + 2)), len(raw)]
    parts = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return [p.replace(b"\xff\x00", b"\xff") for p in parts] if b"\xff\x00" in data else parts


def decode_dc(frames: list[Frame]) -> list[np.ndarray]:
    """Luminance thumbnails, one sample for each block, of frames that share tables and layout."""
    first, scan = frames[0], frames[0].luma
    alone = len(scan.parts) == 1
    lookups = [(_huffman(*scan.huffman[dc]), _huffman(*scan.huffman[16 + ac])) for _, dc, ac in scan.parts]
    blocks = [(c, k) for k, (c, _, _) in enumerate(scan.parts) for _ in range(1 if alone else first.parts[c][1] * first.parts[c][2])]
    luma = [k for k, (c, _) in enumerate(blocks) if c == 0]
    chunks, count = [], []
    for f in frames:
        total = f.units[0] * f.units[1]
        step = f.luma.interval or total
        parts = split_intervals(f.luma.data)
        chunks += parts
        count += [min(step, total - k * step) for k in range(len(parts))]
    count = np.array(count)
    starts = np.cumsum([0, *map(len, chunks)])[:-1]
    buffer = b"".join(chunks) + bytes(16)
    ahead = np.ndarray((len(buffer) - 8,), ">u8", buffer, strides=(1,))
    order = np.argsort(-count, kind="stable")
    position = (starts[order] * 8).astype(np.int64)
    value = np.zeros((len(scan.parts), len(order)), np.int64)
    out = np.zeros((int(count.max()), len(luma), len(order)), np.int16)
    live = np.searchsorted(-count[order], -np.arange(int(count.max())), "left")

    def peek(at: np.ndarray) -> np.ndarray:
        return ahead[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    for unit in range(len(out)):
        n = live[unit]
        at = position[:n]
        seen = 0
        for c, k in blocks:
            dc, ac = lookups[k]
            bits = peek(at)
            entry = dc[(bits >> np.uint64(48)).astype(np.int64)]
            length, size = entry >> 8, entry & 255
            extra = ((bits << length.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)
            extra = extra.astype(np.int64)
            value[k, :n] += extra - np.where(extra < (1 << size >> 1), (1 << size) - 1, 0)
            at = at + length + size
            if c == 0:
                out[unit, seen, :n] = value[k, :n]
                seen += 1
            todo, done = np.arange(n), np.ones(n, np.int64)
            while len(todo):
                entry = ac[(peek(at[todo]) >> np.uint64(48)).astype(np.int64)]
                run, size = (entry & 255) >> 4, entry & 15
                at[todo] += (entry >> 8) + size
                done[todo] += np.where((run == 0) & (size == 0), 64, run + 1)
                todo = todo[done[todo] < 64] if (done[todo] < 64).any() else todo[:0]
        position[:n] = at
    back = np.argsort(order)
    scale = scan.quant[first.parts[0][3]]
    thumbs, k = [], 0
    for f in frames:
        total = f.units[0] * f.units[1]
        step = f.luma.interval or total
        n = -(-total // step)
        got = np.concatenate([out[: count[j], :, back[j]] for j in range(k, k + n)]) if n > 1 and step != total else None
        if got is None:
            got = out[:total, :, back[k]]
        k += n
        h, v = (1, 1) if alone else (f.parts[0][1], f.parts[0][2])
        across, down = f.units
        grid = got.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        wide, high = (-(-n // 8) for n in f.samples)
        samples = np.clip((grid[:high, :wide].astype(np.int32) * scale + 4) // 8 + 128, 0, 255)
        thumbs.append(samples.astype(np.uint8))
    return thumbs


def thumbnails(media: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """For each stored form, its frames with their thumbnails. Frames that share tables are decoded together."""
    parsed = [parse(m) for m in media]
    alike = defaultdict(list)
    for i, frames in enumerate(parsed):
        for j, f in enumerate(frames):
            alike[tuple(f.luma.huffman.items()), tuple(f.luma.quant.items()), tuple(f.parts), tuple(f.luma.parts), f.luma.interval].append((i, j))
    out: list[list] = [[None] * len(frames) for frames in parsed]
    for places in alike.values():
        for (i, j), thumb in zip(places, decode_dc([parsed[i][j] for i, j in places]), strict=True):
            out[i][j] = (parsed[i][j], thumb)
    return out


def thumb_hash(thumb: np.ndarray) -> str:
    """Difference hash: 8 rows of 9 samples, one bit for each pair of neighbours."""
    high, wide = thumb.shape
    small = thumb[np.ix_(np.arange(8) * high // 8, np.arange(9) * wide // 9)]
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: each text as JPEG frames."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [x or b"" for x in part.column("raw").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(map(len, raw), pa.int64()), pa.array([encode_payload(payload_of(x)) for x in raw], pa.binary())], [key, "n_bytes", "media"])

    return docs.select(key, F.col(text).cast("binary").alias("raw")).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, media binary")


def features(frames: list[tuple[Frame, np.ndarray]]) -> str:
    """Width x height of each frame and its thumbnail's hash."""
    return ";".join(f"{f.width}x{f.height}:{thumb_hash(t)}" for f, t in frames)


def media_features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, frames, width, height of the first frame, feature; nulls for media that isn't baseline JPEG."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for m in part.column(column).to_pylist():
                    try:
                        rows.append(thumbnails([m])[0] or None)
                    except (ValueError, IndexError, KeyError, TypeError):
                        rows.append(None)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([r and len(r) for r in rows], pa.int64()), pa.array([r and r[0][0].width for r in rows], pa.int64()), pa.array([r and r[0][0].height for r in rows], pa.int64()), pa.array([r and features(r) for r in rows], pa.string())], [key, "frames", "width", "height", "feature"])

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, frames bigint, width bigint, height bigint, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, and report digests of both and the features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        """Slices of about a megabyte of text."""
        sizes = np.cumsum([len(x) if x else 0 for x in batch.column("raw").to_pylist()])
        cuts = sorted({0, *(np.searchsorted(sizes, np.arange(2**20, sizes[-1], 2**20)) + 1).tolist(), len(sizes)}) if len(sizes) else [0]
        for a, b in pairwise(cuts):
            part = batch.slice(a, b - a)
            yield part, [x or b"" for x in part.column("raw").to_pylist()]

    def run(batches):
        for batch in batches:
            for part, raw in groups(batch):
                media = [encode_payload(payload_of(x)) for x in raw]
                rows = []
                for x, m, frames in zip(raw, media, thumbnails(media), strict=True):
                    payload = b"".join(t.tobytes() for _, t in frames)
                    rows.append((len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(frames)))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, schema)
