"""Texts as PNG images in a binary column, and perceptual hashes of such images.

An image is an 8-bit greyscale PNG of WIDTH samples a row, its payload the UTF-8 bytes of a
text filled up with zeros. Rows are filtered, each with the filter that leaves the smallest differences, as PNG's own rule for such samples has it. Chunks are checked by their CRC, the pixel stream by zlib's Adler-32,
and the rows of all images of a batch are unfiltered together with numpy, diagonal by diagonal. The feature is the sign pattern of the lowest frequencies of a cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shared import documents_text, lean, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Image bytes of an IDAT chunk at most.
CHUNK = 1 << 16
#: Bytes that a byte of a zlib stream can stand for at most: a header that promises more is wrong, so what is unpacked is bounded by what is stored.
EXPANDS = 1032
#: Rows whose filters are chosen at a time, and rows of images that are unfiltered together, about.
ROWS = 1 << 14
#: Side of the picture that is transformed, and of the block of low frequencies.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _guesses(left: np.ndarray, up: np.ndarray, corner: np.ndarray, kind: int) -> np.ndarray:
    """What a filter of this kind (1 to 4) takes off a sample, of its neighbours as 16-bit numbers."""
    if kind == 1:
        return left
    if kind == 2:
        return up
    if kind == 3:
        return (left + up) >> 1
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of samples with their filter type before them, the one whose differences (as signed bytes) have the least sum. first: which rows begin an image."""
    out = np.zeros((len(rows), rows.shape[1] + 1), dtype=np.uint8)
    for a in range(0, len(rows), ROWS):
        own = rows[a : a + ROWS].astype(np.int16)
        up = np.zeros_like(own)
        up[1:] = own[:-1]
        if a:
            up[0] = rows[a - 1]
        up[first[a : a + ROWS]] = 0
        left, corner = np.zeros_like(own), np.zeros_like(own)
        left[:, 1:], corner[:, 1:] = own[:, :-1], up[:, :-1]
        best, best_cost = own.astype(np.uint8), np.abs(own.astype(np.int8).astype(np.int16)).sum(axis=1)
        kinds = np.zeros(len(own), dtype=np.uint8)
        for kind in range(1, 5):
            rest = (own - _guesses(left, up, corner, kind)).astype(np.uint8)
            cost = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=1)
            better = cost < best_cost
            best[better], best_cost[better], kinds[better] = rest[better], cost[better], kind
        out[a : a + ROWS, 0], out[a : a + ROWS, 1:] = kinds, best
    return out


def encode_all(payloads: list[bytes], level: int = 6) -> list[bytes]:
    """Each payload (a positive multiple of WIDTH bytes) as a greyscale PNG of filtered rows."""
    counts = np.array([len(p) // WIDTH for p in payloads], dtype=np.int64)
    ends = np.cumsum(counts)
    first = np.zeros(int(counts.sum()), dtype=bool)
    first[ends - counts] = True
    raw = filtered(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, WIDTH), first)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        data = zlib.compress(raw[end - n : end], level)
        head = struct.pack(">IIBBBBB", WIDTH, n, 8, 0, 0, 0, 0)
        parts = [_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
        out.append(SIGNATURE + _chunk(b"IHDR", head) + b"".join(parts) + _chunk(b"IEND", b""))
    return out


def encode_png(payload: bytes, level: int = 6) -> bytes:
    return encode_all([payload], level)[0]


def unfilter_all(raws: list[np.ndarray]) -> list[np.ndarray]:
    """Reverses the PNG row filters of images of one width. raws: for each image a row of bytes a scan line, its filter type first.

    A sample needs the ones to its left, above and between, so all samples of one diagonal of all images are told at once. Rows are
    laid out by their number in the image, tallest images first: a diagonal's rows stand together."""
    kinds = [r[:, 0] for r in raws]
    if any(k.max(initial=0) > 4 for k in kinds):
        raise ValueError("unknown PNG filter")
    if not any(k.any() for k in kinds):
        return [r[:, 1:] for r in raws]
    width = raws[0].shape[1]
    heights = np.array([len(r) for r in raws])
    rank = np.argsort(np.argsort(-heights, kind="stable"), kind="stable")
    alive = np.searchsorted(np.sort(-heights), -np.arange(heights.max() + 1), side="left")  # images with a row of that number
    start = np.concatenate(([0], np.cumsum(alive[: heights.max()])))
    total = int(start[-1])
    sample = np.zeros((total + 1, width), dtype=np.uint8)  # a zero column for what is left of an image, a zero row for what is above it
    kind, line, above = np.zeros(total, dtype=np.uint8), np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
    places = []
    for r, j in zip(raws, rank.tolist(), strict=True):
        at = start[: len(r)] + j
        sample[at, 1:] = r[:, 1:]
        kind[at], line[at] = r[:, 0], np.arange(len(r))
        above[at] = np.concatenate(([total], at[:-1]))
        places.append(at)
    flat = sample.reshape(-1)
    here, over = np.arange(total) * width + 1 - line, above * width + 1 - line
    odd = [kind == k for k in range(1, 5)]
    for d in range(int(heights.max()) + width - 2):
        rows = slice(start[max(0, d - width + 2)], start[min(len(start) - 1, d + 1)])
        own = here[rows] + d
        left, up, corner = (flat[x].astype(np.int16) for x in (own - 1, over[rows] + d, over[rows] + d - 1))
        guess = np.zeros(len(own), dtype=np.int16)
        for k in range(1, 5):
            if (mask := odd[k - 1][rows]).any():
                np.copyto(guess, _guesses(left, up, corner, k), where=mask)
        flat[own] += guess.astype(np.uint8)
    return [sample[at, 1:] for at in places]


def unfilter(raw: np.ndarray) -> np.ndarray:
    return unfilter_all([raw])[0]


def scan_lines(image: bytes) -> np.ndarray:
    """The filtered scan lines of an 8-bit, not interlaced greyscale PNG, filter types first. ValueError: broken or of another kind."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(image) and not ended:
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if len(data) != size or image[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError("broken PNG chunk")
        if kind == b"IHDR":
            if size != 13 or head is not None:
                raise ValueError("broken PNG header")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no 8-bit greyscale PNG")
    width, height = head[:2]
    if not width or not height:
        raise ValueError("PNG without samples")
    if height * (width + 1) > EXPANDS * (sum(map(len, parts)) + 1):
        raise ValueError("PNG of too many samples")
    size, stream = height * (width + 1), zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(parts), size + 1)
    except zlib.error as error:
        raise ValueError("broken PNG data") from error
    if len(raw) != size or not stream.eof:
        raise ValueError("PNG data of another size")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].max() > 4:
        raise ValueError("unknown PNG filter")
    return lines


def decode_png(image: bytes) -> np.ndarray:
    """The samples of a PNG as scan_lines() reads it, one row a scan line."""
    return unfilter(scan_lines(image))


def decode_all(images: list[bytes | None]) -> Iterator[tuple[int, np.ndarray | ValueError]]:
    """(place, samples or what is wrong) of every image, in any order."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def flush(width: int) -> Iterator[tuple[int, np.ndarray]]:
        some = held.pop(width)
        yield from zip([i for i, _ in some], unfilter_all([x for _, x in some]), strict=True)

    for i, image in enumerate(images):
        try:
            lines = scan_lines(image or b"")
        except ValueError as error:
            yield i, error
            continue
        width = lines.shape[1]
        held.setdefault(width, []).append((i, lines))
        if sum(len(x) for _, x in held[width]) * width >= ROWS * WIDTH:
            yield from flush(width)
    for width in list(held):
        yield from flush(width)


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_COS = _cosines(SIDE, LOW)


def _shrunk(image: np.ndarray) -> np.ndarray:
    """SIDE x SIDE means of the pixels that fall in each cell; a smaller image is repeated."""
    for axis in (0, 1):
        n = image.shape[axis]
        if n < SIDE:
            image = np.repeat(image, -(-SIDE // n), axis=axis)
            n = image.shape[axis]
        cuts = np.arange(SIDE) * n // SIDE
        sizes = np.diff(np.append(cuts, n))
        image = np.add.reduceat(image.astype(np.float64), cuts, axis=axis) / (sizes[:, None] if axis == 0 else sizes)
    return image


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the LOW x LOW lowest cosine terms, the mean's apart, are above their median."""
    terms = np.rint(_COS @ _shrunk(image) @ _COS.T * 1024).reshape(-1)
    terms[0] = 0
    return np.packbits(terms > np.median(terms[1:])).tobytes().hex()


def with_images(docs: DataFrame, level: int = 6) -> DataFrame:
    """doc_id, n_bytes and media (binary: the text as PNG), a row for each row of docs. A null text is the empty one: WIDTH zeros. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_buffer().to_pybytes() for t in batch["text"]]
            media, some, size = [], [], 0
            for b in raw:
                some.append(b + bytes(-len(b) % WIDTH if b else WIDTH))
                size += len(b)
                if size >= ROWS * WIDTH:
                    media += encode_all(some, level)
                    some, size = [], 0
            media += encode_all(some, level)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents_text(docs).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def image_features(media: DataFrame) -> DataFrame:
    """Reads the images of a binary column back. A row for each row of media (doc_id, n_bytes, media): those ids
    and sizes, payload_bytes, payload_sha256, tail_crc32 (of the last WIDTH bytes), media_bytes, media_sha256, feature and
    error (null unless media is null or no image of this kind; then the payload's columns and the feature are null)."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = batch["media"].to_pylist()
            rows: list[tuple] = [()] * len(images)
            for i, found in decode_all(images):
                image = images[i]
                own = (None, None) if image is None else (len(image), hashlib.sha256(image).hexdigest())
                if isinstance(found, ValueError):
                    rows[i] = (None, None, None, *own, None, str(found))
                else:
                    payload = found.tobytes()
                    rows[i] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *own, cosine_hash(found), None)
            cols = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", F.col("n_bytes"), "media").mapInArrow(lean(run), schema)
