"""TIFF pages: a writer, and a reader of striped and tiled images.

Reads both byte orders; compressions none, PackBits, LZW and deflate; horizontal
predictors; 8, 16 and 32-bit samples, interleaved or in planes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns, text_slices

#: Fixed values of the TIFF 6.0 format: tags, field type sizes, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

ROW_BYTES = 192
PAGE_ROWS = 4096
STRIP_ROWS = 512


class TiffError(ValueError):
    """The bytes are not a TIFF file that this reader takes."""


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        stop = at + 1
        while stop < n and stop - at < 128 and (stop + 1 >= n or data[stop] != data[stop + 1]):
            stop += 1
        out.append(stop - at - 1)
        out += data[at:stop]
        at = stop
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Variable-width codes, high bit first; the width grows one code early."""
    first = [bytes((b,)) for b in range(256)] + [b"", b""]
    names, width, previous = list(first), 9, b""
    out, held, bits = [], 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            names, width, previous = list(first), 9, b""
            continue
        if code == 257:
            break
        if code < len(names):
            word = names[code]
        elif previous and code == len(names):
            word = previous + previous[:1]
        else:
            raise TiffError("bad LZW code")
        out.append(word)
        if previous:
            names.append(previous + word[:1])
            if len(names) + 1 >= 1 << width and width < 12:
                width += 1
        previous = word
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    codes = {bytes((b,)): b for b in range(256)}
    known, width, word = 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        grown = word + data[k : k + 1]
        if grown in codes:
            word = grown
            continue
        put(codes[word], width)
        codes[grown] = known
        known += 1
        if known >= 1 << width:
            width += 1
        if known == 4094:
            put(256, width if width < 13 else 12)
            codes, known, width = {bytes((b,)): b for b in range(256)}, 258, 9
        word = data[k : k + 1]
    if word:
        put(codes[word], width)
        known += 1
        if known >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


_UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
#: Bytes that a stored byte can stand for at most.
_MOST = {NONE: 1, LZW: 2731, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}
_PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian grey-scale file of 8-bit pages (height x width), in strips or (height, width) tiles."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            th, tw = tile
            blocks = []
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    block = np.zeros((th, tw), np.uint8)
                    part = page[y : y + th, x : x + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            packed = _PACK[compression](np.ascontiguousarray(block).tobytes())
            places.append(len(out))
            sizes.append(len(packed))
            out += packed
        if len(out) % 2:
            out.append(0)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(fields):
            value = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(value) > 4:
                entries.append(struct.pack("<HHII", tag, kind, len(values), len(out)))
                out += value
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("bad directory link")
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            shape = f"{order}{count}s" if kind == 2 else f"{order}{count * len(TYPES[kind])}{TYPES[kind][0]}"
            size, where = struct.calcsize(shape), at + 10 + 12 * k
            if size > 4:
                (where,) = struct.unpack_from(f"{order}I", data, where)
            fields[tag] = struct.unpack_from(shape, data, where)
        yield order, fields
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def read_tiff(data: bytes) -> Iterator[np.ndarray]:
    """Each page as an array (height, width, samples)."""
    try:
        for order, tags in _directories(data):
            yield _page(data, order, tags)
    except TiffError:
        raise
    except Exception as e:  # noqa: BLE001  any bytes may come in
        raise TiffError(f"damaged file: {type(e).__name__} {e}") from e


def _page(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    unpack = _UNPACK.get(one(COMPRESSION, 1))
    if unpack is None or one(BITS, 8) not in (8, 16, 32, 64):
        raise TiffError("compression or sample size not taken")
    kind = np.dtype(f"{order}u{one(BITS, 8) // 8}")
    planes = one(PLANAR, 1) == 2
    deep = 1 if planes else samples
    if TILE_OFFSETS in tags:
        bh, bw, places, sizes = one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        bh, bw, places, sizes = min(one(ROWS_PER_STRIP, height), height), width, tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    predictor = one(PREDICTOR, 1)
    if min(width, height, samples, bh, bw) < 1 or predictor not in (1, 2, 3):
        raise TiffError("no size, or a predictor that is not taken")
    across, down = -(-width // bw), -(-height // bh)
    if len(places) != len(sizes) or len(places) != across * down * (samples if planes else 1):
        raise TiffError("another number of strips or tiles than the size asks for")
    # nothing is allocated that the stored bytes can't fill
    if height * width * samples * kind.itemsize > _MOST[one(COMPRESSION, 1)] * sum(min(s, len(data)) for s in sizes):
        raise TiffError("larger than its strips or tiles can be")
    page = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(places, sizes)):
        plane, place = divmod(k, across * down)
        y, x = place // across * bh, place % across * bw
        rows = bh if TILE_OFFSETS in tags else min(bh, height - y)
        stored = unpack(data[at : at + size])
        if predictor == 3:
            # differences of bytes, a row's highest bytes first
            raw = np.frombuffer(stored, np.uint8, count=rows * bw * deep * kind.itemsize).reshape(rows, -1, deep)
            bytewise = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, bw * deep)
            block = np.ascontiguousarray(bytewise.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, bw, deep).astype(page.dtype)
        else:
            block = np.frombuffer(stored, dtype=kind, count=rows * bw * deep).reshape(rows, bw, deep).astype(page.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=page.dtype)
        block = block[: height - y, : width - x]
        target = page[y : y + block.shape[0], x : x + block.shape[1]]
        if planes:
            target[:, :, plane] = block[:, :, 0]
        else:
            target[:] = block
    return page


def tiff_pages(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """One row per page: key, page, width, height, samples, bits, pixels (row by row), error.

    A null or damaged file gives one row whose error is set and whose page is null;
    pages in front of the damage keep their rows.
    """
    fields = "page int, width int, height int, samples int, bits int, pixels binary, error string"
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1)):
                rows = []
                try:
                    for n, page in enumerate(read_tiff(data.as_py() or b"")):
                        rows.append((n, page.shape[1], page.shape[0], page.shape[2], page.dtype.itemsize * 8, page.tobytes(), None))
                except TiffError as e:
                    rows.append((None, None, None, None, None, None, str(e)))
                kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]
                columns = [pa.array([k.as_py()] * len(rows), batch.schema.field(0).type)] + [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)]
                yield pa.RecordBatch.from_arrays(columns, [key, "page", "width", "height", "samples", "bits", "pixels", "error"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, {fields}")


def payload_pages(payload: bytes) -> list[np.ndarray]:
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    return [grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)]


def media_report(docs: DataFrame, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """Store each text as a TIFF file, decode the file again and describe what came back.

    The payload is the UTF-8 text with spaces up to a positive multiple of 192
    bytes; a null text is empty. Equal texts give equal rows but for doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for text in batch.column(1):
                raw = text.as_py().encode()
                payload = raw.ljust(max(ROW_BYTES, -(-len(raw) // ROW_BYTES) * ROW_BYTES), b" ")
                media = write_tiff(payload_pages(payload), compression, predictor)
                pages = list(read_tiff(media))
                back = b"".join(p.tobytes() for p in pages)
                samples = np.frombuffer(back, np.uint8)
                seen = np.bincount(samples, minlength=256)
                share = seen[seen > 0] / len(samples)
                mean = float(samples.sum(dtype=np.int64)) / len(samples)
                feature = f"pages={len(pages)};rows={sum(p.shape[0] for p in pages)};mean={mean:.4f};levels={int((seen > 0).sum())};entropy={float(-(share * np.log2(share)).sum()):.4f}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return doc_columns(docs).mapInArrow(run, schema)
