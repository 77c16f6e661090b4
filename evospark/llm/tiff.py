"""Media columns holding TIFF files.

``pages`` walks the chain of image directories of a file and decodes strips or tiles that are
stored plainly or with PackBits, LZW or deflate, undoes the horizontal predictor and yields one
record per page. ``encode`` writes such files. ``decode_pages`` applies the reader to a binary
column, one row per page.

Read: classic TIFF of either byte order, chunky samples of 8 or 16 bits (16-bit samples are given
in little-endian order). Defined cases: a null file has no rows; a damaged or unsupported file, an
empty one included, has one row with ``error`` set and no pixels; a chain that returns to a
directory ends there with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import chunks, lean, pick

# Fixed values of the format: tags, field types with their sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
SCHEMES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
OLD_DEFLATE = 32946
CLEAR, END = 256, 257


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    scheme: str
    pixels: bytes


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as a repeat, the rest as literals of up to 128 bytes."""
    out, raw = bytearray(), np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(raw)) + 1
    starts = np.concatenate(([0], edges)) if len(raw) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate((starts, [len(raw)])))
    literal = bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for start, n in zip(starts.tolist(), lengths.tolist()):
        if n < 3:
            literal += data[start : start + n]
            continue
        flush()
        for i in range(0, n, 128):
            k = min(128, n - i)
            out += bytes(((257 - k) & 255, data[start])) if k > 1 else bytes((0, data[start]))
    flush()
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one code early."""
    acc, bits, out = CLEAR, 9, bytearray()
    table = {bytes((i,)): i for i in range(256)}
    width, following, held = 9, 258, b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = acc << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        put(table[held])
        table[longer] = following
        following += 1
        held = data[i : i + 1]
        if following == 4094:
            put(CLEAR)
            table, width, following = {bytes((j,)): j for j in range(256)}, 9, 258
        elif following + 1 > 1 << width:
            width += 1
    if held:
        put(table[held])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last, acc, bits, made = list(roots), 9, b"", 0, 0, 0
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(roots), 9, b""
            continue
        if not last:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out.append(piece)
        made += len(piece)
        if made >= size:
            break
        last = piece
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def _packed(data: bytes, scheme: str) -> bytes:
    return {"none": bytes, "lzw": lzw_encode, "packbits": packbits_encode, "deflate": lambda x: zlib.compress(x, 1)}[scheme](data)


def _unpacked(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == SCHEMES["none"]:
        out = data
    elif scheme == SCHEMES["lzw"]:
        out = lzw_decode(data, size)
    elif scheme in (SCHEMES["deflate"], OLD_DEFLATE):
        out = zlib.decompress(data)
    elif scheme == SCHEMES["packbits"]:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {scheme}")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def encode(images: list[np.ndarray], scheme: str = "deflate", predictor: bool = False, rows_per_strip: int | None = None, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file with a page per image: ``(height, width, samples)`` arrays of uint8 or uint16."""
    head = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)
    body = bytearray(head)
    link = 4  # where the offset of the next directory goes
    for image in images:
        height, width, samples = image.shape
        bits, stored = image.dtype.itemsize * 8, []
        if tile:
            th, tw = tile
            full = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), image.dtype)
            full[:height, :width] = image
            blocks = [full[y : y + th, x : x + tw] for y in range(0, full.shape[0], th) for x in range(0, full.shape[1], tw)]
        else:
            rows = rows_per_strip or height
            blocks = [image[y : y + rows] for y in range(0, height, rows)]
        for block in blocks:
            if predictor:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            data = _packed(block.astype(block.dtype.newbyteorder(order)).tobytes(), scheme)
            stored.append((len(body), len(data)))
            body += data
        body += b"\0" * (len(body) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [SCHEMES[scheme]]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [1 + predictor])]
        at, sizes = [x[0] for x in stored], [x[1] for x in stored]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, at), (TILE_SIZES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, at), (ROWS_PER_STRIP, 4, [rows_per_strip or height]), (STRIP_SIZES, 4, sizes)]
        fields.sort()
        here = len(body)
        struct.pack_into(order + "I", body, link, here)
        beyond, table = here + 2 + 12 * len(fields) + 4, bytearray(struct.pack(order + "H", len(fields)))
        extra = bytearray()
        for tag, kind, values in fields:
            code, n = TYPES[kind]
            packed = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(packed) > 4:
                where = struct.pack(order + "I", beyond + len(extra))
                extra += packed + b"\0" * (len(packed) % 2)
            else:
                where = packed.ljust(4, b"\0")
            table += struct.pack(order + "HHI", tag, kind, len(values)) + where
        link = here + len(table)
        body += table + struct.pack(order + "I", 0) + extra
    return bytes(body)


def _directory(blob: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", blob, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
        if kind in TYPES:
            code, each = TYPES[kind]
            where = at + 10 + 12 * i
            if each * count > 4:
                (where,) = struct.unpack_from(order + "I", blob, where)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", blob, where)
    return tags, struct.unpack_from(order + "I", blob, at + 2 + 12 * n)[0]


def _page(blob: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> Page:
    one = lambda tag, default=None: tags[tag][0] if default is None or tag in tags else default
    width, height, samples, bits, scheme = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1)
    if bits not in (8, 16) or one(PLANAR, 1) != 1 or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("samples other than chunky 8 or 16 bits")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    if not width or not height or not bh or not bw:
        raise ValueError("an empty image")
    starts, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    across = -(-width // bw)
    if len(starts) != across * -(-height // bh):
        raise ValueError("strips or tiles are missing")
    out = np.empty((height, width, samples), f"<u{bits // 8}")
    for k, (start, size) in enumerate(zip(starts, sizes)):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        data = _unpacked(blob[start : start + size], scheme, rows * bw * samples * kind.itemsize)
        block = np.frombuffer(data, kind).reshape(rows, bw, samples)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=f"u{bits // 8}")
        part = out[y : y + bh, x : x + bw]
        part[:] = block[: part.shape[0], : part.shape[1]]
    names = {v: k for k, v in SCHEMES.items()} | {OLD_DEFLATE: "deflate"}
    return Page(width, height, samples, bits, names[scheme], out.tobytes())


def pages(blob: bytes) -> Iterator[Page]:
    """The file's pages in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(blob[:2]))
    if order is None or len(blob) < 8 or struct.unpack_from(order + "H", blob, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", blob, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a ring")
        seen.add(at)
        tags, following = _directory(blob, order, at)
        yield _page(blob, order, tags)
        at = following


def features(page: Page) -> str:
    """Size, mean, deviation and entropy of the samples."""
    x = np.frombuffer(page.pixels, f"<u{page.bits // 8}")
    share = np.bincount(x >> (page.bits - 8) if page.bits > 8 else x, minlength=256) / len(x)
    share = share[share > 0]
    return f"{page.width}x{page.height}x{page.samples} mean={x.mean():.6f} std={x.std():.6f} entropy={-(share * np.log2(share)).sum():.6f}"


PAGE_FIELDS = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("scheme", pa.string()), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())]


def _reader(keep: list[str], column: str):
    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column):
                source, rows = [], []
                for i, blob in enumerate(part.column(column)):
                    if not blob.is_valid:
                        continue
                    k = 0
                    try:
                        for k, p in enumerate(pages(blob.as_py())):  # noqa: B007
                            source.append(i)
                            rows.append((k, p.width, p.height, p.samples, p.bits, p.scheme, p.pixels, features(p), None))
                            k += 1
                    except (ValueError, IndexError, KeyError, struct.error, zlib.error, MemoryError) as e:
                        source.append(i)
                        rows.append((k, *[None] * 7, str(e) or type(e).__name__))
                taken = pa.array(source, pa.int64())
                columns = list(zip(*rows)) or [()] * len(PAGE_FIELDS)
                yield pa.record_batch([*(part.column(c).take(taken) for c in keep), *(pa.array(c, t) for c, (_, t) in zip(columns, PAGE_FIELDS))], [*keep, *(n for n, _ in PAGE_FIELDS)])

    return read


def decode_pages(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row per page: the columns in ``keep`` (the file's too, if named), then the page's."""
    ship(df.sparkSession)
    keep = list(keep or [])
    fields = df.select(*keep).schema.simpleString()[len("struct<") : -1]
    kinds = ", ".join(f"{n} {({'string': 'string', 'binary': 'binary', 'int32': 'int'})[str(t)]}" for n, t in PAGE_FIELDS)
    wanted = df.select(*dict.fromkeys([*keep, media_col]))
    return wanted.mapInArrow(_reader(keep, media_col), ", ".join(x for x in (fields.replace(":", " "), kinds) if x))


#: Texts are stored as rows of 24 x 24 samples, in strips of so many rows.
BLOCK, STRIP_ROWS = 576, 64


@lean
def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            sizes, media = [], []
            for text in part.column("text"):
                raw = text.as_buffer().to_pybytes() if hasattr(text, "as_buffer") else text.as_py().encode()
                padded = raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)
                image = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK, 1)
                sizes.append(len(raw))
                media.append(encode([image], "deflate", predictor=True, rows_per_strip=STRIP_ROWS))
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's bytes, padded with 255, as a one-page file."""
    return pick(docs, id_col, text_col).mapInArrow(_writer, "doc_id long, n_bytes long, media binary")


def text_media(docs: DataFrame, tail_bytes: int = BLOCK) -> DataFrame:
    """The digests of every text stored as TIFF and read back through ``decode_pages``; the checksum
    is that of the payload's last ``tail_bytes``."""
    stored = store_texts(docs).select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    rows = decode_pages(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    size = F.octet_length("pixels").cast("long")
    tail = F.substring(F.col("pixels"), -tail_bytes, tail_bytes)
    return rows.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
