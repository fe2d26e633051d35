"""Media columns: Netpbm and BMP images in a binary column, as NPY tiles with difference hashes.

`decode` reads P1 to P6 (plain and raw, 1 to 16 bits) and uncompressed BMP of 1, 4, 8, 16, 24 and 32 bits (with the masks that BITFIELDS give), bottom-up or top-down, into a numpy
array of bytes, (height, width) for grey and (height, width, 3) for colour. `area_resize` averages each target pixel's
exact area, fractions of pixels included, by differences of one integral image, of which only the lines that the target needs are kept.
The resized image is cut into
tiles, each an NPY file in a binary column; the difference hash compares neighbours of the 9 x 8 resized grey image. The target is a square of LEAST
pixels, doubled while it is no larger than the image's longer side and up to MOST, or of the side given.

An image of any size is taken: what it needs of memory is in proportion to its bytes (at most 8 pixels a byte), as its sizes are checked against them first.

The given tables have no images. `render` makes a media column of them: the bytes of a text as pixels, in
each of the formats in turn; the query runs over that column of the whole table.

Defined results: a null or empty value, one in another format, one that is cut off, and any other that can't be decoded have one row with a reason in `error` and
no tile; numbers of a plain format above its maximum count as that; trailing bytes are ignored; an image smaller than the target is enlarged by the same rule; a null id passes through, repeated
rows give repeated results, an empty table an empty one; further columns, also of names that differ by case only, are ignored. Equal neighbours have the bit 0 in the hash.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, exact, load, placed

LEAST, MOST, TILE = 32, 256, 16
STRIP = 1 << 20
_TOKEN = re.compile(rb"\s*(?:#[^\n\r]*[\n\r]\s*)*(\S+)")


def decode(data: bytes | None) -> np.ndarray:
    """The image; ValueError tells what is wrong."""
    if not data:
        raise ValueError("empty")
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("unknown format")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit() or len(m[1]) > 9:
            raise ValueError("bad header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if not width or not height or not 0 < top < 65536:
        raise ValueError("bad header")
    bands = 3 if kind in (3, 6) else 1
    count = width * height * bands
    if kind == 4:
        row = (width + 7) // 8
        if len(data) < at + 1 + row * height:
            raise ValueError("cut off")
        body = np.frombuffer(data, np.uint8, row * height, at + 1)
        pixels = 1 - np.unpackbits(body.reshape(height, row), axis=1)[:, :width]
    elif kind > 3:
        step = 2 if top > 255 else 1
        if len(data) < at + 1 + count * step:
            raise ValueError("cut off")
        pixels = np.frombuffer(data, ">u2" if step == 2 else np.uint8, count, at + 1)
    elif kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\n\r]*", b"", data[at:]), np.uint8)
        bits = bits[(bits == 48) | (bits == 49)]
        if bits.size < count:
            raise ValueError("cut off")
        pixels = 49 - bits[:count]
    else:
        pixels = _numbers(re.sub(rb"#[^\n\r]*", b"", data[at:]), count, top)
    return _scaled(pixels.ravel(), top).reshape((height, width, 3) if bands == 3 else (height, width))


def _numbers(body: bytes, count: int, top: int) -> np.ndarray:
    """The first numbers of a plain format, none above top, a stretch at a time."""
    parts, at, left = [], 0, count
    while left and at < len(body):
        end = min(len(body), at + STRIP)
        while end < len(body) and not body[end : end + 1].isspace():
            end += 1
        words = body[at:end].split()[:left]
        if not all(w.isdigit() for w in words):
            raise ValueError("bad pixels")
        parts.append(np.array([top if len(w) > 9 and len(w.lstrip(b"0")) > 9 else min(int(w), top) for w in words], np.uint16))
        at, left = end, left - len(words)
    if left:
        raise ValueError("cut off")
    return np.concatenate(parts)


def _scaled(values: np.ndarray, top: int) -> np.ndarray:
    """values from 0 to top (larger ones count as top) as bytes from 0 to 255."""
    if top == 255 and values.dtype == np.uint8:
        return values
    out = np.empty(len(values), np.uint8)
    for a in range(0, len(values), STRIP):
        v = np.minimum(values[a : a + STRIP].astype(np.int64), top)
        out[a : a + STRIP] = (v * 255 + top // 2) // top
    return out


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("cut off")
    offset, size, width, height, _, depth, packing, _, _, _, colours = struct.unpack_from("<10xIIiiHHIIiiI", data)
    if size < 40 or packing not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32) or (packing == 3 and depth not in (16, 32)):
        raise ValueError("unsupported BMP")
    down, height = height < 0, abs(height)
    if width <= 0 or not height:
        raise ValueError("bad header")
    stride = (width * depth + 31) // 32 * 4
    if len(data) < offset + stride * height:
        raise ValueError("cut off")
    rows = np.frombuffer(data, np.uint8, stride * height, offset).reshape(height, stride)
    if not down:
        rows = rows[::-1]
    if depth == 16 or packing == 3:
        masks = struct.unpack_from("<III", data, 54) if packing == 3 and len(data) >= 66 else (0x7C00, 0x3E0, 0x1F)
        step = depth // 8
        whole = np.ascontiguousarray(rows[:, : width * step]).view("<u2" if step == 2 else "<u4").ravel()
        bands = []
        for mask in masks:
            low = (mask & -mask).bit_length() - 1 if mask else 0
            top = mask >> low
            if not mask or top & (top + 1):
                raise ValueError("bad masks")
            part = (whole & whole.dtype.type(mask)) >> whole.dtype.type(low)
            extra = max(0, top.bit_length() - 16)  # a mask of more than 16 bits keeps its upper ones
            bands.append(_scaled(part >> whole.dtype.type(extra), top >> extra))
        return np.stack(bands, axis=1).reshape(height, width, 3)
    if depth >= 24:
        step = depth // 8
        return np.ascontiguousarray(rows[:, : width * step].reshape(height, width, step)[:, :, 2::-1])
    if depth == 8:
        index = rows[:, :width]
    elif depth == 4:
        index = np.stack([rows >> 4, rows & 15], axis=2).reshape(height, -1)[:, :width]
    else:
        index = np.unpackbits(rows, axis=1)[:, :width]
    entries = colours or 1 << depth
    if len(data) < 14 + size + 4 * entries or int(index.max()) >= entries:
        raise ValueError("bad palette")
    palette = np.frombuffer(data, np.uint8, 4 * entries, 14 + size).reshape(entries, 4)[:, 2::-1]
    grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return palette[:, 0][index] if grey else palette[index]


def integral_lines(image: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Some lines of the integral image of (height, width, bands); line k holds the sums of the first k lines. rows ascend."""
    h, w, bands = image.shape
    out, total = np.zeros((len(rows), w + 1, bands)), np.zeros((w, bands))
    step = max(1, STRIP // (w * bands))
    for a in range(0, h, step):
        sums = np.cumsum(image[a : a + step], axis=0, dtype=np.float64) + total  # of the lines a + 1 and on
        lo, hi = np.searchsorted(rows, [a, a + len(sums)], side="right")
        out[lo:hi, 1:] = np.cumsum(sums[rows[lo:hi] - a - 1], axis=1)
        total = sums[-1]
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each pixel of the result is the mean of its area of the image, by an integral image; rounded half up."""
    h, w = image.shape[:2]
    flat = image.reshape(h, w, -1)
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(ys.astype(int), h - 1), np.minimum(xs.astype(int), w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    # the integral is linear between pixel edges
    lines = integral_lines(flat, y0) * (1 - fy) + integral_lines(flat, y0 + 1) * fy
    at = lines[:, x0] * (1 - fx) + lines[:, x0 + 1] * fx
    area = (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / ((h / height) * (w / width))
    out = np.clip(np.floor(area + 0.5 + 1e-9), 0, 255).astype(np.uint8)
    return out[:, :, 0] if image.ndim == 2 else out


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((image[:, :, 0].astype(np.uint32) * 299 + image[:, :, 1].astype(np.uint32) * 587 + image[:, :, 2].astype(np.uint32) * 114 + 500) // 1000).astype(np.uint8)


def difference_hash(image: np.ndarray) -> int:
    """64 bits as a signed integer: whether a pixel of the 9 x 8 grey image is darker than the one to its right."""
    small = area_resize(grey(image), 8, 9)
    return int(np.packbits(small[:, :-1] < small[:, 1:]).view(">i8")[0])


def npy(tile: np.ndarray) -> bytes:
    """The tile as an NPY file (format 1.0)."""
    head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': {tile.shape}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + tile.tobytes()


def target_side(image: np.ndarray) -> int:
    side = LEAST
    while 2 * side <= min(MOST, max(image.shape[:2])):
        side *= 2
    return side


def tiles(data: bytes | None, side: int | None = None, tile: int = TILE) -> tuple[list[dict], int | None, int | None, int | None, str | None]:
    """(tiles, width, height, hash, error)."""
    try:
        image = decode(data)
    except (ValueError, OverflowError, struct.error) as e:
        return [], None, None, None, str(e) or "bad image"
    side = side or target_side(image)
    small = area_resize(image, side, side)
    cells = [{"row": y // tile, "col": x // tile, "npy": npy(small[y : y + tile, x : x + tile])} for y in range(0, side, tile) for x in range(0, side, tile)]
    return cells, image.shape[1], image.shape[0], difference_hash(image), None


def tile_udf(side: int | None = None, tile: int = TILE):
    cell = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary())])
    kind = pa.struct([("tiles", pa.list_(cell)), ("width", pa.int32()), ("height", pa.int32()), ("dhash", pa.int64()), ("error", pa.string())])

    @F.arrow_udf("struct<tiles:array<struct<row:int,col:int,npy:binary>>,width:int,height:int,dhash:long,error:string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            columns = list(zip(*[tiles(x.as_py(), side, tile) for x in values])) or [()] * 5
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))

    return cut


def tile_images(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", side: int | None = None, tile: int = TILE) -> DataFrame:
    """(doc_id, width, height, dhash, error, tile_row, tile_col, npy): a row for each tile, or one with an error."""
    rows = placed(media).select(F.col(at(media, id_col)).alias("doc_id"), tile_udf(side, tile)(F.col(at(media, media_col))).alias("r")).select("doc_id", "r.*")
    return rows.select("doc_id", "width", "height", "dhash", "error", F.explode_outer("tiles").alias("t")).select("doc_id", "width", "height", "dhash", "error", F.col("t.row").alias("tile_row"), F.col("t.col").alias("tile_col"), F.col("t.npy").alias("npy"))


def encode(pixels: bytes, kind: int) -> bytes:
    """An image of these pixels, in one of eight formats: P1 to P6, BMP with a palette, BMP of 24 bits."""
    bands = 3 if kind in (3, 6, 8) else 1
    width = max(1, int((len(pixels) / bands) ** 0.5))
    height = max(1, -(-len(pixels) // (width * bands)))
    raw = np.zeros(width * height * bands, np.uint8)
    raw[: len(pixels)] = np.frombuffer(pixels, np.uint8)
    size = b"%d %d\n" % (width, height)
    if kind == 1:
        return b"P1\n# bits\n" + size + np.where(raw.reshape(height, width) > 96, b"1", b"0").tobytes()
    if kind == 4:
        return b"P4\n" + size + np.packbits(raw.reshape(height, width) > 96, axis=1).tobytes()
    if kind in (2, 3):
        return b"P%d\n" % kind + size + b"255\n" + " ".join(map(str, raw.tolist())).encode()
    if kind in (5, 6):
        return b"P%d\n" % kind + size + b"255\n" + raw.tobytes()
    depth = 8 if kind == 7 else 24
    stride = (width * depth + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * bands] = (raw.reshape(height, width) if bands == 1 else raw.reshape(height, width, 3)[:, :, ::-1].reshape(height, -1))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if depth == 8 else np.empty(0, np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + rows.size, 0, start, 40, width, height, 1, depth, 0, rows.size, 2835, 2835, 256 if depth == 8 else 0, 0)
    return head + palette.tobytes() + rows.tobytes()


def render_udf():
    @F.arrow_udf("binary")
    def draw(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, kind in texts:
            yield pa.array([encode(t, k) if t else None for t, k in zip(text.cast(pa.binary()).to_pylist(), kind.to_pylist())], pa.binary())

    return draw


def render(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every text as an image, null and empty texts as null."""
    kind = (F.pmod(F.xxhash64(F.coalesce(F.col(id_col), F.lit(0))), F.lit(8)) + 1).cast("int")
    return exact(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), render_udf()(F.col(text_col), kind).alias("media"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_images(render(load(spark, sf_dir, "documents")))
