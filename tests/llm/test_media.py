import io
import struct
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skriva.llm import media as M

from . import edge


def brute_resize(image, height, width):
    """Exact areas, in fractions."""
    h, w = image.shape
    out = np.zeros((height, width), int)
    for y in range(height):
        for x in range(width):
            top, bottom, left, right = Fraction(y * h, height), Fraction((y + 1) * h, height), Fraction(x * w, width), Fraction((x + 1) * w, width)
            total = Fraction(0)
            for i in range(int(top), min(h, -int(-bottom // 1))):
                for j in range(int(left), min(w, -int(-right // 1))):
                    total += int(image[i, j]) * (min(bottom, i + 1) - max(top, i)) * (min(right, j + 1) - max(left, j))
            out[y, x] = int(total / ((bottom - top) * (right - left)) + Fraction(1, 2))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 7), st.integers(1, 7), st.integers(0, 99))
def test_resize(h, w, height, width, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8)
    assert (M.area_resize(image, height, width) == brute_resize(image, height, width)).all()


@pytest.mark.parametrize("kind", range(1, 9))
def test_formats_round_trip(kind):
    raw = bytes(np.random.default_rng(kind).integers(0, 256, 300, dtype=np.uint8))
    image = M.decode(M.encode(raw, kind))
    want = np.zeros(image.size, np.uint8)
    want[:300] = np.frombuffer(raw, np.uint8)[: image.size]
    if kind in (1, 4):
        want = np.where(want > 96, 0, 255)
    assert (image.ravel() == want).all() and image.ndim == (3 if kind in (3, 6, 8) else 2)


def test_hand_written_images():
    assert M.decode(b"P1 # c\n2 2\n10 01").tolist() == [[0, 255], [255, 0]]
    assert M.decode(b"P2\n2 1\n15\n0 15\n").tolist() == [[0, 255]]
    assert M.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    assert M.decode(b"P3\n1 1 255\n1 2 3").tolist() == [[[1, 2, 3]]]


@pytest.mark.parametrize("data", [None, b"", b"P5", b"P7 1 1", b"P5 2 2 255\nab", b"P2 2 1 255\n1", b"P2 1 1 255\nx", b"P5 0 5 255\n", b"BM", b"BM" + bytes(60), b"GIF89a", b"P1 3 1\n10", b"P5 1 1 0\na", b"P4\n9 9", b"P6 1 1 255", b"P2 1 1 255 -3", b"P5 999999999 999999999 255\nab", b"P1 999999999 999999999 1", b"BM" + bytes(8) + b"\xff\xff\xff\xff" + bytes(60)])
def test_broken_images_have_a_reason(data):
    cells, width, _, digest, error = M.tiles(data)
    assert cells == [] and width is None and digest is None and error


def test_tiles_and_hash():
    image = np.arange(64 * 64, dtype=np.uint32).reshape(64, 64).astype(np.uint8)
    data = b"P5\n64 64\n255\n" + image.tobytes()
    cells, width, height, digest, error = M.tiles(data, side=32, tile=16)
    small = M.area_resize(image, 32, 32)
    assert error is None and (width, height) == (64, 64)
    whole = np.block([[np.load(io.BytesIO(c["npy"])) for c in cells if c["row"] == r] for r in sorted({c["row"] for c in cells})])
    assert (whole == small).all()
    nine = brute_resize(image, 8, 9)
    bits = "".join("1" if nine[y, x] < nine[y, x + 1] else "0" for y in range(8) for x in range(8))
    assert digest % 2**64 == int(bits, 2)


def test_edge_cases(spark):
    docs = edge.table(spark)
    rows = M.tile_images(M.render(docs)).collect()
    texts = [t for _, t, *_ in edge.ROWS]
    assert sum(r.error is not None for r in rows) == sum(not t for t in texts)
    assert len(rows) == sum(4 if len(t or "") < 4000 and t else 256 if t else 1 for t in texts)
    assert M.tile_images(M.render(edge.empty(spark))).count() == 0
    own = spark.createDataFrame([(None, b"P5 1 1 255\nx", 1), (1, b"oops", 2)], "doc_id long, media binary, r int")
    assert sorted((r.doc_id, r.error) for r in M.tile_images(own).dropDuplicates(["doc_id"]).collect() if r.doc_id) == [(1, "unknown format")]


def test_query_is_decoding_resizing_and_cutting_by_plain_loops(spark):
    path = "/root/testdata/sf0.001"
    media = {r.doc_id: bytes(r.media) for r in M.render(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    got = {}
    for r in M.query(spark, path).collect():
        got.setdefault(r.doc_id, {"size": (r.width, r.height), "hash": r.dhash, "error": r.error})[r.tile_row, r.tile_col] = np.load(io.BytesIO(r.npy))
    assert got.keys() == media.keys()
    for i in [k for k, data in media.items() if len(data) < 3000][:40]:
        image, side = M.decode(media[i]), M.LEAST
        while 2 * side <= min(M.MOST, max(image.shape[:2])):
            side *= 2
        bands = [image] if image.ndim == 2 else [image[:, :, b] for b in range(3)]
        small = [brute_resize(b, side, side) for b in bands]
        assert got[i]["error"] is None and got[i]["size"] == (image.shape[1], image.shape[0])
        for y in range(side // M.TILE):
            for x in range(side // M.TILE):
                cut = [b[y * M.TILE : (y + 1) * M.TILE, x * M.TILE : (x + 1) * M.TILE] for b in small]
                assert (got[i][y, x] == (cut[0] if image.ndim == 2 else np.stack(cut, axis=2))).all()
        flat = image if image.ndim == 2 else (image.astype(int) @ [299, 587, 114] + 500) // 1000
        nine = brute_resize(flat, 8, 9)
        assert got[i]["hash"] % 2**64 == int("".join("1" if nine[y, x] < nine[y, x + 1] else "0" for y in range(8) for x in range(8)), 2)


def bmp(depth, rows, palette=b"", packing=0, masks=b"", height=None, width=2):
    start = 54 + len(masks) + len(palette)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(rows), 0, start, 40, width, 2 if height is None else height, 1, depth, packing, len(rows), 0, 0, len(palette) // 4, 0) + masks + palette + rows


def test_bmp_depths_masks_and_order():
    two = bytes([0, 0, 0, 0, 255, 255, 255, 0])
    assert M.decode(bmp(1, b"\x40\0\0\0\x80\0\0\0", two)).tolist() == [[255, 0], [0, 255]]
    assert M.decode(bmp(4, b"\x01\0\0\0\x10\0\0\0", two)).tolist() == [[255, 0], [0, 255]]
    colours = bytes([1, 2, 3, 0, 4, 5, 6, 0])
    assert M.decode(bmp(4, b"\x01\0\0\0\x10\0\0\0", colours)).tolist() == [[[6, 5, 4], [3, 2, 1]], [[3, 2, 1], [6, 5, 4]]]
    rows = bytes(range(16))
    plain = M.decode(bmp(32, rows))
    assert plain.tolist() == [[[10, 9, 8], [14, 13, 12]], [[2, 1, 0], [6, 5, 4]]]
    assert M.decode(bmp(32, rows, height=-2)).tolist() == plain[::-1].tolist()  # top-down
    swapped = M.decode(bmp(32, rows, packing=3, masks=struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)))
    assert swapped.tolist() == plain[:, :, ::-1].tolist()
    ten = M.decode(bmp(32, struct.pack("<4I", *[(1023 << 20) | (512 << 10)] * 4), packing=3, masks=struct.pack("<III", 1023 << 20, 1023 << 10, 1023)))
    assert ten[0, 0].tolist() == [255, 128, 0]
    assert M.decode(bmp(16, struct.pack("<4H", 0x7C00, 0x3E0, 0x1F, 0)))[1].tolist() == [[255, 0, 0], [0, 255, 0]]
    assert M.decode(bmp(16, struct.pack("<4H", 0xF800, 0x7E0, 0x1F, 0), packing=3, masks=struct.pack("<III", 0xF800, 0x7E0, 0x1F)))[1].tolist() == [[255, 0, 0], [0, 255, 0]]
    assert M.tiles(bmp(32, rows, packing=3, masks=struct.pack("<III", 5, 0xFF00, 0xFF0000)))[4] == "bad masks"


def test_a_number_too_large_for_any_integer_counts_as_the_largest():
    assert M.decode(b"P2 1 1 255 99999999999999999999").tolist() == [[255]]
    assert M.decode(b"P2 2 1 255 0000000000000000000007 300").tolist() == [[7, 255]]


def test_large_images_in_strips(monkeypatch):
    image = np.random.default_rng(5).integers(0, 256, (301, 203, 3), dtype=np.uint8)
    whole = M.area_resize(image, 32, 32)
    text = b"P3 203 301 1000\n" + " ".join(str(int(v) * 3) for v in image.ravel()).encode()
    decoded = M.decode(text)
    monkeypatch.setattr(M, "STRIP", 700)
    assert (M.area_resize(image, 32, 32) == whole).all() and (M.decode(text) == decoded).all()
    assert (M.area_resize(image, 1, 1)[0, 0] == np.floor(image.reshape(-1, 3).mean(axis=0) + 0.5)).all()
