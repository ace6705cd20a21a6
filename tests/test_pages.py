"""Page images: round trips, colour and filters of PNG, bands, pruned files, damaged files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from terracut.operators import raster
from terracut.sources import pages


def rows_of(df):
    return {(r.sheet_id, r.y): bytes(r.gray) for r in df.collect()}


def png(image: np.ndarray, kinds: list[int], colour: int) -> bytes:
    """A PNG of image (height, width, channels) whose rows use the filters named, one after another."""
    part, (height, width, n) = pages.PageWriter.part, image.shape
    body = b""
    for y in range(height):
        kind, row = kinds[y % len(kinds)], image[y].astype(int).ravel()
        above = image[y - 1].astype(int).ravel() if y else np.zeros_like(row)
        line = []
        for i, v in enumerate(row):
            a, b, c = (row[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        body += bytes([kind]) + bytes(line)
    packed = zlib.compress(body)
    return pages.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + part(b"tEXt", b"a\0b") + part(b"IDAT", packed[:7]) + part(b"IDAT", packed[7:]) + part(b"IEND", b"")


@pytest.mark.parametrize("kind", ["png", "pgm"])
def test_round_trip(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    page = {("A/1", y): rng.integers(0, 256, 70, np.uint8).tobytes() for y in range(1300)} | {("B é", y): bytes([y, 9]) for y in (1, 3)} | {("blank", y): bytes(4096) for y in range(300)}
    df = spark.createDataFrame([(s, y, g, 1) for (s, y), g in page.items()] + [("C", 0, None, 1), (None, 0, b"x", 1), ("C", None, b"x", 1)], "sheet_id string, y int, gray binary, width int")
    pages.write_pages(df.repartition(5), str(tmp_path), kind)
    want = page | {("B é", 0): b"\xff\xff", ("B é", 2): b"\xff\xff", ("C", 0): b"\xff"}
    assert rows_of(pages.read_pages(spark, str(tmp_path))) == want
    assert rows_of(pages.read_pages(spark, f"file://{tmp_path}")) == want
    assert not [f for f in tmp_path.iterdir() if f.name.startswith("_")]
    # Written again, a sheet's image is replaced.
    pages.write_pages(df.where("sheet_id = 'C'").selectExpr("sheet_id", "y", "X'0102' AS gray"), str(tmp_path), kind)
    assert rows_of(pages.read_pages(spark, str(tmp_path)).where("sheet_id = 'C'")) == {("C", 0): b"\1\2"}


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_colours_and_filters(spark, tmp_path, colour):
    rng = np.random.default_rng(colour)
    image = rng.integers(0, 256, (23, 17, pages.CHANNELS[colour]), np.uint8)
    (tmp_path / "p.png").write_bytes(png(image, [4, 3, 2, 1, 0, 4, 4, 3], colour))
    got = rows_of(pages.read_pages(spark, str(tmp_path)))
    flat = image[:, :, 0] if colour in (0, 4) else (image[:, :, :3].astype(int) @ np.array([299, 587, 114]) + 500) // 1000
    assert len(got) == 23 and all(np.abs(np.frombuffer(got["p", y], np.uint8).astype(int) - flat[y]).max() <= (0 if colour in (0, 4) else 1) for y in range(23))


def test_sheet_filters_choose_files_and_bands(spark, tmp_path):
    df = spark.range(1200).selectExpr("concat('S', id % 3) AS sheet_id", "CAST(floor(id / 3) * 3 AS INT) AS y", "X'00' AS gray")
    pages.write_pages(df, str(tmp_path), "pgm")
    (tmp_path / "notes.txt").write_text("no page")
    everything = pages.read_pages(spark, str(tmp_path))
    assert everything.rdd.getNumPartitions() == 9 and everything.count() == 3 * 1198
    one = everything.where("sheet_id = 'S1' AND y < 10")
    assert one.rdd.getNumPartitions() == 3 and one.count() == 10
    assert everything.where("sheet_id IN ('S0', 'S2')").rdd.getNumPartitions() == 6
    assert everything.where("sheet_id = 'none'").count() == 0
    # A damaged file does not matter to those who read others.
    (tmp_path / "bad.png").write_bytes(b"no image")
    assert everything.where("sheet_id = 'S1'").count() == 1198


def test_colour_netpbm_and_comments(spark, tmp_path):
    (tmp_path / "c.ppm").write_bytes(b"P6 # made by hand\n2 1\n255\n" + bytes([255, 255, 255, 0, 0, 0]))
    assert rows_of(pages.read_pages(spark, str(tmp_path))) == {("c", 0): b"\xff\x00"}


@pytest.mark.parametrize("damage", ["short", "bit", "depth", "filter"])
def test_damaged_images_are_errors(spark, tmp_path, damage):
    good = png(np.zeros((9, 8, 1), np.uint8), [0], 0)
    bad = {"short": good[:50], "bit": good[:-20] + bytes([good[-20] ^ 1]) + good[-19:], "depth": good.replace(struct.pack(">IIBB", 8, 9, 8, 0), struct.pack(">IIBB", 8, 9, 16, 0)), "filter": png(np.zeros((2, 2, 1), np.uint8), [0], 0)[:33] + b"".join(pages.PageWriter.part(n, b) for n, b in ((b"IDAT", zlib.compress(b"\x07\0\0\x07\0\0")), (b"IEND", b"")))}[damage]
    (tmp_path / "d.png").write_bytes(bad)
    with pytest.raises(PySparkException):
        pages.read_pages(spark, str(tmp_path)).collect()


def test_repeated_rows_and_empty_folders(spark, tmp_path):
    twice = spark.createDataFrame([("A", 0, b"a"), ("A", 0, b"b")], pages.GRAY_ROWS)
    with pytest.raises(PySparkException):
        pages.write_pages(twice, str(tmp_path))
    assert pages.read_pages(spark, str(tmp_path)).count() == 0
    pages.write_pages(twice.limit(0), str(tmp_path))
    assert pages.read_pages(spark, str(tmp_path)).count() == 0


def test_swatches_from_files(spark, tmp_path):
    image = np.full((12, 60), 255, np.uint8)
    image[4:8, :] = np.where(np.arange(60) % 12 < 7, 20, 255)
    (tmp_path / "dashes.png").write_bytes(png(image[:, :, None], [1, 4], 0))
    profile = raster.swatch_profiles(pages.read_pages(spark, str(tmp_path)), "sheet_id").collect()
    assert [p.sheet_id for p in profile] == ["dashes"] and profile[0].ink_ratio > 0.4
