"""Terrain images read as pixels, and whole profiles of traces over a terrain of known slope."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators import relief
from pathloom.sources import files

ZOOM, SIDE = 14, 256
LAT, LON = 48.36, -4.571


def png(pixels: np.ndarray) -> bytes:
    """An image of rows x columns x channels, without filters."""
    kind = {1: 0, 3: 2, 4: 6}[pixels.shape[2]]
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def latitudes(row: int) -> np.ndarray:
    """Of the middles of the pixels of a row of tiles."""
    y = (row * SIDE + np.arange(SIDE) + 0.5) / (SIDE << ZOOM)
    return np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * y))))


def encoded(metres: np.ndarray, channels: int = 3) -> np.ndarray:
    """The pixels that encode the altitude of each row of a tile."""
    code = np.round((metres + 32768) * 256).astype(np.int64)
    rows = np.stack([code >> 16, code >> 8 & 255, code & 255] + [np.full_like(code, 255)] * (channels - 3), axis=1)
    return np.repeat(rows[:, None, :], SIDE, axis=1).astype(np.uint8)


def tiles(folder, height, channels=3):
    """Writes the tiles around the traces of the tests."""
    x = (LON + 180) / 360 * (1 << ZOOM)
    y = (1 - math.asinh(math.tan(math.radians(LAT))) / math.pi) / 2 * (1 << ZOOM)
    for column in (int(x) - 1, int(x), int(x) + 1):
        place = folder / str(ZOOM) / str(column)
        place.mkdir(parents=True)
        for row in (int(y) - 1, int(y), int(y) + 1):
            (place / f"{row}.png").write_bytes(png(encoded(height(latitudes(row)), channels)))
    (folder / str(ZOOM) / str(int(x)) / "1.png").write_bytes(b"no image")


def trace(spark, rows):
    return spark.createDataFrame([(t, i, *p) for t, points in rows.items() for i, p in enumerate(points)], "trace_id long, seq long, lat double, lon double")


@pytest.mark.parametrize("channels", [3, 4])
def test_images_are_pixels(spark, tmp_path, channels):
    place = tmp_path / "3" / "2"
    place.mkdir(parents=True)
    values = np.random.default_rng(channels).integers(0, 256, (4, 4, channels)).astype(np.uint8)
    (place / "5.png").write_bytes(png(values))
    (place / "6.png").write_bytes(b"no image")
    got = {(r.x, r.y): r.altitude for r in files.terrain(spark, str(tmp_path)).collect()}
    want = {(8 + i, 20 + j): values[j, i, 0] * 256.0 + values[j, i, 1] + values[j, i, 2] / 256 - 32768 for i in range(4) for j in range(4)}
    assert got == want


def test_a_grey_image_has_equal_channels(spark, tmp_path):
    place = tmp_path / "3" / "0"
    place.mkdir(parents=True)
    (place / "0.png").write_bytes(png(np.array([[[0], [130]]], dtype=np.uint8)))
    assert [r.altitude for r in files.terrain(spark, str(tmp_path)).orderBy("x").collect()] == [-32768.0, 130 * 256 + 130 + 130 / 256 - 32768]


def test_profile_of_a_known_slope(spark, tmp_path):
    """Up and down an even slope of 5 %: gain and loss short of the rise by the threshold at most, slopes of 5 %."""
    tiles(tmp_path, lambda lat: (lat - LAT) * geo.METRES_PER_DEGREE * 0.05, channels=4)
    pixels = files.terrain(spark, str(tmp_path)).drop("zoom")
    there = trace(spark, {1: [(LAT, LON), (LAT + 0.005, LON), (LAT, LON)], 2: [(LAT, LON), (10.0, LON)], 3: [(LAT, LON)], 4: [(LAT, LON), (LAT + 0.00001, LON)]})
    samples, sums = relief.profile(there, pixels, ZOOM)
    rise = 0.005 * geo.METRES_PER_DEGREE * 0.05
    (one,) = sums.collect()
    assert one.trace_id == 1
    for metres in (one.gain_m, one.loss_m):
        assert rise - 3.5 <= metres <= rise + 0.5
    assert abs(one.highest_m - one.lowest_m - rise) < 2 and abs(one.length_m - 2 * 556.6) < 30
    rows = samples.orderBy("k").collect()
    assert one.n_samples == len(rows) and [r.k for r in rows] == list(range(len(rows)))
    assert [r.slope_pct is None for r in rows] == [False] * (len(rows) - 1) + [True]
    assert np.median([abs(r.slope_pct) for r in rows[:-1]]) == pytest.approx(5, abs=1)


def test_level_ground_has_no_gain(spark, tmp_path):
    tiles(tmp_path, lambda lat: np.full_like(lat, 42.0))
    there = trace(spark, {7: [(LAT, LON), (LAT + 0.002, LON - 0.004), (LAT, LON)]})
    samples, sums = relief.profile(there, files.terrain(spark, str(tmp_path)).drop("zoom"), ZOOM)
    (one,) = sums.collect()
    assert one.gain_m < 0.5 and one.loss_m < 0.5 and one.lowest_m == pytest.approx(42, abs=1e-4) == one.highest_m
    assert samples.filter(F.abs("slope_pct") > 1e-6).count() == 0


def test_without_tiles_there_is_no_profile(spark):
    nothing = spark.createDataFrame([], "x long, y long, altitude double")
    for found in relief.profile(trace(spark, {1: [(LAT, LON), (LAT + 0.005, LON)]}), nothing, ZOOM):
        assert found.count() == 0
