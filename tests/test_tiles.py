"""Regions by tiles against the same work on whole images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstack.operators import raster, tiles


def table(spark, **images):
    parts = [raster._table(k, g) for k, g in images.items()]
    return spark.createDataFrame(pd.concat(parts), raster.PIXEL)


def picture(seed, h, w, light=0.4):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 256, (h, w, 4)).astype(np.int32)
    g[rng.random((h, w)) < light] = (250, 250, 250, 255)
    g[rng.random((h, w)) < 0.1, 3] = 0
    return g


@pytest.mark.parametrize("tile, eight", [(4, True), (7, False)])
def test_regions_of_snakes_and_noise(spark, tile, eight):
    snake = np.zeros((23, 19, 4), np.int32)
    snake[::2, :, 3] = 255
    snake[1::4, -1, 3] = 255
    snake[3::4, 0, 3] = 255
    images = {"snake": snake, "noise": picture(1, 17, 30), "dots": picture(2, 9, 9, 0.9)}
    found = tiles.regions(table(spark, **images), F.col("a") >= 16, eight, tile).collect()
    for k, g in images.items():
        label = raster.labelled(g[..., 3] >= 16, eight)
        want = {(int(x), int(y)): int((label[y, x] - 1) // g.shape[1]) * 2**32 + int((label[y, x] - 1) % g.shape[1]) for y, x in zip(*np.nonzero(label), strict=True)}
        assert {(r.x, r.y): r.region for r in found if r.img_id == k} == want


def test_clearing_equals_whole_images(spark):
    images = {f"i{s}": picture(s, 12 + s, 20 - s, 0.55) for s in range(5)}
    rows = table(spark, **images)
    key = lambda f: sorted(map(tuple, f.select("img_id", "x", "y", "r", "g", "b", "a").collect()))
    assert key(tiles.backgrounds_cleared(rows, tile=5)) == key(raster.per_image(rows, raster.without_background))
    assert key(tiles.holes_opened(rows, tile=5)) == key(raster.per_image(rows, raster.holes_punched))
    assert tiles.backgrounds_cleared(rows.limit(0)).count() == 0
