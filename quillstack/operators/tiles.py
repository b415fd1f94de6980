"""Connected regions of images of any size, tile by tile.

Each tile is labelled by itself, an array of ``tile`` x ``tile`` at most; a label is its first pixel's place in the
whole image.  Pixels on both sides of a tile's border that belong together link two labels, and components over
these links, one table for all images, join the parts.  A region is then named by its first pixel, row by row,
whatever the tiles.  So one image of many megapixels is many tasks, and what goes through the components are
labels on borders only, about the square root of the pixels.

Fills that start at the border, and holes, are choices among regions: those that touch it and those that don't.
Images have pixels at places from 0; pixels that aren't there are outside every region. Empty tables give nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components, kept
from .raster import OPAQUE, colour_distance, labelled
from .sync import first_per_key

TILE = 512
_ROW = 1 << 32


def regions(pixels: DataFrame, mask: Column, eight: bool = True, tile: int = TILE) -> DataFrame:
    """img_id, x, y, region of the pixels for which the mask holds."""
    on = pixels.filter(mask).select("img_id", "x", "y", F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty"))

    def label(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        _, tx, ty = key
        x, y = p["x"].to_numpy() - int(tx) * tile, p["y"].to_numpy() - int(ty) * tile
        here = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
        here[y, x] = True
        first = labelled(here, eight)[y, x].astype(np.int64) - 1  # a label is the place of its first cell, from 1
        row, column = np.divmod(first, here.shape[1])
        return pd.DataFrame({"img_id": p["img_id"], "x": p["x"], "y": p["y"], "part": (row + int(ty) * tile) * _ROW + column + int(tx) * tile})

    parts = kept(on.groupBy("img_id", "tx", "ty").applyInPandas(label, "img_id string, x int, y int, part long"))
    # a pixel at a right or lower border of its tile against those beyond it
    steps = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if eight else [])]
    node = F.struct("img_id", F.col("part").alias("part"))
    x, y = F.col("x"), F.col("y")
    at_edge = (x % tile == tile - 1) | (y % tile == tile - 1) | ((x % tile == 0) & (y % tile >= 0) if eight else F.lit(False))
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
    sent = parts.filter(at_edge).select("img_id", "x", "y", node.alias("a"), F.explode(shifts).alias("s"))
    beyond = (F.floor((x + F.col("s.dx")) / tile) != F.floor(x / tile)) | (F.floor((y + F.col("s.dy")) / tile) != F.floor(y / tile))
    sent = sent.filter(beyond).select("img_id", (x + F.col("s.dx")).alias("x"), (y + F.col("s.dy")).alias("y"), "a")
    rim = parts.filter((x % tile == 0) | (y % tile == 0) | (x % tile == tile - 1))
    links = kept(sent.join(rim.select("img_id", "x", "y", node.alias("b")), ["img_id", "x", "y"]).select("a", "b").distinct())
    if links.isEmpty():
        return parts.withColumnRenamed("part", "region")
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    joined = components(nodes, links).select(F.col("id.img_id").alias("img_id"), F.col("id.part").alias("part"), F.col("component.part").alias("region"))
    return parts.join(joined, ["img_id", "part"], "left").select("img_id", "x", "y", F.coalesce("region", "part").alias("region"))


def boxes(found: DataFrame) -> DataFrame:
    """Box and size of each region."""
    return found.groupBy("img_id", "region").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _cleared(pixels: DataFrame, found: DataFrame, gone: DataFrame) -> DataFrame:
    """Pixels, clear where their region is one of those that go."""
    clear = found.join(gone.select("img_id", "region"), ["img_id", "region"], "left_semi").select("img_id", "x", "y", F.lit(True).alias("clear"))
    joined = pixels.join(clear, ["img_id", "x", "y"], "left")
    return joined.select("img_id", "x", "y", "r", "g", "b", F.when(F.col("clear"), 0).otherwise(F.col("a")).cast("int").alias("a"))


def _on_border() -> Column:
    return (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == F.col("w") - 1) | (F.col("y1") == F.col("h") - 1)


def backgrounds_cleared(pixels: DataFrame, near: int = 24, tile: int = TILE) -> DataFrame:
    """Clears what is connected with the border and close to the border's commonest colour."""
    size = kept(sizes(pixels))
    edge = pixels.filter(F.col("a") >= OPAQUE).join(size, "img_id").filter((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1))
    counted = edge.groupBy("img_id", "r", "g", "b").agg(F.count("*").alias("n"))
    plate = kept(first_per_key(counted, "img_id", F.desc("n"), F.col("r"), F.col("g"), F.col("b")).select("img_id", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb")))
    like = colour_distance(F.col("r"), F.col("g"), F.col("b"), F.col("pr"), F.col("pg"), F.col("pb")) <= near
    found = regions(pixels.join(plate, "img_id"), like & (F.col("a") >= OPAQUE), False, tile)
    return _cleared(pixels, found, boxes(found).join(size, "img_id").filter(_on_border()))


def holes_opened(pixels: DataFrame, most: float = 0.2, tile: int = TILE) -> DataFrame:
    """Clears light regions inside the ink that don't touch the border and are small."""
    light = (F.col("a") >= OPAQUE) & (F.least("r", "g", "b") >= 240)
    found = regions(pixels, light, True, tile)
    inside = boxes(found).join(sizes(pixels), "img_id").filter(~_on_border() & (F.col("n") <= most * F.col("w") * F.col("h")))
    return _cleared(pixels, found, inside)
