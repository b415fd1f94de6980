"""Images as pixel tables (img_id, x, y, r, g, b, a) and as arrays per image.

What a pixel or its neighbours decide is aggregates and joins over the table.  Flood fills,
labels and repeated erosion run per image on arrays; an image is one group, bounded by its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = "img_id string, x int, y int, r int, g int, b int, a int"
OPAQUE = 16


def colour_distance(r1, g1, b1, r2, g2, b2) -> Column:
    """The largest difference of a channel."""
    return F.greatest(F.abs(r1 - r2), F.abs(g1 - g2), F.abs(b1 - b2))


def is_plate(r="r", g="g", b="b", least: int = 240) -> Column:
    return F.least(r, g, b) >= least


def is_grey(r="r", g="g", b="b", most: int = 18) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b) <= most


def is_near_black(r="r", g="g", b="b", most: int = 48) -> Column:
    return F.greatest(r, g, b) <= most


def is_ink(a="a", least: int = OPAQUE) -> Column:
    return (F.col(a) >= least) & ~is_plate()


def ink_box(pixels: DataFrame, ink: Column | None = None) -> DataFrame:
    """Box, count, aspect and share of the ink of each image."""
    p = pixels.filter(is_ink() if ink is None else ink)
    box = p.groupBy("img_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("ink"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return box.withColumn("aspect", w / h).withColumn("fill", F.col("ink") / (w * h))


def inset_box(pixels: DataFrame, margin: int, ink: Column | None = None) -> DataFrame:
    """The ink's box with a margin, within the image."""
    size = pixels.groupBy("img_id").agg(F.max("x").alias("__w"), F.max("y").alias("__h"))
    box = ink_box(pixels, ink).join(size, "img_id")
    low = lambda c: F.greatest(F.col(c) - margin, F.lit(0)).alias(c)
    return box.select("img_id", low("x0"), low("y0"), F.least(F.col("x1") + margin, "__w").alias("x1"), F.least(F.col("y1") + margin, "__h").alias("y1"))


def aspect_drift(boxes: DataFrame, other: DataFrame) -> DataFrame:
    o = other.select("img_id", F.col("aspect").alias("__a"))
    return boxes.join(o, "img_id").select("img_id", (F.abs(F.col("aspect") - F.col("__a")) / F.col("aspect")).alias("drift"))


def is_thin(box: DataFrame, fill: float = 0.18, least: int = 80) -> DataFrame:
    return box.select("img_id", ((F.col("fill") < fill) & (F.col("ink") >= least)).alias("thin"))


def histogram(pixels: DataFrame, top: int = 6, least: float = 0.0) -> DataFrame:
    """The commonest colours of opaque pixels, four bits a channel, with their share: place from 1."""
    p = pixels.filter(F.col("a") >= OPAQUE)
    q = lambda c: F.shiftright(c, 4)
    counts = p.groupBy("img_id", (q("r") * 256 + q("g") * 16 + q("b")).alias("bucket")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("img_id"))
    at = F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("n"), "bucket"))
    return counts.withColumn("share", share).withColumn("place", at).filter((F.col("place") <= top) & (F.col("share") >= least))


def block_hash(pixels: DataFrame, size: int = 8) -> DataFrame:
    """64 bits an image: which of 8 x 8 cells are lighter than the mean cell; bit 63 is the sign."""
    w = Window.partitionBy("img_id")
    light = (F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000
    cell = lambda c: F.floor(F.col(c) * size / (F.max(c).over(w) + 1)).cast("int")
    cells = pixels.select("img_id", cell("x").alias("cx"), cell("y").alias("cy"), light.alias("l")).groupBy("img_id", "cx", "cy").agg(F.avg("l").alias("l"))
    bit = F.when(F.col("l") >= F.avg("l").over(w), F.expr(f"shiftleft(1L, cy * {size} + cx)")).otherwise(F.lit(0))
    return cells.withColumn("bit", bit).groupBy("img_id").agg(F.bit_or("bit").alias("hash"))


def mask_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of two images' ink (intersection over union) and the mean colour error where both have it."""
    left = a.select("img_id", "x", "y", F.struct("r", "g", "b", "a", is_ink().alias("ink")).alias("p"))
    right = b.select("img_id", "x", "y", F.struct("r", "g", "b", "a", is_ink().alias("ink")).alias("q"))
    j = left.join(right, ["img_id", "x", "y"], "full")
    in_p, in_q = F.coalesce(F.col("p.ink"), F.lit(False)), F.coalesce(F.col("q.ink"), F.lit(False))
    error = (F.abs(F.col("p.r") - F.col("q.r")) + F.abs(F.col("p.g") - F.col("q.g")) + F.abs(F.col("p.b") - F.col("q.b"))) / 3.0
    out = j.groupBy("img_id").agg(F.count_if(in_p & in_q).alias("both"), F.count_if(in_p | in_q).alias("either"), F.avg(F.when(in_p & in_q, error)).alias("error"))
    return out.withColumn("iou", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(1.0))


def border_share(pixels: DataFrame, condition: Column, band: int = 1) -> DataFrame:
    """Share of the pixels in the outer band for which a condition holds."""
    w = Window.partitionBy("img_id")
    edge = (F.col("x") < band) | (F.col("y") < band) | (F.col("x") > F.max("x").over(w) - band) | (F.col("y") > F.max("y").over(w) - band)
    return pixels.withColumn("__c", condition.cast("int")).withColumn("__e", edge).filter("__e").groupBy("img_id").agg(F.avg("__c").alias("share"))


def sampled_share(pixels: DataFrame, condition: Column, most: int = 180) -> DataFrame:
    """Share on a grid of at most ``most`` x ``most`` points."""
    w = Window.partitionBy("img_id")
    step = lambda c: F.greatest(F.lit(1), F.ceil((F.max(c).over(w) + 1) / most))
    p = pixels.withColumn("__sx", step("x")).withColumn("__sy", step("y")).filter("x % __sx = 0 and y % __sy = 0")
    return p.groupBy("img_id").agg(F.avg(condition.cast("int")).alias("share"))


def nearest_palette(pixels: DataFrame, palette: list[tuple[int, int, int]], most: int = 48) -> DataFrame:
    """Pixels with the nearest palette colour of their greyness within a distance, else their own."""
    options = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(max(r, g, b) - min(r, g, b) <= 18).alias("grey")) for r, g, b in palette])
    ranked = F.transform(F.filter(options, lambda o: o["grey"] == is_grey()), lambda o, i: F.struct(colour_distance(F.col("r"), F.col("g"), F.col("b"), o["r"], o["g"], o["b"]).alias("d"), i.alias("i"), o["r"].alias("r"), o["g"].alias("g"), o["b"].alias("b")))
    best = F.array_min(F.filter(ranked, lambda o: o["d"] <= most))
    return pixels.withColumn("__o", best).select("img_id", "x", "y", *[F.coalesce(F.col(f"__o.{c}"), F.col(c)).alias(c) for c in "rgb"], "a")


def neighbour_counts(pixels: DataFrame, ink: Column | None = None, reach: int = 1) -> DataFrame:
    """For each pixel, how many of its eight neighbours are ink and how many are not there or empty."""
    p = pixels.withColumn("__i", (is_ink() if ink is None else ink).cast("int"))
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if dx or dy])
    sent = p.filter("__i = 1").select("img_id", F.explode(shifts).alias("s"), "x", "y").select("img_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    got = sent.groupBy("img_id", "x", "y").agg(F.count("*").alias("near"))
    around = (2 * reach + 1) ** 2 - 1
    return pixels.join(got, ["img_id", "x", "y"], "left").withColumn("ink_near", F.coalesce("near", F.lit(0))).withColumn("empty_near", F.lit(around) - F.col("ink_near")).drop("near")


def dilated(pixels: DataFrame, ink: Column | None = None) -> DataFrame:
    """Pixels that are ink or next to ink, of eight."""
    n = neighbour_counts(pixels, ink)
    return n.filter((is_ink() if ink is None else ink) | (F.col("ink_near") > 0)).select(pixels.columns)


def eroded(pixels: DataFrame, ink: Column | None = None) -> DataFrame:
    """Ink pixels whose four neighbours are ink too."""
    p = pixels.filter(is_ink() if ink is None else ink)
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    sent = p.select("img_id", F.explode(shifts).alias("s"), "x", "y").select("img_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    inner = sent.groupBy("img_id", "x", "y").agg(F.count("*").alias("n")).filter("n = 4").drop("n")
    return p.join(inner, ["img_id", "x", "y"], "left_semi").select(pixels.columns)


def rim_punched(pixels: DataFrame, most: int = 6) -> DataFrame:
    """Light pixels between ink and nothing become clear."""
    n = neighbour_counts(pixels)
    rim = is_plate(least=200) & (F.col("ink_near") > 0) & (F.col("ink_near") <= most) & (F.col("empty_near") > 0) & (F.col("a") > 0)
    return n.withColumn("a", F.when(rim, 0).otherwise(F.col("a"))).select(pixels.columns)


def to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, v) of channels from 0 to 255: degrees, and shares of 1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (high - low).cast("double")
    sector = F.when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.struct(F.when(d == 0, 0.0).otherwise(sector * 60).alias("h"), F.when(high == 0, 0.0).otherwise(d / high).alias("s"), (high / 255.0).alias("v"))


def from_hsv(h: Column, s: Column, v: Column) -> Column:
    """struct(r, g, b) of channels from 0 to 255."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0))
        return F.round((v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255).cast("int")

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def hue_anchor(pixels: DataFrame) -> DataFrame:
    """The circular mean hue, in degrees, of coloured ink."""
    rad = F.radians(to_hsv(F.col("r"), F.col("g"), F.col("b"))["h"])
    return pixels.filter(is_ink() & ~is_grey()).groupBy("img_id").agg(F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0)).alias("hue"))


def recoloured(pixels: DataFrame, faint: int = 64) -> DataFrame:
    """Nearly grey ink with little opacity takes the image's mean hue, at its own lightness and full saturation."""
    p = pixels.join(hue_anchor(pixels), "img_id", "left")
    c = to_hsv(F.col("r"), F.col("g"), F.col("b"))
    fresh = from_hsv(F.col("hue"), F.lit(1.0), c["v"])
    takes = is_ink(least=1) & (F.col("a") < faint) & is_grey() & F.col("hue").isNotNull()
    return p.select("img_id", "x", "y", *[F.when(takes, fresh[k]).otherwise(F.col(k)).alias(k) for k in "rgb"], "a")


def signature_ink(pixels: DataFrame, cut: int = 18) -> DataFrame:
    """Darkness as opacity of black ink; faint pixels go."""
    dark = (F.lit(255) - ((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000)).cast("int")
    return pixels.withColumn("a", dark).filter(F.col("a") >= cut).select("img_id", "x", "y", F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), "a")


def cropped(pixels: DataFrame, left: float, top: float, width: float, height: float) -> DataFrame:
    w = Window.partitionBy("img_id")
    span = lambda c: F.max(c).over(w) + 1
    p = pixels.withColumn("__w", span("x")).withColumn("__h", span("y"))
    x0, y0 = F.round(F.col("__w") * left), F.round(F.col("__h") * top)
    x1, y1 = F.least(F.round(F.col("__w") * (left + width)), F.col("__w")), F.least(F.round(F.col("__h") * (top + height)), F.col("__h"))
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return p.filter(inside).select("img_id", (F.col("x") - x0).cast("int").alias("x"), (F.col("y") - y0).cast("int").alias("y"), "r", "g", "b", "a")


def background(pixels: DataFrame, patch: int = 4, agree: float = 0.75, near: int = 24) -> DataFrame:
    """The colour of the corners, the upper middle of each channel, where enough of them agree."""
    w = Window.partitionBy("img_id")
    edge = lambda c: (F.col(c) < patch) | (F.col(c) > F.max(c).over(w) - patch)
    corner = pixels.withColumn("__e", edge("x") & edge("y")).filter("__e")
    middle = lambda c: F.get(F.array_sort(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int")).alias(f"b{c}")
    mid = corner.groupBy("img_id").agg(*[middle(c) for c in "rgb"])  # 4 patches of fixed size
    close = colour_distance(F.col("r"), F.col("g"), F.col("b"), F.col("br"), F.col("bg"), F.col("bb")) <= near
    share = corner.join(mid, "img_id").groupBy("img_id", "br", "bg", "bb").agg(F.avg(close.cast("int")).alias("share"))
    return share.filter(F.col("share") >= agree)


# per image, on arrays


def labelled(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Component numbers, from 1, of the true cells of a mask: the least label spreads until nothing changes."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    while True:
        before = label.copy()
        for dy, dx in steps:
            a = label[: h - dy, max(0, -dx) : w - max(0, dx)]
            b = label[dy:, max(0, dx) : w - max(0, -dx)]
            both = (a > 0) & (b > 0)
            low = np.minimum(a, b)
            np.minimum(a, low, out=a, where=both)
            np.minimum(b, low, out=b, where=both)
        flat = label.ravel()
        on = flat > 0
        flat[on] = flat[flat[on] - 1]  # a label's own cell may have a smaller one by now
        if (label == before).all():
            return label


def grid(p: pd.DataFrame) -> np.ndarray:
    g = np.zeros((int(p["y"].max()) + 1, int(p["x"].max()) + 1, 4), np.int32)
    g[p["y"], p["x"]] = p[["r", "g", "b", "a"]].to_numpy()
    return g


def _table(img_id: str, g: np.ndarray) -> pd.DataFrame:
    y, x = np.indices(g.shape[:2]).reshape(2, -1)
    return pd.DataFrame({"img_id": img_id, "x": x, "y": y, **{c: g[..., i].ravel() for i, c in enumerate("rgba")}})


def per_image(pixels: DataFrame, change) -> DataFrame:
    """Pixels after change(grid), a height x width x 4 array."""
    return pixels.groupBy("img_id").applyInPandas(lambda key, p: _table(key[0], change(grid(p))), PIXEL)


def regions(pixels: DataFrame, eight: bool = True) -> DataFrame:
    """Pixel, box and size of the connected ink regions of each image: img_id, region, x0, y0, x1, y1, n."""

    def find(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        g = grid(p)
        label = labelled((g[..., 3] >= OPAQUE) & (g[..., :3].min(axis=2) < 240), eight)
        y, x = np.nonzero(label)
        rows = pd.DataFrame({"region": label[y, x], "x": x, "y": y})
        box = rows.groupby("region").agg(x0=("x", "min"), y0=("y", "min"), x1=("x", "max"), y1=("y", "max"), n=("x", "size")).reset_index()
        return box.assign(img_id=key[0])[["img_id", "region", "x0", "y0", "x1", "y1", "n"]]

    return pixels.groupBy("img_id").applyInPandas(find, "img_id string, region int, x0 int, y0 int, x1 int, y1 int, n int")


def without_corner_marks(g: np.ndarray, share: float = 0.02) -> np.ndarray:
    """Clears the boxes of small regions that lie in a corner quarter, away from the largest region."""
    mask = (g[..., 3] >= OPAQUE) & (g[..., :3].min(axis=2) < 240)
    label = labelled(mask, True)
    ids, n = np.unique(label[label > 0], return_counts=True)
    if len(ids) < 2:
        return g
    h, w = mask.shape
    out = g.copy()
    for i, size in zip(ids, n, strict=True):
        if size == n.max() or size > share * n.sum():
            continue
        y, x = np.nonzero(label == i)
        if (x.max() < w / 4 or x.min() >= 3 * w / 4) and (y.max() < h / 4 or y.min() >= 3 * h / 4):
            out[y.min() : y.max() + 1, x.min() : x.max() + 1, 3] = 0
    return out


def without_background(g: np.ndarray, near: int = 24) -> np.ndarray:
    """Clears what is connected with the border and close to the border's commonest colour."""
    border = np.ones(g.shape[:2], bool)
    border[1:-1, 1:-1] = False
    edge = g[border & (g[..., 3] >= OPAQUE)]
    if not len(edge):
        return g
    colours, n = np.unique(edge[:, :3], axis=0, return_counts=True)
    plate = (np.abs(g[..., :3] - colours[n.argmax()]).max(axis=2) <= near) & (g[..., 3] >= OPAQUE)
    label = labelled(plate)
    rim = np.unique(np.concatenate((label[0], label[-1], label[:, 0], label[:, -1])))
    out = g.copy()
    out[np.isin(label, rim[rim > 0]), 3] = 0
    return out


def flattened(g: np.ndarray, bits: int = 5, least: int = 24) -> np.ndarray:
    """Each large region of nearly one colour takes the upper middle of its channels."""
    out = g.copy()
    code = (g[..., 0] >> bits) * 4096 + (g[..., 1] >> bits) * 64 + (g[..., 2] >> bits)
    for c in np.unique(code[g[..., 3] >= OPAQUE]):
        label = labelled((code == c) & (g[..., 3] >= OPAQUE))
        ids, n = np.unique(label[label > 0], return_counts=True)
        for i in ids[n >= least]:
            own = label == i
            for k in range(3):
                v = np.sort(g[..., k][own])
                out[..., k][own] = v[len(v) // 2]
    return out


def skeleton(mask: np.ndarray) -> np.ndarray:
    """What repeated erosion leaves of openings: the centre lines of a mask."""
    shifted = lambda m, dy, dx: np.pad(m, 1)[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    erode = lambda m: m & shifted(m, 0, 1) & shifted(m, 0, -1) & shifted(m, 1, 0) & shifted(m, -1, 0)
    dilate = lambda m: np.logical_or.reduce([shifted(m, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    out = np.zeros_like(mask)
    while mask.any():
        small = erode(mask)
        out |= mask & ~dilate(small)
        mask = small
    return out


def checkerboard_share(pixels: DataFrame, step: int = 8, contrast: int = 12) -> DataFrame:
    """Share of sampled 2 x 2 cells, ``step`` apart, whose diagonals agree and whose sides differ."""
    light = pixels.filter(F.col("a") >= OPAQUE).select("img_id", "x", "y", ((F.col("r") + F.col("g") + F.col("b")) / 3).alias("l"))
    at = lambda dx, dy, n: light.select("img_id", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("l").alias(n))
    j = light.filter((F.col("x") % step == 0) & (F.col("y") % step == 0))
    for dx, dy, n in ((step, 0, "e"), (0, step, "s"), (step, step, "d")):
        j = j.join(at(dx, dy, n), ["img_id", "x", "y"])
    hit = (F.abs(F.col("l") - F.col("d")) < contrast / 2) & (F.abs(F.col("e") - F.col("s")) < contrast / 2) & (F.abs(F.col("l") - F.col("e")) >= contrast)
    return j.groupBy("img_id").agg(F.avg(hit.cast("int")).alias("share"))


def trimmed(pixels: DataFrame, pad: int = 0, ink: Column | None = None) -> DataFrame:
    """Pixels of the box of what isn't empty, or of ``ink``, with a margin, from 0."""
    box = ink_box(pixels, F.col("a") >= OPAQUE if ink is None else ink).select("img_id", "x0", "y0", "x1", "y1")
    j = pixels.join(box, "img_id").filter("x between x0 - {0} and x1 + {0} and y between y0 - {0} and y1 + {0}".format(pad))
    return j.select("img_id", (F.col("x") - F.greatest(F.col("x0") - pad, F.lit(0))).alias("x"), (F.col("y") - F.greatest(F.col("y0") - pad, F.lit(0))).alias("y"), "r", "g", "b", "a")


def trimmed_by_coverage(pixels: DataFrame, least: float = 0.02, ink: Column | None = None) -> DataFrame:
    """Pixels between the outermost rows and columns of which enough is ink, from 0; margins with less go."""
    full = (is_ink() if ink is None else ink).cast("int")

    def span(c: str) -> DataFrame:
        lines = pixels.groupBy("img_id", c).agg(F.avg(full).alias("__s")).filter(F.col("__s") >= least)
        return lines.groupBy("img_id").agg(F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"))

    j = pixels.join(span("x"), "img_id").join(span("y"), "img_id").filter("x between x0 and x1 and y between y0 and y1")
    return j.select("img_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "r", "g", "b", "a")


def pad_sizes(width: Column, height: Column, share: float = 0.06, least: int = 4, most: int = 64) -> Column:
    """struct(x, y): margins in proportion, within limits."""
    one = lambda n: F.greatest(F.lit(least), F.least(F.lit(most), F.round(n * share).cast("int")))
    return F.struct(one(width).alias("x"), one(height).alias("y"))


def resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Average over source cells, colours weighted by opacity, so that clear pixels lend no colour."""
    h, w = g.shape[:2]
    alpha = g[..., 3:].astype(float)
    flat = np.concatenate((g[..., :3] * alpha, alpha), axis=2)

    def along(a: np.ndarray, n: int) -> np.ndarray:
        size = a.shape[0]
        total = np.concatenate((np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)))
        edges = np.arange(n + 1) * size / n
        low = np.floor(edges).astype(int)
        upto = total[low] + (edges - low).reshape(-1, *[1] * (a.ndim - 1)) * a[np.minimum(low, size - 1)]
        return (upto[1:] - upto[:-1]) * n / size

    out = along(along(flat, height).swapaxes(0, 1), width).swapaxes(0, 1)
    colour = out[..., :3] / np.maximum(out[..., 3:], 1e-9)
    return np.concatenate((np.rint(colour), np.rint(out[..., 3:])), axis=2).astype(np.int32) if (h, w) != (height, width) else g


def resize_weights(sizes: DataFrame, how: str) -> DataFrame:
    """old, new, target, source, weight: what each source cell of a line of ``old`` cells gives to each of ``new``.

    ``average``: the share of the target cell that it covers. ``cubic``: the four cells around the target's place, by a
    cubic through the middle two with the slopes of their neighbours; cells beyond an end are the end's."""
    t = sizes.select("old", "new").distinct().withColumn("target", F.explode(F.sequence(F.lit(0), F.col("new") - 1)))
    scale = F.col("old") / F.col("new")
    if how == "average":
        low, high = F.col("target") * scale, (F.col("target") + 1) * scale
        cells = t.withColumn("source", F.explode(F.sequence(F.floor(low).cast("int"), F.least(F.ceil(high).cast("int"), F.col("old")) - 1)))
        covered = F.least(high, F.col("source") + F.lit(1.0)) - F.greatest(low, F.col("source") + F.lit(0.0))
        return cells.select("old", "new", "target", "source", (covered / scale).alias("weight")).filter("weight > 1e-12")
    at = F.col("target") * scale
    d = at - F.floor(at)
    taps = F.array(*[F.struct(F.lit(k).alias("k"), (w / 2).alias("w")) for k, w in ((-1, -d + 2 * d * d - d * d * d), (0, 2 - 5 * d * d + 3 * d * d * d), (1, d + 4 * d * d - 3 * d * d * d), (2, -d * d + d * d * d))])
    each = t.withColumn("tap", F.explode(taps)).withColumn("source", F.least(F.greatest((F.floor(at) + F.col("tap.k")).cast("int"), F.lit(0)), F.col("old") - 1))
    return each.groupBy("old", "new", "target", "source").agg(F.sum("tap.w").alias("weight"))


def resized_pixels(pixels: DataFrame, wanted: DataFrame, how: str = "average") -> DataFrame:
    """Pixel tables in other sizes: along x, then along y, each a join with the weights of its line and a sum, so
    a large image is as many tasks as its lines ask for. Colours are weighted by opacity, so that clear pixels lend none.

    wanted: img_id, width, height (whole numbers from 1). Images have pixels at all places from 0."""
    size = pixels.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).join(wanted, "img_id")
    size = size.select("img_id", "w", "h", F.col("width").cast("int").alias("tw"), F.col("height").cast("int").alias("th"))
    flat = pixels.select("img_id", "x", "y", *[(F.col(c) * F.col("a")).cast("double").alias(c) for c in "rgb"], F.col("a").cast("double").alias("a"))

    def along(rows: DataFrame, axis: str, old: str, new: str) -> DataFrame:
        weights = resize_weights(size.select(F.col(old).alias("old"), F.col(new).alias("new")), how)
        keyed = rows.join(size.select("img_id", F.col(old).alias("old"), F.col(new).alias("new")), "img_id").withColumnRenamed(axis, "source")
        other = "y" if axis == "x" else "x"
        sums = keyed.join(weights, ["old", "new", "source"]).groupBy("img_id", other, F.col("target").alias(axis))
        return sums.agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in "rgba"])

    out = along(along(flat, "x", "w", "tw"), "y", "h", "th")
    whole = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.500001).cast("int")))
    colour = [whole(F.when(F.col("a") > 1e-6, F.col(c) / F.col("a")).otherwise(0.0)).alias(c) for c in "rgb"]
    return out.select("img_id", "x", "y", *colour, whole(F.col("a")).alias("a"))


def colour_layers(g: np.ndarray, k: int = 3, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, labels with -1 where clear): k-means by the largest channel difference, evenly spaced seeds."""
    on = g[..., 3] >= OPAQUE
    p = g[on][:, :3].astype(float)
    label = np.full(on.shape, -1)
    if not len(p):
        return np.zeros((0, 3)), label
    order = p[np.lexsort(p.T[::-1])]
    centres = order[np.linspace(0, len(order) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.abs(p[:, None] - centres[None]).max(axis=2).argmin(axis=1)
        centres = np.array([p[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
    label[on] = np.abs(p[:, None] - centres[None]).max(axis=2).argmin(axis=1)
    return centres, label


def outlined(g: np.ndarray, passes: int, colour: tuple[int, int, int]) -> np.ndarray:
    """A ring of a colour around the ink: dilated ``passes`` times, less the ink itself."""
    ink = g[..., 3] >= OPAQUE
    grown = ink.copy()
    for _ in range(passes):
        wide = np.pad(grown, 1)
        grown = np.logical_or.reduce([wide[1 + dy : 1 + dy + ink.shape[0], 1 + dx : 1 + dx + ink.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    out = g.copy()
    out[grown & ~ink] = (*colour, 255)
    return out


def holes_punched(g: np.ndarray, most: float = 0.2) -> np.ndarray:
    """Clears light regions inside the ink that don't touch the border and are small."""
    plate = (g[..., 3] >= OPAQUE) & (g[..., :3].min(axis=2) >= 240)
    label = labelled(plate, True)
    rim = set(np.concatenate((label[0], label[-1], label[:, 0], label[:, -1])).tolist())
    out = g.copy()
    for i, n in zip(*np.unique(label[label > 0], return_counts=True), strict=True):
        if i not in rim and n <= most * plate.size:
            out[label == i, 3] = 0
    return out


def visible(g: np.ndarray) -> np.ndarray:
    """Background and corner marks gone, holes open, cut to what is left."""
    out = holes_punched(without_corner_marks(without_background(g)))
    y, x = np.nonzero(out[..., 3] >= OPAQUE)
    return out[y.min() : y.max() + 1, x.min() : x.max() + 1] if len(y) else out[:1, :1]


def hardened(pixels: DataFrame, soft: int = 200) -> DataFrame:
    """Half-clear ink takes the whole-number mean colour of its solid neighbours and becomes solid."""
    solid = (F.col("a") >= soft) & ~is_plate()
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    sent = pixels.filter(solid).select("img_id", F.explode(shifts).alias("s"), "x", "y", "r", "g", "b").select("img_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "r", "g", "b")
    mean = sent.groupBy("img_id", "x", "y").agg(*[F.floor(F.sum(c) / F.count("*")).cast("int").alias(f"m{c}") for c in "rgb"])
    j = pixels.join(mean, ["img_id", "x", "y"], "left")
    takes = (F.col("a") >= OPAQUE) & (F.col("a") < soft) & F.col("mr").isNotNull()
    return j.select("img_id", "x", "y", *[F.when(takes, F.col(f"m{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"], F.when(takes, 255).otherwise(F.col("a")).alias("a"))


def outline_colour(pixels: DataFrame, least: float = 0.02, most: float = 0.5) -> DataFrame:
    """The mean colour of dark ink next to coloured fill, for images where it is a fitting share of the fill."""
    fill = is_ink() & ~is_near_black()
    n = neighbour_counts(pixels, fill)
    edge = is_ink() & is_near_black() & (F.col("ink_near") > 0)
    sums = n.groupBy("img_id").agg(F.count_if(edge).alias("edge"), F.count_if(fill).alias("fill"), *[F.avg(F.when(edge, F.col(c))).alias(c) for c in "rgb"])
    share = F.col("edge") / F.greatest(F.col("fill"), F.lit(1))
    return sums.filter(share.between(least, most)).select("img_id", *[F.floor(c).cast("int").alias(c) for c in "rgb"], share.alias("share"))


def protected(pixels: DataFrame, plate: DataFrame, near: int = 24) -> DataFrame:
    """Keys of pixels that no clearing may touch: ink unlike the plate and what is next to it, less the plate itself.

    plate: img_id, br, bg, bb, as ``background`` gives it."""
    p = pixels.join(plate.select("img_id", "br", "bg", "bb"), "img_id")
    like = colour_distance(F.col("r"), F.col("g"), F.col("b"), F.col("br"), F.col("bg"), F.col("bb")) <= near
    grown = dilated(p, (F.col("a") >= OPAQUE) & ~like)
    return grown.filter(~like).select("img_id", "x", "y")


def without_remnants(g: np.ndarray, plate: tuple[int, int, int], near: int = 40, reach: int = 2) -> np.ndarray:
    """Clears plate-like regions that touch the border or clear pixels and lie ``reach`` pixels away from ink."""
    on = g[..., 3] >= OPAQUE
    like = on & (np.abs(g[..., :3] - np.array(plate)).max(axis=2) <= near)
    guard = on & ~like
    for _ in range(reach):
        wide = np.pad(guard, 1)
        guard = np.logical_or.reduce([wide[1 + dy : 1 + dy + on.shape[0], 1 + dx : 1 + dx + on.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    free = like & ~guard
    label = labelled(free, True)
    open_ = np.pad(~on, 1, constant_values=True)
    beside = np.logical_or.reduce([open_[1 + dy : 1 + dy + on.shape[0], 1 + dx : 1 + dx + on.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    reached = np.unique(label[beside & free])
    out = g.copy()
    out[np.isin(label, reached[reached > 0]), 3] = 0
    return out
