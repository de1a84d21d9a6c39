"""Pixel-table operators (X operators): rows (cam, frame, row, col, value), 0-based positions."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import attach, exact_quantiles
from ..session import cut
from .ftle import gaussian_smooth, key_schema

IMAGE = ("cam", "frame")
AT = ("row", "col")


def temporal_background(pixels: DataFrame, how: str = "median") -> DataFrame:
    """Median or mean of every pixel position over time: (cam, row, col, background).

    The exact median of integer pixels keeps one counter per grey level, so its
    state is bounded by the bit depth however long the film is.
    """
    if how == "median":
        level = F.median("value")
    elif how == "mean":
        level = F.avg("value")
    else:
        raise ValueError("how is median or mean")
    return pixels.groupBy("cam", *AT).agg(level.cast("double").alias("background"))


def subtract_background(pixels: DataFrame, background: DataFrame, clip: bool = True) -> DataFrame:
    diff = F.col("value") - F.col("background")
    out = pixels.join(background, ["cam", *AT])
    return out.withColumn("value", F.greatest(diff, F.lit(0.0)) if clip else diff).drop("background")


def dense_frames(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of every frame; missing pixels are 0."""
    frames = pixels.select(*IMAGE).distinct()
    for n, size in zip(AT, (height, width)):
        frames = frames.withColumn(n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))))
    have = pixels.select(*IMAGE, *[F.col(c).cast("bigint").alias(c) for c in AT], "value")
    return frames.join(have, [*IMAGE, *AT], "left").na.fill(0, ["value"])


def bandpass(pixels: DataFrame, shape: tuple[int, int], sigma_bg: float, sigma_noise: float) -> DataFrame:
    """Fine minus coarse Gaussian smoothing of dense frames; the result is signed."""
    base = pixels.withColumn("value", F.col("value").cast("double"))
    fine = gaussian_smooth(base, IMAGE, "value", shape, sigma_noise, nodes=AT)
    coarse = gaussian_smooth(base, IMAGE, "value", shape, sigma_bg, nodes=AT)
    coarse = coarse.withColumnRenamed("value", "_c").toDF(*IMAGE, *AT, "_c")
    return fine.join(coarse, [*IMAGE, *AT]).select(*IMAGE, *AT, (F.col("value") - F.col("_c")).alias("value"))


def robust_threshold(pixels: DataFrame, k: float, floor: float) -> DataFrame:
    """Per camera: noise sigma = 1.4826 MAD of all pixels of all frames, and max(k*sigma, floor)."""
    centre = exact_quantiles(pixels, ["cam"], "value", {"_m": 0.5})
    gaps = attach(pixels, centre, ["cam"]).withColumn("_d", F.abs(F.col("value") - F.col("_m")))
    mad = exact_quantiles(gaps, ["cam"], "_d", {"_mad": 0.5})
    sigma = 1.4826 * F.col("_mad")
    return mad.select("cam", sigma.alias("sigma"), F.greatest(k * sigma, F.lit(float(floor))).alias("threshold"))


def _offsets(half: int, names: Sequence[str] = ("dr", "dc")) -> Column:
    steps = range(-half, half + 1)
    return F.array(
        *[F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1])) for a, b in itertools.product(steps, steps)]
    )


def local_maxima(pixels: DataFrame, window: int, threshold: float | Column) -> DataFrame:
    """Pixels above the threshold that are at least as bright as their whole window.

    Only pixels above the threshold can beat one that is, so only those are
    sent to their neighbours; all pixels of a plateau are kept.
    """
    half = window // 2
    bright = pixels.filter(F.col("value") > threshold).select(*IMAGE, *AT, "value")
    sent = bright.withColumn("_o", F.explode(_offsets(half)))
    here = (F.col("_o.dr") == 0) & (F.col("_o.dc") == 0)
    seen = sent.groupBy(*IMAGE, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col")).agg(
        F.max("value").alias("_most"), F.max(F.when(here, F.col("value"))).alias("value")
    )
    return seen.filter(F.col("value") >= F.col("_most")).drop("_most")


#: Side of the squares in which peaks are suppressed, in pixels, and peaks that a task takes together.
TILE = 512
TILE_PEAKS = 50_000


def _greedy(peaks: pd.DataFrame, radius: float, halo: np.ndarray) -> np.ndarray:
    """Fate of each peak of one tile: 1 kept, 0 covered, 2 undecided.

    Strongest first, ties by column, then row.  A peak of the ``halo`` counts as
    undecided, and so does a peak that only undecided ones may cover.
    """
    row, col, value = (peaks[c].to_numpy() for c in (*AT, "value"))
    reach = int(np.floor(radius))
    r, c = row - row.min() + reach, col - col.min() + reach
    raster = np.zeros((r.max() + reach + 1, c.max() + reach + 1), np.int8)
    dr, dc = np.ogrid[-reach : reach + 1, -reach : reach + 1]
    disc = dr * dr + dc * dc <= radius * radius
    fate = np.zeros(len(peaks), np.int8)
    for k in np.lexsort((row, col, -value)):
        near = raster[r[k] - reach : r[k] + reach + 1, c[k] - reach : c[k] + reach + 1][disc]
        if halo[k] or not (near == 1).any():
            fate[k] = raster[r[k], c[k]] = 2 if halo[k] or (near == 2).any() else 1
    return fate


def _greedy_far(peaks: pd.DataFrame, radius: float) -> np.ndarray:
    """Whether each peak is kept; peaks may lie anywhere, so kept ones are looked up by square."""
    row, col, value = (peaks[c].to_numpy() for c in (*AT, "value"))
    side = max(1, int(np.ceil(radius)))
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    kept = np.zeros(len(peaks), bool)
    for k in np.lexsort((row, col, -value)):
        r, c = int(row[k]), int(col[k])
        i, j = r // side, c // side
        around = (p for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for p in held.get((a, b), ()))
        if not any((r - y) ** 2 + (c - x) ** 2 <= radius * radius for y, x in around):
            kept[k] = True
            held.setdefault((i, j), []).append((r, c))
    return kept


def suppress_peaks(peaks: DataFrame, radius: float, tile: int = TILE) -> DataFrame:
    """Greedy suppression: strongest first, a kept peak covers all others within ``radius``.

    Ties are broken by column, then row.  Images are cut into squares of ``tile``
    pixels that also see the peaks within ``radius`` of their border.  Inside a
    square the greedy rule is applied in Arrow batches; a peak is left undecided only
    when its fate hangs on a peak beyond the border.  Undecided peaks, with the kept
    ones near borders, are then decided image by image: two passes whatever the
    length of a chain of peaks that cover each other.  An image is one sensor frame,
    so its border peaks fit a task.
    """
    tile = max(tile, 4 * int(radius) + 1)
    named = peaks.select(*IMAGE, *AT, "value")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    reach = float(radius)

    def squares(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))

    seen = named.withColumn("_ti", F.explode(squares("row"))).withColumn("_tj", F.explode(squares("col")))
    seen = seen.withColumn("_halo", (F.floor(F.col("row") / tile) != F.col("_ti")) | (F.floor(F.col("col") / tile) != F.col("_tj")))
    place = [*IMAGE, "_ti", "_tj"]

    def decide(bundle: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, square in bundle.groupby(place, sort=False):
            halo = square["_halo"].to_numpy()
            out.append(square.assign(_fate=_greedy(square, radius, halo).astype("int32"))[~halo])
        return pd.concat(out)[[*IMAGE, *AT, "value", "_fate"]]

    total = named.count()
    bundles = max(1, -(-total // TILE_PEAKS))
    dealt = seen.withColumn("_bundle", F.pmod(F.xxhash64(*place), F.lit(bundles)))
    fates = cut(dealt.groupBy("_bundle").applyInPandas(decide, f"{fields}, _fate int"))
    kept = fates.where("_fate = 1").select(*named.columns)
    if not fates.where("_fate = 2").head(1):
        return kept
    border = functools.reduce(Column.__or__, [F.pmod(F.col(c), F.lit(tile)) < reach for c in AT] + [F.pmod(F.col(c), F.lit(tile)) >= tile - reach for c in AT])
    # kept peaks near a border decide with the undecided; what they cover at home is settled
    open_ = fates.where((F.col("_fate") == 2) | ((F.col("_fate") == 1) & border))

    def settle(image: pd.DataFrame) -> pd.DataFrame:
        sure = image["_fate"].to_numpy() == 1
        found = _greedy_far(image, radius)
        return image[found & ~sure][[*IMAGE, *AT, "value"]]

    return kept.unionByName(open_.groupBy(*IMAGE).applyInPandas(settle, fields))


def neighbour_values(peaks: DataFrame, pixels: DataFrame, offsets: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Peaks with the pixel values at named offsets beside them (NULL outside)."""
    steps = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for n, a, b in offsets])
    asked = peaks.select(*IMAGE, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_v"), F.explode(steps).alias("_o"))
    asked = asked.withColumns({"row": F.col("_r") + F.col("_o.dr"), "col": F.col("_c") + F.col("_o.dc")})
    values = pixels.select(*IMAGE, *AT, F.col("value").cast("double").alias("_pv"))
    met = asked.join(values.toDF(*values.columns), [*IMAGE, *AT], "left")
    return met.groupBy(*IMAGE, F.col("_r").alias("row"), F.col("_c").alias("col"), F.col("_v").alias("value")).agg(
        *[F.max(F.when(F.col("_o.n") == n, F.col("_pv"))).alias(n) for n, _, _ in offsets]
    )


def subpixel_gauss3(peaks: DataFrame, pixels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Sub-pixel x (col) and y (row) from a log-parabola through three pixels per axis."""
    rows = neighbour_values(peaks, pixels, [("_l", 0, -1), ("_r", 0, 1), ("_u", -1, 0), ("_d", 1, 0)])

    def offset(before: str, after: str) -> Column:
        a, m, b = (F.col(c).cast("double") for c in (before, "value", after))
        la, lm, lb = F.log(a), F.log(m), F.log(b)
        bend = la - 2 * lm + lb
        raw = F.greatest(F.least(0.5 * (la - lb) / bend, F.lit(0.5)), F.lit(-0.5))
        return F.when((a > 0) & (m > 0) & (b > 0) & (bend != 0), raw).otherwise(0.0)

    inside = F.col("row").between(1, shape[0] - 2) & F.col("col").between(1, shape[1] - 2)
    x = F.col("col") + F.when(inside, F.coalesce(offset("_l", "_r"), F.lit(0.0))).otherwise(0.0)
    y = F.col("row") + F.when(inside, F.coalesce(offset("_u", "_d"), F.lit(0.0))).otherwise(0.0)
    return rows.select(*IMAGE, *AT, "value", x.alias("x"), y.alias("y"))


def detect_tracers(
    pixels: DataFrame, shape: tuple[int, int], *, background: str = "median", sigma_bg: float, sigma_noise: float,
    k: float, floor: float, window: int, radius: float, target: float,
) -> DataFrame:
    """From raw frames to tracers: (cam, frame, row, col, value, x, y, threshold, gain).

    The temporal background is removed (signed), the residual is band-passed, its
    noise gives one threshold for each camera, maxima above it are suppressed
    greedily and placed between pixels on the band-passed residual.  The gain brings
    a camera's bright peaks, detected above ``floor``, to ``target``.
    """
    residual = subtract_background(dense_frames(pixels, *shape), temporal_background(dense_frames(pixels, *shape), background), clip=False)
    clean = cut(bandpass(residual, shape, sigma_bg, sigma_noise))
    limits = robust_threshold(clean, k, floor)
    seen = suppress_peaks(local_maxima(clean, window, floor), radius)
    gain = camera_gain(seen, target).select("cam", "gain")
    above = attach(clean, limits, ["cam"]).filter(F.col("value") > F.col("threshold")).select(*clean.columns)
    found = subpixel_gauss3(suppress_peaks(local_maxima(above, window, floor), radius), clean, shape)
    return attach(attach(found, limits.select("cam", "threshold"), ["cam"]), gain, ["cam"], "left")


def camera_gain(peaks: DataFrame, target: float) -> DataFrame:
    """Gain per camera that brings the nearest-rank 90th percentile of the peaks to ``target``."""
    bright = exact_quantiles(peaks, ["cam"], "value", {"bright": 0.9}, rule="nearest")
    return bright.withColumn("gain", target / F.greatest(F.col("bright"), F.lit(2.220446049250313e-16)))


def equalise_gain(pixels: DataFrame, gain: DataFrame, noise: DataFrame, k: float, cap: int) -> DataFrame:
    """Soft floor, gain, cap and rounding of the pixel values."""
    rows = attach(attach(pixels, gain.select("cam", "gain"), ["cam"]), noise.select("cam", "sigma"), ["cam"])
    lifted = F.greatest(F.col("value") - k * F.col("sigma"), F.lit(0.0)) * F.col("gain")
    return rows.select(*IMAGE, *AT, F.floor(F.least(lifted, F.lit(float(cap))) + 0.5).cast("int").alias("value"))


def peak_sigma(pixels: DataFrame, peaks: DataFrame, shape: tuple[int, int], r: int = 6) -> DataFrame:
    """Intensity-weighted radial width of all peaks whose patch lies in the frame.

    The patch minimum is removed from the moments afterwards, so one aggregate
    over the patch pixels is enough.
    """
    inside = F.col("row").between(r, shape[0] - 1 - r) & F.col("col").between(r, shape[1] - 1 - r)
    asked = peaks.filter(inside).select(
        *IMAGE, F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(_offsets(r)).alias("_o")
    )
    asked = asked.withColumns({"row": F.col("_r") + F.col("_o.dr"), "col": F.col("_c") + F.col("_o.dc")})
    values = pixels.select(*IMAGE, *AT, F.col("value").cast("double").alias("_v"))
    met = asked.join(values.toDF(*values.columns), [*IMAGE, *AT])
    dx, dy, v = F.col("_o.dc"), F.col("_o.dr"), F.col("_v")
    s = met.groupBy(*IMAGE, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(
        F.min(v).alias("m"), F.count(v).alias("n"), F.sum(v).alias("s0"), F.sum(dx * v).alias("sx"), F.sum(dy * v).alias("sy"),
        F.sum((dx * dx + dy * dy) * v).alias("s2"), F.sum(dx).alias("gx"), F.sum(dy).alias("gy"), F.sum(dx * dx + dy * dy).alias("g2"),
    )
    m = F.col("m")
    total = F.col("s0") - F.col("n") * m
    cx, cy = (F.col("sx") - m * F.col("gx")) / total, (F.col("sy") - m * F.col("gy")) / total
    var = (F.col("s2") - m * F.col("g2")) / total - cx * cx - cy * cy
    return s.filter(total > 0).select(*IMAGE, *AT, F.sqrt(F.greatest(var, F.lit(0.0)) / 2).alias("sigma"))


def particle_size(sigmas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact median width and its full width at half maximum."""
    mid = exact_quantiles(sigmas, by, "sigma", {"sigma": 0.5})
    # fixed value: the full width at half maximum of a Gaussian over its sigma
    return mid.withColumn("fwhm", 2.3548 * F.col("sigma"))


def percentile_mask(pixels: DataFrame, pct: float) -> DataFrame:
    """Pixels at or above the exact percentile of the non-zero pixels of their frame."""
    lit_pixels = pixels.filter(F.col("value") > 0)
    cuts = exact_quantiles(lit_pixels, IMAGE, "value", {"_cut": pct / 100})
    return attach(lit_pixels, cuts, IMAGE).filter(F.col("value") >= F.col("_cut")).drop("_cut")


def connected_labels(nodes: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Smallest node id of each connected part: (by, node, label).

    Every round takes the least label among a node and its neighbours and then
    follows the label of that label, so chains shorten geometrically.
    """
    by = list(by)
    both = edges.select(*by, F.col("a"), F.col("b")).unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.distinct())
    labels = cut(nodes.select(*by, "node", F.col("node").alias("label")))
    if both.isEmpty():
        return labels
    while True:
        seen = both.join(labels.toDF(*by, "b", "label"), [*by, "b"]).select(*by, F.col("a").alias("node"), "label")
        least = labels.select(*by, "node", "label").unionByName(seen).groupBy(*by, "node").agg(F.min("label").alias("label"))
        least = cut(least)
        jump = least.toDF(*by, "label", "_next")
        fresh = cut(
            least.toDF(*by, "node", "label").join(jump, [*by, "label"]).select(*by, "node", F.least("label", "_next").alias("label"))
        )
        moved = fresh.join(labels.toDF(*by, "node", "_old"), [*by, "node"]).filter(F.col("label") != F.col("_old"))
        done = moved.isEmpty()
        labels = fresh
        if done:
            return labels


def _tile_labels(height: int, width: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Labels of the 8-connected parts of a small mask, by spreading the least label."""
    grid = np.full((height + 2, width + 2), np.iinfo(np.int64).max)
    grid[rows + 1, cols + 1] = np.arange(len(rows))
    mask = grid < np.iinfo(np.int64).max
    while True:
        spread = grid.copy()
        for dr, dc in itertools.product((-1, 0, 1), repeat=2):
            spread = np.minimum(spread, np.roll(grid, (dr, dc), (0, 1)))
        spread[~mask] = np.iinfo(np.int64).max
        if (spread == grid).all():
            return grid[rows + 1, cols + 1]
        grid = spread


def label_blobs(mask: DataFrame, width: int, tile: int = 64) -> DataFrame:
    """Mask pixels with the number of their 8-connected blob (its smallest row*width+col).

    Tiles of fixed size are labelled on their own; blobs that cross tile borders
    are merged by connecting the tile labels, a far smaller graph than the pixels.
    """
    keys = [*IMAGE, "_tr", "_tc"]
    rows = mask.select(
        *IMAGE, *[F.col(c).cast("bigint").alias(c) for c in AT], F.col("value").cast("double").alias("value")
    ).withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        first = _tile_labels(tile, tile, r % tile, c % tile)
        ids = r * width + c
        out = pdf[[*IMAGE, *AT, "value"]].copy()
        out["node"] = ids[first]
        return out

    schema = key_schema(rows, IMAGE) + "row bigint, col bigint, value double, node bigint"
    tiled = cut(rows.groupBy(*keys).applyInPandas(local, schema))
    r, c = F.col("row") % tile, F.col("col") % tile
    border = tiled.filter((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1))
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    sent = border.withColumn("_o", F.explode(steps)).select(
        *IMAGE, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"), F.col("node").alias("a")
    )
    other = border.select(*IMAGE, *AT, F.col("node").alias("b"))
    edges = sent.join(other.toDF(*other.columns), [*IMAGE, *AT]).filter(F.col("a") != F.col("b")).select(*IMAGE, "a", "b")
    nodes = tiled.select(*IMAGE, "node").distinct()
    labels = connected_labels(nodes, edges, IMAGE)
    return tiled.join(labels.toDF(*IMAGE, "node", "blob"), [*IMAGE, "node"]).select(*IMAGE, *AT, "value", "blob")


def blobs(mask: DataFrame, width: int, min_area: int, max_area: int, tile: int = 64) -> DataFrame:
    """Area, mean, max and intensity-weighted centroid of every blob within the area limits."""
    v = F.col("value")
    return (
        label_blobs(mask, width, tile)
        .groupBy(*IMAGE, "blob")
        .agg(
            F.count(F.lit(1)).alias("area"), F.avg(v).alias("mean"), F.max(v).alias("peak"),
            (F.sum(F.col("col") * v) / F.sum(v)).alias("x"), (F.sum(F.col("row") * v) / F.sum(v)).alias("y"),
        )
        .filter(F.col("area").between(min_area, max_area))
    )


def otsu_threshold(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Threshold of greatest between-class variance over 256 grey levels, per group.

    The histogram has 256 rows per group, which bounds the windows over it.
    """
    level = F.least(F.floor("value"), F.lit(255).cast("bigint"))
    hist = pixels.filter(F.col("value").between(0, 256)).groupBy(*by, level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    grid = hist.select(*by).distinct().withColumn("level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))))
    full = grid.join(hist.toDF(*hist.columns), [*by, "level"], "left").na.fill(0, ["n"])
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.col("n") / F.sum("n").over(whole)
    probs = full.withColumn("_p", p)
    sums = probs.withColumns(
        {
            "_w": F.sum("_p").over(upto),
            "_mu": F.sum(F.col("_p") * F.col("level")).over(upto),
            "_all": F.sum(F.col("_p") * F.col("level")).over(whole),
        }
    )
    spread = F.col("_w") * (1 - F.col("_w"))
    score = F.when(spread > 1e-12, F.pow(F.col("_all") * F.col("_w") - F.col("_mu"), 2) / spread)
    scored = sums.withColumn("_s", F.round(score, 9)).filter(F.col("_s").isNotNull())
    return scored.groupBy(*by).agg(F.max_by("level", F.struct(F.col("_s"), -F.col("level"))).alias("threshold"))
