"""Dense optical flow between the frames of a sequence, by polynomial expansion, and how steady a sequence is.

Around each pixel both images are fitted by quadratics; where one is the other moved by d, the linear terms differ by 2 A d, so sums over a
window give d by least squares. It is found on the smallest image of a pyramid first and refined on the larger ones. Spark pairs the frames
and deals out the pairs; a task works on a batch of pairs of one size at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scale from one image of the pyramid to the next, how many smaller ones there are, the least side of one, window, iterations, and the width
#: and deviation of the fit: the usual setting for rendered frames.
PYRAMID, LEVELS, LEAST, WINDOW, ITERATIONS, WIDTH, SIGMA = 0.5, 3, 32, 15, 3, 5, 1.2
#: Pixels that are worked on at once; each takes some 500 bytes of intermediate arrays, in every Python process of an executor.
PIXELS = 1 << 17


def _filtered(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis, the border repeated."""
    r = len(kernel) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    p = np.pad(x, pad, mode="edge")
    at = lambda i: np.take(p, range(i, i + x.shape[axis]), axis)
    return sum(k * at(i) for i, k in enumerate(kernel))


def _summed(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over square windows, as far as they lie in the image."""
    for axis in (-2, -1):
        n = x.shape[axis]
        total = np.cumsum(x, axis)
        total = np.concatenate([np.zeros_like(np.take(total, [0], axis)), total], axis)
        r = size // 2
        hi, lo = np.minimum(np.arange(n) + r + 1, n), np.maximum(np.arange(n) - r, 0)
        x = np.take(total, hi, axis) - np.take(total, lo, axis)
    return x


def expansion(images: np.ndarray, width: int = WIDTH, sigma: float = SIGMA) -> np.ndarray:
    """Quadratic terms xx, xy, yy and linear terms x, y of the fit around each pixel, stacked first."""
    at = np.arange(width) - width // 2
    g = np.exp(-(at**2) / (2 * sigma**2))
    g /= g.sum()
    m2, m4 = (g * at**2).sum(), (g * at**4).sum()
    rows = {k: _filtered(images, g * at**k, -1) for k in (0, 1, 2)}
    s = {(i, j): _filtered(rows[i], g * at**j, -2) for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))}
    solve = np.linalg.inv(np.array([[1, m2, m2], [m2, m4, m2 * m2], [m2, m2 * m2, m4]]))
    xx, yy = (sum(solve[k, j] * s[p] for j, p in enumerate(((0, 0), (2, 0), (0, 2)))) for k in (1, 2))
    return np.stack([xx, s[1, 1] / (2 * m2 * m2), yy, s[1, 0] / m2, s[0, 1] / m2])


def _sampled(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """values (.., n, height, width) at places x, y (n, height, width), linear between pixels, the border repeated."""
    h, w = values.shape[-2:]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    n = np.arange(values.shape[-3])[:, None, None]
    at = lambda j, i: values[..., n, j, i]
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def _resized(images: np.ndarray, h: int, w: int) -> np.ndarray:
    y, x = np.meshgrid((np.arange(h) + 0.5) * images.shape[-2] / h - 0.5, (np.arange(w) + 0.5) * images.shape[-1] / w - 0.5, indexing="ij")
    whole = lambda a: np.broadcast_to(a, (images.shape[-3], h, w))
    return _sampled(images, whole(x), whole(y))


def _smaller(images: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return images
    sigma = (1 / scale - 1) * 0.5
    at = np.arange(-int(np.ceil(2.5 * sigma)), int(np.ceil(2.5 * sigma)) + 1)
    g = np.exp(-(at**2) / (2 * sigma**2))
    g /= g.sum()
    smooth = _filtered(_filtered(images, g, -1), g, -2)
    return _resized(smooth, round(images.shape[-2] * scale), round(images.shape[-1] * scale))


def displacements(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(2, n, height, width): how far, in x and in y, each pixel of n images moves to the image after; grey values from 0 to 255."""
    n, h, w = before.shape
    scales = [1.0]
    while len(scales) <= LEVELS and min(h, w) * scales[-1] * PYRAMID >= LEAST:
        scales.append(scales[-1] * PYRAMID)
    d = None
    for scale in reversed(scales):
        one, two = (expansion(_smaller(i, scale)) for i in (before, after))
        hs, ws = one.shape[-2:]
        if d is None:
            d = np.zeros((2, n, hs, ws))
        else:
            d = np.stack([_resized(d[0], hs, ws) * (ws / d.shape[-1]), _resized(d[1], hs, ws) * (hs / d.shape[-2])])
        y, x = np.meshgrid(np.arange(hs), np.arange(ws), indexing="ij")
        for _ in range(ITERATIONS):
            there = _sampled(two, x + d[0], y + d[1])
            xx, xy, yy = (one[:3] + there[:3]) / 2
            bx = (one[3] - there[3]) / 2 + xx * d[0] + xy * d[1]
            by = (one[4] - there[4]) / 2 + xy * d[0] + yy * d[1]
            g11, g12, g22, h1, h2 = (_summed(v, WINDOW) for v in (xx * xx + xy * xy, xy * (xx + yy), yy * yy + xy * xy, xx * bx + xy * by, xy * bx + yy * by))
            area = WINDOW * WINDOW
            g11, g12, g22, h1, h2 = (v / area for v in (g11, g12, g22, h1, h2))
            det = g11 * g22 - g12 * g12 + 1e-3
            d = np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det])
    return d


def images_of(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(sequence, frame_id, width, height, grey) of pixel rows (sequence, frame_id, x, y, value from 0 to 1): grey holds the rows of an image one
    after the other, so a group is one image. Missing and null pixels are 0."""
    size = pixels.groupBy("sequence", "frame_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.map_from_entries(F.collect_list(F.struct(F.struct("y", "x").alias("k"), F.coalesce(F.col(value).cast("float"), F.lit(0.0).cast("float")).alias("v")))).alias("m"))
    at = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)
    held = F.array_sort(F.map_entries("m"))
    full = F.size("m") == F.col("width") * F.col("height")
    grey = F.when(full, F.transform(held, lambda e: e["value"])).otherwise(F.transform(at, lambda i: F.coalesce(F.try_element_at("m", F.struct(F.floor(i / F.col("width")).cast(pixels.schema["y"].dataType).alias("y"), (i % F.col("width")).cast(pixels.schema["x"].dataType).alias("x"))), F.lit(0.0).cast("float"))))
    return size.select("sequence", "frame_id", "width", "height", grey.alias("grey"))


def frame_flow(images: DataFrame, field: bool = False) -> DataFrame:
    """(sequence, frame_id, mean_flow) of each frame that has one before it of its size: the mean length of the flow that leads to it; with
    field also dx and dy of all pixels. images: sequence, frame_id, width, height, grey (0 to 1, row by row)."""
    import pyarrow as pa

    # grey levels as single bytes, as rendered frames have them; images are dealt out twice
    level = lambda v: (F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255) - 128).cast("tinyint")
    images = images.select("sequence", "frame_id", "width", "height", F.transform("grey", level).alias("grey"))
    pair = images.select("sequence", "frame_id", F.lag("frame_id").over(Window.partitionBy("sequence").orderBy("frame_id")).alias("before")).where("before IS NOT NULL")
    old = images.select("sequence", F.col("frame_id").alias("before"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("grey").alias("_g"))
    pairs = pair.join(images, ["sequence", "frame_id"]).join(old, ["sequence", "before"]).where("width = _w AND height = _h AND width > 0 AND height > 0")
    extra = ", dx array<float>, dy array<float>" if field else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h = (batch.column(c).to_numpy() for c in (2, 3))
            for width, height in sorted(set(zip(w.tolist(), h.tolist(), strict=True))):
                rows = np.nonzero((w == width) & (h == height))[0]
                step = max(1, PIXELS // (width * height))
                for k in range(0, len(rows), step):
                    own = batch.take(pa.array(rows[k : k + step]))
                    after, before = (own.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width) + 128.0 for c in (4, 5))
                    d = displacements(before, after)
                    out = [own.column(0), own.column(1), pa.array(np.hypot(*d).mean((1, 2)))]
                    if field:
                        out += [pa.array(list(d[i].reshape(len(own), -1).astype(np.float32)), pa.list_(pa.float32())) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays(out, names=["sequence", "frame_id", "mean_flow", "dx", "dy"][: len(out)])

    return pairs.select("sequence", "frame_id", "width", "height", "grey", "_g").mapInArrow(run, f"sequence long, frame_id long, mean_flow double{extra}")


def steadiness(images: DataFrame) -> DataFrame:
    """(sequence, mean_flow_magnitude, max_flow_magnitude, std_flow_magnitude) over the pairs of each sequence; zeros for a single frame."""
    flow = frame_flow(images).groupBy("sequence").agg(F.avg("mean_flow").alias("mean"), F.max("mean_flow").alias("max"), F.stddev_pop("mean_flow").alias("std"))
    rows = images.select("sequence").distinct().join(flow, "sequence", "left")
    return rows.select("sequence", *[F.coalesce(k, F.lit(0.0)).alias(f"{k}_flow_magnitude") for k in ("mean", "max", "std")])
