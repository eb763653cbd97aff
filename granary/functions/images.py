"""Functions of images held as flat arrays of pixel values, and perceptual hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.vectors import once

#: Weights of red, green and blue in grey.
GREY = (0.3, 0.59, 0.11)


def unsigned(b: Column) -> Column:
    """A signed byte as 0..255."""
    return b.cast("int").bitwiseAND(F.lit(0xFF))


def grey(r: Column, g: Column, b: Column) -> Column:
    return r * GREY[0] + g * GREY[1] + b * GREY[2]


def channel_scale(pixels: Column, means: list[float], deviations: list[float]) -> Column:
    """Interleaved pixels, each channel centred and divided by its own deviation."""
    n = len(means)
    m, s = F.array(*map(F.lit, means)), F.array(*map(F.lit, deviations))
    return F.transform(pixels, lambda x, i: (x - F.get(m, i % n)) / F.get(s, i % n))


def to_planar(pixels: Column, height: int, width: int, channels: int = 3, swap: bool = False) -> Column:
    """Interleaved (height, width, channel) -> planar (channel, height, width); swap reverses the channels."""
    area = height * width
    index = F.sequence(F.lit(0), F.lit(area * channels - 1))
    channel = lambda i: F.floor(i / area).cast("int")
    return F.transform(index, lambda i: F.get(pixels, (i % area) * channels + (channels - 1 - channel(i) if swap else channel(i))))


def to_interleaved(pixels: Column, height: int, width: int, channels: int = 3, swap: bool = False) -> Column:
    area = height * width
    index = F.sequence(F.lit(0), F.lit(area * channels - 1))
    return F.transform(index, lambda i: F.get(pixels, ((channels - 1 - i % channels) if swap else i % channels) * area + F.floor(i / channels).cast("int")))


def histogram(df: DataFrame, pixels: str, key: str, channels: int = 1, segments: int = 6) -> DataFrame:
    """key, bin, share: 256 grey bins, or segments^3 colour bins of interleaved pixels (0..255)."""
    if channels == 1:
        cells = df.select(key, F.explode(pixels).alias("x")).select(key, F.floor("x").cast("int").alias("bin"))
    else:
        part = lambda x: F.least(F.lit(segments - 1), F.floor(x * segments / 255)).cast("int")
        base = df.select(key, F.col(pixels).alias("_p"), F.explode(F.sequence(F.lit(0), F.floor(F.size(pixels) / 3).cast("int") - 1)).alias("_i"))
        at = lambda j: F.get("_p", F.col("_i") * 3 + j)
        cells = base.select(key, ((part(at(0)) * segments + part(at(1))) * segments + part(at(2))).alias("bin"))
    counts = cells.groupBy(key, "bin").count()
    sums = counts.groupBy(key).agg(F.sum("count").alias("_n"))
    return counts.join(sums, key).select(key, "bin", (F.col("count") / F.col("_n")).alias("share"))


def average_hash(pixels: Column, levels: int = 64) -> Column:
    """64 grey pixels (0..255) -> bit 63-i set where pixel i is at least the mean."""
    scaled = F.transform(pixels, lambda x: x / 255.0 * levels)
    mean = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    return _bits(once(mean, lambda m: F.transform(scaled, lambda x: x >= m)))


def difference_hash(pixels: Column, height: int = 8, width: int = 9) -> Column:
    """height x width grey pixels -> a bit for each pixel that is brighter than its right neighbour."""
    falls = F.zip_with(pixels, F.slice(pixels, F.lit(2), F.greatest(F.size(pixels) - 1, F.lit(0))), lambda a, b: a > b)
    return _bits(F.filter(F.slice(falls, 1, height * width), lambda _, i: i % width < width - 1))


def _bits(flags: Column) -> Column:
    """64 flags -> a long, the first flag in the highest bit."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.when(b, 1).otherwise(0).cast("long")))


def hash_bits(h: Column) -> Column:
    """A 64-bit hash as 64 doubles, the highest bit first."""
    return once(h, lambda x: F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(1)).cast("double")))


def dct(pixels: np.ndarray) -> np.ndarray:
    """Orthonormal two-dimensional cosine transform of square images [..., n, n], cut to integers."""
    n = pixels.shape[-1]
    c = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n) + 1)[None] * np.arange(n)[:, None] / (2 * n))
    c[0] = np.sqrt(1 / n)
    return np.trunc(c @ pixels @ c.T)


def shrink(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images [..., h, w] to height x width by area means."""

    def weights(old, new):
        edge = np.linspace(0, old, new + 1)
        low = np.maximum(edge[:-1, None], np.arange(old)[None])
        high = np.minimum(edge[1:, None], np.arange(1, old + 1)[None])
        w = np.maximum(0, high - low)
        return w / w.sum(axis=1, keepdims=True)

    return weights(pixels.shape[-2], height) @ pixels @ weights(pixels.shape[-1], width).T


def perceptual_hashes(images: DataFrame, key: str, pixels: str = "pixels", height: int = 28, width: int = 28, channels: int = 1) -> DataFrame:
    """key, ahash, phash, dhash of interleaved 8-bit images, a batch at a time (null or odd-sized images: null hashes)."""
    kind = images.schema[key].dataType.simpleString()

    def pack(flags):
        return [int.from_bytes(np.packbits(f).tobytes(), "big", signed=True) for f in flags.reshape(len(flags), 64)]

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            ok = [i for i, x in enumerate(raw) if x is not None and len(x) == height * width * channels]
            out = [[None] * len(raw) for _ in range(3)]
            if ok:
                img = np.array([np.frombuffer(bytes(raw[i]), np.uint8) if isinstance(raw[i], (bytes, bytearray)) else raw[i] for i in ok], np.float64).reshape(len(ok), height, width, channels)
                g = img[..., 0] if channels == 1 else img[..., 2] * GREY[0] + img[..., 1] * GREY[1] + img[..., 0] * GREY[2]
                a, d, p = shrink(g, 8, 8), shrink(g, 8, 9), dct(g)[:, :8, :8] if height == width else None
                for col, flags in zip(out, (a >= a.mean(axis=(1, 2), keepdims=True), None if p is None else p >= p.mean(axis=(1, 2), keepdims=True), d[:, :, :-1] > d[:, :, 1:]), strict=True):
                    if flags is not None:
                        for i, h in zip(ok, pack(flags), strict=True):
                            col[i] = h
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out]], names=[key, "ahash", "phash", "dhash"])

    return images.select(key, pixels).mapInArrow(run, f"`{key}` {kind}, ahash long, phash long, dhash long")
