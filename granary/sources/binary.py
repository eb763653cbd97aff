"""Readers of binary image sets. Files are read by Spark, whole, and decoded in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.images import channel_scale, grey, unsigned

#: Magic numbers of the IDX formats, and the size of a CIFAR-10 image.
IDX_IMAGES, IDX_LABELS = 2051, 2049
CIFAR_SIDE = 32


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def mnist(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """idx, label (from 1), pixels binary, h, w of an IDX pair. Raises on a wrong magic number and on unlike counts."""
    both = _files(spark, images).select(F.col("content").alias("a")).crossJoin(_files(spark, labels).select(F.col("content").alias("b")))  # one row each

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                magic, n, h, w = np.frombuffer(a, ">i4", 4)
                magic_l, n_l = np.frombuffer(b, ">i4", 2)
                if magic != IDX_IMAGES or magic_l != IDX_LABELS:
                    raise ValueError(f"magic numbers {magic} and {magic_l}; {IDX_IMAGES} and {IDX_LABELS} are needed")
                if n != n_l:
                    raise ValueError(f"{n} images and {n_l} labels")
                pixels, y = np.frombuffer(a, np.uint8, -1, 16), np.frombuffer(b, np.uint8, -1, 8)
                size = int(h) * int(w)
                for at in range(0, int(n), 4096):
                    rows = range(at, min(at + 4096, int(n)))
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([float(y[i]) + 1 for i in rows], pa.float32()), pa.array([pixels[i * size : (i + 1) * size].tobytes() for i in rows], pa.binary()), pa.array([int(h)] * len(rows), pa.int32()), pa.array([int(w)] * len(rows), pa.int32())], names=["idx", "label", "pixels", "h", "w"])

    return both.mapInArrow(run, "idx long, label float, pixels binary, h int, w int")


def cifar10(spark: SparkSession, *paths: str) -> DataFrame:
    """path, idx, label (from 1), pixels (interleaved blue, green, red), h, w of CIFAR-10 binary files."""
    area = CIFAR_SIDE * CIFAR_SIDE
    record = 1 + 3 * area

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(raw) % record:
                    raise ValueError(f"{path} doesn't hold whole records")
                x = np.frombuffer(raw, np.uint8).reshape(-1, record)
                bgr = np.ascontiguousarray(x[:, 1:].reshape(-1, 3, area)[:, ::-1].transpose(0, 2, 1)).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(range(len(x)), pa.int64()), pa.array((x[:, 0] + 1).astype(np.float32)), pa.array([r.tobytes() for r in bgr], pa.binary()), pa.array([CIFAR_SIDE] * len(x), pa.int32()), pa.array([CIFAR_SIDE] * len(x), pa.int32())], names=["path", "idx", "label", "pixels", "h", "w"])

    return _files(spark, *paths).mapInArrow(run, "path string, idx long, label float, pixels binary, h int, w int")


def cifar10_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(training, test): the five batches and the test batch."""
    return cifar10(spark, *[f"{folder}/data_batch_{i}.bin" for i in range(1, 6)]), cifar10(spark, f"{folder}/test_batch.bin")


def pixel_array(df: DataFrame, pixels: str = "pixels", out: str = "features") -> DataFrame:
    """Binary pixels as array<double> of 0..255."""
    digits = F.regexp_extract_all(F.hex(pixels), F.lit("(..)"), 1)
    return df.withColumn(out, F.transform(digits, lambda x: F.conv(x, 16, 10).cast("double")))


def normalised(df: DataFrame, means: list[float], deviations: list[float], pixels: str = "features") -> DataFrame:
    """Pixels centred and scaled by channel, with given means (of the training or the test set)."""
    return df.withColumn(pixels, channel_scale(F.col(pixels), means, deviations))


def signed_bytes(df: DataFrame, column: str) -> DataFrame:
    """array<tinyint> as array<int> of 0..255."""
    return df.withColumn(column, F.transform(column, unsigned))


def labelled(df: DataFrame, labels: str | list[int] | None = None) -> DataFrame:
    from granary.operators.select import with_labels

    return with_labels(df, "label", labels) if labels else df


def samples(df: DataFrame, means: list[float], deviations: list[float], labels: str | list[int] | None = None) -> DataFrame:
    """idx, label, features of pictures (of mnist or cifar10): of the given labels, as normalised arrays."""
    return normalised(pixel_array(labelled(df, labels)), means, deviations).select("idx", "label", "features")


def grey_samples(df: DataFrame) -> DataFrame:
    """idx, label, features of colour pictures: one grey value a pixel."""
    px = pixel_array(df)
    rgb = F.transform(F.sequence(F.lit(0), F.floor(F.size("features") / 3).cast("int") - 1), lambda i: grey(F.get("features", i * 3 + 2), F.get("features", i * 3 + 1), F.get("features", i * 3)))
    return px.select("idx", "label", rgb.alias("features"))


def aggregated(df: DataFrame, upper: int, classes: int, labels: str | list[int] | None = None, method: str = "svd", key: str = "idx", vector: str = "features", **more) -> DataFrame:
    """Rows with bucket: pictures of the given labels in buckets of about `upper` of one label, by a reduction (svd, pca, slice) and median splits or by a clustering (kmeans, bisecting, gaussian)."""
    from granary.operators.buckets import aggregate_points, cluster_by

    rows = labelled(df, labels)
    if method in ("svd", "pca", "slice"):
        return aggregate_points(rows, vector, key, "label", upper, classes, method, **more)
    return rows.join(cluster_by(rows, vector, key, "label", upper, method, **more).drop("label"), key)
