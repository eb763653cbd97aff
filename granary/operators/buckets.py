"""Balanced buckets by recursive median splits, their centroids, and layers of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.vectors import dense, dot, literal, mean_vector, one_hot
from granary.operators.ranks import largest, ranked
from granary.session import cut


#: Rows of a group that the sequential reductions take into one worker at most.
WORKER_ROWS = 2_000_000


def levels_for(n: int, upper: int, whole: bool = False) -> int:
    """Splits that give buckets of about `upper` of n rows: round(log2(n / upper)), at least 0; `whole` divides integers first."""
    ratio = n // upper if whole else n / upper
    return max(0, math.floor(math.log2(ratio) + 0.5)) if ratio > 0 else 0


def median_split(df: DataFrame, features: list[Column], key: str, by: list[str] | None = None) -> DataFrame:
    """df with bucket string: one bit for each feature. The lower floor(n/2) rows of a bucket by the feature, then the key, get 0.

    One ranking a level, over the buckets so far. A bucket halves each time, so the largest one is
    counted once; levels of large buckets are ranked over many tasks.
    """
    by = by or []
    out = df.withColumn("bucket", F.lit(""))
    most = largest(df, by) if features else 0
    for f in features:
        out = ranked(out, [*by, "bucket"], [f, F.col(key)], most)
        out = out.withColumn("bucket", F.concat("bucket", (F.col("_r") > F.floor(F.col("_n") / 2)).cast("int").cast("string"))).drop("_r", "_n")
        most = (most + 1) // 2
    return out


def split_large(df: DataFrame, feature: Column, parts: int, by: list[str] | None = None, accuracy: int = 100_000) -> DataFrame:
    """df with part int: cut at approximate quantiles of the feature, without sorting a group in one task.

    For groups too large for median_split's first windows; parts differ in size by the quantiles' error.
    """
    by = by or []
    cuts = [i / parts for i in range(1, parts)]
    edges = df.groupBy(*by).agg(F.percentile_approx(feature, cuts, F.lit(accuracy)).alias("_edges"))
    joined = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))  # one row
    return joined.withColumn("part", F.size(F.filter("_edges", lambda e: e < feature))).drop("_edges")


def centroids(df: DataFrame, vector: str, by: list[str], label: str | None = None, classes: int | None = None) -> DataFrame:
    """by, size, centroid (and the mean label, and with `classes` its one-hot): one row a bucket.

    Whole vectors are summed with partial aggregation before the shuffle; a bucket's rows never meet.
    """
    named = [F.avg(label).alias("label")] if label and label not in by else []
    out = df.groupBy(*by).agg(F.count("*").alias("size"), *named, mean_vector(dense(vector)).alias("centroid"))
    return out.withColumn("one_hot", one_hot(F.floor(F.col(label)).cast("int"), classes)) if classes else out


def centroid_cells(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """by, pos, m, n: the centroid as rows, for wide vectors."""
    return df.select(*by, F.posexplode(dense(vector)).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("m"), F.count("x").alias("n"))


def label_free(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("label", F.lit(0.0))


def roll_up(children: DataFrame, parent: Column, size: str = "size", centroid: str = "centroid") -> DataFrame:
    """parent, size, centroid: the next coarser layer, sums over children weighted by their sizes."""
    rows = children.select(parent.alias("parent"), F.col(size).alias("n"), F.posexplode(centroid).alias("pos", "m"))
    sums = rows.groupBy("parent", "pos").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    return sums.groupBy("parent").agg(F.first("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def layers(df: DataFrame, vector: str, key: str, features: list[Column], depths: list[int], by: list[str] | None = None) -> DataFrame:
    """level, bucket_id, parent_id, size, centroid (and `by`), from coarse to fine; originals keep their finest bucket in median_split's result.

    Rows are split and summed once, for the finest layer; each coarser one is rolled up from the next.
    """
    by, out, below = by or [], None, None
    for level in range(len(depths) - 1, -1, -1):
        depth = depths[level]
        if below is None:
            split = median_split(df, features, key, by).withColumn("bucket", F.substring("bucket", 1, depth))
            below = cut(centroids(split, vector, [*by, "bucket"]))
        else:
            parent = F.struct(*by, F.substring("bucket", 1, depth).alias("bucket"))
            below = cut(roll_up(below, parent).select("parent.*", "size", "centroid"))
        layer = below.withColumn("level", F.lit(level)).withColumn("parent_id", F.substring("bucket", 1, depths[level - 1]) if level else F.lit(None).cast("string")).withColumnRenamed("bucket", "bucket_id")
        out = layer if out is None else layer.unionByName(out)
    return out


def layer_bounds(upper: int, count: int) -> list[int]:
    return [max(1, upper // 4**level) for level in range(1, count)]


def slices(df: DataFrame, feature: Column, key: str, parts: int, by: list[str] | None = None) -> DataFrame:
    """df with slice int: the rank by the feature, then the key, cut into `parts` equal stretches."""
    out = ranked(df, by or [], [feature, F.col(key)])
    return out.withColumn("slice", F.least(F.floor((F.col("_r") - 1) * parts / F.col("_n")), F.lit(parts - 1)).cast("int")).drop("_r", "_n")


def by_deviation(df: DataFrame, vector: str) -> list[int]:
    """Positions by descending population deviation, then position: the order in which raw features are split."""
    stats = df.select(F.posexplode(dense(vector)).alias("pos", "x")).groupBy("pos").agg(F.stddev_pop("x").alias("s"))
    return [r["pos"] for r in stats.orderBy(F.desc("s"), "pos").collect()]  # one value a dimension


def small_and_large(buckets: DataFrame, per_bucket: int, size: str = "size") -> tuple[DataFrame, DataFrame]:
    """Buckets of at most per_bucket // 2 rows, and larger ones."""
    return buckets.filter(F.col(size) <= per_bucket // 2), buckets.filter(F.col(size) > per_bucket // 2)


def regroup_small(df: DataFrame, vector: str, per_bucket: int, seed: int = 1) -> DataFrame:
    """df (with bucket) where the rows of small buckets are pooled and clustered again by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sizes = df.groupBy("bucket").agg(F.count("*").alias("size"))
    small, large = small_and_large(sizes, per_bucket)
    pool = df.join(small.select("bucket"), "bucket", "left_semi")
    n = pool.count()
    if n == 0:
        return df
    pool = pool.withColumn("_x", array_to_vector(dense(vector)))
    model = KMeans(k=max(2, round(n / per_bucket)), seed=seed, featuresCol="_x", predictionCol="_c").fit(pool) if n > 1 else None
    pool = model.transform(pool).withColumn("bucket", F.concat(F.lit("pool/"), F.col("_c").cast("string"))).drop("_c") if model else pool.withColumn("bucket", F.lit("pool/0"))
    return df.join(large.select("bucket"), "bucket", "left_semi").unionByName(pool.drop("_x"))


def padded_dump(buckets: DataFrame, head: str, members: str) -> DataFrame:
    """value: 'label;f,f|label;f,f...' with the head first, its members repeated in turn up to the longest bucket.

    head is struct(label, features), members an array of such.
    """
    said = lambda s: F.concat_ws(";", s["label"].cast("string"), F.concat_ws(",", s["features"].cast("array<string>")))
    top = buckets.agg(F.max(F.size(members)).alias("_top"))
    joined = buckets.crossJoin(F.broadcast(top))  # one row
    filled = F.transform(F.sequence(F.lit(0), F.col("_top") - 1), lambda i: F.get(members, i % F.size(members)))
    return joined.filter(F.size(members) > 0).select(F.concat_ws("|", F.array(said(F.col(head))), F.transform(filled, said)).alias("value"))


def svd_features(df: DataFrame, vector: str, key: str, count: int, by: str | None = None, rounds: int = 20, ratio: int = 100, rate: float = 0.001, reg: float = 0.015, start: float = 0.1, limit: float = 30.0, true_stride: bool = False, backtracking: bool = False) -> DataFrame:
    """key, features: incremental SVD by gradient steps over rows and every ratio-th column, one group (`by`) in a task.

    The steps depend on each other, so a group has to fit into a worker: one of over WORKER_ROWS rows is refused, and pca_features is the way for it.
    """
    most = largest(df, [by] if by else [])  # 0 if small
    if most > WORKER_ROWS:
        raise ValueError(f"a group of {most} rows is too large for the steps of one worker; use pca_features")
    kind = df.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf["_v"].to_numpy()).astype(float)
        u, _ = incremental_svd(x, count, rounds, ratio, rate, reg, start, limit, true_stride, backtracking)
        return pd.DataFrame({key: pdf[key], "features": list(u)})

    rows = df.select(key, dense(vector).alias("_v"), *([by] if by else []))
    return rows.groupBy(*([by] if by else [])).applyInPandas(fit, f"`{key}` {kind}, features array<double>")


def incremental_svd(x: np.ndarray, count: int, rounds: int, ratio: int = 1, rate: float = 0.001, reg: float = 0.015, start: float = 0.1, limit: float = 30.0, true_stride: bool = False, backtracking: bool = False, trailing: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row factors and column factors; rows of one step are updated together, columns in the order they are visited.

    A step: p = clip(u.m), e = x - p, u += rate (e m - reg u), m += rate (e u - reg m). Backtracking
    halves the rate where the error has risen, 20 times at most, and lets it decay by 0.9. With
    `trailing` p also has what the factors that aren't stepped yet give at their start.
    """
    n, m = x.shape
    width = max(1, round(m / ratio))
    u, v = np.full((n, count), start), np.full((count, m), start)
    for f in range(count):
        error, speed, halved = np.inf, rate, 0
        for _ in range(rounds):
            old = u[:, f].copy(), v[f].copy()
            for j in range(width):
                c = (f + j * (ratio if true_stride else width)) % m
                later = (count - f - 1) * start * start if trailing else 0.0
                e = x[:, c] - np.clip(u[:, : f + 1] @ v[: f + 1, c] + later, -limit, limit)
                before = u[:, f].copy()
                u[:, f] += speed * (e * v[f, c] - reg * u[:, f])
                v[f, c] += speed * (float(e @ before) - reg * v[f, c])
            if backtracking:
                now = float(np.sqrt(np.mean((x - np.clip(u @ v, -limit, limit)) ** 2)))
                if now > error and halved < 20:
                    u[:, f], v[f] = old
                    speed, halved = speed / 2, halved + 1
                else:
                    error, speed = now, speed * 0.9
    return u, v


def sparse_incremental_svd(rows: list[tuple[np.ndarray, np.ndarray]], size: int, count: int, rounds: int, ratio: int = 1, rate: float = 0.001, reg: float = 0.015, start: float = 0.1, limit: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """Row and column factors of sparse rows (indices, values): the steps visit every `ratio`-th active entry of the table, from the factor's number on.

    The entries of one column are stepped together; entries that aren't stored are no zeros but unknown.
    """
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    col = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, int)
    val = np.concatenate([x for _, x in rows]).astype(float) if rows else np.zeros(0)
    u, v = np.full((len(rows), count), start), np.full((count, size), start)
    for f in range(count):
        on = np.arange(f % ratio, len(col), ratio)
        on = on[np.argsort(col[on], kind="stable")]
        parts = np.split(on, np.flatnonzero(np.diff(col[on])) + 1) if len(on) else []
        for _ in range(rounds):
            for part in parts:
                r, c = row[part], col[part[0]]
                e = val[part] - np.clip(u[r, : f + 1] @ v[: f + 1, c], -limit, limit)
                before = u[r, f].copy()
                u[r, f] += rate * (e * v[f, c] - reg * before)
                v[f, c] += rate * (float(e @ before) - reg * v[f, c])
    return u, v


def sparse_svd_features(df: DataFrame, indices: str, values: str, key: str, size: int, count: int, by: str | None = None, rounds: int = 20, ratio: int = 1, rate: float = 0.001) -> DataFrame:
    """key, features: svd_features of sparse rows, one group in a task; groups of over WORKER_ROWS rows are refused."""
    kind = df.schema[key].dataType.simpleString()
    most = largest(df, [by] if by else [])
    if most > WORKER_ROWS:
        raise ValueError(f"a group of {most} rows is too large for the steps of one worker")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        u, _ = sparse_incremental_svd(list(zip(pdf["_i"], pdf["_x"], strict=True)), size, count, rounds, ratio, rate)
        return pd.DataFrame({key: pdf[key], "features": list(u)})

    rows = df.select(key, F.col(indices).alias("_i"), F.col(values).alias("_x"), *([by] if by else []))
    return rows.groupBy(*([by] if by else [])).applyInPandas(fit, f"`{key}` {kind}, features array<double>")


def predicted(u: Column, m: Column, limit: float = 30.0) -> Column:
    """The clipped product of a row's and a column's factors."""
    return F.greatest(F.least(dot(u, m), F.lit(limit)), F.lit(-limit))


def root_error(x: Column, p: Column) -> Column:
    """Aggregate: the root of the mean squared difference."""
    return F.sqrt(F.avg((x - p) * (x - p)))


def svd_error(x: np.ndarray, u: np.ndarray, v: np.ndarray, limit: float = 30.0) -> float:
    return float(np.sqrt(np.mean((x - np.clip(u @ v, -limit, limit)) ** 2)))


def segmented_svd(df: DataFrame, vector: str, key: str, segments: int, count: int, **more) -> DataFrame:
    """key, features: the positions cut into segments, each reduced by itself in a task of its own, joined again in order."""
    size = df.select(F.max(F.size(vector))).first()[0] or 1
    step = math.ceil(size / segments)
    parts = df.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(size / step) - 1)), lambda s: F.struct(s.alias("seg"), F.slice(dense(vector), s * step + 1, F.lit(step)).alias("part")))).alias("_p"))
    rows = parts.select(F.struct(key, "_p.seg").alias("_k"), key, F.col("_p.seg").alias("seg"), F.col("_p.part").alias("part"))
    kind = df.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        u, _ = incremental_svd(np.stack(pdf["part"].to_numpy()).astype(float), count, more.get("rounds", 20), more.get("ratio", 1))
        return pd.DataFrame({key: pdf[key], "seg": pdf["seg"], "f": list(u)})

    got = rows.select(key, "seg", "part").groupBy("seg").applyInPandas(fit, f"`{key}` {kind}, seg int, f array<double>")
    return got.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg", "f"))), lambda s: s["f"])).alias("features"))


def pca_features(df: DataFrame, vector: str, key: str, count: int) -> DataFrame:
    """key, features: principal components, found from a distributed covariance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(dense(vector)).alias("_x"))
    return PCA(k=count, inputCol="_x", outputCol="_y").fit(rows).transform(rows).select(key, vector_to_array("_y").alias("features"))


def svd_projection(df: DataFrame, vector: str, key: str, count: int) -> DataFrame:
    """key, features: rows of U of the SVD, from the eigenvectors of the Gram matrix (dimension squared values on the driver)."""
    def part(frames):
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"i": np.arange(x.shape[1]), "row": list(x.T @ x)})

    # Every batch sends its own matrix, which are added by row.
    got = df.select(dense(vector).alias("v")).mapInPandas(part, "i int, row array<double>").groupBy("i").agg(F.count("*").alias("n"), mean_vector(F.col("row")).alias("row")).orderBy("i").collect()
    gram = np.array([np.array(r["row"]) * r["n"] for r in got]).reshape(len(got), len(got))
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(values)[::-1][:count]
    basis = vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(top))] < 0, -1, 1)
    return df.select(key, F.array(*[dot(dense(vector), literal(c)) for c in basis.T]).alias("features"))


def singular_values(df: DataFrame, vector: str, key: str, height: int, width: int, count: int) -> DataFrame:
    """key, features: the largest singular values of each row's matrix."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            x = np.stack(pdf["_v"].to_numpy()).reshape(-1, height, width) if len(pdf) else np.zeros((0, height, width))
            yield pd.DataFrame({key: pdf[key], "features": list(np.linalg.svd(x, compute_uv=False)[:, :count])})

    return df.select(key, dense(vector).alias("_v")).mapInPandas(run, f"`{key}` {kind}, features array<double>")


def first_columns(vector: str, count: int) -> Column:
    return F.slice(dense(vector), 1, count)


def aggregate_points(df: DataFrame, vector: str, key: str, label: str, upper: int, classes: int, method: str = "svd", rounds: int = 20, ratio: int = 100) -> DataFrame:
    """df with bucket, by class (label mod classes): the default chain of reduction and median splits.

    The number of splits follows from the largest class, so all classes have as many.
    """
    rows = df.withColumn("category", F.pmod(F.col(label).cast("int"), F.lit(classes)))
    top = rows.groupBy("category").count().agg(F.max("count")).first()[0] or 0
    depth = levels_for(top, upper)
    if depth == 0:
        return rows.withColumn("bucket", F.lit(""))
    if method == "svd":
        got = svd_features(rows, vector, key, depth, "category", rounds, ratio)
    elif method == "pca":
        got = pca_features(rows, vector, key, depth)
    elif method == "slice":
        got = rows.select(key, first_columns(vector, depth).alias("features"))
    else:
        raise ValueError(f"no such method: {method}")
    rows = rows.join(got.withColumnRenamed("features", "_f"), key)
    return median_split(rows, [F.get("_f", F.lit(i)) for i in range(depth)], key, ["category"]).drop("_f")


def cluster_by(df: DataFrame, vector: str, key: str, label: str, upper: int, method: str = "kmeans", seed: int = 1) -> DataFrame:
    """key, label, bucket: a clustering of each label's rows with k = round(n / 10 / upper) from MLlib.

    A loop over labels, which are few; each fit is a distributed job.
    """
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.functions import array_to_vector

    kinds = {"kmeans": KMeans, "bisecting": BisectingKMeans, "gaussian": GaussianMixture}
    rows, out = df.select(key, label, array_to_vector(dense(vector)).alias("_x")), None
    for r in rows.groupBy(label).count().orderBy(label).collect():
        part, k = rows.filter(F.col(label) == r[label]), round(r["count"] / 10 / upper)
        if k >= 2:
            part = kinds[method](k=k, seed=seed, featuresCol="_x", predictionCol="bucket").fit(part).transform(part)
        else:
            part = part.withColumn("bucket", F.lit(0))
        part = part.select(key, label, F.col("bucket").cast("int").alias("bucket"))
        out = part if out is None else out.unionByName(part)
    return out


def hash_iterative(df: DataFrame, features: list[Column], key: str, upper: int, parts: int = 2, deepest: int = 50) -> DataFrame:
    """df with bucket: equal rank slices by one feature after another, only of buckets that still hold over `upper` rows.

    A bucket's name has one step a split. Stops when no bucket is larger, the features are used up, or at `deepest`.
    """
    out = df.withColumn("bucket", F.lit(""))
    for depth, f in enumerate(features[:deepest]):
        sizes = out.groupBy("bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > upper)
        if depth % 5 == 4:
            out = cut(out)
        if sizes.isEmpty():
            break
        joined = out.join(sizes, "bucket", "left")
        large = ranked(joined.filter("_n is not null").drop("_n"), ["bucket"], [f, F.col(key)])
        step = F.least(F.floor((F.col("_r") - 1) * parts / F.col("_n")), F.lit(parts - 1)).cast("string")
        large = large.withColumn("bucket", F.concat("bucket", F.lit("/"), step)).drop("_r", "_n")
        out = large.unionByName(joined.filter("_n is null").drop("_n"))
    return out


def nested(layered: DataFrame, coarse: str, fine: str) -> DataFrame:
    """coarse key, fine (array of keys, sorted), sizes: a two-layer aggregate as one row; members stay in their own table."""
    counts = layered.groupBy(coarse, fine).agg(F.count("*").alias("size"))
    pairs = counts.groupBy(coarse).agg(F.array_sort(F.collect_list(F.struct(fine, "size"))).alias("_p"))
    return pairs.select(coarse, F.transform("_p", lambda p: p[fine]).alias(fine), F.transform("_p", lambda p: p["size"]).alias("sizes"), F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["size"]).alias("total"))


def select_members(layered: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the chosen aggregates (by their keys)."""
    return layered.join(chosen.select(*by).distinct(), by, "left_semi")


def direct_buckets(df: DataFrame, vector: str, key: str, upper: int, parts: int = 2, most: int = 8) -> DataFrame:
    """df with bucket: hash_iterative on the raw positions, those of the largest deviation first."""
    order = by_deviation(df, vector)[:most]
    return hash_iterative(df, [F.get(dense(vector), F.lit(i)) for i in order], key, upper, parts)


def two_levels(df: DataFrame, features: list[Column], key: str, upper: int) -> DataFrame:
    """df with coarse and bucket: median splits into buckets of about `upper` rows, and each of these into ones of half as many."""
    depth = levels_for(df.count(), upper)
    if depth + 1 > len(features):
        raise ValueError(f"{depth + 1} features are needed")
    out = median_split(df, features[: depth + 1], key)
    return out.withColumn("coarse", F.substring("bucket", 1, depth))


def members_of(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """by, size, members (keys in order): a bucket with the rows behind it; the rows themselves stay in their table."""
    return df.groupBy(*by).agg(F.count("*").alias("size"), F.array_sort(F.collect_list(key)).alias("members"))


def pure_centroids(df: DataFrame, vector: str, by: list[str], label: str) -> DataFrame:
    """centroids with the label of each bucket, all of whose rows must have it: others are an error."""
    got = df.groupBy(*by).agg(F.count("*").alias("size"), mean_vector(dense(vector)).alias("centroid"), F.min(label).alias("_low"), F.max(label).alias("_high"))
    same = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.raise_error(F.lit("a bucket with several labels")))
    return got.select(*by, "size", "centroid", same.alias(label))


def hashed_buckets(df: DataFrame, hashed: Column, key: str, label: str, upper: int) -> DataFrame:
    """df with bucket: each label's rows in the order of a perceptual hash, cut into stretches of about `upper` rows by median splits."""
    top = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0
    return median_split(df, [hashed] * levels_for(top, upper), key, [label])
