"""Kernel machines: scoring as a join with the support set, pack training, and partition-wise SMO in cascades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.vectors import dense, kernel

#: Most support vectors that are sent to every task; larger sets are joined in blocks of this many.
BLOCK = 20_000
#: Rows that are solved with their whole kernel at once, and rows whose kernel with those is held at once.
WORKING, SLICE = 2048, 512


def margins(df: DataFrame, vector: str, key: str, support: DataFrame, name: str = "rbf", gamma: float = 0.05, bias: float = 0.0) -> DataFrame:
    """key, margin = sum alpha y K(x, s) - bias. support: sv_id, sv_y, alpha, sv (array).

    A stated support set against all rows, block by block: each block is of a checked size, is sent
    to the tasks, and is summed before anything is shuffled.
    """
    k = kernel(name, gamma) if name != "linear" else kernel("linear")
    support = support.filter("alpha <> 0").select("sv_id", (F.col("alpha") * F.col("sv_y")).alias("_w"), dense("sv").alias("_s"))
    blocks = max(1, -(-support.count() // BLOCK))
    rows, out = df.select(key, dense(vector).alias("_v")), None
    for b in range(blocks):
        part = support if blocks == 1 else support.filter(F.pmod(F.xxhash64("sv_id"), F.lit(blocks)) == b)
        sums = rows.crossJoin(F.broadcast(part)).groupBy(key).agg(F.sum(F.col("_w") * k(F.col("_v"), F.col("_s"))).alias("margin"))
        out = sums if out is None else out.unionByName(sums)
    out = out.groupBy(key).agg(F.sum("margin").alias("margin")) if blocks > 1 else out
    return rows.select(key).join(out, key, "left").select(key, (F.coalesce("margin", F.lit(0.0)) - bias).alias("margin"))


def predict(margin: Column) -> Column:
    return F.when(margin > 0, 1).otherwise(-1)


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def hard_points(scored: DataFrame, label: str, margin: str, key: str, ratio: float) -> DataFrame:
    """The int(n * ratio) rows of the largest abs(y * margin - 1)."""
    from granary.operators.select import top_k

    return top_k(scored, F.abs(F.col(label) * F.col(margin) - 1), key, int(scored.count() * ratio))


def kernel_matrix(name: str, gamma: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if name == "rbf":
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
        d -= 2 * x @ y.T
        np.maximum(0, d, out=d)
        d *= -gamma
        return np.exp(d, out=d)
    if name == "poly":
        return (gamma * x @ y.T) ** 2
    if name == "tanh":
        return np.tanh(gamma * x @ y.T)
    return x @ y.T


class PackSvm:
    """Pegasos by packs: each round draws a pack of rows, scores it against the support set, then takes its rows one by one."""

    def __init__(self, lam: float = 0.01, gamma: float = 0.05, name: str = "rbf", seed: int = 1):
        self.lam, self.gamma, self.name, self.seed = lam, gamma, name, seed
        self.alpha: dict[int, float] = {}
        self.rows: dict[int, tuple[float, np.ndarray]] = {}
        self.scale = 1.0

    def fit(self, df: DataFrame, vector: str, label: str, key: str, rounds: int, pack: int, pool: DataFrame | None = None, weights: dict | None = None) -> PackSvm:
        """Rows are drawn by a seeded hash of the key, so runs repeat. pool: the keys that may be drawn (of chosen zips)."""
        source = df if pool is None else df.join(pool.select(key).distinct(), key, "left_semi")
        t, norm = 1, 0.0
        for r in range(rounds):
            got = source.select(key, F.col(label).cast("double").alias("y"), dense(vector).alias("v")).orderBy(F.xxhash64(F.lit(self.seed * 1000 + r), key)).limit(pack).collect()
            if not got:
                break
            ids, y, x = [g[0] for g in got], np.array([g["y"] for g in got]), np.array([g["v"] for g in got])
            own = kernel_matrix(self.name, self.gamma, x, x)
            sums = self._sums(x) * self.scale
            for i in range(len(ids)):
                t += 1
                shrink = 1 - 1 / t
                self.scale *= shrink
                sums *= shrink
                norm *= shrink * shrink
                if y[i] * sums[i] < 1:
                    step = 1 / (self.lam * t)
                    norm += 2 * y[i] * step * sums[i] + step * step * own[i, i]
                    self.alpha[ids[i]] = self.alpha.get(ids[i], 0.0) + step / self.scale
                    self.rows[ids[i]] = (y[i], x[i])
                    later = slice(i + 1, None)
                    sums[later] += step * y[i] * own[i, later]
                    if norm > 1 / self.lam:
                        ratio = np.sqrt(self.lam * norm)
                        self.scale /= ratio
                        sums /= ratio
                        norm = 1 / self.lam
        return self

    def _sums(self, x: np.ndarray) -> np.ndarray:
        if not self.alpha:
            return np.zeros(len(x))
        y, s = np.array([self.rows[i][0] for i in self.alpha]), np.stack([self.rows[i][1] for i in self.alpha])
        return kernel_matrix(self.name, self.gamma, x, s) @ (np.array(list(self.alpha.values())) * y)

    def support(self, spark) -> DataFrame:
        rows = [(int(i), float(self.rows[i][0]), float(a * self.scale), self.rows[i][1].tolist()) for i, a in self.alpha.items()]
        return spark.createDataFrame(rows, "sv_id long, sv_y double, alpha double, sv array<double>")


def zip_svm(df: DataFrame, zips: DataFrame, vector: str, label: str, key: str, rounds: int, pack: int, **more) -> PackSvm:
    """Two levels: solve on the zips (zip_id, centroid, label), then draw packs from the rows of the zips that support it."""
    spark = df.sparkSession
    coarse = PackSvm(**more).fit(zips, "centroid", label, "zip_id", rounds, pack)
    chosen = spark.createDataFrame([(int(i),) for i, a in coarse.alpha.items() if a > 0] or [(-1,)], "zip_id long")
    pool = df.join(chosen, "zip_id", "left_semi")  # at most rounds * pack zips; the planner knows their number
    return PackSvm(**more).fit(df, vector, label, key, rounds, pack, pool)


def layered_svm(df: DataFrame, layers: list[DataFrame], vector: str, label: str, key: str, rounds: int, pack: int, **more) -> PackSvm:
    """As zip_svm with more than one layer of zips, coarsest first (zip_id, centroid, label, parent): each layer draws from the zips whose parents support the one above, the rows from those of the finest."""
    spark, pool = df.sparkSession, None
    for layer in layers:
        rows = layer if pool is None else layer.join(pool.withColumnRenamed("zip_id", "parent"), "parent", "left_semi")
        machine = PackSvm(**more).fit(rows, "centroid", label, "zip_id", rounds, pack)
        pool = spark.createDataFrame([(int(i),) for i, a in machine.alpha.items() if a > 0] or [(-1,)], "zip_id long")
    return PackSvm(**more).fit(df, vector, label, key, rounds, pack, df.join(pool, "zip_id", "left_semi") if layers else None)


def zipped(df: DataFrame, vector: str, label: str, key: str, upper: int, method: str = "svd", hyper=None, **more) -> tuple[DataFrame, DataFrame]:
    """(rows with zip_id, zips): buckets of one label of about `upper` rows, by a reduction (svd, pca, slice) or by sign hashing (lsh, with planes)."""
    from granary.operators import buckets, lsh

    if method == "lsh":
        split = df.join(lsh.rounds(df, vector, key, upper, hyper), key)
    else:
        side = df.withColumn("_side", F.when(F.col(label) > 0, 1).otherwise(0))
        split = buckets.aggregate_points(side, vector, key, "_side", upper, 2, method, **more).drop("_side", "category")
    zips = buckets.centroids(split, vector, [label, "bucket"])
    rows = split.withColumn("zip_id", F.xxhash64(label, "bucket")).drop("bucket")
    return rows, zips.withColumn("zip_id", F.xxhash64(label, "bucket")).select("zip_id", "centroid", label)


def _open(y: np.ndarray, a: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose y * alpha may rise, and whose may fall."""
    more, less = a < c - 1e-12, a > 1e-12
    return np.where(y > 0, more, less), np.where(y > 0, less, more)


def _steps(k: np.ndarray, y: np.ndarray, a: np.ndarray, f: np.ndarray, c: float, tol: float, most: int) -> int:
    """Steps on the pair of the largest violation until none is over 2 tol: a and f are changed in place. The number of steps."""
    for done in range(most):
        up, low = _open(y, a, c)
        if not up.any() or not low.any():
            return done
        i, j = np.where(up, f, np.inf).argmin(), np.where(low, f, -np.inf).argmax()
        if f[j] - f[i] <= 2 * tol:
            return done
        eta = 2 * k[i, j] - k[i, i] - k[j, j]
        if y[i] != y[j]:
            bottom, top = max(0.0, a[j] - a[i]), min(c, c + a[j] - a[i])
        else:
            bottom, top = max(0.0, a[i] + a[j] - c), min(c, a[i] + a[j])
        new = a[j] - y[j] * (f[i] - f[j]) / eta if eta < 0 else (bottom if y[j] * (f[i] - f[j]) > 0 else top)
        new = min(max(new, bottom), top)
        d = new - a[j]
        if abs(d) < 1e-12:
            return done
        e = -y[i] * y[j] * d
        a[j], a[i] = new, a[i] + e
        f += d * y[j] * k[j] + e * y[i] * k[i]
    return most


def _worst(f: np.ndarray, up: np.ndarray, low: np.ndarray, tol: float) -> np.ndarray:
    """Places of the WORKING / 2 smallest f of the rows that may rise and the largest of those that may fall, as far as they violate the optimum."""
    out = []
    for g, side, bound in ((f, up, f[low].max()), (-f, low, -f[up].min())):
        at = np.flatnonzero(side & (g < bound - 2 * tol))
        out.append(at if len(at) <= WORKING // 2 else at[np.argpartition(g[at], WORKING // 2 - 1)[: WORKING // 2]])
    return np.union1d(*out)


def smo(x: np.ndarray, y: np.ndarray, c: float = 1.0, gamma: float = 0.05, name: str = "rbf", tol: float = 1e-3, most: int = 10_000, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Sequential minimal optimisation with the two-threshold rule: (alpha, b), margins are sum alpha y K - b.

    More than WORKING rows are solved by the WORKING rows of the largest violations, again and again, until no row
    violates; only the kernel of those is kept, that with the others comes and goes in slices. `most` steps
    are taken at most, and as many for each further WORKING rows. Raises ValueError where only one class is present.
    """
    if len(set(y.tolist())) < 2:
        raise ValueError("rows of both classes are needed")
    n, all_ = len(y), np.arange(len(y))
    a = np.zeros(n) if start is None else start.astype(float).copy()
    f, left = -y.astype(float), most * max(1, -(-n // WORKING))

    def add(change: np.ndarray, of: np.ndarray) -> None:
        """f for changes of alpha * y of the rows `of`."""
        at = np.flatnonzero(change)
        for s in range(0, n, SLICE):
            for t in range(0, len(at), WORKING):
                u = at[t : t + WORKING]
                f[s : s + SLICE] += kernel_matrix(name, gamma, x[s : s + SLICE], x[of[u]]) @ change[u]

    add(a * y, all_)
    while left > 0:
        up, low = _open(y, a, c)
        if not up.any() or not low.any() or f[low].max() - f[up].min() <= 2 * tol:
            break
        rows = all_ if n <= WORKING else _worst(f, up, low, tol)
        own, before = f[rows], a[rows]
        now = before.copy()
        took = _steps(kernel_matrix(name, gamma, x[rows], x[rows]), y[rows], now, own, c, tol, left)
        left -= took
        a[rows] = now
        if n <= WORKING:
            f = own
        else:
            add((now - before) * y[rows], rows)
        if n <= WORKING or not took:
            break
    up, low = _open(y, a, c)
    inside = (a > 1e-8) & (a < c - 1e-8)
    b = float(f[inside].mean()) if inside.any() else float((np.where(up, f, np.inf).min() + np.where(low, f, -np.inf).max()) / 2)
    return a, b


def stratified_parts(df: DataFrame, label: str, key: str, parts: int) -> DataFrame:
    """df with part_id: rows of each class are dealt out by the hash of the key, so every part sees both at any fair size."""
    return df.withColumn("part_id", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def solve_parts(df: DataFrame, vector: str, label: str, key: str, c: float = 1.0, gamma: float = 0.05, name: str = "rbf") -> DataFrame:
    """key, part_id, y, alpha, v of each part's support vectors, and a row with key -(part + 1) and alpha = b for its intercept.

    A part is solved in memory: choose the number of parts so that one holds a few thousand rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, y = np.stack(pdf["v"].to_numpy()), pdf["y"].to_numpy(float)
        a, b = smo(x, y, c, gamma, name)
        keep = a > 1e-8
        part = int(pdf["part_id"].iloc[0])
        out = pd.DataFrame({"id": pdf[key][keep], "part_id": part, "y": y[keep], "alpha": a[keep], "v": list(x[keep])})
        return pd.concat([out, pd.DataFrame({"id": [-(part + 1)], "part_id": [part], "y": [0.0], "alpha": [b], "v": [[]]})])

    rows = df.select(key, "part_id", F.col(label).cast("double").alias("y"), dense(vector).alias("v"))
    return rows.groupBy("part_id").applyInPandas(run, "id long, part_id int, y double, alpha double, v array<double>")


def cascade(df: DataFrame, vector: str, label: str, key: str, parts: int, layers: int = 2, ratio: float | None = None, c: float = 1.0, gamma: float = 0.05, name: str = "rbf") -> tuple[DataFrame, float]:
    """(support set, bias): each layer halves the parts and solves on what the last one kept.

    It keeps the support vectors, and with `ratio` also that share of all rows, the hardest by
    abs(y * margin - 1).
    """
    from granary.session import cut

    rows = df.select(F.col(key).alias("id"), F.col(label).cast("double").alias("y"), dense(vector).alias("v"))
    pool, support, bias = rows, None, 0.0
    for layer in range(layers):
        n = max(1, parts >> layer) if layer < layers - 1 else 1
        got = cut(solve_parts(stratified_parts(pool, "y", "id", n), "v", "y", "id", c, gamma, name))
        bias = got.filter("id < 0").agg(F.avg("alpha")).first()[0] or 0.0
        support = got.filter("id >= 0").select(F.col("id").alias("sv_id"), F.col("y").alias("sv_y"), "alpha", F.col("v").alias("sv"))
        keep = support.select(F.col("sv_id").alias("id"))
        if ratio is not None and layer < layers - 1:
            scored = rows.join(margins(rows, "v", "id", support.withColumn("alpha", F.col("alpha") / n), name, gamma, bias), "id")
            keep = keep.union(hard_points(scored, "y", "margin", "id", ratio).select("id")).distinct()
        pool = cut(rows.join(keep, "id", "left_semi"))
    return support, float(bias)


def zip_cascade(df: DataFrame, zips: DataFrame, vector: str, label: str, key: str, ratio: float, parts: int, **more) -> tuple[DataFrame, float]:
    """A cascade over the rows of the zips (zip_id, centroid, label) that are hardest for a machine trained on the zips."""
    support, bias = cascade(zips, "centroid", label, "zip_id", 1, 1, **more)
    named = {k: v for k, v in more.items() if k in ("name", "gamma")}
    scored = zips.join(margins(zips, "centroid", "zip_id", support, bias=bias, **named), "zip_id")
    chosen = hard_points(scored, label, "margin", "zip_id", ratio)
    return cascade(df.join(chosen.select("zip_id"), "zip_id", "left_semi"), vector, label, key, parts, **more)
