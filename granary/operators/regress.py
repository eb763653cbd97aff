"""Nonlinear regression: models, the sum-of-squares objective, and its trainers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.vectors import dense, dot, literal


class SigmoidNetwork:
    """sum_i v_i sigmoid(w_i x + b_i); the weights are one run [w, b, v] a node."""

    def __init__(self, inputs: int, nodes: int):
        self.inputs, self.nodes = inputs, nodes
        self.size = (inputs + 2) * nodes

    def _parts(self, w):
        w = np.asarray(w, float).reshape(self.nodes, self.inputs + 2)
        return w[:, : self.inputs], w[:, self.inputs], w[:, self.inputs + 1]

    def column(self, v: Column, weights) -> Column:
        out = F.lit(0.0)
        for w, b, s in zip(*self._parts(weights), strict=True):
            out = out + float(s) / (F.lit(1.0) + F.exp(-(dot(v, literal(w)) + float(b))))
        return out

    def value(self, x: np.ndarray, weights) -> np.ndarray:
        w, b, s = self._parts(weights)
        return (1 / (1 + np.exp(-(x @ w.T + b)))) @ s

    def gradient(self, x: np.ndarray, weights) -> np.ndarray:
        """One row a point: the derivative of the value by each weight."""
        w, b, s = self._parts(weights)
        a = 1 / (1 + np.exp(-(x @ w.T + b)))
        slope = a * (1 - a) * s
        out = np.concatenate([slope[:, :, None] * x[:, None, :], slope[:, :, None], a[:, :, None]], axis=2)
        return out.reshape(len(x), self.size)


class RadialSum:
    """sum alpha exp(-0.5 sum ((x - mu) / sigma)^2); the weights are one run [mu, sigma, alpha] a unit (one sigma)."""

    def __init__(self, inputs: int, units: int):
        self.inputs, self.units = inputs, units
        self.size = (inputs + 2) * units

    def _parts(self, w):
        w = np.asarray(w, float).reshape(self.units, self.inputs + 2)
        return w[:, : self.inputs], w[:, self.inputs], w[:, self.inputs + 1]

    def column(self, v: Column, weights) -> Column:
        from granary.functions.vectors import sqdist

        out = F.lit(0.0)
        for mu, sigma, alpha in zip(*self._parts(weights), strict=True):
            out = out + float(alpha) * F.exp(-0.5 * sqdist(v, literal(mu)) / float(sigma * sigma))
        return out

    def value(self, x: np.ndarray, weights) -> np.ndarray:
        mu, sigma, alpha = self._parts(weights)
        return np.exp(-0.5 * ((x[:, None] - mu) ** 2).sum(axis=2) / sigma**2) @ alpha

    def gradient(self, x: np.ndarray, weights) -> np.ndarray:
        mu, sigma, alpha = self._parts(weights)
        d = x[:, None] - mu
        q = (d * d).sum(axis=2)
        e = np.exp(-0.5 * q / sigma**2)
        out = np.concatenate([(alpha * e / sigma**2)[:, :, None] * d, (alpha * e * q / sigma**3)[:, :, None], e[:, :, None]], axis=2)
        return out.reshape(len(x), self.size)


def numeric_gradient(model, x: np.ndarray, weights, h: float = 1e-6) -> np.ndarray:
    w = np.asarray(weights, float)
    return np.stack([(model.value(x, w + h * e) - model.value(x, w - h * e)) / (2 * h) for e in np.eye(len(w))], axis=1)


def random_weights(size: int, seed: int = 1, scale: float = 1.0) -> list[float]:
    return (np.random.default_rng(seed).standard_normal(size) * scale).tolist()


def loss(df: DataFrame, model, vector: str, label: str, weights) -> DataFrame:
    """One row: n, loss = 0.5 * sum of squared residuals, mse. Native: the model is an expression."""
    r = model.column(dense(vector), weights) - F.col(label)
    return df.agg(F.count("*").alias("n"), (0.5 * F.sum(r * r)).alias("loss"), F.avg(r * r).alias("mse"))


def _partial(df: DataFrame, vector: str, label: str, fn) -> np.ndarray:
    """Sum over all rows of the vectors that fn(x, y) returns for each batch; batches send one vector each, added by position."""

    def run(frames):
        import pandas as pd

        held = None
        for pdf in frames:
            if len(pdf):
                got = fn(np.stack(pdf["_v"].to_numpy()), pdf["_y"].to_numpy(float))
                held = got if held is None else held + got
        if held is not None:
            yield pd.DataFrame({"pos": np.arange(len(held)), "x": held})

    rows = df.select(dense(vector).alias("_v"), F.col(label).cast("double").alias("_y")).mapInPandas(run, "pos int, x double")
    got = rows.groupBy("pos").agg(F.sum("x").alias("x")).collect()  # one value a weight
    out = np.zeros(max((r["pos"] for r in got), default=-1) + 1)
    for r in got:
        out[r["pos"]] = r["x"]
    return out


def loss_and_gradient(df: DataFrame, model, vector: str, label: str, weights) -> tuple[float, np.ndarray]:
    """(0.5 sum r^2, the gradient with the factor 2 of sum r^2)."""
    w = np.asarray(weights, float)

    def fn(x, y):
        r = model.value(x, w) - y
        return np.append(2 * (r @ model.gradient(x, w)), 0.5 * r @ r)

    got = _partial(df, vector, label, fn)
    return (float(got[-1]), got[:-1]) if len(got) else (0.0, np.zeros(model.size))


def hessian(df: DataFrame, model, vector: str, label: str, weights, floor: float = 1e-4) -> np.ndarray:
    """Gauss-Newton matrix: sum of gradient products, its eigenvalues raised to `floor`."""
    w = np.asarray(weights, float)

    def fn(x, y):
        g = model.gradient(x, w)
        return (g.T @ g).ravel()

    m = _partial(df, vector, label, fn).reshape(model.size, model.size)
    values, vectors = np.linalg.eigh(m)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def quadratic_minimum(x0, f0, g0, x1, f1) -> float | None:
    """Minimum of the parabola through two values and a slope at the first."""
    d = x1 - x0
    a = (f1 - f0 - g0 * d) / (d * d)
    return x0 - g0 / (2 * a) if a > 0 else None


def line_search(value, f0: float, slope: float, start: float = 1.0, c1: float = 1e-4, tries: int = 20) -> float:
    """A step of sufficient decrease, by parabolas kept within a tenth and a half of the last step; 0 if there is none."""
    step = start
    for _ in range(tries):
        f = value(step)
        if np.isfinite(f) and f <= f0 + c1 * step * slope:
            return step
        guess = quadratic_minimum(0.0, f0, slope, step, f) if np.isfinite(f) else None
        step = min(max(guess if guess is not None else 0.0, step * 0.1), step * 0.5)
    return 0.0


def descend(df: DataFrame, model, vector: str, label: str, weights, iterations: int = 20, newton: bool = False) -> tuple[np.ndarray, list[float]]:
    """Gradient (or Gauss-Newton) descent with a line search; one aggregate job an evaluation."""
    w, history = np.asarray(weights, float), []
    for _ in range(iterations):
        f, g = loss_and_gradient(df, model, vector, label, w)
        history.append(f)
        d = -np.linalg.solve(hessian(df, model, vector, label, w), g) if newton else -g
        step = line_search(lambda s, w=w, d=d: loss(df, model, vector, label, w + s * d).first()["loss"], f, float(g @ d) / 2)
        if step == 0.0:
            break
        w = w + step * d
    return w, history


def point_scores(df: DataFrame, model, vector: str, label: str, weights) -> DataFrame:
    """df with grad_norm of each row's 2 r dV/dw."""
    w = np.asarray(weights, float)
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(v, y):
        import pandas as pd

        if not len(v):
            return pd.Series([], dtype=float)
        x = np.stack(v.to_numpy())
        return pd.Series(np.abs(2 * (model.value(x, w) - y.to_numpy(float))) * np.linalg.norm(model.gradient(x, w), axis=1))

    return df.withColumn("grad_norm", score(dense(vector), F.col(label).cast("double")))


def top_gradient(df: DataFrame, model, vector: str, label: str, key: str, weights, ratio: float, part: str) -> np.ndarray:
    """The gradient over the top `ratio` of rows by gradient norm in each part."""
    from granary.operators.select import top_fraction

    chosen = top_fraction(point_scores(df, model, vector, label, weights), F.col("grad_norm"), key, ratio, [part])
    return loss_and_gradient(chosen, model, vector, label, weights)[1]


def large_gradients(df: DataFrame, model: SigmoidNetwork, vector: str, label: str, weights, nodes: int = 2, limit: float = 1e-10) -> DataFrame:
    """Rows whose squared gradient over the first `nodes` nodes exceeds limit / C^2, C = 2 (prediction - y). Native."""
    v = dense(vector)
    c = 2 * (model.column(v, weights) - F.col(label))
    w, b, s = model._parts(weights)
    square, norm2 = F.lit(0.0), dot(v, v)
    for i in range(min(nodes, model.nodes)):
        a = F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot(v, literal(w[i])) + float(b[i]))))
        slope = a * (F.lit(1.0) - a) * float(s[i])
        square = square + slope * slope * (norm2 + 1) + a * a
    return df.filter((c != 0) & (square > limit / (c * c)))


def minibatch(df: DataFrame, model, vector: str, label: str, weights, iterations: int, step: float, fraction: float = 1.0, seed: int = 1, large_only: bool = False) -> np.ndarray:
    """Mini-batch descent with steps step / n / sqrt(iteration), n the rows of the batch."""
    w = np.asarray(weights, float)
    for i in range(1, iterations + 1):
        batch = df.sample(False, fraction, seed + i) if fraction < 1 else df
        if large_only:
            batch = large_gradients(batch, model, vector, label, w)
        n = batch.count()
        if n:
            w = w - step / n / np.sqrt(i) * loss_and_gradient(batch, model, vector, label, w)[1]
    return w


def zip_descent(points: DataFrame, zips: DataFrame, model, vector: str, label: str, weights, iterations: int, step: float, ratio: float, part: str) -> np.ndarray:
    """Each iteration ranks the zips (zip_id, centroid, label, part) by gradient norm and uses the rows of the top `ratio` (one at least)."""
    from granary.operators.select import expand, top_fraction

    w = np.asarray(weights, float)
    for i in range(1, iterations + 1):
        scored = point_scores(zips, model, "centroid", label, w)
        chosen = expand(top_fraction(scored, F.col("grad_norm"), "zip_id", ratio, [part], least=1), points, ["zip_id"])
        n = chosen.count()
        if n:
            w = w - step / n / np.sqrt(i) * loss_and_gradient(chosen, model, vector, label, w)[1]
    return w


def zip_regression(df: DataFrame, model, vector: str, label: str, key: str, weights, iterations: int, step: float, ratio: float, per_bucket: int, hyper) -> np.ndarray:
    """The whole chain: hashing rounds, regrouping of small buckets, then zip descent."""
    from granary.operators.buckets import centroids, regroup_small
    from granary.operators.lsh import rounds

    bucketed = df.join(rounds(df, vector, key, per_bucket, hyper), key)
    bucketed = regroup_small(bucketed, vector, per_bucket).withColumnRenamed("bucket", "zip_id")
    zips = centroids(bucketed, vector, ["zip_id"], label).withColumnRenamed("label", label).withColumn("part", F.pmod(F.xxhash64("zip_id"), F.lit(4)))
    return zip_descent(bucketed, zips, model, vector, label, weights, iterations, step, ratio, "part")


def linear_regression(df: DataFrame, vector: str, label: str, iterations: int = 50):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(maxIter=iterations, featuresCol="x", labelCol="y").fit(df.select(array_to_vector(dense(vector)).alias("x"), F.col(label).cast("double").alias("y")))
