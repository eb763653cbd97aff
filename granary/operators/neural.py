"""Multilayer perceptrons and a small convolutional network: numpy gradients in Arrow batches, summed by position."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.vectors import dense


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Perceptron:
    """Affine layers with sigmoids between, and softmax with cross-entropy (or sigmoids with squared error) at the end."""

    def __init__(self, layers: list[int], softmax: bool = True):
        self.layers, self.softmax = list(layers), softmax
        self.size = sum(a * b + b for a, b in zip(layers, layers[1:]))

    def start(self, seed: int = 1) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([np.append(rng.standard_normal(a * b) / np.sqrt(a), np.zeros(b)) for a, b in zip(self.layers, self.layers[1:])])

    def _parts(self, w):
        out, at = [], 0
        for a, b in zip(self.layers, self.layers[1:]):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x, w):
        acts = [x]
        parts = self._parts(np.asarray(w, float))
        for i, (m, b) in enumerate(parts):
            z = acts[-1] @ m + b
            if i < len(parts) - 1 or not self.softmax:
                acts.append(sigmoid(z))
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                acts.append(e / e.sum(axis=1, keepdims=True))
        return acts

    def loss_gradient(self, x, y, w):
        """(sum of losses, gradient) for 0-based labels y."""
        acts, parts = self.forward(x, w), self._parts(np.asarray(w, float))
        t = np.eye(self.layers[-1])[y.astype(int)]
        p = acts[-1]
        loss = -np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-300)).sum() if self.softmax else 0.5 * ((p - t) ** 2).sum()
        delta = p - t if self.softmax else (p - t) * p * (1 - p)
        out = []
        for i in range(len(parts) - 1, -1, -1):
            out.insert(0, np.append((acts[i].T @ delta).ravel(), delta.sum(axis=0)))
            if i:
                delta = (delta @ parts[i][0].T) * acts[i] * (1 - acts[i])
        return float(loss), np.concatenate(out)

    def first_layer_scores(self, x, y, w):
        """Squared first-layer gradient of each row."""
        acts, parts = self.forward(x, w), self._parts(np.asarray(w, float))
        delta = acts[-1] - np.eye(self.layers[-1])[y.astype(int)]
        for i in range(len(parts) - 1, 0, -1):
            delta = (delta @ parts[i][0].T) * acts[i] * (1 - acts[i])
        return (delta**2).sum(axis=1) * ((x**2).sum(axis=1) + 1)

    def value(self, x, w):
        return self.forward(x, w)[-1]


class Convolution:
    """One convolution with sigmoids, mean pooling by `pool`, and a softmax layer, for square grey images."""

    def __init__(self, side: int, kernel: int = 5, maps: int = 6, pool: int = 2, classes: int = 10):
        self.side, self.kernel, self.maps, self.pool, self.classes = side, kernel, maps, pool, classes
        self.out = (side - kernel + 1) // pool
        self.flat = maps * self.out * self.out
        self.size = maps * kernel * kernel + maps + self.flat * classes + classes

    def start(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        a, b = self.maps * self.kernel**2, self.flat * self.classes
        return np.concatenate([rng.standard_normal(a) / self.kernel, np.zeros(self.maps), rng.standard_normal(b) / np.sqrt(self.flat), np.zeros(self.classes)])

    def _parts(self, w):
        w = np.asarray(w, float)
        a, b = self.maps * self.kernel**2, self.flat * self.classes
        return w[:a].reshape(self.maps, -1), w[a : a + self.maps], w[a + self.maps : a + self.maps + b].reshape(self.flat, -1), w[a + self.maps + b :]

    def _patches(self, x):
        img = x.reshape(-1, self.side, self.side)
        return np.lib.stride_tricks.sliding_window_view(img, (self.kernel, self.kernel), axis=(1, 2)).reshape(len(x), self.side - self.kernel + 1, -1, self.kernel**2)

    def _forward(self, x, w):
        k, b, m, c = self._parts(w)
        patches = self._patches(x)
        a = sigmoid(np.einsum("nijp,mp->nmij", patches, k) + b[None, :, None, None])
        o, p = self.out, self.pool
        pooled = a[:, :, : o * p, : o * p].reshape(len(x), self.maps, o, p, o, p).mean(axis=(3, 5))
        z = pooled.reshape(len(x), -1) @ m + c
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return patches, a, pooled, e / e.sum(axis=1, keepdims=True)

    def value(self, x, w):
        return self._forward(x, w)[-1]

    def loss_gradient(self, x, y, w):
        k, b, m, c = self._parts(w)
        patches, a, pooled, prob = self._forward(x, w)
        t = np.eye(self.classes)[y.astype(int)]
        delta = prob - t
        o, p = self.out, self.pool
        back = (delta @ m.T).reshape(len(x), self.maps, o, o)
        up = np.zeros_like(a)
        up[:, :, : o * p, : o * p] = np.kron(back, np.ones((p, p))) / (p * p)
        up *= a * (1 - a)
        loss = -np.log(np.maximum(prob[np.arange(len(y)), y.astype(int)], 1e-300)).sum()
        return float(loss), np.concatenate([np.einsum("nmij,nijp->mp", up, patches).ravel(), up.sum(axis=(0, 2, 3)), (pooled.reshape(len(x), -1).T @ delta).ravel(), delta.sum(axis=0)])

    def first_layer_scores(self, x, y, w):
        return np.array([(self.loss_gradient(x[i : i + 1], y[i : i + 1], w)[1][: self.maps * self.kernel**2] ** 2).sum() for i in range(len(x))])


class Network:
    """Layers in a row: ("conv", maps, kernel), ("pool", size), ("full", units), each but a pool followed by a sigmoid; the last full layer by a softmax, or by sigmoids with squared error.

    Inputs are square images of `side` and `channels` (channel by channel), or plain rows with side 0 and
    `channels` values. lenet() builds the usual stack.
    """

    def __init__(self, layers: list[tuple], side: int, channels: int = 1, softmax: bool = True):
        self.layers, self.side, self.channels, self.softmax = [tuple(x) for x in layers], side, channels, softmax
        self.shapes, shape = [], (channels, side) if side else (channels, 1)
        for kind, *p in self.layers:
            c, n = shape
            if kind == "conv":
                if p[1] > n:
                    raise ValueError(f"a kernel of {p[1]} on a side of {n}")
                self.shapes.append(((p[0], c * p[1] * p[1]), p[0]))
                shape = p[0], n - p[1] + 1
            elif kind == "pool":
                self.shapes.append(None)
                shape = c, n // p[0]
            elif kind == "full":
                self.shapes.append(((p[0], c * n * n), p[0]))
                shape = p[0], 1
            else:
                raise ValueError(f"no such layer: {kind}")
        self.classes = shape[0] * shape[1] * shape[1]
        self.size = sum(s[0][0] * s[0][1] + s[1] for s in self.shapes if s)

    def start(self, seed: int = 1) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([np.concatenate([rng.standard_normal(s[0]).ravel() / np.sqrt(s[0][1]), np.zeros(s[1])]) for s in self.shapes if s])

    def _weights(self, w):
        out, at, w = [], 0, np.asarray(w, float)
        for s in self.shapes:
            if s is None:
                out.append(None)
                continue
            n = s[0][0] * s[0][1]
            out.append((w[at : at + n].reshape(s[0]), w[at + n : at + n + s[1]]))
            at += n + s[1]
        return out

    @staticmethod
    def _patches(x, k):
        view = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(2, 3))  # n, c, i, j, k, k
        return view.transpose(0, 2, 3, 1, 4, 5).reshape(len(x), view.shape[2], view.shape[3], -1)

    def _forward(self, x, w):
        a, kept = x.reshape(len(x), self.channels, self.side, self.side) if self.side else x.reshape(len(x), -1, 1, 1), []
        for i, ((kind, *p), m) in enumerate(zip(self.layers, self._weights(w), strict=True)):
            if kind == "conv":
                patches = self._patches(a, p[1])
                out = sigmoid((patches @ m[0].T + m[1]).transpose(0, 3, 1, 2))
                kept.append((a, patches, out))
            elif kind == "pool":
                s, n = p[0], a.shape[2] // p[0]
                out = a[:, :, : n * s, : n * s].reshape(*a.shape[:2], n, s, n, s).mean(axis=(3, 5))
                kept.append((a, None, out))
            else:
                flat = a.reshape(len(a), -1)
                z = flat @ m[0].T + m[1]
                if i == len(self.layers) - 1 and self.softmax:
                    e = np.exp(z - z.max(axis=1, keepdims=True))
                    z = e / e.sum(axis=1, keepdims=True)
                else:
                    z = sigmoid(z)
                out = z[:, :, None, None]
                kept.append((a, flat, out))
            a = out
        return kept

    def value(self, x, w):
        return self._forward(x, w)[-1][2].reshape(len(x), -1)

    def loss_gradient(self, x, y, w):
        kept = self._forward(x, w)
        p = kept[-1][2].reshape(len(x), -1)
        t = np.eye(self.classes)[y.astype(int)]
        if self.softmax:
            loss, back = -np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-300)).sum(), p - t
        else:
            loss, back = 0.5 * ((p - t) ** 2).sum(), (p - t) * p * (1 - p)
        grads, d = [], back[:, :, None, None]  # d: by the layer's sum, before its sigmoid
        for i in range(len(self.layers) - 1, -1, -1):
            (kind, *q), m, (a, inner, _) = self.layers[i], self._weights(w)[i], kept[i]
            if kind == "conv":
                grads.append(np.concatenate([np.einsum("nmij,nijp->mp", d, inner).ravel(), d.sum(axis=(0, 2, 3))]))
                cols = np.einsum("nmij,mp->nijp", d, m[0]).reshape(len(x), d.shape[2], d.shape[3], a.shape[1], q[1], q[1])
                back = np.zeros(a.shape)
                for r in range(q[1]):
                    for c in range(q[1]):
                        back[:, :, r : r + d.shape[2], c : c + d.shape[3]] += cols[:, :, :, :, r, c].transpose(0, 3, 1, 2)
            elif kind == "pool":
                s, n = q[0], a.shape[2] // q[0]
                back = np.zeros(a.shape)
                back[:, :, : n * s, : n * s] = np.kron(d, np.ones((1, 1, s, s))) / (s * s)
            else:
                flat = d.reshape(len(x), -1)
                grads.append(np.concatenate([(flat.T @ inner).ravel(), flat.sum(axis=0)]))
                back = (flat @ m[0]).reshape(a.shape)
            d = back * a * (1 - a) if i and self.layers[i - 1][0] != "pool" else back
        return float(loss), np.concatenate(grads[::-1])

    def first_layer_scores(self, x, y, w):
        n = self.shapes[0][0][0] * self.shapes[0][0][1]
        return np.array([(self.loss_gradient(x[i : i + 1], y[i : i + 1], w)[1][:n] ** 2).sum() for i in range(len(x))])


def lenet(side: int = 28, classes: int = 10, maps: tuple[int, int] = (6, 12), kernel: int = 5, units: int = 100, channels: int = 1) -> Network:
    """Two convolutions with pools, a full layer and the classes."""
    return Network([("conv", maps[0], kernel), ("pool", 2), ("conv", maps[1], kernel), ("pool", 2), ("full", units), ("full", classes)], side, channels)


class Update:
    """Weight updates by name: constant, simple (step / sqrt(t)), l1, l2, adam, radam."""

    def __init__(self, kind: str = "simple", step: float = 0.1, reg: float = 0.0, beta1: float = 0.9, beta2: float = 0.999):
        if kind not in ("constant", "simple", "l1", "l2", "adam", "radam"):
            raise ValueError(f"no such update: {kind}")
        self.kind, self.step, self.reg, self.b1, self.b2 = kind, step, reg, beta1, beta2
        self.m = self.v = 0.0

    def __call__(self, w: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
        s = self.step / np.sqrt(t)
        if self.kind == "constant":
            return w - self.step * g
        if self.kind == "simple":
            return w - s * g
        if self.kind == "l1":
            x = w - s * g
            return np.sign(x) * np.maximum(0, np.abs(x) - s * self.reg)
        if self.kind == "l2":
            return w * (1 - s * self.reg) - s * g
        self.m = self.b1 * self.m + (1 - self.b1) * g
        self.v = self.b2 * self.v + (1 - self.b2) * g * g
        mean = self.m / (1 - self.b1**t)
        if self.kind == "radam":
            top = 2 / (1 - self.b2) - 1
            rho = top - 2 * t * self.b2**t / (1 - self.b2**t)
            if rho <= 4:
                return w - self.step * mean
            rect = np.sqrt((rho - 4) * (rho - 2) * top / ((top - 4) * (top - 2) * rho))
            return w - self.step * rect * mean / (np.sqrt(self.v / (1 - self.b2**t)) + 1e-8)
        return w - self.step * mean / (np.sqrt(self.v / (1 - self.b2**t)) + 1e-8)


def decayed(step: float, epoch: int, every: int = 30, factor: float = 0.1) -> float:
    return step * factor ** (epoch // every)


def gradient(df: DataFrame, model, vector: str, label: str, w) -> tuple[float, np.ndarray, int]:
    """(mean loss, mean gradient, rows): each task sends one vector, added by position."""
    from granary.operators.regress import _partial

    def fn(x, y):
        loss, g = model.loss_gradient(x, y, w)
        return np.concatenate([g, [loss, float(len(y))]])

    got = _partial(df, vector, label, fn)
    if not len(got):
        return 0.0, np.zeros(model.size), 0
    n = int(got[-1])
    return got[-2] / n, got[:-2] / n, n


def fit(df: DataFrame, model, vector: str, label: str, iterations: int = 50, update: Update | None = None, seed: int = 1, start=None) -> tuple[np.ndarray, list[float]]:
    w, update, history = model.start(seed) if start is None else np.asarray(start, float), update or Update(), []
    for t in range(1, iterations + 1):
        loss, g, _ = gradient(df, model, vector, label, w)
        history.append(loss)
        w = update(w, g, t)
    return w, history


def zip_scores(zips: DataFrame, model, label: str, w, part: str, vector: str = "centroid") -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(v, y):
        import pandas as pd

        return pd.Series(model.first_layer_scores(np.stack(v.to_numpy()), y.to_numpy(float), w) if len(v) else [], dtype=float)

    return zips.withColumn("score", score(dense(vector), F.col(label).cast("double")))


def fit_zips(points: DataFrame, zips: DataFrame, model, vector: str, label: str, iterations: int, part: str, update: Update | None = None, seed: int = 1, floor: float = 1e-4, share: float = 1 / 50) -> tuple[np.ndarray, list[float]]:
    """Each step uses the rows of the zips whose first-layer score exceeds `floor` and `share` of their part's mean (share 1: the mean)."""
    from pyspark.sql import Window

    w, update, history = model.start(seed), update or Update(), []
    for t in range(1, iterations + 1):
        scored = zip_scores(zips, model, label, w, part)
        mean = F.avg("score").over(Window.partitionBy(part))
        chosen = scored.withColumn("_mean", mean).filter((F.col("score") > floor) & (F.col("score") > F.col("_mean") * share))
        loss, g, n = gradient(points.join(chosen.select("zip_id"), "zip_id", "left_semi"), model, vector, label, w)
        history.append(loss)
        if n == 0:
            break
        w = update(w, g, t)
    return w, history


def predict(df: DataFrame, model, vector: str, w, out: str = "prediction") -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def best(v):
        import pandas as pd

        return pd.Series(model.value(np.stack(v.to_numpy()), w).argmax(axis=1) if len(v) else [], dtype="int32")

    return df.withColumn(out, best(dense(vector)))


def save(spark: SparkSession, layers: list[int], w, path: str) -> None:
    spark.createDataFrame([([int(x) for x in layers], [float(x) for x in w])], "layers array<int>, weights array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[list[int], np.ndarray]:
    r = spark.read.parquet(path).first()
    return list(r["layers"]), np.array(r["weights"])


def mllib(df: DataFrame, vector: str, label: str, layers: list[int], iterations: int = 100, seed: int = 1):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(dense(vector)).alias("x"), F.col(label).cast("double").alias("y"))
    return MultilayerPerceptronClassifier(layers=layers, maxIter=iterations, seed=seed, solver="gd", featuresCol="x", labelCol="y").fit(rows)


def convolve(x: np.ndarray, k: np.ndarray, full: bool = False) -> np.ndarray:
    """Two-dimensional convolution (the kernel turned around), valid or full."""
    if full:
        x = np.pad(x, [(k.shape[0] - 1,) * 2, (k.shape[1] - 1,) * 2])
    return np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(x, k.shape), k[::-1, ::-1])


def pool_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Means of size x size cells; what doesn't fill a cell is left out."""
    h, w = (n // size for n in x.shape)
    return x[: h * size, : w * size].reshape(h, size, w, size).mean(axis=(1, 3))


def unpool(x: np.ndarray, size: int) -> np.ndarray:
    """Each value as a size x size cell: the Kronecker product with ones."""
    return np.kron(x, np.ones((size, size)))


def spec(model) -> str:
    return json.dumps({k: v for k, v in vars(model).items() if isinstance(v, (int, float, list, bool))})
