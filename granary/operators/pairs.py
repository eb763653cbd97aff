"""Pairs within groups: the index of the upper triangle, matrices of distances or kernels, and sums of kernels.

A group's rows are cut into blocks, and each two blocks meet in a task of their own, so that no task
sees more than two blocks however large the group is. The pairs are the result, as many as asked for;
of sums no pair leaves its task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.vectors import dense
from granary.operators.ranks import ranked

#: Rows of a group in a block; in a block of sums, whose pairs aren't kept; rows of such a block whose pairs are in memory at once.
BLOCK, SUM_BLOCK, SUM_STEP = 512, 4096, 256
#: Largest error of an exponent that a product of vectors may leave; beyond it differences are taken first.
EXPONENT_ERROR = 1e-13


def _meeting(df: DataFrame, key: str, by: list[str], columns: list, block: int | None = None, order: tuple = ()) -> DataFrame:
    """by, _i, _j (two blocks, or one twice), _b (the row's own block), key and columns: each row once for every block of its group."""
    block = block or BLOCK
    rows = ranked(df.select(*by, key, *columns), by, [F.col(key), *order])
    blocks, own = F.ceil(F.col("_n") / block).cast("int"), F.floor((F.col("_r") - 1) / block).cast("int")
    rows = rows.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_r", "_n", "_o")


def _triangle(pdf: pd.DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that a task answers for: first key <= second key; rows of one block with themselves, or those of two."""
    own = pdf["_b"].to_numpy()
    if pdf["_i"].iat[0] == pdf["_j"].iat[0]:
        return np.triu_indices(len(pdf))
    a, b = np.flatnonzero(own == pdf["_i"].iat[0]), np.flatnonzero(own == pdf["_j"].iat[0])
    return np.repeat(a, len(b)), np.tile(b, len(a))


def pair_index(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """by, a, b: the pairs of keys a <= b of each group, each row with itself included. Keys are unique in a group and not null."""
    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + f"{', ' if by else ''}a {kind}, b {kind}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, y = _triangle(pdf, key)
        k = pdf[key].to_numpy()
        return pd.DataFrame({**{c: [pdf[c].iat[0]] * len(x) for c in by}, "a": k[x], "b": k[y]})

    return _meeting(df, key, by, []).groupBy(*by, "_i", "_j").applyInPandas(run, schema)


def matrix(df: DataFrame, vector: str, key: str, by: list[str], kind: str = "euclidean", gamma: float = 1.0) -> DataFrame:
    """by, a, b, value: of each two rows of a group (a <= b) the Euclidean distance or a kernel (rbf, poly, linear, tanh)."""
    from granary.operators.svm import kernel_matrix

    if kind not in ("euclidean", "rbf", "poly", "linear", "tanh"):
        raise ValueError(f"no such matrix: {kind}")
    name = df.schema[key].dataType.simpleString()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + f"{', ' if by else ''}a {name}, b {name}, value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, y = _triangle(pdf, key)
        v, k = np.stack(pdf["_v"].to_numpy()).astype(float), pdf[key].to_numpy()
        if kind == "euclidean":  # differences first: close rows would lose their digits in a product
            value = np.concatenate([np.linalg.norm(v[x[i : i + 65536]] - v[y[i : i + 65536]], axis=1) for i in range(0, len(x), 65536)])
        else:
            value = kernel_matrix(kind, gamma, v, v)[x, y]
        return pd.DataFrame({**{c: [pdf[c].iat[0]] * len(x) for c in by}, "a": k[x], "b": k[y], "value": value})

    return _meeting(df, key, by, [dense(vector).alias("_v")]).groupBy(*by, "_i", "_j").applyInPandas(run, schema)


def _padded(vectors: pd.Series, there: pd.Series) -> tuple[np.ndarray, np.ndarray | None]:
    """The vectors as rows, zeros where nothing is, and where something is; None if everywhere. there: flags of the elements of a vector with null ones, else null."""
    if vectors.notna().all() and there.isna().all() and vectors.map(len).nunique() == 1 and len(vectors.iat[0]):
        return np.stack(vectors.to_numpy()).astype(float), None
    x = np.zeros((len(vectors), max((len(v) for v in vectors if v is not None), default=0)))
    known = np.zeros(x.shape)
    for i, (v, t) in enumerate(zip(vectors, there, strict=True)):
        if v is not None:
            t = np.ones(len(v), bool) if t is None else np.asarray(t, bool)
            x[i, : len(v)], known[i, : len(v)] = np.where(t, v, 0.0), t
    return x, known


def _sqdist(x: np.ndarray, y: np.ndarray, p: np.ndarray | None, q: np.ndarray | None, most: float) -> np.ndarray:
    """Squared distances of the rows of x and y over the elements that both have (p, q: 1 where one is; None: all). Differences first where a product could leave an error over `most`."""
    with np.errstate(all="ignore"):
        xx, yy = x * x, y * y
        if 16 * np.finfo(float).eps * (xx.sum(1).max(initial=0) + yy.sum(1).max(initial=0)) <= most:
            sides = xx.sum(1)[:, None] + yy.sum(1)[None] if p is None else xx @ q.T + p @ yy.T
            return np.maximum(0, sides - 2 * x @ y.T)
        out = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            d = (x[:, j, None] - y[None, :, j]) ** 2
            out += d if p is None else np.where(p[:, j, None] * q[None, :, j] > 0, d, 0)
        return out


def rbf_sums(df: DataFrame, vector: str, key: str, by: list[str], gamma: float) -> DataFrame:
    """by, total, pairs: the sum of exp(-gamma * squared distance) over the pairs of rows of a group with first key <= second key, each row with itself included, and their number.

    Rows of one key are pairs in either order. Rows with a null key or group are in no pair. Distances
    are over the elements that both vectors have; pairs without any are counted and add nothing.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + f"{', ' if by else ''}total double, pairs long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_b", key])
        (x, known), k, own = _padded(pdf["_v"], pdf["_there"]), pdf[key].to_numpy(), pdf["_b"].to_numpy()
        alone = own[0] == own[-1]
        first, second = np.flatnonzero(own == own[0]), np.flatnonzero(own == own[-1])
        sums, some, n = [], False, 0
        for s in range(0, len(first), SUM_STEP):
            a = first[s : s + SUM_STEP]
            b = second[np.searchsorted(k[second], k[a[0]]) :] if alone else second
            p, q = (None, None) if known is None else (known[a], known[b])
            value = np.exp(-gamma * _sqdist(x[a], x[b], p, q, EXPONENT_ERROR / abs(gamma) if gamma else np.inf))
            times = None
            if alone:
                times = (k[a][:, None] <= k[b][None]).astype(int)
            elif k[a[-1]] >= k[b[0]]:  # rows of one key fell into two blocks
                times = 1 + (k[a][:, None] == k[b][None])
            if times is not None:
                value = np.where(times > 0, value, 0) * times
            if known is not None:
                both = p @ q.T > 0
                value = np.where(both, value, 0)
                both = both if times is None else both & (times > 0)
            n += value.size if times is None else int(times.sum())
            some = some or known is None or bool(both.any())
            sums.append(value.sum(1))
        return pd.DataFrame({**{c: [pdf[c].iat[0]] for c in by}, "total": [math.fsum(np.concatenate(sums)) if some else None], "pairs": [n]})

    held = df.filter(F.col(key).isNotNull())
    for c in by:
        held = held.filter(F.col(c).isNotNull())
    there = F.when(F.exists(vector, F.isnull), F.transform(vector, F.isnotnull))
    rows = _meeting(held, key, by, [F.col(vector).alias("_v"), there.alias("_there")], SUM_BLOCK, (F.xxhash64("_v"),))
    rows = rows.repartition(*by, "_i", "_j")  # ranked by a window they'd all stay in the task of their group
    return rows.groupBy(*by, "_i", "_j").applyInPandas(run, schema).groupBy(*by).agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
