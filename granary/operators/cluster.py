"""Clustering: exact and approximate k-means, bisecting k-means, mixtures.

The state between iterations is a center list (k rows, on the driver) and, for the approximate
variants, a table of (id, label) cut by a checkpoint every few steps.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.vectors import costs, dense, distance, gap, literal, mean_vector, nearest, spread_vector, total
from granary.operators.ranks import ranked
from granary.session import cut


def assign(df: DataFrame, vector: str, centers: list[list[float]], metric: str = "euclidean") -> DataFrame:
    """df with cluster (the first of the nearest) and cost. A projection: the centers are a literal of the plan."""
    return df.withColumn("_c", costs(dense(vector), centers, metric)).withColumn("cluster", nearest(F.col("_c"))).withColumn("cost", F.array_min("_c")).drop("_c")


#: Cells (centers times positions) of a block of a center table.
CENTER_CELLS = 4_000_000


def assign_joined(df: DataFrame, vector: str, key: str, centers: DataFrame, metric: str = "euclidean") -> DataFrame:
    """key, cluster, cost for a center table (cluster, center) too long for a literal; the smallest cluster of equally near ones.

    Rows pass by the centers block by block, and each carries its nearest one so far: nothing is
    shuffled, and no block is larger than CENTER_CELLS, however long the table. A null or undefined
    cost is that of no center.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"no such metric: {metric}")
    kinds = {f.name: f.dataType.simpleString() for f in [df.schema[key], centers.schema["cluster"]]}
    schema = f"`{key}` {kinds[key]}, _v array<double>, cluster {kinds['cluster']}, cost double"
    out = df.select(key, dense(vector).alias("_v"), F.lit(None).cast(kinds["cluster"]).alias("cluster"), F.lit(None).cast("double").alias("cost"))
    width = centers.select(F.max(F.size("center"))).first()[0] or 1
    rows = max(1, CENTER_CELLS // width)
    n, table = centers.count(), centers.select("cluster", F.col("center").cast("array<double>").alias("center"))
    if n > rows:
        table = cut(ranked(table, [], [F.col("cluster")], most=n))
    for start in range(0, n, rows):
        block = table.filter(F.col("_r").between(start + 1, start + rows)) if n > rows else table
        out = out.mapInPandas(_nearer(*_block(block), metric), schema)
    return out.select(key, "cluster", "cost")


def _block(block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Names and matrix of a block of at most CENTER_CELLS cells."""
    got = sorted(((r["cluster"], r["center"]) for r in block.select("cluster", "center").collect()), key=lambda x: x[0])
    return np.array([c for c, _ in got]), np.array([x for _, x in got], float)


def _nearer(names: np.ndarray, centers: np.ndarray, metric: str):
    def cost(v: np.ndarray) -> np.ndarray:
        if metric == "euclidean":
            d = centers - v
            return np.einsum("ij,ij->i", d, d)
        length = np.linalg.norm(centers, axis=1) * np.linalg.norm(v)
        return np.where(length > 0, 1 - centers @ v / np.where(length > 0, length, 1), np.inf)

    def run(frames):
        for pdf in frames:
            for i, v in enumerate(pdf["_v"]):
                c = cost(np.asarray(v, float)) if v is not None else np.array([np.inf])
                at = int(c.argmin())
                if np.isfinite(c[at]) and not c[at] >= pdf["cost"].iat[i]:
                    pdf.iat[i, 2], pdf.iat[i, 3] = names[at], c[at]
            yield pdf

    return run


def wssse(df: DataFrame, vector: str, centers: list[list[float]], metric: str = "euclidean") -> DataFrame:
    return assign(df, vector, centers, metric).agg(F.sum("cost").alias("wssse"))


def center_sums(assigned: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """cluster, n, center: whole vectors are summed in each task before the shuffle."""
    return assigned.groupBy(cluster).agg(F.count("*").alias("n"), mean_vector(dense(vector)).alias("center"))


def moved(centers: list[list[float]], sums: DataFrame, cluster: str = "cluster") -> list[list[float]]:
    """New centers; an empty cluster keeps its own."""
    got = {r[cluster]: list(r["center"]) for r in sums.collect()}  # k rows
    return [got.get(i, c) for i, c in enumerate(centers)]


def kmeans(df: DataFrame, vector: str, centers: list[list[float]], iterations: int, metric: str = "euclidean") -> list[list[float]]:
    """Lloyd's iterations, a fixed number, over the vectors alone, which are kept in memory or on disk meanwhile."""
    rows = df.select(dense(vector).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(iterations):
            centers = moved(centers, center_sums(assign(rows, "v", centers, metric), "v"))
    finally:
        rows.unpersist()
    return centers


def change_count(df: DataFrame, vector: str, before: list[list[float]], after: list[list[float]], metric: str = "euclidean") -> DataFrame:
    """One row: how many rows change their cluster between two center lists."""
    old, new = nearest(costs(dense(vector), before, metric)), nearest(costs(dense(vector), after, metric))
    return df.agg(F.count_if(old != new).alias("changed"), F.count("*").alias("n"))


def kmeans_with_statistics(df: DataFrame, vector: str, centers: list[list[float]], iterations: int, metric: str = "euclidean") -> tuple[list[list[float]], list[int]]:
    counts = []
    for _ in range(iterations):
        after = moved(centers, center_sums(assign(df, vector, centers, metric), vector))
        counts.append(change_count(df, vector, centers, after, metric).first()["changed"])
        centers = after
    return centers, counts


def approximate_step(points: DataFrame, zips: DataFrame, vector: str, key: str, before: list[list[float]] | None, centers: list[list[float]], ratio: float, part: str, metric: str = "euclidean", order: str = "change") -> DataFrame:
    """points (key, vector, zip_id, cluster) with the clusters of the most affected zips' rows assigned anew.

    Zips are ranked in each `part` by the change of their cost since `before`, descending, or by the gap
    between their two nearest centers, ascending; the first int(n * ratio) are refreshed, all of them
    when `before` is None. The others keep their stale cluster.
    """
    from granary.operators.select import top_fraction

    if before is None:
        return points.withColumn("cluster", nearest(costs(dense(vector), centers, metric)))
    now = costs(dense("centroid"), centers, metric)
    score = F.abs(F.array_min(now) - F.array_min(costs(dense("centroid"), before, metric))) if order == "change" else -gap(now)
    chosen = top_fraction(zips.withColumn("_score", score), F.col("_score"), "zip_id", ratio, [part]).select("zip_id", F.lit(True).alias("_chosen"))
    joined = points.join(chosen, "zip_id", "left")
    return joined.withColumn("cluster", F.when(F.col("_chosen"), nearest(costs(dense(vector), centers, metric))).otherwise(F.col("cluster"))).drop("_chosen")


def approximate_kmeans(points: DataFrame, zips: DataFrame, vector: str, key: str, centers: list[list[float]], iterations: int, ratio: float, part: str, metric: str = "euclidean", order: str = "change", every: int = 3) -> list[list[float]]:
    """k-means that touches only the rows of the zips that matter; with ratio 1 it is exact. State is cut every few steps."""
    state, before = points.withColumn("cluster", F.lit(-1)), None
    for i in range(iterations):
        state = approximate_step(state, zips, vector, key, before, centers, ratio, part, metric, order)
        if i % every == every - 1:
            state = cut(state)
        before, centers = centers, moved(centers, center_sums(state, vector))
    return centers


def layered_kmeans(points: DataFrame, coarse: DataFrame, fine: DataFrame, vector: str, key: str, centers: list[list[float]], iterations: int, budget: int, metric: str = "euclidean") -> list[list[float]]:
    """Two layers of zips: by ascending gap, fine zips are refreshed until `budget` original rows are spent; the rest follow their coarse zip.

    coarse: coarse_id, centroid. fine: zip_id, coarse_id, centroid, size. points: key, vector, zip_id.
    A row budget stands in for a deadline, so that results do not depend on the clock.
    """
    from pyspark.sql import Window

    for _ in range(iterations):
        base = coarse.select("coarse_id", nearest(costs(dense("centroid"), centers, metric)).alias("_coarse"))
        ranked = fine.withColumn("_gap", gap(costs(dense("centroid"), centers, metric)))
        w = Window.orderBy("_gap", "zip_id").rowsBetween(Window.unboundedPreceding, 0)  # over zips, not rows
        chosen = ranked.withColumn("_spent", F.sum("size").over(w)).withColumn("_chosen", F.col("_spent") <= budget).join(base, "coarse_id").select("zip_id", "_chosen", "_coarse")
        state = points.join(chosen, "zip_id").withColumn("cluster", F.when(F.col("_chosen"), nearest(costs(dense(vector), centers, metric))).otherwise(F.col("_coarse")))
        centers = moved(centers, center_sums(state, vector))
    return centers


def summaries(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """by, n, mean, cost: the sum of squared distances of a scalar from its mean, found without subtracting large sums."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("cost"))


def cluster_summaries(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """cluster, size, center, cost of vectors."""
    v = dense(vector)
    return df.groupBy(cluster).agg(F.count("*").alias("size"), mean_vector(v).alias("center"), total(spread_vector(v)).alias("cost"))


def split_center(center: list[float], seed: int, level: float = 1e-4) -> tuple[list[float], list[float]]:
    """Two centers around one, apart by noise of `level` times its length."""
    c = np.array(center)
    noise = np.random.default_rng(seed).random(len(c)) * level * float(np.linalg.norm(c))
    return (c - noise).tolist(), (c + noise).tolist()


class Tree:
    """A bisecting tree: nodes by heap index (root 1, children 2i and 2i+1)."""

    def __init__(self, nodes: dict[int, dict]):
        self.nodes = nodes

    def children(self, i: int) -> list[int]:
        return [c for c in (2 * i, 2 * i + 1) if c in self.nodes]

    def leaves(self) -> list[int]:
        return sorted(i for i in self.nodes if not self.children(i))

    def centers(self) -> list[list[float]]:
        return [self.nodes[i]["center"] for i in self.leaves()]

    def height(self, i: int) -> float:
        c = np.array(self.nodes[i]["center"])
        return float(max((np.sqrt(((np.array(self.nodes[j]["center"]) - c) ** 2).sum()) for j in self.children(i)), default=0.0))

    def leaf(self, v: Column) -> Column:
        """Index of the leaf that a greedy descent reaches."""

        def down(i):
            kids = self.children(i)
            if not kids:
                return F.lit(i)
            if len(kids) == 1:
                return down(kids[0])
            a, b = (distance(v, literal(self.nodes[j]["center"])) for j in kids)
            return F.when(a <= b, down(kids[0])).otherwise(down(kids[1]))

        return down(1)

    def path(self, v: Column) -> Column:
        """Indices from the root to the leaf."""
        leaf, out = self.leaf(v), F.array()
        for depth in range(max(self.nodes).bit_length() - 1, -1, -1):
            out = F.concat(out, F.array(F.shiftright(leaf, depth)))
        return F.filter(out, lambda i: i > 0)

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        order = self.leaves()
        at = F.array_position(F.array(*map(F.lit, order)), self.leaf(dense(vector))) - 1
        return df.withColumn("cluster", at.cast("int"))

    def cost(self, df: DataFrame, vector: str) -> float:
        leaf = self.leaf(dense(vector))
        cost = F.lit(None).cast("double")
        for i in self.leaves():
            cost = F.when(F.col("_leaf") == i, distance(dense(vector), literal(self.nodes[i]["center"]))).otherwise(cost)
        return df.withColumn("_leaf", leaf).agg(F.sum(cost)).first()[0] or 0.0

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, int(n["size"]), n["center"], float(np.linalg.norm(n["center"])), float(n["cost"]), self.height(i), self.children(i)) for i, n in sorted(self.nodes.items())]
        spark.createDataFrame(rows, "index int, size long, center array<double>, norm double, cost double, height double, children array<int>").write.mode("overwrite").parquet(f"{path}/data")
        spark.createDataFrame([(json.dumps({"format": "granary.tree", "version": 1, "root": 1}),)], "value string").write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tree:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        if meta.get("format") != "granary.tree":
            raise ValueError(f"not a tree: {path}")
        return Tree({r["index"]: {"size": r["size"], "center": list(r["center"]), "cost": r["cost"]} for r in spark.read.parquet(f"{path}/data").collect()})


def _node(r) -> dict:
    return {"size": r["size"], "center": list(r["center"]), "cost": r["cost"]}


def bisecting_kmeans(df: DataFrame, vector: str, k: int, iterations: int = 5, least: float = 1.0, eps: float = 1e-12, seed: int = 1, noise: float = 1e-4, zips: DataFrame | None = None, ratio: float = 1.0) -> Tree:
    """Splits the largest divisible leaves until there are k.

    A leaf is divisible with at least `least` rows (a share of all rows below 1) and a cost above
    eps * size. All leaves of a level are split in the same jobs: a row compares with the two children
    of its own leaf only.

    With `zips` (zip_id, centroid; df has zip_id) rows are reassigned zip by zip, and only the `ratio`
    of zips with the largest cost(own) - cost(sibling) look at their rows again.
    """
    from granary.operators.select import top_fraction

    n = df.count()
    if n == 0:
        return Tree({})
    floor = np.ceil(least) if least >= 1 else np.ceil(least * n)
    state = df.withColumn("_node", F.lit(1))
    nodes = {1: _node(cluster_summaries(state, vector, "_node").first())}
    leaves = {1}
    while len(leaves) < k:
        able = sorted((i for i in leaves if nodes[i]["size"] >= floor and nodes[i]["cost"] > eps * nodes[i]["size"]), key=lambda i: (-nodes[i]["size"], i))[: k - len(leaves)]
        if not able:
            break
        centers = {i: split_center(nodes[i]["center"], seed + i, noise) for i in able}

        def child(v, centers=centers):
            out = F.col("_node")
            for i, (a, b) in centers.items():
                out = F.when(F.col("_node") == i, F.when(distance(v, literal(a)) <= distance(v, literal(b)), 2 * i).otherwise(2 * i + 1)).otherwise(out)
            return out

        for step in range(iterations):
            if zips is None or step == 0:
                moved_rows = state.withColumn("_child", child(dense(vector)))
            else:
                at = zips.join(moved_rows.groupBy("zip_id").agg(F.max("_node").alias("_node"), F.max("_child").alias("_child")), "zip_id")
                margin = F.lit(0.0)
                for i, (a, b) in centers.items():
                    d = distance(dense("centroid"), literal(a)) - distance(dense("centroid"), literal(b))
                    margin = F.when(F.col("_child") == 2 * i, d).when(F.col("_child") == 2 * i + 1, -d).otherwise(margin)
                chosen = top_fraction(at.withColumn("_m", margin), F.col("_m"), "zip_id", ratio, ["_node"], least=1).select("zip_id", F.lit(True).alias("_again"))
                moved_rows = moved_rows.join(chosen, "zip_id", "left").withColumn("_child", F.when(F.col("_again"), child(dense(vector))).otherwise(F.col("_child"))).drop("_again")
            got = {r["_child"]: _node(r) for r in cluster_summaries(moved_rows.filter(F.col("_node").isin(able)), vector, "_child").collect()}
            centers = {i: tuple(got[c]["center"] if c in got else centers[i][c - 2 * i] for c in (2 * i, 2 * i + 1)) for i in able}
        state = cut(state.withColumn("_node", child(dense(vector))))
        got = {r["_node"]: _node(r) for r in cluster_summaries(state.filter(F.col("_node").isin([c for i in able for c in (2 * i, 2 * i + 1)])), vector, "_node").collect()}
        for i in able:
            kids = [c for c in (2 * i, 2 * i + 1) if c in got]
            leaves.discard(i)
            if len(kids) < 2:  # no split: the node stays a leaf that can't be divided
                nodes[i]["cost"] = 0.0
                leaves.add(i)
                state = state.withColumn("_node", F.when(F.col("_node").isin(kids), i).otherwise(F.col("_node")))
                continue
            nodes |= {c: got[c] for c in kids}
            leaves |= set(kids)
    return Tree(nodes)


def mllib_kmeans(df: DataFrame, vector: str, k: int, iterations: int = 20, seed: int = 1):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="x").fit(df.select(array_to_vector(dense(vector)).alias("x")))


class Mixture:
    """A Gaussian mixture: weights, means and covariances; history has the log likelihood of each round."""

    def __init__(self, weights, means, covariances, history=()):
        self.weights, self.means, self.covariances, self.history = np.array(weights, float), np.array(means, float), np.array(covariances, float), list(history)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for i, (m, c) in enumerate(zip(self.means, self.covariances, strict=True)):
            low = np.linalg.cholesky(c + 1e-9 * np.eye(len(m)))
            z = np.linalg.solve(low, (x - m).T)
            out[:, i] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares, log of the sum) with p_i = eps + w_i * density."""
        p = np.finfo(float).eps + self.weights * np.exp(self.log_density(x))
        total = p.sum(axis=1, keepdims=True)
        return p / total, np.log(total[:, 0])


def _batches(df: DataFrame, vector: str, fn, schema: str) -> DataFrame:
    """fn(matrix) -> rows, over Arrow batches of the vectors; empty batches are skipped."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame(fn(np.stack(pdf["_v"].to_numpy())))

    return df.select(dense(vector).alias("_v")).mapInPandas(run, schema)


def gaussian_mixture(df: DataFrame, vector: str, k: int, iterations: int = 30, tol: float = 0.01, seed: int = 1, sample: int = 5000) -> Mixture:
    """EM from a sample of at most `sample` rows; each batch sends its partial sums (k rows), which are added by a group-by."""
    rows = np.array([r[0] for r in df.select(dense(vector)).orderBy(F.xxhash64(dense(vector), F.lit(seed))).limit(sample).collect()])
    d = rows.shape[1]
    far = ((rows - rows[0]) ** 2).sum(axis=1)
    seeds = [rows[0]]
    while len(seeds) < k:  # each next seed is the sample row farthest from those before
        seeds.append(rows[far.argmax()])
        far = np.minimum(far, ((rows - seeds[-1]) ** 2).sum(axis=1))
    near = np.stack([((rows - s) ** 2).sum(axis=1) for s in seeds]).argmin(axis=0)
    parts = [rows[near == i] if (near == i).any() else rows for i in range(k)]
    m = Mixture(np.full(k, 1 / k), [p.mean(axis=0) for p in parts], [np.diag(p.var(axis=0) + 1e-6) for p in parts])
    before = -np.inf
    for _ in range(iterations):

        def sums(x, m=m):
            r, ll = m.responsibilities(x)
            flat = [np.concatenate([[r[:, i].sum(), ll.sum() / k], r[:, i] @ x, ((x * r[:, i : i + 1]).T @ x).ravel()]) for i in range(k)]
            return {"i": np.repeat(np.arange(k), len(flat[0])), "pos": np.tile(np.arange(len(flat[0])), k), "x": np.concatenate(flat)}

        got = _batches(df, vector, sums, "i int, pos int, x double").groupBy("i", "pos").agg(F.sum("x").alias("x")).collect()
        table = np.zeros((k, 2 + d + d * d))
        for r in got:
            table[r["i"], r["pos"]] = r["x"]
        w, now = table[:, 0], table[:, 1].sum()
        means = table[:, 2 : 2 + d] / w[:, None]
        cov = table[:, 2 + d :].reshape(k, d, d) / w[:, None, None] - means[:, :, None] * means[:, None, :]
        m = Mixture(w / w.sum(), means, cov + 1e-6 * np.eye(d), [*m.history, float(now)])
        if abs(now - before) <= tol:
            break
        before = now
    return m


def log_likelihood(df: DataFrame, vector: str, m: Mixture) -> float:
    return _batches(df, vector, lambda x: {"x": [m.responsibilities(x)[1].sum()]}, "x double").agg(F.sum("x")).first()[0] or 0.0


def max_posterior_sum(df: DataFrame, vector: str, m: Mixture) -> float:
    return _batches(df, vector, lambda x: {"x": [m.responsibilities(x)[0].max(axis=1).sum()]}, "x double").agg(F.sum("x")).first()[0] or 0.0
