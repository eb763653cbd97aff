"""Functions of array<double> columns. Everything is a Column: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(xs) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def axpy(alpha, x: Column, y: Column) -> Column:
    """alpha * x + y."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(x, y, lambda p, q: alpha * p + q)


def once(value: Column, body) -> Column:
    """body(value) with value computed once: an expression inside a lambda is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scal(alpha, x: Column) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.transform(x, lambda p: alpha * p)


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of them has no length."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d)


def sparse(indices: Column, values: Column) -> Column:
    """A sparse vector as a map from index to value."""
    return F.map_from_arrays(indices, values)


def cosine_shared(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors over the indices that both have; null where they share none."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    pick = lambda m: F.transform(both, lambda i: F.element_at(m, i))
    return cosine(pick(a), pick(b))


def distance(a: Column, b: Column, metric: str = "euclidean", raw: bool = False) -> Column:
    """'euclidean' is the squared distance; 'cosine' is 1 - cosine, or the bare cosine with raw."""
    if metric == "euclidean":
        return sqdist(a, b)
    if metric == "cosine":
        return cosine(a, b) if raw else F.lit(1.0) - cosine(a, b)
    raise ValueError(f"no such metric: {metric}")


def costs(v: Column, centers: list[list[float]], metric: str = "euclidean") -> Column:
    """Distances to each of a short list of centers, in its order. The centers are a literal of the plan."""
    return F.array(*[distance(v, literal(c), metric) for c in centers])


def nearest(cost: Column) -> Column:
    """Index from 0 of the least cost, the first of equal ones."""
    return (F.array_position(cost, F.array_min(cost)) - 1).cast("int")


def gap(cost: Column, relative: bool = False) -> Column:
    """Second least cost minus the least, or that over the least."""
    s = F.array_sort(cost)
    d = F.get(s, F.lit(1)) - F.get(s, F.lit(0))
    return d / F.get(s, F.lit(0)) if relative else d


def hamming(a: Column, b: Column) -> Column:
    """The share of unlike bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def bhattacharyya(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))


def polynomial(v: Column, power: int) -> Column:
    """Each value's powers 1 to `power`, one value after another."""
    return F.flatten(F.transform(v, lambda x: F.array(*[F.pow(x, F.lit(float(p))) for p in range(1, power + 1)])))


def resize(v: Column, size: int) -> Column:
    """The first `size` values, filled up with zeros."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def safe_double(text: Column) -> Column:
    return text.try_cast("double")


def two_digits(x: Column) -> Column:
    return F.format_string("%.2f", x)


def one_hot(label: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == label.cast("int"), 1.0).otherwise(0.0))


def argmax(v: Column) -> Column:
    """Index from 0 of the largest value, the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * sqdist(a, b))


def poly(a: Column, b: Column, gamma: float, coef0: float = 0.0, degree: float = 2.0) -> Column:
    return F.pow(gamma * dot(a, b) + coef0, F.lit(degree))


def tanh(a: Column, b: Column, gamma: float) -> Column:
    return F.tanh(gamma * dot(a, b))


def kernel(name: str, gamma: float = 1.0, **more):
    """A function of two vector Columns."""
    known = {"rbf": rbf, "poly": poly, "tanh": tanh}
    if name == "linear":
        return dot
    if name not in known:
        raise ValueError(f"no such kernel: {name}")
    return lambda a, b: known[name](a, b, gamma, **more)


def label_mod(label: Column, classes: int) -> Column:
    """label modulo classes, with 0 as the last class: labels from 1."""
    r = F.pmod(label, F.lit(classes))
    return F.when(r == 0, classes).otherwise(r)


def sign_label(label: Column) -> Column:
    """-1 below 0.9, else 1."""
    return F.when(label < 0.9, -1).otherwise(1)


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    logs = F.log(total(F.transform(v, lambda x: F.exp(x - top))))
    return F.transform(v, lambda x: x - top - logs)


def nll(logp: Column, target: Column, weights: list[float] | None = None, padding: int = -1) -> Column:
    """Loss of one sample: minus the log probability of its 1-based target, times the class weight; 0 for padding."""
    loss = -F.element_at(logp, F.when(target == padding, 1).otherwise(target.cast("int")))
    if weights is not None:
        loss = loss * F.element_at(literal(weights), F.when(target == padding, 1).otherwise(target.cast("int")))
    return F.when(target == padding, 0.0).otherwise(loss)


def cross_entropy(v: Column, target: Column, weights: list[float] | None = None) -> Column:
    return nll(log_softmax(v), target, weights)


def clean_loss(x: Column) -> Column:
    """NaN and infinities count as no loss."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clip(x: Column, limit: float = 30.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def standard_scale(df: DataFrame, vector: str, by: list[str] | None = None, population: bool = False, out: str | None = None) -> DataFrame:
    """vector with each position centred and divided by its deviation; a position without deviation becomes 0.

    The statistics are one small row a group (and a position), so the rows are never exploded by a window.
    """
    by = by or []
    dev = F.stddev_pop if population else F.stddev_samp
    cells = df.select(*by, F.posexplode(dense(vector)).alias("_i", "_x"))
    stats = cells.groupBy(*by, "_i").agg(F.avg("_x").alias("_m"), dev("_x").alias("_s"))
    stats = stats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_stats"))
    joined = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # without groups: one row
    scaled = F.zip_with(dense(vector), "_stats", lambda x, s: F.when(s["_s"] > 0, (x - s["_m"]) / s["_s"]).otherwise(0.0))
    return joined.withColumn(out or vector, scaled).drop("_stats")


def positions(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """One row for each position: keep, pos (from 0), x."""
    return df.select(*keep, F.posexplode(dense(vector)).alias("pos", "x"))


def mean_vector(v: Column) -> Column:
    """Aggregate: the mean of vectors of one length, summed whole before the shuffle (no row a position)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def spread_vector(v: Column) -> Column:
    """Aggregate: by position the sum of squared distances from the mean of vectors of one length, found without subtracting large sums."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    n = F.count(v)
    return F.transform(vector_to_array(Summarizer.variance(array_to_vector(v))), lambda x: x * (n - 1))
