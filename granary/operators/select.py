"""Selection: top fractions, keep-or-drop strategies by loss, samplers, and density sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.vectors import argmax, dense, literal
from granary.operators.ranks import ranked, small


def top_k(df: DataFrame, score: Column, key: str, k: int) -> DataFrame:
    """The k rows of the largest score, then key: each task sorts its own rows and sends k."""
    return df.orderBy(score.desc(), F.col(key).desc()).limit(k)


def top_fraction(df: DataFrame, score: Column, key: str, ratio: float, by: list[str] | None = None, least: int = 0) -> DataFrame:
    """The int(n * ratio) rows of the largest score in each group `by` (at least `least`), the smaller key first among equals.

    The fraction is of an explicit group, never of a physical partition. Without `by` it is of all rows.
    """
    if not by:
        n = df.count()
        return df.orderBy(score.desc(), F.col(key)).limit(max(least, int(n * ratio)))
    out = ranked(df, by, [score.desc(), F.col(key)])
    return out.filter(F.col("_r") <= F.greatest(F.floor(F.col("_n") * ratio), F.lit(least))).drop("_r", "_n")


def divisible(sizes: DataFrame, size: str, key: str, k: int) -> DataFrame:
    """The k largest clusters."""
    return sizes.orderBy(F.desc(size), key).limit(k)


def label_set(text: str) -> list[int]:
    """'1-3,5' -> [1, 2, 3, 5]."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        out |= set(range(int(low), int(high or low) + 1))
    return sorted(out)


def with_labels(df: DataFrame, label: str, labels: str | list[int]) -> DataFrame:
    return df.filter(F.round(label).cast("int").isin(label_set(labels) if isinstance(labels, str) else labels))


def expand(aggregates: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """The original rows of the chosen aggregates."""
    return members.join(aggregates.select(*by).distinct(), by, "left_semi")


def critical(aggregates: DataFrame, loss: str, key: str, fraction: float, by: list[str]) -> DataFrame:
    """The int(n * fraction) aggregates of the largest loss in each group: those whose originals are used this epoch."""
    return top_fraction(aggregates, F.col(loss), key, fraction, by)


def time_fraction(own: float, least: float, fixed: float | None = None) -> float:
    return fixed if fixed is not None else least / own


def fixed_ratio(df: DataFrame, loss: str, key: str, fraction: float, by: list[str]) -> DataFrame:
    """Drops the int(n * fraction) rows of the smallest loss."""
    return ranked(df, by, [F.col(loss), F.col(key)]).filter(F.col("_r") > F.floor(F.col("_n") * fraction)).drop("_r", "_n")


def cumulative(df: DataFrame, loss: str, key: str, fraction: float, by: list[str], limit: float = 1.0) -> DataFrame:
    """In ascending order drops rows while the sum of the losses before them is below mean * n * fraction and the dropped share below `limit`.

    Losses must not be negative: then the dropped rows are a prefix of the order.
    """
    rows = with_statistics(ranked(df, by, [F.col(loss), F.col(key)], running=loss), by, _mean=F.avg(loss))
    drop = (F.col("_before") < F.col("_mean") * F.col("_n") * fraction) & ((F.col("_r") - 1) / F.col("_n") < limit)
    return rows.filter(~F.coalesce(drop, F.lit(False))).drop("_r", "_n", "_before", "_mean")


def mean_threshold(df: DataFrame, loss: str, key: str, fraction: float, by: list[str], limit: float = 1.0, epoch: bool = False) -> DataFrame:
    """Drops rows below mean * fraction (the mean where that reaches the maximum; 0.95 * maximum in epoch mode) while the dropped share is below `limit`."""
    rows = with_statistics(ranked(df, by, [F.col(loss), F.col(key)]), by, _mean=F.avg(loss), _top=F.max(loss))
    mean, top = F.col("_mean"), F.col("_top")
    threshold = top * 0.95 if epoch else F.when(mean * fraction >= top, mean).otherwise(mean * fraction)
    drop = (F.col(loss) < threshold) & ((F.col("_r") - 1) / F.col("_n") < limit)
    return rows.filter(~F.coalesce(drop, F.lit(False))).drop("_r", "_n", "_mean", "_top")


def with_statistics(df: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """df with aggregates of its groups: by a window for a small table, else joined back, so that no group comes together."""
    if small(df):
        return df.withColumns({k: v.over(Window.partitionBy(*by)) for k, v in columns.items()})
    names = {c: f"_by_{i}" for i, c in enumerate(by)}
    stats = df.groupBy(*(F.col(c).alias(n) for c, n in names.items())).agg(*(v.alias(k) for k, v in columns.items()))
    same = F.lit(True)
    for c, n in names.items():
        same &= F.col(c).eqNullSafe(F.col(n))
    return df.join(stats, same).drop(*names.values())


def importance(df: DataFrame, loss: str, key: str, fraction: float, by: list[str], seed: int = 1) -> DataFrame:
    """int(n * fraction + 0.98) rows of each group, drawn without replacement by their loss."""
    out = ranked(df.withColumn("_w", weighted_key(F.col(loss), seed)), by, [F.col("_w"), F.col(key)])
    return out.filter(F.col("_r") <= F.floor(F.col("_n") * fraction + 0.98)).drop("_r", "_n", "_w")


def weighted_key(weight: Column, seed: int = 1, favour_small: bool = False) -> Column:
    """Exponential keys -ln(u) / weight. The smallest win; with favour_small the largest do, so light rows are favoured."""
    k = -F.log(F.greatest(F.rand(seed), F.lit(1e-300))) / F.greatest(weight, F.lit(1e-300))
    return -k if favour_small else k


def weighted_sample(df: DataFrame, weight: str, size: int, seed: int = 1, favour_small: bool = False) -> DataFrame:
    """`size` rows without replacement; rows of no weight come last."""
    return df.orderBy(F.col(weight) <= 0, weighted_key(F.col(weight), seed, favour_small)).limit(size)


def uniform_sample(df: DataFrame, size: int, seed: int = 1) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(size)


def uniform_with_replacement(df: DataFrame, key: str, size: int, seed: int = 1) -> DataFrame:
    """`size` draws, each row as often as it was drawn: counts come from a multinomial by chance of each draw's index."""
    ranked, n = dense_ids(df, key, "_i"), df.count()
    draws = df.sparkSession.range(size).select(F.floor(F.rand(seed) * n).cast("long").alias("_i"))
    return draws.join(ranked, "_i").drop("_i")


def bernoulli(df: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    return df.sample(False, fraction, seed)


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """df with fold 0..k-1 by the hash of the key: the same at every run and size."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int"))


def dense_ids(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """df with ids 0..n-1 in the order of the key, from a range partition and its counts: no global window."""
    parts = df.repartitionByRange(key).sortWithinPartitions(key)
    parts = parts.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    from granary.session import cut

    parts = cut(parts)
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("_p", "_first", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_start"))
    return parts.join(F.broadcast(starts), "_p").withColumn(out, F.col("_m") - F.col("_first") + F.col("_start")).drop("_p", "_m", "_first", "_start")


def density(df: DataFrame, vector: str, centers: list[list[float]], power: float = 1.0) -> DataFrame:
    """df with density: an Epanechnikov product kernel over the given sample rows, to the power.

    The sample is a bounded literal (its size is a parameter of the method).
    """
    s, d = len(centers), len(centers[0])
    h = np.sqrt(5.0) * s ** (-1.0 / (d + 4))
    c = (0.75**d) / h**d

    def term(center):
        z = F.zip_with(dense(vector), literal(center), lambda x, y: (y - x) / h)
        inside = F.forall(z, lambda t: F.abs(t) < 1)
        return F.when(inside, F.aggregate(z, F.lit(1.0), lambda a, t: a * (1 - t * t))).otherwise(0.0)

    total = F.lit(0.0)
    for center in centers:
        total = total + term(center)
    return df.withColumn("density", F.pow(total * (c / s), F.lit(power)))


def density_sample(df: DataFrame, key: str, ratio: float, by: list[str] | None = None, ordered: bool = False, seed: int = 1) -> DataFrame:
    """Rows kept with probability ratio * n * f / sum(f), or (ordered) the top fraction by f."""
    if ordered:
        return top_fraction(df, F.col("density"), key, ratio, by)
    sums = df.agg(F.sum("density").alias("_s"), F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(sums)).filter(F.col("density") * ratio * F.col("_n") / F.col("_s") >= F.rand(seed)).drop("_s", "_n")  # one row


def category_partition(df: DataFrame, label: str, categories: int) -> DataFrame:
    """df with category = label mod categories, rows of one category in one partition."""
    return df.withColumn("category", F.pmod(F.col(label).cast("int"), F.lit(categories))).repartition(categories, "category")


def lower_median(x: str) -> Column:
    """Aggregate: the element at (n - 1) / 2 of the sorted values. It holds a count for each distinct value."""
    return F.expr(f"percentile_disc(0.5) within group (order by {x})")


def order_statistic(x: Column, q: float) -> Column:
    """Aggregate: the element at int((n - 1) * q) of the sorted values of a group (a group's values meet in one task: use on reports, not rows)."""
    xs = F.array_sort(F.collect_list(x))
    return F.get(xs, F.floor((F.size(xs) - 1) * q).cast("int"))


def mini_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with batch: floor of the row's place by the key over the batch size."""
    return dense_ids(df, key, "_i").withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def stack(df: DataFrame, vector: str, key: str, size: int) -> DataFrame:
    """block, keys, matrix: rows in the order of the key, `size` to a block; a last short block is kept."""
    rows = mini_batches(df.select(key, dense(vector).alias("_v")), key, size)
    got = rows.groupBy(F.col("batch").alias("block")).agg(F.array_sort(F.collect_list(F.struct(key, "_v"))).alias("_p"))
    return got.select("block", F.transform("_p", lambda p: p[key]).alias("keys"), F.transform("_p", lambda p: p["_v"]).alias("matrix"))


def unstack(blocks: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the rows of stack's blocks."""
    return blocks.select(F.explode(F.arrays_zip("keys", "matrix")).alias("_p")).select(F.col("_p.keys").alias(key), F.col("_p.matrix").alias(vector))


def class_error(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """mse: the mean squared difference of the index of the largest prediction (from 1) and the target."""
    d = argmax(dense(prediction)) + 1 - F.col(target)
    return df.agg(F.avg(d * d).alias("mse"))
