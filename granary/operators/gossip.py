"""Decentralised training, simulated: one state row an edge, exchanges as joins, the driver loop as the barrier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class GossipConfig:
    edges: int = 4
    epochs: int = 10
    batch: int = 128
    skip_prob: float = 0.05
    critical: float | None = None
    seed: int = 1
    step: float = 0.1


@dataclass
class RemovalConfig:
    strategy: str = "mean"
    fraction: float = 0.5
    limit: float = 1.0
    epoch: bool = False


def initial(spark: SparkSession, edges: int, weights: list[float]) -> DataFrame:
    """edge, score, weights: every edge starts with 1/n and the same weights."""
    return spark.createDataFrame([(i, 1.0 / edges, [float(x) for x in weights]) for i in range(1, edges + 1)], "edge int, score double, weights array<double>")


def members(state: DataFrame) -> int:
    return state.select("edge").distinct().count()


def leave(state: DataFrame, edges: DataFrame) -> DataFrame:
    return state.join(edges.select("edge"), "edge", "left_anti")


def ring_peer(edge: Column, iteration: int, n: int) -> Column:
    """The partner of 1..n at an iteration: (edge + 2^iteration) mod n + 1."""
    return (F.pmod(edge + F.lit(pow(2, iteration, n)), F.lit(n)) + 1).cast("int")


def random_peers(n: int, skip_prob: float, seed: int) -> dict[int, int]:
    """Sender -> receiver, never itself; a sender skips with skip_prob."""
    rng = np.random.default_rng(seed)
    return {i: int(rng.choice([j for j in range(1, n + 1) if j != i])) for i in range(1, n + 1) if n > 1 and rng.random() >= skip_prob}


def merge_scored(state: DataFrame, messages: DataFrame) -> DataFrame:
    """state after messages (src, dest): a sender halves its score and sends that half with its weights; a receiver averages by score.

    The order of messages doesn't matter: w = sum(s x) / sum(s) by position.
    """
    sent = messages.select(F.col("src").alias("edge"), "dest")
    out = state.join(sent, "edge", "left")
    own = out.select("edge", F.when(F.col("dest").isNull(), F.col("score")).otherwise(F.col("score") / 2).alias("score"), "weights")
    got = out.filter("dest is not null").select(F.col("dest").alias("edge"), (F.col("score") / 2).alias("score"), "weights")
    return weighted_mean(own.unionByName(got), "edge").select("edge", "score", "weights")


def weighted_mean(df: DataFrame, by: str, weight: str = "score", vector: str = "weights") -> DataFrame:
    """by, the sum of the weights, and the weighted mean of the vectors, summed whole before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = vector_to_array(Summarizer.mean(array_to_vector(vector), F.col(weight)))
    return df.groupBy(by).agg(F.sum(weight).alias(weight), mean.alias(vector))


def merge_pairs(state: DataFrame, peers: DataFrame, vector: str = "weights") -> DataFrame:
    """state where each edge of peers (edge, peer) takes the mean of its own vector and its peer's."""
    other = state.select(F.col("edge").alias("peer"), F.col(vector).alias("_o"))
    joined = state.join(peers.select("edge", "peer"), "edge", "left").join(other, "peer", "left")
    mean = F.zip_with(vector, "_o", lambda a, b: (a + b) / 2)
    return joined.withColumn(vector, F.when(F.col("_o").isNull(), F.col(vector)).otherwise(mean)).drop("peer", "_o")


def merge_models(models: DataFrame, vector: str = "weights") -> DataFrame:
    """pos, weight: the mean of k models by position."""
    return models.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("weight"))


def rotate(shards: DataFrame, n: int) -> DataFrame:
    """shard rows passed on to the next edge of 1..n."""
    return shards.withColumn("edge", (F.pmod(F.col("edge"), F.lit(n)) + 1).cast("int"))


def blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with block: sample shards of `size`; a last short block is kept."""
    from granary.operators.select import mini_batches

    return mini_batches(df, key, size).withColumnRenamed("batch", "block")


def time_range(times: DataFrame) -> DataFrame:
    return times.agg(F.min("time").alias("least"), F.max("time").alias("most"))


def _edge_frame(spark: SparkSession, pairs: dict[int, int], a: str, b: str) -> DataFrame:
    return spark.createDataFrame(sorted(pairs.items()) or [], f"{a} int, {b} int")


def _local(model, critical: float | None):
    """One edge's mean loss and gradient over its rows, or over the share of the largest losses."""
    import pandas as pd

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.array(pdf["weights"].iloc[0])
        x, y = np.stack(pdf["v"].to_numpy()), pdf["y"].to_numpy()
        if critical is not None:
            p = model.value(x, w)[np.arange(len(y)), y.astype(int)]
            keep = np.argsort(p, kind="stable")[: max(1, int(len(y) * critical))]
            x, y = x[keep], y[keep]
        loss, g = model.loss_gradient(x, y, w)
        return pd.DataFrame({"edge": [pdf["edge"].iloc[0]], "loss": [loss / len(y)], "grad": [(g / len(y)).tolist()]})

    return local


def train(df: DataFrame, model, vector: str, label: str, edge: str, cfg: GossipConfig, mode: str = "scored") -> tuple[DataFrame, list[float]]:
    """(state, mean losses): each epoch every edge steps on its own rows (label 0-based), then edges exchange.

    mode: scored (random receiver, sums by score), pairs (mean with a random peer), ring (gradients averaged
    with the partner of the iteration, then a step). With `critical` only that share of an edge's rows,
    those of the largest loss, is used after the first epoch.
    """
    from granary.functions.vectors import dense
    from granary.session import cut

    spark = df.sparkSession
    state, history = initial(spark, cfg.edges, model.start(cfg.seed).tolist()), []
    rows = df.select(F.col(edge).cast("int").alias("edge"), dense(vector).alias("v"), F.col(label).cast("double").alias("y"))
    for epoch in range(cfg.epochs):

        # An edge's rows are its own data set, which by the simulation's terms fits one machine.
        got = cut(rows.join(state.select("edge", "weights"), "edge").groupBy("edge").applyInPandas(_local(model, cfg.critical if epoch else None), "edge int, loss double, grad array<double>"))
        history.append(got.agg(F.avg("loss")).first()[0])
        if mode == "ring":
            peers = state.select("edge", ring_peer(F.col("edge"), epoch, cfg.edges).alias("peer"))
            got = merge_pairs(got, peers, "grad")
        stepped = state.join(got.select("edge", "grad"), "edge", "left")
        new = F.zip_with("weights", "grad", lambda w, g: w - cfg.step * g)
        state = stepped.withColumn("weights", F.when(F.col("grad").isNull(), F.col("weights")).otherwise(new)).drop("grad")
        if mode != "ring":
            pairs = random_peers(cfg.edges, cfg.skip_prob, cfg.seed * 1000 + epoch)
            if mode == "scored":
                state = merge_scored(state, _edge_frame(spark, pairs, "src", "dest"))
            else:
                state = merge_pairs(state, _edge_frame(spark, pairs, "edge", "peer"))
        state = cut(state.select("edge", "score", "weights"))
    return state, history


def round_state(marks: DataFrame, edges: int) -> DataFrame:
    """round, saved, read, phase of a table of marks (round, edge, what: 'saved' or 'read').

    A round is open until every edge has saved, saved until every edge has read, then done. A mark
    that is repeated counts once; edges of a null number don't count.
    """
    n = lambda what: F.count_distinct(F.when(F.col("what") == what, F.col("edge")))
    got = marks.groupBy("round").agg(n("saved").alias("saved"), n("read").alias("read"))
    phase = F.when(F.col("saved") < edges, "open").when(F.col("read") < edges, "saved").otherwise("done")
    return got.select("round", "saved", "read", phase.alias("phase"))


def reset_round(marks: DataFrame, number: int) -> DataFrame:
    return marks.filter(F.col("round") != number)


def push(messages: DataFrame, more: DataFrame) -> DataFrame:
    """The table of messages (dest, iteration, seq, body) with some more."""
    return messages.unionByName(more)


def pop(messages: DataFrame, upto: int) -> DataFrame:
    """The first message that each destination still has up to an iteration: the least iteration, then seq."""
    first = messages.filter(F.col("iteration") <= upto).groupBy("dest").agg(F.min(F.struct("iteration", "seq", "body")).alias("m"))
    return first.select("dest", "m.*")


def without_stragglers(times: DataFrame, drop: int, time: str = "time") -> DataFrame:
    """The tasks that are faster than the `drop`-th slowest one, whose time is the threshold; all of them for 0.

    `drop` is a number of tasks of one iteration, a parameter of the method.
    """
    if drop <= 0:
        return times
    slow = times.select(F.col(time).alias("_t")).orderBy(F.desc("_t")).limit(drop).agg(F.min("_t").alias("_limit"))
    return times.join(F.broadcast(slow), F.col(time) < F.col("_limit")).drop("_limit")  # one row
