"""Incremental sign hashing and selection over streams: the batch operators are projections, so they serve streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import lsh


def stream_index(vectors: DataFrame, vector: str, key: str, hyper: list[list[float]], tables: int) -> DataFrame:
    """table_id, hash_key, vec_id of a stream of vectors: stateless, so nothing is kept between batches."""
    return lsh.build(vectors, vector, key, hyper, tables)


def append_index(vectors: DataFrame, vector: str, key: str, hyper: list[list[float]], tables: int, path: str, checkpoint: str):
    """Starts a query that appends the index of a stream to Parquet, partitioned by table; returns it."""
    out = stream_index(vectors, vector, key, hyper, tables)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("table_id").outputMode("append").start()


def match_stream(queries: DataFrame, index: DataFrame, vector: str, key: str, hyper: list[list[float]], tables: int) -> DataFrame:
    """query, candidate for a stream of vectors against a stored index."""
    return lsh.candidates_for(index, queries, vector, key, hyper, tables)


def bucket_counts(index: DataFrame, ts: str, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Rows of each bucket and window, for an index stream that kept its event time; late rows count up to the watermark."""
    return index.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "table_id", "hash_key").agg(F.count("*").alias("n"))


def event_statistics(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Window, event_type, n, mean, most of an event stream: the numbers that selection thresholds are made of."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "most")
