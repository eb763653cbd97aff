"""Sign hashing: tables of concatenated sign bits, candidate look-up, and rounds that split large buckets."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.vectors import dense, dot, literal


def planes(size: int, count: int, seed: int = 1, gaussian: bool = False) -> list[list[float]]:
    """`count` vectors of `size`: normal variates, or only their signs."""
    x = np.random.default_rng(seed).standard_normal((count, size))
    return (x if gaussian else np.where(x > 0, 1.0, -1.0)).tolist()


def bit(v: Column, plane: list[float]) -> Column:
    """1 where the dot product is above 0, else 0."""
    return (dot(v, literal(plane)) > 0).cast("int")


def bits(v: Column, hyper: list[list[float]]) -> Column:
    return F.array(*[bit(v, p) for p in hyper])


def table_keys(v: Column, hyper: list[list[float]], tables: int) -> Column:
    """array of (table_id, hash_key): plane i belongs to table i mod tables, and its bits are joined in the order of i."""
    keys = [F.struct(F.lit(t).alias("table_id"), F.concat(*[bit(v, p).cast("string") for p in hyper[t::tables]]).alias("hash_key")) for t in range(tables)]
    return F.array(*keys)


def build(df: DataFrame, vector: str, key: str, hyper: list[list[float]], tables: int) -> DataFrame:
    """The index: table_id, hash_key, vec_id. A projection; it shuffles nothing."""
    return df.select(F.col(key).alias("vec_id"), F.explode(table_keys(dense(vector), hyper, tables)).alias("t")).select("t.table_id", "t.hash_key", "vec_id")


def candidates_of(index: DataFrame, ids: DataFrame, key: str = "vec_id", distinct: bool = False) -> DataFrame:
    """vec_id, candidate: others in a bucket with each asked id, once for each table they share unless distinct."""
    asked = index.join(ids.select(F.col(key).alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = asked.select("table_id", "hash_key", "vec_id")
    other = index.select("table_id", "hash_key", F.col("vec_id").alias("candidate"))
    out = asked.join(other, ["table_id", "hash_key"]).filter("vec_id <> candidate").select("vec_id", "candidate")
    return out.distinct() if distinct else out


def candidates_for(index: DataFrame, queries: DataFrame, vector: str, key: str, hyper: list[list[float]], tables: int) -> DataFrame:
    """query, candidate: ids in the buckets of vectors that needn't be in the index."""
    asked = build(queries, vector, key, hyper, tables).withColumnRenamed("vec_id", "query")
    return asked.join(index, ["table_id", "hash_key"]).select("query", F.col("vec_id").alias("candidate"))


def add(index: DataFrame, df: DataFrame, vector: str, key: str, hyper: list[list[float]], tables: int) -> DataFrame:
    return index.unionByName(build(df, vector, key, hyper, tables))


def remove(index: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return index.join(ids.select(F.col(key).alias("vec_id")), "vec_id", "left_anti")


def where(index: DataFrame, predicate: Column) -> DataFrame:
    return index.filter(predicate)


def same_bits(df: DataFrame, vector: str, key: str, hyper: list[list[float]], one) -> DataFrame:
    """The rows whose bits, of all planes joined, are those of the row with key `one`, which is among them."""
    said = F.concat(*[bit(dense(vector), p).cast("string") for p in hyper])
    asked = df.filter(F.col(key) == F.lit(one)).select(said.alias("_asked")).limit(1)  # one row
    return df.withColumn("_bits", said).join(F.broadcast(asked), F.col("_bits") == F.col("_asked")).drop("_bits", "_asked")


def multiput(store: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """store with the values of changes where it has them; keys that only changes has are added."""
    new = changes.select(key, F.col(value).alias("_new"), F.lit(True).alias("_has"))
    return store.join(new, key, "full").withColumn(value, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_has")


def save(index: DataFrame, hyper: list[list[float]], tables: int, path: str) -> None:
    """Three parts: the index, the planes, and one row of metadata."""
    spark = index.sparkSession
    index.write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(i, p) for i, p in enumerate(hyper)], "i int, plane array<double>").write.mode("overwrite").parquet(f"{path}/hasher")
    meta = json.dumps({"format": "granary.lsh", "version": 1, "tables": tables, "planes": len(hyper)})
    spark.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/metadata")


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[float]], int]:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    hyper = [r["plane"] for r in spark.read.parquet(f"{path}/hasher").orderBy("i").collect()]
    if meta.get("format") != "granary.lsh" or len(hyper) != meta["planes"]:
        raise ValueError(f"not an index: {path}")
    index, tables = spark.read.parquet(f"{path}/data"), meta["tables"]
    sizes = F.array(*[F.lit(len(hyper[t::tables])) for t in range(tables)])
    if not index.filter(F.length("hash_key") != F.get(sizes, F.col("table_id"))).isEmpty():
        raise ValueError("a key whose length is not its table's number of planes")
    return index, hyper, tables


def rounds(df: DataFrame, vector: str, key: str, per_bucket: int, hyper: list[list[list[float]]]) -> DataFrame:
    """key, bucket: buckets over `per_bucket` rows are hashed again in each round, with that round's planes.

    A bucket of n rows takes int(log2(n // per_bucket) + 1) of them. One join with the bucket sizes (a
    row each) a round; small buckets pass through.
    """
    out = df.select(key, dense(vector).alias("_v"), F.lit("").alias("bucket"))
    for r, planes_r in enumerate(hyper):
        sizes = out.groupBy("bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > per_bucket)
        sizes = sizes.withColumn("_bits", F.floor(F.log2(F.floor(F.col("_n") / per_bucket)) + 1).cast("int"))
        all_bits = F.array_join(F.transform(bits(F.col("_v"), planes_r), lambda b: b.cast("string")), "")
        joined = out.join(sizes, "bucket", "left")
        more = F.concat("bucket", F.lit(f"/{r}:"), F.substring(all_bits, F.lit(1), F.least(F.col("_bits"), F.lit(len(planes_r)))))
        out = joined.withColumn("bucket", F.when(F.col("_n").isNull(), F.col("bucket")).otherwise(more)).drop("_n", "_bits")
    return out.select(key, "bucket")


def bits_for(n: int, per_bucket: int) -> int:
    return int(math.log2(n // per_bucket) + 1) if n > per_bucket else 0
