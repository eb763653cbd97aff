"""Readers and writers of text: dense and sparse rows, ratings, centers, weights, and the label rules of the data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.vectors import label_mod

SPACE_OR_COMMA = r"\s+|,"


def _numbers(value: Column, separator: str) -> Column:
    parts = F.filter(F.split(F.trim(value), separator), lambda x: x != "")
    return F.transform(parts, lambda x: F.trim(x).cast("double"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0)


def dense_last(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """label, features from `f1,...,fn,label`."""
    v = _lines(spark, path).select(_numbers(F.col("value"), separator).alias("v"))
    return v.select(F.element_at("v", -1).alias("label"), F.slice("v", F.lit(1), F.size("v") - 1).alias("features"))


def dense_mixed(spark: SparkSession, path: str) -> DataFrame:
    """As dense_last, separated by white space or commas."""
    return dense_last(spark, path, SPACE_OR_COMMA)


def dense_first(spark: SparkSession, path: str, separator: str = SPACE_OR_COMMA) -> DataFrame:
    """label, features from `label f1 ... fn`."""
    v = _lines(spark, path).select(_numbers(F.col("value"), separator).alias("v"))
    return v.select(F.get("v", F.lit(0)).alias("label"), F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))).alias("features"))


def features_only(spark: SparkSession, path: str, separator: str = ",", drop_last: bool = False) -> DataFrame:
    """label (0.0), features; drop_last leaves out the last column."""
    v = _lines(spark, path).select(_numbers(F.col("value"), separator).alias("v"))
    return v.select(F.lit(0.0).alias("label"), (F.slice("v", F.lit(1), F.size("v") - 1) if drop_last else F.col("v")).alias("features"))


def libsvm(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """label, features (ML vectors) of a LIBSVM file; `size` saves a pass over the data."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", size) if size else reader).load(path)


def sparse_rows(lines: DataFrame, one_based: bool = True) -> DataFrame:
    """head, indices (from 0), values of `head i:v ...`. Blank lines and those that start with # are skipped; indices must rise."""
    text = lines.select(F.trim("value").alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    parts = text.select(F.split("value", r"\s+").alias("p")).select(F.get("p", F.lit(0)).alias("head"), F.slice("p", F.lit(2), F.size("p") - 1).alias("items"))
    cells = parts.select("head", F.transform("items", lambda x: F.split(x, ":")).alias("c"))
    out = cells.select("head", F.transform("c", lambda c: c[0].cast("int") - (1 if one_based else 0)).alias("indices"), F.transform("c", lambda c: c[1].cast("double")).alias("values"))
    n = F.size("indices")
    rises = F.forall(F.zip_with(F.slice("indices", F.lit(1), n - 1), F.slice("indices", F.lit(2), n - 1), lambda a, b: a < b), lambda x: x)
    checked = F.when((n < 2) | rises, F.col("indices")).otherwise(F.raise_error(F.lit("indices of a sparse row must rise")))
    return out.select("head", checked.alias("indices"), "values")


def drift(spark: SparkSession, path: str, constraint: bool = False) -> DataFrame:
    """label, indices, values of `label;constraint i:v ...`, with the constraint as label if asked for."""
    rows = sparse_rows(spark.read.text(path))
    return rows.select(F.get(F.split("head", ";"), F.lit(1 if constraint else 0)).cast("double").alias("label"), "indices", "values")


def wesad(spark: SparkSession, path: str) -> DataFrame:
    """As drift, labels counted from 1."""
    return drift(spark, path).withColumn("label", F.col("label") + 1)


def dimension(rows: DataFrame) -> int:
    """Largest index + 1."""
    top = rows.agg(F.max(F.array_max("indices"))).first()[0]
    return 0 if top is None else top + 1


def to_dense(rows: DataFrame, size: int) -> DataFrame:
    """features array<double> from indices and values."""
    full = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(F.map_from_arrays("indices", "values"), i), F.lit(0.0)))
    return rows.withColumn("features", full).drop("indices", "values")


def imagenet(spark: SparkSession, path: str) -> DataFrame:
    """label, features of `label f,f,f`."""
    p = _lines(spark, path).select(F.split(F.trim("value"), r"\s+", 2).alias("p"))
    return p.select(F.get("p", F.lit(0)).cast("double").alias("label"), _numbers(F.get("p", F.lit(1)), ",").alias("features"))


def tiny_images(spark: SparkSession, path: str, classes: int | None = 10) -> DataFrame:
    """label, features of `label,f,f,...`: labels modulo `classes`, 0 as the last; raw without."""
    rows = dense_first(spark, path, ",")
    return rows.withColumn("label", label_mod(F.col("label"), classes).cast("double")) if classes else rows


def tiny_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(training, validation) of xtrain_set.csv and xtest_set.csv, labels as they are."""
    return tiny_images(spark, f"{folder}/xtrain_set.csv", None), tiny_images(spark, f"{folder}/xtest_set.csv", None)


def tiny_scaled(spark: SparkSession, train: str, val: str, classes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, validation), z-scored with the training rows' means and deviations; `classes` cuts training labels only."""
    a, b = dense_first(spark, train, ","), dense_first(spark, val, ",")
    stats = a.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    stats = F.broadcast(stats.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("_stats")))  # one row, a value a dimension

    def scaled(df):
        z = F.zip_with("features", "_stats", lambda x, s: F.when(s["s"] > 0, (x - s["m"]) / s["s"]).otherwise(0.0))
        return df.crossJoin(stats).select("label", z.alias("features"))

    a, b = scaled(a), scaled(b)
    return (a.withColumn("label", F.pmod("label", F.lit(float(classes)))) if classes else a), b


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """user, item, rating of `user::item::rating`."""
    p = _lines(spark, path).select(F.split("value", "::").alias("p"))
    return p.select(F.get("p", F.lit(0)).cast("int").alias("user"), F.get("p", F.lit(1)).cast("int").alias("item"), F.get("p", F.lit(2)).cast("double").alias("rating"))


def user_vectors(rows: DataFrame, user: str = "user", item: str = "item", rating: str = "rating") -> DataFrame:
    """user, items, ratings: a sparse vector a user; of repeated items the largest rating stays. Rows are shuffled once, by user."""
    one = rows.select(user, item, rating).repartition(user).groupBy(user, item).agg(F.max(rating).alias(rating))
    pairs = one.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(item, rating))).alias("p"))
    return pairs.select(user, F.transform("p", lambda x: x[item]).alias("items"), F.transform("p", lambda x: x[rating]).alias("ratings"))


def centers(spark: SparkSession, path: str, k: int, sparse_size: int | None = None, one_based: bool = False, drop_last: bool = True) -> list[list[float]]:
    """The first k lines as centers: dense (without the last column), or `label i:v ...`."""
    lines = spark.read.text(path).limit(k)
    if sparse_size:
        return [r["features"] for r in to_dense(sparse_rows(lines, one_based), sparse_size).collect()]
    v = lines.select(_numbers(F.col("value"), SPACE_OR_COMMA).alias("v"))
    return [r["v"][:-1] if drop_last else r["v"] for r in v.collect()]


def read_weights(spark: SparkSession, path: str) -> list[float]:
    return _lines(spark, path).select(_numbers(F.col("value"), ",").alias("v")).first()["v"]


def write_weights(spark: SparkSession, weights, path: str) -> None:
    write_text(spark.createDataFrame([(",".join(repr(float(w)) for w in weights),)], "value string"), path)


def write_text(df: DataFrame, path: str, single: bool = False) -> None:
    """A text column as lines; `single` puts all into one file, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").text(path)


def copy_text(spark: SparkSession, source: str, path: str) -> None:
    write_text(spark.read.text(source), path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """head, members of a padded aggregate dump."""
    parse = lambda s: F.struct(F.get(F.split(s, ";"), F.lit(0)).cast("double").alias("label"), _numbers(F.get(F.split(s, ";"), F.lit(1)), ",").alias("features"))
    rows = _lines(spark, path).select(F.transform(F.split("value", r"\|"), parse).alias("r"))
    return rows.select(F.get("r", F.lit(0)).alias("head"), F.slice("r", F.lit(2), F.size("r") - 1).alias("members"))


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a folder on whatever file system it is; False if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_results(spark: SparkSession, rows: list[tuple], columns: str, path: str) -> None:
    """Small result tables (ratio, accuracy, time) as CSV."""
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right in a folder, on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().getName() for f in found if f.isFile())
