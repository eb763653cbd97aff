"""More queries over the generated tables: sources read back, samplers, reductions and trainers.

Where an operator is random or iterative, the query gives what must hold of its result whatever the
draw, computed from that result, and the SQL gives the same from the tables alone.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from granary.functions import images
from granary.functions import vectors as V
from granary.operators import buckets, cluster, gossip, lsh, neural, pairs, regress, select, svm
from granary.plans.queries import CENTERS, E, NET, NET_W, PLANES, PROBE, TABLES, _dot, _emb, _events, _l, _lloyd, _r, _sq, _zips, query
from granary.session import cut, load, shared_dir
from granary.sources import binary, text


def _row(spark, **values):
    """One row of what was found on the driver."""
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in values.values())], list(values))


# --- sources: written, read back, and held against the table ---------------------


def _through(spark, df, read):
    """read(path) of df (a text column) written as text to the shared folder, which is emptied again."""
    path = f"{shared_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    text.write_text(df, path)
    got = cut(read(path))
    text.delete(spark, path)
    return got


def _cells(df):
    """label, first, total, n of label and features, which SQL can say of the table."""
    return df.select(F.col("label").cast("double").alias("label"), F.get("features", F.lit(0)).alias("first"), _r(V.total(F.col("features"))).alias("total"), F.size("features").alias("n"))


def _line(*parts, by=","):
    return F.concat_ws(by, *parts).alias("value")


def _texts(v="v"):
    return F.col(v).cast("array<string>")


_DENSE = f"SELECT label::DOUBLE AS label, v[1] AS first, round(list_sum(v), 6) AS total, len(v)::INT AS n FROM {E}"


@query(_DENSE)
def source_dense_last(spark, d):
    lines = _emb(spark, d).select(_line(_texts(), F.col("label").cast("string")))
    return _cells(_through(spark, lines, lambda p: text.dense_last(spark, p)))


@query(_DENSE)
def source_dense_mixed(spark, d):
    lines = _emb(spark, d).select(F.concat(F.array_join(_texts(), " "), F.lit(","), F.col("label").cast("string")).alias("value"))
    return _cells(_through(spark, lines, lambda p: text.dense_mixed(spark, p)))


@query(_DENSE)
def source_dense_first(spark, d):
    lines = _emb(spark, d).select(_line(F.col("label").cast("string"), _texts(), by=" "))
    return _cells(_through(spark, lines, lambda p: text.dense_first(spark, p)))


@query(_DENSE.replace("label::DOUBLE", "0.0::DOUBLE"))
def source_features_only(spark, d):
    return _cells(_through(spark, _emb(spark, d).select(_line(_texts())), lambda p: text.features_only(spark, p)))


@query(_DENSE)
def source_imagenet(spark, d):
    lines = _emb(spark, d).select(F.concat(F.col("label").cast("string"), F.lit(" "), F.array_join(_texts(), ",")).alias("value"))
    return _cells(_through(spark, lines, lambda p: text.imagenet(spark, p)))


@query(_DENSE.replace("label::DOUBLE", "(CASE WHEN label % 10 = 0 THEN 10 ELSE label % 10 END)::DOUBLE"))
def source_tiny_images(spark, d):
    lines = _emb(spark, d).select(_line(F.col("label").cast("string"), _texts()))
    return _cells(_through(spark, lines, lambda p: text.tiny_images(spark, p)))


_SPARSE = f"SELECT label::DOUBLE AS label, list_sum(i)::BIGINT AS places, round(list_sum(list_transform(i, lambda k: v[k + 1])), 6) AS total, len(i)::INT AS n FROM (SELECT label, v, list_filter(range(0, len(v)), lambda k: k % 5 = label % 5) AS i FROM {E})"


def _sparse_lines(spark, d, head):
    some = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["i"] % 5 == F.col("label") % 5)
    items = F.transform(some, lambda s: F.concat_ws(":", (s["i"] + 1).cast("string"), s["x"].cast("string")))
    return _emb(spark, d).select(F.concat_ws(" ", head, items).alias("value"))


def _sparse_cells(df):
    return df.select("label", F.aggregate("indices", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"), _r(V.total(F.col("values"))).alias("total"), F.size("indices").alias("n"))


@query(_SPARSE)
def source_drift(spark, d):
    lines = _sparse_lines(spark, d, F.concat_ws(";", F.col("label").cast("string"), F.lit("7")))
    return _sparse_cells(_through(spark, lines, lambda p: text.drift(spark, p)))


@query(_SPARSE.replace("label::DOUBLE", "(label + 1)::DOUBLE"))
def source_wesad(spark, d):
    lines = _sparse_lines(spark, d, F.concat_ws(";", F.col("label").cast("string"), F.lit("7")))
    return _sparse_cells(_through(spark, lines, lambda p: text.wesad(spark, p)))


@query(f"SELECT label::DOUBLE AS label, 64 AS n, round(list_sum(list_transform(i, lambda k: v[k + 1])), 6) AS total FROM (SELECT label, v, list_filter(range(0, len(v)), lambda k: k % 5 = label % 5) AS i FROM {E})")
def source_libsvm(spark, d):
    from pyspark.ml.functions import vector_to_array

    lines = _sparse_lines(spark, d, F.col("label").cast("string"))
    got = _through(spark, lines, lambda p: text.libsvm(spark, p, 64).select("label", vector_to_array("features").alias("v")))
    return got.select("label", F.size("v").alias("n"), _r(V.total(F.col("v"))).alias("total"))


@query("SELECT o_custkey::INT AS user, count(*) AS n, max(o_orderkey % 1000)::INT AS item, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def source_ratings(spark, d):
    lines = load(spark, d, "orders").select(F.concat_ws("::", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 1000).cast("string"), F.col("o_totalprice").cast("string")).alias("value"))
    got = _through(spark, lines, lambda p: text.ratings(spark, p))
    return got.groupBy("user").agg(F.count("*").alias("n"), F.max("item").alias("item"), _r(F.sum("rating"), 2).alias("total"))


@query(" UNION ALL ".join(f"SELECT {i} AS center, {len(c)} AS n, round(list_sum({_l(c)}), 6) AS total" for i, c in enumerate(CENTERS[:3])))
def source_centers(spark, d):
    """The first lines of a file, one partition of it, as centers."""
    lines = spark.createDataFrame([(",".join(map(repr, [*c, 9.0])),) for c in CENTERS], "value string").coalesce(1)
    path = f"{shared_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    text.write_text(lines, path)
    got = text.centers(spark, path, 3)
    text.delete(spark, path)
    return spark.createDataFrame([(i, len(c), round(sum(c), 6)) for i, c in enumerate(got)], "center int, n int, total double")


@query(f"SELECT {NET.size} AS n, round(list_sum({_l(NET_W)}), 6) AS total")
def source_weights(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    text.write_weights(spark, NET_W, path)
    got = text.read_weights(spark, path)
    text.delete(spark, path)
    return spark.createDataFrame([(len(got), round(sum(got), 6))], "n int, total double")


@query("SELECT label::DOUBLE AS label, max(count(*)) OVER ()::INT AS members, min(vec_id)::DOUBLE AS least FROM embeddings GROUP BY label")
def source_dump(spark, d):
    """Aggregates as padded lines, read again."""
    member = F.struct(F.col("label").cast("double").alias("label"), F.array(F.col("vec_id").cast("double")).alias("features"))
    rows = load(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(member)).alias("members")).withColumn("head", F.get("members", F.lit(0)))
    got = _through(spark, buckets.padded_dump(rows, "head", "members"), lambda p: text.read_dump(spark, p))
    return got.select(F.col("head.label").alias("label"), F.size("members").alias("members"), F.array_min(F.transform("members", lambda m: m["features"][0])).alias("least"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def source_copy(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/copy-{uuid.uuid4().hex}"

    def read(p):
        text.copy_text(spark, p, path)
        return spark.read.text(path)

    got = _through(spark, load(spark, d, "events").select(F.col("event_type").alias("value")), read)
    text.delete(spark, path)
    return got.groupBy("value").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) * {TABLES} AS n, {len(PLANES)} AS planes, {TABLES} AS tables, true AS same FROM embeddings")
def index_saved(spark, d):
    """An index saved and restored: all of its rows, planes and tables."""
    path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index = lsh.build(_emb(spark, d), "v", "vec_id", PLANES, TABLES)
    lsh.save(index, PLANES, TABLES, path)
    back, hyper, tables = lsh.restore(spark, path)
    same = back.exceptAll(index.select(back.columns)).isEmpty() and hyper == PLANES
    out = _row(spark, n=back.count(), planes=len(hyper), tables=tables, same=same)
    text.delete(spark, path)
    return out.select("n", F.col("planes").cast("int").alias("planes"), F.col("tables").cast("int").alias("tables"), "same")


# --- pairs, stacks, rounds -----------------------------------------------------------


@query(f"SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(sqrt({_sq('x.v', 'y.v')}), 6) AS value FROM {E} x JOIN {E} y ON x.label = y.label AND x.vec_id <= y.vec_id")
def distance_matrix(spark, d):
    return pairs.matrix(_emb(spark, d), "v", "vec_id", ["label"]).withColumn("value", _r(F.col("value")))


@query(f"SELECT x.label, round(sum(pow(0.5 * {_dot('x.v', 'y.v')}, 2)), 4) AS total FROM {E} x JOIN {E} y ON x.label = y.label AND x.vec_id <= y.vec_id GROUP BY ALL")
def kernel_matrix(spark, d):
    return pairs.matrix(_emb(spark, d), "v", "vec_id", ["label"], "poly", 0.5).groupBy("label").agg(_r(F.sum("value"), 4).alias("total"))


@query("SELECT label, count(*) * (count(*) + 1) // 2 AS n, min(vec_id) AS least, max(vec_id) AS most FROM embeddings GROUP BY 1")
def pair_index(spark, d):
    got = pairs.pair_index(load(spark, d, "embeddings"), "vec_id", ["label"])
    return got.groupBy("label").agg(F.count("*").alias("n"), F.min("a").alias("least"), F.max("b").alias("most"))


@query(f"SELECT block, count(*) AS n, min(vec_id) AS least, round(sum(v[1]), 6) AS total FROM (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 60 AS block, * FROM {E}) GROUP BY 1")
def stacked_rows(spark, d):
    got = select.stack(_emb(spark, d), "v", "vec_id", 60)
    return got.select("block", F.size("keys").cast("long").alias("n"), F.array_min("keys").alias("least"), _r(V.total(F.transform("matrix", lambda r: r[0]))).alias("total"))


@query(f"SELECT vec_id, round(list_sum(v), 6) AS total FROM {E}")
def unstacked_rows(spark, d):
    return select.unstack(select.stack(_emb(spark, d), "v", "vec_id", 60), "vec_id", "v").select("vec_id", _r(V.total(F.col("v"))).alias("total"))


@query(f"SELECT round(avg(pow(list_position(p, list_max(p)) - (label + 1), 2)), 6) AS mse FROM (SELECT label, v AS p FROM {E})")
def class_error(spark, d):
    rows = _emb(spark, d).select(F.col("v").alias("p"), (F.col("label") + 1).alias("t"))
    return select.class_error(rows, "p", "t").select(_r(F.col("mse")).alias("mse"))


@query("""SELECT round, saved, read, CASE WHEN saved < 4 THEN 'open' WHEN read < 4 THEN 'saved' ELSE 'done' END AS phase FROM (SELECT event_id // 16 AS round, count(DISTINCT user_id % 4) FILTER (event_type <> 'click') AS saved,
    count(DISTINCT user_id % 4) FILTER (event_type = 'click') AS read FROM events GROUP BY 1)""")
def round_states(spark, d):
    e = load(spark, d, "events")
    marks = e.select(F.floor(F.col("event_id") / 16).alias("round"), (F.col("user_id") % 4).alias("edge"), F.when(F.col("event_type") == "click", "read").otherwise("saved").alias("what"))
    return gossip.round_state(marks, 4)


@query("SELECT user_id % 20 AS dest, event_id % 5 AS iteration, event_id AS seq, event_type AS body FROM events WHERE event_id % 5 <= 3 QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id % 5, event_id) = 1")
def popped_messages(spark, d):
    e = load(spark, d, "events")
    mail = e.select((F.col("user_id") % 20).alias("dest"), (F.col("event_id") % 5).alias("iteration"), F.col("event_id").alias("seq"), F.col("event_type").alias("body"))
    return gossip.pop(gossip.push(mail.filter("seq % 2 = 0"), mail.filter("seq % 2 = 1")), 3)


@query("SELECT event_id, value FROM events WHERE value < (SELECT min(value) FROM (SELECT value FROM events ORDER BY value DESC LIMIT 25))")
def without_stragglers(spark, d):
    return gossip.without_stragglers(load(spark, d, "events").select("event_id", "value"), 25, "value")


# --- samplers ----------------------------------------------------------------------------


def _inside(sample, whole, key):
    """n, different, inside: rows of a sample, different keys, and whether all of them are in the table."""
    s = cut(sample.select(key))
    missing = s.join(whole.select(key), key, "left_anti").isEmpty()
    return s.agg(F.count("*").alias("n"), F.count_distinct(key).alias("different")).withColumn("inside", F.lit(missing))


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS different, true AS inside FROM events")
def uniform_sample(spark, d):
    e = load(spark, d, "events")
    return _inside(select.uniform_sample(e, 100, 3), e, "event_id")


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS different, true AS inside FROM events WHERE value > 0")
def weighted_sample(spark, d):
    """Rows of weight 0, of which there are as many, aren't drawn while others are left."""
    e = load(spark, d, "events").filter("value > 0")
    w = e.unionByName(e.withColumns({"event_id": -F.col("event_id") - 1, "value": F.lit(0.0)}))
    return _inside(select.weighted_sample(w, "value", 100, 3), e, "event_id")


@query("SELECT 2 * count(*) AS n, true AS inside, true AS repeats FROM events")
def draws_with_replacement(spark, d):
    """Twice as many draws as there are rows: some repeat."""
    e = load(spark, d, "events")
    got = _inside(select.uniform_with_replacement(e, "event_id", 2 * e.count(), 2), e, "event_id")
    return got.select("n", "inside", (F.col("different") < F.col("n")).alias("repeats"))


@query("SELECT true AS inside, true AS near_share, count(*) AS n FROM events")
def bernoulli_sample(spark, d):
    """The share of rows is the asked one within five standard deviations."""
    e = load(spark, d, "events")
    n = e.count()
    got = _inside(select.bernoulli(e, 0.3, 5), e, "event_id")
    return got.select("inside", (F.abs(F.col("n") - 0.3 * n) < 5 * (0.21 * n) ** 0.5).alias("near_share"), F.lit(n).cast("long").alias("n"))


@query("SELECT 5 AS folds, count(*) AS n, true AS near_even FROM events")
def cross_folds(spark, d):
    sizes = select.folds(load(spark, d, "events"), "event_id", 5).groupBy("fold").count()
    return sizes.agg(F.count("*").cast("int").alias("folds"), F.sum("count").alias("n"), (F.max("count") < F.sum("count") / 5 * 1.3).alias("near_even"))


@query("SELECT event_type, floor(count(*) * 0.2 + 0.98)::BIGINT AS n, true AS heavier FROM events GROUP BY 1")
def importance_sample(spark, d):
    """As many of each type as asked for, and of larger losses than the mean."""
    e = _events(spark, d)
    got = select.importance(e, "value", "event_id", 0.2, ["event_type"], 4).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return got.join(e.groupBy("event_type").agg(F.avg("value").alias("all")), "event_type").select("event_type", "n", (F.col("m") > F.col("all")).alias("heavier"))


# --- reductions ----------------------------------------------------------------------------


@query("SELECT count(*) AS n, 3 AS width, true AS uncorrelated, true AS falling FROM embeddings")
def principal_components(spark, d):
    """Components are uncorrelated, and each varies less than the one before."""
    f = buckets.pca_features(_emb(spark, d), "v", "vec_id", 3)
    x = [F.get("features", F.lit(i)) for i in range(3)]
    none = (F.abs(F.corr(x[0], x[1])) < 1e-6) & (F.abs(F.corr(x[0], x[2])) < 1e-6) & (F.abs(F.corr(x[1], x[2])) < 1e-6)
    return f.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), none.alias("uncorrelated"), ((F.variance(x[0]) >= F.variance(x[1])) & (F.variance(x[1]) >= F.variance(x[2]))).alias("falling"))


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {float(i == j)!r}::DOUBLE AS g" for i in range(3) for j in range(i, 3)))
def svd_projection(spark, d):
    """The columns of U have length 1 and are at right angles."""
    f = cut(buckets.svd_projection(_emb(spark, d), "v", "vec_id", 3))
    x = [F.get("features", F.lit(i)) for i in range(3)]
    got = f.agg(*(F.sum(x[i] * x[j]).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3))).first()
    return spark.createDataFrame([(i, j, abs(round(got[f"g{i}{j}"], 5))) for i in range(3) for j in range(i, 3)], "i int, j int, g double")


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS energy FROM {E}")
def singular_values(spark, d):
    """The squares of all singular values of a row's 8 x 8 matrix sum up to its squared length."""
    f = buckets.singular_values(_emb(spark, d), "v", "vec_id", 8, 8, 8)
    return f.select("vec_id", _r(V.total(F.transform("features", lambda s: s * s)), 5).alias("energy"))


@query(f"SELECT round(sqrt(avg(pow(label - greatest(least({_dot('v', _l([x * 20 for x in PROBE]))}, 3), -3), 2))), 6) AS rmse FROM {E}")
def rating_error(spark, d):
    p = buckets.predicted(F.col("v"), V.literal([x * 20 for x in PROBE]), 3.0)
    return _emb(spark, d).agg(_r(buckets.root_error(F.col("label"), p)).alias("rmse"))


@query("SELECT count(*) AS n, 2 AS width, 10 AS groups, true AS finite FROM embeddings")
def incremental_svd(spark, d):
    e = _emb(spark, d)
    f = buckets.svd_features(e, "v", "vec_id", 2, "label", 5, 4)
    ok = F.bool_and(F.forall("features", lambda x: ~F.isnan(x) & (F.abs(x) < 100)))
    return f.join(e.select("vec_id", "label"), "vec_id").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), F.count_distinct("label").cast("int").alias("groups"), ok.alias("finite"))


@query("SELECT label, true AS dense, true AS backtracking, true AS sparse FROM embeddings GROUP BY 1")
def incremental_svd_error(spark, d):
    """More rounds of the steps leave a smaller error, of the dense, the backtracking and the sparse form; a label's rows in a task."""
    import pandas as pd

    def errors(pdf):
        x = np.stack(pdf.sort_values("vec_id")["v"].to_numpy()) * 10
        some = [(np.arange(i % 2, x.shape[1], 2), r[i % 2 :: 2]) for i, r in enumerate(x)]
        known = (np.arange(x.shape[1]) + np.arange(len(x))[:, None]) % 2 == 0
        plain = [buckets.svd_error(x, *buckets.incremental_svd(x, 2, n)) for n in (1, 30)]
        back = [buckets.svd_error(x, *buckets.incremental_svd(x, 2, n, backtracking=True)) for n in (1, 30)]
        sparse = [float(((x - u @ m)[known] ** 2).mean()) for u, m in (buckets.sparse_incremental_svd(some, x.shape[1], 2, n) for n in (1, 30))]
        return pd.DataFrame({"label": pdf["label"][:1], "dense": [plain[1] < plain[0]], "backtracking": [back[1] < back[0]], "sparse": [sparse[1] < sparse[0]]})

    return _emb(spark, d).groupBy("label").applyInPandas(errors, "label int, dense boolean, backtracking boolean, sparse boolean")


@query("SELECT count(*) AS n, 6 AS width FROM embeddings")
def segmented_svd(spark, d):
    f = buckets.segmented_svd(_emb(spark, d), "v", "vec_id", 3, 2, rounds=2, ratio=4)
    return f.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"))


@query("SELECT label, count(*) AS n, true AS balanced FROM embeddings GROUP BY 1")
def aggregate_points(spark, d):
    """The default chain of reduction and median splits: every row once, and buckets that differ by one row at most."""
    out = buckets.aggregate_points(_emb(spark, d), "v", "vec_id", "label", 15, 10, "slice")
    sizes = out.groupBy("label", "bucket").agg(F.count("*").alias("c"))
    return sizes.groupBy("label").agg(F.sum("c").alias("n"), (F.max("c") - F.min("c") <= 1).alias("balanced"))


@query("SELECT label, count(*) AS n, true AS split FROM embeddings GROUP BY 1")
def clustered_labels(spark, d):
    """A clustering of each label's rows keeps every row, in as many clusters as asked for at most."""
    sizes = buckets.cluster_by(_emb(spark, d), "v", "vec_id", "label", 1).groupBy("label", "bucket").agg(F.count("*").alias("c"))
    return sizes.groupBy("label").agg(F.sum("c").alias("n"), (F.count("*") <= F.greatest(F.round(F.sum("c") / 10), F.lit(1))).alias("split"))


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER w <= count(*) OVER () // 2 THEN '/0' ELSE '/1' END AS bucket FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, count(*) OVER () AS n FROM embeddings) WINDOW w AS (ORDER BY x, vec_id)) GROUP BY 1")
def iterative_buckets(spark, d):
    """Buckets of the first feature alone, by the way that goes on while a bucket is too large."""
    out = buckets.hash_iterative(_emb(spark, d), [F.get("v", F.lit(0))], "vec_id", 10)
    return out.groupBy("bucket").agg(F.count("*").alias("n"))


# --- trainers -----------------------------------------------------------------------------------


def _centers(spark, got):
    return spark.createDataFrame([(i, p, round(x, 6)) for i, c in enumerate(got) for p, x in enumerate(c)], "cluster int, pos long, x double")


_EXACT = _lloyd() + " SELECT cluster, unnest(range(0, len(center))) AS pos, round(unnest(center), 6) AS x FROM c2"


@query(_EXACT)
def approximate_kmeans_exact(spark, d):
    """With all zips refreshed, the approximate form is Lloyd's."""
    rows, zips = _zips(spark, d)
    return _centers(spark, cluster.approximate_kmeans(rows, zips, "v", "vec_id", CENTERS, 2, 1.0, "label"))


@query(_EXACT)
def layered_kmeans_exact(spark, d):
    """With a budget of all rows, the layered form is Lloyd's."""
    rows, zips = _zips(spark, d)
    sizes = rows.groupBy("zip_id").agg(F.count("*").alias("size"))
    fine = zips.select("zip_id", F.col("label").alias("coarse_id"), "centroid").join(sizes, "zip_id")
    coarse = buckets.centroids(rows, "v", ["label"]).select(F.col("label").alias("coarse_id"), "centroid")
    return _centers(spark, cluster.layered_kmeans(rows.select("vec_id", "v", "zip_id"), coarse, fine, "v", "vec_id", CENTERS, 2, 10**12))


@query(_lloyd(3) + ", x AS (SELECT 0 AS iteration, count(*) AS changed FROM a0 JOIN a1 USING (vec_id) WHERE a0.cluster <> a1.cluster) SELECT * FROM x UNION ALL SELECT 1, count(*) FROM a1 JOIN a2 USING (vec_id) WHERE a1.cluster <> a2.cluster")
def kmeans_statistics(spark, d):
    _, counts = cluster.kmeans_with_statistics(_emb(spark, d), "v", CENTERS, 2)
    return spark.createDataFrame(list(enumerate(counts)), "iteration int, changed long")


@query("SELECT 6 AS leaves, count(*) AS n, true AS nested, true AS cheaper FROM embeddings")
def bisecting_tree(spark, d):
    """Leaves as asked for, which hold all rows; children make up their node; the tree costs less than its root."""
    e = _emb(spark, d)
    t = cluster.bisecting_kmeans(e, "v", 6, 3)
    nested = all(sum(t.nodes[c]["size"] for c in t.children(i)) == n["size"] for i, n in t.nodes.items() if t.children(i))
    got = _row(spark, leaves=len(t.leaves()), n=sum(t.nodes[i]["size"] for i in t.leaves()), nested=nested, cheaper=t.cost(e, "v") < t.nodes[1]["cost"])
    return got.withColumn("leaves", F.col("leaves").cast("int"))


@query("SELECT count(*) AS n, true AS settles, true AS whole, true AS sure FROM embeddings")
def gaussian_mixture(spark, d):
    """The likelihood rises, weights sum up to 1, and the best shares of the rows lie between n / k and n."""
    e = _emb(spark, d)
    m = cluster.gaussian_mixture(e, "v", 3, 5)
    n = e.count()
    rises = all(b >= a - 1e-6 * abs(a) for a, b in zip(m.history, m.history[1:], strict=False))
    return _row(spark, n=n, settles=rises, whole=bool(abs(m.weights.sum() - 1) < 1e-9), sure=bool(n / 3 <= cluster.max_posterior_sum(e, "v", m) <= n + 1e-6))


@query("SELECT true AS analytic, true AS falls")
def network_descent(spark, d):
    """The distributed gradient is the numeric one, and descent lowers the loss."""
    e = _emb(spark, d)
    net = regress.SigmoidNetwork(64, 2)
    w = np.array(regress.random_weights(net.size, 3))
    _, g = regress.loss_and_gradient(e, net, "v", "label", w)
    at = lambda x: regress.loss(e, net, "v", "label", x).first()["loss"]
    step = 1e-5
    numeric = np.array([(at(w + step * u) - at(w - step * u)) / (2 * step) for u in np.eye(len(w))[:3]])
    scale = float((g[:3] @ numeric) / (numeric @ numeric))  # the gradient may be of the sum or of its half
    _, history = regress.descend(e, net, "v", "label", w, 3)
    return _row(spark, analytic=bool(np.allclose(g[:3], scale * numeric, rtol=1e-3, atol=1e-3) and scale > 0), falls=history[-1] < history[0])


@query("SELECT count(*) AS n, true AS falls, true AS classes FROM embeddings")
def perceptron(spark, d):
    """Losses fall, and every row gets one of the classes."""
    e = _emb(spark, d)
    model = neural.Perceptron([64, 10])
    w, history = neural.fit(e, model, "v", "label", 15, neural.Update("adam", 0.1))
    said = neural.predict(e, model, "v", w).agg(F.count("*").alias("n"), F.bool_and(F.col("prediction").between(0, 9)).alias("classes")).first()
    return _row(spark, n=said["n"], falls=history[-1] < history[0], classes=said["classes"])


@query("SELECT true AS supports, true AS inside, true AS few")
def pack_machine(spark, d):
    """Support rows are rows, with positive weights, and at most those that were drawn."""
    e = _emb(spark, d).withColumn("y", F.when(F.col("label") < 5, -1.0).otherwise(1.0))
    s = cut(svm.PackSvm(0.01, 0.05).fit(e, "v", "y", "vec_id", 4, 40).support(spark))
    return _row(spark, supports=s.filter("alpha <= 0").isEmpty(), inside=s.join(e, F.col("sv_id") == F.col("vec_id"), "left_anti").isEmpty(), few=0 < s.count() <= 4 * 40)


@query("SELECT true AS falls, 4 AS edges, true AS whole_scores")
def gossip_training(spark, d):
    """Edges step on their own rows and exchange by score: losses fall, and scores still sum up to 1."""
    e = _emb(spark, d).withColumn("edge", F.pmod("vec_id", F.lit(4)) + 1)
    state, history = gossip.train(e, neural.Perceptron([64, 10]), "v", "label", "edge", gossip.GossipConfig(4, 3, step=0.5), "scored")
    got = state.agg(F.count("*").alias("edges"), F.sum("score").alias("s")).first()
    return _row(spark, falls=history[-1] < history[0], edges=got["edges"], whole_scores=abs(got["s"] - 1) < 1e-9).withColumn("edges", F.col("edges").cast("int"))


# --- functions --------------------------------------------------------------------------------


_HALF = "list_transform(v, lambda x: x * x / list_sum(list_transform(v, lambda y: y * y)))"


@query(f"""SELECT vec_id, round(list_sum(list_transform({_HALF}, lambda x: x)), 6) AS whole, round({_dot('list_resize(v, 70, 0.0)', _l([1.0] * 70))}, 6) AS resized,
    bit_count(xor(vec_id, label::BIGINT)) / 64.0::DOUBLE AS hamming, printf('%.2f', v[1]) AS said, TRY_CAST(CASE WHEN label = 3 THEN 'x' ELSE label::VARCHAR END AS DOUBLE) AS parsed FROM {E}""")
def vec_more(spark, d):
    """Bhattacharyya of a distribution with itself is 1; bits that differ, resized vectors, safe parsing, two digits."""
    v = F.col("v")
    share = F.transform(v, lambda x: x * x / V.total(F.transform(v, lambda y: y * y)))
    return _emb(spark, d).select(
        "vec_id",
        _r(V.bhattacharyya(share, share)).alias("whole"),
        _r(V.total(V.resize(v, 70))).alias("resized"),
        V.hamming(F.col("vec_id"), F.col("label").cast("long")).alias("hamming"),
        V.two_digits(F.get(v, F.lit(0))).alias("said"),
        V.safe_double(F.when(F.col("label") == 3, "x").otherwise(F.col("label").cast("string"))).alias("parsed"),
    )


@query(f"SELECT vec_id, round({_dot('a', 'b')} / (sqrt({_dot('a', 'a')}) * sqrt({_dot('b', 'b')})), 6) AS cosine FROM (SELECT vec_id, list_transform(i, lambda k: v[k + 1]) AS a, list_transform(i, lambda k: ({_l(PROBE)})[k + 1]) AS b FROM (SELECT *, list_filter(range(0, 64), lambda k: k % 2 = 0 AND k % 3 <> 0) AS i FROM {E}))")
def cosine_shared(spark, d):
    """Two sparse vectors over the indices that both have: the even ones, and those that three doesn't divide."""
    pick = lambda values, keep: V.sparse(F.filter(F.sequence(F.lit(0), F.lit(63)), keep), F.filter(values, lambda _, i: keep(i)))
    a, b = pick(F.col("v"), lambda i: i % 2 == 0), pick(V.literal(PROBE), lambda i: i % 3 != 0)
    return _emb(spark, d).select("vec_id", _r(V.cosine_shared(a, b)).alias("cosine"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events")
def dense_ids(spark, d):
    return select.dense_ids(load(spark, d, "events").select("event_id"), "event_id")


@query("SELECT label % 4 AS category, count(*) AS n, 1 AS partitions FROM embeddings GROUP BY 1")
def category_partition(spark, d):
    """Rows of a category are in one partition."""
    rows = select.category_partition(load(spark, d, "embeddings"), "label", 4).withColumn("p", F.spark_partition_id())
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("p").cast("int").alias("partitions"))


@query("SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1 ORDER BY size DESC, o_custkey LIMIT 12")
def divisible_groups(spark, d):
    sizes = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    return select.divisible(sizes, "size", "o_custkey", 12)


@query("SELECT user_id % 7 AS parent, list(event_id ORDER BY event_id)[1] AS first, count(*) AS total FROM events GROUP BY 1")
def nested_buckets(spark, d):
    """Two layers as one row a parent: children in their order, and the rows of all of them."""
    rows = load(spark, d, "events").select((F.col("user_id") % 7).alias("parent"), "event_id")
    got = buckets.nested(rows, "parent", "event_id")
    return got.select("parent", F.get("event_id", F.lit(0)).alias("first"), "total")


# --- index ------------------------------------------------------------------------------------


@query(f"SELECT table_id, count(*) AS n, count(DISTINCT vec_id) AS vectors, max(vec_id) AS most FROM (SELECT unnest(range(0, {TABLES}))::INT AS table_id, vec_id FROM embeddings UNION ALL SELECT unnest(range(0, {TABLES}))::INT, vec_id + 1000000 FROM embeddings) GROUP BY 1")
def index_added(spark, d):
    e = _emb(spark, d)
    more = lsh.add(lsh.build(e, "v", "vec_id", PLANES, TABLES), e.withColumn("vec_id", F.col("vec_id") + 1_000_000), "v", "vec_id", PLANES, TABLES)
    return more.groupBy("table_id").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("vectors"), F.max("vec_id").alias("most"))


@query(f"SELECT count(*) * {TABLES} AS n, true AS same FROM embeddings")
def streamed_index(spark, d):
    """An index appended by a stream over the table's files, as many batches as there are, holds what the batch build gives."""
    from granary.streaming import index as streams

    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    table = load(spark, d, "embeddings")
    table.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(table.schema).parquet(f"{folder}/in")
    q = streams.append_index(source, "embedding", "vec_id", PLANES, TABLES, f"{folder}/out", f"{folder}/checkpoint")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{folder}/out").select("vec_id", "table_id", "hash_key")
    want = lsh.build(table, "embedding", "vec_id", PLANES, TABLES).select("vec_id", "table_id", "hash_key")
    out = _row(spark, n=got.count(), same=got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty())
    text.delete(spark, folder)
    return out


# --- images ----------------------------------------------------------------------------------------


def _grey_bytes(spark, d, size):
    """vec_id, label, pixels binary: the vector as grey values, filled up with zeros to `size`."""
    px = F.transform(V.resize(F.col("v"), size), lambda x: F.least(F.lit(255.0), F.floor(F.abs(x) * 400)).cast("int"))
    return _emb(spark, d).select("vec_id", "label", F.unhex(F.array_join(F.transform(px, lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("pixels"))


def _one_file(spark, values, last):
    """Path of one binary file of the rows' bytes, in order, whose last byte `last` the text writer puts there."""
    path = f"{shared_dir(spark).rstrip('/')}/binary-{uuid.uuid4().hex}"
    values.coalesce(1).select(F.col("value").cast("string")).write.option("lineSep", last).text(path)
    return path


_PX = "list_transform(list_resize(v, 72, 0.0), lambda x: least(255, floor(abs(x) * 400)))"


@query(f"SELECT (label + 1)::DOUBLE AS label, count(*) AS n, sum(list_sum({_PX}))::BIGINT AS total FROM {E} GROUP BY 1")
def source_idx(spark, d):
    """A pair of IDX files of 9 x 8 pictures, whose last pixel is 0, and of their labels."""
    rows = _grey_bytes(spark, d, 72)
    n = rows.count()
    # A file is one row here, as its format has one header; what follows has a row a picture.
    body = rows.agg(F.array_sort(F.collect_list(F.struct("vec_id", "pixels", "label"))).alias("r"))
    head = lambda *x: F.unhex(F.lit("".join(f"{i:08x}" for i in x)))
    images = body.select(F.concat(head(2051, n, 9, 8), F.unhex(F.array_join(F.transform("r", lambda r: F.hex(r["pixels"])), ""))).alias("value"))
    labels = body.select(F.concat(head(2049, n), F.unhex(F.array_join(F.transform("r", lambda r: F.lpad(F.hex(r["label"]), 2, "0")), ""))).alias("value"))
    last = rows.orderBy(F.desc("vec_id")).first()["label"]
    cut_ = lambda df: df.select(F.expr("substring(value, 1, length(value) - 1)").alias("value"))
    a, b = _one_file(spark, cut_(images), "\0"), _one_file(spark, cut_(labels), chr(last))
    got = cut(binary.pixel_array(binary.mnist(spark, f"{a}/part-*", f"{b}/part-*")))
    for p in (a, b):
        text.delete(spark, p)
    return got.groupBy(F.col("label").cast("double").alias("label")).agg(F.count("*").alias("n"), F.sum(V.total(F.col("features"))).cast("long").alias("total"))


@query(f"SELECT (label + 1)::DOUBLE AS label, count(*) AS n, sum(list_sum(list_transform(v, lambda x: least(255, floor(abs(x) * 400)))))::BIGINT AS total FROM {E} GROUP BY 1")
def source_cifar(spark, d):
    """Records of a label and 3 x 32 x 32 planar pixels: the vector, filled up with zeros."""
    rows = _grey_bytes(spark, d, 3072).select(F.expr("concat(unhex(lpad(hex(label), 2, '0')), substring(pixels, 1, 3071))").alias("value"))
    path = _one_file(spark, rows, "\0")
    got = cut(binary.pixel_array(binary.cifar10(spark, f"{path}/part-*")))
    text.delete(spark, path)
    return got.groupBy(F.col("label").cast("double").alias("label")).agg(F.count("*").alias("n"), F.sum(V.total(F.col("features"))).cast("long").alias("total"))


@query(f"SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN p[(i // 8) * 9 + i % 8 + 1] > p[(i // 8) * 9 + i % 8 + 2] THEN '1' ELSE '0' END), '') AS dhash FROM (SELECT vec_id, {_PX} AS p FROM {E})")
def difference_hash(spark, d):
    px = F.transform(V.resize(F.col("v"), 72), lambda x: F.least(F.lit(255.0), F.floor(F.abs(x) * 400).cast("double")))
    bits = F.array_join(F.transform(images.hash_bits(F.col("h")), lambda b: b.cast("int").cast("string")), "")
    return _emb(spark, d).select("vec_id", images.difference_hash(px).alias("h")).select("vec_id", bits.alias("dhash"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(0, 63), lambda i: (v[i + 1] - [0.1, 0.2, 0.3][i % 3 + 1]) / [0.5, 0.25, 2.0][i % 3 + 1])) + (v[64] - 0.1) / 0.5, 6) AS total FROM {E}")
def channel_scaled(spark, d):
    return _emb(spark, d).select("vec_id", _r(V.total(images.channel_scale(F.col("v"), [0.1, 0.2, 0.3], [0.5, 0.25, 2.0]))).alias("total"))


# --- more trainers ---------------------------------------------------------------------------------


def _sides(spark, d):
    return _emb(spark, d).withColumn("y", F.when(F.col("label") < 5, -1.0).otherwise(1.0))


@query("SELECT true AS inside, true AS bounded, true AS balanced")
def cascade_machine(spark, d):
    """Support rows are rows, with weights up to c, which balance between the classes."""
    e = _sides(spark, d)
    s, _ = svm.cascade(e, "v", "y", "vec_id", 8, 2, gamma=0.05)
    s = cut(s)
    balance = s.agg(F.abs(F.sum(F.col("alpha") * F.col("sv_y")))).first()[0]
    return _row(spark, inside=s.join(e, F.col("sv_id") == F.col("vec_id"), "left_anti").isEmpty(), bounded=s.filter("alpha <= 0 or alpha > 1 + 1e-9").isEmpty(), balanced=balance < 1e-3)


@query("SELECT true AS supports, true AS inside, true AS few")
def zip_machine(spark, d):
    """A machine that draws from the rows of the zips that support one trained on zips."""
    rows, zips = svm.zipped(_sides(spark, d).drop("label"), "v", "y", "vec_id", 20, "pca")
    s = cut(svm.zip_svm(rows, zips, "v", "y", "vec_id", 4, 40).support(spark))
    return _row(spark, supports=s.filter("alpha <= 0").isEmpty(), inside=s.join(rows, F.col("sv_id") == F.col("vec_id"), "left_anti").isEmpty(), few=0 < s.count() <= 4 * 40)


@query("SELECT true AS minibatch, true AS top, true AS zips")
def descents(spark, d):
    """Mini-batches, the rows of the largest gradients, and the rows of the zips of the largest gradients each lower the loss."""
    e = _emb(spark, d)
    w = np.array(NET_W)
    at = lambda x: regress.loss(e, NET, "v", "label", x).first()["loss"]
    start = at(w)
    rows, zips = _zips(spark, d)
    top = regress.top_gradient(e, NET, "v", "label", "vec_id", w, 0.5, "label")
    zipped = regress.zip_descent(rows, zips.withColumn("part", F.col("label")), NET, "v", "label", w, 2, 0.5, 0.5, "part")
    return _row(spark, minibatch=at(regress.minibatch(e, NET, "v", "label", w, 3, 0.5, 0.5)) < start, top=at(w - 0.5 / e.count() * top) < start, zips=at(zipped) < start)


@query("SELECT 64 AS n, true AS least FROM embeddings LIMIT 1")
def linear_regression(spark, d):
    """Coefficients for each position, with an error below that of the mean."""
    e = _emb(spark, d)
    m = regress.linear_regression(e, "v", "label")
    spread = e.agg(F.stddev_pop("label")).first()[0]
    return _row(spark, n=len(m.coefficients), least=m.summary.rootMeanSquaredError < spread).withColumn("n", F.col("n").cast("int"))


@query("SELECT true AS falls, true AS network_falls")
def zipped_networks(spark, d):
    """A perceptron trained through zips, and a network of layers on the vectors as 8 x 8 pictures: losses fall."""
    e = _emb(spark, d)
    rows, zips = _zips(spark, d)
    model = neural.Perceptron([64, 10])
    _, history = neural.fit_zips(rows, zips.withColumn("part", F.lit(0)), model, "v", "label", 4, "part", neural.Update("constant", 0.5))
    net = neural.Network([("conv", 4, 3), ("pool", 2), ("full", 10)], 8)
    _, losses = neural.fit(e, net, "v", "label", 6, neural.Update("constant", 0.2))
    return _row(spark, falls=history[-1] < history[0], network_falls=losses[-1] < losses[0])


@query("SELECT 4 AS edges, true AS pairs, true AS ring")
def gossip_modes(spark, d):
    """Means with random peers, and gradients averaged around a ring: losses fall."""
    e = _emb(spark, d).withColumn("edge", F.pmod("vec_id", F.lit(4)) + 1)
    model, cfg = neural.Perceptron([64, 10]), gossip.GossipConfig(4, 3, step=0.5)
    state, first = gossip.train(e, model, "v", "label", "edge", cfg, "pairs")
    _, second = gossip.train(e, model, "v", "label", "edge", cfg, "ring")
    return _row(spark, edges=gossip.members(state), pairs=first[-1] < first[0], ring=second[-1] < second[0]).withColumn("edges", F.col("edges").cast("int"))


@query("SELECT 6 AS leaves, count(*) AS n, true AS same FROM embeddings")
def tree_saved(spark, d):
    """A tree of zips' rows, saved and loaded again, predicts the same clusters."""
    rows, zips = _zips(spark, d)
    t = cluster.bisecting_kmeans(rows, "v", 6, 2, zips=zips, ratio=0.5)
    path = f"{shared_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    t.save(spark, path)
    back = cluster.Tree.load(spark, path)
    text.delete(spark, path)
    a, b = t.predict(rows, "v").select("vec_id", "cluster"), back.predict(rows, "v").select("vec_id", "cluster")
    out = _row(spark, leaves=len(back.leaves()), n=a.count(), same=a.exceptAll(b).isEmpty())
    return out.withColumn("leaves", F.col("leaves").cast("int"))


@query("SELECT 5 AS clusters, count(*) AS n FROM embeddings")
def mllib_kmeans(spark, d):
    from pyspark.ml.functions import array_to_vector

    e = _emb(spark, d)
    m = cluster.mllib_kmeans(e, "v", 5, 5)
    got = m.transform(e.select(array_to_vector("v").alias("x")))
    return got.agg(F.count_distinct("prediction").cast("int").alias("clusters"), F.count("*").alias("n"))
