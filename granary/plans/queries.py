"""Queries over the generated tables, each with its SQL: the deterministic forms of the library's operators.

Planes, centers, weights and support sets are small literals made by a rule, shared by both texts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import images, vectors as V
from granary.operators import buckets, cluster, gossip, lsh, pairs, regress, select, svm
from granary.session import load
from granary.sources import text

DIM = 64


def _signs(n, size=DIM):
    return [[1.0 if (i * 7 + j * 3 + i * j) % 5 < 2 else -1.0 for j in range(size)] for i in range(n)]


def _wave(n, size=DIM, scale=0.25):
    """n vectors of small distinct values."""
    return [[round(scale * (((i * 31 + j * 17 + i * j * 5) % 23) - 11) / 11, 4) for j in range(size)] for i in range(n)]


PLANES, TABLES = _signs(12), 3
CENTERS, CENTERS2 = _wave(4), [[x * 0.5 + 0.01 * (i + 1) for x in c] for i, c in enumerate(_wave(4))]
PROBE = _wave(5)[4]
ROUND_PLANES = [_signs(4), [[-x if j % 2 else x for j, x in enumerate(p)] for p in _signs(4)]]
PER_BUCKET = 40
SPLITS = (3, 17, 40)
NET = regress.SigmoidNetwork(DIM, 3)
NET_W = [round(0.3 * (((i * 13) % 19) - 9) / 9, 4) for i in range(NET.size)]
RADIAL = regress.RadialSum(DIM, 2)
RADIAL_W = _wave(2)[0] + [4.0, 1.5] + _wave(2)[1] + [5.0, -0.5]
TREE = cluster.Tree({i: {"size": 1, "center": c, "cost": 0.0} for i, c in zip((1, 2, 3, 4, 5), _wave(5), strict=True)})
SUPPORT = [(i, 1.0 if i % 2 else -1.0, 0.5 + i / 10, c) for i, c in enumerate(_wave(6))]
KDE = _wave(6, DIM, 0.5)


def _emb(spark, d):
    return load(spark, d, "embeddings").select("vec_id", V.dense("embedding").alias("v"), "label")


def _r(c, n=6):
    return F.round(c, n)


E = "(SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _l(xs):
    return "[" + ", ".join(f"({x!r})::DOUBLE" for x in xs) + "]"


def _dot(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _sq(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _norm(a):
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def _costs(centers):
    return "[" + ", ".join(_sq("v", _l(c)) for c in centers) + "]"


Q: dict = {}
SQL: dict = {}


def query(sql):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


# --- vectors -----------------------------------------------------------------


@query(f"""SELECT vec_id, round({_norm('v')}, 6) AS norm, round({_dot('v', _l(PROBE))}, 6) AS dot, round(sqrt({_sq('v', _l(PROBE))}), 6) AS euclid,
    round({_dot('v', _l(PROBE))} / ({_norm('v')} * {_norm(_l(PROBE))}), 6) AS cosine, round(list_sum(list_transform(list_zip(v, {_l(PROBE)}), lambda z: 2 * z[1] + z[2])), 6) AS axpy_sum,
    round(list_sum(list_transform(v, lambda x: x * -0.5)), 6) AS scal_sum FROM {E}""")
def vec_functions(spark, d):
    v, p = F.col("v"), V.literal(PROBE)
    return _emb(spark, d).select("vec_id", _r(V.norm(v)).alias("norm"), _r(V.dot(v, p)).alias("dot"), _r(V.euclidean(v, p)).alias("euclid"), _r(V.cosine(v, p)).alias("cosine"), _r(V.total(V.axpy(2.0, v, p))).alias("axpy_sum"), _r(V.total(V.scal(-0.5, v))).alias("scal_sum"))


@query(f"""SELECT vec_id, round(exp(-0.05 * {_sq('v', _l(PROBE))}), 6) AS rbf, round(pow(0.5 * {_dot('v', _l(PROBE))} + 0, 2), 6) AS poly, round({_dot('v', _l(PROBE))}, 6) AS linear,
    round(tanh(0.5 * {_dot('v', _l(PROBE))}), 6) AS tanh FROM {E}""")
def vec_kernels(spark, d):
    v, p = F.col("v"), V.literal(PROBE)
    return _emb(spark, d).select("vec_id", _r(V.kernel("rbf", 0.05)(v, p)).alias("rbf"), _r(V.kernel("poly", 0.5)(v, p)).alias("poly"), _r(V.kernel("linear")(v, p)).alias("linear"), _r(V.kernel("tanh", 0.5)(v, p)).alias("tanh"))


@query(f"SELECT vec_id, pos, CASE WHEN abs(pow(x, p)) < 1e-6 THEN 0 ELSE round(pow(x, p), 6) END AS f FROM (SELECT vec_id, (unnest(range(0, len(v)))) AS i, unnest(v) AS x FROM {E}), (SELECT unnest([1, 2, 3]) AS p), LATERAL (SELECT i * 3 + p - 1 AS pos)")
def polynomial_features(spark, d):
    return _emb(spark, d).select("vec_id", F.posexplode(V.polynomial(F.col("v"), 3)).alias("pos", "f")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.when(F.abs("f") < 1e-6, 0.0).otherwise(_r(F.col("f"))).alias("f"))


@query(f"SELECT vec_id, label, list_extract(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN 1.0 ELSE 0.0 END), label + 1)::DOUBLE AS hot, (list_position(v, list_max(v)) - 1)::INT AS argmax, (list_position(v, list_max(v)) - 1) % 10 = label AS agrees FROM {E}")
def one_hot_argmax(spark, d):
    hot = V.one_hot(F.col("label"), 10)
    return _emb(spark, d).select("vec_id", "label", F.get(hot, F.col("label")).alias("hot"), V.argmax(F.col("v")).alias("argmax"), (V.argmax(F.col("v")) % 10 == F.col("label")).alias("agrees"))


@query(f"""WITH c AS (SELECT vec_id, label, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM {E}),
    s AS (SELECT label, pos, avg(x) AS m, stddev_samp(x) AS s FROM c GROUP BY ALL)
    SELECT vec_id, pos, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 5) AS z FROM c JOIN s USING (label, pos)""")
def standard_scale(spark, d):
    out = V.standard_scale(_emb(spark, d), "v", ["label"])
    return out.select("vec_id", F.posexplode("v").alias("pos", "z")).select("vec_id", F.col("pos").cast("long").alias("pos"), _r(F.col("z"), 5).alias("z"))


@query(f"SELECT vec_id, label, round(-list_extract(l, label + 1), 6) AS loss FROM (SELECT vec_id, label, list_transform(v, lambda x: x - list_max(v) - ln(list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))) AS l FROM {E})")
def cross_entropy_loss(spark, d):
    return _emb(spark, d).select("vec_id", "label", _r(V.cross_entropy(F.col("v"), F.col("label") + 1)).alias("loss"))


# --- sign hashing --------------------------------------------------------------

_BITS = [f"CASE WHEN {_dot('v', _l(p))} > 0 THEN '1' ELSE '0' END" for p in PLANES]
_KEYS = " UNION ALL ".join(f"SELECT vec_id, {t} AS table_id, {' || '.join(_BITS[t::TABLES])} AS hash_key FROM {E}" for t in range(TABLES))


def _index(spark, d):
    return lsh.build(_emb(spark, d), "v", "vec_id", PLANES, TABLES)


@query(_KEYS)
def lsh_index(spark, d):
    return _index(spark, d)


@query(f"WITH i AS ({_KEYS}) SELECT a.vec_id, b.vec_id AS candidate, count(*) AS tables FROM i a JOIN i b ON a.table_id = b.table_id AND a.hash_key = b.hash_key AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL")
def lsh_candidates(spark, d):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    index = _index(spark, d)
    return lsh.candidates_of(index, index.filter("vec_id % 50 = 0")).groupBy("vec_id", "candidate").agg(F.count("*").alias("tables"))


@query(f"WITH i AS ({_KEYS}), c AS (SELECT DISTINCT a.vec_id AS q, b.vec_id FROM i a JOIN i b USING (table_id, hash_key) WHERE a.vec_id % 50 = 0) SELECT q AS query, c.vec_id AS candidate, round({_dot('x.v', 'y.v')} / ({_norm('x.v')} * {_norm('y.v')}), 6) AS cosine FROM c JOIN {E} x ON x.vec_id = q JOIN {E} y ON y.vec_id = c.vec_id")
def lsh_verify(spark, d):
    e = _emb(spark, d)
    pairs = lsh.candidates_for(_index(spark, d), e.filter("vec_id % 50 = 0"), "v", "vec_id", PLANES, TABLES).distinct()
    a, b = e.select(F.col("vec_id").alias("query"), F.col("v").alias("a")), e.select(F.col("vec_id").alias("candidate"), F.col("v").alias("b"))
    return pairs.join(a, "query").join(b, "candidate").select("query", "candidate", _r(V.cosine(F.col("a"), F.col("b"))).alias("cosine"))


@query(f"WITH i AS ({_KEYS}) SELECT table_id, hash_key, count(*) AS n, min(vec_id) AS least FROM i WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3) GROUP BY ALL")
def lsh_remove(spark, d):
    left = lsh.remove(_index(spark, d), load(spark, d, "embeddings").filter("label = 3"))
    return left.groupBy("table_id", "hash_key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))


def _round_sql():
    prev = f"SELECT vec_id, v, '' AS bucket FROM {E}"
    for r, planes in enumerate(ROUND_PLANES):
        bits = " || ".join(f"CASE WHEN {_dot('v', _l(p))} > 0 THEN '1' ELSE '0' END" for p in planes)
        prev = f"""SELECT vec_id, v, CASE WHEN n > {PER_BUCKET} THEN bucket || '/{r}:' || left({bits}, least(floor(log2(n // {PER_BUCKET}) + 1)::INT, {len(planes)})) ELSE bucket END AS bucket
            FROM (SELECT *, count(*) OVER (PARTITION BY bucket) AS n FROM ({prev}))"""
    return f"SELECT vec_id, bucket FROM ({prev})"


@query(_round_sql())
def lsh_rounds(spark, d):
    return lsh.rounds(_emb(spark, d), "v", "vec_id", PER_BUCKET, ROUND_PLANES)


@query("SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN c_acctbal ELSE total END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def multiput(spark, d):
    new = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    store = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return lsh.multiput(store, new.join(store, "c_custkey", "left_semi"), "c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def multiget(spark, d):
    keys = load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(keys, "c_custkey", "left_semi")


# --- buckets -------------------------------------------------------------------


def _split_sql(by="label", depth=len(SPLITS)):
    prev = f"SELECT vec_id, v, label, '' AS bucket FROM {E}"
    part = f"PARTITION BY {by}, bucket" if by else "PARTITION BY bucket"
    for f in SPLITS[:depth]:
        prev = f"SELECT vec_id, v, label, bucket || CASE WHEN row_number() OVER ({part} ORDER BY v[{f + 1}], vec_id) > count(*) OVER ({part}) // 2 THEN '1' ELSE '0' END AS bucket FROM ({prev})"
    return prev


def _split(spark, d, by=("label",)):
    return buckets.median_split(_emb(spark, d), [F.get("v", F.lit(f)) for f in SPLITS], "vec_id", list(by))


@query(f"SELECT vec_id, label, bucket FROM ({_split_sql()})")
def median_split(spark, d):
    return _split(spark, d).select("vec_id", "label", "bucket")


@query(f"SELECT label, bucket, pos, count(*) AS n, round(avg(x), 6) AS m FROM (SELECT label, bucket, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM ({_split_sql()})) GROUP BY ALL")
def bucket_centroids(spark, d):
    cells = buckets.centroid_cells(_split(spark, d), "v", ["label", "bucket"])
    return cells.select("label", "bucket", F.col("pos").cast("long").alias("pos"), "n", _r(F.col("m")).alias("m"))


@query(f"""WITH f AS (SELECT label, bucket, pos, count(*) AS n, avg(x) AS m FROM (SELECT label, bucket, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM ({_split_sql()})) GROUP BY ALL)
    SELECT label || ':' || left(bucket, 1) AS parent, pos, sum(n)::BIGINT AS size, round(sum(m * n) / sum(n), 6) AS m FROM f GROUP BY ALL""")
def layer_roll_up(spark, d):
    fine = buckets.centroids(_split(spark, d), "v", ["label", "bucket"])
    up = buckets.roll_up(fine, F.concat_ws(":", F.col("label").cast("string"), F.substring("bucket", 1, 1)))
    return up.select("parent", "size", F.posexplode("centroid").alias("pos", "m")).select("parent", F.col("pos").cast("long").alias("pos"), "size", _r(F.col("m")).alias("m"))


@query(f"SELECT label, bucket, count(*) AS size, list_position(list_transform(range(0, 10), lambda i: i = label), true) - 1 AS hot FROM ({_split_sql()}) GROUP BY ALL")
def bucket_one_hot(spark, d):
    out = buckets.centroids(_split(spark, d), "v", ["label", "bucket"], "label", 10)
    return out.select("label", "bucket", "size", V.argmax(F.col("one_hot")).cast("long").alias("hot"))


@query(f"SELECT vec_id, label, least((row_number() OVER w - 1) * 5 // count(*) OVER (PARTITION BY label), 4)::INT AS slice FROM {E} WINDOW w AS (PARTITION BY label ORDER BY v[4], vec_id)")
def rank_slices(spark, d):
    return buckets.slices(_emb(spark, d), F.get("v", F.lit(3)), "vec_id", 5, ["label"]).select("vec_id", "label", "slice")


@query(f"SELECT pos, round(stddev_pop(x), 6) AS s, round(avg(x), 6) AS m FROM (SELECT unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM {E}) GROUP BY ALL")
def position_statistics(spark, d):
    return V.positions(_emb(spark, d), "v").groupBy(F.col("pos").cast("long").alias("pos")).agg(_r(F.stddev_pop("x")).alias("s"), _r(F.avg("x")).alias("m"))


@query(f"""WITH b AS (SELECT label, bucket, list(vec_id ORDER BY vec_id) AS ids FROM ({_split_sql()}) GROUP BY ALL), t AS (SELECT max(len(ids)) AS top FROM b)
    SELECT label || ';' || len(ids) || '|' || array_to_string(list_transform(range(0, top), lambda i: label || ';' || ids[(i % len(ids)) + 1]), '|') AS value FROM b, t""")
def padded_dump(spark, d):
    member = F.struct("label", F.array("vec_id").alias("features"))
    g = _split(spark, d).groupBy("label", "bucket").agg(F.array_sort(F.collect_list(member)).alias("members"))
    g = g.withColumn("head", F.struct("label", F.array(F.size("members").cast("long")).alias("features")))
    return buckets.padded_dump(g, "head", "members")


@query(f"SELECT bucket, n <= 3 AS small, count(*) AS buckets, sum(n)::BIGINT AS n_rows FROM (SELECT label, bucket, count(*) AS n FROM ({_split_sql()}) GROUP BY ALL) GROUP BY ALL")
def small_buckets(spark, d):
    sizes = _split(spark, d).groupBy("label", "bucket").agg(F.count("*").alias("size"))
    small, large = buckets.small_and_large(sizes, 7)
    both = small.withColumn("small", F.lit(True)).unionByName(large.withColumn("small", F.lit(False)))
    return both.groupBy("bucket", "small").agg(F.count("*").alias("buckets"), F.sum("size").alias("n_rows"))


# --- clustering ------------------------------------------------------------------


@query(f"SELECT vec_id, (list_position(c, list_min(c)) - 1)::INT AS cluster, round(list_min(c), 6) AS cost, round(list_sort(c)[2] - list_sort(c)[1], 6) AS gap, round((list_sort(c)[2] - list_sort(c)[1]) / list_sort(c)[1], 6) AS gap_ratio FROM (SELECT vec_id, {_costs(CENTERS)} AS c FROM {E})")
def kmeans_assign(spark, d):
    c = V.costs(F.col("v"), CENTERS)
    return cluster.assign(_emb(spark, d), "v", CENTERS).select("vec_id", "cluster", _r(F.col("cost")).alias("cost"), _r(V.gap(c)).alias("gap"), _r(V.gap(c, True)).alias("gap_ratio"))


@query(f"WITH a AS (SELECT vec_id, v, {_costs(CENTERS)} AS c FROM {E}) SELECT vec_id, (list_position(c, list_min(c)) - 1)::INT AS cluster, round(list_min(c), 6) AS cost FROM a")
def nearest_center_join(spark, d):
    table = spark.createDataFrame(list(enumerate(CENTERS)), "cluster int, center array<double>")
    return cluster.assign_joined(_emb(spark, d), "v", "vec_id", table).select("vec_id", "cluster", _r(F.col("cost")).alias("cost"))


def _lloyd(k=2):
    """SQL of k Lloyd iterations: CTEs c0.. of (cluster, center)."""
    ctes = ["c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_l(c)})" for i, c in enumerate(CENTERS)) + ") t(cluster, center))"]
    for i in range(k):
        ctes.append(f"a{i} AS (SELECT vec_id, v, arg_min(cluster, (cost, cluster)) AS cluster FROM (SELECT vec_id, any_value(v) AS v, cluster, min({_sq('v', 'center')}) AS cost FROM {E}, c{i} GROUP BY vec_id, cluster) GROUP BY vec_id, v)")
        ctes.append(f"m{i} AS (SELECT cluster, list(m ORDER BY pos) AS center FROM (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM a{i}) GROUP BY ALL) GROUP BY cluster)")
        ctes.append(f"c{i + 1} AS (SELECT cluster, coalesce(m{i}.center, c{i}.center) AS center FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return "WITH " + ", ".join(ctes)


@query(_lloyd() + " SELECT cluster, unnest(range(0, len(center))) AS pos, round(unnest(center), 6) AS x FROM c2")
def kmeans_centers(spark, d):
    got = cluster.kmeans(_emb(spark, d), "v", CENTERS, 2)
    return spark.createDataFrame([(i, p, round(x, 6)) for i, c in enumerate(got) for p, x in enumerate(c)], "cluster int, pos long, x double")


@query(f"SELECT round(sum(list_min(c)), 4) AS wssse FROM (SELECT {_costs(CENTERS)} AS c FROM {E})")
def kmeans_cost(spark, d):
    return cluster.wssse(_emb(spark, d), "v", CENTERS).select(_r(F.col("wssse"), 4).alias("wssse"))


@query(f"SELECT count(*) FILTER (WHERE list_position(a, list_min(a)) <> list_position(b, list_min(b))) AS changed, count(*) AS n FROM (SELECT {_costs(CENTERS)} AS a, {_costs(CENTERS2)} AS b FROM {E})")
def kmeans_changes(spark, d):
    return cluster.change_count(_emb(spark, d), "v", CENTERS, CENTERS2)


_ZIP = "label::VARCHAR || ':' || bucket"
_ZIPS = f"SELECT zip_id, label, list(m ORDER BY pos) AS centroid FROM (SELECT {_ZIP} AS zip_id, label, pos, avg(x) AS m FROM (SELECT label, bucket, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM ({_split_sql()})) GROUP BY ALL) GROUP BY ALL"


def _zips(spark, d):
    rows = _split(spark, d).withColumn("zip_id", F.concat_ws(":", F.col("label").cast("string"), "bucket"))
    return rows, buckets.centroids(rows, "v", ["label", "zip_id"])


@query(f"""WITH z AS ({_ZIPS}), s AS (SELECT zip_id, label, abs(list_min({_costs(CENTERS2).replace('(v,', '(centroid,')}) - list_min({_costs(CENTERS).replace('(v,', '(centroid,')})) AS score FROM z),
    k AS (SELECT zip_id FROM (SELECT zip_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, zip_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM s) WHERE r <= floor(n * 0.5))
    SELECT vec_id, CASE WHEN {_ZIP} IN (SELECT zip_id FROM k) THEN list_position({_costs(CENTERS2)}, list_min({_costs(CENTERS2)})) - 1 ELSE list_position({_costs(CENTERS)}, list_min({_costs(CENTERS)})) - 1 END::INT AS cluster FROM ({_split_sql()})""")
def approximate_kmeans_step(spark, d):
    rows, zips = _zips(spark, d)
    first = cluster.approximate_step(rows, zips, "v", "vec_id", None, CENTERS, 0.5, "label")
    return cluster.approximate_step(first, zips, "v", "vec_id", CENTERS, CENTERS2, 0.5, "label").select("vec_id", "cluster")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(greatest(sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity) / count(*), 0), 2) AS cost FROM lineitem GROUP BY ALL")
def cluster_summary(spark, d):
    out = cluster.summaries(load(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "n", _r(F.col("mean")).alias("mean"), _r(F.col("cost"), 2).alias("cost"))


def _d(i):
    return _sq("v", _l(TREE.nodes[i]["center"]))


@query(f"SELECT vec_id, CASE WHEN {_d(2)} <= {_d(3)} THEN CASE WHEN {_d(4)} <= {_d(5)} THEN 4 ELSE 5 END ELSE 3 END AS leaf, CASE WHEN {_d(2)} <= {_d(3)} THEN CASE WHEN {_d(4)} <= {_d(5)} THEN [1, 2, 4] ELSE [1, 2, 5] END ELSE [1, 3] END::VARCHAR AS path FROM {E}")
def tree_predict(spark, d):
    path = F.concat(F.lit("["), F.array_join(TREE.path(F.col("v")).cast("array<string>"), ", "), F.lit("]"))
    return _emb(spark, d).select("vec_id", TREE.leaf(F.col("v")).alias("leaf"), path.alias("path"))


# --- selection -------------------------------------------------------------------


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 25")
def top_k(spark, d):
    return select.top_k(load(spark, d, "events").select("event_id", "value"), F.col("value"), "event_id", 25)


def _ranked(cond, order="value, event_id"):
    return f"SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {order}) AS r, count(*) OVER p AS n, avg(value) OVER p AS mean, max(value) OVER p AS top, coalesce(sum(value) OVER (PARTITION BY event_type ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events WINDOW p AS (PARTITION BY event_type)) WHERE {cond}"


def _events(spark, d):
    return load(spark, d, "events").select("event_id", "event_type", "value")


@query(_ranked("r <= floor(n * 0.1)", "value DESC, event_id"))
def top_fraction(spark, d):
    return select.top_fraction(_events(spark, d), F.col("value"), "event_id", 0.1, ["event_type"])


@query(_ranked("r > floor(n * 0.3)"))
def strategy_fixed_ratio(spark, d):
    return select.fixed_ratio(_events(spark, d), "value", "event_id", 0.3, ["event_type"])


@query(_ranked("NOT (before < mean * n * 0.25 AND (r - 1) / n < 0.4)"))
def strategy_cumulative(spark, d):
    return select.cumulative(_events(spark, d), "value", "event_id", 0.25, ["event_type"], 0.4)


@query(_ranked("NOT (value < CASE WHEN mean * 0.9 >= top THEN mean ELSE mean * 0.9 END AND (r - 1) / n < 0.5)"))
def strategy_mean_threshold(spark, d):
    return select.mean_threshold(_events(spark, d), "value", "event_id", 0.9, ["event_type"], 0.5)


@query(f"""WITH z AS (SELECT label, bucket, max(abs(v[1])) AS loss FROM ({_split_sql()}) GROUP BY ALL),
    k AS (SELECT label, bucket FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY loss DESC, bucket) AS r, count(*) OVER (PARTITION BY label) AS n FROM z) WHERE r <= floor(n * 0.5))
    SELECT vec_id, label, bucket FROM ({_split_sql()}) JOIN k USING (label, bucket)""")
def critical_samples(spark, d):
    rows = _split(spark, d)
    zips = rows.groupBy("label", "bucket").agg(F.max(F.abs(F.get("v", F.lit(0)))).alias("loss"))
    chosen = select.critical(zips, "loss", "bucket", 0.5, ["label"])
    return select.expand(chosen, rows, ["label", "bucket"]).select("vec_id", "label", "bucket")


@query("SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.5) AS lower_median, list_sort(list(l_quantity))[floor((count(*) - 1) * 0.95)::BIGINT + 1] AS p95 FROM lineitem GROUP BY ALL")
def order_statistics(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(select.lower_median("l_extendedprice").alias("lower_median"), select.order_statistic(F.col("l_quantity"), 0.95).alias("p95"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, min(value) AS least, max(value) AS most, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL")
def scalar_statistics(spark, d):
    v = F.col("value")
    return load(spark, d, "events").groupBy("event_type").agg(_r(F.avg(v)).alias("mean"), _r(F.stddev_pop(v)).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"), _r(F.sum(v), 4).alias("total"), F.count("*").alias("n"))


@query("SELECT vec_id, label, CASE WHEN label % 4 = 0 THEN 4 ELSE label % 4 END AS class, CASE WHEN label < 0.9 THEN -1 ELSE 1 END AS sign, ((vec_id % 10) + 10) % 10 AS category FROM embeddings WHERE label IN (0, 1, 2, 3, 5, 8)")
def label_rules(spark, d):
    rows = select.with_labels(load(spark, d, "embeddings").select("vec_id", "label"), "label", "0-3,5,8")
    return rows.select("vec_id", "label", V.label_mod(F.col("label"), 4).alias("class"), V.sign_label(F.col("label")).alias("sign"), F.pmod("vec_id", F.lit(10)).alias("category"))


def _kde_sql():
    s, dim = len(KDE), DIM
    h = (5.0**0.5) * s ** (-1.0 / (dim + 4))
    c = (0.75**dim) / h**dim / s
    term = lambda k: f"CASE WHEN list_max(list_transform(z{k}, lambda t: abs(t))) < 1 THEN list_product(list_transform(z{k}, lambda t: 1 - t * t)) ELSE 0 END"
    zs = ", ".join(f"list_transform(list_zip(v, {_l(x)}), lambda p: (p[2] - p[1]) / {h!r}) AS z{k}" for k, x in enumerate(KDE))
    return f"SELECT vec_id, round(ln(pow(({' + '.join(term(k) for k in range(s))}) * {c!r}, 0.5)), 6) AS density FROM (SELECT vec_id, {zs} FROM {E})"


def _density(spark, d):
    return select.density(_emb(spark, d), "v", KDE, 0.5).withColumn("density", F.log("density"))


@query(_kde_sql())
def kernel_density(spark, d):
    return _density(spark, d).select("vec_id", _r(F.col("density")).alias("density"))


@query(f"SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY density DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM ({_kde_sql()}) JOIN embeddings USING (vec_id)) WHERE r <= floor(n * 0.2)")
def density_ordered(spark, d):
    rows = _density(spark, d).withColumn("density", _r(F.col("density")))
    return select.density_sample(rows, "vec_id", 0.2, ["label"], ordered=True).select("vec_id", "label")


@query("SELECT o_custkey AS user, count(*) AS items, sum(p)::BIGINT AS item_sum, sum(q) AS rating_sum FROM (SELECT o_custkey, l_partkey AS p, max(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY 1")
def rating_vectors(spark, d):
    rows = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"))
    u = text.user_vectors(rows)
    return u.select("user", F.size("items").cast("long").alias("items"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("item_sum"), V.total(F.col("ratings")).alias("rating_sum"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 128 AS batch FROM events")
def mini_batches(spark, d):
    return select.mini_batches(load(spark, d, "events").select("event_id"), "event_id", 128)


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_operations(spark, d):
    o = load(spark, d, "orders")
    left = load(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti")
    return left.unionByName(o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).distinct())


# --- machines and models -----------------------------------------------------------

_MARGIN = " + ".join(f"{a * y!r} * exp(-0.05 * {_sq('v', _l(s))})" for _, y, a, s in SUPPORT)


def _support(spark):
    return spark.createDataFrame(SUPPORT, "sv_id int, sv_y double, alpha double, sv array<double>")


@query(f"SELECT vec_id, round({_MARGIN} - 0.1, 6) AS margin, CASE WHEN round({_MARGIN} - 0.1, 6) > 0 THEN 1 ELSE -1 END AS prediction FROM {E}")
def svm_margins(spark, d):
    m = svm.margins(_emb(spark, d), "v", "vec_id", _support(spark), "rbf", 0.05, 0.1)
    m = m.withColumn("margin", _r(F.col("margin")))
    return m.withColumn("prediction", svm.predict(F.col("margin")))


@query(f"SELECT vec_id, margin FROM (SELECT vec_id, round({_MARGIN}, 6) AS margin, CASE WHEN label < 5 THEN -1 ELSE 1 END AS y FROM {E}) ORDER BY abs(y * margin - 1) DESC, vec_id DESC LIMIT (SELECT count(*) // 10 FROM embeddings)")
def svm_hard_points(spark, d):
    e = _emb(spark, d).withColumn("y", F.when(F.col("label") < 5, -1).otherwise(1))
    m = svm.margins(e, "v", "vec_id", _support(spark), "rbf", 0.05).withColumn("margin", _r(F.col("margin")))
    return svm.hard_points(e.join(m, "vec_id"), "y", "margin", "vec_id", 0.1).select("vec_id", "margin")


@query("SELECT round(avg((quality = 1 - toxic)::INT), 6) AS accuracy FROM labels")
def accuracy(spark, d):
    return svm.accuracy(load(spark, d, "labels").withColumn("p", 1 - F.col("toxic")), "quality", "p").select(_r(F.col("accuracy")).alias("accuracy"))


def _net_sql():
    w, b, s = NET._parts(NET_W)
    return " + ".join(f"{float(v)!r} / (1 + exp(-({_dot('v', _l(map(float, x)))} + {float(c)!r})))" for x, c, v in zip(w, b, s, strict=True))


def _radial_sql():
    m, g, a = RADIAL._parts(RADIAL_W)
    return " + ".join(f"{float(v)!r} * exp(-0.5 * {_sq('v', _l(map(float, x)))} / {float(c * c)!r})" for x, c, v in zip(m, g, a, strict=True))


@query(f"SELECT vec_id, round({_net_sql()}, 6) AS sigmoid, round({_radial_sql()}, 6) AS radial FROM {E}")
def model_values(spark, d):
    v = F.col("v")
    return _emb(spark, d).select("vec_id", _r(NET.column(v, NET_W)).alias("sigmoid"), _r(RADIAL.column(v, RADIAL_W)).alias("radial"))


@query(f"SELECT count(*) AS n, round(0.5 * sum(r * r), 4) AS loss, round(avg(r * r), 6) AS mse FROM (SELECT {_net_sql()} - label AS r FROM {E})")
def model_loss(spark, d):
    return regress.loss(_emb(spark, d), NET, "v", "label", NET_W).select("n", _r(F.col("loss"), 4).alias("loss"), _r(F.col("mse")).alias("mse"))


# --- gossip --------------------------------------------------------------------------

_EDGES = "(SELECT label + 1 AS edge, 1.0 / 10 * (label + 1) AS score, list(m ORDER BY pos) AS weights FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM " + E + ") GROUP BY ALL) GROUP BY ALL)"


def _edges(spark, d):
    c = buckets.centroids(_emb(spark, d), "v", ["label"])
    return c.select((F.col("label") + 1).alias("edge"), (F.lit(1.0) / 10 * (F.col("label") + 1)).alias("score"), F.col("centroid").alias("weights"))


@query(f"""WITH s AS {_EDGES}, m AS (SELECT edge AS src, (edge % 10) + 1 AS dest FROM s WHERE edge % 3 <> 0),
    b AS (SELECT edge, CASE WHEN src IS NULL THEN score ELSE score / 2 END AS score, weights FROM s LEFT JOIN m ON src = edge UNION ALL SELECT dest, score / 2, weights FROM s JOIN m ON src = edge),
    c AS (SELECT edge, score, unnest(range(0, len(weights))) AS pos, unnest(weights) AS x FROM b)
    SELECT edge, pos, round(sum(score), 6) AS score, round(sum(score * x) / sum(score), 6) AS w FROM c GROUP BY ALL""")
def gossip_scored(spark, d):
    state = _edges(spark, d)
    messages = state.filter("edge % 3 <> 0").select(F.col("edge").alias("src"), (F.col("edge") % 10 + 1).alias("dest"))
    out = gossip.merge_scored(state, messages)
    return out.select("edge", _r(F.col("score")).alias("score"), F.posexplode("weights").alias("pos", "w")).select("edge", F.col("pos").cast("long").alias("pos"), "score", _r(F.col("w")).alias("w"))


@query(f"""WITH s AS {_EDGES}, p AS (SELECT edge, (edge + 4) % 10 + 1 AS peer FROM s)
    SELECT edge, pos, round((x + y) / 2, 6) AS w FROM (SELECT s.edge, unnest(range(0, len(s.weights))) AS pos, unnest(s.weights) AS x, unnest(o.weights) AS y FROM s JOIN p USING (edge) JOIN s o ON o.edge = peer)""")
def gossip_ring(spark, d):
    state = _edges(spark, d)
    out = gossip.merge_pairs(state, state.select("edge", gossip.ring_peer(F.col("edge"), 2, 10).alias("peer")))
    return out.select("edge", F.posexplode("weights").alias("pos", "w")).select("edge", F.col("pos").cast("long").alias("pos"), _r(F.col("w")).alias("w"))


@query(f"SELECT pos, round(avg(x), 6) AS weight FROM (SELECT unnest(range(0, len(weights))) AS pos, unnest(weights) AS x FROM {_EDGES}) GROUP BY ALL")
def merge_models(spark, d):
    return gossip.merge_models(_edges(spark, d)).select(F.col("pos").cast("long").alias("pos"), _r(F.col("weight")).alias("weight"))


# --- images ----------------------------------------------------------------------------

_PIXELS = "list_transform(v, lambda x: least(255, floor(abs(x) * 400)))"


def _pixels(spark, d):
    px = F.transform("v", lambda x: F.least(F.lit(255.0), F.floor(F.abs(x) * 400).cast("double")))
    return _emb(spark, d).select("vec_id", px.alias("p"))


@query(f"WITH c AS (SELECT vec_id, unnest({_PIXELS})::INT AS bin FROM {E}) SELECT vec_id, bin, round(count(*) / 64.0, 6) AS share FROM c GROUP BY ALL")
def grey_histogram(spark, d):
    return images.histogram(_pixels(spark, d), "p", "vec_id").select("vec_id", "bin", _r(F.col("share")).alias("share"))


@query(f"SELECT vec_id, array_to_string(list_transform(p, lambda x: CASE WHEN x * 64 >= list_sum(p) THEN '1' ELSE '0' END), '') AS ahash FROM (SELECT vec_id, {_PIXELS} AS p FROM {E})")
def average_hash(spark, d):
    """Mean and pixels are whole numbers, so that no rounding decides a bit."""
    h = images.average_hash(F.col("p"), 255)
    bits = F.array_join(F.transform(images.hash_bits(F.col("h")), lambda b: b.cast("int").cast("string")), "")
    return _pixels(spark, d).select("vec_id", h.alias("h")).select("vec_id", bits.alias("ahash"))


@query(f"SELECT vec_id, unnest(range(0, 75)) AS pos, unnest(list_transform(range(0, 75), lambda i: coalesce(v[(i % 25) * 3 + i // 25 + 1], 0))) AS x FROM {E}")
def planar_layout(spark, d):
    """A picture of 5 x 5 pixels of three channels: the vector, filled up with zeros."""
    p = images.to_planar(V.resize(F.col("v"), 75), 5, 5)
    return _emb(spark, d).select("vec_id", F.posexplode(p).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), "x")


def flagship(spark, d):
    return bucket_centroids(spark, d)


@query(f"SELECT x.label, round(sum(exp(-0.05 * {_sq('x.v', 'y.v')})), 4) AS total, count(*) AS pairs FROM {E} x JOIN {E} y ON x.label = y.label AND x.vec_id <= y.vec_id GROUP BY ALL")
def kernel_sums(spark, d):
    """The kernel matrix of each partition of a solver, its upper triangle summed."""
    sums = pairs.rbf_sums(load(spark, d, "embeddings"), "embedding", "vec_id", ["label"], 0.05)
    return sums.select("label", _r(F.col("total"), 4).alias("total"), "pairs")


@query("SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events QUALIFY r <= 3")
def top_per_group(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return _events(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("event_type", "event_id", "value", F.col("r").cast("long").alias("r"))
