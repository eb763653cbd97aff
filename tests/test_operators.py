import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import images
from granary.operators import buckets, cluster, gossip, lsh, neural, pairs, ranks, regress, select, svm

EMB = "id long, v array<double>, label int"


def blobs(spark, n=60, seed=0, far=10.0):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(3) + (far if i % 2 else 0)).tolist(), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, EMB)


def test_lsh_sign_is_strict_and_index_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [-1.0, 0.0], 0), (3, [0.0, -1.0], 0)], EMB)
    index = lsh.build(df, "v", "id", [[1.0, 0.0], [0.0, 1.0]], 1)
    assert {r.vec_id: r.hash_key for r in index.collect()} == {0: "10", 1: "01", 2: "00", 3: "00"}
    assert {(r.vec_id, r.candidate) for r in lsh.candidates_of(index, df.filter("id = 2"), "id").collect()} == {(2, 3)}
    more = lsh.add(index, df.withColumn("id", F.col("id") + 10), "v", "id", [[1.0, 0.0], [0.0, 1.0]], 1)
    assert more.count() == 8 and lsh.where(more, F.col("hash_key") == "00").count() == 4
    lsh.save(index, [[1.0, 0.0], [0.0, 1.0]], 1, str(tmp_path / "m"))
    back, hyper, tables = lsh.restore(spark, str(tmp_path / "m"))
    assert back.count() == 4 and hyper == [[1.0, 0.0], [0.0, 1.0]] and tables == 1
    lsh.save(index.withColumn("hash_key", F.lit("1")), [[1.0, 0.0], [0.0, 1.0]], 1, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        lsh.restore(spark, str(tmp_path / "m"))
    assert lsh.planes(3, 2, 5) == lsh.planes(3, 2, 5) and set(np.ravel(lsh.planes(3, 2))) <= {1.0, -1.0}


def test_median_split_lower_half_is_smaller(spark):
    df = spark.createDataFrame([(i, [x], 0) for i, x in enumerate([5.0, 1.0, 1.0, 3.0, 4.0])], EMB)
    got = {r.id: r.bucket for r in buckets.median_split(df, [F.get("v", F.lit(0))], "id").collect()}
    assert got == {1: "0", 2: "0", 0: "1", 3: "1", 4: "1"}
    assert [buckets.levels_for(n, 20) for n in (0, 10, 20, 40, 330)] == [0, 0, 0, 1, 4] and buckets.layer_bounds(64, 3) == [16, 4]
    assert buckets.split_large(df, F.get("v", F.lit(0)), 2).count() == 5


def test_large_groups_are_ranked_over_tasks(spark, monkeypatch):
    """The same rows whether a window or ranges give the ranks; null keys of groups and ties included."""
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 9)), None if i % 7 == 0 else int(rng.integers(0, 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, g int").repartition(5)
    v = [F.col("x"), F.col("x") * F.col("x") - F.col("id")]
    ways = {
        "split": lambda: buckets.median_split(df, v, "id", ["g"]).select("id", "bucket"),
        "alone": lambda: buckets.median_split(df, v, "id").select("id", "bucket"),
        "slices": lambda: buckets.slices(df, F.col("x"), "id", 4).select("id", "slice"),
        "top": lambda: select.top_fraction(df, F.col("x"), "id", 0.3, ["g"]).select("id"),
        "ratio": lambda: select.fixed_ratio(df, "x", "id", 0.3, ["g"]).select("id"),
        "cumulative": lambda: select.cumulative(df, "x", "id", 0.4, ["g"], 0.6).select("id"),
        "mean": lambda: select.mean_threshold(df, "x", "id", 0.9, ["g"], 0.5).select("id"),
        "iterative": lambda: buckets.hash_iterative(df, v, "id", 40).select("id", "bucket"),
    }
    small = {k: sorted(map(tuple, f().collect())) for k, f in ways.items()}
    assert ranks.small(spark.range(10)) and not ranks.small(spark.range(10**8))
    monkeypatch.setattr(ranks, "WINDOW_ROWS", 20)
    monkeypatch.setattr(ranks, "SMALL_BYTES", 0)
    for k, f in ways.items():
        assert sorted(map(tuple, f().collect())) == small[k], k
    assert "WindowExec" not in select.top_fraction(df, F.col("x"), "id", 0.3, ["g"])._jdf.queryExecution().analyzed().toString()


def test_nearest_center_of_a_long_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(6)] + [(9, None, 0)], EMB)
    table = spark.createDataFrame([(i, [float(i) + 0.4, 1.0]) for i in range(5)] + [(7, [0.4, 1.0])], "cluster int, center array<double>")
    want = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (9, None)]
    for cells in (4_000_000, 4):  # in blocks of two centers
        monkeypatch.setattr(cluster, "CENTER_CELLS", cells)
        for metric in ("euclidean", "cosine"):
            got = cluster.assign_joined(df, "v", "id", table, metric).orderBy("id").collect()
            assert metric == "cosine" or [(r.id, r.cluster) for r in got] == want
            assert len(got) == 7 and got[-1].cost is None
    assert {r.cluster for r in cluster.assign_joined(df, "v", "id", table.limit(0)).collect()} == {None}
    far = spark.createDataFrame([(i, [1e9 + i % 2], 0) for i in range(4)], EMB)
    assert cluster.summaries(far.selectExpr("label", "v[0] AS x"), "x", ["label"]).first()["cost"] == pytest.approx(1.0)
    assert cluster.cluster_summaries(far, "v", "label").first()["cost"] == pytest.approx(1.0)


def test_aggregate_points_keep_every_row_once(spark):
    df = blobs(spark, 64)
    for method in ("svd", "pca", "slice"):
        out = buckets.aggregate_points(df, "v", "id", "label", 8, 2, method, rounds=3, ratio=1)
        assert out.count() == 64 == out.select("id").distinct().count()
        assert out.groupBy("category", "bucket").count().count() == 8
    z = buckets.layers(df, "v", "id", [F.get("v", F.lit(0)), F.get("v", F.lit(1))], [1, 2], ["label"])
    assert z.filter("level = 0").agg(F.sum("size")).first()[0] == 64 and z.filter("level = 1 and parent_id = substring(bucket_id, 1, 1)").count() == 8
    assert buckets.by_deviation(df, "v") and buckets.cluster_by(df, "v", "id", "label", 1).count() == 64
    split = buckets.median_split(df, [F.get("v", F.lit(0))] * 2, "id")
    assert buckets.regroup_small(split, "v", 40).count() == 64


def test_reductions(spark):
    x = np.outer(np.arange(1, 9), [0.5, 1.0, 1.5, 2.0])
    u, v = buckets.incremental_svd(x, 1, 400, 1, rate=0.005, true_stride=True)
    assert buckets.svd_error(x, u, v) < 0.5 < buckets.svd_error(x, *buckets.incremental_svd(x, 1, 1, 1))
    assert buckets.svd_error(x, *buckets.incremental_svd(x, 1, 60, 1, backtracking=True)) < buckets.svd_error(x, *buckets.incremental_svd(x, 1, 1, 1))
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], EMB)
    got = np.array([r.features for r in buckets.svd_projection(df, "v", "id", 1).orderBy("id").collect()])
    want = np.linalg.svd(x)[0][:, :1]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    s = buckets.singular_values(df, "v", "id", 2, 2, 1).orderBy("id").first()["features"]
    assert s[0] == pytest.approx(np.linalg.svd(x[0].reshape(2, 2))[1][0])
    assert {len(r.features) for r in buckets.segmented_svd(df, "v", "id", 2, 1, rounds=2).collect()} == {2}


def test_kmeans_family(spark):
    df = blobs(spark)
    start = [[0.0, 0.0, 0.0], [9.0, 9.0, 9.0], [99.0, 99.0, 99.0]]
    exact = cluster.kmeans(df, "v", start, 3)
    assert exact[2] == start[2] and exact[1][0] == pytest.approx(10, abs=1)
    costs = [cluster.wssse(df, "v", cluster.kmeans(df, "v", start, i)).first()[0] for i in range(3)]
    assert costs == sorted(costs, reverse=True)
    rows = buckets.median_split(df, [F.get("v", F.lit(0)), F.get("v", F.lit(1))], "id", ["label"]).withColumn("zip_id", F.concat(F.col("label").cast("string"), "bucket"))
    zips = buckets.centroids(rows, "v", ["zip_id"]).withColumn("part", F.lit(0))
    same = cluster.approximate_kmeans(rows, zips, "v", "id", start, 3, 1.0, "part")
    assert np.allclose(same, exact)
    coarse = buckets.roll_up(zips.withColumn("coarse_id", F.substring("zip_id", 1, 1)), F.col("coarse_id")).withColumnRenamed("parent", "coarse_id")
    layered = cluster.layered_kmeans(rows, coarse, zips.withColumn("coarse_id", F.substring("zip_id", 1, 1)), "v", "id", start, 3, 10**6)
    assert np.allclose(layered, exact)
    centers, changes = cluster.kmeans_with_statistics(df, "v", start, 3)
    assert np.allclose(centers, exact) and changes[-1] == 0
    assert len(cluster.mllib_kmeans(df, "v", 2).clusterCenters()) == 2


def test_bisecting_tree(spark, tmp_path):
    df = blobs(spark, 40)
    tree = cluster.bisecting_kmeans(df, "v", 2)
    assert sorted(tree.nodes) == [1, 2, 3] and sorted(tree.nodes[i]["size"] for i in (2, 3)) == [20, 20]
    out = tree.predict(df, "v").groupBy("cluster").agg(F.countDistinct("label").alias("n")).collect()
    assert {r.n for r in out} == {1} and tree.cost(df, "v") == pytest.approx(tree.nodes[2]["cost"] + tree.nodes[3]["cost"], rel=1e-6)
    assert tree.height(1) > 5 and df.select(tree.path(F.col("v")).alias("p")).first()["p"][0] == 1
    tree.save(spark, str(tmp_path / "t"))
    assert cluster.Tree.load(spark, str(tmp_path / "t")).centers() == tree.centers()
    rows = df.withColumn("zip_id", F.concat(F.col("label").cast("string"), F.lit("-"), (F.col("id") % 8).cast("string")))
    zips = buckets.centroids(rows, "v", ["zip_id"])
    assert sorted(n["size"] for i, n in cluster.bisecting_kmeans(rows, "v", 2, zips=zips, ratio=0.5).nodes.items() if i > 1) == [20, 20]
    flat = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(4)], EMB)
    assert cluster.bisecting_kmeans(flat, "v", 3).leaves() == [1]


def test_mixture(spark):
    df = blobs(spark)
    m = cluster.gaussian_mixture(df, "v", 2, 15)
    assert sorted(round(x) for x in m.means[:, 0]) == [0, 10] and m.history[-1] >= m.history[0] - 1e-6
    assert cluster.log_likelihood(df, "v", m) == pytest.approx(m.history[-1], rel=0.05)
    assert cluster.max_posterior_sum(df, "v", m) == pytest.approx(60, abs=0.1)


def test_selection(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(20)], "id long, g string, x double")
    assert select.label_set("1-3,5") == [1, 2, 3, 5]
    assert select.top_fraction(df, F.col("x"), "id", 0.1, ["g"]).count() == 2 and select.top_fraction(df, F.col("x"), "id", 0.1).count() == 2
    assert select.importance(df, "x", "id", 0.3, ["g"]).count() == 6
    assert select.weighted_sample(df, "x", 5).count() == 5 and select.uniform_sample(df, 5).count() == 5
    heavy = spark.createDataFrame([(1, 1e6), (2, 1e-6), (3, 0.0)], "id long, w double")
    assert select.weighted_sample(heavy, "w", 1).first()["id"] == 1 and select.weighted_sample(heavy, "w", 1, favour_small=True).first()["id"] in (2, 3)
    assert select.uniform_with_replacement(df, "id", 50).count() == 50
    assert sorted(r.idx for r in select.dense_ids(df, "id").collect()) == list(range(20))
    assert select.folds(df, "id", 4).select("fold").distinct().count() <= 4
    assert select.category_partition(df.withColumn("l", F.col("id") - 5), "l", 3).select("category").distinct().count() == 3
    kde = select.density(spark.createDataFrame([(1, [0.0]), (2, [99.0])], "id long, v array<double>"), "v", [[0.0], [0.1]])
    d = {r.id: r.density for r in kde.collect()}
    assert d[1] > 0 == d[2] and select.density_sample(kde, "id", 1.0, seed=3).filter("id = 2").count() == 0


def test_regression(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 2))
    net = regress.SigmoidNetwork(2, 2)
    true = np.array(regress.random_weights(net.size, 5))
    y = net.value(x, true)
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y double")
    for model, w in ((net, true + 0.3), (regress.RadialSum(2, 2), np.array([0.1, 0.2, 1.1, 1.0, -0.4, 0.3, 0.9, 0.5]))):
        assert np.allclose(model.gradient(x, w), regress.numeric_gradient(model, x, w), atol=1e-6)
        f, g = regress.loss_and_gradient(df, model, "v", "y", w)
        r = model.value(x, w) - y
        assert f == pytest.approx(0.5 * r @ r) == regress.loss(df, model, "v", "y", w).first()["loss"]
        assert np.allclose(g, 2 * r @ model.gradient(x, w))
    assert np.linalg.eigvalsh(regress.hessian(df, net, "v", "y", true)).min() >= 1e-4 - 1e-9
    w, history = regress.descend(df, net, "v", "y", true + 0.3, 4, newton=True)
    assert history[-1] < history[0]
    w0 = true + 0.3
    start = regress.loss(df, net, "v", "y", w0).first()["loss"]
    w = regress.minibatch(df, net, "v", "y", w0, 3, 1.0, large_only=True)
    assert regress.loss(df, net, "v", "y", w).first()["loss"] < start
    full = regress.top_gradient(df.withColumn("p", F.lit(0)), net, "v", "y", "id", w0, 1.0, "p")
    assert np.allclose(full, regress.loss_and_gradient(df, net, "v", "y", w0)[1])
    assert regress.quadratic_minimum(0, 1, -2, 1, 1) == pytest.approx(0.5)
    w = regress.zip_regression(df, net, "v", "y", "id", w0, 2, 1.0, 0.5, 20, [lsh.planes(2, 4, 1)])
    assert regress.loss(df, net, "v", "y", w).first()["loss"] < start
    assert regress.linear_regression(df, "v", "y").coefficients.size == 2


def test_kernel_machines(spark):
    df = blobs(spark, 60, far=3.0).withColumn("y", F.when(F.col("label") == 1, 1.0).otherwise(-1.0))

    def rate(support, bias=0.0):
        m = svm.margins(df, "v", "id", support, "rbf", 0.05, bias)
        return svm.accuracy(df.join(m, "id").withColumn("p", svm.predict(F.col("margin"))), "y", "p").first()[0]

    assert rate(svm.PackSvm(0.01, 0.05).fit(df, "v", "y", "id", 6, 10).support(spark)) > 0.9
    support, bias = svm.cascade(df, "v", "y", "id", 2, 2)
    assert rate(support, bias) > 0.9
    support, bias = svm.cascade(df, "v", "y", "id", 2, 2, ratio=0.5)
    assert rate(support, bias) > 0.9
    zips = spark.createDataFrame([(i, [float(i % 2) * 3] * 3, 1.0 if i % 2 else -1.0) for i in range(6)], "zip_id long, centroid array<double>, y double")
    rows = df.withColumn("zip_id", (F.col("id") % 6).cast("long"))
    assert rate(svm.zip_svm(rows, zips, "v", "y", "id", 4, 6).support(spark)) > 0.8
    support, bias = svm.zip_cascade(rows, zips, "v", "y", "id", 1.0, 1)
    assert rate(support, bias) > 0.9
    x = np.array([[0.0], [1.0], [3.0], [4.0]])
    a, b = svm.smo(x, np.array([-1.0, -1, 1, 1]), 10.0, name="linear")
    assert np.allclose(svm.kernel_matrix("linear", 0, x, x) @ (a * [-1, -1, 1, 1]) - b, [-2, -1, 1, 2], atol=0.02)
    with pytest.raises(ValueError):
        svm.smo(x, np.ones(4))


def test_networks(spark, tmp_path):
    df = blobs(spark, 40)
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((5, 3)), np.array([0, 1, 0, 1, 1])
    for model, xs in ((neural.Perceptron([3, 4, 2]), x), (neural.Perceptron([3, 4, 2], False), x), (neural.Convolution(6, 3, 2, 2, 2), rng.standard_normal((5, 36))), (neural.lenet(13, 2, (2, 3), 3, 4), rng.standard_normal((5, 169))), (neural.Network([("conv", 2, 2), ("conv", 2, 2), ("full", 2)], 5, 2, False), rng.standard_normal((5, 50))), (neural.Network([("full", 4), ("full", 2)], 0, 3), x)):
        w = model.start(2)
        loss, g = model.loss_gradient(xs, y, w)
        e = np.eye(len(w))
        numeric = [(model.loss_gradient(xs, y, w + 1e-6 * d)[0] - model.loss_gradient(xs, y, w - 1e-6 * d)[0]) / 2e-6 for d in e]
        assert np.allclose(g, numeric, atol=1e-5) and len(w) == model.size
        assert len(model.first_layer_scores(xs, y, w)) == 5
    model = neural.Perceptron([3, 4, 2])
    for kind in ("constant", "simple", "l1", "l2", "adam", "radam"):
        w, history = neural.fit(df, model, "v", "label", 6, neural.Update(kind, 0.1, 1e-4))
        assert history[-1] < history[0]
    out = neural.predict(df, model, "v", neural.fit(df, model, "v", "label", 25, neural.Update("adam", 0.1))[0])
    assert svm.accuracy(out, "label", "prediction").first()[0] > 0.95
    rows = df.withColumn("zip_id", (F.col("id") % 8).cast("int"))
    zips = buckets.centroids(rows, "v", ["zip_id"], "label").withColumn("part", F.lit(0))
    w, history = neural.fit_zips(rows, zips, model, "v", "label", 5, "part", neural.Update("constant", 0.5))
    assert history[-1] < history[0]
    neural.save(spark, [3, 4, 2], w, str(tmp_path / "n"))
    layers, back = neural.load(spark, str(tmp_path / "n"))
    assert layers == [3, 4, 2] and np.array_equal(back, w)
    with pytest.raises(ValueError):
        neural.Update("none")
    assert neural.convolve(np.eye(3), np.array([[1.0, 2], [3, 4]])).tolist() == [[5.0, 2.0], [3.0, 5.0]]
    assert neural.convolve(np.ones((1, 1)), np.ones((2, 2)), True).shape == (2, 2) and neural.decayed(1.0, 60) == pytest.approx(0.01)


def test_gossip(spark):
    df = blobs(spark, 48).withColumn("edge", F.col("id") % 4 + 1)
    for mode in ("scored", "pairs", "ring"):
        state, history = gossip.train(df, neural.Perceptron([3, 2]), "v", "label", "edge", gossip.GossipConfig(4, 3, step=0.1, critical=0.8), mode)
        assert history[-1] < history[0] and state.count() == 4
        if mode == "scored":
            assert state.agg(F.sum("score")).first()[0] == pytest.approx(1)
    assert all(a != b for a, b in gossip.random_peers(5, 0.0, 1).items()) and gossip.random_peers(5, 1.0, 1) == {}
    s = gossip.initial(spark, 3, [1.0, 2.0])
    assert gossip.members(s) == 3 and gossip.members(gossip.leave(s, s.filter("edge = 1"))) == 2
    assert sorted(r.edge for r in gossip.rotate(s.select("edge"), 3).collect()) == [1, 2, 3]
    b = gossip.blocks(df, "id", 10).groupBy("block").count().collect()
    assert sorted(r["count"] for r in b) == [8, 10, 10, 10, 10]


def test_images(spark):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (2, 28, 28)).astype(np.uint8)
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(px)] + [(9, None)], "id long, pixels binary")
    got = {r.id: r for r in images.perceptual_hashes(df, "id").collect()}
    small = images.shrink(px[0].astype(float), 8, 8)
    want = int.from_bytes(np.packbits((small >= small.mean()).ravel()).tobytes(), "big", signed=True)
    assert got[0].ahash == want and got[9].ahash is None and got[1].phash != got[0].phash
    c = images.dct(np.full((1, 8, 8), 4.0))
    assert c[0, 0, 0] in (31.0, 32.0) and np.abs(c).sum() == c[0, 0, 0]
    one = spark.createDataFrame([(1, [float(i) for i in range(72)], [3.0, 250.0, 0.0] * 2)], "id int, p array<double>, q array<double>")
    assert one.select(images.difference_hash(F.col("p"))).first()[0] == 0
    assert [tuple(r) for r in images.histogram(one, "q", "id", 3, 2).collect()] == [(1, 2, 1.0)]
    planar = images.to_planar(F.col("q"), 2, 1)
    assert one.select(planar).first()[0] == [3.0, 3.0, 250.0, 250.0, 0.0, 0.0]
    assert one.select(images.to_interleaved(planar, 2, 1)).first()[0] == [3.0, 250.0, 0.0] * 2
    assert one.select(images.grey(F.lit(100.0), F.lit(100.0), F.lit(100.0))).first()[0] == pytest.approx(100)


def test_streams(spark, tmp_path):
    from granary.streaming import index as streams

    src = str(tmp_path / "in")
    blobs(spark, 20).write.parquet(src)
    stream = spark.readStream.schema(EMB).parquet(src)
    planes = lsh.planes(3, 4, 2)
    q = streams.append_index(stream, "v", "id", planes, 2, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in lsh.build(blobs(spark, 20), "v", "id", planes, 2).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("table_id", "hash_key", "vec_id").collect()} == want
    assert streams.match_stream(stream, lsh.build(blobs(spark, 20), "v", "id", planes, 2), "v", "id", planes, 2).isStreaming
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    r = streams.event_statistics(ev).first()
    assert (r.n, r["mean"], r.most) == (2, 2.0, 3.0)


def test_pairs_stacks_and_sparse_steps(spark, monkeypatch):
    df = blobs(spark, 23)
    v = {r.id: np.array(r.v) for r in df.collect()}
    for block in (512, 4):
        monkeypatch.setattr(pairs, "BLOCK", block)
        got = {(r.a, r.b): r.value for r in pairs.matrix(df, "v", "id", ["label"]).collect()}
        assert got == {(a, b): pytest.approx(np.linalg.norm(v[a] - v[b])) for a in v for b in v if a <= b and a % 2 == b % 2}
        index = [tuple(r) for r in pairs.pair_index(df, "id", []).collect()]
        assert len(index) == len(set(index)) == 23 * 24 // 2 and all(a <= b for a, b in index)
    rbf = pairs.matrix(df, "v", "id", ["label"], "rbf", 0.1).filter("a = 0 and b = 2").first().value
    assert rbf == pytest.approx(np.exp(-0.1 * ((v[0] - v[2]) ** 2).sum()))
    with pytest.raises(ValueError):
        pairs.matrix(df, "v", "id", [], "none")
    blocks = select.stack(df, "v", "id", 10)
    assert sorted(len(r.matrix) for r in blocks.collect()) == [3, 10, 10]
    assert sorted(tuple(r) for r in select.unstack(blocks, "id", "v").collect()) == sorted((r.id, r.v) for r in df.collect())
    x = np.outer(np.arange(1, 9), [0.5, 1.0, 1.5, 2.0])
    rows = [(np.flatnonzero((np.arange(4) + i) % 3), x[i][(np.arange(4) + i) % 3 > 0]) for i in range(8)]
    u, m = buckets.sparse_incremental_svd(rows, 4, 1, 500, rate=0.005)
    assert max(abs(x[i, c] - u[i] @ m[:, c]) for i, (at, _) in enumerate(rows) for c in at) < 1.5
    sparse = spark.createDataFrame([(i, [int(c) for c in at], [float(y) for y in ys]) for i, (at, ys) in enumerate(rows)], "id long, i array<int>, x array<double>")
    assert sparse.count() == buckets.sparse_svd_features(sparse, "i", "x", "id", 4, 2, rounds=3).count()
    monkeypatch.setattr(buckets, "WORKER_ROWS", 3)
    monkeypatch.setattr(ranks, "SMALL_BYTES", 0)
    with pytest.raises(ValueError):
        buckets.svd_features(df, "v", "id", 2)


def test_rounds_messages_and_stragglers(spark):
    marks = spark.createDataFrame([(1, 1, "saved"), (1, 2, "saved"), (1, 1, "read"), (1, 2, "read"), (2, 1, "saved"), (2, 1, "saved"), (3, 1, "saved"), (3, 2, "saved"), (3, None, "read")], "round int, edge int, what string")
    assert {(r["round"], r.phase) for r in gossip.round_state(marks, 2).collect()} == {(1, "done"), (2, "open"), (3, "saved")}
    assert gossip.reset_round(marks, 1).count() == 5
    mail = spark.createDataFrame([(1, 2, 0, "b"), (1, 1, 5, "a"), (2, 4, 0, "c")], "dest int, iteration int, seq int, body string")
    assert [tuple(r) for r in gossip.pop(gossip.push(mail, mail.limit(0)), 3).collect()] == [(1, 1, 5, "a")]
    times = spark.createDataFrame([(i, float(t)) for i, t in enumerate([5, 9, 1, 7, 9])], "task int, time double")
    assert {r.task for r in gossip.without_stragglers(times, 3).collect()} == {0, 2} and gossip.without_stragglers(times, 0).count() == 5
    df = spark.createDataFrame([([0.1, 0.7, 0.2], 2), ([0.9, 0.0, 0.1], 3)], "p array<double>, t int")
    assert select.class_error(df, "p", "t").first().mse == 2.0


def test_layered_machines(spark):
    df = blobs(spark, 80, far=3.0).withColumn("y", F.when(F.col("label") == 1, 1.0).otherwise(-1.0)).drop("label")

    def rate(machine):
        m = svm.margins(df, "v", "id", machine.support(spark), "rbf", 0.05)
        return svm.accuracy(df.join(m, "id").withColumn("p", svm.predict(F.col("margin"))), "y", "p").first()[0]

    for method, more in (("slice", {}), ("svd", {"rounds": 3, "ratio": 1}), ("lsh", {"hyper": [lsh.planes(3, 4, 1)]})):
        rows, zips = svm.zipped(df, "v", "y", "id", 10, method, **more)
        assert rows.count() == 80 and zips.count() > 2
        assert rate(svm.zip_svm(rows, zips, "v", "y", "id", 4, 8)) > 0.8
    rows = df.withColumn("zip_id", F.col("id") % 8)
    fine = buckets.centroids(rows, "v", ["zip_id", "y"]).withColumn("parent", F.col("zip_id") % 2)
    coarse = buckets.centroids(rows.withColumn("zip_id", F.col("id") % 2), "v", ["zip_id", "y"])
    assert rate(svm.layered_svm(rows, [coarse, fine], "v", "y", "id", 4, 8)) > 0.8


def test_smaller_forms(spark, tmp_path):
    from granary import session
    from granary.sources import text

    df = blobs(spark, 40)
    planes = lsh.planes(3, 4, 2)
    near = {r.id for r in lsh.same_bits(df, "v", "id", planes, 3).collect()}
    keys = {r.vec_id: r.hash_key for r in lsh.build(df, "v", "id", planes, 1).collect()}
    assert near == {i for i, k in keys.items() if k == keys[3]}
    assert buckets.direct_buckets(df, "v", "id", 10).groupBy("bucket").count().agg(F.max("count")).first()[0] <= 10
    two = buckets.two_levels(df, [F.get("v", F.lit(i)) for i in range(3)], "id", 10).groupBy("coarse", "bucket").count().collect()
    assert len(two) == 8 and all(r["count"] == 5 and r.bucket.startswith(r.coarse) for r in two)
    with pytest.raises(ValueError):
        buckets.two_levels(df, [F.col("id")], "id", 4)
    assert sorted((r.size, r.members[0]) for r in buckets.members_of(df, "id", ["label"]).collect()) == [(20, 0), (20, 1)]
    assert buckets.pure_centroids(df.withColumn("b", F.col("label")), "v", ["b"], "label").count() == 2
    with pytest.raises(Exception, match="several labels"):
        buckets.pure_centroids(df.withColumn("b", F.lit(0)), "v", ["b"], "label").collect()
    assert buckets.hashed_buckets(df, F.xxhash64("v"), "id", "label", 5).groupBy("label", "bucket").count().count() == 8
    x = np.outer(np.arange(1, 9), [0.5, 1.0, 1.5, 2.0])
    far, late = (buckets.incremental_svd(x, 2, 30, trailing=t) for t in (False, True))
    assert not np.array_equal(far[0], late[0])
    assert neural.pool_mean(np.arange(20.0).reshape(4, 5), 2).tolist() == [[3.0, 5.0], [13.0, 15.0]] and neural.unpool(np.eye(2), 2).sum() == 8
    text.write_text(spark.createDataFrame([("a",)], "value string"), str(tmp_path / "t"), True)
    assert "_SUCCESS" in text.list_files(spark, str(tmp_path / "t"))
    assert session.cores(spark) >= 1
    tried = []

    def step(least):
        tried.append(1)
        if len(tried) < least:
            spark.sql("SELECT raise_error('no')").collect()
        return "done"

    assert session.retried(lambda: step(3)) == "done" and len(tried) == 3
    tried.clear()
    with pytest.raises(Exception, match="no"):
        session.retried(lambda: step(9), 2)
    assert len(tried) == 2


def test_pictures_as_samples(spark):
    from granary.sources import binary

    rng = np.random.default_rng(0)
    rows = [(i, float(i % 2 + 1), bytearray(rng.integers(0, 256, 12).astype(np.uint8).tobytes())) for i in range(24)]
    df = spark.createDataFrame(rows, "idx long, label double, pixels binary")
    got = binary.samples(df, [1.0, 2.0, 3.0], [2.0, 2.0, 2.0], "1").orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(0, 24, 2)) and got[0].features[4] == (rows[0][2][4] - 2.0) / 2
    b, g, r = rows[0][2][:3]
    assert binary.grey_samples(df).filter("idx = 0").first().features[0] == pytest.approx(0.3 * r + 0.59 * g + 0.11 * b)
    px = binary.pixel_array(df)
    assert binary.aggregated(px, 4, 3, "1,2", "slice").count() == 24 and binary.aggregated(px, 1, 3, None, "kmeans").count() == 24
