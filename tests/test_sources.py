import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import vectors as V
from granary.sources import binary, text


@pytest.fixture
def put(tmp_path):
    def write(name, body):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body) if isinstance(body, bytes) else p.write_text(body)
        return str(p)

    return write


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_dense(spark, put):
    assert rows(text.dense_last(spark, put("a.csv", "1,2,3\n\n4,5,6\n")), "label", "features") == [(3.0, [1.0, 2.0]), (6.0, [4.0, 5.0])]
    assert rows(text.dense_mixed(spark, put("b.txt", "1 2,3\n4,5  6\n")), "label", "features") == [(3.0, [1.0, 2.0]), (6.0, [4.0, 5.0])]
    assert rows(text.dense_first(spark, put("c.txt", "1 2 3\n7\n")), "label", "features") == [(1.0, [2.0, 3.0]), (7.0, [])]
    assert rows(text.features_only(spark, put("d.csv", "1,2\n")), "label", "features") == [(0.0, [1.0, 2.0])]
    assert rows(text.features_only(spark, put("d.csv", "1,2\n"), drop_last=True), "features") == [([1.0],)]
    assert rows(text.imagenet(spark, put("e.txt", " 3 1,2, 4 \n")), "label", "features") == [(3.0, [1.0, 2.0, 4.0])]
    tiny = put("tiny.csv", "0,1\n9,1\n10,1\n11,1\n20,1\n")
    assert [r[0] for r in rows(text.tiny_images(spark, tiny), "label")] == [10.0, 9.0, 10.0, 1.0, 10.0]
    assert [r[0] for r in rows(text.tiny_images(spark, tiny, None), "label")] == [0.0, 9.0, 10.0, 11.0, 20.0]


def test_sparse(spark, put):
    path = put("drift.txt", "# note\n\n1;0.5 1:2.5 4:1\n2;0.25\n")
    df = text.drift(spark, path)
    assert rows(df, "label", "indices", "values") == [(1.0, [0, 3], [2.5, 1.0]), (2.0, [], [])]
    assert [r[0] for r in rows(text.drift(spark, path, True), "label")] == [0.5, 0.25]
    assert [r[0] for r in rows(text.wesad(spark, path), "label")] == [2.0, 3.0]
    assert text.dimension(df) == 4 and text.dimension(df.limit(0)) == 0
    assert rows(text.to_dense(df, 4), "features") == [([2.5, 0.0, 0.0, 1.0],), ([0.0] * 4,)]
    with pytest.raises(Exception, match="must rise"):
        text.drift(spark, put("bad.txt", "1;0 3:1 2:1\n")).collect()
    assert text.libsvm(spark, put("s.libsvm", "1 1:2 3:4\n0\n"), 5).first()["features"].size == 5


def test_scaling_uses_training_statistics(spark, put):
    a, b = text.tiny_scaled(spark, put("t.csv", "1,0,5\n12,2,5\n"), put("v.csv", "3,4,6\n"), 10)
    s = 2**0.5
    assert rows(a, "label", "features") == [(1.0, [pytest.approx(-1 / s), 0.0]), (2.0, [pytest.approx(1 / s), 0.0])]
    assert rows(b, "label", "features") == [(3.0, [pytest.approx(3 / s), 0.0])]


def test_ratings_centers_weights(spark, put, tmp_path):
    r = text.ratings(spark, put("ratings.dat", "1::5::3\n1::2::4.5\n1::2::1\n2::7::1\n"))
    assert sorted(rows(text.user_vectors(r), "user", "items", "ratings")) == [(1, [2, 5], [4.5, 3.0]), (2, [7], [1.0])]
    c = put("c.txt", "1,2,9\n3,4,9\n5,6,9\n")
    assert text.centers(spark, c, 2) == [[1.0, 2.0], [3.0, 4.0]] and len(text.centers(spark, c, 9)) == 3
    assert text.centers(spark, put("cs.txt", "0 0:1 2:3\n"), 1, sparse_size=3) == [[1.0, 0.0, 3.0]]
    out = str(tmp_path / "w")
    text.write_weights(spark, [0.1, -2.0], out)
    assert text.read_weights(spark, out) == [0.1, -2.0]
    text.copy_text(spark, out, str(tmp_path / "w2"))
    assert text.read_weights(spark, str(tmp_path / "w2")) == [0.1, -2.0]
    assert text.delete(spark, out) and not text.delete(spark, out)
    text.write_results(spark, [(0.5, 0.9)], "ratio double, accuracy double", str(tmp_path / "res"))
    dump = text.read_dump(spark, put("dump.txt", "1;0.5,1|1;0,1|1;1,1\n")).first()
    assert dump["head"]["features"] == [0.5, 1.0] and len(dump["members"]) == 2


def test_idx(spark, put):
    px = np.arange(2 * 4, dtype=np.uint8)
    img = put("img", struct.pack(">4i", 2051, 2, 2, 2) + px.tobytes())
    lab = put("lab", struct.pack(">2i", 2049, 2) + bytes([0, 9]))
    got = binary.mnist(spark, img, lab).orderBy("idx").collect()
    assert [(r.label, bytes(r.pixels), r.h, r.w) for r in got] == [(1.0, px[:4].tobytes(), 2, 2), (10.0, px[4:].tobytes(), 2, 2)]
    assert binary.pixel_array(binary.mnist(spark, img, lab)).orderBy("idx").first()["features"] == [0.0, 1.0, 2.0, 3.0]
    for bad in (struct.pack(">2i", 2050, 2) + b"\0\1", struct.pack(">2i", 2049, 3) + b"\0\1\2"):
        with pytest.raises(Exception, match="magic|labels"):
            binary.mnist(spark, img, put("badlab", bad)).collect()


def test_cifar(spark, put):
    planes = np.concatenate([np.full(1024, c, np.uint8) for c in (1, 2, 3)])
    path = put("data.bin", b"".join(bytes([y]) + planes.tobytes() for y in (0, 7)))
    got = binary.cifar10(spark, path).orderBy("idx").collect()
    assert [r.label for r in got] == [1.0, 8.0] and bytes(got[0].pixels)[:6] == bytes([3, 2, 1, 3, 2, 1])
    f = binary.normalised(binary.pixel_array(binary.cifar10(spark, path)), [3.0, 2.0, 0.0], [1.0, 1.0, 2.0]).first()["features"]
    assert f[:3] == [0.0, 0.0, 0.5]
    assert binary.labelled(binary.cifar10(spark, path), "8-9").count() == 1
    with pytest.raises(Exception, match="whole records"):
        binary.cifar10(spark, put("short.bin", b"123")).collect()


def test_vector_edges(spark):
    df = spark.createDataFrame([([0, 2], [1.0, 2.0], [2, 5], [2.0, 1.0]), ([0], [1.0], [1], [1.0])], "i array<int>, x array<double>, j array<int>, y array<double>")
    c = df.select(V.cosine_shared(V.sparse(F.col("i"), F.col("x")), V.sparse(F.col("j"), F.col("y"))).alias("c")).collect()
    assert c[0]["c"] == 1.0 and c[1]["c"] is None
    one = spark.range(1)
    losses = [float("nan"), float("inf"), 1.0, None]
    assert [one.select(V.clean_loss(F.lit(x).cast("double"))).first()[0] for x in losses] == [0.0, 0.0, 1.0, 0.0]
    assert one.select(V.safe_double(F.lit("x"))).first()[0] is None and one.select(V.two_digits(F.lit(1.005))).first()[0] in ("1.00", "1.01")
    assert one.select(V.hamming(F.lit(-1), F.lit(0))).first()[0] in (1.0, 0.5)
    assert one.select(V.bhattacharyya(V.literal([0.25, 0.75]), V.literal([0.25, 0.75]))).first()[0] == pytest.approx(1)
    assert one.select(V.resize(V.literal([1]), 3), V.clip(F.lit(99.0))).first()[0:2] == ([1.0, 0.0, 0.0], 30.0)
    assert one.select(V.nll(V.literal([-1.0, -2.0]), F.lit(-1)), V.nll(V.literal([-1.0, -2.0]), F.lit(2), [1, 3])).first()[0:2] == (0.0, 6.0)
    with pytest.raises(ValueError):
        V.kernel("none")
    with pytest.raises(ValueError):
        V.distance(F.lit(1), F.lit(2), "none")
