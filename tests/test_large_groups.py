"""Operators on large groups: what they keep in memory and on disk, and the same results by other block sizes."""

import duckdb
import numpy as np
import pytest

from granary.operators import pairs, svm
from granary.plans import checked  # noqa: F401  registers its queries
from granary.plans.queries import Q, SQL

EMB = "vec_id long, embedding array<float>, label int"


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i // 2 if i < 12 else i, [float(np.float32(x)) for x in rng.standard_normal(4)], i % 3) for i in range(40)]  # keys 0 to 5 twice
    rows += [(50, None, 0), (51, [1.0, None, 2.0, 0.5], 1), (52, [1.0, 2.0], 1), (53, [], 2), (None, [1.0] * 4, 0), (54, [1.0] * 4, None)]
    rows += [(60, [4096.0, 1.0, 0.0, 0.0], 4), (61, [4096.0, 1.5, 0.0, 0.0], 4), (62, [-4096.0, 1.5, 0.25, 0.0], 4), (70, None, 5), (71, None, 5)]
    return rows + [(80, [1.0, 1.0, 2.0, 2.0], 6)] * 7


@pytest.mark.parametrize("block", [4096, 5, 1])
def test_kernel_sums_of_odd_rows_match_sql(spark, tmp_path, monkeypatch, block):
    """Repeated keys across blocks and groups, null vectors, elements, keys and groups, vectors of other lengths or far away."""
    monkeypatch.setattr(pairs, "SUM_BLOCK", block)
    monkeypatch.setattr(pairs, "SUM_STEP", 3)
    spark.createDataFrame(odd_rows(), EMB).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(r[0], r[2]): r[1] for r in con.sql(f"SELECT label, total, pairs FROM ({SQL['kernel_sums']})").fetchall()}
    got = {(r["label"], r["pairs"]): r["total"] for r in Q["kernel_sums"](spark, str(tmp_path)).collect()}
    assert got == {k: v if v is None else pytest.approx(v, abs=1.5e-4) for k, v in want.items()}


def test_kernel_sums_move_rows_not_pairs(spark, tmp_path):
    """No join of rows with rows: what is moved is a row once for each block of its group."""
    n = 3000
    rows = spark.range(n).selectExpr("id AS vec_id", "transform(sequence(1, 4), i -> float((id * i) % 7)) AS embedding", "0 AS label")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    df = Q["kernel_sums"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    x = np.array([[(i * j) % 7 for j in range(1, 5)] for i in range(n)], float)
    k = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(2))
    r = df.first()
    assert (r["total"], r["pairs"]) == (pytest.approx(k[np.triu_indices(n)].sum(), abs=1e-3), n * (n + 1) // 2)


def gap(x, y, a, c=1.0):
    """Violation of the optimum that is left, and the dual objective."""
    f = svm.kernel_matrix("rbf", 0.05, x, x) @ (a * y) - y
    up, low = svm._open(y, a, c)
    return f[low].max() - f[up].min(), a.sum() - 0.5 * ((f + y) * a * y).sum()


@pytest.mark.parametrize("started", [False, True])
def test_machines_of_many_rows_hold_slices_of_the_kernel_and_reach_the_optimum(monkeypatch, started):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((700, 6)), np.where(rng.random(700) < 0.5, 1.0, -1.0)  # nearly every row becomes a support vector
    start = np.full(700, 0.25) if started else None
    whole, b = svm.smo(x, y, start=start)
    largest, plain = [], svm.kernel_matrix
    monkeypatch.setattr(svm, "WORKING", 64, raising=False)
    monkeypatch.setattr(svm, "SLICE", 32, raising=False)
    monkeypatch.setattr(svm, "kernel_matrix", lambda n, g, p, q: largest.append(len(p) * len(q)) or plain(n, g, p, q))
    a, b2 = svm.smo(x, y, start=start)
    assert max(largest) <= 64 * 64
    assert a.min() >= -1e-9 and a.max() <= 1 + 1e-9 and abs(((a - (0 if start is None else start)) * y).sum()) < 1e-9
    assert gap(x, y, a)[0] <= 2e-3 + 1e-9 and gap(x, y, a)[1] == pytest.approx(gap(x, y, whole)[1], rel=1e-4)
    assert b2 == pytest.approx(b, abs=5e-3)
