import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from granary.cli import main
from granary.operators import buckets

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_tasks(spark, sf, tmp_path):
    assert "median_split" in main(["list"])["queries"]
    assert main(["query", "median_split", "--dir", sf, "--out", str(tmp_path / "o")])["rows"] == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    exact = main(["kmeans", "--dir", sf, "--k", "3", "--iterations", "2"])["wssse"]
    near = main(["kmeans", "--dir", sf, "--k", "3", "--iterations", "2", "--ratio", "0.5"])["wssse"]
    assert near == pytest.approx(exact, rel=0.2)
    losses = main(["gossip", "--dir", sf, "--edges", "3", "--iterations", "2", "--mode", "ring"])["losses"]
    assert losses[1] < losses[0]


def test_iterative_buckets_stay_below_the_bound(spark):
    df = spark.range(100).select("id", F.array(F.col("id") % 7, F.col("id") % 11).cast("array<double>").alias("v"))
    out = buckets.hash_iterative(df, [F.get("v", F.lit(i % 2)) for i in range(6)], "id", 10)
    sizes = [r["count"] for r in out.groupBy("bucket").count().collect()]
    assert sum(sizes) == 100 and max(sizes) <= 10
    two = out.withColumn("coarse", F.substring("bucket", 1, 2))
    n = buckets.nested(two, "coarse", "bucket").collect()
    assert sum(r.total for r in n) == 100 and all(sum(r.sizes) == r.total for r in n)
    assert buckets.select_members(two, two.filter("id = 0"), ["bucket"]).filter("id = 0").count() == 1


def test_the_rest_stands_without_the_text_operators(tmp_path):
    """The library imports nothing of its optional subpackage."""
    os.symlink(f"{ROOT}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "granary")
    for name in os.listdir(f"{ROOT}/granary"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/granary/{name}", tmp_path / "granary" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
