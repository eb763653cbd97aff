"""Command line: run a registered query, or a trainer, over a folder of tables.

    python -m granary.cli query median_split --dir /data/sf0.1 --out /tmp/out
    python -m granary.cli kmeans --dir /data/sf0.1 --k 4 --iterations 5 --ratio 0.5
    python -m granary.cli gossip --dir /data/sf0.1 --edges 4 --mode ring
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from granary.functions.vectors import dense
from granary.operators import buckets, cluster, gossip, neural
from granary.plans.queries import Q
from granary.session import get_spark, load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="granary")
    p.add_argument("task", choices=["query", "kmeans", "gossip", "list"])
    p.add_argument("name", nargs="?")
    p.add_argument("--dir")
    p.add_argument("--out")
    p.add_argument("--master")
    p.add_argument("--k", type=int, default=4)
    p.add_argument("--iterations", type=int, default=5)
    p.add_argument("--ratio", type=float, default=1.0)
    p.add_argument("--upper", type=int, default=20, help="rows of a bucket, about")
    p.add_argument("--edges", type=int, default=4)
    p.add_argument("--mode", choices=["scored", "pairs", "ring"], default="scored")
    p.add_argument("--skip-prob", type=float, default=0.05)
    p.add_argument("--critical", type=float)
    p.add_argument("--step", type=float, default=0.1)
    p.add_argument("--seed", type=int, default=1)
    return p


def main(argv=None) -> dict:
    a = parser().parse_args(argv)
    if a.task == "list":
        print("\n".join(sorted(Q)))
        return {"queries": sorted(Q)}
    spark = get_spark("granary", a.master)
    if a.task == "query":
        df = Q[a.name](spark, a.dir)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        said = {"query": a.name, "rows": spark.read.parquet(a.out).count() if a.out else df.count()}
    else:
        rows = load(spark, a.dir, "embeddings").select("vec_id", dense("embedding").alias("v"), "label")
        if a.task == "kmeans":
            start = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(a.seed))).limit(a.k).collect()]
            if a.ratio >= 1:
                centers = cluster.kmeans(rows, "v", start, a.iterations)
            else:
                bucketed = buckets.aggregate_points(rows, "v", "vec_id", "label", a.upper, 10, "slice")
                bucketed = bucketed.withColumn("zip_id", F.concat_ws(":", F.col("category").cast("string"), "bucket"))
                zips = buckets.centroids(bucketed, "v", ["category", "zip_id"])
                centers = cluster.approximate_kmeans(bucketed, zips, "v", "vec_id", start, a.iterations, a.ratio, "category")
            said = {"wssse": cluster.wssse(rows, "v", centers).first()[0], "ratio": a.ratio, "centers": centers}
        else:
            df = rows.withColumn("edge", F.pmod(F.xxhash64("vec_id"), F.lit(a.edges)) + 1)
            size = rows.agg(F.max(F.size("v")), F.max("label")).first()
            cfg = gossip.GossipConfig(a.edges, a.iterations, skip_prob=a.skip_prob, critical=a.critical, seed=a.seed, step=a.step)
            _, history = gossip.train(df, neural.Perceptron([size[0], size[1] + 1]), "v", "label", "edge", cfg, a.mode)
            said = {"mode": a.mode, "losses": history}
    print(json.dumps(said))
    return said


if __name__ == "__main__":
    main()
