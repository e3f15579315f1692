"""Running values in two levels, over groups that are dealt to several ranges."""

import random

from pyspark.sql import functions as F

from vellum.operators import conformance as C
from vellum.operators.scans import scan


def test_scan(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, None, 1, 2, 3])) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.at: (r.nth_is_first, r.before, r.total, r.seen) for r in scan(df, "g", ["at"], previous={"before": F.col("v")}, sums={"total": F.col("v")}, lasts={"seen": F.col("v")}).collect()}
        runs = sorted((r.g or "", r.run, r.value, r.length) for r in C.runs(df, "g", ["at"], "v").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, lengths = {}, []
    for g in ("hot", "a", "b", None):
        before = total = seen = None
        n = 0
        for x, at, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            first = n == 0 and before is None and not any(w[0] == (g or "") for w in lengths)
            total, seen = (total if v is None else (total or 0) + v), v if v is not None else seen
            want[at] = (first, before, total, seen)
            if first or v != before:
                lengths.append([g or "", sum(w[0] == (g or "") for w in lengths) + 1, v, 0])
            lengths[-1][3] += 1
            before = v
    assert got == want
    key = lambda r: (r[0], r[1])
    assert sorted(runs, key=key) == sorted(map(tuple, lengths), key=key)


def test_means_of_clusters(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 9.0, 20.0, 21.0)], "g string, x double")
    got = [(r.cluster, r.low, r.high, r.n, r["mean"]) for r in C.clusters(df, "g", "x", 6.0, mean=True).orderBy("cluster").collect()]
    assert got == [(1, 1.0, 2.0, 3, 5 / 3), (2, 9.0, 9.0, 1, 9.0), (3, 20.0, 21.0, 2, 20.5)]
