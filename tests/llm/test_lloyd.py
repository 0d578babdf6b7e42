"""Sharded Lloyd against plain loops on integers."""

import hashlib
import math
import random

from oracle import same_rows

from deskmatch.llm import lloyd
from deskmatch.llm import queries as registered


def plain(rows, k, rounds, seed, dimensions, scale=1024, most=1 << 27):
    """id, cluster and distance by the contract, and the centroids."""
    kept = [(d, [max(-most, min(most, math.floor(scale * x))) if abs(x) * scale < most else (most if x > 0 else -most) for x in v]) for d, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return min(far), far.index(min(far))

    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), at in zip(kept, found) if at == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((d, near(v)[1], near(v)[0]) for d, v in kept), key=repr), centroids


def test_registered_query_equals_its_sql(spark, small):
    same_rows(registered.op11_sharded_lloyd(spark, small), lloyd.sql(), small)


def test_edge_cases(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows += [(None, [0.5] * 6), (7, rows[7][1]), (7, [0.1] * 6), (70, None), (71, []), (72, [0.0] * 5), (73, [0.0] * 5 + [None]), (74, [float("nan")] * 6), (75, [float("inf")] + [0.0] * 5), (76, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0]), (77, [-0.0001] * 6)]
    df = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<double>, id int, packet string")
    for k, columns in ((3, 4), (8, 6), (100, 1)):
        found, centroids = lloyd.cluster(df, clusters=k, rounds=4, dimensions=6, columns=columns)
        want, plain_centroids = plain(rows, k, 4, "3:", 6)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
        assert centroids.tolist() == plain_centroids
    assert lloyd.with_inertia(*lloyd.cluster(df.filter("false"), dimensions=6)).count() == 0
    assert {t.name for t in spark.catalog.listTables()} == set()


def test_ties_repeated_rows_and_ids_that_are_names(spark):
    rows = [(f"n{i % 5}", [float(i % 2), 0.0]) for i in range(40)]
    found, centroids = lloyd.cluster(spark.createDataFrame(rows, "vec_id string, embedding array<float>"), clusters=4, rounds=3, dimensions=2, columns=1)
    want, plain_centroids = plain(rows, 4, 3, "3:", 2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want and centroids.tolist() == plain_centroids


def test_inertia_and_hashes(spark):
    rows = [(i, [i / 7.0, -i / 3.0]) for i in range(20)]
    found, centroids = lloyd.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=3, rounds=2, dimensions=2)
    got = lloyd.with_inertia(found, centroids).collect()
    for r in got:
        assert r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster) and r.inertia == sum(x.distance for x in got)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()
