"""Vector near-duplicates and integer clustering against all pairs and plain assignment."""

from __future__ import annotations

import hashlib

import numpy as np

from thermaline.llm import pivot_clusters, vector_graph
from thermaline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, node long, shard string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 1, 2, "s", "x") for i, v in rows], SCHEMA)


def brute(rows, cosine=0.95):
    """{row number: (n_links, component)} over all pairs."""
    ok = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v) and any(v):
            ok[n] = np.asarray(v, np.float32).astype(float)
    top = {n: n for n in range(len(rows))}
    links = dict.fromkeys(range(len(rows)), 0)

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine:
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        r = find(n)
        least[r] = i if r not in least or (i is not None and i < least[r]) else least[r]
    return sorted(((i, links[n], least[find(n)]) for n, (i, _) in enumerate(rows)), key=str)


def planted(n=600, dims=16, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims))
    for a in range(0, 200, 10):  # chains, blobs and scaled copies
        x[a + 1] = x[a] + 0.25 * draw.normal(size=dims)
        x[a + 2] = x[a + 1] + 0.25 * draw.normal(size=dims)
        x[a + 3] = 3 * x[a]
    x[300:420] = x[299] + 0.05 * draw.normal(size=(120, dims))
    x[420:460] = x[299] + 0.35 * draw.normal(size=(40, dims))
    x[500:530] = x[498]
    return [(int(i), list(v)) for i, v in zip(draw.permutation(n), x, strict=True)]


def test_links_of_all_pairs(spark):
    rows = planted()
    out = vector_graph.near_duplicates(frame(spark, rows))
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute(rows)


def test_links_over_many_shards(spark):
    rows = planted()
    true = {i: n for i, n, _ in brute(rows)}
    got = {i: n for i, n, _ in vector_graph.near_duplicates(frame(spark, rows), shard=48, rounds=1).collect()}  # the group of 120 spans shards
    assert got.keys() == true.keys() and all(got[i] <= true[i] for i in got)
    assert sum(got.values()) >= 0.98 * sum(true.values())


def test_shards_are_bounded_and_overlap(spark):
    rows = planted(1500)
    nodes = vector_graph.points(spark.createDataFrame([(i, i, -i, [float(e) for e in v]) for i, v in rows], "id long, k1 long, k2 long, x array<double>"))
    got = vector_graph.shards(nodes, 128).toPandas()
    assert got.groupby("shard").size().max() <= 128 and not got.duplicated(["shard", "node"]).any()
    assert (got.groupby("node")["home"].sum() == 1).all() and got.groupby("node").size().min() >= 2


def test_audit_counts_what_is_missed(spark):
    rows = planted()
    df = spark.createDataFrame([(i, i, -i, [float(e) for e in v]) for i, v in rows], "id long, k1 long, k2 long, x array<double>")
    nodes = vector_graph.points(df)
    none = nodes.selectExpr("node", "0L AS n_links")
    assert vector_graph.audited(nodes, none, 0.95) == 0.0
    assert vector_graph.audited(nodes, nodes.selectExpr("node", "1000L AS n_links"), 0.95) == 1.0


def test_search_reaches_all_in_range():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = vector_graph.robust_prune(x)
    assert max(map(len, near)) <= vector_graph.DEGREE
    a = np.repeat(np.arange(400), [len(v) for v in near])
    graph = vector_graph.Graph(x, a, np.concatenate(near))
    true = x @ x.T >= 0.9
    for start in (np.full(400, -1), np.arange(400)):
        found = graph.search(x, start, 0.9)
        assert not (found & ~true).any() and found.sum() >= 0.99 * true.sum()


EDGES = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, None]), (6, [1.0, 0.0, 0.0]),
         (7, [2.0, 0.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, []), (8, [1.0, 0.01]), (-1, [1e30, 1e29]), (10, [1e-30, -0.0])]


def test_vector_edges(spark):
    df = frame(spark, EDGES)
    out = vector_graph.near_duplicates(df)
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute(EDGES)
    one = {r["vec_id"]: r for r in vector_graph.op11(df).collect() if r["vec_id"] != 8}
    assert one[2]["kept"] and one[-1]["kept"] and not one[0]["kept"] and one[None]["component_id"] is None
    assert vector_graph.op11(df.limit(0)).collect() == []
    assert vector_graph.op11(df.where("vec_id in (1, 2)")).count() == 2


def plain(rows, k=40, rounds=5):
    """Assignment of every vector to every centroid, in whole numbers."""
    v = [[int(np.floor(256 * float(np.float32(e)))) for e in x] for _, x in rows]
    order = sorted(range(len(rows)), key=lambda n: (hashlib.sha256(f"2:{rows[n][0]}".encode()).hexdigest(), v[n]))
    c = [v[n] for n in order[:k]]
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
        own = [min(range(len(c)), key=lambda j: (f[j], j)) for f in far]
        if step < rounds:
            for j in range(len(c)):
                mine = [v[n] for n in range(len(v)) if own[n] == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((rows[n][0], own[n], far[n][own[n]]) for n in range(len(rows)))


def test_clusters_of_plain_assignment(spark):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(150, 64)) * draw.choice([0.01, 1, 300], size=(150, 1))
    x[100:120] = x[100]  # ties
    rows = [(n % 140, list(e)) for n, e in enumerate(x)]
    out = pivot_clusters.cluster(frame(spark, rows), k=12, rounds=3).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out) == plain(rows, 12, 3)
    assert {r["inertia"] for r in out} == {sum(r["distance"] for r in out)}
    assert all(len(r["centroid_sha256"]) == 64 for r in out)


def test_bounds_never_exceed_and_prune():
    draw = np.random.default_rng(2)
    v = draw.integers(-(2**27), 2**27, size=(300, 64))
    v[:200] = v[:20].repeat(10, axis=0) + draw.integers(-50, 50, size=(200, 64))
    c, pivots = v[::30].copy(), pivot_clusters.choose_pivots(v[::25])
    cached = np.stack([pivot_clusters.squared(v, p) for p in pivots], axis=1)
    assigner = pivot_clusters.Assigner(c, pivots)
    exact = pivot_clusters.squared(v[:, None, :], c[None, :, :])
    assert (assigner.bounds(cached) <= exact).all()
    own, far, checks = assigner.nearest(v, cached)
    assert (own == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert checks < exact.size


def test_cluster_edges(spark):
    nan = float("nan")
    rows = [(1, [0.5] * 64), (2, [0.5] * 63), (3, None), (4, [nan] * 64), (5, [None] * 64), (6, [1e30] * 64), (None, [0.25] * 64), (1, [0.5] * 64), (7, [-0.001] * 64)]
    out = pivot_clusters.op12(frame(spark, rows)).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["1", "1", "6", "7", "None"]
    assert all(r["distance"] == 0 for r in out)
    assert pivot_clusters.op12(frame(spark, rows).limit(0)).collect() == []


def test_queries_read_all_vectors(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert QUERIES["op11_vector_graph"](spark, sf).count() == n
