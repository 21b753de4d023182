"""Dense vector search and clustering."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import vectors as V

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, t):
    """Class pairs with cosine >= t: {(uid, uid): cosine}, both ways."""
    by = {}
    for i, v in rows:
        by.setdefault(tuple(np.float64(np.array(v, dtype=np.float32)) / np.linalg.norm(np.float64(np.array(v, dtype=np.float32)))), []).append(i)
    uid = [min(x) for x in by.values()]
    u = np.array(list(by))
    cos = u @ u.T
    return {(uid[a], uid[b]): cos[a, b] for a, b in zip(*np.nonzero(cos >= t)) if a != b}, dict(zip(uid, map(len, by.values()))), uid, u


def clustered(seed, n=600, dim=8, groups=12, noise=0.25):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dim))
    return [(int(i), (centre[i % groups] + noise * r.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("cells,block", [(None, 4096), (5, 16)])
def test_range_search_is_exact(spark, cells, block):
    """Also where rings and query sides are cut into several blocks."""
    rows = clustered(1) + [(1000 + i, clustered(1)[7][1]) for i in range(200)]
    classes, members = V.classes_of(V.unit_vectors(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    index = V.build_index(classes, cells, block=block)
    got = {(r.qid, r.uid): (r.cosine, r.mult) for r in V.similar_vectors(index, 0.9, block).collect()}
    want, mult, _, _ = brute(rows, 0.9)
    assert set(got) == set(want) and len(want) > 1000
    assert all(abs(got[p][0] - want[p]) < 1e-9 and got[p][1] == mult[p[1]] for p in want)
    assert {r.uid for r in members.filter("id >= 1000").collect()} == {7}


def test_bound_leaves_rings_out(spark):
    """On data with groups, most blocks are never asked for."""
    rows = clustered(2, n=900, groups=30, noise=0.05)
    index = V.build_index(V.classes_of(V.unit_vectors(spark.createDataFrame(rows, SCHEMA)))[0])
    queries = V._queries(index)
    asked = V._asked_rings(queries, index, math.acos(0.95), None).count()
    assert asked < 0.2 * queries.count() * index.rings.count()


def test_queries_are_the_marked_classes(spark):
    rows = clustered(3, n=200) + [(301, clustered(3, n=200)[50][1]), (350, clustered(3, n=200)[51][1])]
    classes, _ = V.classes_of(V.unit_vectors(spark.createDataFrame(rows, SCHEMA)), F.col("id") % 50 == 0)
    got = {(r.qid, r.uid) for r in V.similar_vectors(V.build_index(classes), 0.8).collect()}
    want = {p for p in brute(rows, 0.8)[0] if p[0] % 50 == 0 or p[0] == 51}     # 350 is a copy of 51
    assert got == want and any(q == 51 for q, _ in got)


def brute_nearest(uid, u, k, ask=lambda i: True):
    cos, out = u @ u.T, {}
    for a, i in enumerate(uid):
        if ask(i):
            out[i] = [j for _, j in sorted((-cos[a, b], uid[b]) for b in range(len(uid)) if b != a)[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_nearest_in_all_cells_is_exact(spark, block):
    rows = clustered(4, n=150)
    index = V.build_index(V.classes_of(V.unit_vectors(spark.createDataFrame(rows, SCHEMA)))[0], cells=7, block=block)
    got = {}
    for r in V.nearest_vectors(index, 5, 7, block).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.uid)
    _, _, uid, u = brute(rows, 2)
    assert got == brute_nearest(uid, u, 5)
    bounded = {}
    for r in V.exact_neighbours(index, 5, 1, block).orderBy("qid", "rank").collect():
        bounded.setdefault(r.qid, []).append(r.uid)
    assert bounded == got


def test_measured_recall_holds(spark):
    """Over the table: the probes found give nine tenths of the true neighbours."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = V.build_index(V.classes_of(V.unit_vectors(table), F.col("id") % 50 == 0)[0])
    probes, recall = V.probes_for(index, 10)
    assert recall >= 0.9 and probes < len(index.centre)
    _, _, uid, u = brute([(r.vec_id, list(r.embedding)) for r in table.collect()], 2)
    want = brute_nearest(uid, u, 10, lambda i: i % 50 == 0)
    hits = sum(r.uid in want[r.qid] for r in V.nearest_vectors(index, 10, probes).collect())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, [1.0]), (None, [1.0, 0.1]), (9, [None, 1.0]), (10, [1.0, 0.01]), (10, [1.0, 0.01])]
    classes, members = V.classes_of(V.unit_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((r.id, r.uid) for r in members.collect()) == [(1, 1), (2, 1), (10, 10), (10, 10)]
    assert {(r.qid, r.uid, r.mult) for r in V.similar_vectors(V.build_index(classes), 0.9).collect()} == {(1, 10, 2), (10, 1, 2)}
    for none in ([], rows[2:5]):
        classes, _ = V.classes_of(V.unit_vectors(spark.createDataFrame(none, SCHEMA)))
        index = V.build_index(classes)
        assert classes.count() == 0 and V.probes_for(index, 10) == (1, 1.0)
        assert V.similar_vectors(index, 0.5).count() == 0 and V.nearest_vectors(index, 10, 1).count() == 0
    assert V.dense_clusters(spark.createDataFrame(rows, SCHEMA), 0.9, 4).select("label").distinct().collect()[0].label == 1


@pytest.mark.parametrize("numbers", [None, 300])
def test_clusters_are_found_without_their_pairs(spark, monkeypatch, numbers):
    """Equal to brute force, with border and noise rows and copies; the links that
    labels run over grow with the classes, not with the pairs of a group."""
    from murmur.operators import cluster
    t, least = 0.9, 5
    rows = clustered(5, n=700, groups=4) + clustered(6, n=60, groups=60)
    rows = [(i, v) for i, (_, v) in enumerate(rows)] + [(2000 + k, rows[3][1]) for k in range(20)]
    pairs, mult, uid, _ = brute(rows, t)
    near = {i: {b for a, b in pairs if a == i} for i in uid}
    core = {i for i in uid if mult[i] + sum(mult[j] for j in near[i]) >= least}
    want = {}
    for i in sorted(core):
        todo = [] if i in want else [i]
        while todo:
            if (j := todo.pop()) not in want:
                want[j] = i
                todo += near[j] & core
    border = {i: min(want[j] for j in near[i] & core) for i in uid if i not in core and near[i] & core}
    assert border and len(core) + len(border) < len(uid) and len(pairs) > 80_000
    links, components = [], cluster.connected_components
    monkeypatch.setattr(cluster, "connected_components", lambda n, e: links.append(e.count()) or components(n, e))
    got = V.dense_clusters(spark.createDataFrame(rows, SCHEMA).repartition(5), t, least, **{"numbers": numbers} if numbers else {})
    assert {r.id: r.label for r in got.collect()} == want | border | {2000 + k: want[3] for k in range(20)}
    assert links[0] < len(pairs) / 2
    assert links[0] <= 2 * len(core) * (V._parts(spark.createDataFrame([(i, [0.0] * 8) for i in core], "uid long, u array<double>"), numbers or V.PART) + 1)
