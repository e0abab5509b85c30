import os
import subprocess
import sys
from pathlib import Path

import numpy as np

from corpusloom.llm import neighbours

SCHEMA = "vec_id long, vector array<struct<term:int,weight:double>>, cosine string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else list(v), "other") for i, v in vectors], SCHEMA)


def brute(vectors, k, least):
    unit = {}
    for i, v in vectors:
        d = {}
        for e in v or []:
            if e and e[0] is not None and e[1]:
                d[e[0]] = d.get(e[0], 0) + e[1]
        n = np.sqrt(sum(w * w for w in d.values()))
        if n:
            unit[i] = {t: w / n for t, w in d.items()}
    out = {}
    for i, a in unit.items():
        near = sorted((-sum(w * b.get(t, 0) for t, w in a.items()), j) for j, b in unit.items() if j != i)
        out[i] = [(j, -c) for c, j in near if -c >= least][:k]
    return out


def groups(rng, n, size, noise=0.15):
    rows = []
    for g in range(n):
        terms = rng.choice(2000, 20, replace=False)
        base = rng.random(20) + 0.2
        for _ in range(size):
            rows.append([(int(t), float(w)) for t, w in zip(terms, (base + noise * rng.standard_normal(20)) * 10 ** rng.uniform(-2, 2))])
    return list(enumerate(rows))


def test_recall_and_exact_cosines(spark):
    vectors = groups(np.random.default_rng(1), 120, 4)
    want = brute(vectors, 5, 0.5)
    rows = neighbours.nearest(frame(spark, vectors + vectors[:50]), 5, 0.5, leaf=8, block_rows=64).collect()
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour, r.cosine))
    hits = sum(j in {x[1] for x in got.get(i, [])} for i, near in want.items() for j, _ in near)
    assert hits >= 0.95 * sum(map(len, want.values()))
    cosine = {(i, j): c for i, near in brute(vectors, 999, -1).items() for j, c in near}
    assert all(abs(c - cosine[i, j]) < 1e-5 for i, near in got.items() for _, j, c in near)
    assert all([n for n, _, _ in sorted(near)] == list(range(1, len(near) + 1)) for near in got.values())


def test_mutual_pairs(spark):
    vectors = groups(np.random.default_rng(2), 60, 9)
    near = brute(vectors, 5, 0.8)
    want = {(i, j) for i, js in near.items() for j, _ in js if i < j and i in {x for x, _ in near[j]}}
    got = {(r.vec_a, r.vec_b) for r in neighbours.mutual(neighbours.nearest(frame(spark, vectors), 5, 0.8), 0.8).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_copies_ties_and_dirt(spark):
    one = [(1, 1.0), (2, 2.0)]
    vectors = [(n, [(2, 4.0), (1, 2.0)] if n % 2 else one) for n in range(300)] + [(900, [(3, 1.0)]), (901, None), (902, []), (903, [(5, 0.0)]), (904, [None, (None, 1.0), (6, None)]), (905, [(1, 1.0), (2, 1.0), (2, 1.0)]), (906, [(1, 1.0), (2, 1.9)])]
    rows = neighbours.nearest(frame(spark, vectors), 5, 0.5, block_rows=16).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[299] == [0, 1, 2, 3, 4] and got[905] == [0, 1, 2, 3, 4] and got[906] == [0, 1, 2, 3, 4]
    assert not {900, 901, 902, 903, 904} & set(got)
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(1, one)])).count() == 0


def test_forest_leaves_are_balanced_and_own_leaf_comes_first():
    points = np.random.default_rng(0).standard_normal((4096, 64)).astype(np.float32)
    forest = neighbours.Forest.fit(points, trees=3, leaf=16)
    leaves = forest.visit(points, 9)
    assert leaves.shape == (4096, 9) and all(len(set(row)) == 9 for row in leaves[:50].tolist())
    for t in range(3):
        sizes = np.bincount(leaves[:, t] - t * 2**forest.depth, minlength=2**forest.depth)
        assert sizes.max() <= 2 * 16


def test_exact_nearest_gives_every_vector_its_five(spark):
    rng = np.random.default_rng(3)
    vectors = groups(rng, 20, 3) + [(900 + n, [(int(t), 1.0 + n % 3) for t in rng.choice(400, 6, replace=False)]) for n in range(120)] + [(2000, [(9999, 1.0)]), (2001, None), (2002, [(5, 0.0)])]
    vectors += [(3000 + i, v) for i, v in vectors[:10]]
    for block_rows in (50, 10_000):
        got = {}
        for r in sorted(neighbours.exact_nearest(frame(spark, vectors), 5, block_rows=block_rows).collect(), key=lambda r: r.rank):
            got.setdefault(r.vec_id, []).append((r.neighbour, r.cosine))
        every = brute(vectors, 10**6, -1)
        assert set(got) == set(every) and {len(x) for x in got.values()} == {5}
        assert [j for j, _ in got[2000]] == [0, 1, 2, 3, 4]
        for i, near in got.items():
            cosine = dict(every[i])
            assert all(abs(c - cosine[j]) < 1e-5 for j, c in near)
            assert all(abs(c - best) < 1e-5 for (_, c), (_, best) in zip(near, every[i]))


def test_top5_query_has_no_least_cosine(spark, sf):
    from corpusloom.llm import plans
    from corpusloom.sources.tables import table

    some = neighbours.unit_vectors(table(spark, sf, "file_vectors")).count()
    rows = plans.p2_top5(spark, sf)
    assert rows.count() == 5 * some and rows.filter("cosine < 0.5").count() > 0


def test_leaves_split_again_keep_recall(spark, monkeypatch):
    vectors = groups(np.random.default_rng(4), 150, 4)
    want = brute(vectors, 5, 0.5)
    for levels in (6, 2):  # in one pass, and in several
        monkeypatch.setattr(neighbours, "SPLIT_LEVELS", levels)
        assert len(neighbours._levels(600, 2, 8)) == (1 if levels == 6 else 3)
        rows = neighbours.nearest(frame(spark, vectors), 5, 0.5, sample=64, leaf_rows=8).collect()
        got = {}
        for r in rows:
            got.setdefault(r.vec_id, set()).add(r.neighbour)
        assert sum(j in got.get(i, ()) for i, near in want.items() for j, _ in near) >= 0.95 * sum(map(len, want.values()))
    assert neighbours._levels(10**4, 11, 64) == [] and sum(neighbours._levels(10**9, 11, 64)) == 13


def test_executors_need_no_copy_of_the_package(tmp_path, sf):
    """Workers started elsewhere, without the package on their path, run the functions as they are sent to them."""
    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from corpusloom.session import local_session
from corpusloom.llm import plans
spark = local_session(4, "4g")
for name in ("p2_found", "p4_found", "p7_found", "p9_found", "p10_found"):
    assert plans.QUERIES[name](spark, {sf!r}).count() >= 0, name
spark.stop()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-2000:]
