import os

import numpy as np
import pytest

from concord.llm import near_vectors as nv


def brute(ids, x, threshold=0.95):
    ok = np.array([v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x])
    n = len(ids)
    links, part = np.zeros(n, int), list(range(n))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]):
                a, b = (np.array(np.float32(v), dtype=np.float64) for v in (x[i], x[j]))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((find(i), find(j)), key=lambda k: ids[k])
                    part[q] = p
    return {ids[i]: (links[i], ids[find(i)]) for i in range(n)}


def vectors(rng, dim):
    base = rng.standard_normal((60, dim))
    out = [list(map(float, np.float32(base[i % 60] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.25, 0.35])))) for i in range(240)]
    out += [list(map(float, np.float32(base[0] + rng.standard_normal(dim) * 0.12))) for _ in range(80)]
    return out


@pytest.mark.parametrize("block,recall", [(2048, 0.999999), (16, 0.999999), (16, 1)])
def test_against_brute_force(spark, monkeypatch, block, recall):
    monkeypatch.setattr(nv, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = vectors(rng, 64) + vectors(rng, 4)[:60] + [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] * 64, [1.0, None], [-0.0, 0.0]]
    ids = [int(i) * 3 for i in rng.permutation(len(x))]
    df = spark.createDataFrame(list(zip(ids, x, ids)), "vec_id long, embedding array<float>, n_links long").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nv.near(df, recall=recall).collect()}
    assert got == brute(ids, x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in nv.near(df.limit(20)).collect())
    assert nv.near(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_on_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in nv.op8_near_vectors(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_estimates_and_bounds():
    """Codes and steps of pairs at several cosines: right on average, within the bound."""
    rng = np.random.default_rng(8)
    for cosine in (0.0, 0.6, 0.95):
        a = nv.units(rng.standard_normal((2000, 64)))
        side = rng.standard_normal((2000, 64))
        side = nv.units(side - (side * a).sum(axis=1)[:, None] * a)
        b = cosine * a + np.sqrt(1 - cosine**2) * side
        left, right = (nv.decode(nv.encode(x, np.arange(len(x)) + s), 64) for x, s in ((a, 1), (b, 9999)))
        estimate = (left[1] * right[2]).sum(axis=1) / left[0]
        assert abs(estimate.mean() - cosine) < 0.01
        assert all(nv.may_reach(tuple(z[i : i + 1] for z in left), tuple(z[i : i + 1] for z in right), cosine)[0, 0] for i in range(2000))


def test_rows_keys_and_doubles(spark):
    base = [1.0, 2.0, 3.0, 0.5]
    other = [-2.0, 1.0, 0.0, 4.0]
    big = [x * 1e200 for x in other]
    rows = [(5, base), (5, other), (7, [x * 1.01 for x in base]), (8, big), (None, [0.0, 0.0, 0.0, 9.0]), (None, [0.0, 0.0, 0.0, 9.0]), (None, None)]
    got = nv.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 1, -1), (-1, 1, -1), (5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 1, 5)]
