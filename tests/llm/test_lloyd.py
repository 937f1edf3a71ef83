import hashlib

import numpy as np
import pytest

from corpusloom.llm import lloyd


def plain_nearest(points, centroids):
    return ((points[:, None] - centroids[None]) ** 2).sum(2).argmin(1)


def plain_lloyd(rows, k, rounds, dims, scale, seed="3"):
    kept = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    if not kept:
        return []
    c, p = np.array([r[1] for r in start]), np.array([r[1] for r in kept])
    for _ in range(rounds):
        at = plain_nearest(p, c)
        c = np.array([p[at == j].sum(0) // (at == j).sum() if (at == j).any() else c[j] for j in range(len(c))])
    at = plain_nearest(p, c)
    d = ((p - c[at]) ** 2).sum(1)
    return [(i, int(j), int(x), int(d[at == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for (i, _), j, x in zip(kept, at, d)]


@pytest.mark.parametrize("seed", range(60))
def test_tree_and_search_against_plain(seed):
    rng = np.random.default_rng(seed)
    n, dims, k = int(rng.integers(1, 200)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
    p = rng.integers(-6, 6, (n, dims)) if seed % 3 else np.repeat(rng.integers(-6, 6, (1, dims)), n, 0)
    if seed % 5 == 0:
        p = p * (1 << 22) + rng.integers(-2, 2, p.shape)
    c = p[rng.integers(0, n, k)]
    tree, order = lloyd.cover_tree(p)
    assert sorted(order) == list(range(n))
    q = p[order]
    for a, b, r, first, m in zip(*tree):
        away = np.sqrt(((q[a:b] - q[a]).astype(float) ** 2).sum(1))
        assert away.max() <= r + 1e-6 * (1 + np.abs(q).max())
        if m:  # children cover their parent in order and are apart
            assert tree.start[first] == a and tree.end[first + m - 1] == b and (tree.start[first + 1 : first + m] == tree.end[first : first + m - 1]).all()
        else:
            assert (q[a:b] == q[a]).all()
    begin, label, _ = lloyd.nearest(q, tree, c)
    assert begin[0] == 0 and (np.repeat(label, np.diff(begin, append=n)) == plain_nearest(q, c)).all()


def test_search_prunes_clustered_points():
    rng = np.random.default_rng(1)
    heads = rng.integers(-1000, 1000, (8, 16))
    p = np.repeat(heads, 100, 0) + rng.integers(-5, 5, (800, 16))
    tree, order = lloyd.cover_tree(p)
    begin, _, compared = lloyd.nearest(p[order], tree, heads)
    assert len(begin) < 100 and compared == 0  # whole nodes were assigned


def run(spark, rows, kind="long", **options):
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, cluster string, distance date, place int, n int")
    return sorted(map(tuple, lloyd.lloyd(df, **options).collect()), key=repr)


def test_rows_against_plain(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=4).round(2).tolist()) for i in range(90)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, [9.0, 0.0, 0.0, 0.0]), (None, [0.5] * 4), (None, [0.5] * 4)]  # repeated and missing keys
    rows += [(500 + i, [0.25, -0.75, 0.1, 0.0]) for i in range(60)]  # one vector many times
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0])]
    wide = [(*r, "x", None, 1, None) for r in rows]
    for options in ({"k": 5, "rounds": 4}, {"k": 1, "rounds": 2}, {"k": 400, "rounds": 1}):
        want = plain_lloyd(rows, dims=4, scale=16, **options)
        assert run(spark, wide, dims=4, scale=16, **options) == sorted(want, key=repr)


def test_empty_strings_and_large(spark):
    assert run(spark, [], dims=4) == []
    assert run(spark, [(1, None, "x", None, 1, None)], dims=4) == []
    got = run(spark, [("a", [0.5], "x", None, 1, None), ("b", [-0.5], "x", None, 1, None)], kind="string", dims=1, k=2, rounds=3, scale=3)
    assert [r[0] for r in got] == ["a", "b"] and {r[2] for r in got} == {0}
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e30], "x", None, 1, None)], dims=1)
