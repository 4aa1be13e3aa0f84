"""Vector groups against brute force: recall, no false link, components of the links found."""

import numpy as np

from cohortloom.llm import itq_dedup


def brute(rows, least=0.98):
    usable = {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[n] = np.array(v) / np.linalg.norm(v)
    return {(a, b) for a in usable for b in usable if a < b and rows[a][2] == rows[b][2] and len(usable[a]) == len(usable[b])
            and usable[a] @ usable[b] >= least}


def sample(rng, groups, size, dims=64):
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, size))):
            v = base + rng.standard_normal(dims) * rng.choice([0.0, 0.05, 0.12, 0.3]) * np.linalg.norm(base) / np.sqrt(dims)
            rows.append((len(rows), [float(x) for x in v], int(g % 3)))
    return rows


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    rows = sample(rng, 60, 9) + sample(rng, 1, 2)
    many = sample(rng, 3, 400)  # buckets that take the block way
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows + many)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 as n_links", "'x' as cls")
    got = {r.vec_id: r for r in itq_dedup.near_duplicates(df.repartition(3)).collect()}
    links = brute(rows)
    n_true = np.zeros(len(rows), int)
    for a, b in links:
        n_true[a] += 1
        n_true[b] += 1
    n_got = np.array([got[i].n_links for i in range(len(rows))])
    assert (n_got <= n_true).all() and n_got.sum() >= 0.97 * n_true.sum()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    same = sum(got[i].component_id == find(i) for i in range(len(rows)))
    assert same >= 0.97 * len(rows) and all(find(got[i].component_id) == find(i) for i in range(len(rows)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_small_tiles_give_the_same(spark, monkeypatch):
    rows = sample(np.random.default_rng(4), 2, 300)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = sorted(tuple(r) for r in itq_dedup.near_duplicates(df).collect())
    monkeypatch.setattr(itq_dedup, "TILE", 40)
    assert sorted(tuple(r) for r in itq_dedup.near_duplicates(df).collect()) == want


def test_odd_rows(spark):
    one, big = [1.0, 0.5, 0.25], [1e200, 0.5e200, 0.25e200]
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 2.0], 1), (8, [float("nan")] * 3, 1),
            (9, [float("inf")] * 3, 1), (10, big, 1), (11, [1.0, 0.5], 1), (None, one, 2), (12, [], 1), (13, [-1.0, -0.5, -0.25], 1)]
    got = itq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted([
        (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 1, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 3, 1), (11, 0, 11),
        (None, 1, None), (12, 0, 12), (13, 0, 13)], key=str)
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert itq_dedup.near_duplicates(none).collect() == []
