"""Bit-sliced search against sorting all inner products."""

import math

import numpy as np

from cohortloom.llm import bit_sliced


def brute(rows, every=50, k=5):
    ints = [(i, np.array([math.floor(256 * x) for x in v])) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ints:
        if q % every == 0:
            best = sorted((-int(a @ b), i) for i, b in ints if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_slices_add_up():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, (130, 7))
    planes = bit_sliced.slices_of(values)
    total = bit_sliced.added([[planes[:, b]] for b in range(planes.shape[1])], planes.shape[2])
    bits = np.unpackbits(total.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
    assert ((bits << np.arange(len(bits))[:, None]).sum(axis=0) == values.sum(axis=1)).all()


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.2, 16))]) for i in range(700)]
    rows += [(700 + i, rows[i % 3][1]) for i in range(12)]
    rows += [(1000, None), (1001, [1.0, None]), (1050, [float("nan")] * 16), (None, rows[1][1]), (1100, []), (1150, [1e3, -5.0]), (1151, [0.0, -1e3]),
             (1152, [2.5, 2.5]), (1200, [0.0] * 16), (1201, [float("-inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as rank", "'x' as v", "2 as tile")
    got = bit_sliced.nearest(df.repartition(3)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows)
    assert bit_sliced.nearest(df.limit(0)).collect() == []


def test_repeated_rows(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    got = bit_sliced.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(50, 1, 1, 32768), (50, 2, 1, 32768)]
