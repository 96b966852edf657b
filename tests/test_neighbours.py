"""Comparison of leaves in single precision against plain distances."""

import numpy as np
import pytest

from lanlore.operators import knn

RNG = np.random.default_rng(1)
CLOUDS = {
    "copies and ties": (RNG.normal(size=(1300, 3)).round(1), RNG.normal(size=(2500, 3)).round(1)),
    "far from the origin": (1e6 + RNG.normal(size=(700, 5)) * 1e-3, 1e6 + RNG.normal(size=(3000, 5)) * 1e-3),
    "one far away": (np.r_[RNG.normal(size=(600, 4)), [[1e9] * 4]], RNG.normal(size=(2000, 4))),
    "fewer than a leaf": (RNG.normal(size=(50, 4)), RNG.normal(size=(2, 4))),
    "not a number": (RNG.normal(size=(600, 4)), np.r_[RNG.normal(size=(1500, 4)), [[np.nan] * 4]]),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_leaves_match_plain_distances(name):
    queries, references = CLOUDS[name]
    plain = np.concatenate([knn.distances(queries[i : i + 50], references) for i in range(0, len(queries), 50)])
    pairing, ties, k = knn.Pairing(queries, references), RNG.permutation(len(references)), min(4, len(references))
    a, b, d = (np.concatenate(c) for c in zip(*pairing.best(k, ties)))
    order = np.argsort(a, kind="stable")
    want = np.array([np.lexsort((ties, row))[:k] for row in plain])
    assert (b[order].reshape(-1, k) == want).all() and np.array_equal(d[order].reshape(-1, k), np.take_along_axis(plain, want, 1), equal_nan=True)
    for eps in (0.0, np.nanmedian(plain.min(axis=1)), np.nanmedian(plain), 2 * np.nanmax(plain)):
        near = np.zeros(plain.shape, bool)
        for rows, span, hit in pairing.within(eps):
            near[np.ix_(pairing.q.at[rows], pairing.r.at[span])] = True if hit is None else hit
        assert (near == (plain <= eps)).all()


def test_a_vector_without_numbers_hides_no_neighbours(spark):
    data = [(i, [float(i), 0.0]) for i in range(20)] + [(20, [float("nan"), 0.0])]
    df = spark.createDataFrame(data, "id long, features array<double>")
    got = {r["id"]: [n["id"] for n in r["neighbors"]] for r in knn.nearest(df, df, 2).collect()}
    assert got[0] == [1, 2] and all(got[i] == [i - 1, i + 1] for i in range(1, 19))


def test_true_pairs_are_found_eight_at_a_time():
    for shape in ((3, 5), (1, 7), (8, 8), (512, 1001), (4, 0)):
        for share in (0.0, 0.01, 1.0):
            hit = RNG.random(shape) < share
            assert all(np.array_equal(a, b) for a, b in zip(knn.pairs_of(hit), np.nonzero(hit)))


def test_limits_come_from_a_few_folded_columns():
    half = RNG.normal(size=(40, 1001)).astype(np.float32)
    for k in (1, 4, 300):
        few = knn.folded(half, k)
        assert few.shape[1] >= k and (np.partition(few, k - 1, axis=1)[:, k - 1] >= np.partition(half, k - 1, axis=1)[:, k - 1]).all()
    assert knn.folded(half, 4).shape[1] < 2 * knn.FOLDED


def test_small_blocks_try_all_their_leaves(monkeypatch):
    """A limit from one leaf of eight would leave eight times as many pairs to measure."""
    x = RNG.normal(size=(6400, 64))
    pairing = knn.Pairing(x[:512], x)
    measured, real = [], knn.Pairing.exact
    monkeypatch.setattr(knn.Pairing, "exact", lambda self, a, b: measured.append(len(a)) or real(self, a, b))
    found = sum(len(a) for a, _, _ in pairing.best(4, np.arange(len(x))))
    assert found == 4 * 512 and sum(measured) < 6 * 512
