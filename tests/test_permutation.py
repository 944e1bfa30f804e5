"""The computed permutation: a bijection, its own inverse, different by pass, without visible order."""

import numpy as np
import pytest

from weftline.functions.permutation import PRIME, permuted, place_of


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 4097])
def test_every_place_once(n):
    for seed, epoch in [(0, 0), (0, 1), (42, 0)]:
        got = permuted(np.arange(n), n, seed, epoch)
        assert sorted(got.tolist()) == list(range(n))
        assert (place_of(got, n, seed, epoch) == np.arange(n)).all()


def test_orders_differ_and_mix():
    n = 50_000
    a, b = permuted(np.arange(n), n, 1, 0), permuted(np.arange(n), n, 1, 1)
    assert (a == b).mean() < 0.001 and (a == np.arange(n)).mean() < 0.001
    assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.02 and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.02
    counts = np.histogram(a[: n // 10], 10)[0]
    assert np.abs(counts - n / 100).max() < 6 * np.sqrt(n / 100)


def test_large_ranges_and_the_limit():
    n = 10**15 + 7
    x = np.array([0, 1, 12345678901234, n - 1])
    assert (place_of(permuted(x, n, 3, 4), n, 3, 4) == x).all() and (permuted(x, n, 3, 4) < n).all()
    with pytest.raises(ValueError, match="too large"):
        permuted(x, PRIME**2 + 1, 3, 4)
    assert permuted(np.array([], np.int64), 0, 1, 1).size == 0
