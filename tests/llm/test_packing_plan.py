import numpy as np
import pytest

from vecscore.llm import packing


@pytest.mark.parametrize("seed,n", [(1, 50), (2, 3000), (3, 60000)])
def test_plan_packs_all_and_comes_near_the_bound(seed, n):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, 1 + rng.lognormal(6, 1, n).astype(int))
    h = np.bincount(lengths, minlength=2049)
    plan = packing.plan_sequences(h, 2048)
    back = np.zeros(2049, int)
    for kinds, times in plan:
        assert sum(kinds) <= 2048 and times > 0
        for k in kinds:
            back[k] += times
    assert np.array_equal(back, h)
    used, bound = sum(t for _, t in plan), -(-int(lengths.sum()) // 2048)
    assert used <= bound * 1.02 + 2
    s = packing.slots(plan)
    assert len(s["length"]) < 40 * 2048


def test_least_squares_is_nonnegative_and_exact_where_it_can_be():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [1, 1, 0]])
    x = packing.nnls(a, a @ np.array([3.0, 0, 2]))
    assert np.allclose(x, [3, 0, 2]) and (x >= 0).all()


def test_patterns_are_all_partitions():
    found = packing.patterns(12, 3)
    assert len(found) == len(set(found)) == 19 and all(sum(p) == 12 for p in found)
