import math

import pytest

from leitmotiv.functions.stop import collision_probability, miss_probability, normal_cdf
from leitmotiv.functions.symbols import breakpoints


def test_collision_probability():
    assert collision_probability(0, 4) == 1
    values = [collision_probability(x, 8) for x in (0.5, 1, 2, 4, 8, 16, 64)]
    assert values == sorted(values, reverse=True) and all(0 <= p <= 1 for p in values)
    assert math.isclose(collision_probability(8, 8), 0.3687, abs_tol=1e-4)


def test_cdf():
    assert math.isclose(normal_cdf(1.96), 0.9750021, abs_tol=1e-6) and normal_cdf(0) == 0.5


@pytest.mark.parametrize("rule", ["matching", "product"])
def test_miss_probability_falls(rule):
    by_j = [miss_probability([2, 2], 8, 0, j, 8, 200, rule) for j in (1, 10, 100, 200)]
    assert by_j == sorted(by_j, reverse=True)
    assert miss_probability([0, 0], 8, 0, 1, 8, 200, rule) == 0
    assert miss_probability([4, 4], 8, 0, 200, 8, 200, "product") < miss_probability([4, 4], 8, 0, 200, 8, 200, "matching")


def test_breakpoints():
    assert breakpoints(4) == [-0.67449, 0.0, 0.67449]
