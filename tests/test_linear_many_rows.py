import numpy as np
import pytest

from lexiprobe.operators import linear


class Held:
    """Rows of one cell in memory, in place of ``linear.Rows``."""

    groups, columns, d, k = [""], ["label"], 2, 1

    def __init__(self, x, y):
        self.y, self.block = y[:, None], linear.Block(np.tile([0, 1], len(x)), x.ravel(), np.full(len(x), 2), 2)

    def zeros(self):
        return np.zeros((1, 3, 1))

    def summed(self, each, width):
        return np.asarray(each(0, self.y, self.block)).reshape(1, width)


@pytest.mark.parametrize("seed", [9, 10, 13, 14])
def test_absolute_penalty_is_met_whatever_the_number_of_rows(seed):
    """The penalty's slope is 1, so a gradient of some share of a large start is no optimum."""
    rng = np.random.default_rng(seed)
    n = int(rng.choice([8000, 30000, 90000, 150000]))
    x = np.stack([np.minimum(rng.exponential(4, n).astype(int), 40), np.where(rng.random(n) < 0.66, np.minimum(rng.exponential(6, n).astype(int), 30), 0)], 1).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [-0.03, 0.047] + 1.8)))).astype(float)
    assert linear.logistic(Held(x, y), c=10.0, penalty="l1").gradient.max() < 1e-3
