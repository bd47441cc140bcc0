import math

import numpy as np
import pytest

from parcelflow.llm import pitman_yor as P, tables as T


def numbers_of_tables(c, d):
    """log S(c, t) for t = 1 .. c."""
    row = np.array([0.0])
    for n in range(1, c):
        stay = row + np.log(n - d * np.arange(1, n + 1))
        row = np.logaddexp(np.append(stay, -np.inf), np.insert(row, 0, -np.inf))
    return row


@pytest.mark.parametrize("count", [2, 5, 250, 300, 3000, 6000])
@pytest.mark.parametrize("step", [-3.0, 2.0, 4.0, 6.0, 9.0])
def test_draws_follow_the_conditional(count, step):
    t = np.arange(1, count + 1)
    w = numbers_of_tables(count, 0.7) + t * step
    w = np.exp(w - w.max())
    mean = (w * t).sum() / w.sum()
    spread = math.sqrt((w * (t - mean) ** 2).sum() / w.sum())
    got = T.draw(np.full(4000, count), np.full(4000, step), np.random.default_rng(1), 0.7)
    assert got.mean() == pytest.approx(mean, abs=5 * spread / math.sqrt(4000) + 1e-3 * mean)
    assert got.std() == pytest.approx(spread, rel=0.1, abs=0.02)


def test_a_restaurant_of_large_dishes_follows_its_posterior():
    """Mean tables with the query's own burn and kept, dishes of thousands of customers."""
    use = P.Settings()
    counts, base = np.array([4000, 2500]), np.array([0.5, 0.01])
    d, a = use.discount, use.strength
    logs = [numbers_of_tables(int(c), d)[:1200] + np.arange(1, 1201) * math.log(p) for c, p in zip(counts, base)]
    n = np.arange(1, 1201)
    all_ = n[:, None] + n[None, :]
    openings = np.concatenate([[0.0, 0.0], np.cumsum(np.log(a + d * np.arange(1, 2500)))])
    w = logs[0][:, None] + logs[1][None, :] + openings[all_]
    w = np.exp(w - w.max())
    want = np.array([(w.sum(1) * n).sum(), (w.sum(0) * n).sum()]) / w.sum()
    sums = np.zeros(2)
    chains = 60
    for chain in range(chains):
        rng, tables = np.random.default_rng(chain), np.array([1, 1])
        for sweep in range(use.burn + use.kept):
            g = rng.standard_gamma(a / d + tables.sum())
            tables = T.draw(counts, np.log(d * g * base), rng, d)
            if sweep >= use.burn:
                sums += tables / use.kept / chains
    assert sums == pytest.approx(want, rel=0.25)
