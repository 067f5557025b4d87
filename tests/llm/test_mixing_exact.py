import random

import pytest

from contactloom.llm.mixing import fit_budget


def total(take):
    return sum(s * n for s, n in take.items())


@pytest.mark.parametrize(
    "sizes,budget,best",
    [
        ([(70_000, 10), (100_000, 10)], 210_000, 210_000), ([(40_000, 6), (70_001, 6)], 280_000, 270_001),
        ([(70_001, 10), (100_003, 10)], 210_003, 210_003), ([(300_007, 4), (500_009, 3)], 1_299_999, 1_200_028), ([(100_000, 5)], 99_999, 0),
    ],
)
def test_sums_of_long_texts_are_as_near_as_can_be(sizes, budget, best):
    assert total(fit_budget(sizes, budget)) == best


@pytest.mark.parametrize("exact", [0, 1, 7, 20, 1 << 16])
def test_every_first_programme_gives_the_best_sum(exact):
    rng = random.Random(exact)
    for _ in range(150):
        sizes = [(s, rng.randint(1, 6)) for s in rng.sample(range(0, 60), rng.randint(0, 6))]
        budget = rng.randint(0, 500)
        reach = {0}
        for s, n in sizes:
            reach = {r + s * k for r in reach for k in range(n + 1)}
        take = fit_budget(sizes, budget, exact)
        assert all(0 <= n <= dict(sizes)[s] for s, n in take.items())
        assert total(take) == max(r for r in reach if r <= budget)
