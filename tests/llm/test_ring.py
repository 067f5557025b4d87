import numpy as np
import pytest

from contactloom.llm.neardup import ring_candidates


def close(p, q, quota):
    n = len(p)
    return {(i, j) for i in range(n) for j in range(i + 1, n) if abs(p[i] - p[j]) <= quota and abs(q[i] - q[j]) <= quota}


@pytest.mark.parametrize("quota", [0, 1, 3, 5])
def test_chains_prune_candidates_and_lose_no_match(quota):
    rng = np.random.default_rng(quota)
    points = np.unique(rng.integers(0, 60, (400, 2)), axis=0)
    p, q = points[:, 0].copy(), points[:, 1].copy()
    every, viable = set(), set()
    for i, j, ok in ring_candidates(np.zeros(len(p), np.int64), p, q, quota):
        pairs = [tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())]
        every.update(pairs)
        viable.update(x for x, y in zip(pairs, ok.tolist()) if y)
    want = close(p.tolist(), q.tolist(), quota)
    assert want <= viable <= every
    # what is viable differs by no more bits in all than both quotas together
    assert all(abs(p[i] - p[j]) + abs(q[i] - q[j]) <= 2 * quota for i, j in viable)
    if quota:
        assert len(viable) < 0.7 * len(every)
    print(f"quota {quota}: {len(every)} candidates, {len(viable)} with a viable chain, {len(want)} matches")


def test_blocks_are_not_compared():
    block, p = np.array([0, 1, 1]), np.array([5, 5, 6])
    got = {(int(a), int(b)) for i, j, _ in ring_candidates(block, p, p, 3) for a, b in zip(i, j)}
    assert {tuple(sorted(x)) for x in got} == {(1, 2)}
    empty = np.empty(0, np.int64)
    assert list(ring_candidates(empty, empty, empty, 3)) == []
