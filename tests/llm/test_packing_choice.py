"""The plan against best two fit done piece by piece."""

import math

import numpy as np
import pytest

from lograft.llm.packing import plan_bins


def piece_by_piece(lengths, capacity):
    """One bin at a time over the pieces themselves, by the rule as it reads."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        room, held, rest = capacity, [], []
        for n in left:
            if n <= room:
                held.append(n)
                room -= n
            else:
                rest.append(n)
        if room and len(rest) >= 2:
            short = held[-1]
            gap, best = room + short, (short, None)
            for i, a in enumerate(rest):
                b = next((j for j in range(i + 1, len(rest)) if a + rest[j] <= gap), None)
                if a < gap and b is not None and a + rest[b] > best[0]:
                    best = (a + rest[b], (i, b))
            if best[1]:
                i, b = best[1]
                held = held[:-1] + [rest[i], rest[b]]
                rest = [n for j, n in enumerate(rest) if j not in (i, b)] + [short]
        bins.append(sorted(held))
        left = sorted(rest, reverse=True)
    return bins


def planned(lengths, capacity):
    plan = plan_bins(np.bincount(lengths, minlength=capacity + 1), capacity)
    return [sorted(n for n, t in make for _ in range(t)) for bins, make in plan for _ in range(bins)]


@pytest.mark.parametrize("seed", range(40))
def test_as_many_bins_as_piece_by_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(10, 80))
    n = int(rng.integers(1, 250))
    shape = seed % 4
    lengths = {
        0: lambda: rng.integers(1, capacity + 1, n),
        1: lambda: np.minimum(rng.geometric(6 / capacity, n), capacity),
        2: lambda: rng.choice(rng.integers(1, capacity + 1, 4), n),
        3: lambda: np.where(rng.random(n) < 0.4, rng.integers(1, capacity // 3, n), capacity * 2 // 3),
    }[shape]()
    mine, theirs = planned(lengths, capacity), piece_by_piece(lengths.tolist(), capacity)
    assert sorted(x for b in mine for x in b) == sorted(lengths.tolist())
    assert all(sum(b) <= capacity for b in mine)
    assert len(mine) <= len(theirs) + math.ceil(0.01 * len(theirs))
    assert mine[0] == theirs[0]


def test_two_shorter_pieces_replace_the_shortest():
    # 6 and 3 leave one free; 2 and 2 fill the place of 3 and the gap.
    assert sorted(planned(np.array([6, 3, 2, 2]), 10)) == [[2, 2, 6], [3]]
    assert planned(np.array([5, 5, 5, 5]), 10) == [[5, 5], [5, 5]]
