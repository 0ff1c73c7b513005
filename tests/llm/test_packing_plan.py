"""The packing plan: the linear program carries it, its bound holds, and small plans meet the optimum."""

import functools

import numpy as np
import pytest

from screentone.llm import packing


def solved(counts, lengths, **how):
    found = packing.configuration_lp(lengths, counts, 1024, **how)
    whole, left = packing.rounded(found, lengths, counts, 1024)
    return found, whole, 1 - float((left * lengths).sum() / (counts * lengths).sum())


@pytest.mark.parametrize("times", [1, 100])
def test_the_linear_program_carries_the_plan(times):
    rng = np.random.default_rng(3)
    drawn = np.bincount(np.minimum(1023, rng.lognormal(5.8, 1.0, 12_000).astype(int) + 1), minlength=1024)
    lengths = np.flatnonzero(drawn)
    counts = drawn[lengths] * times
    found, whole, share = solved(counts, lengths)
    total = int((lengths * counts).sum())
    assert share >= 0.9
    assert solved(counts, lengths, rate=0.0, urge=0.0)[2] < share - 0.05
    sequences = sum(n for _, n in packing.plan(dict(zip(lengths.tolist(), counts.tolist()))))
    assert total / 1024 - 1e-6 <= found.bound <= sequences <= 1.002 * total / 1024 + 2
    for pattern, n in whole.items():
        assert n > 0 and sum(int(lengths[j]) * u for j, u in pattern) <= 1024
    assert all(sum(n * u for pattern, n in whole.items() for i, u in pattern if i == j) <= counts[j] for j in range(0, len(lengths), 97))


def fewest(pieces, capacity):
    """The optimum by trying all places for each piece, the largest first."""

    @functools.cache
    def best(at, rooms):
        if at == len(pieces):
            return len(rooms)
        found = best(at + 1, tuple(sorted((*rooms, capacity - pieces[at]))))
        for i, room in enumerate(rooms):
            if room >= pieces[at]:
                found = min(found, best(at + 1, tuple(sorted((*rooms[:i], room - pieces[at], *rooms[i + 1 :])))))
        return found

    return best(0, ())


def test_small_plans_meet_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(40):
        pieces = sorted(rng.integers(1, 13, size=rng.integers(1, 10)).tolist(), reverse=True)
        histogram = {n: pieces.count(n) for n in set(pieces)}
        plan = packing.plan(histogram, capacity=12)
        used: dict[int, int] = {}
        for pattern, times in plan:
            assert sum(pattern) <= 12
            for n in pattern:
                used[n] = used.get(n, 0) + times
        assert used == histogram
        assert sum(n for _, n in plan) <= fewest(tuple(pieces), 12) + 1


@pytest.mark.parametrize("histogram", [{1: 100_000}, {600: 50, 500: 51, 3: 7}, {1000: 100, 24: 50, 12: 100, 7: 3}, {5: 1}, {}])
def test_odd_histograms(histogram):
    plan = packing.plan(histogram)
    used: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(pattern) <= 1024
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    if histogram == {1: 100_000}:
        assert sum(n for _, n in plan) == 98


HISTOGRAMS = {
    "uniform": lambda rng: rng.integers(1, 1025, 3000),
    "middle": lambda rng: rng.integers(300, 801, 6000),
    "narrow": lambda rng: rng.integers(400, 701, 6000),
    "geometric": lambda rng: np.minimum(1023, rng.geometric(1 / 300, 6000)),
    "three": lambda rng: np.repeat([520, 300, 204], [500, 500, 400]),
}


@pytest.mark.parametrize("kind, times", [*((kind, 1) for kind in HISTOGRAMS), ("three", 40), ("narrow", 40)])
def test_never_more_than_best_fit_and_close_to_the_bound(kind, times):
    drawn = np.bincount(HISTOGRAMS[kind](np.random.default_rng(6)), minlength=1025)
    lengths = np.flatnonzero(drawn[:1024])
    counts = drawn[lengths] * times
    sequences = sum(n for _, n in packing.plan({n: c for n, c in zip(lengths.tolist(), counts.tolist())}, rounds=60))
    assert sequences <= sum(n for _, n in packing._remainder(lengths, counts.copy(), 1024))
    bound = packing.first_prices(lengths, counts, 1024)[1]
    assert bound - 1e-6 <= sequences <= 1.005 * bound + 1
    if kind == "three":
        assert sequences == 500 * times


def test_pairs_are_optimal():
    """At most two pieces fit a sequence; 968 and 673 fit with none, 551 and 530 with one of the small ones."""
    histogram = {352: 575, 378: 592, 456: 535, 530: 556, 551: 596, 673: 595, 968: 551}
    small = 575 + 592 + 535
    assert sum(n for _, n in packing.plan(histogram)) == 551 + 595 + 596 + 556 + -(-(small - 596 - 556) // 2)


def test_first_prices_bound_every_pattern():
    rng = np.random.default_rng(7)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 41, 8))
        counts = rng.integers(1, 9, len(lengths))
        prices, bound = packing.first_prices(lengths, counts, 40)
        best = packing.knapsack(prices, lengths, np.full(len(lengths), 40), 40, np.arange(len(lengths)))[0]
        assert best.max() <= 1 + 1e-9
        assert bound <= sum(n for _, n in packing.plan(dict(zip(lengths.tolist(), counts.tolist())), capacity=40)) + 1e-6
