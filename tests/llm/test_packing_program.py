"""The configuration program of packing: covers the whole histogram, near its bound, and least where that can be known."""

import random
from collections import Counter

import numpy as np

from siltstone.llm import packing


def held(configurations, cap):
    out = Counter()
    for chosen, n in configurations:
        assert sum(k * m for k, m in chosen.items()) <= cap and n > 0
        for k, m in chosen.items():
            out[k] += m * n
    return out


def least(items, cap):
    """The least number of sequences, by trying all ways."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            j = rooms.index(room)
            go(i + 1, [*rooms[:j], room - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, cap - items[i]])

    go(0, [])
    return best[0]


def best_fit_decreasing(histogram, cap):
    """Piece by piece, each into the fullest sequence that has room: how many sequences."""
    rooms = Counter()
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            room = min((r for r, n in rooms.items() if n and r >= k), default=None)
            if room is None:
                rooms[cap - k] += 1
            else:
                rooms[room] -= 1
                rooms[room - k] += 1
    return sum(rooms.values())


def test_plays_cover_every_length():
    r = random.Random(4)
    for cap, histogram in ((100, Counter(r.randint(1, 99) for _ in range(5000))), (64, {31: 1000, 33: 7, 1: 900}), (10, {7: 5}), (50, {3: 1, 49: 2})):
        lengths = np.array(sorted(histogram))
        counts = np.array([histogram[k] for k in sorted(histogram)])
        assert held(packing.played(lengths, counts, lengths / cap, cap), cap) == histogram
        plan = packing.plan(histogram, cap)
        assert held(plan.configurations, cap) == histogram
        assert sum(k * n for k, n in histogram.items()) / cap - 1e-6 <= plan.bound <= plan.sequences + 1e-6 and plan.program <= plan.sequences


def test_bound_is_no_higher_than_the_least_and_plans_meet_it():
    r = random.Random(7)
    over = Counter()
    for case in range(120):
        cap = r.choice((20, 50, 100))
        items = [r.randint(1, cap) if case % 2 else r.randint(cap // 4, cap // 2 + 3) for _ in range(r.randint(0, 11))]
        plan = packing.plan(Counter(items), cap)
        best = least(items, cap)
        assert plan.bound <= best + 1e-6
        over[plan.sequences - best] += 1
    assert set(over) == {0}, over


def test_lengths_that_best_fit_pairs_badly():
    """Three pieces to a sequence, one of each length; best fit, piece by piece, takes 3,500."""
    histogram = {700: 3000, 650: 3000, 690: 3000}
    plan = packing.plan(histogram)
    assert plan.sequences == plan.program == 3000 and abs(plan.bound - 3000) < 1e-6
    assert best_fit_decreasing(histogram, packing.CAPACITY) == 3500


def test_program_beats_best_fit_on_skewed_lengths():
    r = random.Random(1)
    histogram = dict(Counter(int(r.gauss(m, 3)) for m in (130, 74, 69, 54) for _ in range(3000)))
    plan = packing.plan(histogram, 256)
    assert held(plan.configurations, 256) == histogram
    assert plan.sequences < 0.95 * best_fit_decreasing(histogram, 256)
    assert plan.sequences <= 1.06 * plan.bound and plan.bound > sum(k * n for k, n in histogram.items()) / 256 - 1e-6


def test_most_sequences_of_many_lengths_are_the_programs():
    r = random.Random(3)
    histogram = Counter(min(2047, int(r.lognormvariate(6, 0.8))) for _ in range(20_000))
    plan = packing.plan(histogram)
    assert plan.sequences <= 1.001 * plan.bound + 1 and plan.program >= 0.9 * plan.sequences
