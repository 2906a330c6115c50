"""The packing plan holds every piece and is never worse than best-fit decreasing."""

import random

import pytest

pytest.importorskip("plumbline.llm.packing")


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_never_above_best_fit(seed):
    from plumbline.llm.packing import best_fit_decreasing, plan

    rng = random.Random(seed)
    draw = [lambda: rng.randint(1, 2048), lambda: rng.randint(500, 1000), lambda: min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1)][seed % 3]
    histogram = {}
    for _ in range(rng.choice([0, 3, 2500])):
        l = draw()
        histogram[l] = histogram.get(l, 0) + 1
    rows, placed = plan(histogram, 2048)
    held = {}
    for config, n in rows:
        assert sum(l * k for l, k in config.items()) <= 2048
        for l, k in config.items():
            held[l] = held.get(l, 0) + k * n
    assert held == histogram
    assert placed <= sum(n for _, n in rows) <= sum(n for _, n in best_fit_decreasing(histogram, 2048))
