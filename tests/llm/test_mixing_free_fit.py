"""Sources of a few very long texts come as near to their targets as any choice of documents."""

import itertools
import random

from articlespark.llm.mixing import exchanged, fit_lengths, free_fit


def nearest(sizes, budget):
    return min(abs(budget - sum(c)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n))


def given(sizes, take):
    return sum(s * t for s, t in zip(sizes, take))


def test_few_texts_of_millions_of_words():
    rng, missed, best = random.Random(1), [], []
    for _ in range(60):
        sizes = sorted({rng.randint(2_000_000, 40_000_000) for _ in range(rng.randint(8, 12))})
        budget = rng.randint(sum(sizes) // 4, sum(sizes) * 3 // 4)
        epochs, take = fit_lengths(sizes, [1] * len(sizes), budget)
        assert epochs == 0 and all(0 <= t <= 1 for t in take)
        missed.append(abs(budget - given(sizes, take)) / budget)
        best.append(nearest(sizes, budget) / budget)
    assert max(missed) <= max(best) + 1e-3 and sum(missed) <= sum(best) + 60 * 1e-4


def test_units_bound_the_work_and_exchanges_mend_it():
    rng = random.Random(2)
    sizes = sorted({rng.randint(70_000, 90_000_000) for _ in range(400)})
    counts = [rng.randint(1, 4) for _ in sizes]
    budget = sum(s * c for s, c in zip(sizes, counts)) // 3
    rough = free_fit(sizes, counts, budget, bits=1 << 20)
    take = exchanged(sizes, counts, rough, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    assert abs(budget - given(sizes, take)) <= min(abs(budget - given(sizes, rough)), budget * 1e-6)
    assert fit_lengths(sizes, counts, budget) == fit_lengths(sizes, counts, budget)


def test_an_exact_sum_is_found_in_units_of_a_word():
    assert given([70_000, 90_001, 110_007], free_fit([70_000, 90_001, 110_007], [1, 2, 1], 290_009)) == 290_009
    assert given([5, 8, 13], exchanged([5, 8, 13], [1, 1, 1], [1, 0, 0], 13)) == 13
    assert exchanged([5], [2], [0], 4) == [1] and exchanged([5], [2], [2], 4) == [1] and exchanged([], [], [], 4) == []
