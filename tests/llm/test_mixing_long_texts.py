"""Targets of sources whose texts are longer than the knapsack's usual rest."""

import itertools
import random

from articlespark.llm.mixing import KNAPSACK, fit_lengths


def test_long_texts_meet_their_target():
    # Two documents of 200,000 words are 20,000 over; one was 180,000 short.
    assert fit_lengths([200_000], [3], 380_000) == (0, [2])
    assert fit_lengths([200_000], [3], 1_000_000 - 1) == (1, [2])
    assert fit_lengths([150_000, 290_000], [2, 1], 300_000) == (0, [2, 0])


def test_long_rests_are_fitted_exactly():
    from articlespark.llm.mixing import fit_rest

    rng = random.Random(9)
    for _ in range(300):
        limit = 40
        sizes = sorted({rng.randint(50, 400) for _ in range(4)})
        counts = [rng.randint(0, 3) for _ in sizes]
        rest = rng.randint(limit + 1, min(sizes) + limit - 1)
        sums = {sum(s * n for s, n in zip(sizes, ns)) for ns in itertools.product(*(range(c + 1) for c in counts))}
        take = fit_rest(sizes, counts, rest, limit)
        assert all(n <= counts[sizes.index(s)] for s, n in take.items())
        assert abs(rest - sum(s * n for s, n in take.items())) == min(abs(rest - x) for x in sums)


def test_few_long_texts_come_as_near_as_any_choice():
    rng = random.Random(4)
    for _ in range(30):
        sizes = sorted({rng.randint(KNAPSACK + 1, 4 * KNAPSACK) for _ in range(4)})
        counts = [rng.randint(1, 2) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        target = rng.randint(1, total - 1)
        epochs, take = fit_lengths(sizes, counts, target)
        sums = {sum(s * n for s, n in zip(sizes, ns)) for ns in itertools.product(*(range(c + 1) for c in counts))}
        assert epochs == 0 and all(0 <= t <= c for t, c in zip(take, counts))
        assert abs(target - sum(s * t for s, t in zip(sizes, take))) == min(abs(target - x) for x in sums)
