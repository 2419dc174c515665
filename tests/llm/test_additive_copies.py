"""Large groups of equal vectors: the smallest ids are found, however many copies there are."""

import numpy as np

from tidewalk.llm import additive


def test_smallest_ids_of_many_copies():
    rng = np.random.default_rng(14)
    x = rng.normal(0, 0.2, (900, 16))
    x[rng.permutation(900)[:400]] = x[0]
    ids = rng.permutation(900)
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    index = additive.AdditiveIndex(ids, list(x), additive.train(unit, 4, 32), 4, 0.13)
    copies = sorted(ids[(x == x[0]).all(1)].tolist())
    found, scores = index.search([copies[2]], [x[0]], 5)[0]
    assert found == [i for i in copies if i != copies[2]][:5] and np.allclose(scores, 1)
