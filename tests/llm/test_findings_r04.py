"""Cases of the fourth round's findings on corpus operators; each failed before its change."""

import tracemalloc

import numpy as np

from spreadloom.llm import nearest


def test_products_of_many_queries_are_held_in_parts():
    """All of a list's queries were multiplied with all of its entries at once."""
    q, x = np.random.default_rng(1).normal(size=(6000, 4)), np.random.default_rng(2).normal(size=(2000, 4))
    tracemalloc.start()
    best = [int(row.argmax()) for row in nearest._products(q, x)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(best) == 6000 and best[4321] == int((x @ q[4321]).argmax()) and peak < 6000 * 2000 * 8 / 4
