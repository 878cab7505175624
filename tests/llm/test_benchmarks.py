"""Short benchmark items with as many edits as are allowed."""

import random

import pyarrow as pa
import pytest

from spanloom.llm import benchmarks


@pytest.mark.parametrize("n", [12, 13, 15, 18, 20, 25, 29])
def test_short_items_with_edits_are_all_found(n):
    rng = random.Random(n)
    word = lambda: f"v{rng.randrange(5000)}"
    items = [[word() for _ in range(n)] for _ in range(100)]
    finder = benchmarks.Finder(benchmarks.build(list(range(100)), [" ".join(w) for w in items]))
    texts = []
    for w in map(list, items):
        for _ in range(int(0.2 * n + 1e-9)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [word()], [w[k], word()]])
        texts.append(" ".join([word() for _ in range(40)] + w + [word() for _ in range(40)]))
    found = {(r, i) for r, i, *_ in finder.find(pa.array(texts))}
    assert not [r for r in range(100) if (r, r) not in found]
