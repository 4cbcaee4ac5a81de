"""The field's best labels against all sequences of labels."""

from itertools import product

import numpy as np

from quarry.llm import personal_data
from quarry.llm.personal_data import GAPS, LABELS, SHAPES, SLOTS, Field


def test_decoding_is_that_of_an_exhaustive_search():
    rng = np.random.default_rng(6)
    field = Field()
    field.shape, field.gap, field.move = (rng.normal(size=w.shape) for w in (field.shape, field.gap, field.move))
    sequences = [(rng.integers(0, SHAPES, n), rng.integers(0, 2, n)) for n in (1, 2, 3, 4, 4, 1)]
    found = field.decode(sequences)
    for (shapes, gaps), got in zip(sequences, found):
        n, far = len(shapes), max(SLOTS)
        at = lambda values, t: values[t] if 0 <= t < n else 0
        emission = [sum(field.shape[k][at(shapes, t + s)] for k, s in enumerate(SLOTS)) + sum(field.gap[k][at(gaps, t + s)] for k, s in enumerate(GAPS)) for t in range(n)]
        total = lambda own: field.first[own[0]] + sum(emission[t][a] for t, a in enumerate(own)) + sum(field.move[a, b] + field.forbid[a, b] for a, b in zip(own, own[1:]))
        best = max(product(range(len(LABELS)), repeat=n), key=total)
        assert far >= 0 and list(best) == got
    assert not any(LABELS[b][0] == "I" and LABELS[a][2:] != LABELS[b][2:] for own in found for a, b in zip(own, own[1:]))


def test_sequences_decoded_together_are_those_decoded_alone():
    field = personal_data.standard_field()
    rng = np.random.default_rng(7)
    sequences = [(rng.integers(0, SHAPES, n), rng.integers(0, 2, n)) for n in rng.integers(1, 60, 50)]
    assert field.decode(sequences) == [field.decode([s])[0] for s in sequences]
