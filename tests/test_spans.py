"""Look-ups in nested spans against a plain search."""

import random

import pytest

from arbograph.sources.spans import Nesting, between


def nested(r, a, b, out):
    while a < b:
        end = r.randint(a + 1, b)
        if r.random() < 0.6:
            out.append((a, end))
            nested(r, a + 1, end, out)
        a = end


@pytest.mark.parametrize("seed", range(20))
def test_nesting(seed):
    r, spans = random.Random(seed), []
    nested(r, 0, 40, spans)
    r.shuffle(spans)
    for strict in (False, True):
        inner = Nesting(spans, strict)
        for i in range(-2, 45):
            assert inner(i) == max(((a, b) for a, b in spans if a + strict <= i < b), default=None)
    spans = sorted(set(spans))
    assert between(spans, 5, 20) == [s for s in spans if 5 <= s[0] < 20]
