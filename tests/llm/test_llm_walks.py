"""Several walks at once copy what each of them copies alone."""

import numpy as np
import pytest

from folioforge.llm import decontam


@pytest.mark.parametrize("tabled", [True, False])
def test_walks_taken_together_equal_single_walks(tabled):
    draw = np.random.default_rng(3)
    index = decontam.Index.build([(i, " ".join(f"w{x}" for x in draw.integers(0, 60, n))) for i, n in enumerate((9, 20, 20, 31))], 0.15)
    assert index.tabled
    index.tabled = tabled
    for n in (1, 9, 20, 31):
        windows = draw.integers(-1, len(index.codes) + 1, (50, n))
        windows[windows < 0] = len(index.codes)
        windows[:, n // 2 + 1 :][draw.random((50, n - n // 2 - 1)) < 0.1] = -1
        for numbers in (range(0, decontam.TOGETHER), range(8, 11)):
            got = index.copied(windows, numbers)
            for w, number in enumerate(numbers):
                want = decontam.walk(windows, number, decontam.steps_of(n, number))
                ends = (np.cumsum(windows == -1, axis=1) > 0).any(axis=1)
                assert (got[w][~ends] == want[~ends]).all()
