"""Hashing and winnowing by definition."""

import numpy as np

from corvane.llm.repeats import merged
from corvane.llm.shared import mix, window_hashes, winnow


def test_winnow_is_the_leftmost_least_of_each_window():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, w = int(rng.integers(1, 60)), int(rng.integers(1, 20))
        hashes = rng.integers(0, int(rng.choice([3, 10, 1 << 30])), n).astype(np.uint64) << np.uint64(32)
        runs = []
        for s in range(n - w + 1):
            place = s + int(np.argmin(hashes[s : s + w]))
            if runs and runs[-1][0] == place:
                runs[-1][2] = s
            else:
                runs.append([place, s, s])
        assert [list(map(int, x)) for x in zip(*winnow(hashes, w))] == runs


def test_equal_windows_have_equal_hashes():
    rng = np.random.default_rng(1)
    part = mix(rng.integers(0, 5, 300).astype(np.uint64))
    whole = window_hashes(np.concatenate([part, part]), 50)
    assert (whole[:251] == whole[300:]).all() and len(np.unique(whole[:251])) == 251
    assert len(window_hashes(part[:10], 50)) == 0


def test_merged_spans():
    starts, ends = merged([5, 0, 20, 8], [9, 5, 30, 12])
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 12), (20, 30)]
    assert len(merged(None, None)[0]) == 0
