"""Windows of a whole batch are hashed together, as the bytes they hold say and not where they stand."""

import numpy as np

from hushframe.llm.suffix_windows import window_hashes


def test_equal_windows_alone_have_equal_hashes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 20_000).astype(np.uint8)
    data[9_000:9_300] = data[100:400]
    data[12_000:12_400] = 97
    places = np.arange(len(data) - 99)
    h1, h2 = window_hashes(data, places, 100)
    by_text = {}
    for place, *both in zip(places.tolist(), h1.tolist(), h2.tolist(), strict=True):
        by_text.setdefault(data[place : place + 100].tobytes(), set()).add(tuple(both))
    assert len(by_text) < len(places)
    assert all(len(found) == 1 for found in by_text.values())
    for half in (h1, h2):
        assert len(set(half.tolist())) == len(by_text)
