"""Packing of blocks into chunks, as ranges."""

import pytest

from graphloom.operators.chunking import pack


@pytest.mark.parametrize(
    ("tokens", "overlap", "want"),
    [
        ([], 10, []), ([5], 10, [(0, 1)]), ([40, 40, 40], 0, [(0, 2), (2, 3)]), ([40, 40, 40], 30, [(0, 2), (1, 3)]), ([200, 5], 10, [(0, 1), (0, 1), (0, 2), (0, 2)]),
        ([10, 10, 10, 90, 10], 15, [(0, 3), (1, 4), (3, 5), (3, 5)]),
    ],
)
def test_ranges(tokens, overlap, want):
    got = pack(tokens, 100, overlap)
    assert got == want and {i for a, b in got for i in range(a, b)} == set(range(len(tokens)))
