"""The sketch's cut against the exact distribution of its bits."""

import math

import numpy as np

from chobo.llm import near_dup


def test_sketches_lose_far_fewer_links_than_bands():
    bands, rows, similarity = 40, 4, 0.75
    k, n = bands * rows, near_dup.BITS
    most = near_dup.bits_allowed(similarity - near_dup.SLACK, k)
    bits = np.arange(n + 1)
    odd, lost = (bits == 0).astype(float), 0.0
    for differing in range(k + 1):
        lost += math.comb(k, differing) * (1 - similarity) ** differing * similarity ** (k - differing) * odd[most + 1 :].sum()
        for _ in range(2):
            odd = np.r_[0, odd[:-1] * (n - bits[:-1]) / n] + np.r_[odd[1:] * bits[1:] / n, 0]
    assert 0 < lost < (1 - similarity**rows) ** bands / 10
