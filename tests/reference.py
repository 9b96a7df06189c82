"""Brute force that tests of several files use."""

from __future__ import annotations

import math

import numpy as np


def two_sided_p(t, df) -> np.ndarray:
    """Probability of a Student variable beyond ``|t|`` on either side, by the trapezoidal rule over its density in u = x / (1 + x) steps."""
    out = []
    for value, freedom in zip(np.atleast_1d(np.asarray(t, float)), np.atleast_1d(np.asarray(df, float))):
        u = np.linspace(abs(value) / (1 + abs(value)), 1, 400_001)[:-1]
        x = u / (1 - u)
        scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi)
        density = scale * (1 + x * x / freedom) ** (-(freedom + 1) / 2) / (1 - u) ** 2
        out.append(2 * (density.sum() - density[0] / 2) * (u[1] - u[0]))
    return np.array(out)
