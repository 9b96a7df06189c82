"""Normalised associated Legendre functions on a latitude axis, as numpy arrays."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


def quadrature_weight(index: int, intervals: int) -> float:
    """Clenshaw-Curtis weight in sin(latitude) of an equally spaced axis that includes both poles."""
    theta = math.pi * index / intervals
    half = intervals // 2
    total = 0.0
    for k in range(1, half + 1):
        b = 1.0 if 2 * k == intervals else 2.0
        total += b / (4 * k * k - 1) * math.cos(2 * k * theta)
    c = 1.0 if index in (0, intervals) else 2.0
    return c / intervals * (1.0 - total)


def _column(m: int, top: int, mu: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """P(l, m), l = m..top, a row per l, with integral of P^2 over mu equal to one; ``seed`` is the power of the cosine that begins it."""
    out = np.zeros((top - m + 1, mu.size))
    log_norm = 0.5 * (math.log(0.5) + sum(math.log((2 * i + 1) / (2 * i)) for i in range(1, m + 1)))
    out[0] = math.exp(log_norm) * seed
    for l in range(m + 1, top + 1):
        a = math.sqrt((4 * l * l - 1) / (l * l - m * m))
        before = 0.0
        if l > m + 1:
            before = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1)) * out[l - m - 2]
        out[l - m] = a * (mu * out[l - m - 1] - before)
    return out


@dataclass(frozen=True)
class Legendre:
    """For every order m a matrix (l = m..truncation, latitude): ``p``, ``over`` (m P / cos(lat), its limit at the poles) and ``slope`` (of P in
    latitude); ``weight`` is the quadrature weight of each latitude."""

    p: tuple[np.ndarray, ...]
    over: tuple[np.ndarray, ...]
    slope: tuple[np.ndarray, ...]
    weight: np.ndarray


@lru_cache(maxsize=4)
def legendre(n_lat: int, truncation: int) -> Legendre:
    """The functions on ``n_lat`` latitudes from -90 to 90, made once in a process: 24 bytes per latitude, l and m."""
    lat = np.radians(-90.0 + 180.0 * np.arange(n_lat) / (n_lat - 1))
    mu, cosine = np.sin(lat), np.maximum(np.cos(lat), 0.0)
    columns = [_column(m, truncation + 1, mu, cosine**m) for m in range(truncation + 2)]
    p, over, slope = [], [], []
    for m in range(truncation + 1):
        l = np.arange(m, truncation + 1)[:, None]
        p.append(columns[m][: l.size])
        over.append(m * _column(m, truncation, mu, cosine ** (m - 1)) if m else np.zeros_like(p[0]))
        upper = np.zeros_like(p[m])
        upper[1:] = columns[m + 1][: l.size - 1]
        if m == 0:
            slope.append(np.sqrt(l * (l + 1.0)) * upper)
        else:
            lower = columns[m - 1][1 : l.size + 1]
            slope.append(0.5 * (np.sqrt((l - m) * (l + m + 1.0)) * upper - np.sqrt((l + m) * (l - m + 1.0)) * lower))
    weight = np.array([quadrature_weight(i, n_lat - 1) for i in range(n_lat)])
    return Legendre(tuple(p), tuple(over), tuple(slope), weight)
