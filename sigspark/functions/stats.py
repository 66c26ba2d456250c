"""Numpy kernels: chi-square, density by diffusion, thresholds and their sweep."""

from __future__ import annotations

import math

import numpy as np


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function of arrays, by its series below a + 1 and else its continued fraction."""
    a, x = (np.asarray(z, float) for z in np.broadcast_arrays(a, x))
    out = np.where(np.isnan(a) | np.isnan(x), np.nan, 0.0)
    series, fraction = (x > 0) & (x < a + 1), (x > 0) & (x >= a + 1)
    log_gamma = {k: math.lgamma(k) for k in np.unique(a[series | fraction]).tolist()}
    scale = lambda at: np.exp(a[at] * np.log(x[at]) - x[at] - np.array([log_gamma[k] for k in a[at].tolist()]))
    if series.any():
        k, y = a[series].copy(), x[series]
        term = 1 / k
        total = term.copy()
        while (np.abs(term) > 1e-16 * total).any():
            k += 1
            term *= y / k
            total += term
        out[series] = np.minimum(1.0, scale(series) * total)
    if fraction.any():
        k, y = a[fraction], x[fraction]
        b = y + 1 - k
        c, d = np.full(len(k), 1e300), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            step = -i * (i - k)
            b += 2
            d = step * d + b
            d = 1 / np.where(d == 0, 1e-300, d)
            c = b + step / c
            c = np.where(c == 0, 1e-300, c)
            h *= d * c
            if (np.abs(d * c - 1) < 1e-16).all() or i > 200 and (np.abs(d * c - 1) < 1e-13).all():
                break
        out[fraction] = np.maximum(0.0, 1 - scale(fraction) * h)
    return out


def chi2_cdf(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    return gamma_p(np.asarray(k, float) / 2, np.asarray(x, float) / 2)


def dct(x: np.ndarray) -> np.ndarray:
    """Cosine sums: sum over j of x[j] cos(pi k (2 j + 1) / 2n), by one FFT of the mirrored series."""
    n = len(x)
    y = np.fft.rfft(np.r_[x, x[::-1]])[:n]
    return np.real(y * np.exp(-1j * np.pi * np.arange(n) / (2 * n))) / 2


def inverse_dct(y: np.ndarray) -> np.ndarray:
    n = len(y)
    full = np.r_[y, 0] * np.exp(1j * np.pi * np.arange(n + 1) / (2 * n))
    full[n] = 0
    return np.fft.irfft(2 * full, 2 * n)[:n]


def _excess(times: np.ndarray, power: np.ndarray, n: int, stages: int) -> np.ndarray:
    """For each of some squared bandwidths, the logarithm of it over what the plug-in rule makes of it.

    The rule of Botev, Grotowski and Kroese (Annals of Statistics, 2010): a time of diffusion gives the squared norm of a
    derivative of the density, and that the time that is best for the norm of the derivative below, down to the second.
    Norms and times are kept as logarithms, as the high ones span hundreds of orders of magnitude.
    """
    log_k, log_power = np.log(np.arange(1, len(power) + 1) * math.pi), np.log(power)

    def norm(order: int, log_times: np.ndarray) -> np.ndarray:
        terms = 2 * order * log_k + log_power - np.exp(2 * log_k + log_times[:, None])
        most = terms.max(axis=1)
        return math.log(2) + most + np.log(np.exp(terms - most[:, None]).sum(axis=1))

    orders = np.arange(stages - 1, 1, -1)
    double_factorials = np.array([math.lgamma(2 * s + 1) - math.lgamma(s + 1) - s * math.log(2) for s in orders])
    constants = np.log(2 * (1 + 0.5 ** (orders + 0.5)) / 3) + double_factorials - math.log(2 * math.pi) / 2 - math.log(n)
    now = norm(stages, np.log(times))
    for order, constant in zip(orders.tolist(), constants, strict=True):
        now = norm(order, (constant - now) * 2 / (3 + 2 * order))
    return np.log(times) + 0.4 * (math.log(2 * n * math.sqrt(math.pi)) + now)


def _bandwidth(power: np.ndarray, n: int, stages: int = 7) -> float:
    """The squared bandwidth that the plug-in rule gives back, between 1e-12 and 0.1; a rule of thumb without one."""
    low, high = 1e-12, 0.1
    with np.errstate(all="ignore"):
        for _ in range(12):  # each pass looks at 33 bandwidths at once, evenly spaced
            times = np.linspace(low, high, 33)
            sign = np.sign(_excess(times, power, n, stages))
            if not np.isfinite(sign).all() or sign[0] * sign[-1] >= 0:
                return 0.28 * n**-0.4
            at = int(np.flatnonzero(sign[1:] * sign[0] <= 0)[0])
            low, high = times[at], times[at + 1]
            if sign[at + 1] == 0:
                return float(high)
    return (low + high) / 2


def density(counts: np.ndarray, low: float, high: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Density by diffusion from counts on an even mesh over [low, high]: mesh and density; n is the distinct values."""
    share = counts / counts.sum()
    a = dct(share)
    power = a[1:] ** 2
    t = _bandwidth(power, n)
    k = np.arange(len(a))
    smooth = a * np.exp(-(k**2) * math.pi**2 * t / 2)
    width = (high - low) or 1.0
    return np.linspace(low, high, len(counts)), inverse_dct(smooth) * len(counts) / width


def last_minimum(x: np.ndarray, y: np.ndarray, width: int) -> float:
    """The last place, inside the range, that no neighbour within ``width`` undercuts; 0 without one."""
    found = [i for i in range(1, len(y) - 1) if y[i] <= y[max(0, i - width) : i + width + 1].min()]
    return float(x[found[-1]]) if found else 0.0


def kde_threshold(counts: np.ndarray, low: float, high: float, n: int, points: int = 32, first: float = 0.3, last: float = 1.0, width: int = 5) -> float:
    """The amplitude threshold from binned amplitudes; 0 without a minimum, and minus infinity where no density exists."""
    if counts.sum() == 0 or n < 2 or high <= low:
        return float("-inf")
    mesh, dens = density(counts, low, high, n)
    x = np.linspace(first, last, points)
    return last_minimum(x, np.interp(x, mesh, dens, left=0, right=0), width)
