"""What coarse quantizers do to normal samples: how the correlation of quantized samples depends on
that of the samples (Price's theorem), and the voltages that two-bit states stand for."""

from __future__ import annotations

import functools
import math

import numpy as np

from sampledeck.functions.numeric import solve


def density(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def upper(x: float) -> float:
    """The chance that a standard normal variate is above x."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def steps(levels: int) -> np.ndarray:
    """Where an odd number of levels ..., -1, 0, 1, ... of unit spacing change: halves."""
    if levels < 3 or levels % 2 == 0:
        raise ValueError("levels must be odd, 3 at least")
    return np.arange(levels - 1) - (levels - 2) / 2


def output_power(levels: int, spacing: float) -> float:
    """Mean square of quantized normal samples, with `spacing` standard deviations between steps."""
    return sum(2 * (2 * k + 1) * upper((k + 0.5) * spacing) for k in range(levels // 2))


def spacing_for(levels: int, power: float) -> float:
    """The spacing at which quantized samples have that mean square."""
    most = (levels // 2) ** 2
    if not 0 < power < most:
        raise ValueError(f"the zero lag of {levels} levels lies between 0 and {most}")
    return solve(lambda s: output_power(levels, s) - power, 1e-6, 60.0, 1e-13)


def correlation(levels: int, spacing: float, rho: np.ndarray) -> np.ndarray:
    """Mean product of quantized samples whose originals have correlations rho, rising from -1 to 1
    and 0 among them: its derivative is the joint density at all pairs of steps."""
    at = steps(levels) * spacing
    a, b = (x.ravel() for x in np.meshgrid(at, at))
    node, weight = np.polynomial.legendre.leggauss(24)
    angle = np.arcsin(rho)  # d rho / sqrt(1 - rho^2), so nothing blows up at the ends
    low, high = angle[:-1], angle[1:]
    theta = (low + high)[:, None] / 2 + (high - low)[:, None] / 2 * node
    cosine = np.maximum(np.cos(theta) ** 2, 1e-300)[..., None]
    inside = np.exp(-np.minimum((a * a + b * b - 2 * np.sin(theta)[..., None] * a * b) / (2 * cosine), 700)).sum(-1) / (2 * math.pi)
    total = np.concatenate([[0.0], np.cumsum((inside * weight).sum(1) * (high - low) / 2)])
    return total - np.interp(0.0, rho, total)


def corrected(levels: int, lags: np.ndarray, points: int = 513) -> np.ndarray:
    """Correlations of the samples behind quantized ones, from their mean products; lags[0] is the
    zero lag, which tells the spacing and becomes 1."""
    spacing = spacing_for(levels, float(lags[0]))
    rho = np.sin(np.linspace(-math.pi / 2, math.pi / 2, points))
    out = np.sin(np.interp(lags, correlation(levels, spacing, rho), np.arcsin(rho)))
    out[0] = 1.0
    return out


#: Least and greatest spacing of steps, in standard deviations, that a surface covers; its points by
#: zero lag and by lag.
SPACINGS, SURFACE = (0.02, 8.0), (256, 513)


def log_share(power: float, levels: int) -> float:
    """How a surface counts zero lags: the logarithm of power to what it lacks of the most."""
    return math.log(power / ((levels // 2) ** 2 - power))


@functools.lru_cache(maxsize=8)
def surface(levels: int, points: int = 1025) -> tuple[float, float, np.ndarray]:
    """(first, step, angle[zero lag, lag]): the arc sine of the correlation behind a lag, for zero lags
    first + k * step (as log_share) and lags of -1 to 1 times the zero lag, evenly. Both dependences
    are smooth, to the ends, so cubics between points are good to far under 1e-6."""
    ends = sorted(log_share(output_power(levels, s), levels) for s in SPACINGS)
    shares = np.linspace(*ends, SURFACE[0])
    theta = np.linspace(-math.pi / 2, math.pi / 2, points)
    lag, out = np.linspace(-1, 1, SURFACE[1]), np.empty(SURFACE)
    for k, share in enumerate(shares.tolist()):
        power = (levels // 2) ** 2 / (1 + math.exp(-share))
        products = correlation(levels, spacing_for(levels, power), np.sin(theta)) / power
        products /= np.interp(math.pi / 2, theta, products)  # 1 at the end but for rounding
        rough = np.interp(lag, products, theta)
        # a parabola through the three nearest points takes off what the straight line leaves
        at = np.clip(np.searchsorted(theta, rough) - 1, 1, points - 3)
        best = rough
        with np.errstate(divide="ignore", invalid="ignore"):
            for shift in (0, 1):
                p = [products[at + shift + j] for j in (-1, 0, 1)]
                t = [theta[at + shift + j] for j in (-1, 0, 1)]
                fine = sum(t[a] * (lag - p[b]) * (lag - p[c]) / ((p[a] - p[b]) * (p[a] - p[c])) for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
                best = np.where(np.isfinite(fine) & (abs(fine - rough) < math.pi / points), fine if shift == 0 else (best + fine) / 2, best)
        out[k] = best
    return float(shares[0]), float(shares[1] - shares[0]), out


def two_bit_voltages(low: float) -> tuple[float, float]:
    """Root mean squares of normal samples of unit variance within and beyond the threshold that a
    share `low` of them stays within, so both states keep the power that they stand for."""
    u = solve(lambda x: 1 - 2 * upper(x) - low, 0.0, 12.0, 1e-14)
    return math.sqrt(max(0.0, 1 - 2 * u * density(u) / low)), math.sqrt(1 + 2 * u * density(u) / (1 - low))


def two_bit_levels(low: float) -> tuple[float, float]:
    """As two_bit_voltages(), in units of the threshold, which stays where it is when the power of
    what is sampled changes: the outputs that follow the input's power."""
    u = solve(lambda x: 1 - 2 * upper(x) - low, 0.0, 12.0, 1e-14)
    within, beyond = two_bit_voltages(low)
    return within / u, beyond / u
