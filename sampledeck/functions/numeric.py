"""Scalar numerics of the driver: dispersion, filter lengths, windows, quadrature, thresholds."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: The dispersion constant in its customary form: delay = DM / K * (1/f1^2 - 1/f2^2), seconds, MHz.
DISPERSION_K = 2.41e-4


def dispersion_delay(dm: float, f1: float, f2: float) -> float:
    """Seconds by which f1 arrives after f2."""
    return dm / DISPERSION_K * (1.0 / f1**2 - 1.0 / f2**2)


def smearing_seconds(dm: float, centre: float, width: float) -> float:
    """Spread of arrival times across a channel."""
    half = abs(width) / 2
    return dispersion_delay(dm, centre - half, centre + half)


def smearing_samples(dm: float, centre: float, width: float, rate: float, worst_half: float = 0.1) -> int:
    """Samples that the worse half of a channel's impulse response takes, with a tenth to spare."""
    low = dispersion_delay(dm, centre - abs(width) / 2, centre)
    return math.ceil(abs(low) * rate * (1 + worst_half))


def chirp(dm: float, centre: float, width: float, n: int, dc_zero: bool = True) -> np.ndarray:
    """Response of n points that undoes dispersion over one channel, in FFT order."""
    f = np.fft.fftfreq(n) * width
    phase = 2 * np.pi * 1e6 * dm / DISPERSION_K * f**2 / (centre**2 * (centre + f))
    out = np.exp(-1j * math.copysign(1, width) * phase)
    if dc_zero:
        out[0] = 0
    return out


def fft_cost(n: int, filtered: int) -> float:
    """Operations for each sample that overlap-save keeps."""
    return n * math.log2(n) / (n - filtered)


def optimal_fft(filtered: int, most: int = 1 << 26) -> int:
    """The power of two above `filtered` that costs least by fft_cost."""
    n = 2 << max(1, filtered).bit_length()
    while 2 * n <= most and fft_cost(2 * n, filtered) < fft_cost(n, filtered):
        n *= 2
    return n


def window(kind: str, n: int) -> np.ndarray:
    """Apodization: hann, welch, or bartlett (a triangle), over n points with ends at 0."""
    return _window(kind, n)


def normalised(taps: np.ndarray) -> np.ndarray:
    """A window whose points add up to 1, so it leaves a constant as it is."""
    return taps / taps.sum()


def _window(kind: str, n: int) -> np.ndarray:
    i = np.arange(n)
    if kind == "hann":
        return 0.5 * (1 - np.cos(2 * np.pi * i / (n - 1)))
    mid = (n - 1) / 2
    if kind == "welch":
        return 1 - ((i - mid) / mid) ** 2
    if kind == "bartlett":
        return 1 - np.abs((i - mid) / mid)
    raise ValueError(kind)


def integrate(f: Callable[[np.ndarray], np.ndarray], a: float, b: float, parts: int = 64) -> float:
    """Gauss-Legendre quadrature in panels; infinite ends by x = t / (1 - t^2)."""
    if math.isinf(a) or math.isinf(b):
        lo, hi = (-1.0 if math.isinf(a) else _unbounded(a)), (1.0 if math.isinf(b) else _unbounded(b))
        return integrate(lambda t: f(t / (1 - t * t)) * (1 + t * t) / (1 - t * t) ** 2, lo, hi, parts)
    x, w = np.polynomial.legendre.leggauss(16)
    edges = np.linspace(a, b, parts + 1)
    half, mid = np.diff(edges)[:, None] / 2, (edges[:-1, None] + edges[1:, None]) / 2
    return float((half * w * f(mid + half * x)).sum())


def _unbounded(x: float) -> float:
    """The t for which t / (1 - t^2) = x."""
    return 0.0 if x == 0 else (math.sqrt(1 + 4 * x * x) - 1) / (2 * x)


def solve(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-12) -> float:
    """A root of f between low and high, by halving the bracket."""
    below = f(low)
    if below * f(high) > 0:
        raise ValueError("no sign change in the bracket")
    while high - low > tolerance:
        mid = (low + high) / 2
        if below * f(mid) > 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def sk_variance(m: int) -> float:
    """Variance of the spectral kurtosis estimate of Gaussian noise over m spectra."""
    return 4.0 * m * m / ((m - 1.0) * (m + 2.0) * (m + 3.0))


class Pearson:
    """The distribution of Pearson's system of zero mean and unit variance with that skewness (not
    negative) and kurtosis: types I, IV and VI. Its density's logarithm has the derivative
    -(x + c1) / (c0 + c1 x + c2 x^2). x is a function of u, which runs over all numbers, so that
    the density of u falls off on both sides and needs no bracket."""

    def __init__(self, skewness: float, kurtosis: float) -> None:
        beta1 = skewness * skewness
        d = 10 * kurtosis - 12 * beta1 - 18
        c0, c1, c2 = (4 * kurtosis - 3 * beta1) / d, skewness * (kurtosis + 3) / d, (2 * kurtosis - 3 * beta1 - 6) / d
        under = c1 * c1 - 4 * c0 * c2
        if under < 0:  # no roots: type IV, over all numbers
            middle, half = -c1 / (2 * c2), math.sqrt(-under) / (2 * abs(c2))
            self.at = lambda u: middle + half * np.sinh(u)
            turn = (c1 + middle) / (c2 * half)
            self.log = lambda u: -np.log(np.cosh(u)) / c2 - turn * np.arctan(np.sinh(u)) + np.log(np.cosh(u))
        else:
            low, high = sorted((-c1 + side * math.sqrt(under)) / (2 * c2) for side in (-1, 1))
            first, second = (low + c1) / (c2 * (low - high)), (high + c1) / (c2 * (high - low))
            if low < 0 < high:  # the mean lies between the roots: type I
                self.at = lambda u: low + (high - low) / (1 + np.exp(-u))
                self.log = lambda u: (1 - first) * -np.logaddexp(0, -u) + (1 - second) * -np.logaddexp(0, u)
            else:  # beyond both: type VI
                self.at = lambda u: high + np.exp(u)
                self.log = lambda u: (1 - second) * u - first * np.logaddexp(u, math.log(high - low))
        grid = np.linspace(-60, 60, 24_001)
        logs = self.log(grid)
        self.peak = float(logs.max())
        inside = grid[logs > self.peak - 60]
        self.ends = float(inside[0]), float(inside[-1])
        self.total = integrate(self.density, *self.ends, 512)

    def density(self, u: np.ndarray) -> np.ndarray:
        return np.exp(np.maximum(self.log(u) - self.peak, -700))

    def tail(self, chance: float, upper: bool) -> float:
        """The x beyond which that share lies."""

        def excess(u: float) -> float:
            ends = (u, self.ends[1]) if upper else (self.ends[0], u)
            return integrate(self.density, *ends, 256) / self.total - chance

        return float(self.at(solve(excess, *self.ends)))


def simplex_tails(m: int, points: int = 1201) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, the chance to be below, the chance to be above) of w = (m q - 1) / (m - 1), q being the sum of
    squares of m shares of a whole, all divisions being alike: what m powers of noise are of their
    sum. A share taken off leaves a smaller whole divided alike, so m follows from m - 1 by one
    integral over the share; both tails are positive sums, so small ones keep their digits."""
    w = np.linspace(0, 1, points) ** 2
    node, weight = np.polynomial.legendre.leggauss(48)
    edges = np.linspace(0, 1, 9)
    t = ((edges[:-1, None] + edges[1:, None]) / 2 + np.diff(edges)[:, None] / 2 * node).ravel()
    dt = (np.diff(edges)[:, None] / 2 * weight).ravel()
    below, above = np.sqrt(w), 1 - np.sqrt(w)  # of two shares: q = (1 + d^2) / 2 with d uniform
    for k in range(3, m + 1):
        q = (1 + (k - 1) * w) / k
        # with the share 1 - t off, what is left has q' = (q - (1 - t)^2) / t^2; within this span of t it can be
        root = np.sqrt(np.maximum((k - 1) * (k * q - 1), 0))
        low, high = np.maximum((k - 1 - root) / k, 0), np.minimum((k - 1 + root) / k, 1)
        at = low[:, None] + (high - low)[:, None] * t
        inner = ((q[:, None] - (1 - at) ** 2) / at**2 * (k - 1) - 1) / (k - 2)
        look = lambda f: np.exp(np.interp(np.sqrt(np.clip(inner, 0, 1)), np.sqrt(w), np.log(np.maximum(f, 1e-300))))  # noqa: B023, E731
        share = (k - 1) * at ** (k - 2) * dt * (high - low)[:, None]
        # outside the span: whatever is left, q is above
        outside = low ** (k - 1) + 1 - high ** (k - 1)
        below, above = (share * np.where(inner >= 1, 1.0, look(below))).sum(1), (share * np.where(inner >= 1, 0.0, look(above))).sum(1) + outside
        below[0] = above[-1] = 0.0
    return w, below, above


def sk_exact_limits(m: int, sigmas: float = 3.0) -> tuple[float, float]:
    """As sk_limits(), by the estimate's own distribution, see simplex_tails(): for few spectra its
    lower tail is far thinner than that of a distribution with its first moments."""
    w, below, above = simplex_tails(m)
    chance = 0.5 * math.erfc(sigmas / math.sqrt(2))
    some = below > 0
    low = np.interp(math.log(chance), np.log(below[some]), w[some])
    some = above > 0
    high = np.interp(-math.log(chance), -np.log(above[some]), w[some])
    return (m + 1) * float(low), (m + 1) * float(high)


def sk_limits(m: int, sigmas: float = 3.0) -> tuple[float, float]:
    """Bounds outside which the estimate falls as rarely as a normal variate beyond `sigmas`.

    The estimate's first moments (mean 1, the variance above, and the published third and fourth)
    fix a distribution of Pearson's system, whichever its type, whose tails are integrated. From
    32768 spectra on it is as good as normal, with the variance 4 / m.
    """
    if m < 3:
        raise ValueError("the estimate's distribution needs 3 spectra at least")
    if m >= 32768:
        rough = sigmas * math.sqrt(4.0 / m)
        return 1 - rough, 1 + rough
    n, mu2 = float(m), sk_variance(m)
    beta1 = 4 * (n + 2) * (n + 3) * (5 * n - 7) ** 2 / ((n - 1) * (n + 4) ** 2 * (n + 5) ** 2)
    beta2 = 3 * (n + 2) * (n + 3) * (n**3 + 98 * n**2 - 185 * n + 78) / ((n - 1) * (n + 4) * (n + 5) * (n + 6) * (n + 7))
    found = Pearson(math.sqrt(beta1), beta2)
    chance = 0.5 * math.erfc(sigmas / math.sqrt(2))
    return tuple(1 + math.sqrt(mu2) * found.tail(chance, upper) for upper in (False, True))
