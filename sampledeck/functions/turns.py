"""Phase in turns by time, in numpy, for tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Turns:
    """Phase in turns by time, and back: of a constant period from an epoch on, or of a predictor's
    segments as fold.predictor() takes them."""

    def __init__(self, period_us: int = 0, epoch_us: int = 0, segments: Sequence[tuple] = (), span_us: int = 0, first_us: int = 0) -> None:
        self.period, self.epoch, self.span, self.first = period_us, epoch_us, span_us, first_us
        self.segments = {(int(m) - first_us) // span_us: (int(m), float(p), float(f), [float(c) for c in cs]) for m, p, f, cs in segments}

    def at(self, us: np.ndarray) -> np.ndarray:
        """NaN where no segment covers a time."""
        us = np.asarray(us, np.int64)
        if self.period:
            return (us - self.epoch) // self.period + (us - self.epoch) % self.period / self.period
        out, number = np.full(len(us), np.nan), (us - self.first) // self.span
        for k in np.unique(number).tolist():
            if k in self.segments:
                middle, phase, frequency, powers = self.segments[k]
                own = number == k
                dt = (us[own] - middle) / 60e6
                out[own] = phase + 60.0 * dt * frequency + np.polynomial.polynomial.polyval(dt, powers or [0.0])
        return out

    def when(self, turn: float) -> int:
        """The first microsecond at which the phase has reached that turn; the end of the last segment
        where it never does, the begin of the next where it does so in a gap."""
        if self.period:
            return self.epoch + int(np.ceil(turn * self.period))
        end = 0
        for k in sorted(self.segments):
            low, high = self.first + k * self.span, self.first + (k + 1) * self.span
            end = high
            if self.at(np.array([high - 1]))[0] < turn:
                continue
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if self.at(np.array([middle]))[0] >= turn else (middle + 1, high)
            return low
        return end
