"""Frequency responses on the driver: arrays of (channels, points) complex numbers, or (channels,
points, 2, 2) where they act on both polarizations. One channel matches any number of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def is_matrix(response: np.ndarray) -> bool:
    return response.ndim == 4


def matched(response: np.ndarray, channels: int, points: int) -> np.ndarray:
    """response with that many channels and points: points of one long channel are dealt out to
    channels in order, and a channel or a point alone stands for all."""
    tail = response.shape[2:]
    if response.shape[0] == 1 and response.shape[1] == channels * points and channels > 1:
        return response.reshape(channels, points, *tail)
    if response.shape[0] not in (1, channels) or response.shape[1] not in (1, points):
        raise ValueError(f"a response of {response.shape[:2]} doesn't match {(channels, points)}")
    return np.broadcast_to(response, (channels, points, *tail))


def product(responses: Sequence[np.ndarray], match: int = 0) -> np.ndarray:
    """The product of responses, each matched to the one at `match`; a scalar one multiplies both
    polarizations, and matrices multiply in order, the first leftmost."""
    if not responses:
        raise ValueError("no responses to multiply")
    channels, points = responses[match].shape[:2]
    out = None
    for response in (matched(r, channels, points) for r in responses):
        if out is None:
            out = response
        elif is_matrix(out) and is_matrix(response):
            out = out @ response
        else:
            a, b = (x if is_matrix(x) or not (is_matrix(out) or is_matrix(response)) else x[:, :, None, None] for x in (out, response))
            out = a * b
    return np.array(out)


def by_frequency(response: np.ndarray) -> np.ndarray:
    """From FFT order to order of frequency, channel by channel."""
    return np.fft.fftshift(response, axes=1)


def fft_order(response: np.ndarray) -> np.ndarray:
    return np.fft.ifftshift(response, axes=1)


def halves_swapped(response: np.ndarray) -> np.ndarray:
    """The halves of the whole band, all channels in order, exchanged."""
    flat = response.reshape(-1, *response.shape[2:])
    return np.roll(flat, len(flat) // 2, axis=0).reshape(response.shape)


def rotated(response: np.ndarray, by: int) -> np.ndarray:
    """Point i of the whole band becomes what point i + by was."""
    flat = response.reshape(-1, *response.shape[2:])
    return np.roll(flat, -by, axis=0).reshape(response.shape)


def scrunched(response: np.ndarray, points: int) -> np.ndarray:
    """Sums of neighbouring points, that many left a channel."""
    if points < 1 or response.shape[1] % points:
        raise ValueError(f"{response.shape[1]} points don't go evenly into {points}")
    return response.reshape(response.shape[0], points, -1, *response.shape[2:]).sum(2)


def power(spectra: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Summed powers (channels, points) of spectra (spectra, channels, points) times a response."""
    return (np.abs(spectra * response) ** 2).sum(0)


def single_axis(gain: np.ndarray, ratio: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Jones matrices (1, points, 2, 2) of receivers with that gain, ratio of the second probe's gain
    to the first's, and phase of the second against the first, radians."""
    out = np.zeros((1, len(gain), 2, 2), complex)
    out[0, :, 0, 0] = gain
    out[0, :, 1, 1] = gain * ratio * np.exp(1j * phase)
    return out


def undone(jones: np.ndarray) -> np.ndarray:
    """The response that takes such a receiver's effect away; 0 where it can't be."""
    determinant = jones[..., 0, 0] * jones[..., 1, 1] - jones[..., 0, 1] * jones[..., 1, 0]
    adjugate = np.stack([np.stack([jones[..., 1, 1], -jones[..., 0, 1]], -1), np.stack([-jones[..., 1, 0], jones[..., 0, 0]], -1)], -2)
    safe = np.where(determinant == 0, 1, determinant)
    return np.where(determinant == 0, 0, 1 / safe)[..., None, None] * adjugate
