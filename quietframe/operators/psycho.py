"""Masking thresholds, transients, and the veto that protects what masks its noise."""

from __future__ import annotations

import numpy as np

from ..functions import fixed as K
from ..functions import spectra
from ..functions.bands import band_sums, bands, centers, hearing_threshold, spread, tonality


class Transients:
    """Onset weight of each band against a slow average that hurries after onsets."""

    def __init__(self):
        self.average: np.ndarray | None = None

    def step(self, energy: np.ndarray) -> tuple[np.ndarray, bool]:
        if self.average is None:
            self.average = energy.astype(float).copy()
        weight = np.clip((energy / (self.average + 1e-9) - 1) / K.ONSET_SENSITIVITY, 0, 1)
        weight = np.where(energy < K.ONSET_ENERGY, 0, weight)
        a = np.where(weight > 0, K.ONSET_SMOOTHING / 2, K.ONSET_SMOOTHING)
        self.average = energy * (1 - a) + self.average * a
        return weight, bool((weight > 0.5).any())


class TimeSmoother:
    """Damps rises only; with ``ranges``, less where a band has an onset."""

    def __init__(self, bins: int, ranges: list[tuple[int, int]] | None = None):
        self.previous = np.zeros(bins)
        self.ranges = ranges
        self.transients = Transients()

    def step(self, x: np.ndarray, smoothing: float) -> np.ndarray:
        s = np.full(len(x), smoothing)
        if self.ranges:
            weight, _ = self.transients.step(band_sums(x, self.ranges))
            for (lo, hi), w in zip(self.ranges, weight, strict=True):
                s[lo:hi] = smoothing * (1 - w)
        self.previous = np.where(x > self.previous, s * self.previous + (1 - s) * x, x)
        return self.previous.copy()


class Masking:
    """Masking thresholds by bin: spread over bands, carried forward (and back) in time."""

    def __init__(self, rate: int, fft: int, scale: str = "bark", absolute: bool = True, temporal: bool = True):
        self.ranges = bands(rate, fft, scale)
        n = len(self.ranges)
        self.width = np.array([hi - lo for lo, hi in self.ranges])
        hop = fft / (4 * rate)
        w = np.minimum(np.arange(n), 24) / 24
        self.forward = np.exp(-hop / ((1 - w) * K.FORWARD_LOW_S + w * K.FORWARD_HIGH_S))
        self.backward = np.exp(-hop / K.BACKWARD_S)
        self.previous = np.zeros(n)
        self.temporal = temporal
        self.hearing = hearing_threshold(rate, fft) if absolute else None

    def band_threshold(self, x: np.ndarray) -> np.ndarray:
        """Simultaneous masking alone."""
        t = tonality(x, self.ranges)
        offset = t * (K.TONE_OFFSET + np.minimum(np.arange(len(self.ranges)) + 1, 25)) + K.NOISE_OFFSET * (1 - t)
        return 10 ** (np.log10(spread(band_sums(x, self.ranges)) + K.EPSILON) - offset / 10)

    def step(self, x: np.ndarray, future: np.ndarray | None = None) -> np.ndarray:
        threshold = self.band_threshold(x)
        if self.temporal:
            p = K.TIME_EXPONENT
            total = threshold**p + (self.previous * self.forward) ** p
            if future is not None:
                total = total + (self.band_threshold(future) * self.backward) ** p
            threshold = total ** (1 / p)
        self.previous = threshold
        out = np.repeat(threshold, self.width)
        if self.hearing is not None:
            db, reference = self.hearing
            level = np.maximum(10 * np.log10(out + K.EPSILON) + reference, db)
            out = np.maximum(10 ** ((level - reference) / 10) - K.EPSILON, 0)
        return out


def between_bands(values: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """Band values to bins, straight lines between centers; a bin on a center that several bands share takes the first's."""
    k = np.arange(bins, dtype=float)
    right = np.searchsorted(at[1:], k, side="left") + 1  # the first center that the bin does not lie beyond
    last = right >= len(at)
    right = np.minimum(right, len(at) - 1)
    left = np.where(last, right, right - 1)
    width = at[right] - at[left]
    t = np.clip((k - at[left]) / np.where(width > 0, width, 1), 0, 1)
    return np.where(width > 0, values[left] * (1 - t) + values[right] * t, values[left])


class Veto:
    """Draws over-subtraction back to 1 where noise is masked and the bin holds signal."""

    def __init__(self, rate: int, fft: int, scale: str = "bark"):
        self.masking = Masking(rate, fft, scale)
        self.ranges = self.masking.ranges
        self.at = centers(self.ranges)
        self.clean = np.zeros(fft // 2 + 1)
        self.memory = np.zeros(len(self.ranges))

    def step(self, x: np.ndarray, noise: np.ndarray, alpha: np.ndarray, depth: float, future: np.ndarray | None = None) -> np.ndarray:
        if depth < 0:
            return alpha
        a = K.VETO_SMOOTHING
        self.clean = a * np.maximum(x - noise, 0) + (1 - a) * self.clean
        ahead = None if future is None else np.maximum(future - noise, 0)
        threshold = self.masking.step(self.clean, ahead)
        nmr = 10 * np.log10((band_sums(noise, self.ranges) + K.EPSILON) / (band_sums(threshold, self.ranges) + K.EPSILON))
        protection = np.where(self.masking.width > 0, np.clip(1 - nmr / K.VETO_RANGE_DB, 0, 1), 0)
        self.memory = a * protection + (1 - a) * self.memory
        by_bin = between_bands(spectra.smooth_bands(self.memory), self.at, len(x))
        amount = by_bin * np.minimum(self.clean / (noise + K.EPSILON), 1) * depth
        return alpha + (1 - alpha) * amount
