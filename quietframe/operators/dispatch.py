"""One entry for each family of array kernels: features, suppression, gains, smoothing.

A kind is named by its enum; an unknown one raises ``ValueError``.  All take a
frame's power spectrum on the last axis.
"""

from __future__ import annotations

from enum import IntEnum

import numpy as np

from ..functions import fixed as K
from ..functions import spectra
from ..functions.bands import band_sums, bands
from .psycho import Masking, TimeSmoother


class Feature(IntEnum):
    POWER = 0
    MAGNITUDE = 1
    PHASE = 2


class Suppress(IntEnum):
    BEROUTI = 0
    GLOBAL_SNR = 1
    BAND_SNR = 2
    MASKING = 3
    NONE = 4


class Gain(IntEnum):
    GATE = 0
    WIENER = 1
    SUBTRACTION = 2


class Smoothing(IntEnum):
    NONE = 0
    FIXED = 1
    TRANSIENT_AWARE = 2


def feature(spectrum: np.ndarray, kind: Feature) -> np.ndarray:
    """Power, magnitude or phase of complex bins; the first and, of an even transform, the last bin are real."""
    z = np.asarray(spectrum)
    match Feature(kind):
        case Feature.POWER:
            return z.real**2 + z.imag**2
        case Feature.MAGNITUDE:
            return np.hypot(z.real, z.imag)
        case Feature.PHASE:
            return np.arctan2(z.imag, z.real)


def _level_db(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return 10 * np.log10(x / (n + K.EPSILON))


def snr_alpha(x: np.ndarray, n: np.ndarray, strength: float) -> np.ndarray:
    """From summed power: ``strength`` at 0 dB and below, 1 at 20 dB and above."""
    t = np.clip(_level_db(x, n) / K.SNR_HIGH_DB, 0, 1)
    return strength + (K.ALPHA_MIN - strength) * t


def masking_alpha(nmr_db: np.ndarray, strength: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Masked noise (0 dB and less over its mask) gets a tenth of the way to ``strength``; above, it rises from 1 to it."""
    t = np.clip(nmr_db / K.SNR_HIGH_DB, 0, 1)
    return np.where(nmr_db <= 0, K.ALPHA_MIN + (strength - K.ALPHA_MIN) * 0.1, K.ALPHA_MIN + (strength - K.ALPHA_MIN) * t), beta * t


class Suppression:
    """Over- and under-subtraction of each bin by a strategy; only the masking one remembers frames."""

    def __init__(self, kind: Suppress, rate: int, fft: int, scale: str = "bark"):
        self.kind, self.ranges = Suppress(kind), bands(rate, fft, scale)
        self.masking = Masking(rate, fft, scale) if self.kind == Suppress.MASKING else None

    def step(self, x: np.ndarray, noise: np.ndarray, strength: float, beta: float = K.DEFAULT_BETA) -> tuple[np.ndarray, np.ndarray]:
        flat = np.full(len(x), float(beta))
        match self.kind:
            case Suppress.BEROUTI:
                return spectra.berouti(x, noise, strength), np.zeros(len(x))
            case Suppress.GLOBAL_SNR:
                return np.full(len(x), float(snr_alpha(x.sum(), noise.sum(), strength))), flat
            case Suppress.BAND_SNR:
                alpha = snr_alpha(band_sums(x, self.ranges), band_sums(noise, self.ranges), strength)
                return np.repeat(alpha, [hi - lo for lo, hi in self.ranges]), flat
            case Suppress.MASKING:
                threshold = self.masking.step(np.maximum(x - noise, 0))
                return masking_alpha(_level_db(noise, threshold), strength, beta)
            case Suppress.NONE:
                return np.ones(len(x)), np.zeros(len(x))


def gains(kind: Gain, x: np.ndarray, noise: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gains of the bins up to the middle; see :func:`mirrored` for a whole transform."""
    match Gain(kind):
        case Gain.GATE:
            m = alpha * noise
            return np.where((m <= K.FLOAT_MIN) | (x >= m), 1.0, 0.0)
        case Gain.WIENER:
            return spectra.wiener(x, noise, alpha)
        case Gain.SUBTRACTION:
            heard = x > K.FLOAT_MIN
            r = (noise / np.where(heard, x, 1)) ** 2
            with np.errstate(divide="ignore"):
                loud = r < 1 / (alpha + beta)
            return np.where(heard, np.sqrt(np.maximum(np.where(loud, 1 - alpha * r, beta * r), 0)), 1.0)


def mirrored(gain: np.ndarray, fft: int) -> np.ndarray:
    """Gains of all ``fft`` places of a transform: those past the middle as their counterparts."""
    at = np.arange(fft)
    return gain[..., np.minimum(at, fft - at)]


class Smoother:
    """Smoothing in time by kind; every kind but none damps rises only."""

    def __init__(self, kind: Smoothing, rate: int, fft: int):
        self.kind = Smoothing(kind)
        self.inner = TimeSmoother(fft // 2 + 1, bands(rate, fft, "bark") if self.kind == Smoothing.TRANSIENT_AWARE else None)

    def step(self, x: np.ndarray, smoothing: float) -> np.ndarray:
        return x.copy() if self.kind == Smoothing.NONE else self.inner.step(x, smoothing)
