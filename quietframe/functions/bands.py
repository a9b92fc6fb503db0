"""Critical bands, hearing threshold and spreading, as small tables for the driver."""

from __future__ import annotations

import numpy as np

from . import fixed as K
from . import spectra
from .geometry import Window


def bands(rate: int, fft: int, scale: str = "bark") -> list[tuple[int, int]]:
    """Half-open bin ranges of the bands below the Nyquist frequency.

    Edges are placed as if the transform had as many points as it has bins, so
    they lie at about half the bin their frequency suggests; the last band
    reaches to the end.
    """
    edges = K.BARK_EDGES if scale == "bark" else K.OPUS_EDGES
    bins = fft // 2 + 1
    n = max([i for i, f in enumerate(edges) if f < rate / 2], default=0) + 1
    stops = [int(f / (rate / bins) + 0.5) for f in edges[:n]]
    stops[-1] = bins
    return list(zip([0, *stops[:-1]], stops, strict=True))


def centers(ranges: list[tuple[int, int]]) -> np.ndarray:
    return np.array([lo + (hi - lo) / 2 for lo, hi in ranges])


def band_sums(x: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    return np.stack([x[..., lo:hi].sum(-1) for lo, hi in ranges], -1)


def tonality(x: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """From flatness: 0 for noise (0 dB), 1 for tones (-60 dB) and for bands of one bin."""
    v = np.maximum(x, K.EPSILON)
    out = []
    for lo, hi in ranges:
        if hi - lo <= 1:
            out.append(np.ones(x.shape[:-1]))
        else:
            flat = 10 * (np.log10(v[..., lo:hi]).mean(-1) - np.log10(v[..., lo:hi].mean(-1)))
            out.append(np.clip(flat / K.FLATNESS_DB, 0, 1))
    return np.stack(out, -1)


def spreading(distance: np.ndarray, level: np.ndarray) -> np.ndarray:
    up = np.clip(K.SLOPE_MAX - (level - K.SLOPE_REFERENCE) * K.SLOPE_FACTOR, K.SLOPE_MIN, K.SLOPE_MAX)
    y = distance + 0.474
    return 10 ** ((15.81 + (K.SLOPE_DOWN - up) / 2 * y - (K.SLOPE_DOWN + up) / 2 * np.sqrt(1 + y * y)) / 10)


def spread(energy: np.ndarray) -> np.ndarray:
    """Power-law sum over all bands of each one's energy spread to each other."""
    n = energy.shape[-1]
    level = 10 * np.log10(energy + K.EPSILON) + K.FULL_SCALE_SPL
    distance = np.arange(n)[:, None] - np.arange(n)[None, :]
    parts = (energy[..., None, :] * spreading(distance, level[..., None, :])) ** K.SPREAD_EXPONENT
    return parts.sum(-1) ** (1 / K.SPREAD_EXPONENT)


def hearing_threshold(rate: int, fft: int) -> tuple[np.ndarray, float]:
    """Absolute threshold in dB by bin, and the level that turns power into dB of sound pressure."""
    khz = np.maximum(np.arange(fft // 2 + 1) * rate / fft, 20) / 1000
    db = 3.64 * khz**-0.8 - 6.5 * np.exp(-0.6 * (khz - 3.3) ** 2) + 1e-3 * khz**4
    sine = np.sin(2 * np.pi * np.arange(fft) * K.REFERENCE_HZ / rate) * spectra.window(Window.VORBIS, fft)
    top = (np.abs(np.fft.rfft(sine)) ** 2).max()
    return db, K.REFERENCE_DB - 10 * np.log10(top + K.EPSILON)
