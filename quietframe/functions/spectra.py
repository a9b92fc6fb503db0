"""Array kernels of the spectral method, in NumPy and double precision.

A spectrum is the last axis; all kernels take any number of leading axes, so a
whole stream of frames is one call wherever frames do not depend on each other.
"""

from __future__ import annotations

import numpy as np

from . import fixed as K
from .geometry import Geometry, Window


def window(kind: Window, n: int) -> np.ndarray:
    """Periodic window of n points; subnormal values become 0."""
    p = np.arange(n) / n
    if kind == Window.HANN:
        w = 0.5 - 0.5 * np.cos(2 * np.pi * p)
    elif kind == Window.HAMMING:
        w = 0.54 - 0.46 * np.cos(2 * np.pi * p)
    elif kind == Window.BLACKMAN:
        w = 0.42 - 0.5 * np.cos(2 * np.pi * p) + 0.08 * np.cos(4 * np.pi * p)
    elif kind == Window.VORBIS:
        w = np.sin(np.pi / 2 * np.sin(np.pi * p) ** 2)
    else:
        raise ValueError(f"unknown window {kind}")
    return sanitize(np.where(np.abs(w) < 1e-15, 0.0, w))


def sanitize(x: np.ndarray) -> np.ndarray:
    """Zero for everything that is not a normal single-precision number."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(x) & (np.abs(x) >= K.FLOAT_MIN), x, 0.0)


def frame_signal(x: np.ndarray, g: Geometry) -> np.ndarray:
    """Frames (n, frame): frame n covers samples [(n+1) hop - frame, (n+1) hop), zeros before the start."""
    n = len(x) // g.hop
    padded = np.concatenate((np.zeros(g.frame), x))
    at = (np.arange(n)[:, None] + 1) * g.hop + np.arange(g.frame)
    return padded[at]


def scale_factor(w_in: np.ndarray, w_out: np.ndarray, g: Geometry) -> float:
    """What overlap-add multiplies a signal by, with a normalised inverse transform."""
    total = float((w_in * w_out).sum())
    return total / g.hop if g.hop and total >= np.finfo(np.float32).eps else 1.0


def analyze(frames: np.ndarray, g: Geometry) -> np.ndarray:
    padded = np.zeros((*frames.shape[:-1], g.fft))
    padded[..., g.copy_at : g.copy_at + g.frame] = frames * window(Window.HANN, g.frame)
    return np.fft.rfft(padded)


def synthesize(spectra: np.ndarray, g: Geometry) -> np.ndarray:
    w = window(Window.HANN, g.frame)
    return np.fft.irfft(spectra, g.fft)[..., g.copy_at : g.copy_at + g.frame] * (w / scale_factor(w, w, g))


def overlap_add(frames: np.ndarray, g: Geometry, length: int) -> np.ndarray:
    """Output of the same length as the input: delayed by a frame, the last frame never leaves."""
    out = np.zeros(length + 2 * g.frame)
    for i, f in enumerate(frames):
        end = (i + 1) * g.hop
        out[end : end + g.frame] += f
    return out[:length]


def smooth3(x: np.ndarray, factor: float) -> np.ndarray:
    """Mean of a bin and its neighbours (two at the ends), mixed in by ``factor``."""
    total, n = x.copy(), np.full(x.shape[-1], 3.0)
    total[..., 1:] += x[..., :-1]
    total[..., :-1] += x[..., 1:]
    n[0] = n[-1] = 2
    return total / n * factor + x * (1 - factor)


def fill_gaps(x: np.ndarray, threshold: float) -> np.ndarray:
    """Straight lines over bins below ``threshold``; bin 0 anchors, a gap at the end stays."""
    out = np.array(x, float)
    for row in out.reshape(-1, out.shape[-1]):
        n = len(row)
        anchor = row >= threshold
        left = np.maximum.accumulate(np.where(anchor | (np.arange(n) == 0), np.arange(n), 0))
        right = np.minimum.accumulate(np.where(anchor, np.arange(n), n)[::-1])[::-1]
        gap = np.flatnonzero(~anchor & (np.arange(n) > 0) & (np.arange(n) < n - 1) & (right < n))
        a, b = left[gap], right[gap]
        row[gap] = row[a] + (row[b] - row[a]) * (gap - a) / (b - a)
    return out


def smooth_bands(x: np.ndarray) -> np.ndarray:
    """Quarter, half, quarter; element 0 is left alone, the last is its own right neighbour."""
    out = x.copy()
    right = np.concatenate((x[..., 2:], x[..., -1:]), -1)
    out[..., 1:] = 0.25 * x[..., :-1] + 0.5 * x[..., 1:] + 0.25 * right
    return out if x.shape[-1] > 1 else x


def morph(mean: np.ndarray, median: np.ndarray, top: np.ndarray, low: np.ndarray, a: float) -> np.ndarray:
    other, share = (median, -a) if a < 0 else (top, a)
    return np.maximum(mean * (1 - share) + other * share, low)


def tonal_mask(profile: np.ndarray) -> np.ndarray:
    """How far bins stand out of a running median over 51 bins (ends repeated)."""
    half = K.TONAL_WINDOW // 2
    padded = np.concatenate((np.repeat(profile[..., :1], half, -1), profile, np.repeat(profile[..., -1:], half, -1)), -1)
    floor = np.median(np.lib.stride_tricks.sliding_window_view(padded, K.TONAL_WINDOW, axis=-1), axis=-1)
    tone = (profile - floor >= K.PEAK_PROMINENCE) & (profile > K.PEAK_RATIO * np.maximum(floor, K.EPSILON))
    return np.where(tone, (profile - floor) / np.where(profile == 0, 1, profile), 0.0)


def boost_tonal(alpha: np.ndarray, mask: np.ndarray, gain: float) -> np.ndarray:
    if gain >= 0.999:
        return alpha
    return np.where(mask > 0, np.maximum(alpha, 1 + mask * (1 - gain) * (K.ALPHA_MAX_TONAL - 1)), alpha)


def berouti(power: np.ndarray, noise: np.ndarray, strength: float) -> np.ndarray:
    """Over-subtraction by bin SNR: the most at -5 dB and below, 1 at 20 dB and above."""
    most = 1 + (K.ALPHA_MAX - 1) * strength
    with np.errstate(divide="ignore"):
        snr = 10 * np.log10(power / (noise + K.EPSILON))
    return np.clip(most + (1 - most) * (snr - K.SNR_LOW_DB) / (K.SNR_HIGH_DB - K.SNR_LOW_DB), 1, most)


def wiener(power: np.ndarray, noise: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    m = alpha * noise
    return np.where(m <= K.FLOAT_MIN, 1.0, np.where(power > m, (power - m) / np.where(power > m, power, 1), 0.0))


def whitening(profile: np.ndarray, factor: float) -> np.ndarray:
    if factor <= 0:
        return np.ones_like(profile)
    p = smooth3(profile, K.PROFILE_SMOOTHING)
    n = p.shape[-1]
    anchor = np.maximum(np.sort(p, -1)[..., n // 2 : n // 2 + 1], K.EPSILON)
    return np.where(p > K.EPSILON, (anchor / np.where(p > K.EPSILON, p, 1)) ** factor, 1.0)


def noise_floor(gain: np.ndarray, profile: np.ndarray, mask: np.ndarray, reduction: float, tonal: float, factor: float) -> np.ndarray:
    if reduction >= 0.999 and tonal >= 0.999:
        return np.ones_like(gain)
    m = np.maximum(mask, 0) ** 0.25
    path = reduction * (1 - m) + tonal * m
    target = path + factor * (reduction - path)
    floor = target * (1 + (1 - target) * (whitening(profile, factor) - 1))
    return np.maximum(np.minimum(floor, 1), gain)
