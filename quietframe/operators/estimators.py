"""Ordered noise estimators: one step per frame, all bins at once."""

from __future__ import annotations

import numpy as np

from ..functions import fixed as K
from ..functions import spectra
from ..functions.geometry import Adaptive


class SppMmse:
    """Minimum mean square error estimate by the probability that speech is present."""

    def __init__(self, bins: int):
        self.noise = np.zeros(bins)
        self.presence = np.zeros(bins)
        self.fresh = True

    def step(self, x: np.ndarray) -> np.ndarray:
        if x.mean() < K.SILENCE:
            return self.noise.copy()
        if self.fresh:
            self.fresh = False
            self.noise = x.astype(float).copy()
            return self.noise.copy()
        ratio = x / np.maximum(self.noise, K.EPSILON)
        p = 1 / (1 + (1 + K.SPP_XI) * np.exp(-ratio * K.SPP_XI / (1 + K.SPP_XI)))
        self.presence = K.SPP_SMOOTHING * self.presence + (1 - K.SPP_SMOOTHING) * p
        p = np.where(self.presence > K.SPP_CAP, np.minimum(p, K.SPP_CAP), p)
        self.noise = K.SPP_POWER * self.noise + (1 - K.SPP_POWER) * ((1 - p) * x + p * self.noise)
        return self.noise.copy()

    def seed(self, profile: np.ndarray, start: bool = False) -> None:
        self.noise = np.maximum(profile, K.FLOAT_MIN)
        self.presence = np.zeros(len(profile))
        if start:
            self.fresh = False

    def raise_to(self, floor: np.ndarray) -> None:
        self.noise = np.maximum(self.noise, floor)


class Martin:
    """Minimum statistics: least smoothed power of eight windows of twelve frames, times a bias."""

    def __init__(self, bins: int):
        self.power = self.low = np.zeros(bins)
        self.history = np.zeros((K.MARTIN_WINDOWS, bins))
        self.at = self.count = 0
        self.fresh = True

    def step(self, x: np.ndarray) -> np.ndarray:
        silent = x.mean() < K.SILENCE
        if self.fresh:
            if silent:
                return np.zeros(len(x))
            self.seed(x, True)
            self.count = 1
            return x.astype(float).copy()
        if not silent:
            self.power = K.MARTIN_SMOOTHING * self.power + (1 - K.MARTIN_SMOOTHING) * x
            self.low = np.minimum(self.low, self.power)
            if self.count >= K.MARTIN_FRAMES:
                self.history[self.at] = self.low
                self.low = self.power.copy()
                self.at = (self.at + 1) % K.MARTIN_WINDOWS
                self.count = 0
        self.count += 1
        return np.minimum(self.low, self.history.min(0)) * K.MARTIN_BIAS

    def seed(self, profile: np.ndarray, start: bool = False) -> None:
        value = np.maximum(profile, K.FLOAT_MIN) / K.MARTIN_BIAS
        self.power, self.low = value.copy(), value.copy()
        self.history = np.tile(value, (K.MARTIN_WINDOWS, 1))
        self.fresh, self.count = False, 0

    def raise_to(self, floor: np.ndarray) -> None:
        self.power, self.low = np.maximum(self.power, floor), np.maximum(self.low, floor)
        self.history = np.maximum(self.history, floor)


def trimmed_correction(p: float) -> float:
    """Mean of an exponential over the mean of its lowest share p."""
    return 1.0 if p >= 1 else 1 / (1 + (1 - p) / p * np.log(1 - p))


def brandt_history(rate: int, fft: int, duration_ms: float = K.BRANDT_MS) -> int:
    step = max(np.float32(fft) * np.float32(1000) / np.float32(rate) * np.float32(0.5), np.float32(K.BRANDT_MIN_MS))
    return max(int(np.float32(duration_ms) / step), K.BRANDT_MIN_FRAMES)


class Brandt:
    """Trimmed mean of a history whose lowest share looks most like an exponential's."""

    def __init__(self, bins: int, rate: int, fft: int, duration_ms: float = K.BRANDT_MS):
        self.size = brandt_history(rate, fft, duration_ms)
        self.history = np.zeros((bins, self.size))
        self.last = np.zeros(bins)
        self.at = 0
        self.fresh = True

    def step(self, x: np.ndarray) -> np.ndarray:
        silent = x.mean() < K.SILENCE
        if self.fresh and x.mean() > K.SILENCE:
            self.seed(x, True)
        if silent:
            return self.last.copy()
        self.history[:, self.at] = x
        self.at = (self.at + 1) % self.size
        ordered = np.sort(self.history, 1)
        upto = np.cumsum(ordered, 1)
        best, best_mean = np.full(len(x), 2.0), self.last.copy()
        for p in K.BRANDT_SHARES:
            q = int(np.float32(p) * np.float32(self.size))
            if q < K.BRANDT_MIN_RANK:
                continue
            low = upto[:, q - 1] / q
            mean = low * trimmed_correction(p)
            misfit = self._misfit(ordered[:, :q], mean, q)
            better = (low > K.SILENCE) & (misfit < best)
            best, best_mean = np.where(better, misfit, best), np.where(better, mean, best_mean)
        self.last = np.where(1 - best >= K.BRANDT_CONFIDENCE, best_mean, self.last)
        return self.last.copy()

    @staticmethod
    def _misfit(ordered: np.ndarray, mean: np.ndarray, q: int) -> np.ndarray:
        usable = mean >= 1e-15
        safe = np.where(usable, mean, 1)[:, None]
        whole = 1 - np.exp(-ordered[:, -1:] / safe)
        usable &= np.abs(whole[:, 0]) >= K.EPSILON
        expected = (1 - np.exp(-ordered / safe)) / np.where(np.abs(whole) < K.EPSILON, 1, whole)
        return np.where(usable, np.abs(np.arange(1, q + 1) / q - expected).sum(1) * 2 / q, 1.0)

    def seed(self, profile: np.ndarray, start: bool = False) -> None:
        bins = np.arange(len(profile))[:, None]
        jitter = 1 + 0.01 * ((np.arange(self.size) + bins) % 11 - 5) / 5
        self.history = profile[:, None] / trimmed_correction(K.BRANDT_PERCENTILE) * jitter
        self.last = profile.astype(float).copy()
        self.fresh = False

    def raise_to(self, floor: np.ndarray) -> None:
        self.history = np.maximum(self.history, (floor / trimmed_correction(K.BRANDT_PERCENTILE))[:, None])


class AdaptiveNoise:
    """One of the estimators; what it gives is gap-filled and smoothed, its state is not."""

    def __init__(self, method: int, bins: int, rate: int, fft: int):
        if method == Adaptive.SPP:
            self.inner: SppMmse | Martin | Brandt = SppMmse(bins)
        elif method == Adaptive.BRANDT:
            self.inner = Brandt(bins, rate, fft)
        else:
            self.inner = Martin(bins)

    def step(self, x: np.ndarray) -> np.ndarray:
        return spectra.smooth3(spectra.fill_gaps(self.inner.step(x), K.GAP_THRESHOLD), K.PROFILE_SMOOTHING)

    def set_state(self, profile: np.ndarray) -> None:
        self.inner.seed(profile, True)

    def update_seed(self, profile: np.ndarray) -> None:
        self.inner.seed(profile)

    def raise_to(self, floor: np.ndarray) -> None:
        self.inner.raise_to(floor)


class Learner:
    """Profiles of the four modes; MEDIAN is over a ring that starts with zeros, MIN starts at zero."""

    def __init__(self, bins: int):
        self.bins = bins
        self.values = {m: np.zeros(bins) for m in (1, 2, 3, 4)}
        self.counts = dict.fromkeys((1, 2, 3, 4), 0)
        self.available = dict.fromkeys((1, 2, 3, 4), False)
        self.ring = np.zeros((K.MEDIAN_FRAMES, bins))

    def learn(self, x: np.ndarray) -> None:
        n = self.counts[1]
        self.values[1] = x.astype(float).copy() if n < 2 else self.values[1] + (x - self.values[1]) / n
        self.ring[n % K.MEDIAN_FRAMES] = x
        self.values[2] = np.median(self.ring, 0)
        self.values[3] = np.maximum(self.values[3], x)
        self.values[4] = np.minimum(self.values[4], x)
        for m in self.counts:
            self.increment(m)
        for m in (2, 3, 4):
            self.available[m] = True

    def increment(self, mode: int) -> None:
        self.counts[mode] += 1
        if self.counts[mode] > K.MEAN_FRAMES_AVAILABLE:
            self.available[mode] = True

    def refine(self) -> None:
        for m, ok in self.available.items():
            if ok:
                self.values[m] = spectra.smooth3(spectra.fill_gaps(self.values[m], K.GAP_THRESHOLD), K.PROFILE_SMOOTHING)

    def load(self, mode: int, profile: np.ndarray, count: int) -> None:
        if mode not in self.values or len(profile) != self.bins:
            raise ValueError("unknown mode or wrong profile length")
        self.values[mode], self.counts[mode], self.available[mode] = np.array(profile, float), count, True

    def reset(self) -> None:
        self.__init__(self.bins)

    def morphed(self, a: float) -> np.ndarray:
        v = self.values
        return spectra.morph(v[1], v[2], v[3], v[4], a)
