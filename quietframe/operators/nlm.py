"""Non-local means over the time-frequency plane of signal-to-noise ratios."""

from __future__ import annotations

import numpy as np

from ..functions import fixed as K


def fast_exp(x: np.ndarray) -> np.ndarray:
    """exp by writing a line into a float's bits (within 4 %); exactly 0 below -20."""
    bits = (np.float32(12102203.0) * np.asarray(x, np.float32) + np.float32(1064866805.0)).astype(np.float64)
    return np.where(np.asarray(x) < -20, 0.0, np.clip(bits, 0, 2**32 - 1).astype(np.uint32).view(np.float32).astype(float))


class Nlm:
    """Ring of frames; each block of bins is replaced by a mean of alike blocks nearby."""

    def __init__(self, bins: int, h: float = 1.0, patch: int = K.NLM_PATCH, block: int = K.NLM_BLOCK, freq: int = K.NLM_FREQ, past: int = K.NLM_PAST, future: int = K.NLM_FUTURE, exact_exp: bool = False):
        self.bins, self.h, self.patch, self.block, self.freq, self.past, self.future = bins, h, patch, block, freq, past, future
        self.size = past + future + 1
        self.frames = np.zeros((self.size, bins))
        self.head = self.filled = 0
        self.exp = np.exp if exact_exp else fast_exp

    @property
    def ready(self) -> bool:
        return self.filled >= self.size

    def set_h(self, h: float) -> None:
        if h > 0:
            self.h = h

    def push(self, frame: np.ndarray) -> None:
        self.frames[self.head] = frame
        self.head = (self.head + 1) % self.size
        self.filled += 1

    def reset(self) -> None:
        self.frames[:] = 0
        self.head = self.filled = 0

    def _at(self, offset: np.ndarray) -> np.ndarray:
        """Ring rows at offsets from the target; beyond the ring's size they wrap."""
        return (self.head - self.future - 1 + offset) % self.size

    def process(self) -> np.ndarray | None:
        """The smoothed target frame, or None until the ring is full."""
        if not self.ready:
            return None
        half, n = self.patch // 2, self.bins
        target = self.frames[self._at(np.array(0))]
        begin = np.arange(0, n, self.block)
        center = np.minimum(begin + self.block // 2, n - 1)
        scale = 1 + K.NLM_FREQ_SCALE * (center / (n - 1)) ** 2 if n > 1 else np.ones(len(center))
        h2 = (self.h * scale) ** 2
        rows = np.arange(self.patch) - half
        cols = np.arange(self.patch) - half
        own = self.frames[self._at(rows)][:, np.clip(center[:, None] + cols, 0, n - 1)]  # patch row, block, patch column
        active = np.add.reduceat(target, begin) >= 1e-6
        total, weights = np.zeros(n), np.zeros(n)
        of_block = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
        shift = np.arange(-self.freq, self.freq + 1)
        near = np.clip(center[:, None] + shift, 0, n - 1)
        spot = np.clip(near[..., None] + cols, 0, n - 1)
        for dt in range(-self.past, self.future + 1):
            other = self.frames[self._at(dt + rows)][:, spot]  # patch row, block, shift, patch column
            distance = ((own[:, :, None, :] - other) ** 2).sum((0, 3))
            w = np.where(distance > K.NLM_DISTANCE * h2[:, None], 0.0, self.exp(-distance / h2[:, None]))
            w = np.where((w < K.NLM_LEAST_WEIGHT) | ~active[:, None], 0.0, w)
            frame = self.frames[self._at(np.array(dt))]
            values = frame[np.clip(np.arange(n)[:, None] + shift, 0, n - 1)]
            total += (w[of_block] * values).sum(1)
            weights += w[of_block].sum(1)
        return np.where(weights > K.NLM_LEAST_WEIGHT, total / np.where(weights > 0, weights, 1), target)


def snr(power: np.ndarray, noise: np.ndarray) -> np.ndarray:
    return power / np.maximum(noise, K.NLM_FLOOR)


def reconstruct(ratio: np.ndarray, noise: np.ndarray) -> np.ndarray:
    return ratio * np.maximum(noise, K.NLM_FLOOR)
