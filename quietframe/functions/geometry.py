"""Frame geometry and parameters of a processor, computed once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntEnum

import numpy as np

from . import fixed as K


class Padding(IntEnum):
    NONE = 0
    POWER_OF_TWO = 1
    FIXED = 2


class Window(IntEnum):
    HANN = 0
    HAMMING = 1
    BLACKMAN = 2
    VORBIS = 3


class Profile(IntEnum):
    MEAN = 1
    MEDIAN = 2
    MAX = 3
    MIN = 4


class Adaptive(IntEnum):
    SPP = 0
    BRANDT = 1
    MARTIN = 2


def next_even(n: int) -> int:
    return n + n % 2


def next_power_of_two(n: int) -> int:
    """Smallest power of two that is at least n; 1 for n <= 0."""
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def fft_size(frame: int, padding: Padding, amount: int = K.ZERO_PADDING) -> int:
    if padding == Padding.POWER_OF_TWO:
        return next_power_of_two(frame)
    return next_even(frame + (amount if padding == Padding.FIXED else 0))


def db_to_gain(db: float) -> float:
    return 10 ** (db / 20)


def log_like(x: float) -> float:
    """Share 0..1 to 1 - exp(-3x)."""
    return 1 - float(np.exp(-3 * x))


@dataclass(frozen=True)
class Geometry:
    """Sizes of a short-time transform; ``frame`` and ``hop`` are truncated independently."""

    rate: int
    frame: int
    hop: int
    fft: int

    @property
    def bins(self) -> int:
        return self.fft // 2 + 1

    def bin_to_hz(self, k: float) -> float:
        return k * self.rate / self.fft

    def hz_to_bin(self, hz: float) -> int:
        """The nearest bin, halves up."""
        return int(np.floor(hz / (self.rate / self.fft) + 0.5))

    @property
    def copy_at(self) -> int:
        """Where a frame begins in its zero-padded transform."""
        return self.fft // 2 - self.frame // 2

    @property
    def latency(self) -> int:
        return self.frame

    @property
    def latency_2d(self) -> int:
        """As reported: the look-ahead is counted in quarters of the transform, not in hops."""
        return self.frame + K.NLM_FUTURE * (self.fft // 4)


def geometry(rate: int, frame_ms: float, two_d: bool = False, overlap: int = K.OVERLAP, padding: Padding = Padding.FIXED, amount: int = K.ZERO_PADDING) -> Geometry:
    """1D accepts 4 to 192 kHz, 2D any rate but 0."""
    if rate <= 0 or (not two_d and not 4000 <= rate <= 192000) or frame_ms <= 0:
        raise ValueError(f"unsupported sample rate {rate} or frame of {frame_ms} ms")
    frame = int(np.float32(np.float32(frame_ms) / np.float32(1000.0)) * np.float32(rate))
    if frame < overlap:
        raise ValueError("frame too short")
    return Geometry(rate, frame, frame // overlap, fft_size(frame, padding, amount))


@dataclass(frozen=True)
class Parameters:
    """User units: dB for reductions, percent for smoothing, whitening and strength (see ``loaded``)."""

    learn_noise: int = 0
    residual_listen: bool = False
    reduction_amount: float = 10.0
    smoothing_factor: float = 0.0
    whitening_factor: float = 0.0
    adaptive_noise: int = 0
    noise_estimation_method: int = 0
    masking_depth: float = 0.0
    suppression_strength: float = 0.0
    aggressiveness: float = 0.0
    tonal_reduction: float = 0.0

    def loaded(self, two_d: bool = False) -> Parameters:
        """Linear units.  1D smoothing is bent by 1 - exp(-3x); 2D smoothing is the filter's h as it is."""
        return replace(
            self,
            reduction_amount=db_to_gain(-self.reduction_amount),
            tonal_reduction=db_to_gain(-self.tonal_reduction),
            whitening_factor=self.whitening_factor / 100,
            suppression_strength=self.suppression_strength / 100,
            smoothing_factor=self.smoothing_factor if two_d else log_like(self.smoothing_factor / 100),
        )
