"""The 1D and 2D noise reduction pipelines over streams of samples.

A stream's samples are gathered in order and all its stages run in one Arrow
task: transforms, estimators and filters are one pass over arrays, and only
samples cross the boundary.  Streams are independent; a plan scales with their
number.  One stream has to fit a task; unbounded streams go through
``streaming.live``, which keeps bounded state instead.
"""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import spectra
from ..functions.bands import bands
from ..functions.geometry import Geometry, Parameters, geometry
from ..operators.estimators import AdaptiveNoise, Learner
from ..operators.nlm import Nlm, reconstruct, snr
from ..operators.psycho import TimeSmoother, Veto


class Processor:
    """Frame-by-frame state of one stream; ``parameters`` are in loaded (linear) units."""

    def __init__(self, g: Geometry, parameters: Parameters, two_d: bool = False, faithful_cache: bool = True):
        self.g, self.two_d = g, two_d
        self.learner = Learner(g.bins)
        self.veto = Veto(g.rate, g.fft)
        self.smoother = TimeSmoother(g.bins)
        self.nlm = Nlm(g.bins)
        self.delay: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(g.bins, complex), np.zeros(g.bins))] * K.NLM_FUTURE
        self.adaptive: AdaptiveNoise | None = None
        self.method = -1
        self.adapting = self.learning = False
        self.floor = np.zeros(g.bins)
        self.cache: tuple[float, bool, np.ndarray] | None = None
        self.faithful_cache = faithful_cache
        self.load(parameters)

    def load(self, p: Parameters) -> None:
        """Take new parameters; another estimation method starts anew."""
        if p.adaptive_noise and p.noise_estimation_method != self.method:
            self.adaptive = AdaptiveNoise(p.noise_estimation_method, self.g.bins, self.g.rate, self.g.fft)
            self.method, self.adapting = p.noise_estimation_method, False
        if self.two_d:
            self.nlm.set_h(p.smoothing_factor)
        self.p = p

    def noise(self, x: np.ndarray) -> np.ndarray:
        if not (self.p.adaptive_noise and self.adaptive):
            self.adapting = False
            return self.learner.morphed(self.p.aggressiveness)
        if not self.adapting:
            self.floor = self.learner.morphed(self.p.aggressiveness)
            self.adaptive.update_seed(self.floor)
            self.adapting = True
        n = self.adaptive.step(x)
        self.adaptive.raise_to(self.floor)
        return np.maximum(n, self.floor)

    def mask(self, noise: np.ndarray) -> np.ndarray:
        """Tonal mask; recomputed when the profile's sum or source changes (so a change of equal sum goes unseen)."""
        learned = bool((self.learner.values[2] > 0).any())
        profile = self.learner.values[3] if learned else noise
        total = float(profile.sum())
        if not self.faithful_cache or self.cache is None or self.cache[:2] != (total, learned):
            self.cache = (total, learned, spectra.tonal_mask(profile))
        return self.cache[2]

    def gains(self, x: np.ndarray, noise: np.ndarray, future: np.ndarray | None = None) -> np.ndarray:
        p = self.p
        alpha = spectra.berouti(x, noise, p.suppression_strength)
        mask = self.mask(noise)
        alpha = spectra.boost_tonal(alpha, mask, p.tonal_reduction)
        if not self.two_d:
            x = self.smoother.step(x, p.smoothing_factor)
        alpha = self.veto.step(x, noise, alpha, p.masking_depth, future)
        return spectra.noise_floor(spectra.wiener(x, noise, alpha), noise, mask, p.reduction_amount, p.tonal_reduction, p.whitening_factor)

    def step(self, spectrum: np.ndarray) -> np.ndarray:
        """One spectrum in, one out (2D: of four frames earlier)."""
        x = spectrum.real**2 + spectrum.imag**2
        if self.p.learn_noise:
            self.learner.learn(x)
            self.learning = True
            return spectrum
        if self.learning:
            self.learner.refine()
            self.learning = False
        noise = self.noise(x)
        if not self.two_d:
            return self._mixed(spectrum, self.gains(x, noise))
        self.delay.append((spectrum, noise))
        late, late_noise = self.delay.pop(0)
        self.nlm.push(snr(x, noise))
        smooth = self.nlm.process()
        if smooth is None:
            return late
        # What serves as the look-ahead is the delayed frame as packed: real parts up to the middle.
        return self._mixed(late, self.gains(reconstruct(smooth, late_noise), late_noise, late.real))

    def _mixed(self, spectrum: np.ndarray, gain: np.ndarray) -> np.ndarray:
        return spectrum - spectrum * gain if self.p.residual_listen else spectrum * gain


def process_signal(
    x: np.ndarray, g: Geometry, parameters: Parameters, learn_samples: int, two_d: bool = False, profiles: dict[int, tuple[np.ndarray, int]] | None = None, controls: list[tuple[int, Parameters]] | None = None
) -> np.ndarray:
    """Learn from the frames that end within the first samples, then reduce noise; output is as long as the input.

    ``profiles`` has, by mode, a profile and the number of frames it was learned
    from.  ``controls`` are parameters (in user units) and the position from
    which they hold: for every frame that ends after it.  One that comes while
    the profile is learned ends that.
    """
    spectrum = spectra.analyze(spectra.frame_signal(np.asarray(x, float), g), g)
    loaded = parameters.loaded(two_d)
    learning = Parameters(**{**loaded.__dict__, "learn_noise": 1})
    machine = Processor(g, learning if learn_samples else loaded, two_d)
    for mode, (profile, count) in (profiles or {}).items():
        machine.learner.load(mode, profile, count)
    waiting = sorted(controls or [], key=lambda c: c[0])
    out = np.empty_like(spectrum)
    for n, s in enumerate(spectrum):
        end = (n + 1) * g.hop
        if learn_samples and machine.p.learn_noise and end > learn_samples:
            machine.load(loaded)
        while waiting and waiting[0][0] < end:
            machine.load(waiting.pop(0)[1].loaded(two_d))
        out[n] = machine.step(s)
    return spectra.overlap_add(spectra.synthesize(out, g), g, len(x))


def denoise(
    signal: DataFrame, rate: int, frame_ms: float, parameters: Parameters, learn_samples: int = 0, two_d: bool = False, profiles: DataFrame | None = None, controls: DataFrame | None = None
) -> DataFrame:
    """``(stream_id, pos, amp)`` to ``(stream_id, pos, value)``: the whole chain, stream by stream.

    Positions of a stream are ranked; gaps are not filled.  The output is
    delayed by the reported latency; a stream shorter than a hop gives zeros.
    ``profiles`` are rows of the profile store, ``profile_id`` naming the stream;
    those that are not available are left out.  ``controls`` has ``stream_id``,
    ``pos`` and any fields of :class:`Parameters`: from there on these hold, and
    fields that are absent or null are those of ``parameters``.
    """
    g = geometry(rate, frame_ms, two_d)
    key = signal.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {key}, pos long, value double"
    samples = signal.select("stream_id", "pos", "amp").groupBy("stream_id")

    def one(pdf: pd.DataFrame, held: dict | None = None, changes: list | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        value = process_signal(pdf["amp"].to_numpy(), g, parameters, learn_samples, two_d, held, changes)
        return pd.DataFrame({"stream_id": pdf["stream_id"].to_numpy(), "pos": pdf["pos"].to_numpy(), "value": value})

    if profiles is None and controls is None:
        return samples.applyInPandas(lambda pdf: one(pdf), schema)
    side = f"stream_id {key}, mode int, block_count int, profile array<double>, pos long, control string"
    rows = signal.sparkSession.createDataFrame([], side)
    nothing = lambda kind: F.lit(None).cast(kind)
    if profiles is not None:
        mine = profiles.where("available").select(F.col("profile_id").cast(key).alias("stream_id"), "mode", "block_count", F.col("profile").cast("array<double>").alias("profile"))
        rows = rows.unionByName(mine.withColumns({"pos": nothing("long"), "control": nothing("string")}))
    if controls is not None:
        fields = F.to_json(F.struct(*(c for c in controls.columns if c not in ("stream_id", "pos"))))
        changes = controls.select(F.col("stream_id").cast(key).alias("stream_id"), F.col("pos").cast("long").alias("pos"), fields.alias("control"))
        rows = rows.unionByName(changes.withColumns({"mode": nothing("int"), "block_count": nothing("int"), "profile": nothing("array<double>")}))

    def both(pdf: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"stream_id": [], "pos": [], "value": []})
        known = side[side["mode"].notna()]
        held = {int(m): (np.array(p, float), int(n)) for m, p, n in zip(known["mode"], known["profile"], known["block_count"], strict=True)}
        told = side[side["control"].notna()]
        changes = [(int(p), replace(parameters, **json.loads(c))) for p, c in zip(told["pos"], told["control"], strict=True)]
        return one(pdf, held, changes)

    return samples.cogroup(rows.groupBy("stream_id")).applyInPandas(both, schema)


def band_ranges(g: Geometry, scale: str = "bark") -> list[tuple[int, int]]:
    return bands(g.rate, g.fft, scale)
