"""Noise reduction of unbounded streams with bounded state.

Samples come in any micro-batches; each stream keeps its processor (a frame of
input, a frame of output, noise estimates, and in 2D the delay and the ring)
and gives as many samples as it got, delayed by a frame.  Samples are put in
order of position within a micro-batch; positions that were already passed are
late and dropped, a gap is closed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import spectra
from ..functions.geometry import Geometry, Parameters, geometry
from ..plans.denoise import Processor


class LiveStream:
    """Push samples, get as many back: the block interface of one stream."""

    def __init__(self, g: Geometry, parameters: Parameters, learn_samples: int = 0, two_d: bool = False):
        self.g, self.two_d = g, two_d
        self.parameters = parameters.loaded(two_d)
        learning = Parameters(**{**self.parameters.__dict__, "learn_noise": 1})
        self.machine = Processor(g, learning if learn_samples else self.parameters, two_d)
        self.learn_samples = learn_samples
        self.input = np.zeros(g.frame)
        self.pending = np.zeros(0)
        self.sum = np.zeros(g.frame)
        self.ready = np.zeros(g.hop)
        self.seen = 0
        self.next_pos = -1

    def load_parameters(self, parameters: Parameters) -> None:
        """New parameters from the next frame on."""
        self.parameters = parameters.loaded(self.two_d)
        self.machine.load(self.parameters)
        self.learn_samples = 0

    def process(self, x: np.ndarray) -> np.ndarray:
        if x is None or not len(x):
            raise ValueError("no samples")
        g = self.g
        self.pending = np.concatenate((self.pending, np.asarray(x, float)))
        while len(self.pending) >= g.hop:
            block, self.pending = self.pending[: g.hop], self.pending[g.hop :]
            self.input = np.concatenate((self.input[g.hop :], block))
            self.seen += g.hop
            if self.machine.p.learn_noise and self.learn_samples and self.seen > self.learn_samples:
                self.machine.load(self.parameters)
            frame = spectra.synthesize(self.machine.step(spectra.analyze(self.input, g)), g)
            self.sum = self.sum + frame
            self.ready = np.concatenate((self.ready, self.sum[: g.hop]))
            self.sum = np.concatenate((self.sum[g.hop :], np.zeros(g.hop)))
        out, self.ready = self.ready[: len(x)], self.ready[len(x) :]
        return out


def denoise_stream(samples: DataFrame, rate: int, frame_ms: float, parameters: Parameters, learn_samples: int = 0, two_d: bool = False, idle_ms: int | None = None) -> DataFrame:
    """Streaming ``(stream_id string, pos long, amp double)`` to ``(stream_id, pos, value)``.

    With ``idle_ms``, state is dropped after so much processing time without
    samples, and what comes for the stream later begins anew, with learning;
    without it state stays, and so do streams that have ended.  State is the
    pickled machine: a query has to be restarted with the version that wrote it.
    """
    g = geometry(rate, frame_ms, two_d)

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = pickle.loads(state.get[0]) if state.exists else LiveStream(g, parameters, learn_samples, two_d)
        pdf = pd.concat(list(parts)).sort_values("pos").drop_duplicates("pos")
        pdf = pdf[pdf["pos"] > live.next_pos - 1] if live.next_pos >= 0 else pdf
        if len(pdf):
            value = live.process(pdf["amp"].to_numpy())
            live.next_pos = int(pdf["pos"].iloc[-1]) + 1
            yield pd.DataFrame({"stream_id": key[0], "pos": pdf["pos"].to_numpy(), "value": value})
        state.update((pickle.dumps(live),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return samples.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, pos long, value double", "machine binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
