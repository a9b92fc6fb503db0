"""Queries without SQL against the method restated in plain Python, on a small fixture."""

import datetime

import brute
import numpy as np
import pandas as pd
import pytest

from quietframe.functions.bands import bands
from quietframe.functions.geometry import Parameters, geometry
from quietframe.operators.estimators import Brandt, Martin, SppMmse, brandt_history
from quietframe.operators.nlm import Nlm
from quietframe.plans import registry
from quietframe.plans.denoise import process_signal

BARK = bands(registry.RATE, registry.FFT, "bark")


@pytest.fixture(scope="module")
def fixture(tmp_path_factory):
    """Two streams of 64-bin frames (one with a silent frame and an onset), and signals of three users."""
    where = tmp_path_factory.mktemp("small")
    rng = np.random.default_rng(44)
    frames = rng.normal(size=(54, 64)) * (0.05 + rng.random((54, 1)))
    frames[9] = 0
    frames[21] *= 40
    pd.DataFrame({"vec_id": np.arange(54), "embedding": list(frames), "label": np.arange(54) % 2}).to_parquet(where / "embeddings.parquet")
    size = {1: 120, 2: 44, 3: 3}
    rows = [(u, i, rng.normal() + 2 * np.sin(i / 3) * (i > 40)) for u, n in size.items() for i in range(n)]
    at = datetime.datetime(2024, 1, 1)
    pd.DataFrame({"event_id": range(len(rows)), "user_id": [r[0] for r in rows], "ts": [at + datetime.timedelta(seconds=r[1]) for r in rows], "event_type": "a", "value": [r[2] for r in rows]}).to_parquet(where / "events.parquet", coerce_timestamps="us")
    return str(where)


def streams(fixture):
    pdf = pd.read_parquet(f"{fixture}/embeddings.parquet")
    return {label: [[float(v) ** 2 for v in e] for e in g.sort_values("vec_id")["embedding"]] for label, g in pdf.groupby("label")}


def check(spark, fixture, name, column, expected):
    """``expected`` by stream: a list of frames of values."""
    out = registry.queries()[name](spark, fixture).toPandas()
    assert len(out) == sum(len(f) for frames in expected.values() for f in frames)
    for label, frames in expected.items():
        got = out[out.stream_id == label].sort_values(["frame_no", "bin"])[column].to_numpy().reshape(len(frames), -1)
        assert np.allclose(got, np.array(frames), rtol=1e-6, atol=2e-6), (name, label)


def test_brandt(spark, fixture):
    size = brandt_history(registry.RATE, registry.FFT, 60)
    assert size == 42
    check(spark, fixture, "q_brandt", "noise", {k: list(brute.brandt(f, size)) for k, f in streams(fixture).items()})


def test_adaptive(spark, fixture):
    out = registry.queries()["q_adaptive"](spark, fixture).toPandas()
    size = brandt_history(registry.RATE, registry.FFT)
    for method, raw in enumerate((brute.spp, lambda f: brute.brandt(f, size), brute.martin)):
        for label, frames in streams(fixture).items():
            mine = out[(out.method == method) & (out.stream_id == label)].sort_values(["frame_no", "bin"])["noise"].to_numpy().reshape(len(frames), -1)
            assert np.allclose(mine, [brute.shown(e) for e in raw(frames)], rtol=1e-6, atol=2e-6)


@pytest.mark.parametrize("kind", ["spp", "martin", "brandt"])
def test_estimators_over_long_streams(kind):
    """Long enough for every window to turn over, with silent stretches at the start and later."""
    rng = np.random.default_rng(5)
    frames = rng.exponential(size=(130, 5)) * np.array([1, 2, 0.5, 1e-3, 10])
    frames[:2] = frames[60:64] = 0
    rows = frames.tolist()
    made, expected = {"spp": (SppMmse(5), brute.spp(rows)), "martin": (Martin(5), brute.martin(rows)), "brandt": (Brandt(5, 44100, 126, 60), brute.brandt(rows, 42))}[kind]
    assert np.allclose([made.step(f) for f in frames], list(expected), rtol=1e-9)


def test_masking(spark, fixture):
    expected = {}
    for label, frames in streams(fixture).items():
        mask = brute.Mask(registry.RATE, registry.FFT, BARK)
        expected[label] = [mask(f) for f in frames]
    check(spark, fixture, "q_masking", "threshold", expected)


def test_veto(spark, fixture):
    expected = {}
    for label, frames in streams(fixture).items():
        veto, noise = brute.Vetoed(registry.RATE, registry.FFT, BARK), np.mean(frames[:10], axis=0).tolist()
        expected[label] = [veto(f, noise, [4.0] * 64, 1.0) for f in frames]
    check(spark, fixture, "q_veto", "alpha", expected)


def test_transient_smoothing(spark, fixture):
    check(spark, fixture, "q_transient_smoothing", "smooth", {k: list(brute.aware(f, BARK, 0.7)) for k, f in streams(fixture).items()})


def test_similarity_filter(spark, fixture):
    expected = {k: [s if s is not None else f for f, s in zip(frames, brute.similar(frames, 0.05), strict=True)] for k, frames in streams(fixture).items()}
    assert any(s != f for k, frames in streams(fixture).items() for s, f in zip(expected[k], frames, strict=True))
    check(spark, fixture, "q_nlm", "smoothed", expected)


@pytest.mark.parametrize("bins", [5, 13, 30])
def test_similarity_filter_at_the_edges(bins):
    """Bins that no block fills, alike frames, silent blocks."""
    rng = np.random.default_rng(bins)
    frames = rng.random((26, bins)) * 0.2 + np.arange(bins) * 0.01
    frames[:, :4] *= 1e-9
    f, got = Nlm(bins, 0.4), []
    for frame in frames:
        f.push(frame)
        got.append(f.process())
    for a, b in zip(got, brute.similar(frames.tolist(), 0.4), strict=True):
        assert (a is None) == (b is None) and (a is None or np.allclose(a, b, rtol=1e-5))


LINEAR = {"reduction": 0.1, "tonal": 10 ** (-6 / 20), "whitening": 0.5, "strength": 0.5, "depth": 0.5}


@pytest.mark.parametrize("two_d", [False, True])
def test_chain(spark, fixture, two_d):
    g = geometry(4000, 4.0, two_d)
    p = LINEAR | ({"h": 1.0} if two_d else {"smoothing": 1 - np.exp(-0.75)})
    out = registry.queries()["q_denoise_2d" if two_d else "q_denoise_1d"](spark, fixture).toPandas()
    events = pd.read_parquet(f"{fixture}/events.parquet")
    for user, rows in events.groupby("user_id"):
        x = rows.sort_values("ts")["value"].tolist()
        if two_d and user == 1:
            x = x[:120]
        expected = brute.denoised(x, g.rate, g.frame, g.hop, g.fft, bands(g.rate, g.fft, "bark"), p, 24, two_d)
        got = out[out.stream_id == user].sort_values("pos")["value"].to_numpy()
        assert np.allclose(got, expected, atol=3e-6), (user, np.abs(got - expected).max())
    assert np.abs(out["value"]).max() > 0.1


def test_short_stream_of_the_chain():
    g = geometry(4000, 4.0)
    assert process_signal(np.ones(3), g, Parameters(), 0).tolist() == [0, 0, 0]
