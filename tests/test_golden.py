"""Exact small cases of the array kernels."""

import numpy as np
import pytest

from quietframe.functions import geometry as G
from quietframe.functions import spectra as S
from quietframe.functions.bands import bands, spreading
from quietframe.operators.estimators import Brandt, Learner, Martin, SppMmse, trimmed_correction
from quietframe.operators.nlm import Nlm, fast_exp, reconstruct, snr
from quietframe.operators.psycho import Masking, Transients, Veto
from quietframe.plans.denoise import Processor, process_signal


def test_sizes():
    assert [G.fft_size(512, G.Padding.NONE), G.fft_size(500, G.Padding.POWER_OF_TWO), G.fft_size(512, G.Padding.FIXED, 512)] == [512, 512, 1024]
    assert [G.next_even(n) for n in (1, 2, 3, 7, 9)] == [2, 2, 4, 8, 10]
    assert [G.next_power_of_two(n) for n in (0, 1, 3, 5, 9, 17)] == [1, 1, 4, 8, 16, 32]
    g = G.geometry(44100, 20)
    assert (g.frame, g.hop, g.fft, g.latency, g.latency_2d) == (882, 220, 1682, 882, 2562)
    with pytest.raises(ValueError):
        G.geometry(3000, 20)
    assert G.geometry(3000, 20, two_d=True).frame == 60


def test_scalars():
    assert G.db_to_gain(-6) == pytest.approx(0.501, abs=0.01)
    assert G.log_like(1) == pytest.approx(0.9502, abs=1e-3)
    assert S.sanitize(np.array([1e-40, -1, 0.5, np.inf, np.nan])).tolist() == [0, -1, 0.5, 0, 0]


def test_windows():
    hann, hamming, blackman, vorbis = (S.window(w, 64) for w in G.Window)
    assert hann[0] == 0 and hann[32] > 0.9 and 0.07 < hamming[0] < 0.09 and blackman[0] == 0 and vorbis[0] == 0


def test_smoothing():
    assert np.allclose(S.smooth3(np.array([1.0, 2, 4, 8]), 0.5), [1.25, 2.1666667, 4.3333333, 7])
    assert S.fill_gaps(np.array([1, 0.05, 3]), 0.1).tolist() == [1, 2, 3]
    assert S.fill_gaps(np.array([1, 0.05, 0.05]), 0.1).tolist() == [1, 0.05, 0.05]
    assert S.smooth_bands(np.array([4.0, 8, 0])).tolist() == [4, 5, 2]


def test_morph():
    mean, median, top, low = (np.array(x, float) for x in ([2, 4], [1, 3], [4, 6], [1.5, 2.5]))
    assert S.morph(mean, median, top, low, 0.5).tolist() == [3, 5]
    assert S.morph(mean, median, top, low, -0.5).tolist() == [1.5, 3.5]
    assert S.morph(mean, median, top, low, -1)[0] == 1.5


def test_learner():
    a = Learner(4)
    for _ in range(6):
        a.learn(np.ones(4))
    assert a.available == {1: True, 2: True, 3: True, 4: True} and a.values[4].tolist() == [0] * 4 and a.values[2].tolist() == [0] * 4
    a.reset()
    assert not any(a.available.values()) and a.counts[1] == 0
    with pytest.raises(ValueError):
        a.load(5, np.ones(4), 1)


def test_estimators():
    spp = SppMmse(64)
    assert spp.step(np.full(64, 5e-11)).max() == 0
    assert np.allclose(spp.step(np.ones(64)), 1) and np.allclose(spp.step(np.full(64, 1e-11)), 1)
    m = Martin(64)
    assert np.allclose(m.step(np.ones(64)), 1) and np.allclose(m.step(np.zeros(64)), 1)
    b = Brandt(64, 44100, 128, 500)
    b.seed(np.ones(64))
    assert np.allclose(b.step(np.ones(64)), 1, atol=1e-2) and np.allclose(b.step(np.zeros(64)), b.last)
    assert trimmed_correction(1) == 1


def test_gains():
    x, one = np.full(17, 2.0), np.ones(17)
    assert np.allclose(S.wiener(x, one, one), 0.5)
    assert S.berouti(np.array([0.01, 1000]), np.ones(2), 0.5) == pytest.approx([2.5, 1])


def test_tones():
    p = np.full(1025, 0.01)
    for k, v in ((100, 0.1), (99, 0.08), (101, 0.08), (98, 0.04), (102, 0.04), (97, 0.02), (103, 0.02)):
        p[k] = v
    m = S.tonal_mask(p)
    assert (m[97:104] > 0).all() and m[96] == 0 and m[104] == 0
    assert not S.tonal_mask(np.full(1025, 0.01)).any()
    a = S.boost_tonal(np.ones(1025), m, 0.00398)
    assert a[100] > 8 and a[200] == 1


def test_stale_tonal_mask():
    """A profile of equal sum keeps the mask that was found before."""
    g = G.geometry(44100, 20)
    p = Processor(g, G.Parameters())
    n = np.full(g.bins, 0.01)
    n[100] = 0.1
    assert p.mask(n)[100] > 0
    moved = np.full(g.bins, 0.01)
    moved[200] = 0.1
    assert moved.sum() == n.sum() and p.mask(moved)[200] == 0
    moved[5] = 0.02
    assert p.mask(moved)[200] > 0 and p.mask(moved)[100] == 0


def test_whitening_and_floor():
    p = np.full(513, 0.1)
    p[100] = 10
    w = S.whitening(p, 1)
    assert 0.99 <= w[200] <= 1.01 and 0.05 <= 10 * w[100] <= 0.2
    zero, flat = np.zeros(513), np.ones(513)
    assert np.allclose(S.noise_floor(zero, flat, zero, 0.1, 0.1, 0), 0.1) and np.allclose(S.noise_floor(zero, flat, zero, 0.1, 0.1, 1), 0.1)
    assert np.allclose(S.noise_floor(zero, flat, zero, 1, 1, 0), 1) and np.allclose(S.noise_floor(zero, flat, flat, 0.1, 1, 1), 0.1)


def test_bands():
    expected = [2, 4, 6, 8, 10, 12, 15, 18, 21, 24, 28, 33, 38, 44, 52, 60, 71, 84, 101, 122, 147, 181, 229, 296, 842]
    assert [hi for _, hi in bands(44100, 1682)] == expected
    assert all(lo < hi <= 513 for lo, hi in bands(44100, 1024))
    assert spreading(np.array(0.0), np.array(40.0)) == pytest.approx(10 ** ((15.81 + 5 * 0.474 - 20 * np.sqrt(1 + 0.474**2)) / 10))


def test_transients():
    t = Transients()
    e = np.ones(25)
    t.step(e)
    e[10] = 100
    w, found = t.step(e)
    assert found and w[10] > 0.9 and w[0] < 0.1
    for _ in range(8):
        w, _ = t.step(e)
    assert w[10] < 0.5


def test_masking_and_veto():
    g = 1024
    assert (Masking(44100, g).step(np.random.default_rng(0).random(513)) >= 0).all()
    v = Veto(44100, g, "opus")
    assert v.step(np.full(513, 1000.0), np.ones(513), np.full(513, 4.0), 1)[100] < 4
    v = Veto(44100, g, "opus")
    for _ in range(10):
        a = v.step(np.full(513, 0.01), np.full(513, 100.0), np.full(513, 4.0), 1)
    assert a[100] > 3
    assert (v.step(np.ones(513), np.ones(513), np.full(513, 4.0), -1) == 4).all()


def test_nlm():
    x = -np.array([0, 1, 5.0])
    assert np.allclose(fast_exp(x), np.exp(x), atol=0.05) and fast_exp(np.array([-21.0]))[0] == 0
    f = Nlm(32, 1, patch=4, block=2, freq=2, past=2, future=2)
    for _ in range(4):
        f.push(np.full(32, 5.0))
        assert f.process() is None
    f.push(np.full(32, 5.0))
    assert np.allclose(f.process(), 5, atol=0.01)
    assert snr(np.array([10.0, 20, 0, 40]), np.array([2.0, 10, 0, 0]))[:3].tolist() == [5, 2, 0]
    assert np.allclose(reconstruct(np.array([5.0, 2, 1, 10]), np.array([2.0, 10, 0, 0])), [10, 20, 0, 0], atol=1e-4)


@pytest.mark.parametrize("two_d", [False, True])
def test_unity_gain_is_identity(two_d):
    g = G.geometry(4000, 8, two_d)
    x = np.random.default_rng(1).normal(size=800)
    p = G.Parameters(reduction_amount=0, tonal_reduction=0, masking_depth=0)
    y = process_signal(x, g, p, 0, two_d)
    delay = g.frame + (4 * g.hop if two_d else 0)
    assert np.allclose(y[delay + g.frame :], x[g.frame : len(x) - delay], atol=0.02)
    assert (y[: g.hop] == 0).all()


@pytest.mark.parametrize("params,bound", [({}, 0.96), ({"adaptive_noise": 1}, 0.98), ({"adaptive_noise": 1, "noise_estimation_method": 2}, 0.98)])
def test_reduction(params, bound):
    rng = np.random.default_rng(12345)
    t = np.arange(44100) / 44100
    x = 0.3 * np.sin(2 * np.pi * 1000 * t) + 0.1 * np.sin(2 * np.pi * 2000 * t) + 0.1 * rng.uniform(-1, 1, len(t))
    g = G.geometry(44100, 20)
    noise = rng.uniform(-0.1, 0.1, 8820)
    y = process_signal(np.concatenate((noise, x)), g, G.Parameters(reduction_amount=20, **params), 0 if params else 8820)
    ratio = (y[8820 + 882 :] ** 2).mean() / (x**2).mean()
    assert 0.01 < ratio < bound
    again = process_signal(np.concatenate((noise, x)), g, G.Parameters(reduction_amount=20, **params), 0 if params else 8820)
    assert (y == again).all()


def test_profiles_and_controls(spark):
    """Stored profiles and parameter rows as inputs of a plan; a stream without either is as before."""
    import pandas as pd

    from quietframe.plans.denoise import denoise
    from quietframe.sources import profiles as store

    rng = np.random.default_rng(8)
    signals = {s: rng.normal(size=300) for s in ("a", "b", "c")}
    signal = spark.createDataFrame(pd.concat(pd.DataFrame({"stream_id": s, "pos": np.arange(300), "amp": x}) for s, x in signals.items()))
    g, p = G.geometry(4000, 8), G.Parameters(reduction_amount=12, masking_depth=0)
    profile = (rng.random(g.bins) + 0.5).astype(np.float32).tolist()
    kept = store.put(spark.createDataFrame([], store.SCHEMA), "a", 1, profile, 9, store.profile_size(g.bins, g.fft, False))
    kept = store.put(kept, "b", 1, profile, 9, g.bins)
    kept = kept.unionByName(spark.createDataFrame([("c", 1, 9, False, profile)], store.SCHEMA))
    controls = spark.createDataFrame([("b", 120, 30.0, None), ("b", 200, 0.0, True), ("c", 0, 6.0, None)], "stream_id string, pos long, reduction_amount double, residual_listen boolean")
    out = denoise(signal, 4000, 8, p, 0, profiles=kept, controls=controls).toPandas()
    got = {s: out[out.stream_id == s].sort_values("pos")["value"].to_numpy() for s in signals}
    held = {1: (np.array(profile), 9)}
    assert np.allclose(got["a"], process_signal(signals["a"], g, p, 0, profiles=held))
    loud = G.Parameters(reduction_amount=30, masking_depth=0)
    rest = G.Parameters(reduction_amount=0, masking_depth=0, residual_listen=True)
    assert np.allclose(got["b"], process_signal(signals["b"], g, p, 0, profiles=held, controls=[(200, rest), (120, loud)]))
    assert np.allclose(got["b"][:120], process_signal(signals["b"], g, p, 0, profiles=held)[:120])
    assert np.allclose(got["c"], process_signal(signals["c"], g, G.Parameters(reduction_amount=6, masking_depth=0), 0))
    plain = denoise(signal, 4000, 8, p, 40).toPandas()
    assert np.allclose(plain[plain.stream_id == "c"].sort_values("pos")["value"], process_signal(signals["c"], g, p, 40))
