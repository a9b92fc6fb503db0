"""Dispatchers against scalar restatements."""

import math

import numpy as np
import pytest

from quietframe.functions import fixed as K
from quietframe.functions import spectra as S
from quietframe.functions.bands import bands
from quietframe.operators import dispatch as D

RATE, FFT = 44100, 128
RNG = np.random.default_rng(9)
X = RNG.random(65) * 10 ** RNG.uniform(-3, 3, 65)
N = RNG.random(65)


def test_features():
    z = RNG.normal(size=65) + 1j * RNG.normal(size=65)
    z[0], z[-1] = 2, -3
    assert np.allclose(D.feature(z, D.Feature.POWER), np.abs(z) ** 2)
    assert np.allclose(D.feature(z, D.Feature.MAGNITUDE), np.abs(z))
    phase = D.feature(z, D.Feature.PHASE)
    assert np.allclose(phase, [math.atan2(v.imag, v.real) for v in z]) and phase[0] == 0 and phase[-1] == pytest.approx(math.pi)
    with pytest.raises(ValueError):
        D.feature(z, 7)


def scalar_alpha(db, strength):
    return strength if db <= 0 else 1.0 if db >= 20 else (1 - db / 20) * strength + db / 20


@pytest.mark.parametrize("strength", [1.5, 4.0])
def test_suppression(strength):
    alpha, beta = D.Suppression(D.Suppress.GLOBAL_SNR, RATE, FFT).step(X, N, strength, 0.02)
    assert np.allclose(alpha, scalar_alpha(10 * math.log10(X.sum() / (N.sum() + 1e-12)), strength)) and (beta == 0.02).all()
    alpha, beta = D.Suppression(D.Suppress.BAND_SNR, RATE, FFT).step(X, N, strength, 0.02)
    for lo, hi in bands(RATE, FFT, "bark"):
        if hi > lo:
            assert np.allclose(alpha[lo:hi], scalar_alpha(10 * math.log10(X[lo:hi].sum() / (N[lo:hi].sum() + 1e-12)), strength))
    alpha, beta = D.Suppression(D.Suppress.BEROUTI, RATE, FFT).step(X, N, 0.5)
    assert np.array_equal(alpha, S.berouti(X, N, 0.5)) and not beta.any()
    alpha, beta = D.Suppression(D.Suppress.NONE, RATE, FFT).step(X, N, strength)
    assert (alpha == 1).all() and not beta.any()


def test_masking_suppression():
    for db, a, b in ((-3, 1.3, 0), (0, 1.3, 0), (10, 2.5, 0.05), (20, 4, 0.1), (30, 4, 0.1)):
        alpha, beta = D.masking_alpha(np.array([float(db)]), 4.0, 0.1)
        assert alpha[0] == pytest.approx(a) and beta[0] == pytest.approx(b)
    engine = D.Suppression(D.Suppress.MASKING, RATE, FFT)
    first, _ = engine.step(X, N, 4.0)
    second, _ = engine.step(X, N, 4.0)  # what was before masks too
    assert (second <= np.maximum(first, 1.3) + 1e-12).all() and (first >= 1).all()


def test_gains_and_mirror():
    alpha, beta = np.full(65, 2.0), np.full(65, 0.01)
    x = X.copy()
    x[3] = 0
    gate, wiener, subtraction = (D.gains(k, x, N, alpha, beta) for k in D.Gain)
    for k in range(65):
        m = 2 * N[k]
        assert gate[k] == float(x[k] >= m)
        assert wiener[k] == pytest.approx(max(0, (x[k] - m) / x[k]) if x[k] > 0 else 0)
        if x[k] <= K.FLOAT_MIN:
            assert subtraction[k] == 1
        else:
            r = (N[k] / x[k]) ** 2
            assert subtraction[k] == pytest.approx(math.sqrt(max(1 - 2 * r, 0)) if r < 1 / 2.01 else math.sqrt(0.01 * r))
    whole = D.mirrored(wiener, FFT)
    assert len(whole) == FFT and np.array_equal(whole[:65], wiener) and all(whole[FFT - k] == wiener[k] for k in range(1, 64))


def test_smoothers():
    none, fixed, aware = (D.Smoother(k, RATE, FFT) for k in D.Smoothing)
    assert np.array_equal(none.step(X, 0.9), X)
    assert np.allclose(fixed.step(X, 0.7), 0.3 * X)
    assert np.allclose(fixed.step(X / 10, 0.7), np.where(X / 10 > 0.3 * X, 0.7 * 0.3 * X + 0.3 * X / 10, X / 10))
    aware.step(np.ones(65), 0.7)
    loud = np.ones(65)
    loud[40:] = 1000
    out = aware.step(loud, 0.7)
    assert out[-1] == pytest.approx(1000) and out[0] == pytest.approx(0.7 * 0.3 + 0.3)
