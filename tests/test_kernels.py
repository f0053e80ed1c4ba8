import numpy as np
import pandas as pd
import pytest

from tremorgrid.functions import kernels as k

RNG = np.random.default_rng(7)


def test_wavelet_filters_are_orthonormal():
    assert np.isclose(k.DB4_LOW.sum(), np.sqrt(2)) and np.isclose((k.DB4_LOW ** 2).sum(), 1)
    assert np.isclose(k.DB4_HIGH.sum(), 0) and np.isclose(k.DB4_LOW @ k.DB4_HIGH, 0)


@pytest.mark.parametrize("size,lengths", [(20, (13, 10, 8)), (64, (35, 21, 14)), (5, (6, 6, 6))])
def test_wavelet_lengths_and_constant(size, lengths):
    x = np.full((2, size), 3.0)
    for length in lengths:
        low, high = k.dwt_step(x)
        assert low.shape == (2, length) and np.allclose(high, 0)
        x = low
    energies = k.packet_energies(np.full((1, size), 3.0))
    assert energies.shape == (1, 8) and energies[0, 0] > 0 and np.allclose(energies[0, 1:], 0)


def test_plain_decomposition_agrees_with_packets():
    x = RNG.normal(size=(4, 20))
    assert np.allclose(k.dwt_energies(x), k.packet_energies(x)[:, :2])


def test_frequency_features_against_a_naive_transform():
    x, n, fs = RNG.normal(size=(3, 20)), 20, 10.0
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    basis = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    magnitude = np.abs((x * taper) @ basis.T)
    got = k.freq_features(x, fs)
    assert np.allclose(got[:, 0], (magnitude ** 2).sum(axis=1))
    assert np.allclose(got[:, 1], magnitude.argmax(axis=1) * fs / n)
    assert np.isnan(k.freq_features(np.zeros((1, 20)), fs)[0, 2])


def test_time_features_of_flat_and_short_windows():
    assert np.allclose(k.time_features(np.full((1, 9), 2.0))[0, [1, 3, 4, 5]], 0)
    assert np.isnan(k.time_features(np.array([[1.0, 2.0]]))[0, [4, 5]]).all()
    x = RNG.normal(size=(5, 20))
    series = [pd.Series(row) for row in x]
    assert np.allclose(k.time_features(x)[:, 4], [s.skew() for s in series])
    assert np.allclose(k.time_features(x)[:, 5], [s.kurt() for s in series])


@pytest.mark.parametrize("size,n_fft,overlap,frames", [(20, 16, 0.5, 2), (100, 64, 0.5, 3), (100, 64, 0.9, 7), (20, 1024, 0.5, 1)])
def test_spectrogram_shape(size, n_fft, overlap, frames):
    assert k.spectrogram_db(RNG.normal(size=(2, 6, size)), n_fft, overlap).shape == (2, n_fft // 2 + 1, frames)


def test_spectrogram_averages_channels_before_decibels():
    n = np.arange(16)
    tone = np.cos(2 * np.pi * 4 * n / 16)
    one = k.spectrogram_db(np.stack([tone, 0 * tone])[None], 16, 0.5)
    assert np.isclose(one[0, 4, 0], 20 * np.log10(0.25))
    assert np.allclose(k.spectrogram_db(np.zeros((1, 1, 16)), 16, 0.5), -240)


def test_periodogram_sum_is_the_variance_times_band():
    x = RNG.normal(size=(2, 20))
    assert np.allclose(k.periodogram_sums(x, 10.0)[:, 0] * 10.0 / 20, x.var(axis=1))


def test_spline_reproduces_cubics():
    t = np.sort(RNG.uniform(0, 10, 30))
    at = np.linspace(t[0], t[-1], 77)
    cubic = np.polynomial.Polynomial([1.0, -2.0, 0.5, 0.25])
    assert np.allclose(k.cubic_spline(t, cubic(t), at), cubic(at), atol=1e-8)
    assert np.allclose(k.cubic_spline(t[:4], cubic(t[:4]), at), cubic(at), atol=1e-5)


def test_spline_is_smooth_and_passes_through_its_points():
    t, y = np.arange(12.0), RNG.normal(size=12)
    assert np.allclose(k.cubic_spline(t, y, t), y)
    left, right = k.cubic_spline(t, y, np.array([5 - 1e-6, 5 + 1e-6]))
    assert abs((y[5] - left) - (right - y[5])) < 1e-9


def test_bandpass_gain():
    b, a, poles = k.butter_bandpass(10.0, (1.0, 4.0), 4)
    assert len(b) == len(a) == 9 and np.abs(poles).max() < 1

    def gain(hz):
        z = np.exp(-2j * np.pi * hz / 10 * np.arange(9))
        return abs((b @ z) / (a @ z))

    assert gain(0.0) < 1e-9 and gain(5.0) < 1e-9
    assert np.isclose(gain(1.0), np.sqrt(0.5), atol=1e-6) and np.isclose(gain(4.0), np.sqrt(0.5), atol=1e-6)
    assert np.isclose(gain(2.2), 1.0, atol=1e-3)
    with pytest.raises(ValueError):
        k.butter_bandpass(10.0, (4.0, 1.0), 4)


def test_zero_phase_keeps_the_band_and_removes_the_rest():
    b, a, _ = k.butter_bandpass(100.0, (5.0, 20.0), 4)
    h = k.impulse_response(b, a, 2000)
    t = np.arange(1000) / 100
    kept, removed = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 0.5 * t) + 4
    out = k.zero_phase((kept + removed)[:, None], h, 27)[:, 0]
    assert np.abs(out - kept)[200:-200].max() < 1e-3
    with pytest.raises(ValueError):
        k.zero_phase(np.zeros((27, 1)), h, 27)
