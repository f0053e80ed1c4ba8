"""NumPy kernels on batches of windows; each call handles one Arrow batch or one piece of a series."""

from __future__ import annotations

import numpy as np

# The published Daubechies-4 analysis low-pass filter.
DB4_LOW = np.array([
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
])
DB4_HIGH = DB4_LOW[::-1] * np.where(np.arange(8) % 2 == 0, -1.0, 1.0)

TIME_NAMES = ("mean", "std", "rms", "mad", "skewness", "kurtosis", "crest_factor")
FREQ_NAMES = (
    "spectral_energy", "peak_frequency", "spectral_centroid",
    "band_power_low", "band_power_mid", "band_power_high",
)
SERVING_NAMES = (
    "time_rms", "time_mean", "time_std", "time_mad", "time_skewness", "time_crest_factor",
    "freq_spectral_energy", "freq_band_power_low", "wpd_wpd_energy_lvl3_node0", "wpd_wpd_energy_lvl3_node1",
)
WPD_NAMES = tuple(f"wpd_energy_lvl3_node{n}" for n in range(8))


def time_features(x: np.ndarray) -> np.ndarray:
    """Shape statistics of each row of ``x`` with bias-corrected skewness and kurtosis."""
    n = x.shape[1]
    mean = x.mean(axis=1)
    d = x - mean[:, None]
    m2, m3, m4 = ((d ** p).mean(axis=1) for p in (2, 3, 4))
    rms = np.sqrt((x * x).mean(axis=1))
    flat = m2 < 1e-14
    safe = np.where(flat, 1.0, m2)
    g1 = np.where(flat, 0.0, m3 / safe ** 1.5)
    g2 = np.where(flat, 0.0, m4 / safe ** 2 - 3.0)
    skew = g1 * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 else np.full_like(g1, np.nan)
    kurt = np.full_like(g2, np.nan)
    if n > 3:
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        kurt[flat] = 0.0
    return np.column_stack([
        mean, np.sqrt(m2), rms, np.abs(d).mean(axis=1), skew, kurt,
        np.abs(x).max(axis=1) / (rms + 1e-12),
    ])


def _trapezoid(y: np.ndarray) -> np.ndarray:
    if y.shape[1] < 2:
        return np.zeros(len(y))
    return y.sum(axis=1) - (y[:, 0] + y[:, -1]) / 2


def freq_features(x: np.ndarray, fs: float, fft_size: int | None = 1024) -> np.ndarray:
    n = min(x.shape[1], fft_size) if fft_size else x.shape[1]
    magnitude = np.abs(np.fft.rfft(x[:, :n] * np.hanning(n), axis=1))
    freqs = np.fft.rfftfreq(n, d=1.0 / fs)
    total = magnitude.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        centroid = (magnitude * freqs).sum(axis=1) / total
    low, high = freqs < fs / 6, freqs >= fs / 3
    return np.column_stack([
        (magnitude ** 2).sum(axis=1), freqs[magnitude.argmax(axis=1)], centroid,
        _trapezoid(magnitude[:, low]), _trapezoid(magnitude[:, ~low & ~high]), _trapezoid(magnitude[:, high]),
    ])


def dwt_step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One db4 analysis level with half-sample reflection at both ends: (approximation, detail)."""
    n = x.shape[1]
    at = np.arange(-7, n + 7) % (2 * n)
    extended = x[:, np.where(at < n, at, 2 * n - 1 - at)]
    k = np.arange((n + 7) // 2)
    taps = np.stack([extended[:, 2 * k + 8 - j] for j in range(8)], axis=-1)
    return taps @ DB4_LOW, taps @ DB4_HIGH


def packet_energies(x: np.ndarray, level: int = 3) -> np.ndarray:
    """Energy of each wavelet-packet node at ``level``, in natural order."""
    nodes = [x]
    for _ in range(level):
        nodes = [half for node in nodes for half in dwt_step(node)]
    return np.column_stack([(node ** 2).sum(axis=1) for node in nodes])


def dwt_energies(x: np.ndarray, level: int = 3) -> np.ndarray:
    """Energies of the deepest approximation and of the deepest detail of a plain decomposition."""
    approximation, detail = x, None
    for _ in range(level):
        approximation, detail = dwt_step(approximation)
    return np.column_stack([(approximation ** 2).sum(axis=1), (detail ** 2).sum(axis=1)])


def periodogram_sums(x: np.ndarray, fs: float, low_hz: float = 2.5) -> np.ndarray:
    """Sum of the one-sided power density, over all bins and over bins below ``low_hz``."""
    n = x.shape[1]
    psd = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2 / (fs * n)
    psd[:, 1:(-1 if n % 2 == 0 else None)] *= 2
    low = np.fft.rfftfreq(n, d=1.0 / fs) < low_hz
    return np.column_stack([psd.sum(axis=1), psd[:, low].sum(axis=1)])


def serving_features(x: np.ndarray, fs: float) -> np.ndarray:
    """What the streaming model uses of one channel, in the order of ``SERVING_NAMES``."""
    mean, middle = x.mean(axis=1), np.median(x, axis=1)
    d = x - mean[:, None]
    m2, m3 = (d ** 2).mean(axis=1), (d ** 3).mean(axis=1)
    rms = np.sqrt((x * x).mean(axis=1))
    flat = m2 < 1e-14
    skew = np.where(flat, 0.0, m3 / np.where(flat, 1.0, m2) ** 1.5)
    crest = np.where(rms > 0, np.abs(x).max(axis=1) / np.where(rms > 0, rms, 1.0), 0.0)
    away = np.median(np.abs(x - middle[:, None]), axis=1)
    return np.hstack([
        np.column_stack([rms, mean, np.sqrt(m2), away, skew, crest]), periodogram_sums(x, fs), dwt_energies(x)])


def spectrogram_db(x: np.ndarray, n_fft: int, overlap: float) -> np.ndarray:
    """Decibel spectrogram (batch, frequency, time) of (batch, channel, sample), averaged over channels."""
    hop = max(1, int(n_fft * (1 - overlap)))
    n = max(x.shape[2], n_fft)
    padded = n + (-(n - n_fft) % hop)
    x = np.pad(x, ((0, 0), (0, 0), (0, padded - x.shape[2])))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft, axis=2)[:, :, ::hop]
    magnitude = np.abs(np.fft.rfft(frames * (window / window.sum()), axis=-1)).mean(axis=1)
    return 20 * np.log10(np.maximum(magnitude, 1e-12)).swapaxes(1, 2)


def _tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Solve a diagonally dominant tridiagonal system by parallel cyclic reduction."""
    n, stride = len(b), 1
    while stride < n:
        up = np.zeros(n)
        down = np.zeros(n)
        up[stride:] = -a[stride:] / b[:-stride]
        down[:-stride] = -c[:-stride] / b[stride:]
        na, nb, nc, nd = np.zeros(n), b.copy(), np.zeros(n), d.copy()
        nb[stride:] += up[stride:] * c[:-stride]
        nb[:-stride] += down[:-stride] * a[stride:]
        nd[stride:] += up[stride:] * d[:-stride]
        nd[:-stride] += down[:-stride] * d[stride:]
        na[stride:] = up[stride:] * a[:-stride]
        nc[:-stride] = down[:-stride] * c[stride:]
        a, b, c, d = na, nb, nc, nd
        stride *= 2
    return d / b


def cubic_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (t, y) evaluated at ``at``; the end pieces extrapolate."""
    h = np.diff(t)
    slope = np.diff(y) / h
    a, b, c = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    rhs = 6 * np.diff(slope)
    b[0] += h[0] * (h[0] + h[1]) / h[1]
    c[0] -= h[0] ** 2 / h[1]
    b[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    a[-1] -= h[-1] ** 2 / h[-2]
    a[0] = c[-1] = 0.0
    inner = _tridiagonal(a, b, c, rhs)
    first = ((h[0] + h[1]) * inner[0] - h[0] * inner[1]) / h[1]
    last = ((h[-2] + h[-1]) * inner[-1] - h[-1] * inner[-2]) / h[-2]
    m = np.concatenate([[first], inner, [last]])
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    left, right, width = at - t[k], t[k + 1] - at, h[k]
    return (
        (m[k] * right ** 3 + m[k + 1] * left ** 3) / (6 * width)
        + (y[k] / width - m[k] * width / 6) * right
        + (y[k + 1] / width - m[k + 1] * width / 6) * left
    )


def butter_bandpass(fs: float, cutoff_hz, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (b, a) and poles of a Butterworth band-pass filter."""
    nyquist = fs / 2
    low, high = max(cutoff_hz[0] / nyquist, 1e-4), min(cutoff_hz[1] / nyquist, 0.999)
    if low >= high:
        raise ValueError("band-pass cutoffs must satisfy low < high < Nyquist")
    w1, w2 = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    angles = np.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    half = np.exp(1j * angles) * (w2 - w1) / 2
    root = np.sqrt(half ** 2 - w1 * w2)
    analog = np.concatenate([half + root, half - root])
    poles = (4 + analog) / (4 - analog)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    gain = ((w2 - w1) ** order * 4.0 ** order / np.prod(4 - analog)).real
    return gain * np.poly(zeros).real, np.poly(poles).real, poles


def impulse_response(b: np.ndarray, a: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(length)
    order = len(a) - 1
    recent = np.zeros(order)
    for n in range(length):
        value = (b[n] if n < len(b) else 0.0) - a[1:] @ recent
        recent = np.concatenate([[value], recent[:-1]])
        out[n] = value
    return out


def _causal(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Filter each column of ``x`` as if its first value had held forever before."""
    held = np.concatenate([np.repeat(x[:1], len(h), axis=0), x])
    size = 1 << int(np.ceil(np.log2(len(held) + len(h))))
    spectrum = np.fft.rfft(held, size, axis=0) * np.fft.rfft(h, size)[:, None]
    return np.fft.irfft(spectrum, size, axis=0)[len(h):len(held)]


def zero_phase(x: np.ndarray, h: np.ndarray, pad: int) -> np.ndarray:
    """Forward-backward filtering of the columns of ``x`` with odd reflection of ``pad`` samples."""
    if len(x) <= pad:
        raise ValueError(f"a recording needs more than {pad} samples to be filtered, got {len(x)}")
    extended = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    both = _causal(_causal(extended, h)[::-1], h)[::-1]
    return both[pad:-pad]
