"""Signal kernels on numpy arrays: filters, spectra, smoothing, peaks. No loop runs over samples."""

from __future__ import annotations

import numpy as np

#: The frequency of a notch over its width.
NOTCH_Q = 30.0


def bandpass_taps(low: float, high: float, fs: float) -> np.ndarray:
    """A Hamming-windowed sinc band-pass with unit gain at its centre, 4 fs over the transition width long, 101 at least."""
    if high >= fs / 2:
        raise ValueError(f"{high} Hz is not below half of {fs} Hz")
    n = int(4 * fs / min(0.5 * low, 0.3 * (high - low), 50.0))
    n = max(n + 1 - n % 2, 101)
    t = np.arange(n) - (n - 1) / 2
    taps = (2 * high / fs * np.sinc(2 * high / fs * t) - 2 * low / fs * np.sinc(2 * low / fs * t)) * np.hamming(n)
    return taps / np.abs(np.sum(taps * np.exp(-2j * np.pi * (low + high) / 2 / fs * t)))


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The middle of the full convolution, as long as x, with zeros beyond the ends."""
    n = len(x) + len(taps) - 1
    size = 1 << (n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[:n]
    start = (len(taps) - 1) // 2
    return full[start : start + len(x)]


def _odd(x: np.ndarray, pad: int) -> np.ndarray:
    return np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])


def _zero_phase(x: np.ndarray, gain, fs: float) -> np.ndarray:
    """x filtered forth and back: its spectrum times the squared gain, after odd padding."""
    pad = min(len(x) - 1, int(2 * fs))
    if pad < 1:
        return x.astype(float)
    y = _odd(x.astype(float), pad)
    n = len(y)
    return np.fft.irfft(np.fft.rfft(y) * gain(np.fft.rfftfreq(n, 1 / fs)), n)[pad : pad + len(x)]


def butterworth(x: np.ndarray, low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """A zero-phase digital Butterworth band-pass by its squared gain in bilinear frequencies."""
    a, b = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)

    def gain(f: np.ndarray) -> np.ndarray:
        w = np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-9)) / fs)
        with np.errstate(divide="ignore", over="ignore"):
            return 1 / (1 + ((w * w - a * b) / (w * (b - a))) ** (2 * order))

    return _zero_phase(x, gain, fs)


def notch(x: np.ndarray, at: float, fs: float, q: float = NOTCH_Q) -> np.ndarray:
    """A zero-phase second-order notch of width at / q."""
    w0, beta = 2 * np.pi * at / fs, np.tan(np.pi * at / fs / q)

    def gain(f: np.ndarray) -> np.ndarray:
        z = np.exp(-2j * np.pi * f / fs)
        top = 1 - 2 * np.cos(w0) * z + z * z
        bottom = (1 + beta) - 2 * np.cos(w0) * z + (1 - beta) * z * z
        return np.abs(top / bottom) ** 2

    return _zero_phase(x, gain, fs)


def detrended(x: np.ndarray, linear: bool = True) -> np.ndarray:
    """Rows less their line, or mean."""
    x = np.asarray(x, float)
    x = x - x.mean(-1, keepdims=True)
    if not linear or x.shape[-1] < 2:
        return x
    t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    return x - (x @ t)[..., None] / (t @ t) * t


def resampled(x: np.ndarray, down: int) -> np.ndarray:
    """Every `down`-th sample after a Kaiser (beta 5) low-pass of 20 * down + 1 taps."""
    half = 10 * down
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / down) * np.kaiser(2 * half + 1, 5.0)
    return convolved(x, taps / taps.sum())[::down]


def density(epochs: np.ndarray, fs: float, periodic: bool = True, linear: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the one-sided power density of each row under a Hann window, after detrending.

    What lies above 0 and, for an even length, below half the rate is doubled.
    """
    x = detrended(epochs, linear)
    n = x.shape[-1]
    window = np.hanning(n + 1)[:-1] if periodic else np.hanning(n)
    p = np.abs(np.fft.rfft(x * window)) ** 2 / (fs * np.sum(window**2))
    p[..., 1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def gaussian_smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian to 4 sigma with the end values repeated; NaNs count as 0 and stay NaN."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    gaps = np.isnan(x)
    y = np.convolve(np.pad(np.where(gaps, 0.0, x), r, mode="edge"), k / k.sum(), "valid")
    return np.where(gaps, np.nan, y)


def gaussian_spread(rows: np.ndarray, sigma: float) -> np.ndarray:
    """The transpose of gaussian_smoothed: rows @ gaussian_smoothed(x) is gaussian_spread(rows) @ x."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    n = rows.shape[1]
    wide = np.stack([convolved(np.pad(x, r), k / k.sum()) for x in rows])
    out = wide[:, r : r + n].copy()
    out[:, 0] += wide[:, :r].sum(1)
    out[:, -1] += wide[:, r + n :].sum(1)
    return out


def savitzky_golay(x: np.ndarray, window: int = 11, order: int = 3) -> np.ndarray:
    """Local polynomials; at the ends those of the first and last window."""
    window = min(window, len(x) - (1 - len(x) % 2))
    if window <= order:
        return np.asarray(x, float)
    half = window // 2
    t = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    fit = t @ np.linalg.pinv(t)
    out = np.convolve(x, fit[half][::-1], "same")
    out[:half], out[-half:] = (fit @ x[:window])[:half], (fit @ x[-window:])[-half:]
    return out


def smoothed_in_place(x: np.ndarray, width: int = 15) -> np.ndarray:
    """Each value the mean of those around it, of which the earlier ones are smoothed already; the ends stay."""
    y, half = np.asarray(x, float).tolist(), width // 2
    n = len(y)
    if n < width:
        return np.array(y)
    total = sum(y[:width])
    for i in range(half, n - half):
        new = total / width
        total += new - y[i] - y[i - half] + (y[i + half + 1] if i + half + 1 < n else 0)
        y[i] = new
    return np.array(y)


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def instantaneous_frequency(x: np.ndarray, fs: float) -> np.ndarray:
    return np.diff(np.unwrap(np.angle(analytic(x)))) * fs / (2 * np.pi)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values."""
    edge = np.flatnonzero(np.diff(x) != 0)
    return np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(x) - 1]])


def maxima(x: np.ndarray) -> np.ndarray:
    """Local maxima: the middle of each run that is higher than what stands beside it; runs at the ends are none."""
    if len(x) < 3:
        return np.empty(0, np.int64)
    first, last = runs(x)
    v = x[first]
    k = 1 + np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]))
    return (first[k] + last[k]) // 2


KEPT, REMOVED, UNKNOWN = 1, 0, -1


def spaced(at: np.ndarray, height: np.ndarray, distance: int, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """KEPT or REMOVED of each maximum: from the highest on (of equal ones the last) those less than `distance` away go.

    The places are linked in both directions, and what is removed leaves the links: each is passed once. Beyond low and
    high nothing is known: what that could change is UNKNOWN.
    """
    n = len(at)
    state, doubt = np.full(n, KEPT, np.int8), np.zeros(n, bool)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    place = at.tolist()
    for j in np.lexsort((at, height))[::-1].tolist():
        if state[j] == REMOVED:
            continue
        unsure = doubt[j] or place[j] - low < distance or high - place[j] < distance
        if unsure:
            state[j] = UNKNOWN
        for link, back, way in ((before, after, -1), (after, before, 1)):
            k = link[j]
            while 0 <= k < n and abs(place[k] - place[j]) < distance:
                if unsure:
                    doubt[k] = True
                elif state[k] == KEPT:
                    state[k] = REMOVED
                    if 0 <= before[k]:
                        after[before[k]] = after[k]
                    if after[k] < n:
                        before[after[k]] = before[k]
                k = link[k]
    return state


def bases(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each maximum the lowest value between it and the nearest higher one to its left, and whether there is one.

    A stack of falling heights, with the lowest value before each: over the maxima alone, for between two of them the
    values fall and rise once. Without a higher value the lowest of all to the left is given.
    """
    low, closed = np.empty(len(at)), np.zeros(len(at), bool)
    if not len(at):
        return low, closed
    valleys = np.minimum.reduceat(x[: at[-1] + 1], np.concatenate([[0], at[:-1]]))
    heights, lows = [float(x[0])], [np.inf]  # the first value counts as a height, for it may be higher than a maximum
    for k, (h, v) in enumerate(zip(x[at].tolist(), valleys.tolist())):
        while heights and heights[-1] <= h:
            v = min(v, lows.pop())
            heights.pop()
        low[k], closed[k] = v, bool(heights)
        heights.append(h)
        lows.append(v)
    return low, closed


def peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima at least `distance` apart, higher ones first, that rise far enough above their higher base."""
    x = np.asarray(x, float)
    at = maxima(x)
    left, right = bases(x, at)[0], bases(x[::-1], len(x) - 1 - at[::-1])[0][::-1]
    kept = spaced(at, x[at], distance) == KEPT
    return at[kept & (x[at] - np.maximum(left, right) >= prominence)]


#: Samples on either side that a shift by a part of a sample reads.
REACH = 128


def shift_taps(shift: float) -> np.ndarray:
    """A Kaiser-windowed sinc around `shift`: what it filters comes later by that part of a sample, to 1e-7 of a wave of up
    to 0.47 of the rate, and keeps its mean."""
    t = np.arange(-REACH, REACH + 1) - shift
    taps = np.sinc(t) * np.i0(14 * np.sqrt(np.maximum(0, 1 - (t / (REACH + 1)) ** 2)))
    return taps / taps.sum()
