"""Array kernels over ARRAY<DOUBLE>, as pandas UDFs on Arrow batches; each function returns a Column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _map(values: pd.Series, f) -> pd.Series:
    return pd.Series([None if v is None else np.asarray(f(np.asarray(v, float)), float).tolist() for v in values], dtype=object)


def linear_resample(source: Column, values: Column, target: Column) -> Column:
    """Linear interpolation at target coordinates, constant beyond the ends."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([np.interp(c, a, b).tolist() for a, b, c in zip(x, y, t, strict=True)], dtype=object)

    return run(source, values, target)


def robust_normalise(power: Column, low: float = -8.0, high: float = 16.0) -> Column:
    """log1p, then median and interquartile range to 0 and 1, clipped."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            x = np.log1p(np.maximum(v, 0))
            q1, q2, q3 = np.percentile(x, [25, 50, 75])
            return np.clip((x - q2) / max(q3 - q1, 1e-6), low, high)

        return _map(values, one)

    return run(power)


def resample_fft(values: Column, source_rate: int, target_rate: int) -> Column:
    """Band-limited change of the sampling rate: the spectrum is cut or padded."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        def one(v):
            n = round(len(v) * target_rate / source_rate)
            spectrum = np.fft.rfft(v)
            out = np.zeros(n // 2 + 1, complex)
            k = min(len(out), len(spectrum))
            out[:k] = spectrum[:k]
            return np.fft.irfft(out, n) * n / len(v)

        return _map(series, one)

    return run(values)


def decimate(values: Column, source_rate: int, target_rate: int) -> Column:
    """Every k-th sample, after all frequencies from 0.45 of the target rate on are removed. The source rate must be a
    multiple of the target rate; equal rates leave the samples as they are."""
    if source_rate % target_rate:
        raise ValueError("the source rate isn't a multiple of the target rate")
    step = source_rate // target_rate

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        def one(v):
            if step == 1:
                return v
            z = np.fft.rfft(v)
            z[np.fft.rfftfreq(len(v), 1 / source_rate) >= 0.45 * target_rate] = 0
            return np.fft.irfft(z, len(v))[::step]

        return _map(series, one)

    return run(values)


def _batches(*series: pd.Series) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Positions of rows without a null and their values as matrices, all rows of one set of lengths at once."""
    by: dict[tuple, list[int]] = {}
    for i, row in enumerate(zip(*series, strict=True)):
        if all(v is not None for v in row):
            by.setdefault(tuple(len(v) for v in row), []).append(i)
    for at in by.values():
        yield at, [np.array([s.iat[i] for i in at], float) for s in series]


def whitened(rows: np.ndarray, references: np.ndarray, smoothing: int = 129, component: bool = False) -> np.ndarray:
    """Rows of a matrix, each divided by the smoothed spectral density of its reference, so that the reference would have
    unit deviation. Densities are means over strided views of all rows at once."""
    if rows.shape != references.shape or not (np.isfinite(rows).all() and np.isfinite(references).all()):
        raise ValueError("values and reference must be finite and of one length")
    level_of = np.median(references, axis=1, keepdims=True)
    both = np.fft.rfft(np.stack([references - level_of, rows if component else rows - level_of]))
    bins = both.shape[2]
    span = min(smoothing, max(3, 2 * (bins // 16) + 1))
    around = np.pad(np.square(np.abs(both[0])), ((0, 0), (span // 2, (span - 1) // 2)))
    density = np.lib.stride_tricks.sliding_window_view(around, span, axis=1).mean(2)
    floor = np.maximum(1e-6 * np.median(density, axis=1, keepdims=True), np.finfo(float).tiny)
    unit, out = np.fft.irfft(both / np.sqrt(np.maximum(density, floor)), rows.shape[1])
    deviation = unit.std(1, keepdims=True)
    if not (deviation > 1e-12).all():
        raise ValueError("the whitened reference has no variance")
    return out / deviation


def whiten(values: Column, reference: Column, smoothing: int = 129, component: bool = False) -> Column:
    """Values over the density of their reference, in units of the whitened reference's deviation. A component (part of
    a sum, as a signal in noise) keeps its level; other values lose the reference's median. Null where either is."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series, refs: pd.Series) -> pd.Series:
        out: list = [None] * len(series)
        for at, (x, r) in _batches(series, refs):
            for i, v in zip(at, whitened(x, r, smoothing, component), strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    return run(values, reference)


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2, mode="reflect"), size)[::hop]


def power_spectrogram(values: Column, size: int, hop: int) -> Column:
    """|STFT|^2, frequency by frequency in one flat array (bins = size // 2 + 1)."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return _map(series, lambda v: (np.abs(np.fft.rfft(_frames(v, size, hop) * np.hanning(size), axis=1)) ** 2).T.ravel())

    return run(values)


def resolution_plane(v: np.ndarray, rate: int, q: float, frequency_bins: int, time_bins: int, fmin: float, fmax: float) -> np.ndarray:
    """Power over (frequency, time) with windows of q / 32 seconds, 1/16 at least and 1 at most, on a grid from fmin to
    fmax (or half the rate) and from the first frame to the last."""
    size = min(max(16, round(min(max(q / 32, 0.0625), 1.0) * rate)), len(v))
    hop = max(1, (len(v) - size) // max(time_bins - 1, 1))
    frames = np.lib.stride_tricks.sliding_window_view(v, size)[::hop] * np.hanning(size)
    n = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames, n, axis=1)) ** 2
    have, want = np.fft.rfftfreq(n, 1 / rate), np.linspace(fmin, min(fmax, rate / 2), frequency_bins)
    rows = np.stack([np.interp(want, have, p) for p in power])
    t = np.linspace(0, 1, len(rows))
    return np.stack([np.interp(np.linspace(0, 1, time_bins), t, c) for c in rows.T])


def multiresolution_power(values: Column, rate: int, q_values: list[float], frequency_bins: int, time_bins: int, fmin: float, fmax: float) -> Column:
    """Power at several resolutions on one grid, flat in the order (q, frequency, time)."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return _map(series, lambda v: np.stack([resolution_plane(v, rate, q, frequency_bins, time_bins, fmin, fmax) for q in q_values]).ravel())

    return run(values)


def _hats(have: int, want: int) -> np.ndarray:
    """(want, have) matrix that reads `want` places of the unit interval off `have` knots, linearly between them."""
    place = np.linspace(0, max(have - 1, 0), want)[:, None]
    return np.clip(1 - np.abs(place - np.arange(have)), 0, None)


def suppressed(rows: np.ndarray, glitch: np.ndarray, chirp: np.ndarray, strength: float, size: int, hop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signals (rows) without what their glitch masks mark and their chirp masks don't protect; for each, the share of
    energy that went, and the mean gain. Masks are (row, resolution, frequency, time); the largest over resolutions counts.

    Gains are two matrix products with the masks. Frames that don't overlap are added to the signals together, as one
    strided view for each of the few places that a frame has between them.
    """
    count, n = rows.shape
    frames = 1 + max(0, -(-(n - size) // hop))
    taper = np.hamming(size)
    apart = -(-size // hop)  # every so many frames don't overlap
    room = (frames + apart) * hop + size
    view = np.lib.stride_tricks.sliding_window_view(np.pad(rows, ((0, 0), (0, room - n))), size, axis=1)
    spectra = np.fft.rfft(view[:, : frames * hop : hop] * taper)
    marked = np.clip(glitch.max(1), 0, 1) * (1 - np.clip(chirp.max(1), 0, 1))
    gain = np.clip(1 - strength * np.einsum("ta,rfa,gf->rtg", _hats(marked.shape[2], frames), marked, _hats(marked.shape[1], spectra.shape[2]), optimize=True), 0, 1)
    energy = np.square(np.abs(spectra))
    whole, kept = energy.sum((1, 2)), (energy * np.square(gain)).sum((1, 2))
    pieces = np.fft.irfft(spectra * gain, size) * taper
    signal, weight = np.zeros((count, room)), np.zeros((1, room))
    for first in range(min(apart, frames)):
        for into, what in ((signal, pieces[:, first::apart]), (weight, np.broadcast_to(taper * taper, (1, frames, size))[:, first::apart])):
            places = np.lib.stride_tricks.sliding_window_view(into, size, axis=1, writeable=True)[:, first * hop :: apart * hop]
            places[:, : what.shape[1]] += what
    clean = np.divide(signal, weight, out=signal, where=weight > 1e-10)[:, :n]
    removed = np.clip(np.divide(whole - kept, whole, out=np.zeros(count), where=whole > 0), 0, 1)
    return clean, removed, gain.mean((1, 2))


def mask_filter(values: Column, glitch: Column, chirp: Column, planes: tuple[int, int, int], strength: float = 0.9, size: int = 256, hop: int = 64) -> Column:
    """struct(cleaned, removed, mean_gain) of `suppressed`; masks are flat arrays of (resolution, frequency, time). Nulls
    where one of the three is null."""
    if not 0 <= strength <= 1 or size <= 1 or not 0 < hop <= size:
        raise ValueError("strength, window and hop of a mask filter are out of range")

    @F.pandas_udf("cleaned array<double>, removed double, mean_gain double")
    def run(series: pd.Series, bad: pd.Series, good: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None, None, None)] * len(series)
        for at, (x, b, g) in _batches(series, bad, good):
            cube = (len(at), *planes)
            for i, *row in zip(at, *suppressed(x, b.reshape(cube), g.reshape(cube), strength, size, hop), strict=True):
                out[i] = tuple(row)
        return pd.DataFrame(out, columns=["cleaned", "removed", "mean_gain"]).astype({"removed": float, "mean_gain": float})

    return run(values, glitch, chirp)


def pack_half(values: Column, most_error: float = 1e-3, least_overlap: float = 0.999999) -> Column:
    """struct(scale, packed, relative_error, overlap): values as half-precision numbers of a unit peak. Values that
    can't be had back within the error, or with too little overlap, are an error."""

    @F.pandas_udf("scale double, packed array<float>, relative_error double, overlap double")
    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        for v in series:
            x = np.asarray(v, float)
            scale = float(np.abs(x).max(initial=0))
            half = (x / scale if scale else x).astype(np.float16)
            back = half.astype(float) * scale
            norm = float(np.linalg.norm(x))
            error = float(np.linalg.norm(back - x)) / max(norm, 1e-300)
            both = float(np.linalg.norm(back)) * norm
            overlap = float(back @ x) / both if both > 0 else 1.0
            if not np.isfinite(x).all() or error > most_error or overlap < least_overlap:
                raise ValueError(f"half precision loses too much: error {error}, overlap {overlap}")
            rows.append((scale, half.astype(np.float32).tolist(), error, overlap))
        return pd.DataFrame(rows, columns=["scale", "packed", "relative_error", "overlap"])

    return run(values)


def unpack_half(packed: Column) -> Column:
    return F.transform(packed["packed"], lambda x: x.cast("double") * packed["scale"])


def mixture(background: Column, packed: Column) -> Column:
    """A background with a packed signal added sample by sample (both of one length)."""
    return F.zip_with(background, unpack_half(packed), lambda a, b: a + b)


def lag_coherence(a: Column, b: Column, most: int) -> Column:
    """struct(lag, coherence): the largest |normalised correlation| over lags -most..most; the smallest lag wins ties.
    A positive lag means that b comes later."""

    @F.pandas_udf("lag int, coherence double")
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(left, right, strict=True):
            x, y = np.asarray(x, float), np.asarray(y, float)
            best = (-most, -1.0)
            for lag in range(-most, most + 1):
                u, v = (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[: len(y) + lag])
                norm = float(np.sqrt((u * u).sum() * (v * v).sum()))
                c = abs(float((u * v).sum())) / norm if norm > 0 else 0.0
                if c > best[1]:
                    best = (lag, c)
            rows.append(best)
        return pd.DataFrame(rows, columns=["lag", "coherence"])

    return run(a, b)


def comoving_distance(z: Column, hubble: float = 67.7, matter: float = 0.31, most: float = 20.0, points: int = 20_001) -> Column:
    """Megaparsecs in a flat universe, from a table of the integral (trapezoids) and linear interpolation."""
    grid = np.linspace(0, most, points)
    e = 1 / np.sqrt(matter * (1 + grid) ** 3 + 1 - matter)
    total = np.concatenate([[0], np.cumsum((e[1:] + e[:-1]) / 2 * np.diff(grid))]) * 299_792.458 / hubble

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(x, grid, total))

    return run(z)
