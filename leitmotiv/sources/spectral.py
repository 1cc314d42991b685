"""Samples of a signal to band energies over time: linear bands of a spectrogram, or mel bands in decibels.

samples(series_id, t, value) are cut into chunks of frames, each with the samples its frames reach into, so a recording of any length is
spread over tasks. The result is points(series_id, t, dim, value): t the frame, dim the band.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES = 4096


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """The periodic tapered cosine window."""
    x = np.arange(n) / n
    ramp = alpha / 2
    rise, fall = x < ramp, x >= 1 - ramp
    out = np.ones(n)
    out[rise] = 0.5 * (1 + np.cos(np.pi * (x[rise] / ramp - 1)))
    out[fall] = 0.5 * (1 + np.cos(np.pi * ((x[fall] - 1) / ramp + 1)))
    return out


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def mel_filters(rate: float, n_fft: int, bands: int, low: float, high: float) -> np.ndarray:
    """Triangles of equal area on the mel scale that is linear up to 1 kHz (15 mels) and logarithmic above: bands x frequencies."""
    step = np.log(6.4) / 27

    def to_mel(f: np.ndarray) -> np.ndarray:
        return np.where(f < 1000, 3 * f / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)

    mels = np.linspace(*to_mel(np.array([low, high])), bands + 2)
    edges = np.where(mels < 15, 200 * mels / 3, 1000 * np.exp(step * (mels - 15)))
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def framed(samples: DataFrame, length: int, hop: int, offset: int, kernel: Callable[[np.ndarray], np.ndarray], centred: bool) -> DataFrame:
    """kernel: frames x length to frames x bands. Frame f starts at sample f * hop - offset; samples beyond the ends are 0 if centred,
    else only full frames count."""
    span = samples.groupBy("series_id").agg((F.max("t") + 1).alias("_n"))
    reach = FRAMES * hop
    first = F.floor((F.col("t") + offset - length + 1) / reach)
    chunk = F.explode(F.sequence(F.greatest(F.lit(0), first).cast("bigint"), F.floor((F.col("t") + offset) / reach).cast("bigint")))
    rows = samples.join(F.broadcast(span), "series_id").select("series_id", "_n", "t", "value", chunk.alias("_c"))  # one row a series

    def run(key: tuple, table: pa.Table) -> pa.Table:
        series, c = key[0].as_py(), key[1].as_py()
        n = table["_n"][0].as_py()
        last = n // hop + 1 if centred else (n - length) // hop + 1
        frames = np.arange(c * FRAMES, min(last, (c + 1) * FRAMES))
        if not len(frames):
            return pa.table({"series_id": pa.array([], pa.string()), "t": pa.array([], pa.int64()), "dim": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
        start = frames[0] * hop - offset
        signal = np.zeros((len(frames) - 1) * hop + length)
        at = np.asarray(table["t"]) - start
        ok = (at >= 0) & (at < len(signal))
        signal[at[ok]] = np.asarray(table["value"])[ok]
        out = kernel(np.lib.stride_tricks.sliding_window_view(signal, length)[::hop])
        bands = out.shape[1]
        return pa.table({
            "series_id": pa.array([series] * out.size, pa.string()), "t": np.repeat(frames, bands),
            "dim": np.tile(np.arange(bands, dtype=np.int32), len(frames)), "value": out.ravel().astype(float),
        })

    return rows.groupBy("series_id", "_c").applyInArrow(run, "series_id string, t bigint, dim int, value double")


def band_energies(samples: DataFrame, rate: float, length: int = 8, overlap: int = 4, bands: int = 32, low: float = 1.0, high: float = 20.0) -> DataFrame:
    """The mean power density in each of `bands` equal bands; NaN for bands without a frequency of the transform."""
    window = tukey(length)
    scale = 1 / (rate * (window**2).sum())
    f = np.arange(length // 2 + 1) * rate / length
    edges = np.linspace(low, high, bands + 1)
    masks = [(f >= a) & (f < b) for a, b in zip(edges[:-1], edges[1:])]

    def kernel(frames: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window, axis=1)) ** 2 * scale
        power[:, 1 : None if length % 2 else -1] *= 2
        return np.stack([power[:, m].mean(1) if m.any() else np.full(len(power), np.nan) for m in masks], 1)

    return framed(samples, length, length - overlap, 0, kernel, centred=False)


def mel_decibels(samples: DataFrame, rate: float, n_fft: int = 2048, win_length: int = 256, hop: int = 128, bands: int = 32, low: float = 0.0, high: float = 8000.0, range_db: float = 80.0) -> DataFrame:
    """Mel-band power in dB below the series' largest, cut off at range_db."""
    window = np.zeros(n_fft)
    pad = (n_fft - win_length) // 2
    window[pad : pad + win_length] = hann(win_length)
    filters = mel_filters(rate, n_fft, bands, low, high)

    def kernel(frames: np.ndarray) -> np.ndarray:
        out = np.empty((len(frames), bands))
        for k in range(0, len(frames), 512):
            out[k : k + 512] = np.abs(np.fft.rfft(frames[k : k + 512] * window, axis=1)) ** 2 @ filters.T
        return out

    power = framed(samples, n_fft, hop, n_fft // 2, kernel, centred=True)
    most = power.groupBy("series_id").agg(F.max("value").alias("_most"))
    db = lambda x: 10 * F.log10(F.greatest(F.lit(1e-10), x))
    out = power.join(F.broadcast(most), "series_id")  # one row a series
    return out.select("series_id", "t", "dim", F.greatest(db(F.col("value")) - db(F.col("_most")), F.lit(-range_db)).alias("value"))
