"""Levels, envelopes and spectra of signals in array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def peak_db(signal: Column) -> Column:
    return 20 * F.log10(F.greatest(F.array_max(F.transform(signal, lambda x: F.abs(x.cast("double")))), F.lit(1e-8)))


def rms_db(signal: Column) -> Column:
    mean = F.aggregate(signal, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(signal)
    return 20 * F.log10(F.greatest(F.sqrt(mean), F.lit(1e-8)))


def envelope(signal: Column, bins: int = 200) -> Column:
    """Greatest absolute value of each of ``bins`` equal parts."""
    at = lambda i: F.floor(i * F.size(signal) / bins).cast("int")
    part = lambda i: F.slice(signal, at(i) + 1, F.greatest(at(i + 1) - at(i), F.lit(1)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.array_max(F.transform(part(i), lambda x: F.abs(x.cast("double")))), F.lit(0.0)))


def spectrum(size: int = 256, hop: int = 128):
    """Arrow-batched function: magnitudes of Hann-windowed frames."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def find(signals: pd.Series) -> pd.Series:
        window = np.hanning(size)
        out = []
        for s in signals:
            x = np.asarray(s if s is not None else [], dtype=np.float64)
            x = np.pad(x, (0, max(0, size - len(x))))
            frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * window
            out.append(np.abs(np.fft.rfft(frames, axis=1)).tolist())
        return pd.Series(out)

    return find
