"""Perceptual hash of grey images: resize by Lanczos, DCT-II, median, 64 bits.

Numeric and sequential per image, so Arrow batches of numpy work.  The transform is an FFT: on a
constant image every coefficient but the first must cancel exactly, which a matrix product does not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

SIDE, KEEP, LOBES = 32, 8, 3.0


def _weights(size: int, to: int) -> np.ndarray:
    """Rows of resampling weights; the support stretches when shrinking, edges are normalised anew."""
    scale = size / to
    stretch = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / stretch
    w = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


def resized(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    across = _rounded(grey @ _weights(grey.shape[1], side).T)
    return _rounded(_weights(grey.shape[0], side) @ across)


def dct2(x: np.ndarray) -> np.ndarray:
    """DCT-II along the last axis, by the FFT of the even-odd reordered sequence."""
    n = x.shape[-1]
    v = np.concatenate([x[..., ::2], x[..., 1::2][..., ::-1]], axis=-1)
    return (np.fft.fft(v, axis=-1) * np.exp(-1j * np.pi * np.arange(n) / (2 * n))).real


def image_hash(grey: np.ndarray) -> int:
    """Signed 64-bit pattern; the first coefficient is the highest bit."""
    c = dct2(dct2(resized(np.asarray(grey, np.float64))).T).T[:KEEP, :KEEP].astype(np.float32).ravel()
    s = np.sort(c)
    bits = c > (s[31] + s[32]) / 2
    return int(np.packbits(bits).view(">i8")[0])


def phash(pixels: Column, width: Column) -> Column:
    """Hash of pixels (array of grey values, row by row); null for null, empty or ragged images."""

    @pandas_udf("bigint")
    def run(p: pd.Series, w: pd.Series) -> pd.Series:
        ok = [x is not None and n == n and n > 0 and len(x) > 0 and len(x) % int(n) == 0 for x, n in zip(p, w, strict=True)]
        return pd.Series([image_hash(np.reshape(x, (-1, int(n)))) if k else None for x, n, k in zip(p, w, ok, strict=True)], dtype="Int64")

    return run(pixels, width)
