"""Colour panels of maps and masks as PNG, for looking at results. Written with zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def palette() -> np.ndarray:
    """256 RGB colours from blue over green and yellow to red, by three shifted ramps."""
    t = np.linspace(0, 1, 256)[:, None]
    ramps = 1.5 - np.abs(4 * t - np.array([3.0, 2.0, 1.0]))
    return (255 * np.clip(ramps, 0, 1)).round().astype(np.uint8)


def colour_index(depth: np.ndarray) -> np.ndarray:
    """As the array expression of the same name: by the range of finite values, NaN and -inf low, +inf high."""
    d = np.asarray(depth, float)
    ok = np.isfinite(d)
    if not ok.any():
        return np.zeros(d.shape, np.int64)
    lo, hi = d[ok].min(), d[ok].max()
    share = np.zeros(d.shape)
    if hi > lo:
        share[ok] = (d[ok] - lo) / (hi - lo)
    share[d == np.inf] = 1
    return np.floor(np.clip(share, 0, 1) * 255).astype(np.int64)


def colourise(depth: np.ndarray) -> np.ndarray:
    """(h, w, 3) colours; a map without a finite value is black."""
    if not np.isfinite(depth).any():
        return np.zeros((*np.shape(depth), 3), np.uint8)
    return palette()[colour_index(depth)]


def colour_bar(height: int, width: int = 16) -> np.ndarray:
    """A gradient from the highest colour at the top to the lowest."""
    rows = np.linspace(255, 0, height).round().astype(int)
    return np.repeat(palette()[rows][:, None, :], width, 1)


def outline(mask: np.ndarray) -> np.ndarray:
    """Pixels of a mask with a neighbour outside it."""
    m = np.pad(np.asarray(mask, bool), 1)
    inner = m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    return m[1:-1, 1:-1] & ~inner


def overlay(depth: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """Colours of a map with the outlines of masks in white."""
    out = colourise(depth).copy()
    for m in masks:
        out[outline(m)] = 255
    return out


def pair(original: np.ndarray, calibrated: np.ndarray) -> np.ndarray:
    """Both maps side by side with a bar."""
    return np.concatenate([colourise(original), colourise(calibrated), colour_bar(np.shape(original)[0])], 1)


def png(image: np.ndarray) -> bytes:
    """An (h, w, 3) image as PNG."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, 3 * w)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def pair_png(h: pd.Series, w: pd.Series, original: pd.Series, calibrated: pd.Series) -> pd.Series:
    """A column of side-by-side panels."""
    return pd.Series([png(pair(np.reshape(a, (y, x)), np.reshape(b, (y, x)))) for y, x, a, b in zip(h, w, original, calibrated, strict=True)])


def write_panels(panels: DataFrame, folder: str) -> DataFrame:
    """Write (name, png) rows; a panel that fails is left out. Returns the names written."""
    from ..sources.files import put_file

    def save(batches):
        for pdf in batches:
            done = []
            for name, data in zip(pdf["name"], pdf["png"], strict=True):
                try:
                    put_file(folder, name, bytes(data))
                    done.append(name)
                except (OSError, TypeError):
                    continue
            yield pd.DataFrame({"name": done})

    return panels.select("name", "png").mapInPandas(save, "name string")
